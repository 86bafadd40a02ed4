"""Ridge regression over folds and penalties from one pass (M4, M7).

One pass over the rows gives, for each fold, the products of all columns
(with a column of ones and the label) in blocks of ``BLOCK`` x ``BLOCK``
numbers, and the largest absolute value of each column. The training part of
a fold is the whole minus the fold, so no row is read again for another fold;
one factorisation of a fold's centred and scaled matrix then serves all
penalties. A task holds one strip of blocks of each fold, as many strips at
a time as ``TASK_BYTES`` allow (wide vectors take several passes), and the
blocks of the tasks are added in two steps, so that no task meets those of
all others. The solution equals the closed form
``(X'X + alpha I)^-1 X'y`` on centred columns divided by the training rows'
largest absolute values (M1), a column of zeros by one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

RIDGE_ALPHA = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
BLOCK = 256
TASK_BYTES = 256 << 20
WHOLE = -1  # the fold number of all rows together
PARTS = "fold int, i int, j int, values array<double>"


@dataclass
class RidgeModel:
    """Weights of the unscaled columns."""
    weights: list[float]
    intercept: float
    alpha: float

    def predict(self, col: str) -> Column:
        return dot(F.col(col), F.lit(self.weights)) + F.lit(self.intercept)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def strips_of(width: int, folds: int, task_bytes: int) -> list[list[int]]:
    """Block rows by pass: as many as a task can hold for all folds."""
    blocks = -(-width // BLOCK)
    each = max(1, task_bytes // (8 * folds * BLOCK * width))
    return [list(range(at, min(at + each, blocks))) for at in range(0, blocks, each)]


def fold_products(rows: DataFrame, width: int, folds: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(fold, i, j, values)`` from ``rows(fold, y, x)``: block (i, j), i <= j,
    of the products of [x, 1, y]; block (-1, -1) is the largest |x|."""
    full = width + 2

    def run(wanted: list[int], with_max: bool):
        def of(batches):
            sums: dict[int, dict] = {}
            for pdf in batches:
                for fold, part in pdf.groupby("fold"):
                    x = np.stack(part["x"].to_list()).astype(np.float64)
                    a = np.column_stack([x, np.ones(len(x)), part["y"].to_numpy(np.float64)])
                    have = sums.setdefault(int(fold), {i: np.zeros((min(BLOCK, full - i * BLOCK), full - i * BLOCK)) for i in wanted})
                    for i in wanted:
                        have[i] += a[:, i * BLOCK:(i + 1) * BLOCK].T @ a[:, i * BLOCK:]
                    if with_max:
                        have[-1] = np.maximum(have.get(-1, 0.0), np.abs(x).max(axis=0))
            out = []
            for fold, have in sums.items():
                for i in wanted:
                    out += [(fold, i, j, have[i][:, (j - i) * BLOCK:(j - i + 1) * BLOCK].ravel()) for j in range(i, -(-full // BLOCK))]
                if with_max:
                    out.append((fold, -1, -1, have[-1]))
            if out:
                yield pd.DataFrame(out, columns=["fold", "i", "j", "values"])
        return of

    def added(key, pdf):
        values = np.stack(pdf["values"].to_list())
        total = values.max(axis=0) if key[1] < 0 else values.sum(axis=0)
        return pd.DataFrame([(key[0], key[1], key[2], total)], columns=["fold", "i", "j", "values"])

    out = None
    for n, wanted in enumerate(strips_of(full, folds, task_bytes)):
        parts = materialize(rows.mapInPandas(run(wanted, n == 0), PARTS).withColumn("part", F.spark_partition_id()))
        groups = max(1, int(parts.agg(F.count_distinct("part")).first()[0] ** 0.5))
        some = parts.groupBy("fold", "i", "j", F.pmod("part", F.lit(groups)).alias("group")).applyInPandas(added, PARTS)
        whole = some.groupBy("fold", "i", "j").applyInPandas(added, PARTS)
        out = whole if out is None else out.unionByName(whole)
    return materialize(out)


def solved(products: DataFrame, width: int, alphas: Sequence[float], nested: bool = False) -> DataFrame:
    """``(fold, alpha, weights, intercept)`` of the rows outside each fold, and
    of all rows (fold ``WHOLE``); ``nested``: of the rows of each fold and of
    those with smaller numbers, so that each training set holds the smaller
    ones."""
    alphas, full = list(alphas), width + 2

    def left_out(key, pdf):
        by = {int(f): np.array(v) for f, v in zip(pdf["fold"], pdf["values"])}
        if key[0] < 0:
            rest = {f: np.maximum.reduce([v for g, v in by.items() if g != f] or [np.zeros(width)]) for f in by}
            rest[WHOLE] = np.maximum.reduce(list(by.values()))
        else:
            whole = sum(by.values())
            rest = {f: whole - v for f, v in by.items()} | {WHOLE: whole}
        return pd.DataFrame([(f, key[0], key[1], v) for f, v in rest.items()], columns=["fold", "i", "j", "values"])

    def prefixes(key, pdf):
        out, have = [], None
        for f, v in sorted(zip(pdf["fold"], pdf["values"]), key=lambda x: x[0]):
            v = np.array(v)
            have = v if have is None else np.maximum(have, v) if key[0] < 0 else have + v
            out.append((f, key[0], key[1], have))
        return pd.DataFrame(out, columns=["fold", "i", "j", "values"])

    def solve(key, pdf):
        g, scale = np.zeros((full, full)), np.ones(width)
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["values"]):
            if i < 0:
                scale = np.where(np.array(v) > 0, v, 1.0)
                continue
            block = np.array(v).reshape(min(BLOCK, full - i * BLOCK), -1)
            g[i * BLOCK:(i + 1) * BLOCK, j * BLOCK:(j + 1) * BLOCK] = block
            g[j * BLOCK:(j + 1) * BLOCK, i * BLOCK:(i + 1) * BLOCK] = block.T
        n = g[width, width]
        if n < 0.5:  # all rows are in the fold
            return pd.DataFrame([], columns=["fold", "alpha", "weights", "intercept"])
        mean = g[:, width] / n
        centred = g - n * np.outer(mean, mean)
        values, turn = np.linalg.eigh(centred[:width, :width] / np.outer(scale, scale))
        seen = turn.T @ (centred[:width, width + 1] / scale)
        out = []
        for alpha in alphas:
            w = turn @ (seen / (np.maximum(values, 0) + alpha)) / scale
            out.append((key[0], alpha, w, float(mean[width + 1] - w @ mean[:width])))
        return pd.DataFrame(out, columns=["fold", "alpha", "weights", "intercept"])

    training = products.groupBy("i", "j").applyInPandas(prefixes if nested else left_out, PARTS)
    return training.groupBy("fold").applyInPandas(solve, "fold int, alpha double, weights array<double>, intercept double")


def ridge_folds(train: DataFrame, label: str, fold_col: str = "fold", col: str = "embedding",
                alphas: Sequence[float] = tuple(RIDGE_ALPHA), task_bytes: int = TASK_BYTES) -> tuple[DataFrame, RidgeModel | None]:
    """M7 for ridge: ``(fold, alpha, r2, mae, n)`` of every fold's rows under the
    model of the other rows, and the model of all rows with the penalty of
    the best mean R2 (the smaller penalty of two). Rows without a label or
    with a vector of another width than the first are an error of the input."""
    rows = train.select(F.col(fold_col).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), F.col(col).alias("x"))
    rows = materialize(rows)
    folds = rows.agg(F.count_distinct("fold"), F.max(F.size("x"))).first()
    if not folds[0]:
        return train.sparkSession.createDataFrame([], "fold int, alpha double, r2 double, mae double, n long"), None
    found = materialize(solved(fold_products(rows, folds[1], folds[0], task_bytes), folds[1], alphas))
    # folds x penalties rows, both parameters
    tried = rows.join(F.broadcast(found.filter(F.col("fold") != WHOLE)), "fold").select(
        "fold", "alpha", "y", (dot(F.col("x"), F.col("weights")) + F.col("intercept")).alias("f"))
    sums = tried.groupBy("fold", "alpha").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("f"))).alias("mae"),
        F.sum(F.pow(F.col("y") - F.col("f"), 2)).alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"))
    scores = materialize(sums.select("fold", "alpha", (1 - F.try_divide("sse", "sst")).alias("r2"), "mae", "n"))
    best = scores.groupBy("alpha").agg(F.avg("r2").alias("mean")).orderBy(F.desc_nulls_last("mean"), "alpha").first()
    alpha = best["alpha"] if best else alphas[0]
    row = found.filter((F.col("fold") == WHOLE) & (F.col("alpha") == alpha)).first()
    return scores, RidgeModel(list(row["weights"]), row["intercept"], alpha)


def nested_curve(df: DataFrame, label: str, order: Column, sizes: Sequence[float], col: str = "embedding", alpha: float = 1.0,
                 task_bytes: int = TASK_BYTES) -> DataFrame:
    """C20: AUROC by training share from nested training sets. ``order`` gives
    each row a uniform number in [0, 1); the training set of share s has the
    rows below s, the test set the others, so each set is a prefix of the
    next and all fits come from one pass of products, added up share by
    share: ``(train_share, n_train, n_test, auroc)``."""
    from . import metrics as M

    cuts = sorted(sizes)
    step = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        step = F.when(order < cuts[i], i).otherwise(step)
    rows = materialize(df.select(step.cast("int").alias("fold"), F.col(label).cast("double").alias("y"), F.col(col).alias("x")))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return df.sparkSession.createDataFrame([], "train_share double, n_train long, n_test long, auroc double")
    models = materialize(solved(fold_products(rows, width, len(cuts) + 1, task_bytes), width, [alpha], nested=True))
    shares = F.array(*[F.lit(float(c)) for c in cuts])
    # a row a share, a parameter
    tested = rows.join(F.broadcast(models.filter(F.col("fold") < len(cuts)).withColumnRenamed("fold", "step")), F.col("fold") > F.col("step"))
    scored = tested.select("step", "y", (dot(F.col("x"), F.col("weights")) + F.col("intercept")).alias("p"))
    sizes_of = rows.groupBy("fold").agg(F.count("*").alias("n"))
    below = [F.sum(F.when(F.col("fold") <= i, F.col("n")).otherwise(F.lit(0))).cast("long") for i in range(len(cuts))]
    total = sizes_of.agg(F.array(*below).alias("train"), F.sum("n").alias("all"))
    n = total.select(F.posexplode("train").alias("step", "n_train"), "all")
    return (M.auroc(scored, "y", "p", by=["step"]).join(n, "step")
            .select(F.get(shares, F.col("step")).alias("train_share"), "n_train", (F.col("all") - F.col("n_train")).alias("n_test"), "auroc"))


def cv_summary(scores: DataFrame, value: str = "r2") -> DataFrame:
    """``(alpha, folds, mean, std, n_folds)``, std with ddof 1 and 0 for one fold."""
    return scores.groupBy("alpha").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("fold", value))), lambda x: x[value]).alias("folds"),
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).cast("int").alias("n_folds"))
