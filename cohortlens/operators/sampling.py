"""Sampling and splitting (P1-P10, W10). Every random choice comes from
:func:`cohortlens.functions.hashing.uniform`, so results do not depend on the
partitioning and can be replayed in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .ranking import null_safe_join, ordered_position, unit_ranges


def weighted_sample(df: DataFrame, strata: Sequence[str], n: int, weight: str, id_col: str,
                    seed: int = 0) -> DataFrame:
    """N rows per stratum without replacement, chance proportional to
    ``weight`` (Efraimidis-Spirakis: smallest ``-ln(u)/w`` wins; the same
    distribution as successive weighted draws).

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before
    the shuffle, so each map task sends at most n rows per stratum: a hot
    stratum does not move its rows.
    """
    key = -F.log(uniform(F.col(id_col), seed)) / F.col(weight)
    w = Window.partitionBy(*strata).orderBy(key, F.col(id_col))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def hash_order_position(df: DataFrame, by: Sequence[str], id_col: str, seed: int = 0,
                        out: str = "pos", total: str | None = None) -> DataFrame:
    """1-based position in a seeded random order (by ``u(id, seed)``)
    inside ``by``; skew-safe (see :mod:`.ranking`)."""
    u = uniform(F.col(id_col), seed)
    d = df.withColumn("__u", u)
    res = ordered_position(d, by, [F.col("__u"), F.col(id_col)], unit_ranges(d, "__u"), out=out, total=total)
    return res.drop("__u")


def random_parts(df: DataFrame, n_parts: int, id_col: str, seed: int = 0, out: str = "part") -> DataFrame:
    """Split into ``n_parts`` random parts of equal size; the first parts
    take one extra row (the sizes of ``array_split`` / ``ntile``). Parts are
    numbered from 1."""
    d = hash_order_position(df, [], id_col, seed, out="__p", total="__n")
    q = F.floor(F.col("__n") / n_parts)
    r = F.col("__n") - q * n_parts
    big = r * (q + 1)
    part = F.when(F.col("__p") <= big, F.floor((F.col("__p") - 1) / (q + 1)) + 1) \
        .otherwise(r + F.floor((F.col("__p") - big - 1) / q) + 1)
    return d.withColumn(out, part.cast("int")).drop("__p", "__n")


def _train_quotas(counts: DataFrame, by: Sequence[str], label: str, test_size: float | str) -> DataFrame:
    """Per (group, class): rows that go to train. n_test = ceil(f * n);
    the train rows are shared over the classes by largest remainder, ties to
    the lower class value."""
    g = Window.partitionBy(*by) if by else Window.partitionBy()
    c = counts.withColumn("__n", F.sum("__nc").over(g))
    ts = F.col(test_size) if isinstance(test_size, str) else F.lit(test_size)
    c = c.withColumn("__ntrain", F.col("__n") - F.ceil(ts * F.col("__n")))
    exact = F.col("__ntrain") * F.col("__nc") / F.col("__n")
    c = c.withColumn("__fl", F.floor(exact)).withColumn("__rem", exact - F.floor(exact))
    c = c.withColumn("__left", F.col("__ntrain") - F.sum("__fl").over(g))
    rank = F.row_number().over(g.orderBy(F.col("__rem").desc(), F.col(label)))
    c = c.withColumn("__quota", F.col("__fl") + F.when(rank <= F.col("__left"), 1).otherwise(0))
    return c.select(*by, label, "__quota")


def stratified_split(df: DataFrame, by: Sequence[str], label: str, test_size: float | str, id_col: str,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """Inside each group of ``by``, split rows into 'train'/'test' with
    class shares of ``label`` kept (largest-remainder quotas), the rows of
    each class taken in seeded random order. A class with one row goes to
    train (the study's library raises there). ``test_size`` may name a
    column (then it must be part of ``by``): one job splits at many sizes."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__nc"))
    quotas = _train_quotas(counts, by, label, test_size)
    ranked = hash_order_position(df, [*by, label], id_col, seed, out="__pos")
    res = null_safe_join(ranked, quotas, [*by, label])
    return (res.withColumn(out, F.when(F.col("__pos") <= F.col("__quota"), F.lit("train")).otherwise(F.lit("test")))
            .drop("__pos", "__quota"))


def stratified_splits(df: DataFrame, by: Sequence[str], label: str, test_sizes: Sequence[float], id_col: str,
                      seed: int = 42, out: str = "split", size: str = "test_size") -> DataFrame:
    """P4 at several test sizes: the rows of :func:`stratified_split` at each
    size, with it in column ``size``. The seeded order within a class is the
    same at all sizes, so rows are numbered once and multiplied last."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__nc"))
    counts = counts.withColumn(size, F.explode(F.array(*[F.lit(s) for s in test_sizes])))
    quotas = (_train_quotas(counts, [size, *by], label, size)
              .groupBy(*by, label).agg(F.collect_list(F.struct(size, "__quota")).alias("__quotas")))
    ranked = hash_order_position(df, [*by, label], id_col, seed, out="__pos")
    res = null_safe_join(ranked, quotas, [*by, label]).select("*", F.inline("__quotas"))
    return (res.withColumn(out, F.when(F.col("__pos") <= F.col("__quota"), F.lit("train")).otherwise(F.lit("test")))
            .drop("__pos", "__quota", "__quotas"))


def three_way_split(df: DataFrame, by: Sequence[str], label: str, test_size: float, val_size: float,
                    id_col: str, seed: int = 42, out: str = "split") -> DataFrame:
    """Test first, then validation out of the rest with
    ``val / (1 - test)``."""
    first = stratified_split(df, by, label, test_size, id_col, seed, out="__s1")
    rest = first.filter(F.col("__s1") == "train")
    second = stratified_split(rest.drop("__s1"), by, label, val_size / (1.0 - test_size), id_col, seed + 1,
                              out="__s2")
    test = first.filter(F.col("__s1") == "test").drop("__s1").withColumn(out, F.lit("test"))
    rest = second.withColumn(out, F.when(F.col("__s2") == "train", F.lit("train")).otherwise(F.lit("val"))) \
        .drop("__s2")
    return test.unionByName(rest)


def stratified_folds(df: DataFrame, label: str, k: int, id_col: str, seed: int = 0,
                     by: Sequence[str] = (), out: str = "fold") -> DataFrame:
    """Stratified k-fold. Rows are laid out class by class, each class in
    seeded random order; fold = position mod k (fold numbers from 0). The
    position is the class offset plus the position inside the class, so no
    window spans all rows."""
    by = list(by)
    ranked = hash_order_position(df, [*by, label], id_col, seed, out="__pos")
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__nc"))
    g = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(label) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*by, label, F.coalesce(F.sum("__nc").over(g), F.lit(0)).alias("__off"))
    res = null_safe_join(ranked, offs, [*by, label])
    return (res.withColumn(out, F.pmod(F.col("__off") + F.col("__pos") - 1, F.lit(k)).cast("int"))
            .drop("__pos", "__off"))


def folds(df: DataFrame, k: int, id_col: str, seed: int = 0, out: str = "fold") -> DataFrame:
    """Plain shuffled k-fold (P6 with a single class)."""
    d = df.withColumn("__one", F.lit(0))
    return stratified_folds(d, "__one", k, id_col, seed, out=out).drop("__one")


def cap_split(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """At most ``n`` random rows (n < 0: all rows, n = 0: none). This is
    a sampling operator: the cap is the feature."""
    if n < 0:
        return df
    if n == 0:
        return df.limit(0)
    w = Window.orderBy(uniform(F.col(id_col), seed), F.col(id_col))
    # row_number() <= n over one global order is planned as a partial
    # top-n per task followed by a merge of at most n rows per task.
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def select_task(df: DataFrame, task: str, shot_size: int, fold: int) -> DataFrame:
    """P10: rows of a few-shot split table for one task: training rows of the
    given shot size (-1 = all sizes) and fold, plus all validation and test rows."""
    t = df.filter(F.col("task") == task)
    train = t.filter((F.col("split_name") == "train") & (F.col("fold") == fold))
    if shot_size >= 0:
        train = train.filter(F.col("shot_size") == shot_size)
    return train.unionByName(t.filter(F.col("split_name").isin("val", "test")))
