"""Evaluation metrics as grouped aggregations.

Rank metrics first collapse rows to one row per (group, score) with the
positive and negative weight at that score (partial aggregation), then take
cumulative sums over scores with the skew-safe running sums of
:mod:`.ranking` (score ranges by quantiles), so neither a hot group nor a
narrow band of scores lands in one task. Every metric takes ``by`` columns, so one
job scores all variants / draws / classes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ordered_position, with_ranges


def _w(w) -> Column:
    return F.lit(1.0) if w is None else (F.col(w) if isinstance(w, str) else w).cast("double")


def score_ranges(df: DataFrame, p: str, out: str = "__range") -> DataFrame:
    """Add the range number of the score (missing scores: -1), by quantiles
    over the rows. Compute it once before rows are multiplied (draws,
    variants) and name it in ``ranges`` of a rank metric."""
    score = F.col(p).cast("double")
    return with_ranges(df, score, out).withColumn(out, F.when(score.isNull(), -1).otherwise(F.col(out)["range"]))


def _score_table(df: DataFrame, y: str, p: str, w, by: Sequence[str], ranges: str | None) -> DataFrame:
    """One row per (group, score) with its range."""
    pos = F.when(F.col(y).cast("double") > 0, _w(w)).otherwise(F.lit(0.0))
    neg = F.when(F.col(y).cast("double") > 0, F.lit(0.0)).otherwise(_w(w))
    rows = df.select(*by, F.col(p).cast("double").alias("__p"), pos.alias("__pos"), neg.alias("__neg"),
                     *([F.col(ranges).alias("__range")] if ranges else []))
    s = rows.groupBy(*by, *(["__range"] if ranges else []), "__p").agg(
        F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"))
    return s if ranges else score_ranges(s, "__p")


def auroc(df: DataFrame, y: str, p: str, w=None, by: Sequence[str] = (), out: str = "auroc",
          ranges: str | None = None) -> DataFrame:
    """M9: area under the ROC curve with weights; tied scores count half.
    Groups without both classes give null."""
    by = list(by)
    s = _score_table(df, y, p, w, by, ranges)
    s = ordered_position(s, by, [F.col("__p")], F.col("__range"), out="__k",
                         running={"__cneg": F.col("__neg")})
    below = F.col("__cneg") - F.col("__neg")
    contrib = F.col("__pos") * (below + F.col("__neg") / 2.0)
    agg = s.groupBy(*by).agg(F.sum(contrib).alias("__num"), F.sum("__pos").alias("__P"),
                             F.sum("__neg").alias("__N"))
    return agg.select(*by, F.when((F.col("__P") > 0) & (F.col("__N") > 0),
                                  F.col("__num") / (F.col("__P") * F.col("__N"))).alias(out))


def average_precision(df: DataFrame, y: str, p: str, w=None, by: Sequence[str] = (),
                      out: str = "auprc", ranges: str | None = None) -> DataFrame:
    """Step-wise average precision, sum over distinct thresholds
    (descending) of recall increase times precision."""
    by = list(by)
    s = _score_table(df, y, p, w, by, ranges)
    s = s.withColumn("__np", -F.col("__p"))
    falling = F.when(F.col("__range") < 0, F.lit(None)).otherwise(-F.col("__range"))
    s = ordered_position(s, by, [F.col("__np")], falling, out="__k",
                         running={"__ctp": F.col("__pos"), "__ctot": F.col("__pos") + F.col("__neg")})
    agg = s.groupBy(*by).agg(F.sum(F.col("__pos") * F.col("__ctp") / F.col("__ctot")).alias("__num"),
                             F.sum("__pos").alias("__P"))
    return agg.select(*by, F.when(F.col("__P") > 0, F.col("__num") / F.col("__P")).alias(out))


def brier(df: DataFrame, y: str, p: str, w=None, by: Sequence[str] = (), out: str = "brier") -> DataFrame:
    """Weighted mean squared difference of probability and outcome."""
    ww = _w(w)
    sq = ww * F.pow(F.col(p).cast("double") - F.col(y).cast("double"), 2)
    return df.groupBy(*by).agg((F.sum(sq) / F.sum(ww)).alias(out))


def brier_multiclass(df: DataFrame, y: str, probs: str, by: Sequence[str] = (), out: str = "brier") -> DataFrame:
    """M11, several classes: per row the sum over classes of
    (p_c - [y = c])^2, averaged over rows; classes are array positions."""
    per_row = F.aggregate(F.transform(F.col(probs), lambda x, i: F.pow(x.cast("double") - F.when(
        F.col(y) == i, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, b: a + b)
    return df.groupBy(*by).agg(F.avg(per_row).alias(out))


def one_vs_rest(df: DataFrame, y: str, probs: str, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """M12 input: one row per (row, class) with the class score and a 0/1
    outcome (``posexplode`` of the probability array)."""
    e = df.select(*by, id_col, F.col(y).alias("__y"), F.posexplode(probs).alias("class_index", "score"))
    return e.withColumn("y_c", (F.col("__y") == F.col("class_index")).cast("int")).drop("__y")


def auroc_ovr(df: DataFrame, y: str, probs: str, id_col: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Per-class one-vs-rest AUROC and AP, and their macro means."""
    by = list(by)
    e = one_vs_rest(df, y, probs, id_col, by)
    per = (auroc(e, "y_c", "score", by=[*by, "class_index"])
           .join(average_precision(e, "y_c", "score", by=[*by, "class_index"]), [*by, "class_index"]))
    macro = per.groupBy(*by).agg(F.avg("auroc").alias("macro_auroc"), F.avg("auprc").alias("macro_auprc"))
    return per, macro


def r2(df: DataFrame, y: str, pred: str, w=None, by: Sequence[str] = (), out: str = "r2") -> DataFrame:
    """Weighted R^2 = 1 - sum w (y - f)^2 / sum w (y - ybar_w)^2, from
    sums (one pass): sum w(y-ybar)^2 = sum w y^2 - (sum w y)^2 / sum w."""
    ww = _w(w)
    yy, ff = F.col(y).cast("double"), F.col(pred).cast("double")
    agg = df.groupBy(*by).agg(F.sum(ww * F.pow(yy - ff, 2)).alias("__sse"), F.sum(ww).alias("__sw"),
                              F.sum(ww * yy).alias("__swy"), F.sum(ww * yy * yy).alias("__swyy"))
    sst = F.col("__swyy") - F.col("__swy") * F.col("__swy") / F.col("__sw")
    return agg.select(*by, (F.lit(1.0) - F.col("__sse") / sst).alias(out))


def mean_probability(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Mean predicted probability and prevalence per run."""
    return df.groupBy(*by).agg(F.avg(F.col(p).cast("double")).alias("mean_proba"),
                               F.avg(F.col(y).cast("double")).alias("prevalence"))


def threshold_rates(df: DataFrame, y: str, p: str, by: Sequence[str], cut: float = 0.5) -> DataFrame:
    """Hard prediction at ``cut`` and the share of 'yes' per true class."""
    return df.groupBy(*by, y).agg(F.avg((F.col(p) >= cut).cast("double")).alias("yes_rate"),
                                  F.count(F.lit(1)).alias("n"))


def two_way(p_yes, p_no) -> Column:
    """p_yes / max(p_yes + p_no, 1e-12)."""
    a = F.col(p_yes) if isinstance(p_yes, str) else p_yes
    b = F.col(p_no) if isinstance(p_no, str) else p_no
    return a / F.greatest(a + b, F.lit(1e-12))


def l2_normalize(vec) -> Column:
    """Vector divided by its Euclidean norm (zero vector stays zero)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    vd = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(vd, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vd, lambda x: F.when(norm > 0, x / norm).otherwise(x))
