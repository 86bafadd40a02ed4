"""Bootstrap intervals.

``method='exact'``: draw b picks n units with replacement (n = number of
units): pick j of draw b is unit ``floor(u(b*n + j, seed) * n)``. The picks
are generated as a range of their numbers (no driver loop) and joined to the
rows of their units, then the metric is computed for all draws in one grouped job. ``method='poisson'``: each unit
gets a Poisson(1) weight per draw from the same hash (the usual big-data
bootstrap: no global index, no count). Draws whose weights leave the metric
undefined are skipped. Summary: std (ddof 1), mean, 2.5 / 97.5 percentiles
(linear interpolation) and the point score."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform_parts
from ..session import fan_out_partitions, materialize
from . import metrics as M
from .ranking import ordered_position

MetricFn = Callable[..., DataFrame]
TASK_PICKS = 1 << 21      # picks a task makes
BROADCAST_ROWS = 500_000  # rows of (position, outcome, score, range) that are sent to every executor


def _poisson1(u) -> F.Column:
    """Inverse CDF of Poisson(1) on a uniform number (k up to 12)."""
    cdf, term, acc = [], math.exp(-1.0), 0.0
    for k in range(13):
        acc += term
        cdf.append(acc)
        term /= (k + 1)
    expr = F.lit(13)
    for k in reversed(range(13)):
        expr = F.when(u <= F.lit(cdf[k]), F.lit(k)).otherwise(expr)
    return expr


def _positions(units: DataFrame, unit: str) -> DataFrame:
    """(unit, __j): the units numbered from 1 by their value."""
    # staged: counted and joined, with the quantiles of its ranges in the plan each time
    return materialize(ordered_position(units.select(unit).distinct(), [], [F.col(unit)], key=F.col(unit), out="__j"))


def _picks(spark: SparkSession, n: int, draws: int, seed: int) -> DataFrame:
    """(draw, __j): the n picks of every draw, one row each. A task makes the picks of neighbouring
    draws, and the planner knows their count (that of an exploded array it takes for one)."""
    parts = max(fan_out_partitions(spark), -(-n * draws // TASK_PICKS))
    picked = F.floor(uniform_parts(F.col("id"), F.lit(str(seed))) * n).cast("long") + 1
    return spark.range(0, n * draws, 1, parts).select(F.expr(f"cast(id div {max(n, 1)} as int)").alias("draw"), picked.alias("__j"))


def _poisson_rows(rows: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """``rows`` once for every draw that gives their unit a weight, with ``draw`` and ``w``. The
    weight is a function of unit and draw: nothing is joined."""
    e = rows.filter(F.col(unit).isNotNull()).repartition(fan_out_partitions(rows.sparkSession))
    # the hash is a column of the generator: a filter on the weight does not hash again
    e = e.select("*", F.inline(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: F.struct(
        k.alias("draw"), uniform_parts(F.col(unit), k, F.lit(f"p{seed}")).alias("__u")))))
    return e.withColumn("w", _poisson1(F.col("__u")).cast("double")).filter(F.col("w") > 0).drop("__u")


def bootstrap_weights(units: DataFrame, unit: str, draws: int, seed: int = 0, method: str = "exact") -> DataFrame:
    """(draw, unit, w) with w > 0 for every unit picked in a draw."""
    if method == "poisson":
        return _poisson_rows(units.select(unit).distinct(), unit, draws, seed).select(unit, "draw", "w")
    pos = _positions(units, unit)
    counts = _picks(units.sparkSession, pos.count(), draws, seed).groupBy("draw", "__j").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(pos, "__j").select("draw", unit, F.col("w").cast("double"))


def drawn_rows(df: DataFrame, unit: str, draws: int, seed: int = 0, method: str = "exact") -> DataFrame:
    """The rows of ``df`` with ``draw`` and ``w``: for 'poisson' once a draw, for 'exact' once a pick
    of their unit (weight one), so that the picks are joined to the rows at once and never counted by
    unit. The rows are broadcast while they are few, else picks and rows are shuffled."""
    if method == "poisson":
        return _poisson_rows(df, unit, draws, seed)
    pos = _positions(df, unit)
    rows = materialize(df.join(pos, unit))
    few = rows.count() <= BROADCAST_ROWS
    picks = _picks(df.sparkSession, pos.count(), draws, seed)
    return picks.join(F.broadcast(rows) if few else rows.hint("merge"), "__j").drop("__j").withColumn("w", F.lit(1.0))


def bootstrap(df: DataFrame, unit: str, metric: MetricFn, metric_col: str, draws: int = 1000, seed: int = 0,
              method: str = "exact", **metric_args) -> DataFrame:
    """M8: one row (score, std, lower, mean, upper, n_draws) for ``metric``
    (a function of this module's metric signature returning
    ``metric_col``). Rank metrics get score ranges of the rows themselves,
    found before the draws multiply them, and read staged sums of weights per
    (draw, score, outcome)."""
    rank_metric = metric in (M.auroc, M.average_precision)
    if rank_metric:
        df = materialize(M.score_ranges(df, metric_args["p"]))
        metric_args = {**metric_args, "ranges": "__range"}
    named = {unit, *(a for a in metric_args.values() if isinstance(a, str))}
    read = [c for c in df.columns if c in named]
    weighted = drawn_rows(df.select(*read), unit, draws, seed, method)
    if rank_metric:
        # Rank metrics read one row per (draw, score, outcome) several times: staged, so that the plan
        # of the weights, which the driver keeps as text with every re-planning, is run and held once.
        kept = list(dict.fromkeys(["draw", metric_args["y"], metric_args["p"], "__range"]))
        weighted = materialize(weighted.groupBy(*kept).agg(F.sum("w").alias("w")))
    per_draw = metric(weighted, w="w", by=["draw"], **metric_args).filter(F.col(metric_col).isNotNull())
    point = metric(df, **metric_args).select(F.col(metric_col).alias("score"))
    summ = per_draw.agg(F.stddev_samp(metric_col).alias("std"),
                        F.percentile(metric_col, 0.025).alias("lower"),
                        F.avg(metric_col).alias("mean"),
                        F.percentile(metric_col, 0.975).alias("upper"),
                        F.count(F.lit(1)).alias("n_draws"))
    return _one_row_join(point, summ)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two one-row results side by side (equi-join on a constant key)."""
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")


__all__ = ["bootstrap", "bootstrap_weights", "drawn_rows"]
