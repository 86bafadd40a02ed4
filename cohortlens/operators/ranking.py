"""Skew-safe ordered positions inside groups.

A plain ``row_number() over (partition by g order by x)`` sends every row of
group ``g`` to one task. When one group holds a third of all rows that task
holds a third of the data. The helpers here compute the same numbers in two
levels:

1. rows are windowed per cell ``(g, range)``, where ``range`` is a column that
   never decreases along the order, so a hot group is spread over many tasks;
2. a small table with one row per cell (counts, sums) is windowed per ``g`` to
   get the offset of each cell; it has at most (number of ranges) rows per
   group, whatever the group size;
3. the offsets are joined back on the cell. Group columns and range stand in
   one struct, which is never null itself and equals another one also where
   both hold nulls, so window and join ask for the same partitioning and the
   rows move once.

Ranges come from the data: quantiles of the order key over all rows
(:func:`with_ranges`), or equal parts of [0, 1) for a hash
(:func:`unit_ranges`). The results equal the one-window form exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

CUTS = 4096           # quantiles kept: at most this many ranges, 32 KB beside the rows
RANGE_ROWS = 1 << 20  # rows of a range beyond which more ranges are taken


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def wanted_ranges(df: DataFrame) -> int:
    """Ranges that keep all tasks of a shuffle busy: twice its partitions."""
    return max(2, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unit_ranges(df: DataFrame, u: Column | str) -> Column:
    """Range of an order key that is spread evenly over [0, 1) (a hash)."""
    n = wanted_ranges(df)
    u = F.col(u) if isinstance(u, str) else u
    return F.least(F.floor(u * F.lit(n)), F.lit(n - 1)).cast("int")


def _cuts(values: Column, n: Column, wanted: int) -> Column:
    """Every k-th quantile, so that ranges number ``wanted``, or more where
    they would hold over RANGE_ROWS rows."""
    ranges = F.greatest(F.lit(wanted).cast("double"), n / F.lit(RANGE_ROWS))
    step = F.greatest(F.lit(1), F.floor(F.lit(CUTS) / ranges).cast("int"))
    none = F.array().cast("array<double>")
    return F.coalesce(F.filter(values, lambda x, i: (i + 1) % step == 0), none)


def _halves(cuts: Column) -> Column:
    """Powers of two from the highest within the number of ``cuts`` down to 1."""
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(CUTS.bit_length()))])
    return F.filter(powers, lambda p: p <= F.size(cuts))


def _place(cuts: Column, halves: Column, x: Column) -> Column:
    """Number of ``cuts`` (ascending) that are <= x, by halving; null: 0."""
    return F.aggregate(halves, F.lit(0), lambda at, s: F.when(
        (at + s <= F.size(cuts)) & (F.get(cuts, at + s - F.lit(1)) <= x), at + s).otherwise(at))


def with_ranges(df: DataFrame, key: Column, out: str, tie: Column | None = None) -> DataFrame:
    """Add ``out``: a struct that never decreases along ``(key, tie)`` and
    splits the rows into ranges of nearly equal size, by quantiles of ``key``
    over all rows (one mergeable sketch, one row of at most CUTS numbers
    beside the rows; null keys come first). A key value that fills whole
    ranges by itself (a hot score or age) is divided by ranges of ``tie``,
    so it does not end in one task. ``key`` and ``tie`` are numbers that a
    double holds exactly."""
    wanted = wanted_ranges(df)
    quantiles = (f"percentile_approx(%s, cast(split('{','.join(repr(i / CUTS) for i in range(1, CUTS))}', ',') "
                 f"as array<double>), {4 * CUTS})")
    keys = df.select(key.cast("double").alias("k"), (F.lit(None) if tie is None else tie).cast("double").alias("t"))
    sketch = keys.agg(F.count("k").alias("n"), F.expr(quantiles % "k").alias("k"),
                      *([] if tie is None else [F.expr(quantiles % "t").alias("t")]))
    cuts = _cuts(F.col("k"), F.col("n"), wanted)
    repeated = F.array_distinct(F.filter(cuts, lambda x, i: (i > 0) & (F.get(cuts, i - F.lit(1)) == x)))
    one = sketch.select(
        F.array_distinct(cuts).alias("cuts"), repeated.alias("hot"),
        (F.array().cast("array<double>") if tie is None else _cuts(F.col("t"), F.col("n"), wanted)).alias("ties"))
    one = one.select(F.struct("*", _halves(F.col("cuts")).alias("cut_halves"),
                              _halves(F.col("ties")).alias("tie_halves")).alias("__ranges"))
    d = df.join(F.broadcast(one))  # one row
    r, k = F.col("__ranges"), key.cast("double")
    # the cut itself is the lowest key of its range, so its rows come first
    hot = F.coalesce(F.array_contains(r["hot"], k), F.lit(False))
    within = F.lit(0) if tie is None else F.when(hot, _place(r["ties"], r["tie_halves"], tie.cast("double"))).otherwise(F.lit(0))
    return d.withColumn(out, F.struct(_place(r["cuts"], r["cut_halves"], k).alias("range"), (~hot).cast("int").alias("above"),
                                      within.alias("within"))).drop("__ranges")


def is_number(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NumericType)


def ordered_position(df: DataFrame, by: Sequence[str], order: Sequence, bucket: Column | None = None,
                     out: str = "pos", running: dict[str, Column] | None = None,
                     total: str | None = None, key: Column | None = None, tie: Column | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row inside ``by`` ordered by
    ``order`` (same as ``row_number``), and for each ``name -> expr`` in
    ``running`` an inclusive running sum of ``expr`` in the same order.

    Ranges come from ``bucket``, a column that never decreases along
    ``order`` inside each group, or from quantiles of ``key`` (and ``tie``):
    the first (and second) column of ``order``, as numbers.
    ``order`` must be a total order (end it with a unique id). With
    ``total`` set, the group size is attached too (from the cell table).
    """
    running = running or {}
    by = list(by)
    if bucket is None:
        d = with_ranges(df, key, "__range", tie)
    else:
        d = df.withColumn("__range", bucket)
    cell = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)] + [F.col("__range").alias("range")]
    d = d.withColumn("__cell", F.struct(*cell)).drop("__range")
    w_local = Window.partitionBy("__cell").orderBy(*_cols(order))
    w_cum = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = d.withColumn("__local", F.row_number().over(w_local))
    for name, expr in running.items():
        local = local.withColumn(f"__r_{name}", F.sum(expr).over(w_cum))
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.sum(expr).alias(f"__t_{name}") for name, expr in running.items()]
    totals = d.groupBy("__cell").agg(*aggs)
    group = Window.partitionBy(*[F.col("__cell")[f"g{i}"] for i in range(len(by))])
    w_prev = group.orderBy(F.col("__cell")["range"]).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("__cell",
                         F.coalesce(F.sum("__n").over(w_prev), F.lit(0)).alias("__off"),
                         *[F.coalesce(F.sum(f"__t_{name}").over(w_prev), F.lit(0)).alias(f"__o_{name}")
                           for name in running],
                         *([F.sum("__n").over(group).alias(total)] if total else []))
    out_df = local.join(offs, "__cell").withColumn(out, F.col("__off") + F.col("__local"))
    for name in running:
        out_df = out_df.withColumn(name, F.col(f"__o_{name}") + F.col(f"__r_{name}"))
    drop = ["__cell", "__local", "__off"] + [f"__r_{n}" for n in running] + [f"__o_{n}" for n in running]
    return out_df.drop(*drop)


def group_sizes(df: DataFrame, by: Sequence[str], out: str = "group_size") -> DataFrame:
    """Attach the row count of each group. Partial aggregation happens before
    the shuffle, so a hot group costs one row per map task."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    return null_safe_join(df, sizes, list(by))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (``<=>``), keeping one
    copy of each key column. Used to attach per-group values computed from
    the same rows, so that rows with a null group key are kept."""
    r = right
    renamed = {k: f"__k_{k}" for k in keys}
    for k, v in renamed.items():
        r = r.withColumnRenamed(k, v)
    cond = [left[k].eqNullSafe(r[v]) for k, v in renamed.items()]
    return left.join(r, on=cond, how=how).drop(*renamed.values())
