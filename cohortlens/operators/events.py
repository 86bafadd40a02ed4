"""Event-sequence operators: next-event outcome label (W1), repeated
entities (F4), chronological order check (F10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import null_safe_join

FAR_FUTURE = "9999-12-31 00:00:00"
#: Rows of one entity that one window task sorts; an entity with more is split into ranges.
HOT_ROWS = 1_000_000
#: Hot entities (their number is counted) up to which their keys are broadcast.
HOT_BROADCAST = 100_000


def split_hot(df: DataFrame, entity: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of entities with at most ``hot_rows`` rows, and rows of the others (None if a count by
    entity, combined before its shuffle, finds none). Null is an entity like any other."""
    hot = materialize(df.groupBy(F.col(entity).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
                      .filter(F.col("__n") > hot_rows).select("__hot"))
    n = hot.count()
    if not n:
        return df, None
    keys = F.broadcast(hot) if n <= HOT_BROADCAST else hot
    same = F.col(entity).eqNullSafe(F.col("__hot"))
    return df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")


def keep_repeated(df: DataFrame, key: str) -> DataFrame:
    """rows of entities that occur at least twice (``duplicated(keep=False)``).
    Counts are pre-aggregated per map task, then a semi join."""
    rep = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(key)
    return df.join(rep, on=key, how="left_semi")


def label_next_event(df: DataFrame, entity: str, start: str, end: str, event_id: str,
                     within: str = "30 days", keep: Column | str | None = None,
                     split_seconds: int | None = 7 * 86400,
                     label: str = "label", position: str = "visit_no",
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per entity, ordered by ``end`` (nulls last) then ``event_id``, label
    each event by ``next.start <= this.end + within``.

    * the last event of an entity gets no row;
    * events where ``keep`` is false get no row, but still count as the next
      event of their predecessor and as a position;
    * ``position`` is the 0-based place of the event among all events of the
      entity; a null time gives label false; negative gaps are true.

    Entities with more than ``hot_rows`` rows are cut into time ranges of
    ``split_seconds``, the window runs per (entity, range), and the first event
    of the following range is looked up in a small per-range table, so that a
    patient holding a third of all events is spread over many tasks. All other
    entities take one plain window (all entities, without the count, if
    ``split_seconds`` is None; all in ranges if ``hot_rows`` is 0).
    """
    if split_seconds is not None and hot_rows > 0:
        rest, hot = split_hot(df, entity, hot_rows)
        args = dict(entity=entity, start=start, end=end, event_id=event_id, within=within, keep=keep, label=label,
                    position=position)
        plain = label_next_event(rest, split_seconds=None, **args)
        return plain if hot is None else plain.unionByName(
            label_next_event(hot, split_seconds=split_seconds, hot_rows=0, **args))
    keep_col = F.lit(True) if keep is None else (F.col(keep) if isinstance(keep, str) else keep)
    d = df.withColumn("__keep", F.coalesce(keep_col, F.lit(False)))
    sort_end = F.coalesce(F.col(end), F.lit(FAR_FUTURE).cast("timestamp"))
    within_iv = F.expr(f"INTERVAL {within}")

    if split_seconds is None:
        w = Window.partitionBy(entity).orderBy(F.col(end).asc_nulls_last(), F.col(event_id))
        d = (d.withColumn(position, (F.row_number().over(w) - 1).cast("int"))
             .withColumn("__next_start", F.lead(start).over(w))
             .withColumn("__next_id", F.lead(event_id).over(w)))
    else:
        bucket = F.floor(F.unix_seconds(sort_end) / F.lit(split_seconds)).cast("long")
        d = d.withColumn("__b", bucket).withColumn("__send", sort_end)
        w = Window.partitionBy(entity, "__b").orderBy(F.col("__send"), F.col(event_id))
        d = (d.withColumn("__rn", F.row_number().over(w))
             .withColumn("__ln_start", F.lead(start).over(w))
             .withColumn("__ln_id", F.lead(event_id).over(w)))
        per_b = d.groupBy(entity, "__b").agg(
            F.count(F.lit(1)).alias("__n"),
            F.min(F.struct(F.col("__send"), F.col(event_id).alias("id"), F.col(start).alias("st")))
            .alias("__first"))
        wb = Window.partitionBy(entity).orderBy("__b")
        per_b = per_b.select(
            entity, "__b",
            F.coalesce(F.sum("__n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
            F.lead("__first").over(wb).alias("__nb"))
        d = null_safe_join(d, per_b, [entity, "__b"])
        last_in_b = F.col("__ln_id").isNull()
        d = (d.withColumn(position, (F.col("__off") + F.col("__rn") - 1).cast("int"))
             .withColumn("__next_start", F.when(last_in_b, F.col("__nb.st")).otherwise(F.col("__ln_start")))
             .withColumn("__next_id", F.when(last_in_b, F.col("__nb.id")).otherwise(F.col("__ln_id")))
             .drop("__b", "__send", "__rn", "__ln_start", "__ln_id", "__off", "__nb"))
    gap_ok = F.col("__next_start") <= F.col(end) + within_iv
    return (d.filter(F.col("__next_id").isNotNull() & F.col("__keep"))
            .withColumn(label, F.coalesce(gap_ok, F.lit(False)))
            .withColumnRenamed("__next_start", f"next_{start}")
            .drop("__keep", "__next_id"))


def order_violations(df: DataFrame, entity: str, order: list[str], ts: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows whose ``ts`` is earlier than the previous row of the same
    entity in ``order``. Empty means chronological. An entity with more than
    ``hot_rows`` rows is range-partitioned by ``order``; the first row of a
    range is compared with the last one of the range before."""
    rest, hot = split_hot(df, entity, hot_rows)
    early = (rest.withColumn("__prev", F.lag(ts).over(Window.partitionBy(entity).orderBy(*order)))
             .filter(F.col(ts) < F.col("__prev")).drop("__prev"))
    if hot is None:
        return early
    # the checkpoint fixes the ranges, whatever is computed again later
    ranged = materialize(hot.repartitionByRange(entity, *order).withColumn("__b", F.spark_partition_id()))
    w = Window.partitionBy(entity, "__b").orderBy(*order)
    last = ranged.groupBy(entity, "__b").agg(F.max_by(ts, F.struct(*order)).alias("__last"))
    last = last.select(entity, "__b", F.lag("__last").over(Window.partitionBy(entity).orderBy("__b")).alias("__before"))
    ranged = ranged.withColumn("__prev", F.lag(ts).over(w)).withColumn("__rn", F.row_number().over(w))
    prev = F.when(F.col("__rn") == 1, F.col("__before")).otherwise(F.col("__prev"))
    return early.unionByName(null_safe_join(ranged, last, [entity, "__b"]).filter(F.col(ts) < prev).select(df.columns))


def assert_monotonic(df: DataFrame, entity: str, order: list[str], ts: str) -> None:
    """F10 as a check that raises, like the study's order check."""
    bad = order_violations(df, entity, order, ts).limit(1).count()
    if bad:
        raise ValueError(f"{ts} is not in chronological order for some {entity}")
