"""Filters and checks (F3, F5, F6, F9, F11, F12) and group weights.

Group-level conditions are computed as small aggregates (partial
aggregation before the shuffle) and applied with semi joins, never by
collecting id lists on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import null_safe_join


def exclude_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """drop rows whose ``col`` is in ``values``; nulls are kept (as
    ``~isin`` keeps NaN)."""
    return df.filter(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def keep_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """F3 (positive form): rows whose ``col`` is in ``values``."""
    return df.filter(F.col(col).isin(list(values)))


def keep_groups(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """rows of groups with at least ``min_rows`` rows; rows with a null
    key are dropped (groupby drops them)."""
    keys = list(keys)
    big = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
           .filter(F.col("__n") >= min_rows).select(*keys))
    return df.join(big, on=keys, how="left_semi")


def unambiguous(df: DataFrame, key: str, col: str) -> DataFrame:
    """keys whose ``col`` takes exactly one value (null counts as a
    value). Returns one column ``key``."""
    return (df.select(key, col).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") == 1).select(key))


def balance_weights(df: DataFrame, value: str, strata: Sequence[str], out: str = "weight") -> DataFrame:
    """W4 + W5: weight = rows with this ``value`` overall / rows with this
    ``value`` inside the stratum, so that a weighted sample of each stratum
    follows the overall distribution of ``value``."""
    overall = df.groupBy(value).agg(F.count(F.lit(1)).alias("__all"))
    inside = df.groupBy(value, *strata).agg(F.count(F.lit(1)).alias("__in"))
    d = null_safe_join(df, overall, [value])
    d = null_safe_join(d, inside, [value, *strata])
    return d.withColumn(out, F.col("__all") / F.col("__in")).drop("__all", "__in")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                 validate: str = "one_to_one") -> DataFrame:
    """a join that fails when keys repeat where ``validate`` forbids it
    ('one_to_one', 'many_to_one', 'one_to_many'). The check is one
    aggregate per side (no driver-side key lists)."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[validate]
    for s in sides:
        if duplicate_keys(s, on).limit(1).count():
            raise ValueError(f"join keys {list(on)} are not unique ({validate})")
    return left.join(right, on=list(on), how=how)


def count_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """one row (n_a, n_b, same) comparing two row counts."""
    ca = a.agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.agg(F.count(F.lit(1)).alias("n_b"))
    return (ca.withColumn("__k", F.lit(1)).join(cb.withColumn("__k", F.lit(1)), "__k").drop("__k")
            .withColumn("same", F.col("n_a") == F.col("n_b")))


def assert_same_count(a: DataFrame, b: DataFrame) -> None:
    row = count_difference(a, b).first()
    if not row["same"]:
        raise ValueError(f"row counts differ: {row['n_a']} vs {row['n_b']}")


def map_conflicts(maps: DataFrame, source: str, key: str, value: str) -> DataFrame:
    """keys mapped to more than one value across sources (files).
    Empty means all label maps agree."""
    return (maps.groupBy(key).agg(F.count_distinct(value).alias("n_values"),
                                  F.count_distinct(source).alias("n_sources"))
            .filter(F.col("n_values") > 1))
