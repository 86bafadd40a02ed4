"""Helpers shared by the operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Words of the contracts that split at ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def ship(module: str) -> None:
    """Send this module's functions to the executors by value, so that Python workers need not
    have the package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write a result that several later steps read as a parquet table in the cluster's shared
    folder and read it back: the lineage is cut, a lost executor rereads the table, and each
    reader takes only the columns it needs."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_rows(df: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct column ``row``, with ``more`` columns beside it: joins on these cannot
    clash with the table's own names, and ``select("row.*")`` gives the rows back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a side whose row count was measured and is within ``limit``; else leave the
    join to the planner (a shuffle join whose skewed partitions AQE splits)."""
    return F.broadcast(df) if rows <= limit else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: a higher-order function binds it, so
    that an expensive expression is not repeated inside the lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def shifted(xs: Column, by: int, width: int) -> Column:
    """The part of an array that starts ``by`` places in, of its length less ``width``."""
    return F.slice(xs, F.lit(by + 1), F.greatest(F.size(xs) - width, F.lit(0)))
