"""Readers for the raw inputs (S1, S4, S5, S6 and the parquet test tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TEST_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet test table. Column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: Sequence[str] = TEST_TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str,
               header: bool = True, multiline: bool = True) -> DataFrame:
    """CSV or CSV.gz with a declared schema (no inference).

    Notes hold newlines inside quoted fields, so ``multiLine`` is on by
    default; a list of paths reads numbered part files as one table. Gzip
    files are not splittable: one task per file, so large inputs should be
    many files (or converted once to parquet).
    """
    return (spark.read.schema(schema)
            .option("header", header).option("multiLine", multiline)
            .option("escape", '"').option("mode", "FAILFAST")
            .csv(paths if isinstance(paths, str) else list(paths)))


def head_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in an explicit order (a row cap on a sorted
    input; planned as TakeOrderedAndProject, a per-task top-n plus a merge)."""
    return df.orderBy(*order).limit(n)


def pick_label_column(df: DataFrame) -> str:
    """The column ``label``, or the only column, else an error."""
    if "label" in df.columns:
        return "label"
    if len(df.columns) == 1:
        return df.columns[0]
    raise ValueError(f"need a 'label' column or exactly one column, got {df.columns}")


def read_embeddings(df: DataFrame, col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Keep rows with an embedding of the expected width; fails the job
    (ANSI ``raise_error``) on a width mismatch instead of silently dropping."""
    if dim is None:
        return df
    return df.withColumn(col, F.when(F.size(col) == dim, F.col(col))
                         .otherwise(F.raise_error(F.concat(F.lit(f"embedding width is not {dim}: "),
                                                           F.size(col).cast("string")))))
