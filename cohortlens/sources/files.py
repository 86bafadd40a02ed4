"""File sources and sinks.

Staging folders are taken below the session's ``spark.checkpoint.dir`` (a
shared folder on a cluster), never a machine-local temporary folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, IntegerType

from ..session import ensure_checkpoint_dir, fan_out_partitions

LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def staging_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job's files below the checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "staging", f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed, when a reader is made, by a few tasks a core, not by a task for each of up
    to 10,000 folders: starting one takes many times as long as listing a folder."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, min(int(before), fan_out_partitions(spark)))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def read_notes(spark: SparkSession, path: str | Sequence[str], suffix: str = ".annotated.txt",
               recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Every file of a folder (recursively, optionally filtered by
    a glob) as one row (note_key, text); the key is the file name without
    folders and ``suffix``. Unreadable files are skipped when
    ``spark.sql.files.ignoreCorruptFiles`` is on."""
    r = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(path if isinstance(path, str) else list(path), wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    key = F.regexp_replace(name, F.lit(_re_escape(suffix) + "$"), F.lit(""))
    return df.select(key.alias("note_key"), F.col("_metadata.file_path").alias("file_path"),
                     F.col("value").alias("text"))


def read_listed(spark: SparkSession, path: str, wanted: DataFrame, suffix: str = ".annotated.txt",
                glob: str | None = None, key_of: str | None = None) -> DataFrame:
    """S2 / S3 with a list of files: (note_key, status, n_bytes, text) for
    every key of ``wanted(note_key)``. Status 'read'; 'missing': no such file
    below ``path``, or an empty one (Spark's scans leave empty files out);
    'unreadable': listed, but the read skipped it; 'twice':
    several files have the key (a row each). The keys are the file names
    without ``suffix``, or the first group of the pattern ``key_of`` on the
    path. The listing reads no content; files that are not wanted are not
    read on to a result."""
    pattern = key_of or r"([^/]*)" + _re_escape(suffix) + "$"
    key = lambda p: F.regexp_extract(p, pattern, 1)
    r = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    with few_listing_tasks(spark):
        listed, got = r.format("binaryFile").load(path), r.format("text").option("wholetext", True).load(path)
    listed = listed.select(F.col("path").alias("file_path"), F.col("length").alias("n_bytes"))
    listed = listed.select(key(F.col("file_path")).alias("note_key"), F.lit(True).alias("there"), "file_path", "n_bytes")
    got = got.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    count = F.count("there").over(Window.partitionBy("note_key"))
    found = (wanted.select("note_key").distinct().join(listed, "note_key", "left")
             .withColumn("n_files", count).join(got, "file_path", "left"))
    status = (F.when(F.col("there").isNull(), "missing").when(F.col("text").isNull(), "unreadable")
              .when(F.col("n_files") > 1, "twice").otherwise("read"))
    return found.select("note_key", status.alias("status"), "n_bytes", "text")


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def write_variants(df: DataFrame, path: str, partition_by: Sequence[str] = ("variant", "split"),
                   mode: str = "errorifexists", fmt: str = "parquet") -> str:
    """One partitioned write for all variants and splits (a
    folder per value, so readers prune by variant); ``mode`` refuses to
    overwrite unless 'overwrite' / 'ignore' is asked for. Text makes up the
    files: parquet takes a denser compression than its default."""
    dense = {"compression": "zstd"} if fmt == "parquet" else {}
    df.write.mode(mode).partitionBy(*partition_by).format(fmt).options(header=True, **dense).save(path)
    return path


def write_many(df: DataFrame, path: str, partition_by: Sequence[str], **options) -> None:
    """Write text rows as very many small files. Each task moves its own files to their place when it
    commits (the committer's algorithm 2), not the driver one after another at the end; the folder is
    fresh, so a job that fails leaves nothing that is read."""
    df.write.partitionBy(*partition_by).options(**options) \
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def read_metrics(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A folder of metric JSON files (recursively); ``run`` = the path
    below ``path`` without '.json' (or the partition folder name)."""
    r = spark.read.option("recursiveFileLookup", True)
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path)
    rel = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + _re_escape(path.rstrip("/")) + "/", "")
    return df.withColumn("run", F.regexp_replace(rel, r"\.json$", ""))


def metrics_long(df: DataFrame, run: str, metrics: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Nested ``metrics.<metric>.<split>`` to a long table
    (run, metric, split, value) with one ``stack``."""
    pairs = [(m, s) for m in metrics for s in splits]
    expr = "stack({}, {}) as (metric, split, value)".format(
        len(pairs), ", ".join(f"'{m}', '{s}', CAST(metrics.{m}.{s} AS DOUBLE)" for m, s in pairs))
    return df.selectExpr(run, expr)


def read_label_maps(spark: SparkSession, path: str, glob: str = "*metadata.json") -> DataFrame:
    """Every '*metadata.json' below ``path``; the ``label_map`` object
    exploded to (source, key, value)."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    m = F.from_json(F.to_json("label_map"), MapType(StringType(), IntegerType()))
    return df.select(F.col("_metadata.file_path").alias("source"), F.explode(m).alias("key", "value"))
