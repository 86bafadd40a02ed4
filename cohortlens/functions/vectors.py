"""Feature helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per listed value."""
    p = prefix or col
    for v in values:
        df = df.withColumn(f"{p}_{v}", (F.col(col) == F.lit(v)).cast("int"))
    return df


def encode_label(values: DataFrame, col: str, out: str = "label_index") -> DataFrame:
    """Stable label map, value -> index in alphabetical order (fitted
    once on the distinct values, so train and test share it). The window
    runs over the distinct values only (a small dimension)."""
    return values.select(col, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int").alias(out))


def fingerprint(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-free content fingerprint: row count and the sum of a 32-bit
    prefix of each row's SHA-256 (same result for any row order or
    partitioning)."""
    h = F.conv(F.substring(F.sha2(F.col(col), 256), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("bigint").alias("sha_sum"))


def chunk_tokens(text, size: int, max_chunks: int, max_chars: int | None = None) -> Column:
    """Whitespace tokens cut into windows of ``size`` tokens, at most
    ``max_chunks`` windows, as an array of token arrays. ``max_chars``
    (optional) cuts the text before tokenising, as encoders with an input
    budget do."""
    t = F.col(text) if isinstance(text, str) else text
    if max_chars:
        t = F.substring(t, 1, max_chars)
    toks = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    n = F.size(toks)
    k = F.least(F.ceil(n / F.lit(size)), F.lit(max_chunks)).cast("int")
    starts = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(toks, i * size + 1, size))


def mean_by_chunk(df: DataFrame, keys: Sequence[str], vec: str, out: str = "embedding") -> DataFrame:
    """Element-wise mean of chunk vectors per key, one partial aggregate
    of whole vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = df.select(*keys, array_to_vector(F.col(vec).cast("array<double>")).alias("__v"))
    return v.groupBy(*keys).agg(Summarizer.mean(F.col("__v")).alias("__m")) \
        .select(*keys, vector_to_array("__m").alias(out))
