"""Embedding job.

The study runs a GPU language-model encoder over each CSV. Here the encoder
is a plug-in: any callable ``list[str] -> ndarray (n, dim)`` is built once
per task inside ``mapInPandas`` and fed Arrow batches of the text column, so
the work is partitioned by Spark and the rows never pass through the driver.
The built-in default is a hashed bag of words made by ``pyspark.ml``, enough to
exercise the job and the models downstream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

Encoder = Callable[[list], np.ndarray]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def _hashed(df: DataFrame, dim: int) -> DataFrame:
    return HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dim).transform(df)


def word_counts(df: DataFrame, text: Column, out: str, dim: int) -> DataFrame:
    """Add ``out``: the hashed counts of the words of ``text``, by which texts that share a part cut
    at white space have that part read once (``counts`` of :func:`embed`). White space is in no word,
    and no letter's lower case depends on what is beyond it."""
    d = _hashed(df.withColumn("__words", _words(text)), dim)
    return d.withColumn(out, vector_to_array("__counts")).drop("__words", "__counts")


def added(a: Column, b: Column) -> Column:
    """Sum of two arrays of counts."""
    return F.zip_with(a, b, lambda x, y: x + y)


def hashed_words(df: DataFrame, text_col: str, keys: Sequence[str], dim: int, out: str, counts: str | None = None) -> DataFrame:
    """Default encoder: lower-cased words hashed into ``dim`` counts,
    L2-normalised (a zero vector stays zero); no Python. ``counts``: a column
    of :func:`word_counts` of the rest of a text that is not null."""
    d = df.select(*keys, _words(F.col(text_col)).alias("__words"), *(
        [] if counts is None else [F.when(F.col(text_col).isNotNull(), F.col(counts)).alias("__more")]))
    d = _hashed(d, dim)
    if counts is not None:
        own = vector_to_array("__counts")
        d = d.withColumn("__counts", array_to_vector(added(own, F.coalesce("__more", F.array_repeat(F.lit(0.0), dim)))))
    d = Normalizer(inputCol="__counts", outputCol="__unit").transform(d)
    return d.select(*keys, vector_to_array("__unit", "float32").alias(out))


def embed(df: DataFrame, text_col: str, keys: Sequence[str], dim: int = 64,
          encoder_factory: Callable[[], Encoder] | None = None, out: str = "embedding",
          counts: str | None = None) -> DataFrame:
    """(keys..., embedding array<float>) for every row. An own encoder is
    created once per task and applied batch by batch; without one the words
    are hashed (``hashed_words``), beside those that were counted before."""
    keys = list(keys)
    if encoder_factory is None:
        return hashed_words(df, text_col, keys, dim, out, counts)
    in_df = df.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = StructType([*[f for f in in_df.schema.fields if f.name in keys],
                         StructField(out, ArrayType(FloatType(), False), False)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder_factory()
        for b in batches:
            vecs = enc(b["__text"].tolist())
            if vecs.shape != (len(b), dim):
                raise ValueError(f"encoder returned shape {vecs.shape}, expected {(len(b), dim)}")
            res = b[keys].copy()
            res[out] = list(vecs.astype(np.float32))
            yield res
    return in_df.mapInPandas(run, schema)


def write_embeddings(df: DataFrame, path: str, dim: int, col: str = "embedding", mode: str = "errorifexists",
                     partition_by: Sequence[str] = ()) -> dict:
    """S12 + S13: write embeddings as parquet (``mode`` refuses to overwrite
    unless told), checking the width on every row and counting the rows
    during the write (an Observation, no second pass)."""
    obs = Observation("embeddings")
    checked = df.withColumn(col, F.when(F.size(col) == dim, F.col(col)).otherwise(
        F.raise_error(F.lit(f"embedding width is not {dim}"))))
    w = checked.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return {"rows": obs.get["rows"], "path": path}


def embedding_metadata(spark, info: dict) -> DataFrame:
    """The metadata sidecar as a one-row DataFrame (write with
    ``.write.json``)."""
    fields = ["csv_path", "text_column", "label_column", "model_alias", "encoder_class", "instruction",
              "embedding_path", "labels_path"]
    row = {k: str(info.get(k, "")) for k in fields}
    if info.get("label_map"):  # classes of the label: an object in the JSON
        row["label_map"] = {str(k): int(v) for k, v in info["label_map"].items()}
    row.update({k: int(info.get(k, 0)) for k in ("max_input_length", "num_rows", "embedding_dim", "read_batch_size")})
    return spark.createDataFrame([row])


def chunk_embeddings(df: DataFrame, text_col: str, key: str, size: int, dim: int = 64,
                     encoder_factory: Callable[[], Encoder] | None = None, max_chunks: int | None = None) -> DataFrame:
    """Cut each text into windows of ``size`` whitespace tokens (all
    of them unless ``max_chunks`` is set), embed every chunk and average the
    chunk vectors per text."""
    from ..functions.vectors import chunk_tokens, mean_by_chunk
    ch = df.select(key, F.posexplode(chunk_tokens(text_col, size, max_chunks or (1 << 30))).alias("chunk", "toks"))
    ch = ch.select(key, "chunk", F.array_join("toks", " ").alias("chunk_text"))
    e = embed(ch, "chunk_text", [key, "chunk"], dim, encoder_factory)
    return mean_by_chunk(e, [key], "embedding")
