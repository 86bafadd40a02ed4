"""Structured Streaming: the stateless text rewrites on a stream of files.

The tag functions are plain column expressions, so they run unchanged on a
streaming DataFrame. New parquet files in a folder are tagged as they
arrive and appended to a parquet sink; ``availableNow`` processes what is
there and stops (restartable from the checkpoint after a failure)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.prompts import tag_personal


def stream_tag_personal(spark: SparkSession, src: str, glob: str, sink: str, checkpoint: str,
                        text_col: str = "text", keys: tuple = ("doc_id",), max_files: int = 1) -> DataFrame:
    """Tag personal data (C5) in every file that lands in ``src`` and write
    (keys, tagged) to ``sink`` (``src``: the folder that holds the files, or a pattern); returns the sink read back as a batch
    table once the available files are processed."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(src).schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", max_files).parquet(src))
    out = stream.select(*keys, tag_personal(text_col).alias("tagged"))
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)
