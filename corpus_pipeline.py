"""From raw documents to packed training sequences: toxic and poor documents go, one document of
each group of near copies stays, documents that share a passage with the benchmark go, and what is
left is packed.

Each stage reads all that its predecessor kept. The stages handle nulls, repeated rows, empty
tables and further columns as their operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontaminate, packing, quality, simhash, toxicity
from cohortlens.llm.common import stage
from cohortlens.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"
HELD = 48 << 20  # workers outlive the packing, and with them what their encoders hold


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), held=HELD)


STAGES = [("toxicity", toxic), ("quality_rules", rules), ("simhash_near_dedup", near_copies),
          ("benchmark_decontamination", leaks), ("best_fit_packing", pack)]
#: No SQL: the trained scores, the sketches' limits, the fingerprints and the packing are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
