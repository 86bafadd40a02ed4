"""Named queries of this subpackage: a builder ``(spark, sf_dir) -> DataFrame`` and, where SQL
can express the result, the DuckDB text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

MODULES = ("chat_pairs", "token_files", "toxicity", "simhash", "quality", "packing", "licenses",
           "sharding", "decontaminate", "urls", "personal_data", "whitening", "lexical")


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
