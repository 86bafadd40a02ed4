"""Portable, partition-independent randomness.

``rand(seed)`` depends on how rows fall into partitions, so it changes when a
cluster re-plans or an executor is lost. All random choices here derive from
one hash of (key, seed) instead:

    u(key, seed) = (int(md5(key || '|' || seed)[0:13], 16) + 0.5) / 2**52

which lies strictly inside (0, 1), is the same on every run and every
partitioning, and is also computable in plain SQL (DuckDB:
``('0x' || substr(md5(...), 1, 13))::BIGINT``), so samples, splits and
bootstrap draws can be checked against an oracle query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _key(*parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash52(*parts) -> Column:
    """52-bit integer from the md5 of the '|'-joined parts."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 13), 16, 10).cast("bigint")


def uniform(key, seed: int = 0) -> Column:
    """Uniform number in (0, 1) from a key column and a seed."""
    return (hash52(key, F.lit(str(seed))) + F.lit(0.5)) / F.lit(TWO_POW_52)


def uniform_parts(*parts) -> Column:
    """Uniform number in (0, 1) from several key parts (the last one is
    usually the seed)."""
    return (hash52(*parts) + F.lit(0.5)) / F.lit(TWO_POW_52)


def sql_uniform(key_sql: str, seed_sql: str = "'0'") -> str:
    """The DuckDB text of :func:`uniform` for oracle queries."""
    return (f"((('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '|' || CAST({seed_sql} AS VARCHAR)), 1, 13))::BIGINT"
            f" + 0.5) / {TWO_POW_52})")
