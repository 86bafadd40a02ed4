"""Rank-matched pairing.

Ranks are computed with the skew-safe ordered positions of
:mod:`.ranking`; pairs are equi-joins on (strata, rank). In J9 every key
(gender, rank) holds at most one row per group value (race), so the pairs per
key are bounded by the square of the number of groups (a dimension), not by
the data size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import is_number, ordered_position


def rank_first(df: DataFrame, by: Sequence[str], order: str, id_col: str, out: str = "rank",
               ascending: bool = True, total: str | None = None) -> DataFrame:
    """Rank 'first' (ties by id) inside ``by``, ascending or
    descending; 1-based. An ``order`` value that many rows share is divided
    by ranges of the id, if ids are numbers."""
    o = F.col(order) if ascending else -F.col(order)
    tie = F.col(id_col) if is_number(df, id_col) else None
    return ordered_position(df.withColumn("__o", o), list(by), [F.col("__o"), F.col(id_col)], out=out,
                            total=total, key=F.col("__o"), tie=tie).drop("__o")


def rank_match(a: DataFrame, b: DataFrame, strata: Sequence[str], order: str, id_col: str,
               suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Pair the k-th row of ``a`` with the k-th row of ``b`` inside each
    stratum, both ranked by ``order`` (ties by id). Unmatched tails drop out
    (inner join on strata + rank)."""
    strata = list(strata)
    ra = rank_first(a, strata, order, id_col, out="__rank")
    rb = rank_first(b, strata, order, id_col, out="__rank")
    sa, sb = suffixes
    ra = ra.select(*strata, "__rank", *[F.col(c).alias(c + sa) for c in a.columns if c not in strata])
    rb = rb.select(*strata, "__rank", *[F.col(c).alias(c + sb) for c in b.columns if c not in strata])
    return ra.join(rb, [*strata, "__rank"], "inner").withColumnRenamed("__rank", "rank")


def rank_match_all(df: DataFrame, group: str, strata: Sequence[str], order: str, id_col: str) -> DataFrame:
    """For every ordered pair of different ``group`` values, pair rows by
    rank inside ``strata`` -- one self-join on (strata, rank) with
    ``a.group <> b.group`` as a residual condition, instead of a loop over
    group pairs."""
    strata = list(strata)
    r = rank_first(df, [*strata, group], order, id_col, out="__rank")
    a = r.select(*strata, "__rank", *[F.col(c).alias(c + "_a") for c in df.columns if c not in strata])
    b = r.select(*strata, "__rank", *[F.col(c).alias(c + "_b") for c in df.columns if c not in strata])
    cond = [a[s] == b[s] for s in strata] + [a["__rank"] == b["__rank"], a[group + "_a"] != b[group + "_b"]]
    return a.join(b, cond, "inner").select(*[a[s] for s in strata], a["__rank"].alias("rank"),
                                           *[c for c in a.columns if c not in strata and c != "__rank"],
                                           *[c for c in b.columns if c not in strata and c != "__rank"])


def tail_pairs(df: DataFrame, strata: Sequence[str], order: str, id_col: str, k: int) -> DataFrame:
    """The k lowest and the k highest rows (by ``order``) of each
    stratum, paired by position: lowest-1 with (n-k+1)-th, and so on.
    Columns get ``_y`` (low) and ``_o`` (high) suffixes."""
    strata = list(strata)

    def first(*by: Column) -> DataFrame:
        # planned with a partial WindowGroupLimit: a task sends at most k rows a stratum
        w = Window.partitionBy(*strata).orderBy(*by)
        return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)
    low = first(F.col(order).asc(), F.col(id_col).asc())
    high = first(F.col(order).desc(), F.col(id_col).desc()).withColumn("__rank", F.lit(k + 1) - F.col("__rank"))
    cols = [c for c in df.columns if c not in strata]
    low = low.select(*strata, "__rank", *[F.col(c).alias(c + "_y") for c in cols])
    high = high.select(*strata, "__rank", *[F.col(c).alias(c + "_o") for c in cols])
    return low.join(high, [*strata, "__rank"], "inner").withColumnRenamed("__rank", "rank")


def groups_with_all(df: DataFrame, group: str, by: str) -> DataFrame:
    """Rows of ``group`` values present with every value of ``by``
    (e.g. races that have both genders)."""
    n_all = df.select(by).distinct().count()  # size of a small dimension
    ok = (df.groupBy(group).agg(F.count_distinct(by).alias("__k")).filter(F.col("__k") == n_all)
          .select(group))
    return df.join(ok, group, "left_semi")
