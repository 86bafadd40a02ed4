"""Cohort data products: C1 build_cohort, C2 replace_mismatched,
C3 attach_surrogates, C4 assign_surrogates, and the ``demographics`` table
the text operators start from.

Stages are lazy DataFrame functions. The note text is joined only where it
is read (C2's sex check and the text operators), never carried through the
shuffles by patient and subgroup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.codes import EXCLUDED_RACES
from ..functions.hashing import hash52, uniform
from ..functions.tags import find_sex, race_of_abbrev, with_abbrev
from ..operators.filters import balance_weights, exclude_values, keep_groups, unambiguous
from ..operators.ranking import null_safe_join, ordered_position, unit_ranges
from ..operators.sampling import weighted_sample
from ..session import materialize
from ..sources import adapters as ad
from ..sources.tables import table
from .q_events import readmission_labels

MIN_ROWS = 100   # smallest subgroup kept
PER_GROUP = 100  # notes sampled per subgroup
SEED = 0


def cohort_pool(spark: SparkSession, d: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """C1 without the sample: labelled stays with admissions and patients
    (J3, J2), patients whose race never changes (F6), known races (F3),
    subgroups of at least ``min_rows`` rows (F5), age at discharge (D2),
    age-balancing weight (W5) and subgroup code (T13).

    The labels and the pool are stage outputs read by several later steps,
    so both are checkpointed (``materialize``)."""
    readm = materialize(readmission_labels(spark, d))
    adm = ad.admissions(spark, d)
    pat = ad.patients(spark, d)
    m = (readm.join(adm, ["subject_id", "hadm_id"], "inner")
         .join(pat, "subject_id", "left"))
    with_notes = adm.join(readm.select("subject_id"), "subject_id", "left_semi")
    m = m.join(unambiguous(with_notes, "subject_id", "race"), "subject_id", "left_semi")
    m = exclude_values(m, "race", EXCLUDED_RACES)
    m = keep_groups(m, ["gender", "race"], min_rows)
    m = m.withColumn("actual_age", D.actual_age("dischtime", "anchor_year", "anchor_age"))
    m = balance_weights(m, "actual_age", ["race", "gender"])
    return materialize(m.withColumn("abbrev", with_abbrev("gender", "race")))


def build_cohort(spark: SparkSession, d: str, n: int = PER_GROUP, min_rows: int = MIN_ROWS,
                 seed: int = SEED) -> DataFrame:
    """``n`` stays per (gender, race), drawn with the age-balancing
    weight (P1)."""
    return weighted_sample(cohort_pool(spark, d, min_rows), ["gender", "race"], n, "weight", "hadm_id", seed)


def replace_mismatched(sample: DataFrame, pool: DataFrame, notes: DataFrame, seed: int = SEED) -> DataFrame:
    """C2 (T12 + P2): sampled stays whose note states another sex than the
    record are replaced by stays of the same gender, race and age whose note
    agrees. The k-th flagged stay of a stratum (by id) takes the k-th
    candidate in seeded random order, so no candidate is used twice and no
    sampled stay comes back. Flagged stays without a candidate stay as they
    are, marked ``mismatched``. Adds ``replaced`` and ``mismatched``; one row
    comes back per sampled stay."""
    text = notes.select("hadm_id", find_sex("text").alias("sex"))
    s = sample.join(text, "hadm_id", "left").withColumn("sex", F.coalesce("sex", F.lit("")))
    agrees = F.coalesce(F.col("sex") == F.col("gender"), F.lit(False))
    keep = (s.filter(agrees).drop("sex").withColumn("replaced", F.lit(False))
            .withColumn("mismatched", F.lit(False)))
    strata = ["gender", "race", "actual_age"]
    flagged = ordered_position(s.filter(~agrees).drop("sex"), strata, [F.col("hadm_id")],
                               key=F.col("hadm_id"), out="__k")
    cand = (pool.join(flagged.select(*strata).distinct(), strata, "left_semi")
            .join(sample.select("hadm_id"), "hadm_id", "left_anti")
            .join(text, "hadm_id", "inner")
            .filter(F.col("sex") == F.col("gender")).drop("sex"))
    cand = cand.withColumn("__u", uniform(F.col("hadm_id"), seed))
    cand = ordered_position(cand, strata, [F.col("__u"), F.col("hadm_id")], unit_ranges(cand, "__u"),
                            out="__k").drop("__u")
    own = [c for c in sample.columns if c not in strata]
    cand = cand.select(*strata, "__k", *[F.col(c).alias(f"__new_{c}") for c in own])
    found = F.col("__new_hadm_id").isNotNull()
    rest = flagged.join(cand, [*strata, "__k"], "left").select(
        *strata, *[F.when(found, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in own],
        found.alias("replaced"), (~found).alias("mismatched"))
    return keep.unionByName(rest)


def demographics(spark: SparkSession, d: str, pool: DataFrame | None = None) -> DataFrame:
    """Per stay: code, race, gender, name, address, age, visit dates moved to
    2025/2026 (D3), birth year (D4) and the outcome. Built over the whole
    pool, so the text work downstream grows with the data."""
    pool = cohort_pool(spark, d) if pool is None else pool
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    admit_t, disch_t = D.shift_stay("admittime", "dischtime")
    p = pool.withColumn("admittime_today", admit_t).withColumn("dischtime_today", disch_t)
    p = (p.join(c, p.subject_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .withColumn("name", F.col("c_name"))
         .withColumn("address", F.concat(F.col("c_custkey").cast("string"), F.lit(" Harbor Road, "),
                                         F.col("n_name"))))
    return p.select("hadm_id", "subject_id", "abbrev", race_of_abbrev("abbrev").alias("race_abbrev"), "race",
                    "gender", "name", "address", "actual_age", "admittime_today", "dischtime_today",
                    D.birth_year("dischtime_today", "actual_age").alias("dob"), "thirty_day_readmission")


def surrogate_pool(spark: SparkSession, d: str) -> DataFrame:
    """C4 pool: generated names and addresses per (race, gender); here
    supplier names with the supplier's nation as race."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").alias("pool_id"), F.col("n_name").alias("race"),
                    F.when(F.col("s_suppkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
                    F.regexp_replace("s_name", "[<>]", "").alias("name"),
                    F.concat(F.col("s_suppkey").cast("string"), F.lit(" Mill Lane, "), F.col("n_name"))
                    .alias("address")))


def assign_surrogates(df: DataFrame, pool: DataFrame, keys: Sequence[str] = ("race", "gender"),
                      id_col: str = "hadm_id", seed: int = SEED) -> DataFrame:
    """C4: each row gets the pool entry number ``hash(id, seed) mod size``
    of its stratum. Pool entries are numbered per stratum by ``pool_id``
    (skew-safe positions); rows of strata without a pool get nulls."""
    keys = list(keys)
    ranked = ordered_position(pool, keys, [F.col("pool_id")], key=F.col("pool_id"), out="__idx", total="__size")
    sizes = ranked.select(*keys, "__size").distinct()
    rows = null_safe_join(df, sizes, keys, how="left")
    rows = rows.withColumn("__idx", F.pmod(hash52(F.col(id_col), F.lit(str(seed))), F.col("__size")) + 1)
    picked = ranked.select(*keys, "__idx", "name", "address")
    return (rows.join(picked, [*keys, "__idx"], "left").drop("__idx", "__size"))


def fill_from_match(df: DataFrame, pool: DataFrame, keys: Sequence[str], cols: Sequence[str],
                    order: str) -> DataFrame:
    """Missing values of ``cols`` taken from the first pool row (by
    ``order``) with the same ``keys``. The pool is cut to one row per key
    before the join (a partial WindowGroupLimit per task)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    first = (pool.filter(F.col(cols[0]).isNotNull())
             .withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
             .select(*keys, *[F.col(c).alias(f"__f_{c}") for c in cols]))
    res = df.join(first, keys, "left")
    for c in cols:
        res = res.withColumn(c, F.coalesce(F.col(c), F.col(f"__f_{c}")))
    return res.drop(*[f"__f_{c}" for c in cols])


def attach_surrogates(cohort: DataFrame, generated: DataFrame) -> DataFrame:
    """Join generated name and address by stay id (one to one); stays
    without one (replacements) take them from the first generated row with
    the same race, age and gender (J10)."""
    gen = generated.select("hadm_id", "name", "address")
    res = cohort.join(gen, "hadm_id", "left")
    return fill_from_match(res, generated, ["race", "actual_age", "gender"], ["name", "address"], "hadm_id")
