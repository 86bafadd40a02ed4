"""Splits and prevalence: A7 (flagship), J11, P4, P6-P10, N1-N3, N7, F9."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.codes import AGE_BANDS
from ..functions.hashing import sql_uniform
from ..functions.tags import race_code, sql_race_code
from ..operators.aggregates import band_join, prevalence
from ..operators.sampling import cap_split, folds, stratified_folds, stratified_split, three_way_split
from ..sources import adapters as ad
from ..sources.tables import table
from . import cohort as C
from . import sqltext as S
from . import variants as V
from .catalog import register
from .q_events import SQL_EVENTS, readmission_labels
from .q_text import TN_WITH

R = 9


def labelled_stays(spark, d) -> DataFrame:
    """Every labelled stay with gender, race code and age at discharge."""
    r = readmission_labels(spark, d)
    a = ad.admissions(spark, d).select("subject_id", "hadm_id", "race", "dischtime")
    p = ad.patients(spark, d)
    j = r.join(a, ["subject_id", "hadm_id"]).join(p, "subject_id")
    return j.select("hadm_id", "thirty_day_readmission", "gender", race_code("race").alias("race_abbrev"),
                    D.actual_age("dischtime", "anchor_year", "anchor_age").alias("actual_age"))


LAB_BASE = ad.sql_with("admissions", "note_keys", "patients") + "," + SQL_EVENTS + f""",
lab AS (SELECT r.hadm_id, r.thirty_day_readmission, p.gender, {sql_race_code('a.race')} AS race_abbrev,
               CAST(year(a.dischtime) - p.anchor_year + p.anchor_age AS INTEGER) AS actual_age
        FROM readm r JOIN admissions a ON r.subject_id = a.subject_id AND r.hadm_id = a.hadm_id
        JOIN patients p ON r.subject_id = p.subject_id)"""
LAB_WITH = LAB_BASE + ",\n" + S.split_sql('lab', group='gender').strip()

BANDS_SQL = "(VALUES " + ", ".join(f"({lo}, {hi}, '({lo}, {hi})')" for lo, hi in AGE_BANDS) + ") b(lo, hi, category)"


def _prev_sql(src: str) -> str:
    return f""",
pj AS (SELECT l.*, s.split FROM {src} l JOIN splits s ON l.hadm_id = s.hadm_id),
cats AS (SELECT 'gender' AS category_type, gender AS category, thirty_day_readmission AS y, split FROM pj
         UNION ALL SELECT 'race', race_abbrev, thirty_day_readmission, split FROM pj
         UNION ALL SELECT 'age_band', b.category, thirty_day_readmission, split FROM pj
                   JOIN {BANDS_SQL} ON pj.actual_age >= b.lo AND pj.actual_age <= b.hi)
SELECT category_type, category,
       round(avg(CASE WHEN split = 'train' THEN CAST(y AS INTEGER) END), {R}) AS train_prevalence,
       round(avg(CASE WHEN split = 'test' THEN CAST(y AS INTEGER) END), {R}) AS test_prevalence
FROM cats GROUP BY category_type, category"""


def _prev_spark(df: DataFrame) -> DataFrame:
    p = prevalence(df, "thirty_day_readmission", "split",
                   {"gender": F.col("gender"), "race": F.col("race_abbrev")}, age="actual_age", bands=AGE_BANDS)
    return p.select("category_type", "category", F.round("train_prevalence", R).alias("train_prevalence"),
                    F.round("test_prevalence", R).alias("test_prevalence"))


@register("a7_prevalence_by_group", LAB_WITH + _prev_sql("lab"))
def q_a7(spark, d):
    """Flagship: next-stay labels (W1) -> stratified split per gender (P4) ->
    prevalence by gender, race code and age band (A7 with the band join)."""
    lab = labelled_stays(spark, d)
    sp = stratified_split(lab, ["gender"], "thirty_day_readmission", 0.5, "hadm_id", 42)
    return _prev_spark(sp)


@register("a7_prevalence_cohort", TN_WITH + _prev_sql("demographics"))
def q_a7c(spark, d):
    """Prevalence on the cohort pool with the shared per-subgroup split."""
    demo = C.demographics(spark, d)
    return _prev_spark(demo.join(V.split_table(demo), "hadm_id"))


@register("p4_stratified_split", LAB_WITH + """
SELECT l.gender, s.split, l.thirty_day_readmission, count(*) AS n
FROM lab l JOIN splits s ON l.hadm_id = s.hadm_id GROUP BY l.gender, s.split, l.thirty_day_readmission""")
def q_p4(spark, d):
    sp = stratified_split(labelled_stays(spark, d), ["gender"], "thirty_day_readmission", 0.5, "hadm_id", 42)
    return sp.groupBy("gender", "split", "thirty_day_readmission").agg(F.count(F.lit(1)).alias("n"))


@register("j11_band_join", LAB_WITH + f"""
SELECT b.category, count(*) AS n, CAST(sum(CAST(thirty_day_readmission AS INTEGER)) AS BIGINT) AS n_pos
FROM lab JOIN {BANDS_SQL} ON lab.actual_age >= b.lo AND lab.actual_age <= b.hi GROUP BY b.category""")
def q_j11(spark, d):
    lab = labelled_stays(spark, d)
    bt = spark.createDataFrame([(lo, hi, f"({lo}, {hi})") for lo, hi in AGE_BANDS], "lo int, hi int, category string")
    j = band_join(lab, bt, "actual_age")
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.col("thirty_day_readmission").cast("int")).cast("bigint").alias("n_pos"))


def _folds_sql(k: int, seed: int, stratified: bool) -> str:
    u = sql_uniform("vec_id", f"'{seed}'")
    cls = "label >= 5" if stratified else "0"
    return f"""
WITH e AS (SELECT vec_id, {cls} AS y, {u} AS u FROM embeddings),
c AS (SELECT y, count(*) AS nc FROM e GROUP BY y),
o AS (SELECT y, coalesce(sum(nc) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c)
SELECT e.vec_id, CAST((o.off + row_number() OVER (PARTITION BY e.y ORDER BY e.u, e.vec_id) - 1) % {k} AS INTEGER) AS fold
FROM e JOIN o ON e.y = o.y"""


@register("p6_stratified_folds", _folds_sql(5, 0, True))
def q_p6(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") >= 5).alias("y"))
    return stratified_folds(e, "y", 5, "vec_id", seed=0).select("vec_id", "fold")


@register("p7_folds", _folds_sql(5, 3, False))
def q_p7(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    return folds(e, 5, "vec_id", seed=3).select("vec_id", "fold")


@register("p8_three_way_split", LAB_BASE + f""",
{S.split_sql('lab', group='gender', test_size=0.2, seed=42).strip()},
rest AS (SELECT l.* FROM lab l JOIN splits s ON l.hadm_id = s.hadm_id WHERE s.split = 'train'),
{S.split_sql('rest', group='gender', test_size=0.25 / (1 - 0.2), seed=43, out='splits2').replace('sp0', 'tp0')
  .replace('sp_', 'tp_').strip()}
SELECT l.gender, CASE WHEN s.split = 'test' THEN 'test' WHEN s2.split = 'train' THEN 'train' ELSE 'val' END AS split,
       count(*) AS n
FROM lab l JOIN splits s ON l.hadm_id = s.hadm_id LEFT JOIN splits2 s2 ON l.hadm_id = s2.hadm_id
GROUP BY 1, 2""")
def q_p8(spark, d):
    sp = three_way_split(labelled_stays(spark, d), ["gender"], "thirty_day_readmission", 0.2, 0.25, "hadm_id", 42)
    return sp.groupBy("gender", "split").agg(F.count(F.lit(1)).alias("n"))


@register("p9_cap_split", f"""
SELECT doc_id FROM labels QUALIFY row_number() OVER (ORDER BY {sql_uniform('doc_id', "'5'")}, doc_id) <= 100""")
def q_p9(spark, d):
    return cap_split(table(spark, d, "labels"), 100, "doc_id", seed=5).select("doc_id")


@register("n1_one_hot", LAB_WITH + """
SELECT hadm_id, CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS gender_F, CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS gender_M,
       CASE WHEN actual_age < 50 THEN 1 ELSE 0 END AS age_lt50 FROM lab""")
def q_n1(spark, d):
    from ..functions.vectors import one_hot
    lab = labelled_stays(spark, d)
    oh = one_hot(lab, "gender", ["F", "M"])
    return oh.select("hadm_id", "gender_F", "gender_M", (F.col("actual_age") < 50).cast("int").alias("age_lt50"))


@register("n2_encode_label", LAB_WITH + """
SELECT race_abbrev, CAST(dense_rank() OVER (ORDER BY race_abbrev) - 1 AS INTEGER) AS label_index
FROM (SELECT DISTINCT race_abbrev FROM lab)""")
def q_n2(spark, d):
    from ..functions.vectors import encode_label
    lab = labelled_stays(spark, d)
    return encode_label(lab.select("race_abbrev").distinct(), "race_abbrev", "label_index")


@register("n3_strict_cast", """
SELECT doc_id, CAST(CAST(quality AS VARCHAR) AS DOUBLE) AS label FROM labels""")
def q_n3(spark, d):
    lab = table(spark, d, "labels")
    return lab.select("doc_id", F.col("quality").cast("string").cast("double").alias("label"))


@register("n7_fingerprint", """
SELECT lang, count(*) AS n_rows, CAST(sum(('0x' || substr(sha256(text), 1, 8))::BIGINT) AS BIGINT) AS sha_sum
FROM documents GROUP BY lang""")
def q_n7(spark, d):
    from ..functions.vectors import fingerprint
    return fingerprint(table(spark, d, "documents"), "text", by=["lang"])


@register("f9_count_difference", """
SELECT (SELECT count(*) FROM labels) AS n_a, (SELECT count(DISTINCT doc_id) FROM labels) AS n_b,
       (SELECT count(*) FROM labels) = (SELECT count(DISTINCT doc_id) FROM labels) AS same""")
def q_f9(spark, d):
    from ..operators.filters import count_difference
    lab = table(spark, d, "labels")
    return count_difference(lab, lab.select("doc_id").distinct())
