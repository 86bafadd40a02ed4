"""Cohort family: F3, F5, F6, J2, J3, J5, W4, W5, D1-D4, P1, P2, A1, A6,
C1-C4, J10, W10, T12, T13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.codes import EXCLUDED_RACES
from ..functions.hashing import sql_uniform
from ..functions.tags import find_sex, sql_race_code
from ..operators.aggregates import quantiles, value_counts
from ..operators.filters import exclude_values, keep_groups, unambiguous
from ..operators.sampling import random_parts, weighted_sample
from ..sources import adapters as ad
from ..sources.tables import table
from . import cohort as C
from .catalog import register
from .q_events import SQL_EVENTS, readmission_labels

_EXCL = ", ".join(f"'{r}'" for r in EXCLUDED_RACES)
U0 = sql_uniform("hadm_id", "0")

SQL_POOL = f"""
pw AS (SELECT DISTINCT subject_id FROM readm),
unamb AS (SELECT subject_id FROM (SELECT DISTINCT subject_id, race FROM admissions
          WHERE subject_id IN (SELECT subject_id FROM pw)) GROUP BY subject_id HAVING count(*) = 1),
m0 AS (
  SELECT r.hadm_id, r.subject_id, r.visit_no, r.thirty_day_readmission, a.admittime, a.dischtime, a.race,
         p.gender, p.anchor_age, p.anchor_year
  FROM readm r JOIN admissions a ON r.subject_id = a.subject_id AND r.hadm_id = a.hadm_id
  LEFT JOIN patients p ON r.subject_id = p.subject_id
  WHERE r.subject_id IN (SELECT subject_id FROM unamb) AND NOT COALESCE(a.race IN ({_EXCL}), false)),
grp AS (SELECT gender, race FROM m0 GROUP BY gender, race HAVING count(*) >= {C.MIN_ROWS}),
m1 AS (SELECT m0.* FROM m0 JOIN grp ON m0.gender = grp.gender AND m0.race = grp.race),
m2 AS (SELECT *, CAST(year(dischtime) - anchor_year + anchor_age AS INTEGER) AS actual_age FROM m1),
pool AS (
  SELECT *, CAST(count(*) OVER (PARTITION BY actual_age) AS DOUBLE)
              / count(*) OVER (PARTITION BY actual_age, race, gender) AS weight,
         gender || '_' || {sql_race_code('race')} AS abbrev
  FROM m2),
cohort AS (
  SELECT * FROM pool
  QUALIFY row_number() OVER (PARTITION BY gender, race ORDER BY -ln({U0}) / weight, hadm_id) <= {C.PER_GROUP}),
demo AS (
  SELECT p.hadm_id, p.subject_id, p.abbrev, substr(p.abbrev, 3) AS race_abbrev, p.race, p.gender,
         c.c_name AS name, CAST(c.c_custkey AS VARCHAR) || ' Harbor Road, ' || n.n_name AS address,
         p.actual_age, p.admittime + to_years(CAST(2025 - year(p.admittime) AS INTEGER)) AS admittime_today,
         p.dischtime + to_years(CAST((CASE WHEN year(p.admittime) = year(p.dischtime) THEN 2025 ELSE 2026 END)
                                     - year(p.dischtime) AS INTEGER)) AS dischtime_today,
         p.thirty_day_readmission
  FROM pool p JOIN customer c ON p.subject_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
demographics AS (SELECT *, CAST(year(dischtime_today) - actual_age AS INTEGER) AS dob FROM demo)"""

SEX_RE = r"Sex:\s*(?:<[^>/]*>)?\s*(\S)"

SQL_REPLACED = f"""
samp AS (SELECT c.*, COALESCE(regexp_extract(n.text, '{SEX_RE}', 1), '') AS sex
         FROM cohort c LEFT JOIN notes n ON c.hadm_id = n.hadm_id),
flag AS (SELECT gender, race, actual_age, hadm_id,
                row_number() OVER (PARTITION BY gender, race, actual_age ORDER BY hadm_id) AS k
         FROM samp WHERE sex <> gender),
cand AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.gender, p.race, p.actual_age
                                 ORDER BY {sql_uniform('p.hadm_id', "'0'")}, p.hadm_id) AS k
  FROM pool p JOIN notes n ON p.hadm_id = n.hadm_id
  WHERE regexp_extract(n.text, '{SEX_RE}', 1) = p.gender
    AND p.hadm_id NOT IN (SELECT hadm_id FROM cohort)
    AND EXISTS (SELECT 1 FROM flag f WHERE f.gender = p.gender AND f.race = p.race
                AND f.actual_age = p.actual_age)),
final AS (
  SELECT hadm_id, subject_id, abbrev, gender, race, actual_age, thirty_day_readmission, false AS replaced,
         false AS mismatched
  FROM samp WHERE sex = gender
  UNION ALL
  SELECT COALESCE(c.hadm_id, s.hadm_id), COALESCE(c.subject_id, s.subject_id), s.abbrev, s.gender, s.race,
         s.actual_age, CASE WHEN c.hadm_id IS NULL THEN s.thirty_day_readmission ELSE c.thirty_day_readmission END,
         c.hadm_id IS NOT NULL, c.hadm_id IS NULL
  FROM flag f JOIN samp s ON f.hadm_id = s.hadm_id
  LEFT JOIN cand c ON f.gender = c.gender AND f.race = c.race AND f.actual_age = c.actual_age AND f.k = c.k)"""

POOL_WITH = (ad.sql_with("admissions", "note_keys", "patients") + "," + SQL_EVENTS + "," + SQL_POOL + "\n")
REPL_WITH = (ad.sql_with("admissions", "note_keys", "patients", "notes") + "," + SQL_EVENTS + "," + SQL_POOL
             + "," + SQL_REPLACED + "\n")


@register("c1_build_cohort", POOL_WITH + """
SELECT hadm_id, subject_id, abbrev, gender, race, actual_age, weight, visit_no, thirty_day_readmission
FROM cohort""")
def q_c1(spark, d):
    return C.build_cohort(spark, d).select("hadm_id", "subject_id", "abbrev", "gender", "race", "actual_age",
                                           "weight", "visit_no", "thirty_day_readmission")


@register("c2_replace_mismatched", REPL_WITH + "SELECT * FROM final")
def q_c2(spark, d):
    pool = C.cohort_pool(spark, d)
    sample = weighted_sample(pool, ["gender", "race"], C.PER_GROUP, "weight", "hadm_id", C.SEED)
    res = C.replace_mismatched(sample, pool, ad.notes(spark, d))
    return res.select("hadm_id", "subject_id", "abbrev", "gender", "race", "actual_age",
                      "thirty_day_readmission", "replaced", "mismatched")


@register("f6_unambiguous", ad.sql_with("admissions", "note_keys", "patients") + "," + SQL_EVENTS + "," + """
pw AS (SELECT DISTINCT subject_id FROM readm)
SELECT subject_id FROM (SELECT DISTINCT subject_id, race FROM admissions WHERE subject_id IN (SELECT subject_id FROM pw))
GROUP BY subject_id HAVING count(*) = 1""")
def q_f6(spark, d):
    readm = readmission_labels(spark, d)
    adm = ad.admissions(spark, d).join(readm.select("subject_id"), "subject_id", "left_semi")
    return unambiguous(adm, "subject_id", "race")


@register("f3_exclude_values", ad.sql_with("admissions") + f"""
SELECT race, CAST(count(*) AS BIGINT) AS n FROM admissions
WHERE NOT COALESCE(race IN ({_EXCL}), false) GROUP BY race""")
def q_f3(spark, d):
    a = exclude_values(ad.admissions(spark, d), "race", EXCLUDED_RACES)
    return a.groupBy("race").agg(F.count(F.lit(1)).alias("n"))


@register("f5_keep_groups", ad.sql_with("admissions", "patients") + """,
ap AS (SELECT a.*, p.gender FROM admissions a JOIN patients p ON a.subject_id = p.subject_id)
SELECT gender, race, CAST(count(*) AS BIGINT) AS n FROM ap
WHERE gender IS NOT NULL AND race IS NOT NULL GROUP BY gender, race HAVING count(*) >= 300""")
def q_f5(spark, d):
    ap = ad.admissions(spark, d).join(ad.patients(spark, d), "subject_id")
    kept = keep_groups(ap, ["gender", "race"], 300)
    return kept.groupBy("gender", "race").agg(F.count(F.lit(1)).alias("n"))


@register("j2_left_join", POOL_WITH + """
SELECT r.hadm_id, p.gender, p.anchor_age FROM readm r LEFT JOIN patients p ON r.subject_id = p.subject_id""")
def q_j2(spark, d):
    r = readmission_labels(spark, d)
    return r.join(ad.patients(spark, d), "subject_id", "left").select("hadm_id", "gender", "anchor_age")


@register("j3_inner_join", POOL_WITH + """
SELECT r.hadm_id, a.race, a.dischtime, r.thirty_day_readmission
FROM readm r JOIN admissions a ON r.subject_id = a.subject_id AND r.hadm_id = a.hadm_id""")
def q_j3(spark, d):
    r = readmission_labels(spark, d)
    a = ad.admissions(spark, d)
    return r.join(a, ["subject_id", "hadm_id"]).select("hadm_id", "race", "dischtime", "thirty_day_readmission")


@register("j5_anti_join", POOL_WITH + f"""
SELECT r.hadm_id, r.subject_id FROM readm r JOIN admissions a ON r.subject_id = a.subject_id AND r.hadm_id = a.hadm_id
WHERE NOT COALESCE(a.race IN ({_EXCL}), false) AND r.subject_id NOT IN (SELECT subject_id FROM unamb)
UNION ALL
SELECT r.hadm_id, r.subject_id FROM readm r
WHERE r.subject_id NOT IN (SELECT subject_id FROM unamb)""")
def q_j5(spark, d):
    """Semi join keeps the unambiguous patients; here the complement: labelled
    stays of patients whose race changes (left_anti), together with the
    stays of known race that the semi join dropped."""
    readm = readmission_labels(spark, d)
    adm = ad.admissions(spark, d)
    una = unambiguous(adm.join(readm.select("subject_id"), "subject_id", "left_semi"), "subject_id", "race")
    r_anti = readm.join(una, "subject_id", "left_anti").select("hadm_id", "subject_id")
    m0 = exclude_values(readm.join(adm.select("subject_id", "hadm_id", "race"), ["subject_id", "hadm_id"]),
                        "race", EXCLUDED_RACES)
    return m0.join(una, "subject_id", "left_anti").select("hadm_id", "subject_id").unionByName(r_anti)


@register("w4_group_size", POOL_WITH + """
SELECT hadm_id, CAST(count(*) OVER (PARTITION BY gender, race) AS BIGINT) AS group_size FROM pool""")
def q_w4(spark, d):
    from ..operators.ranking import group_sizes
    return group_sizes(C.cohort_pool(spark, d), ["gender", "race"]).select("hadm_id", "group_size")


@register("w5_balance_weights", POOL_WITH + "SELECT hadm_id, actual_age, weight FROM pool")
def q_w5(spark, d):
    return C.cohort_pool(spark, d).select("hadm_id", "actual_age", "weight")


@register("d1_parse_timestamp", """
SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts
FROM orders""")
def q_d1(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", D.parse_timestamp(D.ts_text("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@register("d2_actual_age", POOL_WITH + "SELECT hadm_id, actual_age FROM pool")
def q_d2(spark, d):
    return C.cohort_pool(spark, d).select("hadm_id", "actual_age")


@register("d3_shift_year", POOL_WITH + """
SELECT hadm_id, strftime(admittime_today, '%Y-%m-%d %H:%M:%S') AS admittime_today,
       strftime(dischtime_today, '%Y-%m-%d %H:%M:%S') AS dischtime_today FROM demographics""")
def q_d3(spark, d):
    dm = C.demographics(spark, d)
    return dm.select("hadm_id", D.ts_text("admittime_today").alias("admittime_today"),
                     D.ts_text("dischtime_today").alias("dischtime_today"))


@register("d4_birth_year", POOL_WITH + "SELECT hadm_id, dob FROM demographics")
def q_d4(spark, d):
    return C.demographics(spark, d).select("hadm_id", "dob")


@register("p1_weighted_sample", f"""
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity > 0
QUALIFY row_number() OVER (PARTITION BY l_returnflag
  ORDER BY -ln({sql_uniform("l_orderkey || '.' || l_linenumber", "'7'")}) / l_quantity,
           l_orderkey || '.' || l_linenumber) <= 50""")
def q_p1(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_quantity") > 0)
    li = li.withColumn("__id", F.concat_ws(".", "l_orderkey", "l_linenumber"))
    return weighted_sample(li, ["l_returnflag"], 50, "l_quantity", "__id", seed=7) \
        .select("l_orderkey", "l_linenumber", "l_returnflag")


@register("a1_value_counts", POOL_WITH + """
SELECT actual_age, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER () AS share
FROM pool WHERE actual_age IS NOT NULL GROUP BY actual_age""")
def q_a1(spark, d):
    return value_counts(C.cohort_pool(spark, d), "actual_age")


@register("a6_quantiles", POOL_WITH + """
SELECT 'ALL' AS grp, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS prob,
       CAST(unnest(quantile_cont(actual_age, [0.0, 0.25, 0.5, 0.75, 1.0])) AS DOUBLE) AS value FROM pool
UNION ALL
SELECT gender AS grp, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS prob,
       CAST(unnest(quantile_cont(actual_age, [0.0, 0.25, 0.5, 0.75, 1.0])) AS DOUBLE) AS value
FROM pool GROUP BY gender""")
def q_a6(spark, d):
    pool = C.cohort_pool(spark, d)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    overall = quantiles(pool, "actual_age", [], probs).withColumn("grp", F.lit("ALL"))
    by_g = quantiles(pool, "actual_age", ["gender"], probs).withColumnRenamed("gender", "grp")
    return overall.select("grp", "prob", "value").unionByName(by_g.select("grp", "prob", "value"))


@register("t12_find_sex", ad.sql_with("notes") + f"""
SELECT hadm_id, COALESCE(regexp_extract(text, '{SEX_RE}', 1), '') AS sex FROM notes""")
def q_t12(spark, d):
    return ad.notes(spark, d).select("hadm_id", find_sex("text").alias("sex"))


@register("t13_with_abbrev", POOL_WITH + """
SELECT abbrev, gender, race, substr(abbrev, 3) AS race_abbrev, CAST(count(*) AS BIGINT) AS n
FROM pool GROUP BY abbrev, gender, race""")
def q_t13(spark, d):
    from ..functions.tags import race_of_abbrev
    p = C.cohort_pool(spark, d)
    return p.groupBy("abbrev", "gender", "race").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("race_abbrev", race_of_abbrev("abbrev"))


SQL_SURR = """,
spool AS (
  SELECT s_suppkey AS pool_id, n_name AS race, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         regexp_replace(s_name, '[<>]', '', 'g') AS name,
         CAST(s_suppkey AS VARCHAR) || ' Mill Lane, ' || n_name AS address
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sranked AS (SELECT *, row_number() OVER (PARTITION BY race, gender ORDER BY pool_id) AS idx,
                   count(*) OVER (PARTITION BY race, gender) AS size FROM spool),
ssize AS (SELECT DISTINCT race, gender, size FROM sranked),
generated AS (
  SELECT c.hadm_id, c.race, c.gender, c.actual_age, s.name, s.address
  FROM cohort c LEFT JOIN ssize z ON c.race = z.race AND c.gender = z.gender
  LEFT JOIN sranked s ON s.race = c.race AND s.gender = c.gender
       AND s.idx = (('0x' || substr(md5(CAST(c.hadm_id AS VARCHAR) || '|0'), 1, 13))::BIGINT % z.size) + 1)
"""


@register("c4_assign_surrogates", POOL_WITH + SQL_SURR + "SELECT hadm_id, name, address FROM generated")
def q_c4(spark, d):
    gen = C.assign_surrogates(C.build_cohort(spark, d), C.surrogate_pool(spark, d))
    return gen.select("hadm_id", "name", "address")


@register("c3_attach_surrogates", REPL_WITH + SQL_SURR + """,
firstgen AS (SELECT race, actual_age, gender, name, address FROM generated WHERE name IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY race, actual_age, gender ORDER BY hadm_id) = 1)
SELECT f.hadm_id, COALESCE(g.name, fg.name) AS name, COALESCE(g.address, fg.address) AS address
FROM final f LEFT JOIN generated g ON f.hadm_id = g.hadm_id
LEFT JOIN firstgen fg ON f.race = fg.race AND f.actual_age = fg.actual_age AND f.gender = fg.gender""")
def q_c3(spark, d):
    pool = C.cohort_pool(spark, d)
    sample = weighted_sample(pool, ["gender", "race"], C.PER_GROUP, "weight", "hadm_id", C.SEED)
    final = C.replace_mismatched(sample, pool, ad.notes(spark, d))
    gen = C.assign_surrogates(sample, C.surrogate_pool(spark, d))
    return C.attach_surrogates(final, gen).select("hadm_id", "name", "address")


@register("j10_fill_from_match", POOL_WITH + """,
firstp AS (SELECT race, actual_age, gender, hadm_id AS match_id FROM pool
           QUALIFY row_number() OVER (PARTITION BY race, actual_age, gender ORDER BY hadm_id) = 1)
SELECT c.hadm_id, f.match_id FROM cohort c
LEFT JOIN firstp f ON c.race = f.race AND c.actual_age = f.actual_age AND c.gender = f.gender""")
def q_j10(spark, d):
    pool = C.cohort_pool(spark, d)
    cohort = weighted_sample(pool, ["gender", "race"], C.PER_GROUP, "weight", "hadm_id", C.SEED)
    res = C.fill_from_match(cohort.select("hadm_id", "race", "actual_age", "gender")
                            .withColumn("match_id", F.lit(None).cast("long")),
                            pool.withColumn("match_id", F.col("hadm_id")),
                            ["race", "actual_age", "gender"], ["match_id"], "hadm_id")
    return res.select("hadm_id", "match_id")


@register("w10_random_parts", POOL_WITH + f"""
SELECT hadm_id, CAST(ntile(41) OVER (ORDER BY {U0}, hadm_id) AS INTEGER) AS part FROM cohort""")
def q_w10(spark, d):
    return random_parts(C.build_cohort(spark, d), 41, "hadm_id", seed=0).select("hadm_id", "part")


@register("p2_replace_flagged", REPL_WITH + "SELECT hadm_id, gender, race, actual_age FROM final WHERE replaced")
def q_p2(spark, d):
    """The replacement draws alone (one candidate per flagged stay)."""
    pool = C.cohort_pool(spark, d)
    sample = weighted_sample(pool, ["gender", "race"], C.PER_GROUP, "weight", "hadm_id", C.SEED)
    res = C.replace_mismatched(sample, pool, ad.notes(spark, d))
    return res.filter("replaced").select("hadm_id", "gender", "race", "actual_age")
