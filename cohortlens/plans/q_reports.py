"""Reports family: C14-C20, A2-A5, A9-A15, W6-W8, J4, J6, J12, J13, P10,
T15, T16, F7, F8, O1-O4, U1."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import race_code, sql_race_code, test_size_of
from ..operators import metrics as M
from ..operators.aggregates import (coarsen, delta_to_baseline, explode_per_class, extremes, influence,
                                    minus_diagonal, to_matrix, unpivot, with_group_stats)
from ..operators.sampling import select_task, stratified_split, stratified_splits
from ..session import materialize
from ..sources.tables import table
from . import cohort as C
from . import counterfactuals as CF
from . import reports as RP
from .catalog import register
from .q_metrics import sql_auroc
from ..functions.hashing import sql_uniform, uniform
from .q_cohort import POOL_WITH, SQL_SURR
from .q_pairs import TT_WITH, _c10_sql, _c11_sql, _c12_sql, _c13_sql, _c9_sql, cte_body, test_rows
from .q_splits import LAB_WITH
from .q_text import TN_WITH

R = 9


def runs(spark, d) -> DataFrame:
    """Run metrics of the gender, age-shift and age-swap families."""
    return RP.cf_runs(*test_rows(spark, d))


def _renamed(sql: str, **names: str) -> str:
    """SQL with table names of its own, to stand beside another chain."""
    for old, new in names.items():
        sql = re.sub(rf"\b{old}\b", new, sql)
    return sql


RUNS_WITH = (cte_body(_c9_sql()) + cte_body(_c13_sql())[len(TT_WITH):]
             + _renamed(cte_body(_c12_sql())[len(TT_WITH):], pr="apr", vv="avv")) + """,
cfv AS (SELECT 'gender' AS family, variant, hadm_id AS id, CAST(thirty_day_readmission AS INTEGER) AS y, text FROM gv
        UNION ALL
        SELECT 'age_shift', variant, hadm_id, CAST(thirty_day_readmission AS INTEGER), text FROM sh
        UNION ALL
        SELECT 'age_swap', variant, hadm_id, CAST(thirty_day_readmission AS INTEGER), text FROM av),
sc AS (SELECT family, variant, 'anon' AS model, id, y, (length(text) % 100) / 100.0 AS p FROM cfv
       UNION ALL
       SELECT family, variant, 'full', id, y, (('0x' || substr(md5(text), 1, 4))::BIGINT % 1000) / 1000.0 FROM cfv),
""" + sql_auroc("sc", "family, variant, model").strip() + """,
mp AS (SELECT family, variant, model, avg(p) AS mean_proba FROM sc GROUP BY family, variant, model),
runs AS (SELECT family, variant, model, 'auroc' AS metric, auroc AS value FROM au
         UNION ALL SELECT family, variant, model, 'mean_proba', mean_proba FROM mp)
"""


@register("c14_metric_report", RUNS_WITH + f"SELECT family, variant, model, metric, round(value, {R}) AS value FROM runs")
def q_c14(spark, d):
    return runs(spark, d).select("family", "variant", "model", "metric", F.round("value", R).alias("value"))


@register("c15_effect_report", RUNS_WITH + f""",
r AS (SELECT *, regexp_extract(variant, '^([a-z]+)', 1) AS direction FROM runs WHERE metric = 'mean_proba'),
b AS (SELECT family, direction, model, value AS base FROM r WHERE variant = direction)
SELECT r.family, r.direction, r.variant, r.model, round(r.value - b.base, {R}) + 0.0 AS delta
FROM r LEFT JOIN b ON r.family = b.family AND r.direction = b.direction AND r.model = b.model
WHERE r.variant <> r.direction""")
def q_c15(spark, d):
    e = RP.effect_report(runs(spark, d))
    return e.select("family", "direction", "variant", "model", (F.round("delta", R) + F.lit(0.0)).alias("delta"))


@register("w7_delta_to_baseline", """
SELECT l.l_orderkey, l.l_linenumber, round(l.l_extendedprice - b.base, 6) AS price_delta
FROM lineitem l LEFT JOIN (SELECT l_orderkey, first(l_extendedprice) AS base FROM lineitem
                           WHERE l_linenumber = 1 GROUP BY l_orderkey) b ON l.l_orderkey = b.l_orderkey""")
def q_w7(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    r = delta_to_baseline(li, ["l_orderkey"], F.col("l_linenumber") == 1, ["l_extendedprice"])
    return r.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_delta", 6).alias("price_delta"))


@register("a13_metrics_side_by_side", RUNS_WITH + f"""
SELECT family, variant, model, round(max(CASE WHEN metric = 'auroc' THEN value END), {R}) AS auroc,
       round(max(CASE WHEN metric = 'mean_proba' THEN value END), {R}) AS mean_proba
FROM runs GROUP BY family, variant, model""")
def q_a13(spark, d):
    w = runs(spark, d).groupBy("family", "variant", "model").pivot("metric", ["auroc", "mean_proba"]).agg(F.first("value"))
    return w.select("family", "variant", "model", F.round("auroc", R).alias("auroc"),
                    F.round("mean_proba", R).alias("mean_proba"))


@register("a3_pivot_max", """
SELECT o_orderpriority, round(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS max_f,
       round(max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 6) AS max_o FROM orders GROUP BY o_orderpriority""")
def q_a3(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(
        F.round(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 6).alias("max_f"),
        F.round(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 6).alias("max_o"))


@register("a11_to_matrix", RUNS_WITH + f"""
SELECT variant, round(max(CASE WHEN model = 'anon' THEN value END), {R}) AS anon,
       round(max(CASE WHEN model = 'full' THEN value END), {R}) AS full
FROM runs WHERE family = 'gender' AND metric = 'mean_proba' GROUP BY variant""")
def q_a11(spark, d):
    r = runs(spark, d).filter((F.col("family") == "gender") & (F.col("metric") == "mean_proba"))
    m = to_matrix(r, "variant", "model", "value", ["anon", "full"])
    return m.select("variant", F.round("anon", R).alias("anon"), F.round("full", R).alias("full"))


@register("a12_unpivot", RUNS_WITH + f"""
SELECT variant, model, round(value, {R}) AS value FROM runs WHERE family = 'gender' AND metric = 'mean_proba'""")
def q_a12(spark, d):
    r = runs(spark, d).filter((F.col("family") == "gender") & (F.col("metric") == "mean_proba"))
    m = to_matrix(r, "variant", "model", "value", ["anon", "full"])
    return unpivot(m, ["variant"], ["anon", "full"], "model", "value").select(
        "variant", "model", F.round("value", R).alias("value"))


@register("a9_extremes", RUNS_WITH + f""",
rv AS (SELECT family, variant, model, round(value, 9) AS value FROM runs WHERE metric = 'mean_proba'),
rk AS (SELECT *, row_number() OVER (PARTITION BY family, model ORDER BY value, variant) AS lo,
              row_number() OVER (PARTITION BY family, model ORDER BY value DESC, variant DESC) AS hi
       FROM rv)
SELECT family, model, max(CASE WHEN lo = 1 THEN variant END) AS min_variant,
       round(max(CASE WHEN lo = 1 THEN value END), {R}) AS min_value,
       max(CASE WHEN hi = 1 THEN variant END) AS max_variant, round(max(CASE WHEN hi = 1 THEN value END), {R}) AS max_value
FROM rk GROUP BY family, model""")
def q_a9(spark, d):
    r = runs(spark, d).filter(F.col("metric") == "mean_proba").withColumn("value", F.round("value", R))
    e = extremes(r, ["family", "model"], ["value", "variant"], ["variant", "value"])
    return e.select("family", "model", F.col("min_row.variant").alias("min_variant"),
                    F.round("min_row.value", R).alias("min_value"), F.col("max_row.variant").alias("max_variant"),
                    F.round("max_row.value", R).alias("max_value"))


ATTRS = ["name", "address", "gender"]


@register("a10_influence", RUNS_WITH + """,
g AS (SELECT variant, value, row_number() OVER (ORDER BY value, variant) AS rk
      FROM runs WHERE family = 'gender' AND model = 'full' AND metric = 'mean_proba')
SELECT a.attribute, CAST(sum(CASE WHEN contains(g.variant, a.attribute) THEN rk ELSE 0 END) AS BIGINT) AS rank_sum
FROM g CROSS JOIN (SELECT unnest(['name', 'address', 'gender']) AS attribute) a GROUP BY a.attribute""")
def q_a10(spark, d):
    r = runs(spark, d).filter((F.col("family") == "gender") & (F.col("model") == "full")
                              & (F.col("metric") == "mean_proba"))
    r = r.select("variant", "value", *[F.col("variant").contains(a).alias(a) for a in ATTRS])
    return influence(r, "variant", "value", ATTRS).withColumn("rank_sum", F.col("rank_sum").cast("long"))


@register("c19_runs_by_attribute", RUNS_WITH + f""",
g AS (SELECT * FROM runs WHERE family = 'gender' AND metric = 'mean_proba')
SELECT a.attribute, g.model, count(*) AS n_runs, round(avg(g.value), {R}) AS mean_value
FROM g JOIN (SELECT unnest(['name', 'address', 'gender']) AS attribute) a ON contains(g.variant, a.attribute)
GROUP BY a.attribute, g.model""")
def q_c19(spark, d):
    r = runs(spark, d).filter((F.col("family") == "gender") & (F.col("metric") == "mean_proba"))
    ex = r.withColumn("attribute", F.explode(F.filter(F.array(*[F.lit(a) for a in ATTRS]),
                                                      lambda a: F.col("variant").contains(a))))
    return ex.groupBy("attribute", "model").agg(F.count(F.lit(1)).alias("n_runs"),
                                                F.round(F.avg("value"), R).alias("mean_value"))


# ---------------------------------------------------------------- race effects

RACE_WITH = cte_body(_c10_sql()) + _renamed(cte_body(_c11_sql())[len(TN_WITH):], test0="test0r", tt="ttr") + """,
rall AS (SELECT variant, text FROM allv UNION ALL SELECT variant, text FROM ex),
rsc AS (SELECT variant, 'anon' AS model, (length(text) % 100) / 100.0 AS p FROM rall
        UNION ALL SELECT variant, 'full', (('0x' || substr(md5(text), 1, 4))::BIGINT % 1000) / 1000.0 FROM rall),
rmp AS (SELECT variant, model, avg(p) AS mean_proba FROM rsc GROUP BY variant, model),
rp AS (SELECT *, CASE WHEN instr(variant, '_to_') > 0 THEN regexp_extract(variant, '^(.*?)_to_', 1)
                      ELSE regexp_replace(variant, '_race$', '') END AS orig,
              regexp_extract(variant, '_to_(.*)$', 1) AS rest FROM rmp),
rp2 AS (SELECT *, CASE WHEN instr(variant, '_to_') > 0 THEN regexp_extract(rest, '_(name_address|name|address|race)$', 1)
                       ELSE regexp_extract(variant, '_(race)$', 1) END AS kind,
               CASE WHEN instr(variant, '_to_') > 0 THEN regexp_replace(rest, '_(name_address|name|address|race)$', '')
                    ELSE orig END AS new FROM rp),
rbase AS (SELECT orig, model, kind = 'race' AS explicit, mean_proba AS base FROM rp2 WHERE new = orig),
fine AS (SELECT r.orig, r.new, r.kind, r.model, r.mean_proba - b.base AS delta
         FROM rp2 r LEFT JOIN rbase b ON r.orig = b.orig AND r.model = b.model AND (r.kind = 'race') = b.explicit),
region AS (SELECT """ + sql_race_code("n_name") + """ AS code, r_name AS grp
           FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def race_runs(spark, d) -> DataFrame:
    """All four kinds (name, address, both, explicit race) by both models."""
    tn, text = test_rows(spark, d)
    v = CF.race_counterfactuals(tn, text).unionByName(CF.race_counterfactuals_explicit(tn, text))
    mp = RP.score_variants(v, "race").groupBy("variant", "model").agg(F.avg("p").alias("mean_proba"))
    return RP.race_parts(materialize(mp))


def race_fine(spark, d) -> DataFrame:
    return RP.race_effects(race_runs(spark, d))


def region_map(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(race_code("n_name").alias("code"),
                                                             F.col("r_name").alias("group"))


@register("t15_parse_variant", RACE_WITH + "SELECT variant, orig, new, kind FROM rp2")
def q_t15(spark, d):
    return race_runs(spark, d).select("variant", "orig", "new", "kind")


@register("c16_race_effects_fine", RACE_WITH + f"SELECT orig, new, kind, model, round(delta, {R}) + 0.0 AS delta FROM fine")
def q_c16(spark, d):
    return race_fine(spark, d).select("orig", "new", "kind", "model", (F.round("delta", R) + F.lit(0.0)).alias("delta"))


@register("c16_race_effects_coarse", RACE_WITH + f"""
SELECT a.grp AS orig_group, b.grp AS new_group, f.kind, f.model, round(avg(f.delta), {R}) + 0.0 AS delta
FROM fine f JOIN region a ON f.orig = a.code JOIN region b ON f.new = b.code
GROUP BY a.grp, b.grp, f.kind, f.model""")
def q_c16c(spark, d):
    f = race_fine(spark, d)
    m = region_map(spark, d)
    f = coarsen(f, "orig", m, map_code="code", map_group="group")
    f = coarsen(f, "new", m, map_code="code", map_group="group")
    return f.groupBy(F.col("orig_group"), F.col("new_group"), "kind", "model").agg(
        (F.round(F.avg("delta"), R) + F.lit(0.0)).alias("delta"))


@register("w8_minus_diagonal", """
WITH m AS (SELECT c.c_nationkey AS buyer, s.s_nationkey AS seller, sum(l_extendedprice) AS revenue
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c.c_custkey
           JOIN supplier s ON l_suppkey = s.s_suppkey GROUP BY 1, 2)
SELECT m.buyer, m.seller, round(m.revenue - dg.revenue, 4) AS delta
FROM m LEFT JOIN (SELECT buyer, revenue FROM m WHERE buyer = seller) dg ON m.buyer = dg.buyer""")
def q_w8(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("buyer"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("seller"))
    m = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .join(s, li.l_suppkey == s.s_suppkey).groupBy("buyer", "seller").agg(F.sum("l_extendedprice").alias("revenue")))
    r = minus_diagonal(m, [], "buyer", "seller", ["revenue"])
    return r.select("buyer", "seller", F.round("revenue_delta", 4).alias("delta"))


# ---------------------------------------------------------------- prevalence deltas

@register("c17_prevalence_deltas", LAB_WITH + """,
pj AS (SELECT l.*, s.split FROM lab l JOIN splits s ON l.hadm_id = s.hadm_id),
pr AS (SELECT race_abbrev AS category, avg(CASE WHEN split = 'train' THEN CAST(thirty_day_readmission AS INTEGER) END) AS tr,
              avg(CASE WHEN split = 'test' THEN CAST(thirty_day_readmission AS INTEGER) END) AS te
       FROM pj GROUP BY race_abbrev)
SELECT a.category AS original_race, b.category AS new_race, round(b.tr - a.tr, 9) + 0.0 AS train_delta,
       round(b.te - a.te, 9) + 0.0 AS test_delta FROM pr a CROSS JOIN pr b""")
def q_c17(spark, d):
    from .q_splits import labelled_stays
    from ..operators.aggregates import prevalence
    lab = labelled_stays(spark, d)
    sp = stratified_split(lab, ["gender"], "thirty_day_readmission", 0.5, "hadm_id", 42)
    p = prevalence(sp, "thirty_day_readmission", "split", {"race": F.col("race_abbrev")})
    p = p.select("category", "train_prevalence", "test_prevalence")
    # All ordered pairs of categories; both sides are per-category
    # aggregates (one row per race), so the product is races^2 rows.
    a = p.select(F.col("category").alias("original_race"), F.col("train_prevalence").alias("a_tr"),
                 F.col("test_prevalence").alias("a_te"))
    b = p.select(F.col("category").alias("new_race"), F.col("train_prevalence").alias("b_tr"),
                 F.col("test_prevalence").alias("b_te"))
    x = a.crossJoin(b)
    return x.select("original_race", "new_race", (F.round(F.col("b_tr") - F.col("a_tr"), 9) + F.lit(0.0)).alias("train_delta"),
                    (F.round(F.col("b_te") - F.col("a_te"), 9) + F.lit(0.0)).alias("test_delta"))


# ---------------------------------------------------------------- surrogate quality

@register("c18_surrogate_quality", POOL_WITH + SQL_SURR + """,
dq AS (SELECT race, gender, count(DISTINCT name) AS n_names, count(DISTINCT address) AS n_addresses
       FROM generated GROUP BY race, gender),
reg AS (SELECT n_name AS race, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey),
wide AS (SELECT reg.grp, avg(CASE WHEN gender = 'F' THEN n_names END) AS names_F,
                avg(CASE WHEN gender = 'M' THEN n_names END) AS names_M,
                avg(CASE WHEN gender = 'F' THEN n_addresses END) AS addresses_F,
                avg(CASE WHEN gender = 'M' THEN n_addresses END) AS addresses_M
         FROM dq JOIN reg ON dq.race = reg.race GROUP BY reg.grp)
SELECT grp, measure, round(value, 9) AS value FROM wide
UNPIVOT (value FOR measure IN (names_F, names_M, addresses_F, addresses_M))""")
def q_c18(spark, d):
    gen = C.assign_surrogates(C.build_cohort(spark, d), C.surrogate_pool(spark, d))
    dq = gen.groupBy("race", "gender").agg(F.count_distinct("name").alias("n_names"),
                                           F.count_distinct("address").alias("n_addresses"))
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    reg = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("race"), F.col("r_name").alias("grp"))
    j = dq.join(reg, "race")
    wide = j.groupBy("grp").agg(
        *[F.avg(F.when(F.col("gender") == g, F.col(c))).alias(f"{lbl}_{g}")
          for c, lbl in (("n_names", "names"), ("n_addresses", "addresses")) for g in ("F", "M")])
    long = unpivot(wide, ["grp"], ["names_F", "names_M", "addresses_F", "addresses_M"], "measure", "value")
    return long.filter(F.col("value").isNotNull()).select("grp", "measure", F.round("value", 9).alias("value"))


# ---------------------------------------------------------------- split-size curve

SIZES = [round(0.05 * k, 2) for k in range(1, 20)]


@register("c20_split_curve", TN_WITH + f""",
ts AS (SELECT unnest(CAST({SIZES} AS DOUBLE[])) AS test_size),
sz AS (SELECT d.hadm_id, d.abbrev AS grp, d.thirty_day_readmission AS y, d.actual_age, t.test_size,
              {sql_uniform("d.hadm_id", "'42'")} AS u
       FROM demographics d CROSS JOIN ts t),
c AS (SELECT test_size, grp, y, count(*) AS nc FROM sz GROUP BY test_size, grp, y),
q1 AS (SELECT *, sum(nc) OVER (PARTITION BY test_size, grp) AS n FROM c),
q2 AS (SELECT *, n - ceil(test_size * n) AS ntrain FROM q1),
q3 AS (SELECT *, floor(ntrain * nc / n) AS fl, ntrain * nc / n - floor(ntrain * nc / n) AS rem FROM q2),
q4 AS (SELECT *, ntrain - sum(fl) OVER (PARTITION BY test_size, grp) AS lft,
              row_number() OVER (PARTITION BY test_size, grp ORDER BY rem DESC, y) AS rk FROM q3),
quota AS (SELECT test_size, grp, y, fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM q4),
sp AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.test_size, s.grp, s.y ORDER BY s.u, s.hadm_id)
                          <= q.quota THEN 'train' ELSE 'test' END AS split
       FROM sz s JOIN quota q ON s.test_size = q.test_size AND s.grp = q.grp AND s.y = q.y),
tst AS (SELECT test_size, CAST(y AS INTEGER) AS y, actual_age / 100.0 AS p FROM sp WHERE split = 'test'),
""" + sql_auroc("tst", "test_size").strip() + f"""
SELECT 'auroc_eval/data/test_' || lpad(CAST(CAST(round(test_size * 100) AS INTEGER) AS VARCHAR), 2, '0') || '/test.csv'
         AS path,
       CAST(regexp_extract('auroc_eval/data/test_' || lpad(CAST(CAST(round(test_size * 100) AS INTEGER) AS VARCHAR), 2, '0')
         || '/test.csv', 'test_?(\\d+)', 1) AS DOUBLE) / 100.0 AS test_size, round(auroc, {R}) AS auroc
FROM au""")
def q_c20(spark, d):
    demo = C.demographics(spark, d).select("hadm_id", "abbrev", "thirty_day_readmission", "actual_age")
    sp = stratified_splits(demo, ["abbrev"], "thirty_day_readmission", SIZES, "hadm_id", 42)
    tst = sp.filter(F.col("split") == "test").select("test_size", F.col("thirty_day_readmission").cast("int").alias("y"),
                                                    (F.col("actual_age") / 100.0).alias("p"))
    # staged: the rank metric reads its rows three times
    counts = materialize(tst.groupBy("test_size", "y", "p").agg(F.count(F.lit(1)).alias("n")))
    au = M.auroc(counts, "y", "p", w="n", by=["test_size"])
    path = F.concat(F.lit("auroc_eval/data/test_"), F.lpad(F.round(F.col("test_size") * 100).cast("int").cast("string"),
                                                           2, "0"), F.lit("/test.csv"))
    return au.select(path.alias("path"), test_size_of(path).alias("test_size"), F.round("auroc", R).alias("auroc"))


# ---------------------------------------------------------------- generic report operators on base tables

@register("a2_group_mean", """
SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean_price FROM lineitem GROUP BY l_returnflag""")
def q_a2(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 6).alias("mean_price"))


@register("a4_distinct_count", """
SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_segments, count(*) AS n_customers FROM customer GROUP BY c_nationkey""")
def q_a4(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("n_segments"),
                                        F.count(F.lit(1)).alias("n_customers"))


@register("a5_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_a5(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@register("a14_explode_per_class", """
SELECT vec_id, CAST(c AS INTEGER) AS class_index, round(CAST(v AS DOUBLE), 6) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS c FROM embeddings)""")
def q_a14(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("probs"))
    x = explode_per_class(e, ["vec_id"], "probs")
    return x.select("vec_id", "class_index", F.round(F.col("value").cast("double"), 6).alias("value"))


@register("w6_group_stats", """
SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS l_quantity_group_mean,
       count(DISTINCT l_quantity) OVER (PARTITION BY l_orderkey) AS l_quantity_group_distinct FROM lineitem""")
def q_w6(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    r = with_group_stats(li, ["l_orderkey"], "l_quantity")
    return r.select("l_orderkey", "l_linenumber", F.round("l_quantity_group_mean", 6).alias("l_quantity_group_mean"),
                    "l_quantity_group_distinct")


@register("j4_natural_join", """
SELECT doc_id, l.quality, l.toxic, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id)""")
def q_j4(spark, d):
    lab = table(spark, d, "labels")
    doc = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    common = [c for c in lab.columns if c in doc.columns]  # the shared columns, made explicit
    return lab.join(doc, common).select("doc_id", "quality", "toxic", "lang", "n_chars")


@register("j12_label_names", """
WITH m AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT lang FROM documents)),
c AS (SELECT CAST(label AS INTEGER) % (SELECT count(*) FROM m) AS idx, count(*) AS n FROM embeddings GROUP BY 1)
SELECT c.idx AS class_index, m.lang AS class_name, c.n FROM c JOIN m ON c.idx = m.idx""")
def q_j12(spark, d):
    from ..functions.vectors import encode_label
    m = encode_label(table(spark, d, "documents").select("lang").distinct(), "lang", "idx")
    k = m.count()  # size of the label map (a small dimension)
    e = table(spark, d, "embeddings").groupBy((F.col("label") % k).cast("int").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(m), "idx").select(F.col("idx").alias("class_index"), F.col("lang").alias("class_name"), "n")


def few_shot_splits(spark, d) -> DataFrame:
    """A few-shot split table from ``labels``: task per label column, train
    rows by fold (5) with shot sizes 8/16, validation and test rows; the
    serialization index points into ``documents``."""
    lab = table(spark, d, "labels")
    long = lab.select("doc_id", F.explode(F.array(
        F.struct(F.lit("quality").alias("task"), F.col("quality").alias("label_value")),
        F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("label_value")))).alias("t")) \
        .select("doc_id", "t.task", "t.label_value")
    u = uniform(F.col("doc_id"), 7)
    split_name = F.when(u < 0.5, "train").when(u < 0.7, "val").otherwise("test")
    fold = F.pmod(F.col("doc_id"), F.lit(5)).cast("int")
    return long.select("task", split_name.alias("split_name"), fold.alias("fold"),
                     F.when(F.pmod(F.col("doc_id"), F.lit(3)) == 0, 8).otherwise(16).alias("shot_size"),
                     F.col("doc_id").alias("patient_id"), F.col("label_value").cast("string").alias("label_value"),
                     F.col("doc_id").alias("serialization_idx"))


_U7 = sql_uniform("doc_id", "'7'")
FEW_SHOT_WITH = f"""
WITH long AS (SELECT doc_id, 'quality' AS task, quality AS label_value, {_U7} AS u FROM labels
              UNION ALL SELECT doc_id, 'toxic', toxic, {_U7} FROM labels),
fs AS (SELECT task, CASE WHEN u < 0.5 THEN 'train' WHEN u < 0.7 THEN 'val' ELSE 'test' END AS split_name,
              CAST(doc_id % 5 AS INTEGER) AS fold, CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 16 END AS shot_size,
              doc_id AS patient_id, CAST(label_value AS VARCHAR) AS label_value, doc_id AS serialization_idx
       FROM long)"""


@register("p10_select_task", FEW_SHOT_WITH + """
SELECT * FROM fs WHERE task = 'quality'
  AND (split_name IN ('val', 'test') OR (split_name = 'train' AND shot_size = 8 AND fold = 0))""")
def q_p10(spark, d):
    return select_task(few_shot_splits(spark, d), "quality", 8, 0)


@register("j13_attach_text", FEW_SHOT_WITH + """
SELECT fs.task, fs.split_name, fs.patient_id, CAST(length(d.text) AS INTEGER) AS n_chars
FROM fs JOIN documents d ON fs.serialization_idx = d.doc_id
WHERE task = 'toxic' AND (split_name IN ('val', 'test') OR (split_name = 'train' AND fold = 1))""")
def q_j13(spark, d):
    fs = select_task(few_shot_splits(spark, d), "toxic", -1, 1)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("serialization_idx"), "text")
    return fs.join(docs, "serialization_idx").select("task", "split_name", "patient_id", F.length("text").alias("n_chars"))


@register("f7_string_predicates", """
SELECT p_partkey, starts_with(p_name, 'a') AS starts_a, ends_with(p_type, 'STEEL') AS ends_steel,
       contains(p_type, 'BRASS') AS has_brass, regexp_matches(p_brand, '^Brand#1') AS brand1 FROM part""")
def q_f7(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").startswith("a").alias("starts_a"),
                    F.col("p_type").endswith("STEEL").alias("ends_steel"),
                    F.col("p_type").contains("BRASS").alias("has_brass"),
                    F.col("p_brand").rlike("^Brand#1").alias("brand1"))


@register("f8_conditional_mapping", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderpriority LIKE '2%' THEN 'high'
                        ELSE 'normal' END AS priority_class FROM orders""")
def q_f8(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "urgent")
                    .when(F.col("o_orderpriority").startswith("2"), "high").otherwise("normal").alias("priority_class"))


@register("o1_sort_top", """
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def q_o1(spark, d):
    o = table(spark, d, "orders")
    return o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select(
        "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@register("o2_sequence_column", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS note_seq FROM documents")
def q_o2(spark, d):
    from ..operators.ranking import ordered_position
    doc = table(spark, d, "documents").select("doc_id")
    return ordered_position(doc, [], [F.col("doc_id")], key=F.col("doc_id"), out="note_seq")


@register("o3_first_per_group", """
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def q_o3(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("o_custkey", "o_orderkey")


@register("o4_display_order", """
SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
       WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS display_rank, count(*) AS n
FROM orders GROUP BY o_orderpriority""")
def q_o4(spark, d):
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    m = F.create_map(*[x for i, v in enumerate(order, 1) for x in (F.lit(v), F.lit(i))])
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return o.select("o_orderpriority", F.element_at(m, F.col("o_orderpriority")).alias("display_rank"), "n")


@register("u1_union_by_name", """
SELECT 'F' AS grp, o_orderkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'O', o_orderkey FROM orders WHERE o_orderstatus = 'O'""")
def q_u1(spark, d):
    o = table(spark, d, "orders")
    parts = [o.filter(F.col("o_orderstatus") == g).select(F.lit(g).alias("grp"), "o_orderkey") for g in ("F", "O")]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- explicit small queries for ids used inside others

@register("f1_select_rename_drop", """
SELECT c_custkey AS subject_id, c_nationkey AS nation, c_acctbal FROM customer""")
def q_f1(spark, d):
    c = table(spark, d, "customer")
    return c.withColumnRenamed("c_custkey", "subject_id").withColumnRenamed("c_nationkey", "nation") \
        .drop("c_name", "c_mktsegment")


@register("f2_filters", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000
AND o_orderpriority IS NOT NULL""")
def q_f2(spark, d):
    o = table(spark, d, "orders")
    return o.filter((F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(1000, 50000)
                    & F.col("o_orderpriority").isNotNull()).select("o_orderkey")


@register("j6_cross_join", """
WITH seg AS (SELECT DISTINCT c_mktsegment AS s FROM customer)
SELECT a.s AS original, b.s AS new FROM seg a CROSS JOIN seg b""")
def q_j6(spark, d):
    """All ordered pairs of a small dimension (distinct values on both
    sides; the product is the square of the dimension, not of the data)."""
    seg = table(spark, d, "customer").select(F.col("c_mktsegment").alias("s")).distinct()
    return seg.select(F.col("s").alias("original")).crossJoin(seg.select(F.col("s").alias("new")))


@register("j7_lookup_join", POOL_WITH + """
SELECT r.hadm_id, d.name, d.address FROM readm r JOIN demographics d ON r.hadm_id = d.hadm_id""")
def q_j7(spark, d):
    """Per-note lookups of demographics by key as one equi-join (the
    study scans the table once per note and attribute)."""
    from .q_events import readmission_labels
    return readmission_labels(spark, d).select("hadm_id").join(
        C.demographics(spark, d).select("hadm_id", "name", "address"), "hadm_id")


@register("a15_coarsen", LAB_WITH + f""",
reg AS (SELECT {sql_race_code('n_name')} AS code, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT reg.grp, round(avg(CAST(thirty_day_readmission AS INTEGER)), 9) AS prevalence, count(*) AS n
FROM lab JOIN reg ON lab.race_abbrev = reg.code GROUP BY reg.grp""")
def q_a15(spark, d):
    from .q_splits import labelled_stays
    lab = labelled_stays(spark, d)
    c = coarsen(lab, "race_abbrev", region_map(spark, d), map_code="code", map_group="group")
    return c.groupBy(F.col("race_abbrev_group").alias("grp")).agg(
        F.round(F.avg(F.col("thirty_day_readmission").cast("int")), 9).alias("prevalence"),
        F.count(F.lit(1)).alias("n"))


@register("t16_test_size_of_path", """
SELECT DISTINCT 'auroc_eval/data/test_' || lpad(CAST(CAST(o_orderkey % 19 * 5 + 5 AS INTEGER) AS VARCHAR), 2, '0')
       || '/test.csv' AS path,
       (o_orderkey % 19 * 5 + 5) / 100.0 AS test_size FROM orders""")
def q_t16(spark, d):
    o = table(spark, d, "orders")
    pct = (F.col("o_orderkey") % 19 * 5 + 5).cast("int")
    path = F.concat(F.lit("auroc_eval/data/test_"), F.lpad(pct.cast("string"), 2, "0"), F.lit("/test.csv"))
    return o.select(path.alias("path")).distinct().select("path", test_size_of("path").alias("test_size"))


@register("p3_hash_order", f"""
SELECT doc_id, row_number() OVER (ORDER BY {sql_uniform('doc_id', "'3'")}, doc_id) AS pos FROM documents""")
def q_p3(spark, d):
    from ..operators.sampling import hash_order_position
    return hash_order_position(table(spark, d, "documents").select("doc_id"), [], "doc_id", seed=3, out="pos")
