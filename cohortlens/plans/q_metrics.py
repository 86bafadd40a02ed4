"""Metrics family: M8-M13, M15, M18, N4, N5, A8, P11 on a ``scores`` view
(labels: quality / toxic with hashed scores; lineitem: returns scored by
discount and tax) and on ``embeddings``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sql_uniform, uniform_parts
from ..operators import metrics as M
from ..operators.bootstrap import bootstrap
from ..operators.drawvectors import POISSON_CDF, bootstrap_metrics
from ..sources.tables import table
from .catalog import register

R = 9  # digits kept in metric outputs (sums in another order differ in the last bits)


def scores(spark, d) -> DataFrame:
    lab = table(spark, d, "labels")

    def from_labels(name, col, salt):
        p = F.floor(F.lit(100.0) * (F.lit(0.7) * uniform_parts(F.col("doc_id"), F.lit(salt))
                                    + F.lit(0.3) * F.col(col))) / F.lit(100.0)
        return lab.select(F.lit(name).alias("variant"), F.col("doc_id").alias("id"),
                          F.col(col).cast("int").alias("y"), p.alias("p"))
    li = table(spark, d, "lineitem").select(
        F.lit("returns").alias("variant"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 5 + F.col("l_tax")).alias("p"))
    return from_labels("quality", "quality", "s").unionByName(from_labels("toxic", "toxic", "t")).unionByName(li)


SCORES_SQL = f"""WITH scores AS (
  SELECT 'quality' AS variant, doc_id AS id, CAST(quality AS INTEGER) AS y,
         floor(100.0 * (0.7 * {sql_uniform('doc_id', "'s'")} + 0.3 * quality)) / 100.0 AS p FROM labels
  UNION ALL
  SELECT 'toxic', doc_id, CAST(toxic AS INTEGER), floor(100.0 * (0.7 * {sql_uniform('doc_id', "'t'")} + 0.3 * toxic)) / 100.0
  FROM labels
  UNION ALL
  SELECT 'returns', l_orderkey * 8 + l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END,
         l_discount * 5 + l_tax FROM lineitem)"""


def sql_auroc(src: str, by: str, y: str = "y", p: str = "p", w: str = "1.0") -> str:
    """CTE text: AUROC per ``by`` of ``src``."""
    return f"""
au_s AS (SELECT {by}, {p} AS p, sum(CASE WHEN {y} > 0 THEN {w} ELSE 0 END) AS pos,
                sum(CASE WHEN {y} > 0 THEN 0 ELSE {w} END) AS neg FROM {src} GROUP BY {by}, {p}),
au_c AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY p ROWS UNBOUNDED PRECEDING) AS cneg FROM au_s),
au AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
              THEN sum(pos * (cneg - neg + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auroc
       FROM au_c GROUP BY {by})"""


def sql_ap(src: str, by: str, y: str = "y", p: str = "p") -> str:
    return f"""
ap_s AS (SELECT {by}, {p} AS p, sum(CASE WHEN {y} > 0 THEN 1.0 ELSE 0 END) AS pos, count(*) * 1.0 AS tot
         FROM {src} GROUP BY {by}, {p}),
ap_c AS (SELECT *, sum(pos) OVER w AS ctp, sum(tot) OVER w AS ctot FROM ap_s
         WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT {by}, CASE WHEN sum(pos) > 0 THEN sum(pos * ctp / ctot) / sum(pos) END AS auprc FROM ap_c GROUP BY {by})"""


@register("m9_auroc", SCORES_SQL + "," + sql_auroc("scores", "variant") +
          f"\nSELECT variant, round(auroc, {R}) AS auroc FROM au")
def q_m9(spark, d):
    return M.auroc(scores(spark, d), "y", "p", by=["variant"]).select("variant", F.round("auroc", R).alias("auroc"))


@register("m10_average_precision", SCORES_SQL + "," + sql_ap("scores", "variant") +
          f"\nSELECT variant, round(auprc, {R}) AS auprc FROM ap")
def q_m10(spark, d):
    return M.average_precision(scores(spark, d), "y", "p", by=["variant"]) \
        .select("variant", F.round("auprc", R).alias("auprc"))


@register("m11_brier", SCORES_SQL + f"""
SELECT variant, round(sum((p - y) * (p - y)) / count(*), {R}) AS brier FROM scores GROUP BY variant""")
def q_m11(spark, d):
    return M.brier(scores(spark, d), "y", "p", by=["variant"]).select("variant", F.round("brier", R).alias("brier"))


EMB_PROBS_SQL = """WITH ep AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS sc FROM embeddings),
en AS (SELECT vec_id, label, sc, list_reduce(sc, lambda a, b: a + b) AS tot FROM ep)"""


def emb_scores(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    sc = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return e.select("vec_id", "label", sc.alias("sc"))


@register("m11_brier_multiclass", EMB_PROBS_SQL + f""",
rows AS (SELECT vec_id, label, unnest(sc) / tot AS pr, unnest(generate_series(0, len(sc) - 1)) AS c FROM en)
SELECT round(avg(s), {R}) AS brier FROM (
  SELECT vec_id, sum((pr - CASE WHEN label = c THEN 1.0 ELSE 0.0 END) ^ 2) AS s FROM rows GROUP BY vec_id)""")
def q_m11m(spark, d):
    e = emb_scores(spark, d)
    tot = F.aggregate("sc", F.lit(0.0), lambda a, b: a + b)
    probs = e.select("label", F.transform("sc", lambda x: x / tot).alias("probs"))
    return M.brier_multiclass(probs, "label", "probs").select(F.round("brier", R).alias("brier"))


OVR_SQL = EMB_PROBS_SQL + """,
ov AS (SELECT vec_id, c AS class_index, s AS score, CASE WHEN label = c THEN 1 ELSE 0 END AS y_c FROM (
  SELECT vec_id, label, unnest(sc) AS s, unnest(generate_series(0, len(sc) - 1)) AS c FROM ep))"""


@register("m12_auroc_ovr", OVR_SQL + "," + sql_auroc("ov", "class_index", y="y_c", p="score") + "," +
          sql_ap("ov", "class_index", y="y_c", p="score") + f"""
SELECT au.class_index, round(auroc, {R}) AS auroc, round(auprc, {R}) AS auprc
FROM au JOIN ap ON au.class_index = ap.class_index""")
def q_m12(spark, d):
    per, _ = M.auroc_ovr(emb_scores(spark, d), "label", "sc", "vec_id")
    return per.select("class_index", F.round("auroc", R).alias("auroc"), F.round("auprc", R).alias("auprc"))


@register("m12_macro_ovr", OVR_SQL + "," + sql_auroc("ov", "class_index", y="y_c", p="score") + "," +
          sql_ap("ov", "class_index", y="y_c", p="score") + f"""
SELECT round(avg(auroc), {R}) AS macro_auroc, round(avg(auprc), {R}) AS macro_auprc
FROM au JOIN ap ON au.class_index = ap.class_index""")
def q_m12m(spark, d):
    _, macro = M.auroc_ovr(emb_scores(spark, d), "label", "sc", "vec_id")
    return macro.select(F.round("macro_auroc", R).alias("macro_auroc"), F.round("macro_auprc", R).alias("macro_auprc"))


@register("m13_r2", f"""
SELECT l_returnflag, round(1 - sum((y - f) * (y - f)) / (sum(y * y) - sum(y) * sum(y) / count(*)), {R}) AS r2
FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity * p_retailprice AS f
      FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_returnflag""")
def q_m13(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    li = li.select("l_returnflag", F.col("l_extendedprice").alias("y"),
                   (F.col("l_quantity") * F.col("p_retailprice")).alias("f"))
    return M.r2(li, "y", "f", by=["l_returnflag"]).select("l_returnflag", F.round("r2", R).alias("r2"))


@register("m15_mean_probability", SCORES_SQL + f"""
SELECT variant, round(avg(p), {R}) AS mean_proba, round(avg(y), {R}) AS prevalence FROM scores GROUP BY variant""")
def q_m15(spark, d):
    r = M.mean_probability(scores(spark, d), "y", "p", ["variant"])
    return r.select("variant", F.round("mean_proba", R).alias("mean_proba"), F.round("prevalence", R).alias("prevalence"))


@register("m18_threshold_rates", SCORES_SQL + f"""
SELECT variant, y, round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END), {R}) AS yes_rate, count(*) AS n
FROM scores GROUP BY variant, y""")
def q_m18(spark, d):
    r = M.threshold_rates(scores(spark, d), "y", "p", ["variant"])
    return r.select("variant", "y", F.round("yes_rate", R).alias("yes_rate"), "n")


@register("n4_two_way", f"""
SELECT vec_id, CAST(k AS INTEGER) AS pair,
       round(abs(CAST(embedding[2 * k + 1] AS DOUBLE)) / greatest(abs(CAST(embedding[2 * k + 1] AS DOUBLE))
             + abs(CAST(embedding[2 * k + 2] AS DOUBLE)), 1e-12), {R}) AS p_yes
FROM (SELECT vec_id, embedding, unnest(generate_series(0, len(embedding) // 2 - 1)) AS k FROM embeddings)""")
def q_n4(spark, d):
    e = table(spark, d, "embeddings").where(F.size("embedding") >= 2)
    k = F.explode(F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1)).alias("pair")
    at = lambda n: F.abs(F.get("embedding", F.col("pair") * 2 + n).cast("double"))
    return e.select("vec_id", "embedding", k).select("vec_id", "pair", F.round(M.two_way(at(0), at(1)), R).alias("p_yes"))


@register("n5_l2_normalize", """
SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS position,
       round(CAST(unnest(embedding) AS DOUBLE) / nrm, 6) AS value, round(nrm, 6) AS norm
FROM (SELECT *, sqrt(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)),
                                 lambda a, b: a + b)) AS nrm FROM embeddings)""")
def q_n5(spark, d):
    e = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda a, x: a + x))
    return e.select("vec_id", norm.alias("n"), F.posexplode(M.l2_normalize("embedding")).alias("position", "v")) \
        .select("vec_id", "position", F.round("v", 6).alias("value"), F.round("n", 6).alias("norm"))


@register("a8_mean_sum_absmean", SCORES_SQL + f"""
SELECT variant, round(avg(p), {R}) AS mean_p, round(sum(p), 6) AS sum_p, round(avg(abs(p - y)), {R}) AS abs_err
FROM scores GROUP BY variant""")
def q_a8(spark, d):
    s = scores(spark, d)
    return s.groupBy("variant").agg(F.round(F.avg("p"), R).alias("mean_p"), F.round(F.sum("p"), 6).alias("sum_p"),
                                    F.round(F.avg(F.abs(F.col("p") - F.col("y"))), R).alias("abs_err"))


def _boot_sql(variant: str, draws: int, seed: int, method: str) -> str:
    src = f"(SELECT * FROM scores WHERE variant = '{variant}')"
    if method == "exact":
        wts = f"""
units AS (SELECT id, row_number() OVER (ORDER BY id) AS j, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM {src})),
picks AS (SELECT d.range AS draw,
                 CAST(floor({sql_uniform('CAST(d.range AS BIGINT) * n + j - 1', f"'{seed}'")} * n) AS BIGINT) + 1 AS pj
          FROM units CROSS JOIN range({draws}) d),
cnt AS (SELECT draw, pj, count(*) AS w FROM picks GROUP BY draw, pj),
wts AS (SELECT c.draw, u.id, CAST(c.w AS DOUBLE) AS w FROM cnt c JOIN units u ON c.pj = u.j)"""
    else:
        cdf, term, acc = [], math.exp(-1.0), 0.0
        for k in range(13):
            acc += term
            cdf.append(acc)
            term /= (k + 1)
        u = sql_uniform("id || '|' || CAST(d.range AS VARCHAR)", f"'p{seed}'")
        case = "CASE " + " ".join(f"WHEN uu <= {repr(c)} THEN {k}" for k, c in enumerate(cdf)) + " ELSE 13 END"
        wts = f"""
pu AS (SELECT d.range AS draw, id, {u} AS uu FROM (SELECT DISTINCT id FROM {src}) CROSS JOIN range({draws}) d),
wts AS (SELECT draw, id, CAST({case} AS DOUBLE) AS w FROM pu)"""
    return SCORES_SQL + "," + wts + f""",
wd AS (SELECT s.y, s.p, w.draw, w.w FROM {src} s JOIN wts w ON s.id = w.id WHERE w.w > 0),
""" + sql_auroc("wd", "draw", w="w").strip() + "," + sql_auroc(src, "variant").replace("au_s", "pt_s").replace(
        "au_c", "pt_c").replace("au AS", "pt AS").replace("FROM au_c", "FROM pt_c").strip() + f"""
SELECT round((SELECT auroc FROM pt), {R}) AS score, round(stddev_samp(auroc), {R}) AS std,
       round(quantile_cont(auroc, 0.025), {R}) AS lower, round(avg(auroc), {R}) AS mean,
       round(quantile_cont(auroc, 0.975), {R}) AS upper, count(*) AS n_draws
FROM au WHERE auroc IS NOT NULL"""


def _boot_spark(spark, d, variant, draws, seed, method):
    s = scores(spark, d).filter(F.col("variant") == variant)
    r = bootstrap(s, "id", M.auroc, "auroc", draws=draws, seed=seed, method=method, y="y", p="p")
    return r.select(*[F.round(c, R).alias(c) for c in ["score", "std", "lower", "mean", "upper"]], "n_draws")


@register("m8_bootstrap_exact", _boot_sql("quality", 1000, 0, "exact"))
def q_m8(spark, d):
    return _boot_spark(spark, d, "quality", 1000, 0, "exact")


@register("p11_bootstrap_poisson", _boot_sql("toxic", 1000, 0, "poisson"))
def q_p11(spark, d):
    return _boot_spark(spark, d, "toxic", 1000, 0, "poisson")


def _vector_sql(draws: int, seed: int) -> str:
    cdf = [float(c) for c in POISSON_CDF]
    u = sql_uniform("id || '|' || CAST(d.range AS VARCHAR)", f"'p{seed}'")
    case = "CASE " + " ".join(f"WHEN uu <= {repr(c)} THEN {k}" for k, c in enumerate(cdf)) + " ELSE 13 END"
    return SCORES_SQL + f""",
pu AS (SELECT d.range AS draw, s.variant, s.y, s.p, {u} AS uu FROM scores s CROSS JOIN range({draws}) d),
wd AS (SELECT variant, draw, y, p, CAST({case} AS DOUBLE) AS w FROM pu
       UNION ALL SELECT variant, -1, y, p, 1.0 FROM scores),
""" + sql_auroc("wd", "variant, draw", w="w").strip() + f""",
li AS (SELECT variant, draw, sum(w) AS sw, sum(w * (y - p) * (y - p)) AS sse, sum(w * y) AS sy, sum(w * y * y) AS syy
       FROM wd GROUP BY variant, draw),
ms AS (SELECT variant, draw, 'auroc' AS metric, auroc AS v FROM au
       UNION ALL SELECT variant, draw, 'brier', CASE WHEN sw > 0 THEN sse / sw END FROM li
       UNION ALL SELECT variant, draw, 'r2', CASE WHEN sw > 0 AND syy - sy * sy / sw > 0
                                             THEN 1 - sse / (syy - sy * sy / sw) END FROM li)
SELECT variant, metric, round(max(v) FILTER (WHERE draw < 0), {R}) AS score,
       round(stddev_samp(v) FILTER (WHERE draw >= 0), {R}) AS std,
       round(quantile_cont(v, 0.025) FILTER (WHERE draw >= 0), {R}) AS lower,
       round(avg(v) FILTER (WHERE draw >= 0), {R}) AS mean,
       round(quantile_cont(v, 0.975) FILTER (WHERE draw >= 0), {R}) AS upper,
       count(v) FILTER (WHERE draw >= 0) AS n_draws
FROM ms GROUP BY variant, metric"""


@register("p11_bootstrap_draw_vectors", _vector_sql(100, 0))
def q_p11_vectors(spark, d):
    r = bootstrap_metrics(scores(spark, d), "id", "y", "p", draws=100, by=["variant"])
    return r.select("variant", "metric", *[F.round(c, R).alias(c) for c in ["score", "std", "lower", "mean", "upper"]],
                    "n_draws")
