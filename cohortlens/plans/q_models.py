"""Model family: M1-M7, M14, M16, M17, C21, N6, S13, S14 (embeddings table;
labelled stays for the one-hot model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..operators import gram as G
from ..operators import metrics as M
from ..operators import models as ML
from ..operators.sampling import stratified_folds, stratified_split, three_way_split
from ..sources.files import staging_dir
from ..sources.tables import read_embeddings, table
from .catalog import register
from .embed import chunk_embeddings, embed, embedding_metadata, write_embeddings

R = 6


def emb_split(spark, d) -> DataFrame:
    e = read_embeddings(table(spark, d, "embeddings"), "embedding", 64)
    e = ML.with_features(e).withColumn("y", (F.col("label") >= 5).cast("int"))
    return stratified_split(e, [], "y", 0.3, "vec_id", 42)


@register("m1_max_abs", """
SELECT CAST(i - 1 AS INTEGER) AS position, round(max(abs(CAST(embedding[i] AS DOUBLE))), 6) AS max_abs
FROM embeddings, range(1, 65) t(i) GROUP BY i""")
def q_m1(spark, d):
    m = ML.column_max_abs(table(spark, d, "embeddings"))
    return m.select(F.col("position").cast("int"), F.round("max_abs", 6).alias("max_abs"))


@register("m2_logistic")
def q_m2(spark, d):
    sp = emb_split(spark, d)
    model = ML.logistic(sp.filter("split = 'train'"), "y", C=1.0)
    s = ML.score(model, sp.filter("split = 'test'"))
    return s.select("vec_id", "y", F.round("p", R).alias("p"))


@register("m3_multinomial")
def q_m3(spark, d):
    sp = emb_split(spark, d)
    model = ML.logistic(sp.filter("split = 'train'"), "label", C=1.0, family="multinomial")
    s = ML.score(model, sp.filter("split = 'test'"))
    per, macro = M.auroc_ovr(s, "label", "probs", "vec_id")
    return per.select("class_index", F.round("auroc", R).alias("auroc"), F.round("auprc", R).alias("auprc"))


@register("m4_ridge")
def q_m4(spark, d):
    sp = emb_split(spark, d).withColumn("target", F.col("label").cast("double"))
    model = ML.ridge(sp.filter("split = 'train'"), "target", alpha=1.0)
    s = model.transform(sp.filter("split = 'test'"))
    return M.r2(s, "target", "prediction").select(F.round("r2", R).alias("r2"))


@register("m16_pred_vs_true")
def q_m16(spark, d):
    sp = emb_split(spark, d).withColumn("target", F.col("label").cast("double"))
    model = ML.ridge(sp.filter("split = 'train'"), "target", alpha=1.0)
    s = model.transform(sp)
    return s.select("vec_id", "split", F.col("target").alias("y_true"), F.round("prediction", R).alias("y_pred"))


@register("m5_tree_heads")
def q_m5(spark, d):
    sp = emb_split(spark, d)
    train, test = sp.filter("split = 'train'"), sp.filter("split = 'test'")
    out = None
    for kind in ("rf", "gbt"):
        s = ML.score(ML.tree_head(train, "y", kind), test)
        a = M.auroc(s, "y", "p").select(F.lit(kind).alias("head"), F.round("auroc", R).alias("auroc"))
        out = a if out is None else out.unionByName(a)
    return out


@register("m6_tune_validation")
def q_m6(spark, d):
    e = ML.with_features(read_embeddings(table(spark, d, "embeddings"), "embedding", 64)) \
        .withColumn("y", (F.col("label") >= 5).cast("int"))
    sp = three_way_split(e, [], "y", 0.2, 0.2, "vec_id", 42)
    res = ML.tune(sp.filter("split = 'train'"), sp.filter("split = 'val'"), "y")
    rows = [(g["C"], str(g["class_weight"]), float(s) if s is not None else None) for g, s in res["scores"]]
    df = spark.createDataFrame(rows, "C double, class_weight string, val_auroc double")
    return df.withColumn("best", (F.col("C") == res["best"]["C"]) &
                         (F.col("class_weight") == str(res["best"]["class_weight"])))


@register("m7_tune_cv")
def q_m7(spark, d):
    sp = emb_split(spark, d)
    train = stratified_folds(sp.filter("split = 'train'"), "y", 5, "vec_id", seed=0)
    res = ML.tune_cv(train, "y")
    rows = [(r["C"], str(r["class_weight"]), r["mean"], r["std"], len(r["folds"])) for r in res["cv"]]
    return spark.createDataFrame(rows, "C double, class_weight string, cv_mean double, cv_std double, n_folds int")


@register("m7_ridge_folds")
def q_m7r(spark, d):
    """Ridge by folds on the embeddings: every penalty's fold scores, mean and
    std, and the fit on all training rows scored on the test rows."""
    e = read_embeddings(table(spark, d, "embeddings"), "embedding", 64).withColumn("target", F.col("label").cast("double"))
    sp = stratified_split(e, [], "label", 0.3, "vec_id", 42)
    train = stratified_folds(sp.filter("split = 'train'"), "label", 5, "vec_id", seed=0)
    scores, model = G.ridge_folds(train, "target")
    test = sp.filter("split = 'test'").select("target", model.predict("embedding").alias("f"))
    refit = M.r2(test, "target", "f", out="test_r2").withColumn("alpha", F.lit(model.alpha))
    return G.cv_summary(scores).join(refit, "alpha", "left").select(
        "alpha", F.transform("folds", lambda x: F.round(x, R)).alias("folds"), F.round("mean", R).alias("cv_mean"),
        F.round("std", R).alias("cv_std"), "n_folds", F.round("test_r2", R).alias("test_r2"))


@register("c20_fitted_split_curve")
def q_c20f(spark, d):
    """AUROC of a fitted model by training share: 19 nested training sets."""
    e = read_embeddings(table(spark, d, "embeddings"), "embedding", 64).withColumn("y", (F.col("label") >= 5).cast("int"))
    sizes = [round(0.05 * k, 2) for k in range(1, 20)]
    return G.nested_curve(e, "y", uniform(F.col("vec_id"), 42), sizes).withColumn("auroc", F.round("auroc", R))


@register("m14_save_load_score")
def q_m14(spark, d):
    sp = emb_split(spark, d)
    model = ML.logistic(sp.filter("split = 'train'"), "y", C=10.0, class_weight="balanced")
    path = staging_dir(spark, "lr_model")
    ML.save_model(model, path)
    s = ML.score(ML.load_model(path), sp.filter("split = 'test'"))
    au = M.auroc(s, "y", "p", by=["split"])
    mp = s.groupBy("split").agg(F.round(F.avg("p"), R).alias("mean_proba"), F.count(F.lit(1)).alias("n"))
    return au.join(mp, "split").select("split", F.round("auroc", R).alias("auroc"), "mean_proba", "n")


@register("m17_permutation_importance")
def q_m17(spark, d):
    from .q_splits import labelled_stays
    lab = labelled_stays(spark, d).withColumn("age_band", (F.floor(F.col("actual_age") / 10) * 10).cast("string"))
    lab = lab.withColumn("y", F.col("thirty_day_readmission").cast("int"))
    sp = stratified_split(lab, [], "y", 0.3, "hadm_id", 42)
    cols = ["gender", "race_abbrev", "age_band"]
    # one-hot over the values seen in training (a small dimension per column)
    vals = {c: sorted(r[0] for r in sp.filter("split = 'train'").select(c).distinct().collect()) for c in cols}

    def assemble(df):
        arr = F.array(*[(F.col(c) == F.lit(v)).cast("double") for c in cols for v in vals[c]])
        return df.withColumn("features", ML.array_to_vector(arr))
    model = ML.logistic(assemble(sp.filter("split = 'train'")), "y", C=1.0)
    imp = ML.permutation_importance(model, sp.filter("split = 'train'"), cols, "y", "hadm_id", assemble, repeats=100)
    return imp.select("column", F.round("importance_mean", R).alias("importance_mean"),
                      F.round("importance_std", R).alias("importance_std"))


@register("c21_embed")
def q_c21(spark, d):
    docs = table(spark, d, "documents")
    e = embed(docs, "text", ["doc_id"], dim=64)
    return e.select("doc_id", F.size("embedding").alias("dim"),
                    F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


@register("s13_write_embeddings", """
SELECT count(*) AS rows_read, CAST(64 AS INTEGER) AS min_dim, count(*) AS num_rows, CAST(64 AS BIGINT) AS embedding_dim
FROM documents""")
def q_s13(spark, d):
    base = staging_dir(spark, "embeddings")
    e = embed(table(spark, d, "documents"), "text", ["doc_id"], dim=64)
    info = write_embeddings(e, base, 64, mode="errorifexists")
    meta = embedding_metadata(spark, {"csv_path": d, "text_column": "text", "encoder_class": "hashed",
                                      "embedding_path": base, "num_rows": info["rows"], "embedding_dim": 64})
    meta.write.json(base + "_metadata")
    back = spark.read.parquet(base).groupBy().agg(F.count(F.lit(1)).alias("rows_read"),
                                                  F.min(F.size("embedding")).alias("min_dim"))
    m = spark.read.json(base + "_metadata").select("embedding_path", "num_rows", "embedding_dim")
    return back.withColumn("embedding_path", F.lit(base)).join(m, "embedding_path").drop("embedding_path")


@register("n6_chunk_text", """
SELECT doc_id, len(t) AS n_tokens, CAST(ceil(len(t) / 512.0) AS INTEGER) AS n_chunks
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents)""")
def q_n6(spark, d):
    from ..functions.vectors import chunk_tokens
    docs = table(spark, d, "documents")
    ch = chunk_tokens("text", 512, 1 << 30)
    return docs.select("doc_id", F.aggregate(F.transform(ch, lambda c: F.size(c)), F.lit(0), lambda a, x: a + x)
                       .alias("n_tokens"), F.size(ch).alias("n_chunks"))


@register("n6_mean_by_chunk")
def q_n6m(spark, d):
    docs = table(spark, d, "documents")
    m = chunk_embeddings(docs, "text", "doc_id", size=512, dim=64)
    return m.select("doc_id", F.size("embedding").alias("dim"))
