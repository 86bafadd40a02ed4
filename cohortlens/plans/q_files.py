"""Files family: S1-S16, F11, F12 and the streaming query. Each query writes
what it reads back into a fresh staging folder below the checkpoint folder
(from the test tables), so the readers are exercised on real files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators import metrics as M
from ..operators.filters import checked_join, exclude_values, map_conflicts
from ..operators.sampling import random_parts, stratified_split
from ..sources import adapters as ad
from ..sources.files import (metrics_long, read_label_maps, read_listed, read_metrics, read_notes, staging_dir,
                             write_many, write_variants)
from ..session import materialize
from ..sources.tables import head_rows, pick_label_column, read_embeddings, read_table, table
from ..streaming.textstream import stream_tag_personal
from . import cohort as C
from . import counterfactuals as CF
from . import reports as RP
from . import sqltext as S
from . import variants as V
from .catalog import register
from .q_cohort import POOL_WITH, SQL_SURR
from .q_events import READM_WITH, readmission_labels
from .q_freetext import sql_tag_personal
from .q_metrics import SCORES_SQL, scores, sql_ap, sql_auroc
from .q_pairs import _c13_sql, cte_body, test_rows
from .q_splits import LAB_WITH, labelled_stays
from .q_text import C7_BODY, TN_WITH, rowdigest, sql_rowdigest

ADM_SCHEMA = "hadm_id long, subject_id long, admittime timestamp, dischtime timestamp, race string"


@register("s1_read_csv", ad.sql_with("admissions") + "SELECT * FROM admissions")
def q_s1(spark, d):
    path = staging_dir(spark, "admissions_csv")
    ad.admissions(spark, d).write.option("header", True).option("compression", "gzip").csv(path)
    return read_table(spark, path, ADM_SCHEMA)


@register("s2_read_notes", TN_WITH + """
SELECT dm.abbrev, CAST(sum(length(n.text)) + count(*) AS BIGINT) AS n_chars, count(*) AS n_notes
FROM demographics dm JOIN notes n ON dm.hadm_id = n.hadm_id GROUP BY dm.abbrev""")
def q_s2(spark, d):
    """Notes written as compressed text files, one folder per subgroup; read
    back recursively (S3) with the key from the path. The keys are joined
    before the text, which goes from the documents' join to the files."""
    path = staging_dir(spark, "notes_txt")
    rows = materialize(V.note_rows(spark, d, C.demographics(spark, d).select("hadm_id", "abbrev")))
    notes = ad.with_text(rows, spark, d, V.fan_out_partitions(spark))
    # a file is read back as one row: each task writes its own, of so many notes at most
    notes.select("abbrev", "text").write.partitionBy("abbrev").option("compression", "gzip") \
        .option("maxRecordsPerFile", 10_000).text(path)
    rd = read_notes(spark, path, suffix=".txt.gz", glob="*.txt.gz")
    rd = rd.withColumn("abbrev", F.regexp_extract("file_path", "abbrev=([^/]+)/", 1))
    counts = notes.groupBy("abbrev").agg(F.count(F.lit(1)).alias("n_notes"))
    got = rd.groupBy("abbrev").agg(F.sum(F.length("text")).cast("long").alias("n_chars"))
    return got.join(counts, "abbrev")


@register("s4_multi_part_csv", POOL_WITH + SQL_SURR + "SELECT hadm_id, name, address FROM generated")
def q_s4(spark, d):
    """Generated names in 41 CSV part files (one per random part, W10),
    read back as one table from the list of part folders."""
    base = staging_dir(spark, "generated")
    gen = C.assign_surrogates(C.build_cohort(spark, d), C.surrogate_pool(spark, d))
    gen = random_parts(gen.select("hadm_id", "name", "address"), 41, "hadm_id")
    gen.write.partitionBy("part").option("header", True).csv(base)
    parts = [os.path.join(base, f"part={i}") for i in range(1, 42)]
    return read_table(spark, parts, "hadm_id long, name string, address string")


@register("s5_pruned_scan", """
SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity > 45""")
def q_s5(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_quantity") > 45)) \
        .select("l_orderkey", "l_extendedprice")


@register("s6_head_rows", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def q_s6(spark, d):
    return head_rows(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 100, ["o_orderdate", "o_orderkey"])


@register("s7_read_embeddings", "SELECT vec_id, len(embedding) AS dim FROM embeddings")
def q_s7(spark, d):
    e = read_embeddings(table(spark, d, "embeddings"), "embedding", 64)
    return e.select("vec_id", F.size("embedding").alias("dim"))


@register("s8_pick_label_column", "SELECT CAST(quality AS DOUBLE) AS label FROM labels")
def q_s8(spark, d):
    lab = table(spark, d, "labels").select("quality")
    col = pick_label_column(lab)
    return lab.select(F.col(col).cast("double").alias("label"))


METRIC_SQL = SCORES_SQL + "," + sql_auroc("scores", "variant") + "," + sql_ap("scores", "variant") + """,
br AS (SELECT variant, sum((p - y) * (p - y)) / count(*) AS brier FROM scores GROUP BY variant)
SELECT au.variant AS run, m.metric, 'test' AS split, round(m.value, 9) AS value
FROM au JOIN ap ON au.variant = ap.variant JOIN br ON au.variant = br.variant,
LATERAL (VALUES ('auroc', au.auroc), ('auprc', ap.auprc), ('brier', br.brier)) m(metric, value)"""


@register("s9_read_metrics", METRIC_SQL)
def q_s9(spark, d):
    """One nested metric file per run (S15 summary), read back from the
    folder (S9) and turned into a long table (C14)."""
    path = staging_dir(spark, "metrics")
    s = scores(spark, d)
    m = (M.auroc(s, "y", "p", by=["variant"]).join(M.average_precision(s, "y", "p", by=["variant"]), "variant")
         .join(M.brier(s, "y", "p", by=["variant"]), "variant"))
    nested = m.select("variant", F.struct(*[F.struct(F.col(k).alias("test")).alias(k)
                                            for k in ("auroc", "auprc", "brier")]).alias("metrics"))
    nested.write.partitionBy("variant").json(path)
    schema = StructType([StructField("metrics", StructType([StructField(k, StructType(
        [StructField("test", DoubleType())])) for k in ("auroc", "auprc", "brier")]))])
    back = read_metrics(spark, path, schema).withColumn("run", F.regexp_extract("run", "variant=([^/]+)/", 1))
    long = metrics_long(back, "run", ["auroc", "auprc", "brier"], ["test"])
    return long.select("run", "metric", "split", F.round("value", 9).alias("value"))


@register("s10_read_label_maps", LAB_WITH + """,
cls AS (SELECT DISTINCT s.split AS source, l.race_abbrev AS key FROM lab l JOIN splits s ON l.hadm_id = s.hadm_id)
SELECT source, key, CAST(row_number() OVER (PARTITION BY source ORDER BY key) - 1 AS INTEGER) AS value FROM cls""")
def q_s10(spark, d):
    """Label maps fitted separately on train and test (the study's race
    encoding), written as metadata sidecars and read back recursively."""
    from ..functions.vectors import encode_label
    base = staging_dir(spark, "label_maps")
    sp = stratified_split(labelled_stays(spark, d), ["gender"], "thirty_day_readmission", 0.5, "hadm_id", 42)
    for part in ("train", "test"):
        enc = encode_label(sp.filter(F.col("split") == part).select("race_abbrev").distinct(), "race_abbrev", "idx")
        meta = enc.agg(F.map_from_entries(F.collect_list(F.struct("race_abbrev", "idx"))).alias("label_map")) \
            .withColumn("split", F.lit(part))
        meta.coalesce(1).write.json(os.path.join(base, f"{part}_metadata"))
    maps = read_label_maps(spark, base, glob="*.json")
    return maps.select(F.regexp_extract("source", "/([a-z]+)_metadata/", 1).alias("source"), "key", "value")


@register("s11_write_variants", cte_body(_c13_sql()) + "\n" + S.digest("text", "variant") +
          " FROM sh WHERE variant = 'age_plus_10' GROUP BY variant")
def q_s11(spark, d):
    """Age-shift variants written once, partitioned by (variant, split);
    one variant read back with partition pruning."""
    path = staging_dir(spark, "variants")
    rows, text = test_rows(spark, d)
    v = CF.age_shift(rows, text=text).withColumn("split", F.lit("test"))
    write_variants(v, path)
    back = spark.read.parquet(path).filter(F.col("variant") == "age_plus_10")
    h = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")
    return back.groupBy("variant").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).cast("bigint")
                                       .alias("n_chars"), F.sum(h).cast("bigint").alias("md5_sum"))


@register("s12_write_modes", """
SELECT 'errorifexists' AS mode, 'refused' AS outcome
UNION ALL SELECT 'ignore', 'kept ' || count(*) || ' rows' FROM labels
UNION ALL SELECT 'overwrite', 'now ' || count(*) FILTER (quality = 1) || ' rows' FROM labels""")
def q_s12(spark, d):
    """Refuse to overwrite unless told: errorifexists fails on the second
    write, ignore keeps the first output, overwrite replaces it."""
    path = staging_dir(spark, "modes")
    lab = table(spark, d, "labels")
    outcomes = []
    lab.write.mode("errorifexists").parquet(path)
    try:
        lab.write.mode("errorifexists").parquet(path)
        outcomes.append(("errorifexists", "written"))
    except Exception:  # noqa: BLE001 - AnalysisException: path exists
        outcomes.append(("errorifexists", "refused"))
    lab.limit(0).write.mode("ignore").parquet(path)
    n_ignore = spark.read.parquet(path).count()
    outcomes.append(("ignore", f"kept {n_ignore} rows"))
    lab.filter(F.col("quality") == 1).write.mode("overwrite").parquet(path)
    outcomes.append(("overwrite", f"now {spark.read.parquet(path).count()} rows"))
    return spark.createDataFrame(outcomes, "mode string, outcome string")


def level_auroc(levels):
    """AUROC of every level by the score of its texts' lengths, which come with them. The levels are
    rendered once, for the staged counts of each (level, outcome, score)."""
    sc = levels.select("level", F.col("thirty_day_readmission").cast("int").alias("y"),
                       RP.text_scores(F.col("text"), F.col("n_chars"))["anon"].alias("p"))
    counts = materialize(sc.groupBy("level", "y", "p").agg(F.count(F.lit(1)).cast("double").alias("n")))
    return M.auroc(counts, "y", "p", w="n", by=["level"])


@register("s16_variant_runs", C7_BODY + """
SELECT level, round(auroc, 9) AS auroc FROM (
  WITH sc AS (SELECT level, CAST(thirty_day_readmission AS INTEGER) AS y, (length(text) % 100) / 100.0 AS p FROM lvl),
  """ + sql_auroc("sc", "level").strip() + """
  SELECT level, auroc FROM au)""")
def q_s16(spark, d):
    """All 64 levels scored and evaluated in one job keyed by the level
    (a ``variant`` column instead of a loop over data sets)."""
    notes, splits = V.cohort_notes(spark, d)
    return level_auroc(V.anonymisation_levels(notes)).select("level", F.round("auroc", 9).alias("auroc"))


@register("f11_checked_join", READM_WITH.replace("WITH ", "WITH ", 1) + """
SELECT count(*) AS n FROM readm r JOIN admissions a ON r.subject_id = a.subject_id AND r.hadm_id = a.hadm_id""")
def q_f11(spark, d):
    j = checked_join(readmission_labels(spark, d), ad.admissions(spark, d), ["subject_id", "hadm_id"],
                     validate="one_to_one")
    return j.agg(F.count(F.lit(1)).alias("n"))


@register("st1_stream_tag_personal", sql_rowdigest(sql_tag_personal("text"), "doc_id") + " FROM documents")
def q_st1(spark, d):
    """Structured Streaming over the documents file: tag personal data as
    files arrive (availableNow), parquet sink, read back."""
    base = staging_dir(spark, "stream")
    # a file or a folder of part files: a pattern, as a stream takes no plain file
    docs = os.path.join(d, "{documents}.parquet")
    out = stream_tag_personal(spark, docs, "*", os.path.join(base, "sink"), os.path.join(base, "ckpt"))
    return rowdigest(out, F.col("tagged"), "doc_id")


@register("s3_recursive_glob", """
SELECT lang, count(*) AS n_files FROM documents GROUP BY lang""")
def q_s3(spark, d):
    """S3: nested folders, a glob filter and an explicit file list: one text
    file per document in folders by language, read recursively."""
    base = staging_dir(spark, "docs_txt")
    # the lines of a document's rows in one file; an empty language has the folder of a missing one
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), "text")
    # a fixed count: the files are what takes time, not the bytes that adaptive execution merges by
    docs = docs.repartition(V.fan_out_partitions(spark), "lang", "doc_id")
    docs = docs.groupBy("lang", "doc_id").agg(F.concat_ws("\n", F.collect_list(F.coalesce("text", F.lit("")))).alias("text"))
    write_many(docs.select("lang", "text"), base, ["lang"], maxRecordsPerFile=1)
    rd = read_notes(spark, base, suffix=".txt", glob="part-*.txt")
    return rd.withColumn("lang", F.regexp_extract("file_path", "lang=([^/]+)/", 1)).groupBy("lang") \
        .agg(F.count(F.lit(1)).alias("n_files"))


@register("s3_file_manifest", """
SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS note_key, 'read' AS status, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest
FROM documents WHERE text IS NOT NULL
UNION ALL
SELECT 'item_' || CAST(item_id AS VARCHAR), 'missing', NULL, NULL FROM benchmark""")
def q_s3m(spark, d):
    """One note per file with its key; the list of wanted files also names
    some that are not there."""
    base = staging_dir(spark, "docs_by_key")
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("note_key"), "text")
    write_many(docs.repartition(V.fan_out_partitions(spark), "note_key"), base, ["note_key"])
    gone = table(spark, d, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("note_key"))
    got = read_listed(spark, base, docs.select("note_key").unionByName(gone), glob="part-*.txt", key_of=r"note_key=([^/]+)/")
    # the text sink ends a file with a line end
    return got.select("note_key", "status", (F.col("n_bytes") - 1).alias("n_bytes"),
                      F.md5(F.expr("left(text, length(text) - 1)")).alias("digest"))


@register("s14_label_map", """
SELECT n_name AS key, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS value FROM nation""")
def q_s14m(spark, d):
    """The label map in the sidecar, read back as rows."""
    from .embed import embedding_metadata
    names = sorted(r[0] for r in table(spark, d, "nation").select("n_name").distinct().collect())  # the classes of a label
    path = staging_dir(spark, "label_map")
    meta = embedding_metadata(spark, {"label_column": "race", "label_map": {n: i for i, n in enumerate(names)}})
    meta.write.json(os.path.join(path, "metadata.json"))
    return read_label_maps(spark, path, "*.json").select("key", "value")


@register("s14_embedding_metadata", "SELECT count(*) AS num_rows, 64 AS embedding_dim FROM documents")
def q_s14(spark, d):
    from .embed import embedding_metadata
    n = table(spark, d, "documents").count()  # the planned row count recorded in the sidecar
    meta = embedding_metadata(spark, {"csv_path": d, "text_column": "text", "num_rows": n, "embedding_dim": 64})
    path = staging_dir(spark, "meta")
    meta.write.json(path)
    return spark.read.json(path).select(F.col("num_rows").cast("long"), F.col("embedding_dim").cast("int"))


@register("s15_metric_summary_long", METRIC_SQL)
def q_s15(spark, d):
    """The per-run evaluation summary in long form (run, metric, split,
    value), without a file round trip."""
    s = scores(spark, d)
    m = (M.auroc(s, "y", "p", by=["variant"]).join(M.average_precision(s, "y", "p", by=["variant"]), "variant")
         .join(M.brier(s, "y", "p", by=["variant"]), "variant"))
    long = m.unpivot(["variant"], ["auroc", "auprc", "brier"], "metric", "value")
    return long.select(F.col("variant").alias("run"), "metric", F.lit("test").alias("split"),
                       F.round("value", 9).alias("value"))


@register("f12_map_conflicts", """
WITH t AS (SELECT DISTINCT 'all' AS source, p_type FROM part
           UNION SELECT DISTINCT 'kept', p_type FROM part WHERE p_type <> 'PROMO'),
m AS (SELECT source, p_type, row_number() OVER (PARTITION BY source ORDER BY p_type) - 1 AS v FROM t)
SELECT p_type AS key, count(DISTINCT v) AS n_values, count(DISTINCT source) AS n_sources
FROM m GROUP BY p_type HAVING count(DISTINCT v) > 1""")
def q_f12(spark, d):
    """label maps of the part types, fitted before and after the
    exclusion of one type (F3), written as sidecars, read back (S10) and
    compared: types whose index differs between the files."""
    from ..functions.vectors import encode_label
    base = staging_dir(spark, "type_maps")
    parts = table(spark, d, "part").select("p_type")
    for source, rows in (("all", parts), ("kept", exclude_values(parts, "p_type", ["PROMO"]))):
        enc = encode_label(rows.distinct(), "p_type", "idx")
        meta = enc.agg(F.map_from_entries(F.collect_list(F.struct("p_type", "idx"))).alias("label_map"))
        meta.coalesce(1).write.json(os.path.join(base, f"{source}_metadata"))
    return map_conflicts(read_label_maps(spark, base, glob="*.json"), "source", "key", "value")
