"""Variants are joined from pieces of the template (C9-C13), tails are ranked by k rows a task."""

from pyspark.sql import functions as F

from cohortlens.operators.pairing import tail_pairs
from cohortlens.plans import q_pairs as Q
from cohortlens.plans import variants as V


def test_pieces_fill_like_replace(spark):
    texts = ["a <name>x</name> b <age>1</age><name>y</name>", "<age>1</age>", "no tag", "é <name>___</name>", None]
    d = spark.createDataFrame([(i, t, v) for i, t in enumerate(texts) for v in ["Ann $1 \\ é", "", None]],
                              "i int, text string, v string")
    tmpl, _ = V.slot_template(F.col("text"))
    values, tags = {"name": F.col("v"), "age": F.lit(7)}, ["name", "age"]
    d = d.withColumn("tmpl", tmpl).withColumn("pieces", V.slot_pieces(F.col("tmpl"), tags))
    d = d.withColumn("chars", V.pieces_chars(F.col("pieces"), tags))
    text, n = V.fill_pieces(F.col("pieces"), F.col("chars"), values, tags)
    for r in d.select(text.alias("t"), n.alias("n"), V.render_template(F.col("tmpl"), values).alias("e")).collect():
        assert r.t == r.e
        assert r.n == (None if r.e is None else len(r.e))


def test_tail_pairs_move_k_rows_a_task(spark):
    d = spark.range(200).select(F.col("id").alias("hadm_id"), (F.col("id") % 3).alias("g"),
                                F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("age"))
    p = tail_pairs(d, ["g"], "age", "hadm_id", 5)
    assert p._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
    got = {(r.g, r["rank"], r.hadm_id_y, r.hadm_id_o) for r in p.collect()}
    want = set()
    for g in range(3):
        ids = sorted((x for x in range(200) if x % 3 == g), key=lambda x: (-1 if x % 10 == 0 else x % 7, x))
        want |= {(g, i + 1, ids[i], ids[len(ids) - 5 + i]) for i in range(5)}
    assert got == want


def test_tail_pairs_of_a_small_group(spark):
    d = spark.createDataFrame([(1, 0, 30), (2, 0, 20), (3, 0, 25)], "hadm_id long, g long, age long")
    assert tail_pairs(d, ["g"], "age", "hadm_id", 12).count() == 0
    p = tail_pairs(d, ["g"], "age", "hadm_id", 2).orderBy("rank").collect()
    assert [(r["rank"], r.hadm_id_y, r.hadm_id_o) for r in p] == [(1, 2, 3), (2, 3, 1)]


def test_age_shift_stages_no_rows_of_its_own(spark):
    """One join chain from the staged demographics: the rows are not staged between the joins by stay id."""
    rows, _ = Q.test_rows(spark, "/root/testdata/sf0.001", staged=False)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") >= 2
