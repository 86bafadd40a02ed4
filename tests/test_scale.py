"""What grows with the data: plans the driver keeps, bytes that cross a shuffle, work done twice."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import tags as T
from cohortlens.operators import metrics as M
from cohortlens.operators.bootstrap import bootstrap
from cohortlens.plans import counterfactuals as CF
from cohortlens.plans import q_files, q_pairs, q_text
from cohortlens.plans import reports as RP
from cohortlens.plans.q_pairs import test_notes as notes_of_test
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources.files import write_variants

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("method", ["exact", "poisson"])
def test_bootstrap_keeps_a_short_plan(spark, method):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), float(rng.integers(9)) / 8) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    r = bootstrap(df, "id", M.auroc, "auroc", draws=20, method=method, y="y", p="p")
    # the driver keeps the plan as text with every re-planning: no quantile lists in it
    assert len(r._jdf.queryExecution().toString()) < 200_000
    assert r.first()["n_draws"] == 20


def shuffled_inputs(df) -> list[str]:
    """Columns that enter the exchanges of a plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [line for part in re.split(r"\n\(\d+\) ", text) if part.startswith("Exchange") for line in part.splitlines()
            if line.startswith("Input")]


@pytest.mark.parametrize("query", [q_text.q_t1, q_text.q_t8, lambda s, d: CF.age_shift(notes_of_test(s, d))])
def test_note_text_crosses_no_shuffle(spark, query):
    inputs = shuffled_inputs(query(spark, SF))
    assert inputs and not [x for x in inputs if re.search(r"\btext#", x)]


def test_run_metrics_score_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(x):
        seen.add(1)
        return float(x % 3) / 2

    rows = spark.range(30).selectExpr("'f' family", "'v' variant", "'m' model", "id", "cast(id % 2 as int) y")
    rows = rows.withColumn("p", F.udf(score, "double")("id"))
    got = {r["metric"]: r["value"] for r in RP.run_metrics(rows).collect()}
    assert seen.value == 30
    assert got["mean_proba"] == 0.5 and got["auroc"] == 0.5


def test_clean_up_reads_past_the_last_label(spark):
    tails = ["", " year old", " years old woman", " y/o", "  yo", " YO and on", " year-ol", "\nyo"]
    heads = ["no label", "a <sex>F</sex> <name>Dr Lee</name> is <age>7</age>", "<PRONOUN_x>It</PRONOUN_x> <age>7</age>", "x <3"]
    df = spark.createDataFrame([(h + t + " and untagged", "F") for h in heads for t in tails], "text string, gender string")
    whole = T.drop_year_old(T.check_pronouns(T.check_names(T.apply_head_template("text", "gender"))))
    for r in df.select(whole.alias("a"), T.normalise_tags("text", "gender").alias("b")).collect():
        assert r["a"] == r["b"]


def staged(spark, name: str) -> list[Path]:
    found = sorted(Path(ensure_checkpoint_dir(spark), "staging").glob(f"{name}-*"), key=lambda p: p.stat().st_mtime)
    return [p for p in found[-1].rglob("part-*") if p.is_file()]


def documents(spark, path) -> list[tuple]:
    rows = [(1, "en", "mail a@b5.com"), (2, "en", None), (3, None, ""), (4, "de", "two\nlines"), (5, "de", "x"), (6, "de", "y")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2).write.parquet(str(path / "documents.parquet"))
    return rows


def test_stream_reads_a_table_of_part_files(spark, tmp_path):
    rows = documents(spark, tmp_path)
    got = {r["doc_id"]: r["n_chars"] for r in q_files.q_st1(spark, str(tmp_path)).collect()}
    assert sorted(got) == [r[0] for r in rows] and got[5] == 1 and got[2] is None and got[1] > len(rows[0][2])


def test_a_file_per_document_without_a_folder_each(spark, tmp_path):
    documents(spark, tmp_path)
    assert {r["lang"]: r["n_files"] for r in q_files.q_s3(spark, str(tmp_path)).collect()} == {
        "en": 2, "de": 3, "__HIVE_DEFAULT_PARTITION__": 1}
    files = staged(spark, "docs_txt")
    assert len(files) == 6 and not [f for f in files if "doc_id=" in str(f)]
    assert "two\nlines\n" in [f.read_text() for f in files]


def test_notes_are_staged_compressed(spark):
    got = q_files.q_s2(spark, "/root/testdata/sf0.01").collect()
    files = staged(spark, "notes_txt")
    assert got and files and all(f.name.endswith(".txt.gz") for f in files)


def test_draws_meet_rows_without_a_shuffle_of_the_draws(spark):
    """The same weights as counted by unit; the planner never takes the draws for a small table."""
    from cohortlens.operators.bootstrap import bootstrap_weights, drawn_rows
    df = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (7, 1), (None, 1)], "id long, y int")
    for method in ("exact", "poisson"):
        rows = drawn_rows(df, "id", 30, 3, method)
        plan = rows._jdf.queryExecution().toString()
        assert "hashpartitioning" not in plan.split("== Physical Plan ==")[1]
        assert ("Join" in plan) == (method == "exact")
        got = sorted((r.draw, r.id, r.y, r.w) for r in rows.groupBy("draw", "id", "y").agg({"w": "sum"})
                     .withColumnRenamed("sum(w)", "w").collect())
        want = df.join(bootstrap_weights(df, "id", 30, 3, method), "id")
        assert got == sorted((r.draw, r.id, r.y, r.w) for r in want.collect())
    weights = {(r.draw, r.id): r.w for r in bootstrap_weights(df, "id", 30, 3).collect()}
    want = {}
    for k in range(30 * 4):  # the null unit is counted and numbered
        u = (int(hashlib.md5(f"{k}|3".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        at = (k // 4, [None, 1, 2, 7][int(u * 4)])
        want[at] = want.get(at, 0) + 1
    assert weights == want


def test_levels_are_rendered_once_and_read_by_length(spark):
    """the score takes the length that a level comes with; the rank metric reads staged counts."""
    seen = spark.sparkContext.accumulator(0)

    def chars(x):
        seen.add(1)
        return 100 * x + x % 3 * 50

    rows = spark.range(30).selectExpr("if(id % 2 = 0, 'a', 'b') level", "cast(id as int) id", "id % 4 < 2 thirty_day_readmission",
                                      "raise_error('the text was read') text")
    rows = rows.withColumn("n_chars", F.udf(chars, "int")("id"))
    got = {r["level"]: r["auroc"] for r in q_files.level_auroc(rows).collect()}
    assert seen.value == 30 and set(got) == {"a", "b"}
    for level, odd in (("a", 0), ("b", 1)):
        p = [((100 * x + x % 3 * 50) % 100, x % 4 < 2) for x in range(30) if x % 2 == odd]
        pos, neg = [a for a, y in p if y], [a for a, y in p if not y]
        assert abs(got[level] - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))) < 1e-12


def test_race_partners_are_not_staged(spark):
    """A note's partners hold many times its own attributes."""
    rows, text = q_pairs.test_rows(spark, "/root/testdata/sf0.01")
    plan = CF.race_counterfactuals(rows, text)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan


def test_variants_are_written_dense(spark, tmp_path):
    """zstd where it was snappy; the rows read back are the rows written."""
    df = spark.range(20).selectExpr("concat('note ', id) text", "if(id % 2 = 0, 'a', null) variant", "'test' split")
    write_variants(df, str(tmp_path / "v"))
    files = [f.name for f in (tmp_path / "v").rglob("part-*")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    back = spark.read.parquet(str(tmp_path / "v")).select("text", "variant", "split")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    """files are dealt to a fixed count of tasks; a task lists many folders."""
    from cohortlens.session import fan_out_partitions
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    rows = [(i, "en", f"text {i}") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1,)], "item_id long").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = spark.conf.get(key)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        got = q_files.q_s3m(spark, str(tmp_path)).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert spark.conf.get(key) == before
    assert len(got) == 121 and sum(r.status == "read" for r in got) == 120
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert all(s.numTasks <= fan_out_partitions(spark) for s in stages if s)
