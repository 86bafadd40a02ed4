import os
import tempfile

from cohortlens.functions.prompts import python_tagger, tag_personal
from cohortlens.streaming.textstream import stream_tag_personal

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category_type", "category", "train_prevalence", "test_prevalence"]
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)


def test_rule_tagger_python_equals_spark(spark):
    texts = ["mail me at a.b@mail5.example.com or +1 (499) 555-6503, host 8.196.197.208",
             "a 70 year old with card 1234 5678 9012 3456 on 2020-01-02, 5 yo"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(tag_personal("text")).collect()] == python_tagger(texts)


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="cl-stream-", dir=os.environ.get("TMPDIR", "/tmp"))
    src = os.path.join(base, "src")
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3).write.parquet(src)
    out = stream_tag_personal(spark, src, "*.parquet", os.path.join(base, "sink"), os.path.join(base, "ckpt"))
    batch = spark.read.parquet(src).select("doc_id", tag_personal("text").alias("tagged"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
