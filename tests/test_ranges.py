"""Ranges from the data: equal to one window, spread over tasks, rows moved once."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators.aggregates import quantiles
from cohortlens.operators.pairing import rank_first
from cohortlens.operators.ranking import ordered_position, unit_ranges, with_ranges


def hot_rows(spark, n=6000):
    """A third of the rows in one group, half of all rows of one age, ages
    missing, a group that is null."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise((F.col("id") % 40).cast("string")).alias("g"),
        F.when(F.col("id") % 2 == 0, 91).when(F.col("id") % 11 == 0, None)
        .otherwise(18 + F.col("id") * 7919 % 60).alias("age"))


def test_positions_equal_one_window(spark):
    df = hot_rows(spark)
    for asc in (True, False):
        got = rank_first(df, ["g"], "age", "id", ascending=asc, total="n")
        o = F.col("age") if asc else -F.col("age")
        w = Window.partitionBy("g").orderBy(o, "id")
        want = df.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
        cols = ["id", "rank", "n"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert ordered_position(df.limit(0), ["g"], ["age", "id"], key=F.col("age")).count() == 0


def test_a_value_shared_by_half_of_the_rows_is_divided(spark):
    df = with_ranges(hot_rows(spark), F.col("age"), "r", F.col("id"))
    sizes = [x["count"] for x in df.filter("age = 91").groupBy("r").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 600
    alone = [x["count"] for x in with_ranges(hot_rows(spark), F.col("age"), "r").filter("age = 91").groupBy("r").count().collect()]
    assert alone == [3000]


def test_narrow_scores_fill_all_ranges(spark):
    df = spark.range(8000).select("id", (F.lit(1 / 64) * F.pow(F.col("id") / 8000, 9)).alias("p"))
    sizes = [x["count"] for x in with_ranges(df, F.col("p"), "r").groupBy("r").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * 8000 / len(sizes)


def test_rows_move_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = hot_rows(spark).withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).withColumn("payload", F.md5(F.col("id").cast("string")))
        p = ordered_position(df, ["g"], ["u", "id"], unit_ranges(df, "u"))
        plan = p._jdf.queryExecution().executedPlan().toString()
        # rows (with their payload) by cell, partial counts by cell, cells by group and back by cell
        assert plan.count("Exchange hashpartitioning(__cell") == 3 and plan.count("Exchange") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_quantiles_equal_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.sin("id").alias("v"))
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {r.prob: r.value for r in quantiles(df, "v", [], probs).collect()}
    want = df.agg(*[F.percentile("v", p).alias(f"p{i}") for i, p in enumerate(probs)]).first()
    assert all(abs(got[p] - want[i]) < 1e-12 for i, p in enumerate(probs))
    by = {(r.g, r.prob): r.value for r in quantiles(df, "v", ["g"], probs).collect()}
    for r in df.groupBy("g").agg(*[F.percentile("v", p) for p in probs]).collect():
        assert all(abs(by[(r.g, p)] - r[i + 1]) < 1e-12 for i, p in enumerate(probs))
