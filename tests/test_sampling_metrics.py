import numpy as np
from pyspark.sql import functions as F

from cohortlens.operators import metrics as M
from cohortlens.operators.aggregates import prevalence, quantiles
from cohortlens.operators.bootstrap import bootstrap
from cohortlens.operators.pairing import rank_match
from cohortlens.operators.ranking import ordered_position
from cohortlens.operators.sampling import random_parts, stratified_folds, stratified_split, weighted_sample


def test_split_quota_fixture(spark):
    rows = [(i, 0) for i in range(13)] + [(100 + i, 1) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, y int")
    sp = stratified_split(df, [], "y", 0.5, "id", seed=42)
    c = {(r.split, r.y): r["count"] for r in sp.groupBy("split", "y").count().collect()}
    assert c == {("train", 0): 7, ("train", 1): 3, ("test", 0): 6, ("test", 1): 4}


def test_folds_fixture(spark):
    rows = [(i, 0) for i in range(13)] + [(100 + i, 1) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, y int")
    f = stratified_folds(df, "y", 5, "id", seed=1)
    per = {}
    for r in f.groupBy("fold", "y").count().collect():
        per.setdefault(r.fold, [0, 0])[r.y] += r["count"]
    assert sorted(tuple(v) for v in per.values()) == sorted([(3, 1), (3, 1), (3, 1), (2, 2), (2, 2)])


def test_rank_match_fixture(spark):
    a = spark.createDataFrame([(5, "s", 30), (3, "s", 30), (9, "s", 50)], "id long, s string, age int")
    b = spark.createDataFrame([(41, "s", 41), (42, "s", 42)], "id long, s string, age int")
    p = rank_match(a, b, ["s"], "age", "id")
    assert sorted((r.id_a, r.id_b) for r in p.collect()) == [(3, 41), (5, 42)]


def test_prevalence_fixture(spark):
    rows = [("g1", "train", 1), ("g1", "train", 0), ("g1", "train", 0), ("g1", "train", 0),
            ("g2", "train", 0), ("g2", "test", 0)]
    df = spark.createDataFrame(rows, "g string, split string, y int")
    p = {r.category: (r.train_prevalence, r.test_prevalence)
         for r in prevalence(df, "y", "split", {"grp": F.col("g")}).collect()}
    assert p["g1"] == (0.25, None) and p["g2"] == (0.0, 0.0)


def test_prevalence_bands_overlap_and_scan_once(spark):
    rows = [("g", "train", 1, 30), ("g", "train", 0, 40), (None, "test", 1, 50), ("g", "test", 0, None)]
    df = spark.createDataFrame(rows, "g string, split string, y int, age int")
    p = prevalence(df, "y", "split", {"grp": F.col("g")}, age="age", bands=[(30, 40), (40, 50), (60, 70)])
    got = {(r.category_type, r.category): (r.train_prevalence, r.test_prevalence) for r in p.collect()}
    assert got == {("grp", "g"): (0.5, 0.0), ("grp", None): (None, 1.0), ("age_band", "(30, 40)"): (0.5, None),
                   ("age_band", "(40, 50)"): (0.0, 1.0)}
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_ordered_position_equals_row_number_on_skew(spark):
    rows = [(0 if i % 3 == 0 else i % 40, i, float((i * 7919) % 1000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g long, id long, v double")
    a = ordered_position(df, ["g"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 100), out="pos",
                         running={"cum": F.col("v")})
    from pyspark.sql import Window
    w = Window.partitionBy("g").orderBy("v", "id")
    b = df.withColumn("pos", F.row_number().over(w)).withColumn(
        "cum", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["id", "pos", "cum"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_random_parts_sizes(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "k")
    sizes = sorted(r["count"] for r in random_parts(df, 10, "k").groupBy("part").count().collect())
    assert sizes == [10] * 7 + [11] * 3


def test_weighted_sample_size(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", 1.0 + i % 5) for i in range(300)], "id long, s string, w double")
    c = {r.s: r["count"] for r in weighted_sample(df, ["s"], 20, "w", "id").groupBy("s").count().collect()}
    assert c == {"a": 20, "b": 20}


def _np_auc(y, p, w):
    pos = [(pi, wi) for yi, pi, wi in zip(y, p, w) if yi == 1]
    neg = [(pi, wi) for yi, pi, wi in zip(y, p, w) if yi == 0]
    num = sum(wp * wn * (1.0 if pp > pn else 0.5 if pp == pn else 0.0) for pp, wp in pos for pn, wn in neg)
    return num / (sum(w for _, w in pos) * sum(w for _, w in neg))


def _np_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, tp, tot, prev_r = 0.0, 0, 0, 0.0
    for t in order:
        tp += sum(1 for yi, pi in zip(y, p) if pi == t and yi == 1)
        tot += sum(1 for pi in p if pi == t)
        r = tp / P
        ap += (r - prev_r) * tp / tot
        prev_r = r
    return ap


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200).tolist()
    p = (np.round(rng.random(200) * 20) / 20).tolist()  # many ties
    w = rng.integers(1, 4, 200).astype(float).tolist()
    df = spark.createDataFrame(list(zip(range(200), y, p, w)), "id long, y int, p double, w double")
    assert abs(M.auroc(df, "y", "p", w="w").first()["auroc"] - _np_auc(y, p, w)) < 1e-12
    assert abs(M.auroc(df, "y", "p").first()["auroc"] - _np_auc(y, p, [1.0] * 200)) < 1e-12
    assert abs(M.average_precision(df, "y", "p").first()["auprc"] - _np_ap(y, p)) < 1e-12
    assert abs(M.brier(df, "y", "p").first()["brier"] - float(np.mean((np.array(p) - np.array(y)) ** 2))) < 1e-12
    yt, pr = np.array(y, float), np.array(p)
    r2 = 1 - ((yt - pr) ** 2).sum() / ((yt - yt.mean()) ** 2).sum()
    assert abs(M.r2(df, "y", "p").first()["r2"] - r2) < 1e-9


def test_bootstrap_mean_near_point(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    p = np.clip(y * 0.3 + rng.random(300) * 0.7, 0, 1)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, p double")
    for method in ("exact", "poisson"):
        r = bootstrap(df, "id", M.auroc, "auroc", draws=200, method=method, y="y", p="p").first()
        assert r["n_draws"] == 200
        assert abs(r["mean"] - r["score"]) < 0.02 and r["lower"] < r["score"] < r["upper"]


def test_quantiles_linear(spark):
    vals = [1, 2, 2, 3, 10, 11, 11, 40]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    got = {r.prob: r.value for r in quantiles(df, "x", [], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    exp = np.quantile(vals, [0.0, 0.25, 0.5, 0.75, 1.0])
    assert all(abs(got[p] - e) < 1e-12 for p, e in zip([0.0, 0.25, 0.5, 0.75, 1.0], exp))


def test_splits_at_many_sizes_number_the_rows_once(spark):
    """the same rows as one split a size."""
    from cohortlens.operators.sampling import stratified_splits
    rows = [(i, "ab"[i % 7 == 0] if i % 11 else None, i % 5 == 0 if i % 13 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, y boolean")
    sizes = [0.05, 0.3, 0.5, 0.95]
    many = stratified_splits(df, ["g"], "y", sizes, "id", 42)
    got = sorted((r.test_size, r.id, r.split) for r in many.collect())
    want = [(s, r.id, r.split) for s in sizes for r in stratified_split(df, ["g"], "y", s, "id", 42).collect()]
    assert got == sorted(want)
