import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import metrics as M
from cohortlens.operators.bootstrap import bootstrap
from cohortlens.operators.drawvectors import bootstrap_metrics, draw_metrics, draw_weights


def pair_auroc(y, p, w):
    pos, neg = y > 0, y <= 0
    total = w[pos].sum() * w[neg].sum()
    if not total:
        return None
    wins = (p[pos][:, None] > p[neg][None]) + 0.5 * (p[pos][:, None] == p[neg][None])
    return (w[pos][:, None] * w[neg][None] * wins).sum() / total


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_draws_equal_brute_force_with_a_hot_score(spark, partitions):
    """A third of one group's rows share a score, which then lies in several tasks."""
    rng = np.random.default_rng(3)
    rows = [(g, i, int(rng.random() < 0.4), 0.5 if rng.random() < 1 / 3 else round(float(rng.random()), 2))
            for g, n in (("a", 240), ("b", 60), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "variant string, id long, y int, p double")
    got = {(r.variant, r.draw): r for r in draw_metrics(df, "id", "y", "p", 6, 5, ["variant"], partitions).collect()}
    assert len(got) == 3 * 7
    for g in ("a", "b", None):
        of = [r for r in rows if r[0] == g]
        w = draw_weights([str(r[1]) for r in of], 6, 5)
        y, p = np.array([r[2] for r in of], float), np.array([r[3] for r in of])
        for draw in range(-1, 6):
            ww, r = w[:, draw + 1], got[g, draw]
            mean = (ww * y).sum() / ww.sum()
            assert r.auroc == pytest.approx(pair_auroc(y, p, ww), abs=1e-12)
            assert r.brier == pytest.approx((ww * (y - p) ** 2).sum() / ww.sum(), abs=1e-12)
            assert r.r2 == pytest.approx(1 - (ww * (y - p) ** 2).sum() / (ww * (y - mean) ** 2).sum(), abs=1e-9)


def test_same_summary_as_the_weight_table(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, int(i % 3 == 0), float(rng.random())) for i in range(150)], "id long, y int, p double")
    a = bootstrap(df, "id", M.auroc, "auroc", draws=30, method="poisson", y="y", p="p").first()
    b = bootstrap_metrics(df, "id", "y", "p", draws=30).where("metric = 'auroc'").first()
    for c in ("score", "std", "lower", "mean", "upper", "n_draws"):
        assert b[c] == pytest.approx(a[c], abs=1e-12)


def test_awkward_rows(spark):
    kind = "variant string, id long, y int, p double"
    rows = [("one", 1, 1, 0.5), ("one", 1, 1, 0.5), ("one", 2, 1, 0.7), ("none", None, 1, 0.5), ("none", 3, None, 0.1),
            ("none", 4, 1, None), ("none", 5, 0, float("nan"))]
    got = bootstrap_metrics(spark.createDataFrame(rows, kind), "id", "y", "p", 20, by=["variant"])
    found = {(r.variant, r.metric): r for r in got.collect()}
    assert set(v for v, _ in found) == {"one"}
    assert found["one", "auroc"].score is None and found["one", "auroc"].n_draws == 0
    assert found["one", "r2"].n_draws == 0 and found["one", "brier"].score == pytest.approx((0.25 * 2 + 0.09) / 3)
    assert bootstrap_metrics(spark.createDataFrame([], kind), "id", "y", "p", 20, by=["variant"]).count() == 0


def test_hot_score_is_spread(spark):
    """Rows all of one score still fill every range: no task holds the score alone."""
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 2).alias("y"), F.lit(0.25).alias("p"))
    ranges = df.repartitionByRange(8, "p", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 16)))
    sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    assert draw_metrics(df, "id", "y", "p", 3, partitions=8).where("auroc = 0.5").count() == 4


def test_hashes_of_many_units_at_once():
    """as by hashlib, also where a message takes more than one block."""
    import hashlib

    from cohortlens.operators.drawvectors import md5_parts
    units = [b"", b"7", b"12", b"\xc3\xa9" * 9, b"x" * 50, b"y" * 55, b"z" * 130]
    ends = [f"|{d}|p5".encode() for d in (0, 9, 10, 12345)] + [b""]
    want = [[int.from_bytes(hashlib.md5(u + e).digest()[:8], "big") for e in ends] for u in units]
    assert md5_parts(units, ends).tolist() == want
