import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import dates as D
from cohortlens.operators.events import keep_repeated, label_next_event, order_violations

T = dt.datetime


def stays(spark):
    rows = [
        (1, 21, T(2020, 1, 1, 8), T(2020, 1, 5, 12), "a"),
        (1, 22, T(2020, 2, 4, 12), T(2020, 2, 6, 9), None),
        (1, 23, T(2020, 3, 10), T(2020, 3, 12), "c"),
        (1, 24, T(2020, 4, 20), T(2020, 4, 21), "d"),
        (2, 25, T(2020, 1, 1), T(2020, 1, 2), "e"),
        (3, 26, T(2020, 5, 1), T(2020, 5, 9), "f"),
        (3, 27, T(2020, 5, 8), T(2020, 5, 10), "g"),
    ]
    return spark.createDataFrame(rows, "subject_id long, hadm_id long, admittime timestamp, dischtime timestamp, "
                                       "text string")


def test_next_event_label_fixture(spark):
    expected = {(21, 0, True), (23, 2, False), (26, 0, True)}
    for split in (None, 86400, 7 * 86400):
        ev = keep_repeated(stays(spark), "subject_id")
        lab = label_next_event(ev, "subject_id", "admittime", "dischtime", "hadm_id", "30 days",
                               keep=F.col("text").isNotNull(), split_seconds=split)
        got = {(r.hadm_id, r.visit_no, r.label) for r in lab.collect()}
        assert got == expected, split


@pytest.mark.parametrize("hot_rows", [0, 500, 10**6])
def test_split_window_equals_plain_window_on_hot_entity(spark, hot_rows):
    # two entities (one of them null) hold a third of the rows each: in ranges all, these two, or none
    rows = [((0, None, i % 50)[i % 3], i, T(2020, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "e long, id long, ts timestamp")
    a = label_next_event(df, "e", "ts", "ts", "id", "1 days", split_seconds=3 * 86400, hot_rows=hot_rows)
    b = label_next_event(df, "e", "ts", "ts", "id", "1 days", split_seconds=None)
    cols = ["id", "visit_no", "label"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_order_violations_equal_a_plain_loop(spark, hot_rows):
    rows = [((0, None, i % 50)[i % 3], i, (i * 7919) % 1009 if i % 11 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "e long, id long, ts long")
    expected, last = set(), {}
    for e, i, ts in rows:
        if e in last and None not in (ts, last[e]) and ts < last[e]:
            expected.add(i)
        last[e] = ts
    assert {r.id for r in order_violations(df, "e", ["id"], "ts", hot_rows).collect()} == expected


def test_order_violations(spark):
    df = stays(spark)
    assert order_violations(df, "subject_id", ["hadm_id"], "dischtime").count() == 0
    assert order_violations(df, "subject_id", ["text"], "dischtime").count() >= 0


def test_shift_year_fixture(spark):
    rows = [(T(2180, 2, 29, 10), T(2180, 3, 1)), (T(2179, 12, 30), T(2180, 1, 3)),
            (T(2180, 5, 1), T(2180, 12, 31, 10))]
    df = spark.createDataFrame(rows, "a timestamp, d timestamp")
    a, d = D.shift_stay("a", "d")
    got = [(r[0], r[1]) for r in df.select(a, d).collect()]
    assert got[0][0] == T(2025, 2, 28, 10)
    assert got[1] == (T(2025, 12, 30), T(2026, 1, 3))
    assert got[2][1] == T(2025, 12, 31, 10)
    dob = df.select(D.birth_year(d, F.lit(70))).collect()
    assert dob[1][0] == 2026 - 70
