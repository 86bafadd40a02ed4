"""Event-outcome family: W1, F4, F10, J1 on the adapter views and on
``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import keep_repeated, label_next_event, order_violations
from ..sources import adapters as ad
from ..sources.tables import table
from .catalog import register


def stay_events(spark: SparkSession, d: str) -> DataFrame:
    """J1 + F4: notes full outer join admissions on (subject, stay), patients
    with two or more rows. Only the presence of a note travels, not its text."""
    a = ad.admissions(spark, d).select("hadm_id", "subject_id", "admittime", "dischtime")
    n = ad.note_keys(spark, d).withColumn("has_text", F.lit(True))
    ev = (a.join(n, ["subject_id", "hadm_id"], "full_outer")
          .withColumn("has_text", F.coalesce("has_text", F.lit(False))))
    return keep_repeated(ev, "subject_id")


def readmission_labels(spark: SparkSession, d: str) -> DataFrame:
    """(hadm_id, subject_id, visit_no, thirty_day_readmission) for every stay
    with a note that has a following stay."""
    lab = label_next_event(stay_events(spark, d), "subject_id", "admittime", "dischtime", "hadm_id",
                           within="30 days", keep="has_text", label="thirty_day_readmission")
    return lab.select("hadm_id", "subject_id", "visit_no", "thirty_day_readmission")


SQL_EVENTS = """
ev0 AS (
  SELECT COALESCE(a.subject_id, n.subject_id) AS subject_id, COALESCE(a.hadm_id, n.hadm_id) AS hadm_id,
         a.admittime, a.dischtime, n.hadm_id IS NOT NULL AS has_text
  FROM admissions a FULL OUTER JOIN note_keys n ON a.subject_id = n.subject_id AND a.hadm_id = n.hadm_id),
ev AS (SELECT * FROM ev0 WHERE subject_id IN (SELECT subject_id FROM ev0 GROUP BY subject_id HAVING count(*) > 1)),
seq AS (
  SELECT *, row_number() OVER w - 1 AS visit_no, lead(admittime) OVER w AS next_admittime,
         lead(hadm_id) OVER w AS next_hadm_id
  FROM ev WINDOW w AS (PARTITION BY subject_id ORDER BY dischtime NULLS LAST, hadm_id)),
readm AS (
  SELECT hadm_id, subject_id, CAST(visit_no AS INTEGER) AS visit_no,
         COALESCE(next_admittime <= dischtime + INTERVAL 30 DAY, false) AS thirty_day_readmission
  FROM seq WHERE next_hadm_id IS NOT NULL AND has_text)"""

READM_WITH = ad.sql_with("admissions", "note_keys") + "," + SQL_EVENTS + "\n"


@register("w1_label_next_event", READM_WITH + "SELECT * FROM readm")
def q_w1(spark, d):
    return readmission_labels(spark, d)


@register("w1_label_next_event_plain_window", READM_WITH + "SELECT * FROM readm")
def q_w1_plain(spark, d):
    lab = label_next_event(stay_events(spark, d), "subject_id", "admittime", "dischtime", "hadm_id",
                           within="30 days", keep="has_text", label="thirty_day_readmission",
                           split_seconds=None)
    return lab.select("hadm_id", "subject_id", "visit_no", "thirty_day_readmission")


@register("w1_label_next_event_hours", """
SELECT event_id, user_id, CAST(row_number() OVER w - 1 AS INTEGER) AS visit_no,
       COALESCE(lead(ts) OVER w <= ts + INTERVAL 6 HOUR, false) AS label
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id)
QUALIFY lead(event_id) OVER w IS NOT NULL""")
def q_w1_events(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts")
    lab = label_next_event(ev, "user_id", "ts", "ts", "event_id", within="6 hours",
                           split_seconds=86400)
    return lab.select("event_id", "user_id", "visit_no", "label")


@register("f4_keep_repeated", ad.sql_with("admissions") + """
SELECT subject_id, CAST(count(*) AS BIGINT) AS n_stays FROM admissions
WHERE subject_id IN (SELECT subject_id FROM admissions GROUP BY subject_id HAVING count(*) > 1)
GROUP BY subject_id""")
def q_f4(spark, d):
    rep = keep_repeated(ad.admissions(spark, d), "subject_id")
    return rep.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_stays"))


@register("j1_full_outer_join", ad.sql_with("admissions", "note_keys") + """
SELECT COALESCE(a.hadm_id, n.hadm_id) AS hadm_id, COALESCE(a.subject_id, n.subject_id) AS subject_id,
       n.hadm_id IS NOT NULL AS has_text, a.hadm_id IS NOT NULL AS has_admission
FROM admissions a FULL OUTER JOIN note_keys n ON a.subject_id = n.subject_id AND a.hadm_id = n.hadm_id""")
def q_j1(spark, d):
    a = ad.admissions(spark, d).select("hadm_id", "subject_id").withColumn("has_admission", F.lit(True))
    n = ad.note_keys(spark, d).withColumn("has_text", F.lit(True))
    j = a.join(n, ["subject_id", "hadm_id"], "full_outer")
    return j.select("hadm_id", "subject_id", F.coalesce("has_text", F.lit(False)).alias("has_text"),
                    F.coalesce("has_admission", F.lit(False)).alias("has_admission"))


@register("f10_order_violations", ad.sql_with("admissions") + """
SELECT subject_id, hadm_id FROM admissions
QUALIFY dischtime < lag(dischtime) OVER (PARTITION BY subject_id ORDER BY hadm_id)""")
def q_f10(spark, d):
    bad = order_violations(ad.admissions(spark, d), "subject_id", ["hadm_id"], "dischtime")
    return bad.select("subject_id", "hadm_id")
