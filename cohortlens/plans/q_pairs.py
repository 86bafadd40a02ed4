"""Pairing family: J8, J9, W2, W3, W9, U2, C9-C13 (test notes of the shared
split)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import AGE_SHIFT_RANGE, AGE_SHIFTS, GENDER_TERMS, RACE_CODES
from ..functions.tags import FILL_ORDER
from ..session import materialize
from ..operators.pairing import groups_with_all, rank_first, rank_match, rank_match_all, tail_pairs
from . import cohort as C
from . import counterfactuals as CF
from . import sqltext as S
from . import variants as V
from .catalog import register
from .q_text import TN_WITH


def test_notes(spark, d) -> DataFrame:
    rows, text = test_rows(spark, d)
    return text(rows)


def test_rows(spark, d, staged: bool = True) -> tuple[DataFrame, CF.AddText]:
    """Test stays without text, staged if they are read several times, and
    the function that adds it. The joins by stay id follow each other and
    only the test stays go on, so that the attributes move once."""
    demo = materialize(C.demographics(spark, d))
    test = V.split_table(demo).filter(F.col("split") == "test").select("hadm_id")
    rows = V.note_rows(spark, d, demo.join(test, "hadm_id"))
    return materialize(rows) if staged else rows, lambda r: V.note_text(r, spark, d)


def test_people(spark, d) -> DataFrame:
    """Test stays without text (for the pairing operators alone)."""
    demo = C.demographics(spark, d)
    return demo.join(V.split_table(demo).filter(F.col("split") == "test"), "hadm_id").drop("split")


# ------------------------------------------------------------------ SQL side
TT_WITH = TN_WITH + """,
test0 AS (SELECT tn.*, regexp_extract(tn.text, '(?s)^(.*>)', 1) AS head
          FROM tn JOIN splits ON tn.hadm_id = splits.hadm_id WHERE splits.split = 'test'),
tt AS (SELECT *, substr(text, length(head) + 1) AS tail FROM test0)"""

PEOPLE_WITH = TN_WITH + """,
tt AS (SELECT d.* FROM demographics d JOIN splits ON d.hadm_id = splits.hadm_id WHERE splits.split = 'test')"""

COLS = ["hadm_id", "gender", "race", "race_abbrev", "name", "address", "actual_age", "dob", "admittime_today",
        "dischtime_today", "thirty_day_readmission", "head", "tail"]


def fill_sql(t: str, values: dict[str, str]) -> str:
    for tag in FILL_ORDER:
        if tag in values:
            t = S.set_tag(t, tag, values[tag])
    return t


def all_on_sql(col, kg: str, race_on: bool = True) -> dict[str, str]:
    v = {"name": col("name"), "address": col("address"),
         "age": f"CAST({col('actual_age')} AS VARCHAR) || ' year-old '",
         "admission_date": S.ts(col("admittime_today")), "discharge_date": S.ts(col("dischtime_today")),
         "dob": f"CAST({col('dob')} AS VARCHAR)"}
    for tag, (fw, mw, _o) in GENDER_TERMS.items():
        v[tag] = f"CASE WHEN {kg} = 'F' THEN {S.q(fw)} ELSE {S.q(mw)} END"
    v["race"] = col("race") if race_on else "'___'"
    return v


def text_sql(head: str, tail: str, values: dict[str, str]) -> str:
    return f"{S.strip(fill_sql(head, values))} || {tail}"


DIGEST = ("SELECT variant, count(*) AS n_rows, CAST(sum(CAST(thirty_day_readmission AS INTEGER)) AS BIGINT) AS n_pos, "
          "CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(" + S.md5_32("text") + ") AS BIGINT) AS md5_sum")


def _pair_cols(alias: str, suffix: str) -> str:
    return ", ".join(f"{alias}.{c} AS {c}_{suffix}" for c in COLS)


def _c9_sql() -> str:
    rows = ", ".join(f"({S.q(n)}, {S.q(s)}, {str(g).lower()}, {str(sn).lower()}, {str(sa).lower()})"
                     for n, s, g, sn, sa in CF.GENDER_VARIANTS)

    def own(c):
        return f"(CASE WHEN side = 'f' THEN {c}_f ELSE {c}_m END)"

    def oth(c):
        return f"(CASE WHEN side = 'f' THEN {c}_m ELSE {c}_f END)"
    kg = f"(CASE WHEN regender THEN {oth('gender')} ELSE {own('gender')} END)"
    vals = all_on_sql(own, kg)
    vals["race"] = "race_f"
    vals["name"] = f"(CASE WHEN sname THEN {oth('name')} ELSE {own('name')} END)"
    vals["address"] = f"(CASE WHEN saddr THEN {oth('address')} ELSE {own('address')} END)"
    return TT_WITH + f""",
u2 AS (SELECT * FROM tt WHERE race IN (SELECT race FROM tt GROUP BY race
       HAVING count(DISTINCT gender) = (SELECT count(DISTINCT gender) FROM tt))),
fr AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY actual_age, hadm_id) AS rk FROM u2 WHERE gender = 'F'),
mr AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY actual_age, hadm_id) AS rk FROM u2 WHERE gender = 'M'),
pr AS (SELECT {_pair_cols('f', 'f')}, {_pair_cols('m', 'm')} FROM fr f JOIN mr m ON f.race = m.race AND f.rk = m.rk),
vv AS (SELECT * FROM (VALUES {rows}) t(variant, side, regender, sname, saddr)),
gv AS (SELECT variant, {own('hadm_id')} AS hadm_id, {text_sql(own('head'), own('tail'), vals)} AS text,
              {own('thirty_day_readmission')} AS thirty_day_readmission FROM pr CROSS JOIN vv)
{DIGEST} FROM gv GROUP BY variant"""


@register("c9_gender_counterfactuals", _c9_sql())
def q_c9(spark, d):
    rows, text = test_rows(spark, d)
    return CF.counterfactual_digest(CF.gender_counterfactuals(rows, text=text))


def _c10_sql() -> str:
    def own(c):
        return c
    vals = all_on_sql(own, "gender", race_on=False)
    vals["name"] = "(CASE WHEN contains(k, 'name') THEN name_b ELSE name END)"
    vals["address"] = "(CASE WHEN contains(k, 'address') THEN address_b ELSE address END)"
    base = all_on_sql(own, "gender", race_on=False)
    return TT_WITH + f""",
rr AS (SELECT *, row_number() OVER (PARTITION BY gender, race_abbrev ORDER BY actual_age, hadm_id) AS rk FROM tt),
pp AS (SELECT a.*, b.race_abbrev AS race_abbrev_b, b.name AS name_b, b.address AS address_b
       FROM rr a JOIN rr b ON a.gender = b.gender AND a.rk = b.rk AND a.race_abbrev <> b.race_abbrev),
kk AS (SELECT unnest(['name', 'address', 'name_address']) AS k),
sw AS (SELECT race_abbrev || '_to_' || race_abbrev_b || '_' || k AS variant, hadm_id,
              {text_sql('head', 'tail', vals)} AS text, thirty_day_readmission FROM pp CROSS JOIN kk),
bs AS (SELECT race_abbrev AS variant, hadm_id, {text_sql('head', 'tail', base)} AS text, thirty_day_readmission
       FROM tt),
allv AS (SELECT * FROM bs UNION ALL SELECT * FROM sw)
{DIGEST} FROM allv GROUP BY variant"""


@register("c10_race_counterfactuals", _c10_sql())
def q_c10(spark, d):
    rows, text = test_rows(spark, d)
    return CF.counterfactual_digest(CF.race_counterfactuals(rows, text=text))


def _c11_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RACE_CODES.items())
    vals = all_on_sql(lambda c: c, "gender")
    vals["race"] = f"(CASE WHEN nc = race_abbrev THEN race ELSE COALESCE((CASE nc {cases} END), nc) END)"
    return TT_WITH.replace("regexp_extract(tn.text,", f"regexp_extract({S.insert('tn.text', 'race', 'tn.race')},")\
        .replace("substr(text, length(head) + 1) AS tail",
                 f"substr({S.insert('text', 'race', 'race')}, length(head) + 1) AS tail") + f""",
codes AS (SELECT DISTINCT race_abbrev AS nc FROM tt),
ex AS (SELECT CASE WHEN nc = race_abbrev THEN race_abbrev || '_race' ELSE race_abbrev || '_to_' || nc || '_race' END
              AS variant, hadm_id, {text_sql('head', 'tail', vals)} AS text, thirty_day_readmission
       FROM tt CROSS JOIN codes)
{DIGEST} FROM ex GROUP BY variant"""


@register("c11_race_counterfactuals_explicit", _c11_sql())
def q_c11(spark, d):
    rows, text = test_rows(spark, d)
    return CF.counterfactual_digest(CF.race_counterfactuals_explicit(rows, text=text))


def _c12_sql(k: int = 12) -> str:
    rows = ", ".join(f"({S.q(n)}, {S.q(s)}, {str(a).lower()}, {str(sn).lower()}, {str(sa).lower()})"
                     for n, s, a, sn, sa in CF.AGE_VARIANTS)

    def own(c):
        return f"(CASE WHEN side = 'o' THEN {c}_o ELSE {c}_y END)"

    def oth(c):
        return f"(CASE WHEN side = 'o' THEN {c}_y ELSE {c}_o END)"
    vals = all_on_sql(own, own("gender"))
    vals["age"] = f"(CASE WHEN sage THEN CAST({oth('actual_age')} AS VARCHAR) ELSE {vals['age']} END)"
    vals["dob"] = f"(CASE WHEN sage THEN CAST({oth('dob')} AS VARCHAR) ELSE {vals['dob']} END)"
    vals["name"] = f"(CASE WHEN sname THEN {oth('name')} ELSE {own('name')} END)"
    vals["address"] = f"(CASE WHEN saddr THEN {oth('address')} ELSE {own('address')} END)"
    return TT_WITH + f""",
ar AS (SELECT *, row_number() OVER (PARTITION BY abbrev ORDER BY actual_age, hadm_id) AS rk,
              count(*) OVER (PARTITION BY abbrev) AS n FROM tt),
yy AS (SELECT * FROM ar WHERE rk <= {k}),
oo AS (SELECT *, rk - (n - {k}) AS rk2 FROM ar WHERE rk > n - {k}),
pr AS (SELECT {_pair_cols('y', 'y')}, {_pair_cols('o', 'o')} FROM yy y JOIN oo o ON y.abbrev = o.abbrev AND y.rk = o.rk2),
vv AS (SELECT * FROM (VALUES {rows}) t(variant, side, sage, sname, saddr)),
av AS (SELECT variant, {own('hadm_id')} AS hadm_id, {text_sql(own('head'), own('tail'), vals)} AS text,
              {own('thirty_day_readmission')} AS thirty_day_readmission FROM pr CROSS JOIN vv)
{DIGEST} FROM av GROUP BY variant"""


@register("c12_age_counterfactuals", _c12_sql())
def q_c12(spark, d):
    rows, text = test_rows(spark, d)
    return CF.counterfactual_digest(CF.age_counterfactuals(rows, text=text))


def _c13_sql() -> str:
    names = [("age", 0)] + [(f"age_{'plus' if x > 0 else 'minus'}_{abs(x)}", x) for x in AGE_SHIFTS]
    rows = ", ".join(f"({S.q(n)}, {x})" for n, x in names)
    vals = all_on_sql(lambda c: c, "gender")
    vals["age"] = f"(CASE WHEN delta <> 0 THEN CAST(actual_age + delta AS VARCHAR) ELSE {vals['age']} END)"
    vals["dob"] = f"(CASE WHEN delta <> 0 THEN CAST(dob - delta AS VARCHAR) ELSE {vals['dob']} END)"
    lo, hi = AGE_SHIFT_RANGE
    return TT_WITH + f""",
dd AS (SELECT * FROM (VALUES {rows}) t(variant, delta)),
sh AS (SELECT variant, hadm_id, {text_sql('head', 'tail', vals)} AS text, thirty_day_readmission
       FROM tt CROSS JOIN dd WHERE actual_age BETWEEN {lo} AND {hi})
{DIGEST} FROM sh GROUP BY variant"""


@register("c13_age_shift", _c13_sql())
def q_c13(spark, d):
    rows, text = test_rows(spark, d, staged=False)
    return CF.counterfactual_digest(CF.age_shift(rows, text=text))


@register("w2_rank_first", PEOPLE_WITH + """
SELECT hadm_id, row_number() OVER (PARTITION BY abbrev ORDER BY actual_age, hadm_id) AS rank FROM tt""")
def q_w2(spark, d):
    return rank_first(test_people(spark, d), ["abbrev"], "actual_age", "hadm_id").select("hadm_id", "rank")


@register("w3_rank_first_desc", PEOPLE_WITH + """
SELECT hadm_id, row_number() OVER (PARTITION BY abbrev ORDER BY actual_age DESC, hadm_id) AS rank FROM tt""")
def q_w3(spark, d):
    return rank_first(test_people(spark, d), ["abbrev"], "actual_age", "hadm_id", ascending=False) \
        .select("hadm_id", "rank")


@register("j8_rank_match", PEOPLE_WITH + """,
fr AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY actual_age, hadm_id) AS rk FROM tt WHERE gender = 'F'),
mr AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY actual_age, hadm_id) AS rk FROM tt WHERE gender = 'M')
SELECT f.race, f.rk AS rank, f.hadm_id AS hadm_id_f, m.hadm_id AS hadm_id_m
FROM fr f JOIN mr m ON f.race = m.race AND f.rk = m.rk""")
def q_j8(spark, d):
    tp = test_people(spark, d).select("hadm_id", "race", "gender", "actual_age")
    p = rank_match(tp.filter("gender = 'F'"), tp.filter("gender = 'M'"), ["race"], "actual_age", "hadm_id",
                   suffixes=("_f", "_m"))
    return p.select("race", "rank", "hadm_id_f", "hadm_id_m")


@register("j9_rank_match_all", PEOPLE_WITH + """,
rr AS (SELECT *, row_number() OVER (PARTITION BY gender, race_abbrev ORDER BY actual_age, hadm_id) AS rk FROM tt)
SELECT a.gender, a.rk AS rank, a.hadm_id AS hadm_id_a, b.hadm_id AS hadm_id_b
FROM rr a JOIN rr b ON a.gender = b.gender AND a.rk = b.rk AND a.race_abbrev <> b.race_abbrev""")
def q_j9(spark, d):
    tp = test_people(spark, d).select("hadm_id", "race_abbrev", "gender", "actual_age")
    return rank_match_all(tp, "race_abbrev", ["gender"], "actual_age", "hadm_id") \
        .select("gender", "rank", "hadm_id_a", "hadm_id_b")


@register("w9_tail_pairs", PEOPLE_WITH + """,
ar AS (SELECT *, row_number() OVER (PARTITION BY abbrev ORDER BY actual_age, hadm_id) AS rk,
              count(*) OVER (PARTITION BY abbrev) AS n FROM tt)
SELECT y.abbrev, y.rk AS rank, y.hadm_id AS hadm_id_y, o.hadm_id AS hadm_id_o
FROM (SELECT * FROM ar WHERE rk <= 12) y JOIN (SELECT *, rk - (n - 12) AS rk2 FROM ar WHERE rk > n - 12) o
  ON y.abbrev = o.abbrev AND y.rk = o.rk2""")
def q_w9(spark, d):
    tp = test_people(spark, d).select("hadm_id", "abbrev", "actual_age")
    return tail_pairs(tp, ["abbrev"], "actual_age", "hadm_id", 12).select("abbrev", "rank", "hadm_id_y", "hadm_id_o")


@register("u2_groups_with_all", PEOPLE_WITH + """
SELECT race, count(*) AS n FROM tt WHERE race IN (SELECT race FROM tt GROUP BY race
  HAVING count(DISTINCT gender) = (SELECT count(DISTINCT gender) FROM tt)) GROUP BY race""")
def q_u2(spark, d):
    kept = groups_with_all(test_people(spark, d), "race", "gender")
    return kept.groupBy("race").agg(F.count(F.lit(1)).alias("n"))


def cte_body(sql: str) -> str:
    """The WITH chain of a counterfactual oracle query without its final
    digest (to build other reports on the same variant texts)."""
    return sql[:sql.rindex(DIGEST)].rstrip()
