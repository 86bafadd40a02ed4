"""Tagged-text family: T1-T11, T14, C6, C7, C8, P5.

Row-level text results are returned as (id, n_chars, text_md5) and variant
tables as per-variant digests (rows, characters, md5 sum): the whole text is
rewritten, only the comparison is compact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import tags as T
from ..functions.codes import LEVEL_ATTRIBUTES, TEMPLATE_F, TEMPLATE_M
from ..sources import adapters as ad
from . import cohort as C
from . import sqltext as S
from . import variants as V
from .catalog import register
from .q_cohort import POOL_WITH


def rowdigest(df: DataFrame, text: Column, key: str = "hadm_id") -> DataFrame:
    return df.select(key, F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


def sql_rowdigest(t: str, key: str = "hadm_id") -> str:
    return f"SELECT {key}, length({t}) AS n_chars, md5({t}) AS text_md5"


NOTES_WITH = ad.sql_with("notes")
TN_WITH = (POOL_WITH.replace("WITH ", "WITH notes AS (" + ad.SQL_VIEWS["notes"] + "\n),\n", 1)
           + f""",
tn AS (SELECT dm.*, {S.normalise('n.text', 'dm.gender')} AS text
       FROM demographics dm JOIN notes n ON dm.hadm_id = n.hadm_id),
{S.split_sql('demographics').strip()}
""")


def demo_notes(spark, d) -> DataFrame:
    return ad.with_text(V.note_rows(spark, d), spark, d, V.fan_out_partitions(spark))


@register("t1_head_template", TN_WITH + sql_rowdigest(S.head("n.text", "dm.gender"), "dm.hadm_id")
          + " FROM demographics dm JOIN notes n ON dm.hadm_id = n.hadm_id")
def q_t1(spark, d):
    return rowdigest(demo_notes(spark, d), T.apply_head_template("text", "gender"))


@register("t2_check_names", NOTES_WITH + sql_rowdigest(S.names("text")) + " FROM notes")
def q_t2(spark, d):
    return rowdigest(ad.notes(spark, d), T.check_names("text"))


@register("t3_check_pronouns", NOTES_WITH + sql_rowdigest(S.pronouns("text")) + " FROM notes")
def q_t3(spark, d):
    return rowdigest(ad.notes(spark, d), T.check_pronouns("text"))


@register("t4_drop_year_old", NOTES_WITH + sql_rowdigest(S.year_old("text")) + " FROM notes")
def q_t4(spark, d):
    return rowdigest(ad.notes(spark, d), T.drop_year_old("text"))


@register("t11_strip_tags", NOTES_WITH + sql_rowdigest(S.strip("text")) + " FROM notes")
def q_t11(spark, d):
    return rowdigest(ad.notes(spark, d), T.strip_tags("text"))


@register("c6_normalise_tags", TN_WITH + sql_rowdigest("text") + " FROM tn")
def q_c6(spark, d):
    return rowdigest(demo_notes(spark, d), T.normalise_tags("text", "gender"))


@register("t5_hadm_id_of", POOL_WITH + """
SELECT abbrev || '_' || CAST(hadm_id AS VARCHAR) AS note_key,
       CAST(regexp_extract(abbrev || '_' || CAST(hadm_id AS VARCHAR), '_(\\d+)$', 1) AS BIGINT) AS id_safe,
       TRY_CAST(regexp_replace(abbrev || '_' || CAST(hadm_id AS VARCHAR), '[^2]*_', '', 'g') AS BIGINT) AS id_compat
FROM demographics""")
def q_t5(spark, d):
    k = F.concat_ws("_", "abbrev", F.col("hadm_id").cast("string"))
    dm = C.demographics(spark, d).select(k.alias("note_key"))
    return dm.select("note_key", T.hadm_id_of("note_key").alias("id_safe"),
                     F.regexp_replace("note_key", r"[^2]*_", "").try_cast("long").alias("id_compat"))


@register("t6_insert_attribute", TN_WITH + sql_rowdigest(S.insert("text", "race", "race")) + " FROM tn")
def q_t6(spark, d):
    notes = V.tagged_notes(spark, d)
    return rowdigest(notes, T.insert_attribute("text", "race", F.col("race")))


@register("t6_insert_after_own_head", TN_WITH + sql_rowdigest(
    f"substr(text, 1, CASE WHEN gender = 'F' THEN {len(TEMPLATE_F)} ELSE {len(TEMPLATE_M)} END) || 'age: <age>' || "
    f"CAST(actual_age AS VARCHAR) || '</age>' || substr(text, CASE WHEN gender = 'F' THEN {len(TEMPLATE_F)} "
    f"ELSE {len(TEMPLATE_M)} END + 1)") + " FROM tn")
def q_t6own(spark, d):
    """T6 right after the head of the note's own gender."""
    notes = V.tagged_notes(spark, d)
    return rowdigest(notes, T.insert_attribute("text", "age", F.col("actual_age"), gender="gender", compat=False))


@register("t7_set_tag", TN_WITH + sql_rowdigest(S.set_tag("text", "name", "name")) + " FROM tn")
def q_t7(spark, d):
    return rowdigest(V.tagged_notes(spark, d), T.set_tag("text", "name", F.col("name")))


ALL_ON = {a: "true" for a in LEVEL_ATTRIBUTES}
GENDER_ONLY = {a: ("true" if a == "gender" else "false") for a in LEVEL_ATTRIBUTES}


@register("t8_switch_info", TN_WITH + sql_rowdigest(S.switch_info("text", ALL_ON)) + " FROM tn")
def q_t8(spark, d):
    notes = V.tagged_notes(spark, d)
    return rowdigest(notes, V._switch(F.col("text"), {a: True for a in LEVEL_ATTRIBUTES}))


@register("t9_gender_terms", TN_WITH + sql_rowdigest(S.switch_info("text", GENDER_ONLY, g="kg"))
          + " FROM (SELECT *, CASE WHEN gender = 'F' THEN 'M' ELSE 'F' END AS kg FROM tn)")
def q_t9(spark, d):
    """Gender words for a re-keyed note (the other gender), all else off."""
    notes = V.tagged_notes(spark, d).withColumn("kg", F.when(F.col("gender") == "F", "M").otherwise("F"))
    t = T.switch_info("text", "kg", "name", "address", "actual_age", D.ts_text("admittime_today"),
                      D.ts_text("dischtime_today"), "dob", "race",
                      {a: a == "gender" for a in LEVEL_ATTRIBUTES})
    return rowdigest(notes, t)


@register("t10_swap_tag", TN_WITH + sql_rowdigest(
    S.set_tag(S.set_tag(S.set_tag("text", "age", "actual_age + 10"), "dob", "dob - 10"), "race", "race_abbrev"))
    + " FROM tn")
def q_t10(spark, d):
    notes = demo_notes(spark, d)
    head, tail = T.normalised_parts("text", "gender")
    t = T.swap_race(T.swap_age(head, F.col("actual_age") + 10, F.col("dob") - 10), F.col("race_abbrev"))
    return rowdigest(notes, F.concat(t, tail))


@register("t14_level_name", POOL_WITH + """
SELECT lvl, CASE WHEN replace(lvl, '_', '') = '' THEN 'NONE' ELSE
  array_to_string(list_filter([CASE WHEN instr(lvl, 'address') > 0 THEN 'Address' END,
    CASE WHEN instr(lvl, 'age') > 0 THEN 'Age' END, CASE WHEN instr(lvl, 'gender') > 0 THEN 'Gender' END,
    CASE WHEN instr(lvl, 'name') > 0 THEN 'Name' END,
    CASE WHEN instr(lvl, 'visitdates') > 0 THEN 'Admission and Discharge Time' END,
    CASE WHEN instr(lvl, 'race') > 0 THEN 'Race' END], lambda x: x IS NOT NULL), ', ') END AS readable,
  count(*) AS n
FROM (SELECT '_' || CASE WHEN name IS NOT NULL THEN 'name_' ELSE '' END
          || CASE WHEN address IS NOT NULL THEN 'address_' ELSE '' END
          || CASE WHEN actual_age IS NOT NULL THEN 'age_' ELSE '' END
          || CASE WHEN admittime_today IS NOT NULL AND dischtime_today IS NOT NULL THEN 'visitdates_' ELSE '' END
          || CASE WHEN gender IS NOT NULL THEN 'gender_' ELSE '' END
          || CASE WHEN race IS NOT NULL AND race_abbrev <> '' THEN 'race_' ELSE '' END AS lvl
      FROM demographics) GROUP BY lvl""")
def q_t14(spark, d):
    """Which attributes each stay can fill in, as a level name and its
    readable form, counted."""
    dm = C.demographics(spark, d)
    flags = {"name": F.col("name").isNotNull(), "address": F.col("address").isNotNull(),
             "age": F.col("actual_age").isNotNull(),
             "visitdates": F.col("admittime_today").isNotNull() & F.col("dischtime_today").isNotNull(),
             "gender": F.col("gender").isNotNull(),
             "race": F.col("race").isNotNull() & (F.col("race_abbrev") != "")}
    lv = dm.select(T.level_name(flags).alias("lvl"))
    return lv.groupBy("lvl").agg(F.count(F.lit(1)).alias("n")).withColumn("readable", T.readable_level("lvl"))


def _lv_values() -> str:
    rows = []
    for r in V.level_flags():
        rows.append("(" + ", ".join([S.q(r["level"])] + ["true" if r[a] else "false" for a in LEVEL_ATTRIBUTES]) + ")")
    return "VALUES " + ", ".join(rows)


C7_BODY = TN_WITH + f""",
lv AS (SELECT * FROM ({_lv_values()}) t(level, {', '.join('f_' + a for a in LEVEL_ATTRIBUTES)})),
tn2 AS (SELECT *, regexp_extract(text, '(?s)^(.*>)', 1) AS hd FROM tn),
tn3 AS (SELECT *, substr(text, length(hd) + 1) AS tl FROM tn2),
lvl AS (SELECT lv.level, tn3.hadm_id, tn3.thirty_day_readmission,
               {S.strip(S.switch_info('hd', S.flags_on()))} || tl AS text
        FROM tn3 CROSS JOIN lv)"""
C7_SQL = C7_BODY + f"""
{S.digest('text', 'level, split')} FROM lvl JOIN splits ON lvl.hadm_id = splits.hadm_id GROUP BY level, split"""


@register("c7_anonymisation_levels", C7_SQL)
def q_c7(spark, d):
    rows, splits, text = V.cohort_rows(spark, d)
    # the split is per note: attach it before the text, so that neither the
    # text nor the 64-fold explode cross a shuffle (only the digest does)
    lv = V.anonymisation_levels(text(rows.join(splits, "hadm_id")))
    return V.variant_digest(lv, ["level", "split"], chars="n_chars")


def _sets_values() -> str:
    rows = []
    for n, t, i, f in V.ATTRIBUTE_SETS:
        rows.append("(" + ", ".join([S.q(n), S.q(t), S.q(i or "")] +
                                    ["true" if f[a] else "false" for a in LEVEL_ATTRIBUTES]) + ")")
    return "VALUES " + ", ".join(rows)


C8_SQL = TN_WITH + f""",
st AS (SELECT * FROM ({_sets_values()}) t(set_name, target_name, ins, {', '.join('f_' + a for a in LEVEL_ATTRIBUTES)})),
s1 AS (SELECT st.*, tn.hadm_id, tn.name, tn.address, tn.actual_age, tn.admittime_today, tn.dischtime_today,
              tn.dob, tn.gender, tn.race,
              CASE WHEN ins = 'race' THEN {S.insert('tn.text', 'race', 'tn.race')}
                   WHEN ins = 'age' THEN {S.insert('tn.text', 'age', 'tn.actual_age')} ELSE tn.text END AS text
       FROM tn CROSS JOIN st),
s2 AS (SELECT *, regexp_extract(text, '(?s)^(.*>)', 1) AS hd FROM s1),
s3 AS (SELECT *, substr(text, length(hd) + 1) AS tl FROM s2),
s4 AS (SELECT set_name, hadm_id,
              {S.strip(S.switch_info('hd', S.flags_on()))} || tl || '|' ||
              CASE WHEN target_name = 'race' THEN race WHEN target_name = 'gender' THEN gender
                   ELSE CAST(actual_age AS VARCHAR) END AS text FROM s3)
{S.digest('text', 'set_name, split')} FROM s4 JOIN splits ON s4.hadm_id = splits.hadm_id GROUP BY set_name, split"""


@register("c8_attribute_sets", C8_SQL)
def q_c8(spark, d):
    rows, splits, text = V.cohort_rows(spark, d)
    sets = V.attribute_sets(text(rows.join(splits, "hadm_id")))
    sets = (sets.withColumn("text", F.concat("text", F.lit("|"), "target"))
            .withColumn("n_chars", F.col("n_chars") + 1 + F.length("target")))
    return V.variant_digest(sets, ["set_name", "split"], chars="n_chars")


@register("p5_split_membership", TN_WITH + "SELECT hadm_id, split FROM splits")
def q_p5(spark, d):
    return V.split_table(C.demographics(spark, d))
