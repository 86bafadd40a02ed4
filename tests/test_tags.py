from pyspark.sql import functions as F

from cohortlens.functions import tags as T
from cohortlens.functions.codes import LEVEL_ATTRIBUTES, TEMPLATE_F, TEMPLATE_M
from cohortlens.plans import variants as V

NOTE = ("Name: <name>___</name> Sex: <sex>F</sex>\n"
        "Service: MEDICINE\n"
        "<form_of_address>Ms.</form_of_address> <name>___</name> is a <age>70</age> year old "
        "<gendered_noun>woman</gendered_noun>. <pronoun_subject>She</pronoun_subject> saw <name>Dr Lee</name>; "
        "<pronoun_possessive>her</pronoun_possessive> Hgb <7 and K >5.")
LAST_AFTER_REPAIR = ("<form_of_address>Ms.</form_of_address> <name>___</name> is a <age>70</age>  "
                     "<gendered_noun>woman</gendered_noun>. She saw Dr Lee; "
                     "<pronoun_possessive>her</pronoun_possessive> Hgb <7 and K >5.")


def note_df(spark, gender="F", name="Ann Fox"):
    return spark.createDataFrame([(21, NOTE, gender, name, "1 Road", 70, 1955, "WHITE")],
                                 "hadm_id long, text string, gender string, name string, address string, "
                                 "actual_age int, dob int, race string") \
        .withColumn("admittime_today", F.lit("2025-01-01 00:00:00").cast("timestamp")) \
        .withColumn("dischtime_today", F.lit("2025-01-05 00:00:00").cast("timestamp"))


def test_template_lengths():
    assert len(TEMPLATE_F) == 267 and len(TEMPLATE_M) == 269


def test_repair_chain(spark):
    t = note_df(spark).select(T.normalise_tags("text", "gender").alias("t")).first()["t"]
    assert t.startswith(TEMPLATE_F)
    assert t.splitlines()[-1] == LAST_AFTER_REPAIR


def test_everything_off_stripped(spark):
    df = note_df(spark).withColumn("text", T.normalise_tags("text", "gender"))
    t = df.select(T.strip_tags(V._switch(F.col("text"), {a: False for a in LEVEL_ATTRIBUTES})).alias("t")).first()["t"]
    assert t.splitlines()[-1] == "___ ___ is a ___  ___. She saw Dr Lee; the patient's Hgb 5."


def test_everything_on_regendered_with_dollar(spark):
    df = note_df(spark, name="Ann $1 Fox").withColumn("text", T.normalise_tags("text", "gender"))
    t = T.switch_info("text", F.lit("M"), "name", "address", "actual_age", F.lit("2025"), F.lit("2025"), "dob",
                      "race", {a: True for a in LEVEL_ATTRIBUTES})
    out = df.select(T.strip_tags(t).alias("t")).first()["t"]
    assert out.splitlines()[-1] == "Mr. Ann $1 Fox is a 70 year-old   man. She saw Dr Lee; his Hgb 5."


def test_segment_rendering_equals_regex_chain(spark):
    df = note_df(spark).withColumn("text", T.normalise_tags("text", "gender"))
    df = df.union(df.withColumn("hadm_id", F.lit(22)).withColumn("text", F.regexp_replace("text", "<7 and K >", "")))
    # stray '<' whose span reaches a switched tag / another tag: exact fallback
    df = df.union(df.filter("hadm_id = 21").withColumn("hadm_id", F.lit(23))
                  .withColumn("text", F.concat("text", F.lit(" x <3 <name>Bo</name> y > z"))))
    df = df.union(df.filter("hadm_id = 21").withColumn("hadm_id", F.lit(24))
                  .withColumn("text", F.concat("text", F.lit(" x <3 <spouse>a</spouse> y > z"))))
    levels = V.anonymisation_levels(df).select("level", "hadm_id", "text")
    regex = []
    for r in V.level_flags():
        flags = {a: r[a] for a in LEVEL_ATTRIBUTES}
        head, tail = V.split_head_tail("text")
        regex.append(df.select(F.lit(r["level"]).alias("level"), "hadm_id",
                               F.concat(T.strip_tags(V._switch(head, flags)), tail).alias("text")))
    ref = regex[0]
    for x in regex[1:]:
        ref = ref.unionByName(x)
    assert sorted(map(tuple, levels.collect())) == sorted(map(tuple, ref.collect()))


def test_keys_and_codes(spark):
    df = spark.createDataFrame([("F_W_20012345",), ("M_AS_CH_29999999",)], "k string")
    got = [r[0] for r in df.select(T.hadm_id_of("k")).collect()]
    assert got == [20012345, 29999999]
    got = [r[0] for r in df.select(T.hadm_id_of("k", compat=True)).collect()]
    assert got == [20012345, 29999999]
    r = spark.createDataFrame([("ASIAN - CHINESE",), ("NATION_3",)], "r string").select(T.race_code("r")).collect()
    assert [x[0] for x in r] == ["AS_CH", "NATION_3"]


def test_find_sex(spark):
    df = spark.createDataFrame([("Sex:   F\n",), ("Sex: <sex>M</sex>",), ("no sex",)], "t string")
    assert [r[0] for r in df.select(T.find_sex("t")).collect()] == ["F", "M", ""]


def test_variant_counts():
    from cohortlens.plans import counterfactuals as CF
    assert len({r["level"] for r in V.level_flags()}) == 64
    assert len(V.ATTRIBUTE_SETS) == 12
    assert len(CF.GENDER_VARIANTS) == 16 and len(CF.AGE_VARIANTS) == 16


def test_cut_counts_characters_behind_the_last_bracket(spark):
    texts = ["<a>\u00e9\u00e9\U0001F600x\u00fc rest", "no bracket \u00e9", "", "<a>", "<a>\u00e9", None, "\U0001F600\U0001F600\U0001F600"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for more in (0, 3, 9):
        for t, (head, tail) in zip(texts, df.select(*T.cut_tagged("text", more)).collect()):
            at = None if t is None else t.rfind(">") + 1 + more
            assert (head, tail) == ((None, None) if t is None else (t[:at], t[at:]))


def test_nested_tags_fill_as_in_the_chain(spark):
    """F8: the template takes all tags at once; an outer label around an inner tag is no tag of its own."""
    heads = ["a <age><name>x</name></age> <race>r</race>", "<7 and <name>y</name> <sex>M</sex>", "<name>p</age> <name>q</name>",
             "<spouse><dob>1</dob></spouse> \u00fc <address>z</address>"]
    df = spark.createDataFrame([(h,) for h in heads], "head string")
    values = {t: F.lit(f"[{t}]") for t in V.TAG_ORDER}
    tmpl, safe = V.slot_template(F.col("head"))
    rows = df.select(V.render_template(tmpl, values).alias("fast"), safe.alias("safe"),
                     T.strip_tags(T.fill_tags("head", values)).alias("chain")).collect()
    assert [r.safe for r in rows] == [True, False, True, True]
    assert all(r.fast == r.chain for r in rows if r.safe)


def test_variants_come_with_their_lengths(spark):
    """The characters of the tail are counted once a note."""
    df = note_df(spark).withColumn("text", F.concat("text", F.lit(" tail of \u00e9\U0001F600")))
    for variants in (V.attribute_sets(df), V.anonymisation_levels(df)):
        assert variants.where(~F.col("n_chars").eqNullSafe(F.length("text"))).count() == 0


def test_cut_with_long_rest_equals_plain_cut(spark):
    """A last '>' before, at and behind the first HEAD_BYTES, between characters of several bytes, or none."""
    h = T.HEAD_BYTES
    texts = [None, "", ">", "no bracket", "a>b", "é" * h, "é" * h + ">é", "x" * (h - 1) + ">" + "é" * h,
             "x" * h + ">" + "y" * 9, "é" * (h // 2 - 1) + "x€>" + "€" * h, "a>" + "<é" * h, "€" * h + "<b>" + "z" * 40 + ">"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for more in (0, 3):
        head, tail = T.cut_tagged("t", more, stored=True)
        got = {r["id"]: (r["h"], r["r"]) for r in rows.select("id", head.alias("h"), tail.alias("r")).collect()}
        for i, t in enumerate(texts):
            at = None if t is None else min(len(t), t.rfind(">") + 1 + more)
            assert got[i] == ((None, None) if t is None else (t[:at], t[at:])), (i, more)


def test_parts_are_normalised_once_and_rewritten_like_the_whole(spark):
    """T10 rewrites the first part of C6 and leaves the rest, without a second cut: equal to the rewrite of the whole text."""
    body = "Sex: <sex>F</sex> <age>50</age> year old, <dob>___</dob> <race>X</race> <7 and K >5 <race>Y</race>"
    rows = spark.createDataFrame([(i, b + " yo <age" + "ü" * 1500) for i, b in enumerate([body, body + " <age>7</age>", "", "plain"])],
                                 "id int, t string")
    head, tail = T.normalised_parts("t", "g")
    rows = rows.withColumn("g", F.lit("F")).withColumn("head", head).withColumn("rest", tail).withColumn("text", T.normalise_tags("t", "g"))

    def swapped(t):
        return T.swap_race(T.swap_age(t, F.lit(60), F.lit(1965)), F.lit("BL_A"))
    for r in rows.select("text", "head", "rest", swapped(F.col("text")).alias("whole"),
                         F.concat(swapped(F.col("head")), "rest").alias("parts")).collect():
        assert r["head"] + r["rest"] == r["text"] and ">" not in r["rest"]
        assert r["whole"] == r["parts"]
