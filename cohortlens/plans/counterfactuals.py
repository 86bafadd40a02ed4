"""Counterfactual note sets (C9-C13): the same test notes with personal
details swapped between rank-matched partners.

Pairing (J8 / J9 / W9) sees keys and attributes only: its result is a graph
of partners, one row a note with what the variants take from each partner.
The text comes last: each note meets its partners by stay id, once, and
``explode`` of its variants follows in the same stage; a variant is one fill
pass (T7 per tag) over the tagged head of the note, the untagged tail is
appended unchanged (see :mod:`.variants`). Outputs are (variant, hadm_id,
text, n_chars, label) tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.codes import AGE_SHIFT_RANGE, AGE_SHIFTS, RACE_CODES
from ..operators.pairing import groups_with_all, rank_match, rank_match_all, tail_pairs
from ..session import materialize
from .embed import added
from .variants import (CountWords, cut_space, fill_pieces, open_chunks, pieces_chars, render_template, slot_pieces,
                       slot_template, split_head_tail)

LABEL = "thirty_day_readmission"
# puts the text to rows that came without it (variants.cohort_rows), once their partners are joined
AddText = Callable[[DataFrame], DataFrame]
ATTR_COLS = ["hadm_id", "gender", "race", "race_abbrev", "abbrev", "name", "address", "actual_age", "dob",
             "admittime_today", "dischtime_today", LABEL]


def people_of(test_notes: DataFrame, cols: Sequence[str] = ATTR_COLS) -> DataFrame:
    """What pairing needs: the attributes without the text (staged, as ranks
    and joins read them several times)."""
    return materialize(test_notes.select(*cols))


def both_sides(pairs: DataFrame, sides: tuple[str, str], cols: list[str]) -> DataFrame:
    """Partner graph of pairs: (hadm_id, partners) with the side a note is on
    and the partner's ``cols``; a note has at most one partner on each side."""
    def one(own: str, other: str) -> Column:
        return F.struct(F.col(f"hadm_id_{own}").alias("hadm_id"), F.struct(
            F.lit(own).alias("side"), *[F.col(f"{c}_{other}").alias(c) for c in cols]).alias("partner"))
    a, b = sides
    return pairs.select(F.inline(F.array(one(a, b), one(b, a)))).groupBy("hadm_id").agg(
        F.collect_list("partner").alias("partners"))


def fan_out(partners: Column, variants: Column) -> Column:
    """array<struct<v, o>>: each variant of the side that the note is on, with the partner."""
    return F.flatten(F.transform(partners, lambda p: F.transform(
        F.filter(variants, lambda v: v["side"] == p["side"]), lambda v: F.struct(v.alias("v"), p.alias("o")))))


def with_head_tail(notes: DataFrame, *more: str, text: AddText | None = None, count: CountWords | None = None) -> DataFrame:
    """Attributes, the tagged head, the untagged tail and the slot template
    of each note (computed once, before any fan-out). With ``count`` the tail
    ends at its first white space and the words behind are in ``counts``."""
    notes = notes if text is None else text(notes)
    hd, tl = split_head_tail("text")
    d = notes.select(*ATTR_COLS, hd.alias("head"), tl.alias("tail"), *more)
    if count:
        joint, rest = cut_space(F.col("tail"))
        d = count(d, rest, "counts").withColumn("tail", joint)
    tmpl, safe = slot_template(F.col("head"))
    return d.withColumn("tmpl", tmpl).withColumn("safe", safe).withColumn("tail_chars", F.length("tail"))


def prefilled(d: DataFrame, values: dict, varying: Sequence[str]) -> DataFrame:
    """The template with every value filled in that all variants of a note share."""
    return d.withColumn("tmpl", render_template(F.col("tmpl"), {t: v for t, v in values.items() if t not in varying}))


def with_pieces(d: DataFrame, varying: Sequence[str], tmpl: str = "tmpl", out: str = "",
                count: CountWords | None = None) -> DataFrame:
    """The prefilled template cut at the varying slots, with the characters
    of its pieces (once a note), in place of the template. With ``count`` its
    words that meet no slot are added to the counts of the tail instead."""
    if count:
        shared, fixed = open_chunks(F.col(tmpl))
        d = count(d, F.when(F.col("safe"), fixed), "__more")  # else the variant has the whole head
        d = d.withColumn(f"all_counts{out}", added(F.col("counts"), F.col("__more"))).drop("__more").withColumn(tmpl, shared)
    d = d.withColumn(f"pieces{out}", slot_pieces(F.col(tmpl), varying))
    return d.withColumn(f"chars{out}", pieces_chars(F.col(f"pieces{out}"), varying)).drop(tmpl)


def _filled(p: DataFrame, variant: Column, values: dict, varying: Sequence[str], pieces: Column | None = None,
            chars: Column | None = None, counts: Column | None = None) -> DataFrame:
    """(variant, hadm_id, text, n_chars, label) of the exploded notes, or
    (.., counts, label) with the words counted before. The
    text: the pieces of the prefilled template joined by the varying values
    where exact, else the regex chain over the head with all values; then the
    tail, whose characters are counted once a note."""
    slow = T.strip_tags(T.fill_tags(F.col("head"), values))
    fast, n = fill_pieces(F.col("pieces") if pieces is None else pieces, F.col("chars") if chars is None else chars,
                          values, varying)
    p = p.select(variant.alias("variant"), "hadm_id", F.when(F.col("safe"), fast).otherwise(slow).alias("__head"),
                 F.when(F.col("safe"), n).alias("__n"), "tail", "tail_chars", LABEL,
                 *([] if counts is None else [counts.alias("counts")]))
    if counts is not None:
        return p.select("variant", "hadm_id", F.concat("__head", "tail").alias("text"), "counts", LABEL)
    return p.select("variant", "hadm_id", F.concat("__head", "tail").alias("text"),
                    (F.coalesce("__n", F.length("__head")) + F.col("tail_chars")).alias("n_chars"), LABEL)


# (variant name, base side, regender, swap name, swap address)
GENDER_VARIANTS = []
for side, other in (("f", "m"), ("m", "f")):
    for regender, kinds in itertools.product([False, True], [(), ("address",), ("name",), ("name", "address")]):
        parts = ([side] if not (regender or kinds) else [side, other] + (["gender"] if regender else []) + list(kinds))
        GENDER_VARIANTS.append(("_".join(parts), side, regender, "name" in kinds, "address" in kinds))


def gender_counterfactuals(test_notes: DataFrame, text: AddText | None = None,
                           count: CountWords | None = None) -> DataFrame:
    """Female and male test notes of the same race paired by age rank
    (races with both genders only, U2); 8 variants per direction: base,
    other's name / address / both, and each of these re-gendered. The
    outcome stays with the base note."""
    people = groups_with_all(people_of(test_notes), "race", "gender").select("hadm_id", "gender", "race", "name", "address", "actual_age")
    pairs = rank_match(people.filter(F.col("gender") == "F"), people.filter(F.col("gender") == "M"),
                       ["race"], "actual_age", "hadm_id", suffixes=("_f", "_m"))
    partners = materialize(both_sides(pairs, ("f", "m"), ["gender", "name", "address"]))
    arr = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(s).alias("side"), F.lit(g).alias("regender"),
                             F.lit(sn).alias("sname"), F.lit(sa).alias("saddr"))
                    for n, s, g, sn, sa in GENDER_VARIANTS])
    p = with_head_tail(test_notes.join(partners, "hadm_id"), "partners", text=text, count=count)
    p = prefilled(p, T.all_on_values(F.col, F.col("gender")), ["name", "address", *T.GENDER_TERMS])
    for g in ("F", "M"):  # both genders' words, once a note
        words = T.all_on_values(F.col, F.lit(g))
        p = p.withColumn(f"tmpl_{g}", render_template(F.col("tmpl"), {t: words[t] for t in T.GENDER_TERMS}))
    for g in ("F", "M"):
        p = with_pieces(p, ["name", "address"], f"tmpl_{g}", f"_{g}", count)
    p = p.withColumn("__x", F.explode(fan_out(F.col("partners"), arr)))
    v, other = F.col("__x.v"), F.col("__x.o")
    gender = F.when(v["regender"], other["gender"]).otherwise(F.col("gender"))
    vals = T.all_on_values(F.col, gender)
    vals["name"] = F.when(v["sname"], other["name"]).otherwise(F.col("name"))
    vals["address"] = F.when(v["saddr"], other["address"]).otherwise(F.col("address"))
    pieces, chars = [F.when(gender == "F", F.col(f"{c}_F")).otherwise(F.col(f"{c}_M")) for c in ("pieces", "chars")]
    counts = F.when(gender == "F", F.col("all_counts_F")).otherwise(F.col("all_counts_M")) if count else None
    return _filled(p, v["variant"], vals, ["name", "address"], pieces, chars, counts)


RACE_KINDS = ["name", "address", "name_address"]


def race_counterfactuals(test_notes: DataFrame, text: AddText | None = None,
                         count: CountWords | None = None) -> DataFrame:
    """Race written out of the note (race off, all else on); for every
    ordered pair of races, notes of the base race take the name, the
    address, or both from the same-gender note of equal age rank of the
    other race ('B_to_N_kind'); plus each race's own notes ('B')."""
    people = people_of(test_notes, ["hadm_id", "gender", "race_abbrev", "name", "address", "actual_age"])
    pairs = rank_match_all(people, "race_abbrev", ["gender"], "actual_age", "hadm_id")
    # at most one partner of each other race; many times a note's own attributes, so they are not staged
    partners = pairs.groupBy(F.col("hadm_id_a").alias("hadm_id")).agg(F.collect_list(F.struct(
        F.col("race_abbrev_b").alias("race_abbrev"), F.col("name_b").alias("name"), F.col("address_b").alias("address"))).alias("partners"))
    vals = T.all_on_values(F.col, F.col("gender"), race_on=False)  # gender is the stratum
    swapped = ["name", "address"]
    tn = with_head_tail(test_notes.join(partners, "hadm_id", "left"), "partners", text=text, count=count)
    tn = with_pieces(prefilled(tn, vals, swapped), swapped, count=count)
    kinds = F.array(*[F.lit(k) for k in RACE_KINDS])
    swaps = F.flatten(F.transform("partners", lambda p: F.transform(kinds, lambda k: F.struct(k.alias("kind"), p.alias("o")))))
    swaps_type = "array<struct<kind:string,o:struct<race_abbrev:string,name:string,address:string>>>"
    own = F.array(F.struct(F.lit(None).cast("string").alias("kind"),
                           F.lit(None).cast("struct<race_abbrev:string,name:string,address:string>").alias("o")))
    p = tn.withColumn("__x", F.explode(F.concat(own.cast(swaps_type), F.coalesce(swaps, F.array().cast(swaps_type)).cast(swaps_type))))
    kind, other = F.col("__x.kind"), F.col("__x.o")
    vals["name"] = F.when(kind.contains("name"), other["name"]).otherwise(F.col("name"))
    vals["address"] = F.when(kind.contains("address"), other["address"]).otherwise(F.col("address"))
    variant = F.when(kind.isNull(), F.col("race_abbrev")).otherwise(
        F.concat_ws("_", F.col("race_abbrev"), F.lit("to"), other["race_abbrev"], kind))
    return _filled(p, variant, vals, swapped, counts=F.col("all_counts") if count else None)


def race_counterfactuals_explicit(test_notes: DataFrame, text: AddText | None = None,
                                  count: CountWords | None = None) -> DataFrame:
    """C11: race line inserted into the head (T6), all attributes on, then the
    race label set to each race code of the notes ('B_race' for the own
    race, 'B_to_N_race' otherwise). The codes are one row beside every note."""
    codes = test_notes.select("race_abbrev").distinct().agg(F.collect_list("race_abbrev").alias("__codes"))
    ins = (test_notes if text is None else text(test_notes)).withColumn("text", T.insert_attribute("text", "race", F.col("race")))
    vals = T.all_on_values(F.col, F.col("gender"))
    tn = with_pieces(prefilled(with_head_tail(ins, count=count), vals, ["race"]), ["race"], count=count)
    tn = tn.join(F.broadcast(codes))  # one row: a code a race
    m = F.create_map(*[F.lit(x) for kv in RACE_CODES.items() for x in kv])
    p = tn.withColumn("__n", F.explode("__codes"))
    same = F.col("__n") == F.col("race_abbrev")
    vals["race"] = F.when(same, F.col("race")).otherwise(F.coalesce(F.element_at(m, F.col("__n")), F.col("__n")))
    variant = F.when(same, F.concat(F.col("race_abbrev"), F.lit("_race"))) \
        .otherwise(F.concat_ws("_", F.col("race_abbrev"), F.lit("to"), F.col("__n"), F.lit("race")))
    return _filled(p, variant, vals, ["race"], counts=F.col("all_counts") if count else None)


AGE_VARIANTS = []
for side, other in (("o", "y"), ("y", "o")):
    base = {"o": "old", "y": "young"}[side]
    oth_name = {"o": "young", "y": "old"}[side]
    for combo in [(), ("age",), ("name",), ("address",), ("age", "name"), ("age", "address"), ("name", "address"),
                  ("age", "name", "address")]:
        name = base if not combo else "_".join([base, oth_name, *combo])
        AGE_VARIANTS.append((name, side, "age" in combo, "name" in combo, "address" in combo))


def age_counterfactuals(test_notes: DataFrame, k: int = 12, text: AddText | None = None,
                        count: CountWords | None = None) -> DataFrame:
    """In each subgroup the k youngest and the k oldest test notes,
    paired by order (W9); 8 variants per direction swapping age with birth
    year (no 'year-old' here), name and address."""
    people = test_notes.select("hadm_id", "abbrev", "actual_age", "dob", "name", "address")
    pairs = tail_pairs(people, ["abbrev"], "actual_age", "hadm_id", k)
    # at most 2 k rows a subgroup: the notes stay where they are
    partners = materialize(both_sides(pairs, ("o", "y"), ["actual_age", "dob", "name", "address"]))
    arr = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(s).alias("side"), F.lit(a).alias("sage"),
                             F.lit(sn).alias("sname"), F.lit(sa).alias("saddr")) for n, s, a, sn, sa in AGE_VARIANTS])
    vals = T.all_on_values(F.col, F.col("gender"))
    swapped = ["name", "address", "age", "dob"]
    p = with_head_tail(test_notes.join(F.broadcast(partners), "hadm_id"), "partners", text=text, count=count)
    p = with_pieces(prefilled(p, vals, swapped), swapped, count=count)
    p = p.withColumn("__x", F.explode(fan_out(F.col("partners"), arr)))
    v, other = F.col("__x.v"), F.col("__x.o")
    vals["age"] = F.when(v["sage"], other["actual_age"].cast("string")).otherwise(vals["age"])
    vals["dob"] = F.when(v["sage"], other["dob"].cast("string")).otherwise(vals["dob"])
    vals["name"] = F.when(v["sname"], other["name"]).otherwise(F.col("name"))
    vals["address"] = F.when(v["saddr"], other["address"]).otherwise(F.col("address"))
    return _filled(p, v["variant"], vals, swapped, counts=F.col("all_counts") if count else None)


def age_shift(test_notes: DataFrame, deltas=AGE_SHIFTS, lo: int = AGE_SHIFT_RANGE[0],
              hi: int = AGE_SHIFT_RANGE[1], text: AddText | None = None, count: CountWords | None = None) -> DataFrame:
    """Notes with age in [lo, hi]: the note itself ('age') and the age
    moved by each delta with the birth year moved the other way
    ('age_plus_10', 'age_minus_20', ...)."""
    vals = T.all_on_values(F.col, F.col("gender"))
    tn = with_head_tail(test_notes.filter(F.col("actual_age").between(lo, hi)), text=text, count=count)
    tn = with_pieces(prefilled(tn, vals, ["age", "dob"]), ["age", "dob"], count=count)
    names = [("age", 0)] + [(f"age_{'plus' if x > 0 else 'minus'}_{abs(x)}", x) for x in deltas]
    p = tn.withColumn("__d", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(x).alias("delta"))
                                                 for n, x in names])))
    shifted = F.col("__d.delta") != 0
    vals["age"] = F.when(shifted, (F.col("actual_age") + F.col("__d.delta")).cast("string")).otherwise(vals["age"])
    vals["dob"] = F.when(shifted, (F.col("dob") - F.col("__d.delta")).cast("string")).otherwise(vals["dob"])
    return _filled(p, F.col("__d.variant"), vals, ["age", "dob"], counts=F.col("all_counts") if count else None)


def counterfactual_digest(df: DataFrame) -> DataFrame:
    """Per variant: rows, positives, characters, md5 sum of the texts."""
    h = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")
    return df.groupBy("variant").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum(F.col(LABEL).cast("int")).cast("bigint").alias("n_pos"),
                                     F.sum("n_chars").cast("bigint").alias("n_chars"),
                                     F.sum(h).cast("bigint").alias("md5_sum"))
