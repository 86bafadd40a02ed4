"""Note variants: anonymisation levels (C7), attribute-inference sets
and the shared split (P5).

Design for long notes: every rewrite pattern of a level ends in '>', so no
match can lie after the last '>' of a note. Each note is cut once into a
tagged head (through the last '>') and an untagged tail; the per-variant
work (64 or 12 rewrites) runs on the head only and the tail is appended
unchanged. Variants are produced by ``explode`` of a fixed flag list
(generator, no join), after the join with the demographics.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import tags as T
from ..functions.codes import LEVEL_ATTRIBUTES
from ..operators.sampling import stratified_split
from ..session import fan_out_partitions, materialize
from ..sources import adapters as ad
from . import cohort as C
from .embed import added

SPLIT_SEED = 42
# adds the hashed counts of the words of a text (embed.word_counts, its width set): (rows, text, name of the column)
CountWords = Callable[[DataFrame, Column, str], DataFrame]
TEST_SIZE = 0.5


def split_head_tail(text: str | Column) -> tuple[Column, Column]:
    return T.cut_tagged(text)


def note_rows(spark: SparkSession, d: str, demo: DataFrame | None = None) -> DataFrame:
    """Demographics of the stays with a note, with the keys of its text but
    without the text: what joins by stay id take."""
    demo = C.demographics(spark, d) if demo is None else demo
    return demo.join(ad.note_stays(spark, d).drop("subject_id"), "hadm_id")


def note_text(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """:func:`note_rows`, after all joins, with the note text after the
    clean-up chain (C6). The rows are dealt to the documents in a fixed number
    of partitions; a fan-out behind them finds them spread."""
    return ad.with_text(rows, spark, d, fan_out_partitions(spark)).withColumn(
        "text", F.concat(*T.normalised_parts("text", "gender")))


def tagged_notes(spark: SparkSession, d: str, demo: DataFrame | None = None) -> DataFrame:
    """Demographics joined with the note text after the clean-up chain."""
    return note_text(note_rows(spark, d, demo), spark, d)


def split_table(demo: DataFrame) -> DataFrame:
    """One train/test split per subgroup, stratified on the outcome,
    keyed by stay id and joined to every variant."""
    return stratified_split(demo.select("hadm_id", "abbrev", "thirty_day_readmission"), ["abbrev"],
                            "thirty_day_readmission", TEST_SIZE, "hadm_id", SPLIT_SEED) \
        .select("hadm_id", "split")


def level_flags() -> list[dict]:
    """The 64 switch settings in the study's order (all on first)."""
    out = []
    for combo in itertools.product([True, False], repeat=6):
        f = dict(zip(LEVEL_ATTRIBUTES, combo))
        f["level"] = "_" + "".join(a + "_" for a in LEVEL_ATTRIBUTES if f[a])
        out.append(f)
    return out


# ---------------------------------------------------------------- segments
# A head is cut once into literal text and well-formed '<tag>value</tag>'
# pieces. A variant then only picks, per piece, the value its switches ask
# for and joins the pieces: no regex per variant. Where a literal piece
# holds a '<' (a stray bracket that the study's label stripping would eat
# across pieces) the joined tagged text is stripped by the regex instead,
# so the result is exactly that of the regex chain.

SWITCH_INDEX = {"name": 0, "address": 1, "age": 2, "admission_date": 3, "discharge_date": 3, "dob": 4,
                **{t: 5 for t in T.GENDER_TERMS}, "race": 6}
SPLIT_RE = r"(?=<[A-Za-z_]+>[^<]*</[A-Za-z_]+>)|(?<=</[A-Za-z_]{1,64}>)"


def tag_pieces(head: Column, on_values: dict[str, Column], off_values: dict[str, str]) -> Column:
    """array<struct<idx, tag, lit, val, on, off>>: idx -1 literal, -2 a tag
    no switch touches, else the switch number of SWITCH_INDEX."""
    def piece(p):
        tag = F.regexp_extract(p, r"^<([A-Za-z_]+)>[^<]*</\1>$", 1)
        val = F.regexp_extract(p, r"^<[A-Za-z_]+>([^<]*)</[A-Za-z_]+>$", 1)
        idx = F.when(tag == "", F.lit(-1))
        on = F.lit(None).cast("string")
        off = F.lit(None).cast("string")
        for t, i in SWITCH_INDEX.items():
            idx = idx.when(tag == t, F.lit(i))
            on = F.when(tag == t, on_values[t].cast("string")).otherwise(on)
            off = F.when(tag == t, F.lit(off_values[t])).otherwise(off)
        return F.struct(idx.otherwise(F.lit(-2)).alias("idx"), tag.alias("tag"), p.alias("lit"), val.alias("val"),
                        on.alias("on"), off.alias("off"))
    return F.transform(F.split(head, SPLIT_RE), piece)


def render_pieces(pieces: Column, switches: Column) -> Column:
    """Join the pieces with the switches (array of 7 booleans) applied and
    the labels stripped."""
    def pick(p):
        return F.when(F.element_at(switches, p["idx"] + 1), p["on"]).otherwise(p["off"])
    plain = F.array_join(F.transform(pieces, lambda p: F.when(p["idx"] == -1, p["lit"]).when(p["idx"] == -2, p["val"])
                                     .otherwise(pick(p))), "")
    tagged = F.array_join(F.transform(pieces, lambda p: F.when(p["idx"] < 0, p["lit"]).otherwise(
        F.concat(F.lit("<"), p["tag"], F.lit(">"), pick(p), F.lit("</"), p["tag"], F.lit(">")))), "")
    safe = F.forall(pieces, lambda p: (p["idx"] != -1) | (F.instr(p["lit"], "<") == 0))
    return F.when(safe, plain).otherwise(T.strip_tags(tagged))


# Slot templates: each switched tag of a head is replaced once, all tags in one
# pass, by its name between two private-use characters, every other well-formed
# tag by its value.
# A variant is then 14 plain replaces (codegen'd, no regex, no lambdas).
# Exact wherever no '<' is left after that (a stray bracket would make the
# study's label stripping eat across pieces) and the head holds no private-use
# characters; other notes take the piece / regex path.
TAG_ORDER = ["name", "address", "age", "admission_date", "discharge_date", "dob", *T.GENDER_TERMS, "race"]
SLOT = {t: f"\uE000{t}\uE001" for t in TAG_ORDER}  # private-use code points


def slot_template(head: Column) -> tuple[Column, Column]:
    """(template, safe) of a head."""
    t = F.regexp_replace(head, f"<({'|'.join(TAG_ORDER)})>[^<]*</\\1>", "\uE000$1\uE001")
    # label tokens of other tags and stray '<...>' spans that hold no '<' and
    # no slot are removed exactly as the final strip would remove them
    t = F.regexp_replace(t, "<[^<>\\uE000-\\uE0FF]*>", "")
    private = (F.octet_length(head) != F.length(head)) & head.rlike("[\\uE000-\\uE0FF]")
    safe = (F.instr(t, "<") == 0) & ~private
    return t, safe


def render_template(tmpl: Column, values: dict) -> Column:
    """Fill the slot of every tag in ``values`` with its value (stripped
    text). Values that all variants of a note share are filled in before the
    fan-out, so that a variant replaces its own slots only."""
    t = tmpl
    for tag in (x for x in TAG_ORDER if x in values):
        t = F.replace(t, F.lit(SLOT[tag]), values[tag].cast("string"))
    return t


def cut_space(text: Column) -> tuple[Column, Column]:
    """(text up to its first white space, the rest)."""
    begin = F.regexp_extract(text, r"^\S*", 0)
    return begin, F.substring(text, F.length(begin) + 1, F.lit(1 << 30))


def open_chunks(tmpl: Column) -> tuple[Column, Column]:
    """(the chunks between white space that hold a slot, and the last one, which may go on behind the
    template; all other chunks): the words of a filled template are those of both."""
    chunks = F.split(F.concat(tmpl, F.lit("\uE000")), r"\s+")  # so that the last one counts as open
    shared = F.array_join(F.filter(chunks, lambda c: c.contains("\uE000")), " ")
    return (F.substring(shared, F.lit(1), F.length(shared) - 1),
            F.array_join(F.filter(chunks, lambda c: ~c.contains("\uE000")), " "))


def slot_pieces(tmpl: Column, tags: Sequence[str]) -> Column:
    """A template whose other slots are filled, cut at the slots of ``tags`` once a note, so that its
    variants search no text: array<struct<slot, lit>>, the number of a slot from 1 (0: none) and the
    text behind it."""
    def piece(p, i):
        # 0: the first piece, or a private-use character that came with a value
        res = F.struct(F.lit(0).alias("slot"), F.when(i == 0, p).otherwise(F.concat(F.lit("\uE000"), p)).alias("lit"))
        for n, t in enumerate(tags, 1):
            at = SLOT[t][1:]
            res = F.when((i > 0) & p.startswith(at), F.struct(F.lit(n).alias("slot"), F.substring(
                p, F.lit(len(at) + 1), F.lit(1 << 30)).alias("lit"))).otherwise(res)
        return res
    return F.transform(F.split(tmpl, "\uE000"), piece)


def pieces_chars(pieces: Column, tags: Sequence[str]) -> Column:
    """Characters of :func:`slot_pieces` without the values, then the number of slots of each tag."""
    def slots(n: int) -> Column:
        return F.size(F.filter(pieces["slot"], lambda x: x == n))
    return F.array(F.length(F.array_join(pieces["lit"], "")), *[slots(n) for n in range(1, len(tags) + 1)])


def fill_pieces(pieces: Column, chars: Column, values: dict, tags: Sequence[str]) -> tuple[Column, Column]:
    """(text, its characters) of a variant; null where a value is null. Few pieces a variant: the
    lambda costs little, and it keeps the regex path beside it out of one method too large to compile."""
    vals = [values[t].cast("string") for t in tags]
    n = chars[0]
    for i, v in enumerate(vals, 1):
        n = n + chars[i] * F.length(v)
    by_slot = F.array(F.lit(""), *vals)
    text = F.array_join(F.transform(pieces, lambda p: F.concat(F.get(by_slot, p["slot"]), p["lit"])), "")
    return F.when(n.isNotNull(), text), n


SWITCH_TAGS = {"name": ["name"], "address": ["address"], "age": ["age"], "gender": list(T.GENDER_TERMS),
               "visitdates": ["admission_date", "discharge_date"], "race": ["race"]}  # and dob: age and visitdates
LAST_SWITCHES = ("name", "address")


def level_values(on: dict, off: dict, flags: dict) -> dict:
    """Tag -> value of one level (on or off by its switch)."""
    sw = {"name": flags["name"], "address": flags["address"], "age": flags["age"],
          "admission_date": flags["visitdates"], "discharge_date": flags["visitdates"],
          "dob": flags["age"] & flags["visitdates"], "race": flags["race"],
          **{t: flags["gender"] for t in T.GENDER_TERMS}}
    return {t: F.when(sw[t], on[t]).otherwise(F.lit(off[t])) for t in TAG_ORDER}


def switch_values(key_gender: str = "gender") -> tuple[dict, dict]:
    """On and off values of every switched tag (as T8 writes them)."""
    fem = F.col(key_gender) == "F"
    on = {"name": F.col("name"), "address": F.col("address"),
          "age": F.concat(F.col("actual_age").cast("string"), F.lit(" year-old ")),
          "admission_date": D.ts_text("admittime_today"), "discharge_date": D.ts_text("dischtime_today"),
          "dob": F.col("dob").cast("string"), "race": F.col("race")}
    off = {t: "___" for t in ["name", "address", "age", "admission_date", "discharge_date", "dob", "race"]}
    for t, (fw, mw, ow) in T.GENDER_TERMS.items():
        on[t] = F.when(fem, F.lit(fw)).otherwise(F.lit(mw))
        off[t] = ow
    return on, off


def switches_of(flags: dict) -> Column:
    """The 7 switch values in SWITCH_INDEX order (dob = age and visit dates)."""
    return F.array(flags["name"], flags["address"], flags["age"], flags["visitdates"],
                   flags["age"] & flags["visitdates"], flags["gender"], flags["race"])


def _switch(text: Column, flags: dict) -> Column:
    return T.switch_info(text, "gender", "name", "address", "actual_age",
                         D.ts_text("admittime_today"), D.ts_text("dischtime_today"), "dob", "race", flags)


def anonymisation_levels(notes: DataFrame, rows: list[dict] | None = None, count: CountWords | None = None) -> DataFrame:
    """Every note at all 64 levels (or those of ``rows``): (level,
    hadm_id, ..., text, n_chars) with the labels stripped (T11). The head becomes a
    slot template once per note; levels that share the first switches share
    their fillings. ``notes`` are spread (``tagged_notes``). With ``count``
    the text is what remains when the words that levels share are counted in
    ``counts`` (once a note, or once a setting of the first switches), and
    there is no ``n_chars``."""
    rows = rows or level_flags()
    # first the switches with many slots, once for all levels that share them, then name and address
    first = [a for a in LEVEL_ATTRIBUTES if a not in LAST_SWITCHES]
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        groups.setdefault(tuple(r[a] for a in first), []).append(r)
    head, tail = split_head_tail("text")
    on, off = switch_values()
    tmpl, safe = slot_template(F.col("__head"))
    d = (notes.withColumn("__head", head).withColumn("__tail", tail).withColumn("__n", F.length("__tail")).drop("text")
         .withColumn("__tmpl", tmpl).withColumn("__safe", safe)
         .withColumn("__pieces", F.when(~F.col("__safe"), tag_pieces(F.col("__head"), on, off)))
         .drop("__head"))
    if count:
        joint, rest = cut_space(F.col("__tail"))
        shared, fixed = open_chunks(F.col("__tmpl"))
        # a note without an exact template keeps its head
        d = count(d, F.concat_ws(" ", F.when(F.col("__safe"), fixed), rest), "counts")
        d = d.withColumn("__tail", joint).withColumn("__tmpl", shared)

    def column(key) -> str:
        return "__t" + "".join("1" if x else "0" for x in key)

    # one column per setting of the first 1, 2, .. switches: each fills its slots into that of one switch less
    made = {(): "__tmpl"}
    for i, a in enumerate(first):
        made_next = {k[:i + 1]: column(k[:i + 1]) for k in groups}
        fill = {k: render_template(F.col(made[k[:-1]]), {t: on[t] if k[-1] else F.lit(off[t]) for t in SWITCH_TAGS[a]}
                                   | ({"dob": on["dob"] if k[first.index("age")] and k[-1] else F.lit(off["dob"])}
                                      if a == "visitdates" else {}))
                for k in made_next}
        d = d.select(*[c for c in d.columns if c not in made.values()], *[fill[k].alias(n) for k, n in made_next.items()])
        made = made_next
    d = d.withColumn("__g", F.explode(F.array(*[F.struct(
        F.col(made[k]).alias("tmpl"), *[F.lit(x).alias(f"f_{a}") for a, x in zip(first, k)],
        F.array(*[F.struct(F.lit(r["level"]).alias("level"), *[F.lit(r[a]).alias(f"f_{a}") for a in LAST_SWITCHES])
                  for r in levels]).alias("levels")) for k, levels in groups.items()]))).drop(*made.values())
    d = d.withColumn("__tmpl", F.col("__g.tmpl"))
    if count:
        shared, fixed = open_chunks(F.col("__tmpl"))
        d = count(d, F.when(F.col("__safe"), fixed), "__more")
        d = d.withColumn("counts", added(F.col("counts"), F.col("__more"))).drop("__more").withColumn("__tmpl", shared)
    d = d.withColumn("__lv", F.explode("__g.levels")).withColumn("level", F.col("__lv.level"))
    flags = {a: F.col(f"__lv.f_{a}" if a in LAST_SWITCHES else f"__g.f_{a}") for a in LEVEL_ATTRIBUTES}
    last = {t: F.when(flags[a], on[t]).otherwise(F.lit(off[t])) for a in LAST_SWITCHES for t in SWITCH_TAGS[a]}
    fast = render_template(F.col("__tmpl"), last)
    slow = render_pieces(F.col("__pieces"), switches_of(flags))
    d = d.withColumn("__head", F.when(F.col("__safe"), fast).otherwise(slow))
    return (d.withColumn("text", F.concat("__head", "__tail")).withColumn("n_chars", F.length("__head") + F.col("__n"))
            .drop("__lv", "__g", "__tmpl", "__pieces", "__head", "__tail", "__n", "__safe", *(["n_chars"] if count else [])))


ATTRIBUTE_SETS = []  # (name, target, insert tag, flags)
for given, attr, scope in itertools.product(["given", "no"], ["race", "gender", "age"], ["everything", "nothing"]):
    insert = attr if (given == "given" and attr in ("race", "age")) else None
    if scope == "everything":
        flags = {a: True for a in LEVEL_ATTRIBUTES}
        if given == "no":
            flags[attr] = False
    else:
        flags = {a: False for a in LEVEL_ATTRIBUTES}
        if given == "given":
            flags[attr] = True
    target = {"race": "race", "gender": "gender", "age": "actual_age"}[attr]
    ATTRIBUTE_SETS.append((f"{given}_{attr}_{scope}", target, insert, flags))


def attribute_sets(notes: DataFrame) -> DataFrame:
    """The 12 attribute-inference sets. 'given' race/age inserts the
    attribute line into the head first (T6, study offset); the target
    column holds race, gender or age (as text), ``n_chars`` the text's
    length (that of the tail is counted once a note)."""
    lv = F.array(*[F.struct(F.lit(n).alias("set_name"), F.lit(t).alias("target_name"),
                            F.lit(i or "").alias("insert"), *[F.lit(f[a]).alias(f"f_{a}") for a in LEVEL_ATTRIBUTES])
                   for n, t, i, f in ATTRIBUTE_SETS])
    on, off = switch_values()
    d = notes
    for name, text in [("none", F.col("text")), ("race", T.insert_attribute("text", "race", F.col("race"))),
                       ("age", T.insert_attribute("text", "age", F.col("actual_age")))]:
        head, tail = split_head_tail(text)
        d = d.withColumn("__h", head).withColumn(f"__t_{name}", tail).withColumn(f"__n_{name}", F.length(f"__t_{name}"))
        tmpl, safe = slot_template(F.col("__h"))
        d = (d.withColumn(f"__m_{name}", tmpl).withColumn(f"__s_{name}", safe)
             .withColumn(f"__p_{name}", F.when(~F.col(f"__s_{name}"), tag_pieces(F.col("__h"), on, off)))
             .drop("__h"))
    d = d.withColumn("__s", F.explode(lv)).withColumn("set_name", F.col("__s.set_name"))
    ins = F.col("__s.insert")
    def pick(k):
        return F.when(ins == "race", F.col(f"__{k}_race")).when(ins == "age", F.col(f"__{k}_age")) \
            .otherwise(F.col(f"__{k}_none"))
    flags = {a: F.col(f"__s.f_{a}") for a in LEVEL_ATTRIBUTES}
    fast = render_template(pick("m"), level_values(on, off, flags))
    slow = render_pieces(pick("p"), switches_of(flags))
    d = d.withColumn("__head", F.when(pick("s"), fast).otherwise(slow))
    target = (F.when(F.col("__s.target_name") == "race", F.col("race"))
              .when(F.col("__s.target_name") == "gender", F.col("gender"))
              .otherwise(F.col("actual_age").cast("string")))
    return (d.withColumn("text", F.concat("__head", pick("t")))
            .withColumn("n_chars", F.length("__head") + pick("n")).withColumn("target", target)
            .drop("__s", "__head", *[f"__{k}_{n}" for k in "ptmsn" for n in ("none", "race", "age")]))


def variant_digest(df: DataFrame, keys: list[str], text: str = "text", chars: str | None = None) -> DataFrame:
    """Order-free summary of a variant table: rows, characters (of the column
    ``chars``, if the variants come with their lengths), and the sum of a
    32-bit md5 prefix of each text, per key."""
    h = F.conv(F.substring(F.md5(F.col(text)), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.sum(F.length(text) if chars is None else F.col(chars)).cast("bigint").alias("n_chars"),
                                 F.sum(h).cast("bigint").alias("md5_sum"))


def cohort_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """Keys and attributes of the whole pool (:func:`note_rows`), the split
    table, and the function that puts the text to the rows when all joins by
    stay id are made. What is staged is keys and attributes; the text is read
    where it is rewritten and never written."""
    demo = materialize(C.demographics(spark, d))
    rows = materialize(note_rows(spark, d, demo))
    return rows, materialize(split_table(demo)), lambda r: note_text(r, spark, d)


def cohort_notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tagged, cleaned notes of the whole pool and the split table."""
    rows, splits, text = cohort_rows(spark, d)
    return text(rows), splits
