"""Tagged-text functions (T1-T16, T19, T20, C5 rules).

Notes carry flat labels ``<tag>value</tag>`` (values hold no ``<``). Every
function returns a Column built from ``regexp_replace`` / ``regexp_extract``
/ ``concat``, so a whole chain of rewrites is one projection inside
whole-stage codegen, and the text column is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import (GENDER_TERMS, KEPT_PRONOUNS, LEVEL_ATTRIBUTES, RACE_CODES, TEMPLATE_F, TEMPLATE_M,
                    YEAR_OLD_FORMS)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def escape_replacement(value) -> Column:
    """Escape ``\\`` and ``$`` so a value is inserted literally by
    ``regexp_replace`` (else '$1' in a name is read as a group)."""
    return F.regexp_replace(_c(value).cast("string"), r"([\\$])", r"\\$1")


def tag_pattern(tag: str) -> str:
    return f"<{tag}>[^<]*</{tag}>"


def tagged(tag: str, value) -> Column:
    """``<tag>value</tag>`` as a replacement string (value escaped); a str
    value names a column."""
    return F.concat(F.lit(f"<{tag}>"), escape_replacement(_c(value)), F.lit(f"</{tag}>"))


# ---------------------------------------------------------------- clean-up

HEAD_BYTES = 1024


def cut_tagged(text, more: int = 0, stored: bool = False) -> tuple[Column, Column]:
    """(text up to its last '>' and ``more`` characters behind it, the rest). A pattern that ends in
    '>' (or within ``more`` characters of one) has all its matches in the first part, so that long
    untagged text is not searched. ``stored``: the text is a column, not an expression that would be
    repeated; then ``contains``, which passes over bytes several times faster than
    ``substring_index`` goes back over them, first sees whether the last '>' is within HEAD_BYTES."""
    t = _c(text)
    raw = t.cast("binary")
    begin = t
    if stored:
        behind = F.substring(raw, F.lit(HEAD_BYTES + 1), F.lit(1 << 30)).cast("string").contains(">")
        begin = F.substring(raw, F.lit(1), F.when(behind, F.lit(1 << 30)).otherwise(F.lit(HEAD_BYTES))).cast("string")
    # in bytes, so that long text is copied, not counted
    n = F.octet_length(begin) - F.octet_length(F.substring_index(begin, ">", -1))
    if more:  # a character has four bytes at most: the first ``more`` of them are whole in this piece
        rest = F.substring(raw, n + 1, F.lit(4 * more)) if stored else F.substring(
            F.substring_index(t, ">", -1).cast("binary"), F.lit(1), F.lit(4 * more))
        n = n + F.octet_length(F.substring(rest.cast("string"), F.lit(1), F.lit(more)))
    return F.substring(raw, F.lit(1), n).cast("string"), F.substring(raw, n + 1, F.lit(1 << 30)).cast("string")


def apply_head_template(text, gender) -> Column:
    """Replace everything from the start through the LAST ``</sex>`` by
    the head template of the gender ('F' or anything else = 'M'). No
    ``</sex>`` leaves the text as it is."""
    t = _c(text)
    tmpl = F.when(_c(gender) == "F", F.lit(TEMPLATE_F)).otherwise(F.lit(TEMPLATE_M))
    return F.concat(F.when(t.contains("</sex>"), tmpl).otherwise(F.lit("")), F.substring_index(t, "</sex>", -1))


def check_names(text) -> Column:
    """Drop the ``<name>`` label around values that are not ``___``."""
    return F.regexp_replace(_c(text), r"<name>(?!___</name>)([^<]*)</name>", "$1")


def check_pronouns(text) -> Column:
    """Drop pronoun labels whose value is not one of the seven lower-case
    third-person pronouns. Tag names match in any case, values exactly."""
    words = "|".join(KEPT_PRONOUNS)
    pat = rf"<(?i:pronoun_[^>]*>)(?!(?:{words})(?i:</pronoun_))([^<]*)(?i:</pronoun_[^>]*>)"
    return F.regexp_replace(_c(text), pat, "$1")


def drop_year_old(text) -> Column:
    """T4: remove a 'year old' form right after an age label (label and the
    blank stay)."""
    return F.regexp_replace(_c(text), rf"(?i)<(age>[^<]*</age> )(?:{YEAR_OLD_FORMS})", "<$1")


def normalised_parts(text, gender, stored: bool = True) -> tuple[Column, Column]:
    """C6 of the tagged part of the text (T4 reads at most a blank and the longest form behind a
    label), and the rest. No '>' is in the rest: tag rewrites that follow take the first part only."""
    head, tail = cut_tagged(text, 1 + max(map(len, YEAR_OLD_FORMS.split("|"))), stored)
    return drop_year_old(check_pronouns(check_names(apply_head_template(head, gender)))), tail


def normalise_tags(text, gender) -> Column:
    """The clean-up chain T1-T4 as one expression, over the tagged part of the text."""
    return F.concat(*normalised_parts(text, gender, stored=False))


# ---------------------------------------------------------------- keys

def hadm_id_of(key, compat: bool = False) -> Column:
    """T5: stay id from a note key ``<code>_<id>``. ``compat`` uses the
    study's rule (delete every ``[^2]*_``, valid when codes hold no '2')."""
    if compat:
        return F.regexp_replace(_c(key), r"[^2]*_", "").cast("long")
    return F.regexp_extract(_c(key), r"_(\d+)$", 1).cast("long")


def race_code(race) -> Column:
    """Race part of a subgroup code: the fixed code list, else the race name
    upper-cased with runs of other characters turned into '_'."""
    inv = {v: k for k, v in RACE_CODES.items()}
    m = F.create_map(*[F.lit(x) for kv in inv.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(race)),
                      F.regexp_replace(F.upper(_c(race)), r"[^A-Z0-9]+", "_"))


def sql_race_code(race_sql: str) -> str:
    cases = " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in RACE_CODES.items())
    return (f"(CASE {race_sql} {cases} ELSE regexp_replace(upper({race_sql}), '[^A-Z0-9]+', '_', 'g') END)")


def with_abbrev(gender, race) -> Column:
    """Subgroup code = gender letter + '_' + race code."""
    return F.concat(_c(gender), F.lit("_"), race_code(race))


def race_of_abbrev(abbrev) -> Column:
    """Race part of a code (from the third character)."""
    return F.substring(_c(abbrev), 3, 1 << 20)


# ---------------------------------------------------------------- insert, set, switch

def insert_attribute(text, tag: str, value, gender=None, compat: bool = True) -> Column:
    """Insert ``<tag>: <tag>value</tag>`` into the note. ``compat``: at
    character len(female template) + 1 for every note, as the study does
    (one character after the female head; inside the male head's last
    line). Otherwise right after the head of the note's own gender."""
    ins = F.concat(F.lit(f"{tag}: <{tag}>"), _c(value).cast("string"), F.lit(f"</{tag}>"))
    if compat:
        pos = F.lit(len(TEMPLATE_F) + 1)
    else:
        pos = F.when(_c(gender) == "F", F.lit(len(TEMPLATE_F))).otherwise(F.lit(len(TEMPLATE_M)))
    t = _c(text)
    return F.concat(F.substring(t, F.lit(1), pos), ins, F.substring(t, pos + 1, F.lit(1 << 30)))


def set_tag(text, tag: str, value) -> Column:
    """Every ``<tag>..</tag>`` gets ``value`` (a column or literal)."""
    return F.regexp_replace(_c(text), tag_pattern(tag), tagged(tag, value))


def switch_tag(text, tag: str, on, value, off_value: str = "___") -> Column:
    """T7 with a switch: the real value when ``on``, else ``off_value``.
    The condition sits in the replacement, so the text expression is not
    duplicated into both branches."""
    rep = F.when(_c(on), tagged(tag, value)).otherwise(F.lit(f"<{tag}>{off_value}</{tag}>"))
    return F.regexp_replace(_c(text), tag_pattern(tag), rep)


def switch_info(text, key_gender, name, address, age, admit_text, disch_text, dob, race,
                flags: dict) -> Column:
    """T8 + T9: write each personal attribute in or blank it out.

    ``flags`` maps name, address, age, visitdates, gender, race to a boolean
    Column or a Python bool. Age on writes ``'<N> year-old '`` into the
    label; the birth year is written only when age and visit dates are both
    on; gender words follow ``key_gender`` ('F' or 'M'), and with gender off
    pronouns become 'the patient' / "the patient's"."""
    fl = {k: (F.lit(bool(v)) if isinstance(v, bool) else _c(v)) for k, v in flags.items()}
    t, tail = cut_tagged(text)
    t = switch_tag(t, "name", fl["name"], name)
    t = switch_tag(t, "address", fl["address"], address)
    t = switch_tag(t, "age", fl["age"], F.concat(_c(age).cast("string"), F.lit(" year-old ")))
    t = switch_tag(t, "admission_date", fl["visitdates"], admit_text)
    t = switch_tag(t, "discharge_date", fl["visitdates"], disch_text)
    t = switch_tag(t, "dob", fl["age"] & fl["visitdates"], dob)
    fem = _c(key_gender) == "F"
    for tag, (f_word, m_word, off_word) in GENDER_TERMS.items():
        word = F.when(fem, F.lit(f_word)).otherwise(F.lit(m_word))
        t = switch_tag(t, tag, fl["gender"], word, off_value=off_word)
    t = switch_tag(t, "race", fl["race"], race)
    return F.concat(t, tail)


def swap_age(text, age, dob) -> Column:
    """Age and birth year swap (no ' year-old ' here)."""
    return set_tag(set_tag(text, "age", _c(age).cast("string")), "dob", _c(dob).cast("string"))


def swap_race(text, code) -> Column:
    """Race label set to the race name of a code (fixed code list)."""
    m = F.create_map(*[F.lit(x) for kv in RACE_CODES.items() for x in kv])
    return set_tag(text, "race", F.coalesce(F.element_at(m, _c(code)), _c(code)))


def strip_tags(text, known_tags_only: bool = False, tags: Sequence[str] = ()) -> Column:
    """Remove every ``<...>`` label. As in the study this also deletes
    free text between a real '<' and the next '>'; ``known_tags_only``
    removes only the labels named in ``tags``."""
    if known_tags_only:
        alt = "|".join(tags)
        return F.regexp_replace(_c(text), rf"</?(?:{alt})>", "")
    return F.regexp_replace(_c(text), r"<[^>]*>", "")


def find_sex(text) -> Column:
    """First letter after 'Sex:' (a label around the value is skipped);
    '' when there is none."""
    return F.regexp_extract(_c(text), r"Sex:\s*(?:<[^>/]*>)?\s*(\S)", 1)


# ---------------------------------------------------------------- names of runs

READABLE = {"address": "Address", "age": "Age", "gender": "Gender", "name": "Name",
            "visitdates": "Admission and Discharge Time", "race": "Race"}


def level_name(flags: dict) -> Column:
    """T14: '_' + names of the switches that are on, each followed by '_'."""
    parts = [F.when(_c(flags[a]) if not isinstance(flags[a], bool) else F.lit(flags[a]), F.lit(a + "_"))
             .otherwise(F.lit("")) for a in LEVEL_ATTRIBUTES]
    return F.concat(F.lit("_"), *parts)


def readable_level(name) -> Column:
    """T14 back: readable attribute list in the fixed display order, 'NONE'
    when no attribute is on."""
    n = _c(name)
    parts = F.array(*[F.when(F.instr(n, k) > 0, F.lit(v)) for k, v in READABLE.items()])
    joined = F.array_join(F.filter(parts, lambda x: x.isNotNull()), ", ")
    return F.when(F.regexp_replace(n, "_", "") == "", F.lit("NONE")).otherwise(joined)


def parse_variant(name) -> tuple[Column, Column, Column]:
    """T15: 'A_to_B_kind' -> (A, B, kind); without '_to_' the new group is the
    original one and the kind is empty ('race' for 'A_race', the unswapped
    notes of the explicit kind)."""
    n = _c(name)
    has_to = F.instr(n, "_to_") > 0
    orig = F.when(has_to, F.regexp_extract(n, r"^(.*?)_to_", 1)).otherwise(F.regexp_replace(n, "_race$", ""))
    rest = F.regexp_extract(n, r"_to_(.*)$", 1)
    kinds = r"(name_address|name|address|race)$"
    kind = F.when(has_to, F.regexp_extract(rest, "_" + kinds, 1)).otherwise(F.regexp_extract(n, "_(race)$", 1))
    new = F.when(has_to, F.regexp_replace(rest, "_" + kinds, "")).otherwise(orig)
    return orig, new, kind


def test_size_of(path) -> Column:
    """Test share from a path holding ``test<NN>`` (percent)."""
    return F.regexp_extract(_c(path), r"test_?(\d+)", 1).cast("double") / 100.0


def with_instruction(text, instruction: str | None, colon: bool = False) -> Column:
    """``Instruct: <I>\\nQuery:\\n<T>``; a blank instruction leaves the
    text alone. ``colon`` is the other encoder style: instruction with its
    final dots stripped and ':' added, then the text."""
    if instruction is None or instruction.strip() == "":
        return _c(text)
    if colon:
        ins = instruction if instruction.endswith(":") else instruction.strip(".") + ":"
        return F.concat(F.lit(ins), F.lit(" "), _c(text))
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery:\n"), _c(text))


# Tag order of the fill pass (values never contain '<', so the order only
# has to be fixed, not meaningful).
FILL_ORDER = ["name", "address", "age", "admission_date", "discharge_date", "dob",
              *GENDER_TERMS.keys(), "race"]


def fill_tags(text, values: dict) -> Column:
    """Set each tag in ``values`` (tag -> Column or column name) in one
    chain of rewrites (T7 per tag)."""
    t = _c(text)
    for tag in FILL_ORDER:
        if tag in values:
            t = set_tag(t, tag, values[tag])
    return t


def all_on_values(col, key_gender, race_on: bool = True) -> dict:
    """Tag values of a note with every attribute written in (as T8 with all
    switches on); ``col(name)`` returns the Column of an attribute."""
    from .dates import ts_text
    fem = _c(key_gender) == "F"
    v = {"name": col("name"), "address": col("address"),
         "age": F.concat(col("actual_age").cast("string"), F.lit(" year-old ")),
         "admission_date": ts_text(col("admittime_today")), "discharge_date": ts_text(col("dischtime_today")),
         "dob": col("dob").cast("string")}
    for tag, (fw, mw, _off) in GENDER_TERMS.items():
        v[tag] = F.when(fem, F.lit(fw)).otherwise(F.lit(mw))
    v["race"] = col("race") if race_on else F.lit("___")
    return v
