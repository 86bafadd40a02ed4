"""DuckDB text of the tag functions, for oracle queries only.

RE2 has no look-ahead, so the two checks that use one in Spark (names,
pronouns) protect the kept labels with control-character sentinels, strip
the rest and restore. Replacement strings use ``\\1`` back references."""

from __future__ import annotations

from ..functions.codes import (GENDER_TERMS, KEPT_PRONOUNS, LEVEL_ATTRIBUTES, TEMPLATE_F, TEMPLATE_M,
                               YEAR_OLD_FORMS)
from ..functions.hashing import sql_uniform


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def esc(v: str) -> str:
    return f"replace(CAST({v} AS VARCHAR), '\\', '\\\\')"


def head(t: str, g: str) -> str:
    return (f"regexp_replace({t}, '(?s)^(.*)</sex>', CASE WHEN {g} = 'F' THEN {q(TEMPLATE_F)} "
            f"ELSE {q(TEMPLATE_M)} END)")


def names(t: str) -> str:
    return (f"replace(regexp_replace(replace({t}, '<name>___</name>', chr(1)), '<name>([^<]*)</name>', '\\1', 'g'),"
            f" chr(1), '<name>___</name>')")


def pronouns(t: str) -> str:
    words = "|".join(KEPT_PRONOUNS)
    protect = (f"regexp_replace({t}, '<((?i:pronoun_)[^>]*>)({words})</((?i:pronoun_)[^>]*>)', "
               f"chr(1) || '\\1\\2' || chr(2) || '\\3', 'g')")
    strip = f"regexp_replace({protect}, '(?i)<pronoun_[^>]*>([^<]*)</pronoun_[^>]*>', '\\1', 'g')"
    return f"replace(replace({strip}, chr(1), '<'), chr(2), '</')"


def year_old(t: str) -> str:
    return f"regexp_replace({t}, '(?i)(<age>[^<]*</age> )(?:{YEAR_OLD_FORMS})', '\\1', 'g')"


def normalise(t: str, g: str) -> str:
    return year_old(pronouns(names(head(t, g))))


def set_tag(t: str, tag: str, v: str) -> str:
    return f"regexp_replace({t}, '<{tag}>[^<]*</{tag}>', '<{tag}>' || {esc(v)} || '</{tag}>', 'g')"


def switch_tag(t: str, tag: str, on: str, v: str, off: str = "___") -> str:
    return (f"regexp_replace({t}, '<{tag}>[^<]*</{tag}>', CASE WHEN {on} THEN '<{tag}>' || {esc(v)} || '</{tag}>' "
            f"ELSE {q(f'<{tag}>{off}</{tag}>')} END, 'g')")


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def switch_info(t: str, fl: dict[str, str], g: str = "gender") -> str:
    t = switch_tag(t, "name", fl["name"], "name")
    t = switch_tag(t, "address", fl["address"], "address")
    t = switch_tag(t, "age", fl["age"], "CAST(actual_age AS VARCHAR) || ' year-old '")
    t = switch_tag(t, "admission_date", fl["visitdates"], ts("admittime_today"))
    t = switch_tag(t, "discharge_date", fl["visitdates"], ts("dischtime_today"))
    t = switch_tag(t, "dob", f"({fl['age']}) AND ({fl['visitdates']})", "dob")
    for tag, (fw, mw, off) in GENDER_TERMS.items():
        t = switch_tag(t, tag, fl["gender"], f"CASE WHEN {g} = 'F' THEN {q(fw)} ELSE {q(mw)} END", off)
    t = switch_tag(t, "race", fl["race"], "race")
    return t


def strip(t: str) -> str:
    return f"regexp_replace({t}, '<[^>]*>', '', 'g')"


def insert(t: str, tag: str, v: str, pos: int = len(TEMPLATE_F) + 1) -> str:
    return (f"(substr({t}, 1, {pos}) || '{tag}: <{tag}>' || CAST({v} AS VARCHAR) || '</{tag}>' || "
            f"substr({t}, {pos + 1}))")


def md5_32(t: str) -> str:
    return f"('0x' || substr(md5({t}), 1, 8))::BIGINT"


def digest(t: str, keys: str) -> str:
    return (f"SELECT {keys}, count(*) AS n_rows, CAST(sum(length({t})) AS BIGINT) AS n_chars, "
            f"CAST(sum({md5_32(t)}) AS BIGINT) AS md5_sum")


def flags_on(col_prefix: str = "f_") -> dict[str, str]:
    return {a: f"{col_prefix}{a}" for a in LEVEL_ATTRIBUTES}


def split_sql(src: str, group: str = "abbrev", label: str = "thirty_day_readmission", test_size: float = 0.5,
              seed: int = 42, out: str = "splits") -> str:
    """CTEs for the stratified split (P4) of ``src``, ending in ``out``
    (hadm_id, split)."""
    u = sql_uniform("hadm_id", f"'{seed}'")
    return f"""
sp0 AS (SELECT hadm_id, {group} AS grp, {label} AS y, {u} AS u FROM {src}),
sp_cnt AS (SELECT grp, y, count(*) AS nc FROM sp0 GROUP BY grp, y),
sp_q1 AS (SELECT *, sum(nc) OVER (PARTITION BY grp) AS n FROM sp_cnt),
sp_q2 AS (SELECT *, n - ceil(CAST({test_size} AS DOUBLE) * n) AS ntrain FROM sp_q1),
sp_q3 AS (SELECT *, floor(ntrain * nc / n) AS fl, ntrain * nc / n - floor(ntrain * nc / n) AS rem FROM sp_q2),
sp_q4 AS (SELECT *, ntrain - sum(fl) OVER (PARTITION BY grp) AS lft,
                 row_number() OVER (PARTITION BY grp ORDER BY rem DESC, y) AS rk FROM sp_q3),
sp_quota AS (SELECT grp, y, fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM sp_q4),
{out} AS (SELECT s.hadm_id, CASE WHEN row_number() OVER (PARTITION BY s.grp, s.y ORDER BY s.u, s.hadm_id)
                              <= q.quota THEN 'train' ELSE 'test' END AS split
          FROM sp0 s JOIN sp_quota q ON s.grp = q.grp AND s.y = q.y)"""
