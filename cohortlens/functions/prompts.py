"""Prompt building (T20) and the rule-based personal-data tagger.

The study sends each note to a chat model that writes the labels; that
service is not part of this engine. What remains is (a) the prompt table,
built as a column so a user can send it with their own client, and (b) a
rule-based tagger over a text column, plus a plug-in hook for a user's own
annotator (``annotate``)."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# ---------------------------------------------------------------- FIXED VALUES
# Prompt texts of the study (annotation of a note; name and address
# generation for a table of patients). '{example_name}' and '{file_name}'
# are filled in; line ends are part of the text.
ANNOTATION_PROMPT_LINES = [
    "Please indicate all pieces of personal identifying information of the below listed categories:",
    "",
    "<name> (referring only to the patient)",
    "<admission_date> (**only once in the beginning**)",
    "<discharge_date> (**only once in the beginning**)",
    "<dob> (**only once in the beginning**)",
    "<age> (referring only to the patient's current age, explicit and including some form of \"year old\" or as "
    "a general description e.g. \"elderly\" , \"middle-aged\", \"young\") ",
    "<sex> (**only in the beginning**) ",
    "<pronoun_subject> (only \"she\" or \"he\") ",
    "<pronoun_object> (only \"her\" or \"him\") ",
    "<pronoun_possessive> (only \"his\" or \"her\") ",
    "<pronoun_reflexive> (only \"himself\" or \"herself\") ",
    "<form_of_address> (e.g. \"Mr.\", \"Ms.\") ",
    "<gendered_noun> (describes the patients gender, e.g. \"M\", \"F\", \"male\", \"female\", \"man\", \"woman\", "
    "\"gentleman\", \"lady\") ",
    "<race> (describes the patients race, e.g. \"black\", \"white\", \"caucasian\", \"asian\", \"hispanic\") ",
    "<spouse> (e.g. \"wife\", \"husband\")",
    "<child> (e.g. \"son\", \"daughter\", \"grandchild\", possibly plural)",
    "<discharge_instructions> (speaks directly to the patient, at the end of the document)",
    "<facility> (referring only to the current, anonymized hospital, named directly or inside a greeting like "
    "\"your ___ care team\") ",
    "<attending> (**only once in the beginning**)",
    "",
    "If not mentioned otherwise, this information can appear multiple times anywhere in the text,",
    "pay close attention throughout the whole document and inspect the context of each annotation.",
    "Placeholders ___ at the beginning of the text should **always** be annotated with the appropriate label.",
    "",
    "Use xml tags and refer to the following examples:",
    "",
    "{example_name}",
    "",
    "Repeat the entire document {file_name} **verbatim** with all the xml annotations included, don't alter",
    "the text in any other way.",
    "",
]
GENERATION_PROMPT_LINES = [
    "",
    "Give a name and a US address for every person in this table,",
    "make sure name and address are plausible for the given age and race in each row.",
    "Output them in CSV format and don't change the information in the table,",
    "just add a column each for name and address (put them in quotation marks if need be).",
    "",
]
FILES_WRAPPER = "<FILES>\n<FILE_NAME>\n{file_name}\n</FILE_NAME>\n<FILE_CONTENT>\n\n{file_content}\n\n</FILE_CONTENT>\n</FILES>\n"

# Personal-data rules of the built-in tagger (ours): tag -> pattern, applied
# in this order; the age rule keeps the words after the number outside.
PII_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"\+?\d{1,2} ?\(\d{3}\) ?\d{3}-\d{4}"),
    ("ip", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("card", r"\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}"),
    ("date", r"\d{4}-\d{2}-\d{2}"),
]
AGE_RULE = r"(\d{1,3})( years? old| year-old| y/?o)"
# ------------------------------------------------------------ END FIXED VALUES


def _pieces(template: str, names: Sequence[str]) -> list:
    """Split a template at '{name}' placeholders: str pieces and names."""
    out, rest = [], template
    pat = re.compile("{(" + "|".join(names) + ")}")
    while True:
        m = pat.search(rest)
        if not m:
            out.append(rest)
            return out
        out += [rest[:m.start()], ("col", m.group(1))]
        rest = rest[m.end():]


def _render(template: str, values: dict[str, Column]) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else values[p[1]] for p in _pieces(template, list(values))]
    return F.concat(*parts)


def annotation_prompt(file_name: Column, content: Column, example_name: str,
                      example_annotated: str | None = None) -> Column:
    """The annotation prompt of one file: header, optional example,
    then the file block."""
    header = "\n".join(ANNOTATION_PROMPT_LINES).replace("{example_name}", example_name)
    head = _render(header, {"file_name": file_name})
    files = _render(FILES_WRAPPER, {"file_name": file_name, "file_content": content})
    mid = F.lit("\n\n" + example_annotated + "\n\n") if example_annotated else F.lit("\n\n")
    return F.concat(head, mid, files)


def generation_prompt(file_name: Column, table_csv: Column, example: str | None = None) -> Column:
    """The name/address generation prompt for one table (CSV text), an
    optional example between header and table."""
    header = "\n".join(GENERATION_PROMPT_LINES)
    if example:
        header += "\n\n" + example
    return F.concat(F.lit(header + "\n\n"), _render(FILES_WRAPPER, {"file_name": file_name, "file_content": table_csv}))


def tag_personal(text, rules=PII_RULES, age: bool = True) -> Column:
    """Wrap personal data found by ``rules`` in labels
    (``<email>..</email>`` and so on), one projection of regex rewrites."""
    t = F.col(text) if isinstance(text, str) else text
    for tag, pat in rules:
        t = F.regexp_replace(t, pat, f"<{tag}>$0</{tag}>")
    if age:
        t = F.regexp_replace(t, AGE_RULE, "<age>$1</age>$2")
    return t


def python_tagger(texts: list) -> list:
    """The same rules in Python ``re`` (a small per-batch helper, used as a
    default plug-in for :func:`annotate`)."""
    comp = [(tag, re.compile(p, re.ASCII)) for tag, p in PII_RULES]
    age = re.compile(AGE_RULE, re.ASCII)
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        for tag, p in comp:
            t = p.sub(lambda m, tag=tag: f"<{tag}>{m.group(0)}</{tag}>", t)
        out.append(age.sub(lambda m: f"<age>{m.group(1)}</age>{m.group(2)}", t))
    return out


def annotate(df: DataFrame, text_col: str, keys: Sequence[str], fn: Callable[[list], list] | None = None,
             out: str = "annotated", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """C5 hook: run a user annotator ``fn(list[str]) -> list[str]`` over
    Arrow batches inside the tasks (``mapInPandas``). A failing batch is
    retried ``tries`` times with growing waits; if it still fails its rows
    get null (the study skips such files)."""
    fn = fn or python_tagger
    keys = list(keys)
    in_df = df.select(*keys, F.col(text_col).alias("__text"))
    schema = StructType([*[f for f in in_df.schema.fields if f.name in keys], StructField(out, StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            res = None
            for k in range(tries):
                try:
                    res = fn(b["__text"].tolist())
                    break
                except Exception:  # noqa: BLE001 - a plug-in may fail in any way
                    time.sleep(wait * (k + 1))
            o = b[keys].copy()
            o[out] = res if res is not None else [None] * len(b)
            yield o
    return in_df.mapInPandas(run, schema)
