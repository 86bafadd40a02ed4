"""Free-text family: C5 (rules and hook), T19, T20 on ``documents`` and
``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as PR
from ..functions.hashing import sql_uniform
from ..functions.tags import with_instruction
from ..operators.sampling import random_parts
from ..sources.tables import table
from . import cohort as C
from . import sqltext as S
from .catalog import register
from .q_cohort import POOL_WITH
from .q_text import rowdigest, sql_rowdigest


def sql_tag_personal(t: str) -> str:
    for tag, pat in PR.PII_RULES:
        t = f"regexp_replace({t}, {S.q(pat)}, '<{tag}>\\0</{tag}>', 'g')"
    return f"regexp_replace({t}, {S.q(PR.AGE_RULE)}, '<age>\\1</age>\\2', 'g')"


def sql_template(template: str, values: dict[str, str]) -> str:
    parts = [S.q(p) if isinstance(p, str) else values[p[1]] for p in PR._pieces(template, list(values))]
    return "(" + " || ".join(parts) + ")"


@register("c5_tag_personal", sql_rowdigest(sql_tag_personal("text"), "doc_id") + " FROM documents")
def q_c5(spark, d):
    return rowdigest(table(spark, d, "documents"), PR.tag_personal("text"), "doc_id")


@register("c5_tag_personal_conversations", sql_rowdigest(sql_tag_personal("text"), "conv_id || '.' || turn")
          .replace("SELECT conv_id || '.' || turn,", "SELECT conv_id || '.' || turn AS turn_key,") + " FROM conversations")
def q_c5c(spark, d):
    c = table(spark, d, "conversations").withColumn("turn_key", F.concat_ws(".", "conv_id", "turn"))
    return rowdigest(c, PR.tag_personal("text"), "turn_key")


@register("c5_annotate_hook", sql_rowdigest(sql_tag_personal("text"), "doc_id") + " FROM documents")
def q_c5h(spark, d):
    """The plug-in path: the same rules run as a Python annotator inside the
    tasks (mapInPandas); its output must equal the SQL rules."""
    a = PR.annotate(table(spark, d, "documents"), "text", ["doc_id"])
    return rowdigest(a, F.col("annotated"), "doc_id")


INSTR = "Given a discharge note, estimate the risk of readmission within 30 days"


@register("t19_with_instruction", sql_rowdigest(S.q(f"Instruct: {INSTR}\nQuery:\n") + " || text", "doc_id")
          + " FROM documents")
def q_t19(spark, d):
    return rowdigest(table(spark, d, "documents"), with_instruction("text", INSTR), "doc_id")


@register("t19_with_instruction_colon", sql_rowdigest(S.q(INSTR + ": ") + " || text", "doc_id") + " FROM documents")
def q_t19c(spark, d):
    return rowdigest(table(spark, d, "documents"), with_instruction("text", INSTR, colon=True), "doc_id")


EXAMPLE = "labelled/example.txt"
_HEADER = "\n".join(PR.ANNOTATION_PROMPT_LINES).replace("{example_name}", EXAMPLE)
_FN = "'doc_' || CAST(doc_id AS VARCHAR) || '.txt'"


@register("t20_annotation_prompt", sql_rowdigest(
    sql_template(_HEADER, {"file_name": _FN}) + " || " + S.q("\n\n") + " || "
    + sql_template(PR.FILES_WRAPPER, {"file_name": _FN, "file_content": "text"}), "doc_id") + " FROM documents")
def q_t20(spark, d):
    docs = table(spark, d, "documents")
    fn = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return rowdigest(docs, PR.annotation_prompt(fn, F.col("text"), EXAMPLE), "doc_id")


@register("t20_generation_prompt", POOL_WITH + """,
parts AS (SELECT hadm_id, gender, actual_age, race,
                 CAST(ntile(41) OVER (ORDER BY """ + sql_uniform("hadm_id", "'0'") + """, hadm_id) AS INTEGER) AS part
          FROM cohort),
tabs AS (SELECT part, 'hadm_id,gender,actual_age,race' || chr(10) ||
                string_agg(CAST(hadm_id AS VARCHAR) || ',' || gender || ',' || CAST(actual_age AS VARCHAR) || ',' || race,
                           chr(10) ORDER BY hadm_id) AS csv FROM parts GROUP BY part)
""" + sql_rowdigest(S.q("\n".join(PR.GENERATION_PROMPT_LINES) + "\n\n") + " || " + sql_template(
    PR.FILES_WRAPPER, {"file_name": "'subgroup_' || CAST(part AS VARCHAR) || '.csv'", "file_content": "csv"}),
    "part") + " FROM tabs")
def q_t20g(spark, d):
    """Generation prompt per random part (W10) of the sampled cohort: the
    part's rows as CSV text. A part is bounded by the sample size."""
    parts = random_parts(C.build_cohort(spark, d), 41, "hadm_id", seed=0)
    line = F.concat_ws(",", F.col("hadm_id").cast("string"), "gender", F.col("actual_age").cast("string"), "race")
    tabs = parts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("hadm_id", line.alias("l")))).alias("rows"))
    csv = F.concat(F.lit("hadm_id,gender,actual_age,race\n"), F.array_join(F.transform("rows", lambda r: r["l"]), "\n"))
    fn = F.concat(F.lit("subgroup_"), F.col("part").cast("string"), F.lit(".csv"))
    return rowdigest(tabs, PR.generation_prompt(fn, csv), "part")
