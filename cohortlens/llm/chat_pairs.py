"""Preference pairs for chat training (DataFrame functions only).

A pair is a chosen and a rejected conversation. Their longest common beginning of equal turns (role
and text) is rendered once, as the prompt; the turns behind it are the two completions, each with a
mask: the character spans ``first-last`` (last excluded) that are trained on, which are the
assistant's words with their end sign. All else (headers, the user's turns) is masked out.

The turns of a conversation are gathered in one row, in the order of turn, role and text: a
conversation is one training example and has to fit in memory. Pairs are rows, so a first turn that
many conversations share, or a conversation with many copies, meets nothing.

A null role or text is an empty one, a null turn number comes first. Rows without a conversation id
belong to no conversation. Repeated turns stay repeated. If one side is the beginning of the other,
its completion is empty, and of two equal conversations both are. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import let, shifted
from .registry import register

TRAINED = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)`` with an array of ``(role, text)``."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id"))
            .agg(F.sort_array(F.collect_list(one)).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))


def weaker(turns: Column) -> Column:
    """A rejected counterpart of a conversation: every later answer repeats the first one, and an
    only answer breaks off half way."""
    answers = F.filter(turns, lambda t: t["role"] == TRAINED)

    def half(text: Column) -> Column:
        return let(F.split(text, " "), lambda w: F.array_join(F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")), " "))

    def swapped(a: Column) -> Column:
        put = F.when(F.size(a) == 1, half(F.get(a, F.lit(0))["text"])).otherwise(F.get(a, F.lit(0))["text"])
        return let(put, lambda p: F.transform(turns, lambda t: F.struct(
            t["role"].alias("role"), F.when(t["role"] == TRAINED, p).otherwise(t["text"]).alias("text"))))
    return let(answers, swapped)


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def mask(turns: Column) -> Column:
    """``first-last`` of each trained span of the rendered turns, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        first = state["at"] + F.char_length(header(t))
        last = first + F.char_length(body(t))
        span = F.concat_ws("-", first.cast("string"), last.cast("string"))
        return F.struct(last.alias("at"), F.when(t["role"] == TRAINED, F.array_append(state["spans"], span))
                        .otherwise(state["spans"]).alias("spans"))
    return F.array_join(F.aggregate(turns, start, add)["spans"], ",")


def common_turns(a: Column, b: Column) -> Column:
    """Number of equal turns at the beginning of both."""
    least = F.least(F.size(a), F.size(b))
    differs = F.transform(F.slice(a, F.lit(1), least), lambda t, i: F.when(t != F.get(b, i), i))
    return F.coalesce(F.array_min(differs), least)


def preference_pairs(pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask)`` from the arrays of
    turns ``chosen`` and ``rejected`` of each row."""
    cut = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: shifted(F.col(c), F.col("n_common"), F.col("n_common"))
    cut = cut.select(id_col, "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("shared"),
                     rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return cut.select(id_col, F.col("n_common").cast("long").alias("n_common"), rendered(F.col("shared")).alias("prompt"),
                      *[f(F.col(c)).alias(n) for c in ("chosen", "rejected") for f, n in ((rendered, c), (mask, f"{c}_mask"))])


_SQL = """
with c as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
        order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as c from conversations where conv_id is not null group by conv_id),
a as (select *, list_filter(c, lambda t: t.role = 'assistant') as a from c),
p as (select *, case when len(a) = 1 then array_to_string(string_split(a[1].text, ' ')[1:len(string_split(a[1].text, ' ')) // 2], ' ')
        else a[1].text end as p from a),
b as (select *, list_transform(c, lambda t: {'role': t.role, 'text': case when t.role = 'assistant' then p else t.text end}) as r from p),
n as (select *, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i] <> r[i])) - 1, len(c)) as n from b),
s as (select conv_id, n, c[1:n] as m, c[n + 1:] as c, r[n + 1:] as r from n),
x as (select conv_id, n, list_transform(m, lambda t: '<|' || t.role || '|>\n' || t.text || '<|end|>\n') as m,
        list_transform(c, lambda t: '<|' || t.role || '|>\n') as ch, list_transform(c, lambda t: t.text || '<|end|>\n') as cb, c,
        list_transform(r, lambda t: '<|' || t.role || '|>\n') as rh, list_transform(r, lambda t: t.text || '<|end|>\n') as rb, r from s),
e as (select *, list_transform(range(1, len(c) + 1), lambda i: length(array_to_string(ch[1:i], '') || array_to_string(cb[1:i], ''))) as ce,
        list_transform(range(1, len(r) + 1), lambda i: length(array_to_string(rh[1:i], '') || array_to_string(rb[1:i], ''))) as re from x)
select conv_id, cast(n as bigint) as n_common, array_to_string(m, '') as prompt,
    array_to_string(list_transform(range(1, len(c) + 1), lambda i: ch[i] || cb[i]), '') as chosen,
    array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'),
        lambda i: (ce[i] - length(cb[i])) || '-' || ce[i]), ',') as chosen_mask,
    array_to_string(list_transform(range(1, len(r) + 1), lambda i: rh[i] || rb[i]), '') as rejected,
    array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'),
        lambda i: (re[i] - length(rb[i])) || '-' || re[i]), ',') as rejected_mask
from e
"""


@register("op1_preference_pairs", _SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against its weaker counterpart: the table has no rejected ones."""
    found = conversations(table(spark, sf_dir, "conversations"))
    return preference_pairs(found.select("conv_id", F.col("turns").alias("chosen"), weaker(F.col("turns")).alias("rejected")))
