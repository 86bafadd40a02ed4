"""Benchmark decontamination by winnowing (DataFrame functions only).

Both sides hash all word k-grams and keep, in each window of consecutive k-grams, the smallest
hash; with k = 5 and six k-grams a window, a window is a span of ten words, and two texts that share
such a span keep an equal hash in it. Neighbouring windows with one minimum are one fingerprint. The
documents' fingerprints are joined with the benchmark's by hash, and each hit is extended to the
spans that keep it; these are compared word for word with the benchmark's spans, of which each
different one has the set of items that hold it. Hit spans of a longer run overlap, so their union is
the whole run. Items shorter than a span are one window: for each such length (at most nine) the
documents' k-grams of that length are all kept.

A fingerprint is a hash and two places; it carries no words. Texts with a hit meet their words again,
each different text once, and texts are not shuffled but for these: their keys are broadcast when
their counted number is within ``BROADCAST_IDS`` (else all texts are shuffled once). The benchmark's
hashes (16 bytes each) are broadcast when their counted number is within ``BROADCAST_ROWS``, else
joined by a shuffle.

Null and empty texts have no words: no hit, no items. Items without words are no items; an item
without an id makes words hit but is not counted. Repeated rows give a row each. An empty benchmark
gives no hits, empty documents no rows. Further columns of either table are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import broadcast_if_small, let, shifted, stage, whole_rows
from .registry import register

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
BROADCAST_ROWS = 1_000_000
BROADCAST_IDS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z only; ``lower`` does the same, faster, where a text is all ASCII."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def grams(hashes: Column, k: int) -> Column:
    """Hashes of all k-grams of an array of word hashes (a lambda variable)."""
    return F.transform(shifted(hashes, 0, k - 1), lambda x, i: F.xxhash64(
        F.lit(k), x, *[hashes[i + n] for n in range(1, k)]))


def window_minima(values: Column, width: int) -> Column:
    """Minimum of each ``width`` consecutive values, by doubling."""
    def next_to(step: int):
        return lambda v: F.zip_with(shifted(v, 0, step), shifted(v, step, step), lambda a, b: F.least(a, b))

    have = 1
    while have < width:
        step = min(have, width - have)
        values = let(values, next_to(step))
        have += step
    return values


def kept(values: Column, width: int) -> Column:
    """Runs of windows with one minimum: ``(from, to, hash)``; the k-grams at places ``from`` to
    ``to`` that have this hash are the kept ones."""
    def runs(minima: Column) -> Column:
        firsts = F.filter(F.transform(minima, lambda m, i: F.when(
            (i == 0) | (minima[F.greatest(i - 1, F.lit(0))] != m), F.struct(i.alias("at"), m.alias("hash")))),
            lambda x: x.isNotNull())
        return let(firsts, lambda f: F.transform(f, lambda x, i: F.struct(
            x["at"].alias("from"),
            (F.coalesce(F.get(f, i + 1)["at"], F.size(minima)) + width - 2).alias("to"),
            x["hash"].alias("hash"))))
    return let(window_minima(values, width), runs)


def fingerprints(words: Column, span: int, short: list[int]) -> Column:
    """All kept k-grams of a text: ``(k, from, to, hash)``."""
    k = (span + 1) // 2

    def every(h: Column, s: int) -> Column:
        return F.transform(grams(h, s), lambda g, i: F.struct(
            F.lit(s).alias("k"), i.alias("from"), i.alias("to"), g.alias("hash")))

    def of(h: Column) -> Column:
        long = F.when(F.size(h) >= span, F.transform(
            kept(grams(h, k), span - k + 1), lambda r: F.struct(F.lit(k).alias("k"), r["from"], r["to"], r["hash"])))
        parts = [F.coalesce(long, F.array().cast("array<struct<k:int,from:int,to:int,hash:bigint>>"))]
        return F.concat(*parts, *[every(h, s) for s in short])
    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def read_words(table: DataFrame, text_col: str, span: int, short: list[int], *keep: Column) -> DataFrame:
    """``keep``, the number of words and the fingerprints of each row."""
    return table.select(*keep, let(words_of(F.col(text_col)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), fingerprints(w, span, short).alias("prints"))).alias("read"))


def spans_at(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def benchmark_spans(items: DataFrame, span: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """``(hash, k)`` of all kept k-grams of the items, ``(length, span, items)`` of their different
    spans with the ids of the items that hold them, and the lengths of items shorter than a span."""
    base = stage(items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
                 .where(F.size("words") > 0).distinct(), "benchmark")
    length = F.least(F.size("words"), F.lit(span))
    short = sorted(r[0] for r in base.where(F.size("words") < span)
                   .select(F.size("words")).distinct().collect())  # at most span - 1 numbers
    prints = base.select(length.alias("length"), F.explode(fingerprints(F.col("words"), span, short)).alias("r"))
    own = F.when(F.col("length") < span, F.col("length")).otherwise(F.lit((span + 1) // 2))
    hashes = prints.where(F.col("r.k") == own).select(F.col("r.hash").alias("hash"), F.col("r.k").alias("k")).distinct()
    starts = F.sequence(F.lit(0), F.size("words") - length)
    each = base.select("item_id", length.alias("length"), F.explode(F.transform(
        starts, lambda i: spans_at(F.col("words"), i, length))).alias("span"))
    spans = each.groupBy("length", "span").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return stage(hashes, "benchmark-hashes"), stage(spans, "benchmark-spans"), short


def hit_spans(docs: DataFrame, hits: DataFrame, spans: DataFrame, span: int, text_col: str) -> DataFrame:
    """``(text_key, hit, items)``: the places of the hit spans of each text that has a fingerprint
    among ``hits(text_key, k, from, to)``, and their items."""
    k = (span + 1) // 2
    by_text = stage(hits.groupBy("text_key").agg(F.collect_set(F.struct("k", "from", "to")).alias("hits")), "contaminated-texts")
    text = F.col(text_col)
    keys = broadcast_if_small(by_text.select(F.col("text_key").alias("key")), by_text.count(), BROADCAST_IDS)
    texts = (docs.select(key_of(text).alias("key"), text.alias("text")).join(keys, "key", "left_semi").dropDuplicates(["key"])
             .join(by_text.select(F.col("text_key").alias("key"), "hits"), "key").select("key", "hits", words_of(F.col("text")).alias("words")))
    # the windows of a fingerprint begin at its first place and end at its last one
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.when(
        h["k"] == k, F.transform(F.sequence(h["from"], h["to"] - (span - k)), lambda i: F.struct(i.alias("start"), F.lit(span).alias("length")))).otherwise(
        F.transform(F.sequence(h["from"], h["to"]), lambda i: F.struct(i.alias("start"), h["k"].alias("length")))))))
    some = texts.select("key", F.explode(F.transform(starts, lambda x: F.struct(
        x["start"].alias("start"), x["length"].alias("length"),
        spans_at(F.col("words"), x["start"], x["length"]).alias("span")))).alias("x")).select("key", "x.*")
    return (some.join(spans, ["length", "span"])
            .groupBy("key").agg(F.collect_set(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("length") - 1).alias("hi"))).alias("hit"),
                                F.collect_set("items").alias("items"))
            .select(F.col("key").alias("text_key"), "hit", F.sort_array(F.array_distinct(F.flatten("items"))).alias("items")))


def key_of(text: Column) -> Column:
    """Equal for equal texts; null and empty ones are equal."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row ``(doc_id, text_key, n_words, n_hit, n_items, items, contaminated)``; a word is hit if
    it lies inside a run of ``span`` words (or all words of a shorter item) of an item."""
    hashes, spans, short = benchmark_spans(items, span, item_id_col, item_text_col)
    hashes = broadcast_if_small(hashes.withColumn("found", F.lit(True)), hashes.count(), broadcast_rows)
    read = read_words(docs, text_col, span, short, F.col(id_col).alias("doc_id"), key_of(F.col(text_col)).alias("text_key"))
    # one fingerprint more for each row, which finds no partner: it keeps the row and its number of words
    row = F.array(F.struct(F.lit(0).alias("k"), F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.xxhash64("text_key").alias("hash")))
    prints = (read.select("doc_id", "text_key", F.col("read.n_words").alias("n_words"), F.explode(F.concat(row, "read.prints")).alias("r"))
              .select("doc_id", "text_key", "n_words", "r.*"))
    met = stage(prints.join(hashes, ["hash", "k"], "left").where("k = 0 or found").drop("hash", "found"), "document-prints")
    hits = met.where("k > 0").select("text_key", "k", "from", "to").distinct()
    found = hit_spans(docs, hits, spans, span, text_col)
    union = F.aggregate(
        F.sort_array("hit"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("last")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], a["last"] + 1) + 1))
                              .cast("long").alias("n"), F.greatest(a["last"], s["hi"]).alias("last")))["n"]
    found = stage(found.select("text_key", union.alias("n_hit"), "items"), "contaminated")
    return (met.where("k = 0").join(found, "text_key", "left")
            .select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit word, all columns as they were."""
    found = stage(contamination(docs, items, span, id_col, text_col).where("contaminated")
                  .select("text_key").distinct(), "contaminated-keys")
    return whole_rows(docs, text_key=key_of(F.col(text_col))).join(broadcast_if_small(found, found.count(), BROADCAST_IDS), "text_key", "left_anti").select("row.*")


_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as k,
        unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
            lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) as g from i where len(w) > 0),
dw as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as p,
        unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) as g
        from d, (select distinct k from iw)),
hit as (select doc_id, dw.k, p, item_id from dw join iw on dw.k = iw.k and dw.g = iw.g),
h as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + k)) as x from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s
        from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join it using (doc_id)
"""


@register("op9_benchmark_decontamination", _SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
