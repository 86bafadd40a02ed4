"""Ranked lexical search by Block-Max MaxScore.

Documents are indexed in segments of at most ``SEGMENT_DOCS`` documents or about
``SEGMENT_POSTINGS`` postings, each built by the task that reads the texts (no shuffle of texts or
postings) and stored as one row: the documents' ids and lengths, and for each term a posting list in
blocks of ``BLOCK`` postings. Inside a segment documents are numbered by length, so the documents of
a block are of about the same length and its maximum - the score of its largest frequency in its
shortest document - is tight. A block keeps that maximum uncompressed; its document gaps and
frequencies are packed in the fewest bytes that hold them.

A segment is searched for all queries at once. With t the score of a query's k-th best document so
far (carried from segment to segment of a task):

- the lists are sorted by their global bound, the largest block maximum; those whose bounds add up to
  less than t are non-essential: a document in none but these can't be among the best;
- the essential lists are read and their scores added;
- the non-essential lists are taken from the largest bound down. A document goes as soon as its score
  and the bounds of the lists left are below t, and, with the block maximum in place of the list's
  bound, before its block is unpacked. Only blocks of documents that are left are unpacked.

Each task ends with a heap of k documents for each query; the heaps are merged by a window over at
most k rows a task and query. Scores are 64-bit integers as the weights below say, so no order
depends on rounding; equal scores go by ascending document id (none last).

Weights: N documents have a term, L terms with repeats. A term of df documents weighs
w = floor(1000 * ln((2N + 2) / (2 df + 1))); a document of n terms has m = 100 - 50 + (50 n N) div L
and a term of frequency tf scores w * (10^9 tf div (1000 tf + 20 m)).

Null and empty texts have no terms: such documents are not counted and never found, such queries find
nothing. Repeated documents are found each, repeated queries answered each; a document without an id
is found under a null id. Empty tables give no rows. Further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import ship, stage
from .registry import register

BEST = 50
BLOCK = 128
SEGMENT_DOCS = 16_384
SEGMENT_POSTINGS = 2_000_000
QUERY_BLOCK = 10_000  # queries that are searched in one job
TERMS_BYTES = 64 << 20  # asked-for terms that are sent to the tasks; beyond it all terms are indexed
WIDTHS = (np.uint8, np.uint16, np.uint32)
PART = 1 << 20  # characters of a text that are taken apart at once
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of terms, A-Z in lower case; all other bytes become a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SEGMENT = ("docs long, length long, terms array<binary>, df array<long>, first_block binary, ids binary, no_id binary, "
           "lengths binary, first binary, last binary, most binary, counts binary, widths binary, payload binary")
ship(__name__)


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """All terms of a text, in parts, as a very long text has very many."""
    at, text = 0, text or ""
    while at < len(text):
        end = at + PART
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].encode().translate(BYTES).split()
        at = end


class Numbered(dict):
    """Term -> number, in the order of first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Builder:
    """Collects the documents of one segment."""

    def __init__(self, asked: list[bytes] | None):
        self.asked = None if asked is None else {t: i for i, t in enumerate(asked)}
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbered() if self.asked is None else self.asked
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []  # rows (document, term, frequency)
        self.waiting: list[np.ndarray] = []
        self.first = self.postings = self.words = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        length, codes = 0, []
        for words in terms_of(text):
            length += len(words)
            number = map(self.numbers.__getitem__, words) if self.asked is None else map(self.numbers.get, words, repeat(-1))
            part = np.fromiter(number, np.int64, len(words))
            codes.append(part[part >= 0])
        if length:
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.waiting.append(np.concatenate(codes))
            self.words += length
            if self.words >= 1 << 19:
                self.count()

    def count(self) -> None:
        """Postings of the documents since the last call."""
        docs = np.repeat(np.arange(self.first, len(self.ids)), [len(w) for w in self.waiting])
        keys = np.concatenate([*self.waiting, np.empty(0, np.int64)]) << 32 | docs
        keys, tf = np.unique(keys, return_counts=True)
        self.parts.append(np.stack([keys & 0xFFFFFFFF, keys >> 32, tf]))
        self.postings += len(keys)
        self.waiting, self.first, self.words = [], len(self.ids), 0

    @property
    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def segment(self) -> tuple:
        """The columns of ``SEGMENT``."""
        self.count()
        docs, codes, tf = np.concatenate(self.parts, axis=1)
        lengths = np.array(self.lengths, np.int64)
        order = np.argsort(lengths, kind="stable")  # new number -> old
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        docs, lengths = place[docs], lengths[order]
        by = np.lexsort((docs, codes))
        docs, codes, tf = docs[by], codes[by], tf[by]
        terms, starts, df = np.unique(codes, return_index=True, return_counts=True)
        blocks = -(-df // BLOCK)
        inside = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(starts, blocks) + inside * BLOCK
        size = np.minimum(BLOCK, np.repeat(starts + df, blocks) - begin)
        first, last = docs[begin], docs[begin + size - 1]
        gaps = np.diff(docs, prepend=0)
        gaps[begin] = 0
        if len(begin):
            most, widest = np.maximum.reduceat(tf, begin), np.maximum.reduceat(gaps, begin)
        else:
            most = widest = np.empty(0, np.int64)
        wide = lambda x: (x >= 1 << 8).astype(np.uint8) + (x >= 1 << 16)  # noqa: E731  place in WIDTHS
        gap_width, tf_width = wide(widest), wide(most)
        payload = []
        for s, e, g, f in zip(begin.tolist(), (begin + size).tolist(), gap_width.tolist(), tf_width.tolist()):
            payload.append(gaps[s:e].astype(WIDTHS[g]).tobytes())
            payload.append(tf[s:e].astype(WIDTHS[f]).tobytes())
        ids, names = [self.ids[i] for i in order.tolist()], list(self.numbers)
        return (len(ids), int(lengths.sum()), [names[t] for t in terms.tolist()], df.tolist(),
                *(x.tobytes() for x in (np.cumsum(blocks) - blocks,
                                        np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]),
                                        lengths, first, last, most.astype(np.int64), size.astype(np.uint8),
                                        gap_width << 2 | tf_width)), b"".join(payload))


def build_index(docs: DataFrame, asked: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each segment; the postings of the asked-for terms, or of all."""
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), *[pa.binary()] * 10]
        names = [part.split()[0] for part in SEGMENT.split(", ")]
        one = lambda b: pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(b.segment(), kinds)], names=names)
        built = Builder(asked)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                built.add(doc_id, text.as_py())
                if built.full:
                    yield one(built)
                    built.clear()
        if built.ids:
            yield one(built)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SEGMENT)


class Segment:
    """A stored segment; blocks are unpacked when they are first needed."""

    def __init__(self, row: dict, total_docs: int, total_terms: int):
        of = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
        self.ids, self.no_id = of("ids"), of("no_id", np.bool_)
        lengths = of("lengths")
        if 50 * total_docs * int(lengths.max()) < 1 << 63:
            self.m = 50 + 50 * total_docs * lengths // total_terms
        else:
            self.m = np.array([50 + 50 * total_docs * n // total_terms for n in lengths.tolist()])
        self.number = {t: i for i, t in enumerate(row["terms"])}
        self.df, self.first_block = row["df"], of("first_block")
        self.first, self.last, self.counts = of("first"), of("last"), of("counts", np.uint8).astype(np.int64)
        widths = of("widths", np.uint8)
        self.gap_width, self.tf_width = widths >> 2, widths & 3
        sizes = self.counts * ((1 << self.gap_width.astype(np.int64)) + (1 << self.tf_width.astype(np.int64)))
        self.at = np.cumsum(sizes) - sizes
        self.payload = row["payload"]
        # documents are numbered by length: a block's first one is its shortest
        self.bound = self.score(of("most"), self.m[self.first])
        self.list_bound = np.maximum.reduceat(self.bound, self.first_block).tolist() if self.df else []
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)

    def blocks(self, t: int) -> range:
        return range(int(self.first_block[t]), int(self.first_block[t]) - (-self.df[t] // BLOCK))

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores (without the term's weight) of a block."""
        if b not in self.unpacked:
            n, at = int(self.counts[b]), int(self.at[b])
            gap, tf = WIDTHS[self.gap_width[b]], WIDTHS[self.tf_width[b]]
            docs = np.cumsum(np.frombuffer(self.payload, gap, n, at), dtype=np.int64) + self.first[b]
            tfs = np.frombuffer(self.payload, tf, n, at + n * gap().itemsize).astype(np.int64)
            self.unpacked[b] = docs, self.score(tfs, self.m[docs])
        return self.unpacked[b]

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t not in self.whole:
            found = [self.block(b) for b in self.blocks(t)]
            self.whole[t] = np.concatenate([d for d, _ in found]), np.concatenate([s for _, s in found])
        return self.whole[t]


class Best:
    """The best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.threshold = k, 0
        self.scores = np.empty(0, np.int64)
        self.ids, self.no_id = self.scores, np.empty(0, np.bool_)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        scores, ids, no_id = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.no_id, no_id)))
        best = np.lexsort((ids, no_id, -scores))[:self.k]
        self.scores, self.ids, self.no_id = scores[best], ids[best], no_id[best]
        if len(best) == self.k:
            self.threshold = int(self.scores[-1])


def search(segment: Segment, query: list[tuple[bytes, int]], best: Best, read: set | None = None) -> None:
    """Block-Max MaxScore of one query over one segment; ``read`` gets the blocks it needed."""
    lists = [(segment.number[t], w) for t, w in query if t in segment.number and w > 0]
    if not lists:
        return
    bounds = [w * segment.list_bound[t] for t, w in lists]
    order = sorted(range(len(lists)), key=bounds.__getitem__)
    lists, upto = [lists[i] for i in order], np.cumsum([bounds[i] for i in order]).tolist()
    essential = next((i for i, u in enumerate(upto) if u >= best.threshold), None)
    if essential is None:
        return
    total = np.zeros(len(segment.ids), np.int64)
    for t, w in lists[essential:]:
        docs, scores = segment.postings(t)
        total[docs] += w * scores
        if read is not None:
            read.update(segment.blocks(t))
    docs = np.flatnonzero(total)
    threshold = best.threshold
    if len(docs) > best.k:  # what the documents have by now is a bound from below
        threshold = max(threshold, int(np.partition(total[docs], -best.k)[-best.k]))
    for i in range(essential - 1, -1, -1):
        docs = docs[total[docs] + upto[i] >= threshold]
        if not len(docs):
            return
        t, w = lists[i]
        blocks = segment.blocks(t)
        b = blocks.start + np.searchsorted(segment.last[blocks.start:blocks.stop], docs)
        inside = b < blocks.stop
        inside[inside] = segment.first[b[inside]] <= docs[inside]
        most = np.zeros(len(docs), np.int64)
        most[inside] = w * segment.bound[b[inside]]
        stay = total[docs] + most + (upto[i - 1] if i else 0) >= threshold
        docs, needed = docs[stay], np.unique(b[stay & inside]).tolist()
        left = np.zeros(len(total), np.bool_)
        left[docs] = True
        for one in needed:
            have, scores = segment.block(one)
            known = left[have]
            total[have[known]] += w * scores[known]
        if read is not None:
            read.update(needed)
    docs = docs[total[docs] >= max(threshold, 1)]
    best.add(total[docs], segment.ids[docs], segment.no_id[docs])


def found_in(index: DataFrame, queries: list[tuple[int, list[tuple[bytes, int]]]], total_docs: int, total_terms: int,
             k: int) -> DataFrame:
    """``(query, doc_id, score)``: the heaps of all tasks."""
    def run(batches):
        import pyarrow as pa

        heaps = {q: Best(k) for q, _ in queries}
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], total_docs, total_terms)
                for q, terms in queries:
                    search(segment, terms, heaps[q])
        heaps = {q: h for q, h in heaps.items() if len(h.scores)}
        if heaps:
            n = [len(h.scores) for h in heaps.values()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(list(heaps), n), pa.int64()),
                pa.array(np.concatenate([h.ids for h in heaps.values()]), pa.int64(),
                         mask=np.concatenate([h.no_id for h in heaps.values()])),
                pa.array(np.concatenate([h.scores for h in heaps.values()]), pa.int64())], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")


def query_terms(text: Column) -> Column:
    """The distinct terms of a text, as bytes."""
    ascii_only = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.array_distinct(F.regexp_extract_all(ascii_only, F.lit(TERM), F.lit(0))), lambda t: t.cast("binary"))


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", terms_bytes: int = TERMS_BYTES,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item.

    The items' distinct terms are sent to the indexing tasks while they have at most ``terms_bytes``
    bytes; else all terms are indexed. Queries are searched ``query_block`` at a time."""
    spark = docs.sparkSession
    asked = stage(items.select(F.monotonically_increasing_id().alias("query"), F.col(item_id_col).alias("item_id"),
                               query_terms(F.col(item_text_col)).alias("terms")), "search-items")
    each = asked.select("query", F.explode("terms").alias("term"))
    terms = stage(each.select("term").distinct(), "search-terms")
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    known = sorted(bytes(r.term) for r in terms.collect()) if size <= terms_bytes else None
    index = stage(build_index(docs, known, id_col, text_col), "search-index")
    total = index.agg(F.sum("docs").alias("n"), F.sum("length").alias("l")).first()
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    if total.n and size:
        df = (index.select(F.explode(F.arrays_zip("terms", "df")).alias("t"))
              .groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df")))
        weight = F.floor(1000 * F.log((2 * F.lit(total.n) + 2) / (2 * F.col("df") + 1))).cast("long")
        weighed = stage(each.join(df.select("term", weight.alias("w")), "term").groupBy("query")
                        .agg(F.collect_list(F.struct("term", "w")).alias("terms")), "search-queries")
        blocks = -(-weighed.count() // query_block)
        block = F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1)))
        for b in range(blocks):
            queries = [(r.query, sorted((bytes(t.term), t.w) for t in r.terms)) for r in weighed.where(block == b).collect()]
            found = found.unionByName(stage(found_in(index, queries, total.n, total.l, k), "search-heaps"))
    place = F.expr("row_number() over (partition by query order by score desc, doc_id asc nulls last)")
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t, row_number() over () as r from documents),
i as (select item_id, row_number() over () as q, list_distinct(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
s as (select cast(count(*) as bigint) as n, cast(sum(len(t)) as bigint) as l from d where len(t) > 0),
p as (select r, doc_id, cast(len as bigint) as n, term, cast(count(*) as bigint) as tf
      from (select r, doc_id, len(t) as len, unnest(t) as term from d) group by all),
w as (select term, cast(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) as bigint) as w from p, s group by term),
x as (select q, item_id, unnest(t) as term from i),
c as (select q, item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * s.n) // s.l)))) as bigint) as score
      from x join p using (term) join w using (term), s group by q, item_id, r, doc_id),
k as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from c where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from k where rank <= 50
"""


@register("op13_block_max_search", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
