"""Best-fit packing of token pieces by linear grouping.

A piece is at most ``capacity`` tokens long, so all that a plan needs to know is the histogram of
lengths, at most ``capacity`` numbers whatever the number of documents. The plan is made from it:

1. Full pieces are sequences of their own.
2. The large lengths are sorted and cut into ``GROUPS`` groups of equal cardinality, each rounded up
   to its largest length (linear grouping). How often to use which configuration of the few rounded
   sizes is a linear programme over patterns, solved by column generation, and rounded down.
3. The groups' actual pieces take the places of the rounded ones, longest first; what the rounded
   down configurations leave over and the small pieces are added by best fit, longest first, into
   the fullest sequence with room.

Steps 2 and 3 handle runs of equal sequences at a time, so their work depends on the number of
different lengths, not on the number of pieces. A plan says for each length which ranks among the
pieces of this length go to which sequences and offsets; Spark ranks the pieces (in buckets, so that
a length that a third of all pieces share is spread over many tasks) and looks the places up.

A null text is an empty one: its only piece is the end id. Repeated rows are packed each, ranked in
any order among each other. No documents give no pieces. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import ship, stage
from .registry import register
from .tokens import crc, encoder, in_parts

CAPACITY = 2048
HELD = 160 << 20
GROUPS = 256
SMALL = 3  # lengths up to capacity / SMALL are small
BUCKET_ROWS = 50_000
REFRESH = 64  # steps after which the basis is inverted anew
ship(__name__)
ship(encoder.__module__)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every piece of every document; ``held``: bytes
    of known words that a worker's encoder keeps."""
    def run(batches):
        import pyarrow as pa

        known = encoder(tokenizer, held)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            # texts leave the batch a part at a time: no second copy of all of it beside the encoder
            for part in in_parts(t.as_py() for t in batch.column(1)):
                rows = [(d, p, s, n, crc(x[s:s + n])) for d, x in zip(ids[at:at + len(part)], known.encode(part))
                        for p, (s, n) in enumerate(cuts(len(x), capacity))]
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def most_valuable(sizes: list[int], price: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern of the largest total price: a knapsack, filled one piece at a time."""
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        with_one = np.full((len(sizes), capacity + 1), -1.0)
        for i, s in enumerate(sizes):
            with_one[i, s:] = value[:capacity + 1 - s] + price[i]
        best = with_one.argmax(axis=0)
        gain = with_one.max(axis=0)
        choices.append(np.where(gain > value + 1e-12, best, -1))
        value = np.maximum(value, gain)
    pattern, c = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[c] >= 0:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by row operations; plain vector steps, as this runs on the driver beside a live
    session, where threads of a numerical library may stall."""
    k = len(matrix)
    both = np.hstack([matrix, np.eye(k)])
    for i in range(k):
        best = i + int(np.abs(both[i:, i]).argmax())
        if best != i:
            both[[i, best]] = both[[best, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, k:]


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (pieces of each size in one sequence) and how often to use each: the linear
    programme of least sequences for the counts, by column generation, rounded down."""
    k = len(sizes)
    demand = np.array(counts, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = inverted(basis)
    for at in range(1, 6 * k + 1):  # any basis on the way can be used
        price = inverse.sum(axis=0)
        pattern = most_valuable(sizes, price, capacity)
        if (pattern * price).sum() <= 1 + 1e-7:
            break
        use, step = times(inverse, demand), times(inverse, pattern)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if at % REFRESH:  # one column changed: a rank-one update
            row = inverse[out] / step[out]
            inverse -= step[:, None] * row
            inverse[out] = row
        else:
            inverse = inverted(basis)
    use = times(inverted(basis), demand)
    return [(tuple(int(x) for x in basis[:, j]), int(use[j] + 1e-6)) for j in range(k) if use[j] >= 1 - 1e-6]


class Plan:
    """Where the pieces go: for each length, rows (first rank, ranks, first sequence, pieces of this
    row in each sequence, offset of the first of them)."""

    def __init__(self):
        self.rows: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        self.ranked: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first, number) of sequences
        self.rooms: list[int] = []

    def put(self, length: int, first: int, number: int, each: int, offset: int) -> None:
        """``each`` pieces of the length into ``number`` sequences from ``first`` on."""
        if number and each:
            self.rows[length].append((self.ranked[length], number * each, first, each, offset))
            self.ranked[length] += number * each

    def leave(self, room: int, first: int, number: int) -> None:
        if number:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, number))

    def best_fit(self, length: int, count: int, capacity: int) -> None:
        """Add pieces of one length, each into the fullest sequence with room for it."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):  # none: open as many as are needed
                each = capacity // length
                number = -(-count // each)
                self.leave(capacity, self.sequences, number)
                self.sequences += number
                continue
            room = self.rooms[at]
            first, number = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(at)
            each = min(room // length, count)
            full = min(number, count // each)
            self.put(length, first, full, each, capacity - room)
            self.leave(room - each * length, first, full)
            self.leave(room, first + full, number - full)
            count -= full * each


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan for so many pieces of each length."""
    out = Plan()
    left = {n: c for n, c in histogram.items() if c}
    if full := left.pop(capacity, 0):
        out.put(capacity, 0, full, 1, 0)
        out.sequences = full
    large = sorted((n for n in left if n * SMALL > capacity), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        size = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # of each group, [length, pieces left], longest first
        for n in large:
            c = left.pop(n)
            while c:
                have = sum(x[1] for x in members[-1])
                if have == size:
                    members.append([])
                    have = 0
                now = min(c, size - have)
                members[-1].append([n, now])
                c -= now
        sizes = [m[0][0] for m in members]
        for pattern, times in configurations(sizes, [sum(x[1] for x in m) for m in members], capacity):
            fill_pattern(out, members, pattern, times, capacity)
        for m in members:
            for n, c in m:
                left[n] = left.get(n, 0) + c
    for n in sorted((n for n in left if left[n]), reverse=True):
        out.best_fit(n, left[n], capacity)
    return out


def fill_pattern(out: Plan, members: list[list[list[int]]], pattern: tuple[int, ...], times: int, capacity: int) -> None:
    """Substitute actual pieces for the rounded ones of a pattern, in runs of sequences that get the
    same lengths; a group that runs out leaves its places empty."""
    slots = [g for g, n in enumerate(pattern) for _ in range(n)]
    while times and any(members[g] for g in slots):
        heads = [members[g][0][0] if members[g] else 0 for g in slots]
        uses = {g: slots.count(g) for g in set(slots)}
        run = min([times] + [members[g][0][1] // uses[g] for g in uses if members[g]])
        if run == 0:  # the end of a length inside one sequence: place that one piece by piece
            offset = 0
            for g in slots:
                if members[g]:
                    n = members[g][0][0]
                    out.put(n, out.sequences, 1, 1, offset)
                    offset += n
                    take(members[g], 1)
            out.leave(capacity - offset, out.sequences, 1)
            out.sequences += 1
            times -= 1
            continue
        offset = 0
        for g in dict.fromkeys(slots):
            if members[g]:
                n = members[g][0][0]
                out.put(n, out.sequences, run, uses[g], offset)
                offset += n * uses[g]
        for g in uses:
            if members[g]:
                take(members[g], run * uses[g])
        out.leave(capacity - offset, out.sequences, run)
        out.sequences += run
        times -= run
        assert offset == sum(heads)


def take(group: list[list[int]], n: int) -> None:
    group[0][1] -= n
    if not group[0][1]:
        group.pop(0)


def ranked(found: DataFrame) -> DataFrame:
    """``found`` with the ``rank`` of each piece among those of its length, from 0. Ranks are counted
    in buckets of ids and moved by the number of pieces in the buckets before."""
    buckets = found.count() // BUCKET_ROWS + 16
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = stage(sizes.select("length", "bucket", F.expr(
        "sum(n) over (partition by length order by bucket) - n").alias("before")), "packing-buckets")
    inside = dealt.withColumn("inside", F.expr(
        "row_number() over (partition by length, bucket order by doc_id, piece, start, ids_crc32) - 1"))
    return (inside.join(before, ["length", "bucket"])
            .withColumn("rank", F.col("before") + F.col("inside")).drop("before", "inside", "bucket"))


def packed(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``found`` (a staged table of pieces) with ``sequence_id`` and ``offset``."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(histogram, capacity, groups)  # from at most `capacity` numbers
    rows = {n: np.array(r, np.int64) for n, r in made.rows.items()}

    def place(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                row = rows[int(n)]
                row = row[np.searchsorted(row[:, 0], rank[at], "right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + inside // row[:, 3]
                offset[at] = row[:, 4] + inside % row[:, 3] * n
            pdf["sequence_id"], pdf["offset"] = sequence, offset
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked(found).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    return packed(stage(pieces(docs, tokenizer, capacity, id_col, text_col, held), "packing-pieces"), capacity)


@register("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
