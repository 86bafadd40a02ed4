"""Token files with Re-Pair grammar compression.

Documents are range-partitioned by id (rows of one id may fill several files) and sorted, so that the files hold the ids of all documents in
ascending order of the id. Each file is a parquet table of blocks of about ``BLOCK`` ids; a block is
a grammar of its own: frequent pairs of neighbouring symbols are replaced by a new symbol, round
after round, until no pair is frequent any more. In a round all pairs within a factor of the most
frequent one are replaced together, unless one could overlap another (a symbol is only the left or
only the right side of a round's pairs); pairs of equal symbols have rounds of their own, in which
every second place of a run is replaced. The first rounds rewrite the whole sequence, the later ones
look only at the places of frequent pairs and at the neighbours of what the last round replaced.

A block stores its documents' ids and numbers of tokens, the rules (left and right symbol of each
new symbol), the number of ids that each new symbol stands for, the sequence of symbols, and the
place in the ids of every ``MARK``-th symbol. With these, ``read_range`` decodes any range of ids
without the rest of the block. Columns: shard, block, n_tokens, doc_ids (int64), doc_lengths
(int64), rules (uint32 pairs), lengths (uint32), symbols (uint32, or uint16 if all fit), marks (int64);
arrays are little-endian.

A null text is an empty one (the end id alone). Repeated rows are written each, in any order among
each other; rows without an id come first. No documents give an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import broadcast_if_small, ship, stage
from .registry import register
from .tokens import crc, encoder, in_parts

BLOCK = 1 << 20
MARK = 1024
LEAST_COUNT = 64  # a pair less frequent than that in a block stays
SHARE = 16  # a round replaces the pairs with at least this part of the largest count
ROUNDS = 16  # so many rounds at most rewrite the whole sequence
HASH_BITS = 18
ROOM = 1 << 12  # least number of new symbols that 16 bits are to leave
BROADCAST_BLOCKS = 1_000_000
FORMAT = ("shard int, block int, n_tokens long, doc_ids binary, doc_lengths binary, rules binary, "
          "lengths binary, symbols binary, marks binary")
ship(__name__)
ship(encoder.__module__)


def frequent_pairs(found: np.ndarray, shift: int, limit: int, least: int) -> list[int]:
    """Keys of the pairs to replace in one round, from the keys at all places whose pair may be
    frequent enough."""
    some, times = np.unique(found, return_counts=True)
    lefts, rights, chosen = set(), set(), []
    for i in np.argsort(-times, kind="stable"):
        if times[i] < limit:
            break
        a, b = int(some[i]) >> shift, int(some[i]) & (1 << shift) - 1
        if a == b:
            if not chosen:  # equal pairs of different symbols never overlap
                return sorted(k for k in some[times >= limit].tolist() if k >> shift == k & (1 << shift) - 1)
            continue
        if a not in rights and b not in lefts:
            lefts.add(a)
            rights.add(b)
            chosen.append(int(some[i]))
    if not chosen and len(times) and times.max() >= least:  # pairs counted together are rarer apart
        chosen = [int(some[times.argmax()])]
    return sorted(chosen)


def add_rules(chosen: list[int], shift: int, rules: list, lengths: list, first_symbol: int) -> None:
    for p in chosen:
        a, b = p >> shift, p & (1 << shift) - 1
        lengths.append(sum(1 if s < first_symbol else lengths[s - first_symbol] for s in (a, b)))
        rules.append((a, b))


def later_rounds(seq: np.ndarray, rules: list, lengths: list, first_symbol: int, least: int) -> np.ndarray:
    """Rounds until no pair occurs ``least`` times; the sequence, with rules and lengths extended.
    A pair that becomes frequent has a new symbol, and the other pairs only get rarer: so a round
    needs the places of the pairs frequent before it and those next to the last replacements.
    ``after`` and ``prior`` link the places that are left."""
    n, shift = len(seq), 32
    if n < 2:
        return seq
    after, prior = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    left = np.ones(n, bool)
    place = np.arange(n - 1)
    while True:
        a, b = seq[place], seq[after[place]]
        slot = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        counts = np.bincount(slot, minlength=1 << HASH_BITS)  # at least the count of each pair
        often = (counts >= least)[slot]
        place = place[often]
        found = a[often].astype(np.uint64) << np.uint64(shift) | b[often]
        chosen = frequent_pairs(found, shift, max(least, int(counts.max()) // SHARE), least)
        if not chosen:
            break
        base = first_symbol + len(rules)
        add_rules(chosen, shift, rules, lengths, first_symbol)
        keys = np.array(chosen, np.uint64)
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        same = keys[at] == found
        first, at = place[same], at[same]
        if rules[-1][0] == rules[-1][1]:  # overlaps with itself: every second place of a run
            run = np.flatnonzero(np.concatenate(([True], after[first[:-1]] != first[1:])))
            i = np.arange(len(first))
            even = (i - np.repeat(run, np.diff(run, append=len(first)))) % 2 == 0
            first, at = first[even], at[even]
        gone = after[first]
        seq[first] = base + at
        left[gone] = False
        after[first] = after[gone]
        inner = after[first] < n
        prior[after[first][inner]] = first[inner]
        near = np.zeros(n + 1, bool)  # the last one is the place before the first one
        near[place] = near[prior[first]] = True
        near[:-1] &= left
        place = np.flatnonzero(near[:-1])
        place = place[after[place] < n]
    return seq[left]


def compress(ids: np.ndarray, first_symbol: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols, rules, lengths)``: new symbols count up from ``first_symbol``. In the first rounds
    symbols have 16 bits where the vocabulary leaves room for ``ROOM`` new ones, else 32; when 16 bits
    run out, and once no pair is much more frequent than ``least``, the later rounds take over."""
    narrow = first_symbol + ROOM <= 1 << 16
    kind, wide, shift = (np.uint16, np.uint32, 16) if narrow else (np.uint32, np.uint64, 32)
    most = (1 << shift) - first_symbol
    factor, down = wide(0x9E3779B1 if narrow else 0x9E3779B97F4A7C15), wide(2 * shift - HASH_BITS)
    seq, rules, lengths = ids.astype(kind), [], []
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        key = seq[:-1].astype(wide)
        key <<= wide(shift)
        key |= seq[1:]
        slot = key * factor
        slot >>= down
        slot = slot.astype(np.int64)
        counts = np.bincount(slot, minlength=1 << HASH_BITS)  # at least the count of each pair
        limit = max(least, int(counts.max()) // SHARE)
        if limit == least:
            break
        place = np.flatnonzero((counts >= limit)[slot])
        found = key[place]
        chosen = frequent_pairs(found, shift, limit, least)
        if not chosen or len(rules) + len(chosen) > most:
            break
        base = first_symbol + len(rules)
        add_rules(chosen, shift, rules, lengths, first_symbol)
        keys = np.array(chosen, wide)
        rule = np.zeros(1 << HASH_BITS, np.int32)  # a slot that two rules share has the later one
        rule[((keys * factor) >> down).astype(np.int64)] = np.arange(len(keys))
        at = rule[slot[place]]
        same = keys[at] == found
        place, at = place[same], at[same]
        if rules[-1][0] == rules[-1][1]:  # overlaps with itself: every second place of a run
            run = np.flatnonzero(np.diff(place, prepend=-2) > 1)
            even = (place - np.repeat(place[run], np.diff(run, append=len(place)))) % 2 == 0
            place, at = place[even], at[even]
        seq[place] = (base + at).astype(kind)
        seq = np.delete(seq, place + 1)
    seq = later_rounds(seq.astype(np.uint32), rules, lengths, first_symbol, least)
    return seq, np.array(rules, np.uint32).reshape(-1, 2), np.array(lengths, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    n = np.ones(first_symbol + len(rules), np.int32)
    n[first_symbol:] = lengths
    starts = np.cumsum(n) - n
    flat = np.empty(int(n.sum()), np.uint32)
    flat[:first_symbol] = np.arange(first_symbol)
    for i, (a, b) in enumerate(rules.tolist(), first_symbol):  # a rule's parts come before it
        at, middle = starts[i], starts[i] + n[a]
        flat[at:middle] = flat[starts[a]:starts[a] + n[a]]
        flat[middle:at + n[i]] = flat[starts[b]:starts[b] + n[b]]
    n = n[symbols]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[symbols] - ends + n, n)]


def block_row(shard: int, block: int, ids: list, parts: list[np.ndarray], vocabulary: int, least: int = LEAST_COUNT) -> dict:
    flat = np.concatenate(parts)
    symbols, rules, lengths = compress(flat, vocabulary, least)
    n = np.ones(len(symbols), np.int64)
    new = symbols >= vocabulary
    n[new] = lengths[symbols[new].astype(np.int64) - vocabulary]
    marks = (np.cumsum(n) - n)[::MARK]
    kind = "<u2" if vocabulary + len(rules) <= 1 << 16 else "<u4"
    return {"shard": shard, "block": block, "n_tokens": len(flat),
            "doc_ids": np.array([-1 << 63 if i is None else i for i in ids], "<i8").tobytes(),
            "doc_lengths": np.array([len(p) for p in parts], "<i8").tobytes(),
            "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
            "symbols": symbols.astype(kind).tobytes(), "marks": marks.astype("<i8").tobytes()}


def grammar(row: dict, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    kind = "<u2" if vocabulary + len(rules) <= 1 << 16 else "<u4"
    return np.frombuffer(row["symbols"], kind), rules, np.frombuffer(row["lengths"], "<u4")


def read_range(row: dict, start: int, count: int, vocabulary: int, used: set | None = None) -> np.ndarray:
    """``count`` ids of a block from ``start`` on. Only the symbols that cover them are looked at, and
    of their rules those that the range reaches: a symbol that is partly inside is descended by the
    stored lengths. ``used`` gets the symbols whose rules were read."""
    symbols, rules, lengths = grammar(row, vocabulary)
    marks = np.frombuffer(row["marks"], "<i8")
    if count <= 0 or not len(marks):
        return np.empty(0, np.uint32)
    first = int(np.searchsorted(marks, start, "right")) - 1
    last = int(np.searchsorted(marks, start + count, "left"))
    some = symbols[first * MARK:last * MARK].astype(np.int64)
    size = np.ones(len(some), np.int64)
    new = some >= vocabulary
    size[new] = lengths[some[new] - vocabulary]
    ends = np.cumsum(size) + int(marks[first])
    known: dict[int, np.ndarray] = {}

    def parts(symbol: int) -> list[int]:
        if used is not None:
            used.add(symbol)
        return rules[symbol - vocabulary].tolist()

    def whole(symbol: int) -> np.ndarray:
        waiting = [symbol]
        while waiting:
            top = waiting[-1]
            if top in known:
                waiting.pop()
            elif top < vocabulary:
                known[waiting.pop()] = np.array([top], np.uint32)
            elif missing := [s for s in parts(top) if s not in known]:
                waiting += missing
            else:
                known[waiting.pop()] = np.concatenate([known[s] for s in parts(top)])
        return known[symbol]

    out = []
    at = int(np.searchsorted(ends, start, "right"))
    while at < len(some) and ends[at] - size[at] < start + count:
        begin = int(ends[at] - size[at])
        descent = [(int(some[at]), start - begin, start + count - begin)]
        while descent:
            symbol, low, high = descent.pop()
            n = 1 if symbol < vocabulary else int(lengths[symbol - vocabulary])
            if low <= 0 and high >= n:
                out.append(whole(symbol))
                continue
            a, b = parts(symbol)
            middle = 1 if a < vocabulary else int(lengths[a - vocabulary])
            if high > middle:
                descent.append((b, low - middle, high - middle))
            if low < middle:
                descent.append((a, low, high))
        at += 1
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def write_files(docs: DataFrame, tokenizer: str, vocabulary: int, id_col: str = "doc_id",
                text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """Write the blocks of all documents; the table that reads the files. Pairs that occur fewer than
    ``least`` times (2 at least) in a block stay."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        known, shard, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names = [c.split()[0] for c in FORMAT.split(", ")]
        kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in FORMAT.split(", ")]
        ids, parts, size = [], [], 0

        def out():
            row = block_row(shard, block, ids, parts, vocabulary, max(least, 2))
            return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            batch_ids, at = batch.column(0).to_pylist(), 0
            for part in in_parts(batch.column(1).to_pylist()):
                for d, x in zip(batch_ids[at:at + len(part)], known.encode(part)):
                    ids.append(d)
                    parts.append(x)
                    size += len(x)
                    if size >= BLOCK:
                        yield out()
                        ids, parts, size, block = [], [], 0, block + 1
                at += len(part)
        if ids:
            yield out()

    # the row's number spreads rows of one id, or without one, over many shards
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         F.monotonically_increasing_id().alias("row"))
    dealt = narrow.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id")
    return stage(dealt.select("doc_id", "text").mapInArrow(run, FORMAT), "token-files")


def read_files(files: DataFrame, vocabulary: int) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the blocks. A
    block's start is the sum of the blocks before it in its shard and of the shards before (one
    number a shard, broadcast: there are as many shards as one stage has tasks). The blocks' starts
    are broadcast too while they are few, so that the blocks themselves stay where they are read."""
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = stage(sizes.select(F.col("shard").alias("of"), F.expr("sum(n) over (order by shard) - n").alias("before")),
                   "token-shards")
    inside = stage(files.select(F.col("shard").alias("s"), F.col("block").alias("b"), F.expr(
        "sum(n_tokens) over (partition by shard order by block) - n_tokens").alias("inside")), "token-blocks")
    starts = inside.join(F.broadcast(before), F.col("s") == F.col("of")).select("s", "b", (F.col("inside") + F.col("before")).alias("start"))
    starts = broadcast_if_small(starts, inside.count(), BROADCAST_BLOCKS)
    placed = files.join(starts, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(*grammar(row, vocabulary), vocabulary)
                n = np.frombuffer(row["doc_lengths"], "<i8")
                docs = [None if d == -1 << 63 else d for d in np.frombuffer(row["doc_ids"], "<i8").tolist()]
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(ends - n + row["start"], pa.int64()),
                     pa.array(n, pa.int64()),
                     pa.array([crc(ids[e - k:e]) for e, k in zip(ends.tolist(), n.tolist())], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("doc_ids", "doc_lengths", "rules", "lengths", "symbols", "start").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@register("op2_repair_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    return read_files(write_files(table(spark, sf_dir, "documents"), path, vocabulary), vocabulary)
