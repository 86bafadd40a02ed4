"""Token files and packing against plain encodings of whole texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from cohortlens.llm import packing, token_files
from cohortlens.llm.tokens import Encoder
from conftest import text_of


@pytest.fixture(scope="module")
def plain(tokenizer):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_equals_library(tokenizer, plain):
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "\u00a0", "'s", "12", "\x00", "\r", "<|endoftext|>", "\U0001f600", ".", "\u2028", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", text_of(1, 50)]
    for text, ids in zip(texts, Encoder(tokenizer, most=50).encode(texts)):
        assert ids.tolist() == plain(text).tolist(), repr(text)


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.ones(1000), rng.integers(0, 5, 20_000), np.tile(rng.integers(0, 50, 97), 300), rng.integers(0, 50_000, 5000)):
        ids = ids.astype(np.uint32)
        row = token_files.block_row(0, 0, [1, 2], [ids[:10], ids[10:]], 50_257)
        symbols, rules, lengths = token_files.grammar(row, 50_257)
        assert np.array_equal(token_files.expand(symbols, rules, lengths, 50_257), ids)
        for _ in range(20):
            at = int(rng.integers(0, len(ids) + 1))
            n = int(rng.integers(0, len(ids) - at + 1))
            assert np.array_equal(token_files.read_range(row, at, n, 50_257), ids[at:at + n])
    row = token_files.block_row(0, 0, [1], [np.tile(np.arange(8, dtype=np.uint32), 5000)], 50_257)
    assert len(row["symbols"]) < 40_000 // 4  # a repeated run shrinks


def test_read_range_descends_its_own_rules():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 40, rng.integers(3, 30)) for _ in range(400)]
    ids = np.concatenate([words[int(i)] for i in rng.integers(0, 400, 6000)]).astype(np.uint32)
    row = token_files.block_row(0, 0, [1], [ids], 50, least=2)
    _, rules, lengths = token_files.grammar(row, 50)
    assert len(rules) > 300 and len(token_files.block_row(0, 0, [1], [ids], 50)["rules"]) < len(row["rules"])
    for at, n in ((0, 1), (1000, 1), (len(ids) - 3, 3), (777, 50), (0, len(ids))):
        used = set()
        assert np.array_equal(token_files.read_range(row, at, n, 50, used), ids[at:at + n])
        assert n > 50 or len(used) <= 4 * n + 2 * int(lengths.max()).bit_length() * 8 < len(rules)


def test_rows_of_one_id_fill_several_files(spark, tokenizer, plain):
    rows = [(None if i % 3 else i, f"text {i} of " + text_of(i, 2)) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the files were large
    try:
        files = token_files.write_files(table, tokenizer, 50_257, least=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = token_files.read_files(files, 50_257).collect()
    assert sorted(r.ids_crc32 for r in found) == sorted(crc(plain(t)) for _, t in rows)
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    shards = [r for r in files.collect() if (np.frombuffer(r.doc_ids, "<i8") == -1 << 63).any()]
    assert len({r.shard for r in shards}) > 1


def test_encoder_forgets(tokenizer, plain):
    known = Encoder(tokenizer, most=100_000)
    for i in range(12):
        texts = [text_of(i * 10 + j, 30) for j in range(5)]
        assert all(np.array_equal(a, plain(t)) for a, t in zip(known.encode(texts), texts))
        assert known.held <= 100_000
    assert Encoder(tokenizer).tokenizer is known.tokenizer and Encoder(tokenizer).held == 0


@pytest.mark.parametrize("vocabulary", [50, 65_536 - token_files.ROOM, 50_257])
def test_grammar_is_complete(vocabulary, monkeypatch):
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 50, rng.integers(2, 30)) for _ in range(900)]
    words += [np.tile(rng.integers(0, 50, 9), 40), np.full(3000, 7), np.full(1001, 8)]
    skewed = np.concatenate([words[int(i)] for i in (rng.zipf(1.3, 40_000) - 1) % len(words)]).astype(np.uint32)
    dense = np.concatenate([rng.permutation(50)[:12] for _ in range(6)] + [rng.integers(0, 50, 150_000)]).astype(np.uint32)
    busy = rng.integers(0, 50, 150_000).astype(np.uint32)  # 16 bits run out
    for ids, least in ((skewed, token_files.LEAST_COUNT), (dense, 4), (skewed[:50_000], 2), (busy, 2)):
        symbols, rules, lengths = token_files.compress(ids, vocabulary, least)
        assert np.array_equal(token_files.expand(symbols, rules, lengths, vocabulary), ids)
        pairs = {}
        for pair in zip(symbols.tolist(), symbols[1:].tolist()):
            pairs[pair] = pairs.get(pair, 0) + 1
        assert max(pairs.values(), default=0) < least
        if ids is busy and vocabulary > 50_257:
            assert vocabulary + len(rules) > 1 << 16
            monkeypatch.setattr(token_files, "compress", lambda *_: (symbols, rules, lengths))
            row = token_files.block_row(0, 0, [1], [ids], vocabulary)
            assert np.array_equal(token_files.read_range(row, 100, 5000, vocabulary), ids[100:5100])
            monkeypatch.undo()


def test_token_files(spark, docs, no_docs, tokenizer, plain, monkeypatch):
    for part in (docs, docs.where("doc_id in (4, 5)")):
        found = token_files.read_files(token_files.write_files(part, tokenizer, 50_257), 50_257).collect()
        rows = sorted(part.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        found.sort(key=lambda r: r.start)
        assert [r.doc_id for r in found] == [r.doc_id for r in rows]
        start = 0
        for f, r in zip(found, rows):
            ids = plain(r.text)
            assert (f.start, f.n_tokens, f.ids_crc32) == (start, len(ids), crc(ids))
            start += len(ids)
    assert token_files.read_files(token_files.write_files(no_docs, tokenizer, 50_257), 50_257).count() == 0


def check_packing(found, docs, plain, capacity):
    by_doc = {}
    for r in docs.select("doc_id", "text").collect():
        by_doc.setdefault(r.doc_id, []).append(plain(r.text))
    expected = sorted((d is not None, d, p, s, n, crc(ids[s:s + n])) for d, all_ids in by_doc.items() for ids in all_ids
                      for p, (s, n) in enumerate(packing.cuts(len(ids), capacity)))
    assert sorted((r.doc_id is not None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, no_docs, tokenizer, plain, capacity):
    found = packing.pack_documents(docs, tokenizer, capacity).collect()
    n = check_packing(found, docs, plain, capacity)
    assert n <= -(-sum(r.length for r in found) // capacity) + 2
    assert packing.pack_documents(no_docs, tokenizer, capacity).count() == 0


def test_plan_of_many_lengths_beside_a_session(spark):
    """As many lengths as there are, planned while a session lives, with default threads."""
    import time

    assert spark.range(10).count() == 10
    rng = random.Random(7)
    histogram = {n: rng.randint(1, 400) for n in range(1, 2049)}
    began = time.time()
    made = packing.plan(histogram)
    assert time.time() - began < 30
    assert made.sequences <= 1.02 * sum(n * c for n, c in histogram.items()) / 2048 + 5
    matrix = np.array([[rng.randint(0, 3) + 5 * (i == j) for j in range(40)] for i in range(40)], float)
    assert np.allclose(packing.inverted(matrix) @ matrix, np.eye(40))


def test_plan_is_tight():
    rng = random.Random(3)
    for trial in range(12):
        capacity = 500
        histogram = {}
        for _ in range(rng.choice([1, 10, 3000])):
            n = rng.choice([rng.randint(1, capacity), rng.randint(160, 260), 250])
            histogram[n] = histogram.get(n, 0) + rng.choice([1, 1, 200])
        made = packing.plan(histogram, capacity, groups=32)
        room = {}
        for length, rows in made.rows.items():
            assert sum(r[1] for r in rows) == histogram[length]
            at = 0
            for first, number, sequence, each, offset in rows:
                assert first == at and number % each == 0
                at += number
                for i in range(number):
                    room.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
        assert len(room) == made.sequences or all(room.values())
        for places in room.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
            assert sum(n for _, n in places) <= capacity
        bound = max(-(-sum(n * c for n, c in histogram.items()) // capacity), sum(c for n, c in histogram.items() if 2 * n > capacity))
        assert len(room) <= 1.12 * bound + 34


def test_a_kept_encoder_takes_the_bound_of_its_task():
    """The pipeline's packing leaves less in the workers than op6 does alone."""
    import public_tokenizers

    from cohortlens.llm.tokens import encoder
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["some words and some more", "words again"]
    want = [x.tolist() for x in encoder(path).encode(texts)]
    small = encoder(path, 10)
    assert small.most == 10 and [x.tolist() for x in small.encode(texts)] == want
    assert small.held == 0 and encoder(path).most == 160 << 20
