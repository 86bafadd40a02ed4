"""SimHash, quality rules, toxicity and licenses against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
import xxhash

from cohortlens.llm import licenses, quality, simhash, toxicity
from conftest import text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def print_of(text: str | None) -> int:
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: dict, radius: int) -> dict:
    """Smallest key reachable over links, by flooding."""
    left, out = set(prints), {}
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            p = prints[todo.pop()]
            near = [k for k in left if bin(prints[k] ^ p).count("1") <= radius]
            left.difference_update(near)
            todo += near
            group += near
        out |= {k: min(group) for k in group}
    return out


def test_simhash_of_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: print_of(r.text) for r in docs.collect()}
    found = {r.doc_id: r for r in simhash.op4(spark, sf).collect()}
    assert {d: r.fingerprint for d, r in found.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in found.items()} == groups(prints, 3)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_have_all_components(spark, radius):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(rng.randint(0, 5)):  # chains of flipped bits, close to each other and spread
            p ^= sum(1 << b for b in rng.sample(range(64) if rng.random() < 0.5 else range(5), rng.randint(1, min(5, radius + 1))))
            prints.add(p)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(nodes, radius).collect()]
    assert all(bin(a ^ b).count("1") <= radius for a, b in links)
    expected = groups({p: p for p in prints}, radius)
    root = {p: p for p in prints}
    for _ in prints:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert root == expected


def test_simhash_awkward(docs, no_docs):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    of = {r.doc_id: r.component_id for r in found}
    assert of[1] == of[3] == 1 and {of[4], of[5], of[6]} == {4} and of[7] == 7
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and ids == sorted({c for c in of.values() if c is not None})
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group(spark, docs, no_docs):
    import corpus_pipeline
    a, b, c, d = (text_of(i, 40) for i in range(20, 24))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x"),  # id 2 goes for a and stays for b
            (None, c, "x"), (None, c, "y"), (None, c, "y"),  # a group without an id
            (None, d, "x"), (9, d, "x"), (None, a, "x"), (4, text_of(25, 40), "x"),
            (5, text_of(26, 40), "x"), (5, text_of(26, 40), "x"), (5, text_of(26, 40), "z"),
            (6, None, "x"), (6, "", "x"), (7, text_of(27, 40), None), (7, text_of(28, 40), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    group = {i: print_of(r[1]) for i, r in enumerate(rows)}
    for part in (table, table.repartition(7)):
        out = [tuple(r) for r in corpus_pipeline.near_copies(spark, part, "").collect()]
        assert sorted(print_of(r[1]) for r in out) == sorted(set(group.values()))  # one of each, none lost
        assert {r[0] for r in out if r[1] in (a, b, d)} == {1, 2, 9} and [r[0] for r in out if r[1] == c] == [None]
        assert set(out) <= set(rows)
        seen = sorted(out, key=repr) if part is table else seen
        assert sorted(out, key=repr) == seen  # the same rows whatever the partitions
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert simhash.representatives(no_docs).count() == 0


def base(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = {}
    for i in range(len(words) - 2):
        triples.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeat = len({i + o for at in triples.values() if len(at) > 1 for i in at for o in range(3)})
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat, failed)


def test_quality_base(spark, sf, docs, no_docs, monkeypatch):
    tables = spark.read.parquet(f"{sf}/documents.parquet")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    from pyspark.sql import functions as F
    for packed in (quality.PACKED, 20):  # also the way of very long texts
        monkeypatch.setattr(quality, "PACKED", packed)
        if packed == 20:
            monkeypatch.setattr(quality, "repeated_places", _paired_only(quality))
        for part in (tables, docs):
            for r in quality.measured(part, "text", [F.col("text")]).collect():
                assert tuple(r[c] for c in cols) == base(r.k0), repr(r.k0)[:200]
        monkeypatch.undo()
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in kept.collect()}
    assert {1, 2, 7, 15} <= good and not good & {4, 5, 6, 8, 13}
    assert quality.good_documents(no_docs).count() == 0


def _paired_only(module):
    whole = module.repeated_places

    def places(words):
        old, module.PACKED = module.PACKED, 1 << 16
        try:
            return whole(words)
        finally:
            module.PACKED = old
    return places


def test_quality_sketch(spark):
    rng = random.Random(2)
    values = [0, 1, 63, 64, 65, 127, 128, 10**6] + [rng.randint(0, 10**9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", quality.least_of(quality.bin_of(df.v)).alias("low")).collect():
        assert r.low <= r.v and r.v - r.low <= r.v / 32


def test_quality_limits_are_the_quantiles(spark):
    """Each group's limits from plain Python quantiles of the sketched values."""
    rng = random.Random(13)
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "rare"] if i % 40 == 0 else ["a", "b"])
        rows.append((lang, source, rng.randint(50, 900), rng.randint(200, 9000), rng.randint(0, 60), rng.randint(0, 30), rng.randint(0, 200),
                     rng.randint(1, 40), rng.random() < 0.1))
    names = "lang source n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines base_failed".split()
    measures = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                           "n_repeat_words long, n_lines long, base_failed boolean")
    low = {}
    exprs = {m: e for m, (e, _) in quality.MEASURES.items()}
    values = measures.selectExpr(*names, *[f"{e} as m_{m}" for m, e in exprs.items()])
    for m in exprs:
        values = values.withColumn(f"low_{m}", quality.least_of(quality.bin_of(quality.F.col(f"m_{m}"))))
    every = values.where("not base_failed").collect()

    def group_of(lang, source, m):
        for members in ([r for r in every if r.lang == lang and r.source == source], [r for r in every if r.lang == lang], None):
            if members is None:
                return sorted(r[f"low_{m}"] for r in every)
            if len(members) >= quality.MIN_GROUP:
                return sorted(r[f"low_{m}"] for r in members)

    def quantile(xs, pct):
        return xs[-(-len(xs) * pct // 100) - 1]

    for r in quality.limits(quality.sketches(measures)).collect():
        for m, (_, slack) in quality.MEASURES.items():
            xs = group_of(r.lang, r.source, m)
            q25, q50, q75 = (quantile(xs, p) for p in (25, 50, 75))
            assert math.isclose(r[f"{m}_most"], q75 + max(slack, quality.REACH * (q75 - q50)))
            low[m] = q25 - max(slack, quality.REACH * (q50 - q25))
        assert math.isclose(r.word_length_least, low["word_length"])
    found = quality.judged(quality.stage(measures, "t")).collect()
    assert len(found) == len(rows) and not any(r.kept for r in found if r.base_failed) and any(r.kept for r in found)


def test_quality_limits_follow_the_group(spark):
    junk = lambda i: text_of(i, 8).replace(" ", " # | ")
    rows = [(i, junk(i) if i % 100 == 0 else text_of(i, 8), "en", "clean") for i in range(400)]
    rows += [(1000 + i, text_of(i, 8).replace(" ", " # | "), "en", "tables") for i in range(300)]
    found = quality.judged(quality.stage(quality.measured(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "text",
        [quality.F.col(c) for c in ("doc_id", "lang", "source")]).withColumnsRenamed({"k0": "doc_id", "k1": "lang", "k2": "source"}), "t"))
    out = {r.doc_id for r in found.where("not kept").collect()}
    assert out == {i for i in range(0, 400, 100)}  # symbols are normal in the other source


def test_toxicity_finds_sentences(spark):
    rng = random.Random(4)
    bad, rows, labels = ["vilegrunt", "scumthorn", "hatewort"], [], []
    for i in range(600):
        lines = [f"{text_of(1000 + i * 20 + j, 1)}" for j in range(rng.randint(2, 12))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(lines))
            lines[at] = lines[at][:-1] + " " + rng.choice(bad) + "."
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks.where("doc_id < 400"))
    found = docs.select("doc_id", "text", toxicity.judged(docs.text, model).alias("j")).where("doc_id >= 400").collect()
    assert all((r.j.score >= 0.5) == (r.doc_id % 4 == 0) for r in found)
    for r in found:
        for o in r.j.offending:
            assert any(b in r.text.lower()[o.first:o.last] for b in bad)
        assert bool(r.j.offending) == (r.doc_id % 4 == 0)


def test_toxicity_score_and_gradient():
    """The noisy-or of a text against a plain product, and the gradient against differences."""
    rng = random.Random(12)
    weights = {"bad": 2.5, "badl*": 0.7, "evil": 1.5, "good": -1.0, "fin*": 0.2}
    vocabulary = ["bad", "badly", "badlands", "evil", "good", "fine", "final", "word", "x"]
    for _ in range(200):
        sentences = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(0, 6))]
        text = "".join(" ".join(w.title() if rng.random() < 0.2 else w for w in s) + rng.choice(".!?\n") for s in sentences)
        none = 1.0
        for s in sentences:
            if s:
                z = -1.5 + sum(weights.get(f, 0) for w in set(s) for f in {w, w[:4] + "*" if len(w) > 3 else w, w[:5] + "*" if len(w) > 4 else w})
                none *= 1 - 1 / (1 + math.exp(-z))
        assert math.isclose(toxicity.score(text, toxicity.Known(weights), -1.5)[0], 1 - none, abs_tol=1e-12), text
    raw = lambda xs: np.array(xs, np.int32).tobytes()
    rows = [(rng.randint(0, 1), rng.random() + 0.1, raw(sizes := [rng.randint(1, 4) for _ in range(rng.randint(0, 4))]),
             raw([rng.randrange(6) for _ in range(sum(sizes))]), rng.randint(0, 3)) for _ in range(40)]
    rows = [r if r[2] or r[4] else r[:4] + (1,) for r in rows]
    bags, theta = toxicity.Bags(rows), np.array([rng.uniform(-1, 1) for _ in range(7)])
    _, grad = toxicity.loss_and_gradient(theta, bags)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        slope = (toxicity.loss_and_gradient(theta + step, bags)[0] - toxicity.loss_and_gradient(theta - step, bags)[0]) / 2e-6
        assert math.isclose(grad[i], slope, rel_tol=1e-5, abs_tol=1e-8)


def test_toxicity_sample_is_bounded_by_words(spark):
    rows = [(i, ("vilegrunt " if i % 2 else "") + text_of(i, 20)) for i in range(200)] + [(1, "another text of id 1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, words=4000)  # some twenty documents of each class
    found = docs.select("doc_id", toxicity.judged(docs.text, model)["score"].alias("s")).where("doc_id > 1").collect()
    assert sum((r.s >= 0.5) == (r.doc_id % 2 == 1) for r in found) >= 190


def test_toxicity_awkward(spark, sf, docs, no_docs):
    some = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0), (2, 0), (99, 1)], "doc_id long, toxic int")
    none = some.where("false")
    for marks in (some, none, some.where("toxic = 1")):
        kept = toxicity.clean_documents(docs, marks)
        assert kept.columns == docs.columns
        assert {4, 5, 6} <= {r.doc_id for r in kept.collect()}
    assert toxicity.clean_documents(docs, none).count() == docs.count()
    assert toxicity.clean_documents(no_docs, some).count() == 0
    found = toxicity.op3(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.op3(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    ranked = sorted(found, key=lambda r: r.score)
    ones = sum(r.toxic for r in found)
    pairs, below = 0, 0
    for r in ranked:
        if r.toxic:
            pairs += below
        else:
            below += 1
    assert pairs / (ones * below) > 0.97
    assert sum(r.predicted == r.toxic for r in found) / len(found) > 0.97


def test_licenses(docs, no_docs):
    found = {r.doc_id: r for r in licenses.licenses(docs).collect()}
    assert len(found) == docs.select("doc_id").distinct().count()
    assert {d for d, r in found.items() if r.n_matches} == {9}
    assert (found[9].license, found[9].dice, found[9].kind, found[9].first_line) == ("Apache-2.0", 1.0, "line", 0)
    assert licenses.licenses(no_docs).count() == 0


def test_license_pruning_loses_nothing():
    rng = random.Random(6)
    index = licenses.Index(licenses.TEMPLATES)
    for trial in range(300):
        name = rng.choice(list(licenses.TEMPLATES))
        words = licenses.normalised(licenses.TEMPLATES[name].encode()).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = b"x"
        text = text_of(trial, 2).encode() + b"\n\n" + b" ".join(words) + b"\n\n" + text_of(trial + 1, 2).encode()
        every = set()
        for kind, first, last, some in licenses.passages(licenses.normalised(text)):
            own = licenses.bigrams(some)
            for n, g in index.grams.items():
                if own and 2 * len(own & g) / (len(own) + len(g)) >= licenses.LEAST:
                    every.add((n, licenses.KINDS[kind], first, last))
        assert {(n, k, a, z) for n, _, k, a, z in licenses.scan(text, index, licenses.LEAST)} == every


MIT_PARTS = ("Permission is hereby granted", "The above copyright notice", "THE SOFTWARE IS PROVIDED")


def test_license_spans(spark):
    mit = licenses.TEMPLATES["MIT-full"]
    cuts = [mit.index(p) for p in MIT_PARTS] + [len(mit)]
    paragraphs = "\n\n".join(mit[a:z].strip() for a, z in zip(cuts, cuts[1:]))
    header = licenses.TEMPLATES["Apache-2.0-header"].split(" ")
    wrapped = "\n".join("# " + " ".join(header[i:i + 9]) for i in range(0, len(header), 9))
    long = [text_of(i, 60) for i in range(4)]
    rows = [(1, long[0] + "\n\n" + paragraphs + "\n\n" + long[1], "MIT-full", 1.0),
            (2, long[1] + "\nThis project is released under the MIT License.\n" + long[2], "MIT", 1.0),
            (3, long[2] + "\nReleased under the MIT License. See LICENSE for details.\n" + long[3], "MIT", 1.0),
            (4, wrapped + "\nimport os\n# a word more\n" + long[0], "Apache-2.0-header", 1.0),
            (5, long[3], None, None)]
    found = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, text, name, dice in rows:
        of_name = [m for m in found[i].matches if m.license == name]
        assert [m.dice for m in of_name] == ([dice] if name else []) and found[i].n_matches == len(found[i].matches), i
        if name:
            assert of_name[0].kind == "span" and licenses.scan(text.encode(), licenses.Index({name: licenses.TEMPLATES[name]}), 0.8) == []
    lines = rows[0][1].split("\n")
    m = [m for m in found[1].matches if m.license == "MIT-full"][0]
    assert lines[m.first_line].startswith(MIT_PARTS[0]) and lines[m.last_line].startswith(MIT_PARTS[2])


def test_license_spans_lose_nothing():
    rng = random.Random(8)
    for _ in range(300):
        template = " ".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8)))
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(2, 40))]
        index, least = licenses.Index({"t": template}), rng.choice((0.6, 0.8, 1.0))
        own = index.grams["t"]
        most = max(int(index.places["t"] * (2 - least) / least), 1)
        every = {}
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + most + 1)):
                grams = licenses.bigrams([w.encode() for w in words[i:j + 1]])
                every[i, j] = 2 * len(grams & own) / (len(grams) + len(own))
        found = licenses.scan_spans(" ".join(words).encode(), index, least, [])
        best = max(every.values())
        assert max((m[1] for m in found), default=None) == (best if best >= least else None)
        lines = licenses.scan_spans("\n".join(words).encode(), index, least, [])
        taken = {i for m in lines for i in range(m[3], m[4])}
        assert sum(m[4] - m[3] for m in lines) == len(taken)
        assert all(every[m[3], m[4]] == m[1] for m in lines)
        assert all(taken & set(range(i, j)) for (i, j), d in every.items() if d >= least)


def test_license_table(spark):
    full = licenses.TEMPLATES
    rows = [(f"{n}-full", text_of(i, 30) + "\n\n" + full[f"{n}-full"] + "\n\n" + text_of(i + 1, 30))
            for i, n in enumerate(licenses.FULL_TEXTS)]
    rows += [("BSD-3-Clause", text_of(1, 30) + "\n" + full["BSD-3-Clause"].replace(". ", ".\n\n") + "\n" + text_of(2, 30)),
             ("BSD-2-Clause", text_of(3, 30) + "\n" + full["BSD-2-Clause"].replace(". ", ".\n\n") + "\n" + text_of(2, 30))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in licenses.licenses(docs).collect():
        of_name = {m.license: m.dice for m in reversed(r.matches)}  # the best of each
        name = rows[r.doc_id][0]
        assert of_name.get(name, 0) > 0.99, name
        assert all(d < of_name[name] for n, d in of_name.items() if n != name and (n.endswith("-full") or n.startswith("BSD")))
    notices = {"Licensed under the MIT License.": "MIT", "this code is Distributed under the 3-clause BSD licence, friends": "BSD-3-Clause",
               "// SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1", "It is licensed under CC BY-SA 4.0, as ever": "CC-BY-SA-4.0"}
    index = licenses.Index(full)
    for text, name in notices.items():
        best = licenses.scan_all(text_of(4).encode() + b"\n" + text.encode() + b"\n" + text_of(5).encode(), index, 0.8)[0]
        assert best[0].startswith(name) and best[1] == 1.0, (text, best)
    assert licenses.scan_all(text_of(4).encode(), index, 0.8) == []
