"""Decontamination, URL models, shards and preference pairs; the entry and the pipeline."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cohortlens.llm import chat_pairs, decontaminate, registry, sharding, urls
from conftest import rows_of, text_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(text: str | None, items: list[tuple]) -> tuple[int, set]:
    """Hit words and items by comparing every window with every item's windows."""
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(10, len(b))
        spans = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in spans:
                hit.update(range(i, i + n))
                found.add(item)
    return len(hit), {str(x) for x in found if x is not None}


@pytest.fixture(scope="module")
def bench_rows():
    t2 = " ".join(text_of(2).split()[5:30])
    return [(1, t2), (2, t2 + " more words here"), (3, "one"), (4, None), (5, ""), (6, "a b c a b c a b c a b c a b c"),
            (7, text_of(7)), (7, text_of(7)), (None, " ".join(text_of(12).split()[:12])), (8, "Ünï x"), (9, "zz zy zx"),
            (10, " ".join(text_of(1).split()[3:12]))]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, docs, no_docs, bench_rows, limit):
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in bench_rows], "item_id long, text string, hash int, doc_id string")
    found = decontaminate.contamination(docs, bench, broadcast_rows=limit).collect()
    texts = {r[0]: r[1] for r in rows_of()}
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows_of())  # repeated rows and rows without id too
    for r in found:
        n, items = leaks(texts[r.doc_id], bench_rows)
        assert (r.n_words, r.n_hit, set(r["items"])) == (len(words(texts[r.doc_id])), n, items), r.doc_id
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, t in texts.items() if not leaks(t, bench_rows)[0]}
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == docs.count()


def test_winnowing_finds_every_span(spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "d"]  # many equal k-grams
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(12)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200)))) for i in range(30)]
    found = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string")).collect()
    of = dict(texts)
    for r in found:
        assert (r.n_hit, set(r["items"])) == leaks(of[r.doc_id], items)


def ratio_of(text: str, counts: dict) -> float:
    """Log-likelihood difference of a URL, character by character."""
    padded, total = urls.START * urls.ORDER + text + urls.END, 0
    for i in range(urls.ORDER, len(padded)):
        p = {}
        for c in "ab":
            p[c] = 1 / urls.SYMBOLS
            for k in range(urls.ORDER + 1):
                follow = counts[c][padded[i - k:i]]
                n, kinds = sum(follow.values()), len(follow)
                if n:
                    p[c] = (follow[padded[i]] + kinds * p[c]) / (n + kinds)
        total += math.floor(1e6 * math.log(p["a"] / p["b"]) + 0.5)
    return total / ((len(padded) - urls.ORDER) * 1e6)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_urls(spark, limit):
    import hashlib
    rng = random.Random(9)
    rows = []
    for i in range(300):
        host = rng.choice(["www.", "M.", ""]) + "".join(rng.choice("abc") for _ in range(4)) + rng.choice([".example.net", ".example.com", ".example.org", "net"])
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randint(1, 99)}{rng.choice(['', '/', '?q=1', '#x'])}"))
    rows += [(300, None), (301, ""), (302, "no scheme"), (303, "http://example.net"), (304, "ftp://x://y?z"), (5, rows[5][1]), (None, rows[6][1])]
    rows += [(400, "http://abca.example.org/es/1?q=http"), (401, "http://abca.example.org/es/1?q=#~^%zz")]
    pages = spark.createDataFrame([(i, u, "x", 1, "h", "p", 2, "r") for i, u in rows], "page_id long, url string, host string, window int, "
                                  "_host string, _path string, of_id int, row string")
    found = urls.judged(pages, broadcast_rows=limit).collect()
    assert Counter((r.page_id, r.url) for r in found) == Counter((i, u or "") for i, u in rows)
    queries = {r.page_id: r.score for r in found if r.page_id in (400, 401)}
    assert queries[400] != queries[401]  # they differ in the query string only
    counts = {c: defaultdict(Counter) for c in "ab"}

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    for r in found:
        assert r.rule == rule(r.host, r.path)[0]
        v = rule(r.host, r.path)[1]
        if v and hashlib.md5(r.url.encode()).hexdigest()[0] not in urls.CALIBRATION:
            padded = urls.START * urls.ORDER + r.url + urls.END
            for i in range(urls.ORDER, len(padded)):
                for k in range(urls.ORDER + 1):
                    counts["a" if v == "allow" else "b"][padded[i - k:i]][padded[i]] += 1
    for r in found:
        assert abs(ratio_of(r.url, counts) - r.score) < 1e-5
        if r.rule:
            assert r.verdict == rule(r.host, r.path)[1]
    judged = sorted((r.score, r.verdict) for r in found if not r.rule)
    assert [v for _, v in judged] == sorted((v for _, v in judged), reverse=True) or len({v for _, v in judged}) == 1
    parts = {r.page_id: (r.host, r.path) for r in found}
    assert parts[300] == parts[301] == parts[302] == ("", "") and parts[303] == ("example.net", "") and parts[304] == ("x:", "//y")
    kept = urls.allowed_pages(pages)
    assert kept.columns == pages.columns and kept.count() == sum(r.verdict == "allow" for r in found)
    assert urls.judged(pages.where("false")).count() == 0
    one = urls.judged(pages, rules=(("allow", "org", "/"),)).collect()
    assert all(r.verdict == "allow" for r in one)


def check_shards(rows, shards, tolerance):
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    mean = sum(sizes.values()) / shards
    assert max(abs(sizes[s] - mean) for s in range(shards)) <= tolerance * mean, sizes
    return sizes


def test_shards(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rng = random.Random(10)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"copy {i // 20}" * 15 if i % 3 == 1 else "x" * rng.randint(0, 400)) for i in range(12_000)]
    keys = sharding.stage(sharding.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)), "t")
    found = sharding.placed(keys, 6).collect()
    assert sorted((r.doc_id, r.size) for r in found) == sorted((i, len(t) + 8) for i, t in rows)
    check_shards(found, 6, 0.03)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.placed(keys.repartition(3), 6).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in found}
    text = dict(rows)
    of = defaultdict(set)
    for r in found:
        of[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in of.items() if not t.startswith("hot")) and len(of["hot text " * 20]) > 1
    small = sharding.placed(sharding.stage(sharding.keyed(docs), "t"), 4).collect()
    assert Counter(r.doc_id for r in small) == Counter(r[0] for r in rows_of())
    check_shards(small, 4, 4)
    assert {r.doc_id: (r.size, r.text_crc32) for r in small}[4] == (8, 0)
    assert sharding.placed(sharding.stage(sharding.keyed(no_docs), "t")).count() == 0


@pytest.mark.parametrize("sf,tolerance", [("sf0.01", 0.1), ("sf0.1", 0.06)])
def test_shards_of_tables(spark, sf, tolerance):
    found = sharding.op8(spark, f"/root/testdata/{sf}").collect()
    sizes = check_shards(found, 24, tolerance)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    assert len(found) == len(texts) and len(sizes) == 24
    groups = defaultdict(list)
    for r in found:
        groups[texts[r.doc_id] or ""].append(r)
    bound = sharding.WHOLE * sum(r.size for r in found) / 24
    together = [len({r.shard for r in g}) for g in groups.values() if len(g) > 1 and sum(r.size for r in g) <= bound]
    assert len(together) > 30 and set(together) == {1}  # no group below the bound is torn


def test_write_shards(spark, docs, tmp_path):
    out = sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    assert set(out.columns) == set(docs.columns) | {"slot"}
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert [(r.doc_id, r.text) for r in sorted(out.collect(), key=key)] == [(r.doc_id, r.text) for r in sorted(docs.collect(), key=key)]
    check = defaultdict(list)
    for r in out.collect():
        check[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in check.values())


def test_preference_pairs(spark):
    turn = lambda *xs: [{"role": r, "text": t} for r, t in xs]
    u, a = ("user", "hi"), ("assistant", "yes")
    cases = {
        1: (turn(u, a, u, a), turn(u, a, u, ("assistant", "no"))), 2: (turn(u, a), turn(u, a)),
        3: (turn(u, a), turn(("user", "x"), a)), 4: ([], turn(u)), 5: (turn(u, a, u), turn(u)),
        6: (turn(("", ""), ("assistant", "")), turn(("", ""))),
    }
    pairs = spark.createDataFrame([(i, c, r, "x", 1) for i, (c, r) in cases.items()], "conv_id long, chosen array<struct<role string, text string>>, "
                                  "rejected array<struct<role string, text string>>, prompt string, n_common int")
    show = lambda xs: "".join(f"<|{t['role']}|>\n{t['text']}<|end|>\n" for t in xs)
    for r in chat_pairs.preference_pairs(pairs).collect():
        c, j = cases[r.conv_id]
        n = next((i for i, (x, y) in enumerate(zip(c, j)) if x != y), min(len(c), len(j)))
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == (n, show(c[:n]), show(c[n:]), show(j[n:]))
        for side, spans in ((c[n:], r.chosen_mask), (j[n:], r.rejected_mask)):
            cut = [tuple(map(int, s.split("-"))) for s in spans.split(",") if s]
            assert [show(side)[p:q] for p, q in cut] == [t["text"] + "<|end|>\n" for t in side if t["role"] == "assistant"]


def test_conversations_awkward(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "a"), (1, None, None, None), (2, 0, "assistant", "w x y"),
            (None, 0, "user", "lost"), (3, 0, "user", None), (1, 0, "user", "a")]
    table = spark.createDataFrame([r + ("x",) for r in rows], "conv_id long, turn long, role string, text string, turns string")
    found = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_pairs.conversations(table).collect()}
    assert found == {1: [("", ""), ("user", "a"), ("user", "a"), ("assistant", "a"), ("assistant", "b")], 2: [("assistant", "w x y")], 3: [("user", "")]}
    assert chat_pairs.conversations(table.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op1_preference_pairs", "op7_license_scan", "op9_benchmark_decontamination", "op10_url_language_models"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = registry.QUERIES[name](spark, sf)
    cols = sorted(found.columns)
    expected = con.execute(f"select {', '.join(cols)} from ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(*cols).collect()))) == sorted(map(repr, expected))


def test_entry():
    found = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline(spark, sf, tmp_path):
    """Each stage against the operator's verdicts on the stage's own input."""
    from cohortlens.llm import quality, simhash, toxicity
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            model = toxicity.train(docs, labels.where(~toxicity.held_out(labels.doc_id)))
            assert ids(out) == ids(docs.where(toxicity.judged(docs.text, model)["score"] < 0.5))
        if name == "simhash_near_dedup":
            assert ids(out) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert ids(out) == Counter(r.doc_id for r in docs.collect() if not leaks(r.text, items)[0])
        if i < 4:
            assert out.columns == columns and out.count() > 0
            docs = out
    assert set(r.doc_id for r in out.collect()) == set(ids(docs))
    assert corpus_pipeline.run(spark, sf).count() == out.count()


def test_pipeline_awkward(spark, docs, no_docs, tmp_path):
    for table, where in ((docs, "some"), (no_docs, "none")):
        folder = tmp_path / where
        spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "one"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        at = table
        for name, step in corpus_pipeline.STAGES:
            step(spark, at, str(folder)).write.parquet(f"{folder}/{name}")
            at = spark.read.parquet(f"{folder}/{name}")
        assert Path(f"{folder}/best_fit_packing").exists()
