"""Ranked search, whitening and personal data against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from cohortlens.llm import lexical, personal_data, registry, whitening
from cohortlens.sources.tables import table
from conftest import rows_of, text_of

registry.load_all()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- search

def terms(text: str | None) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """Every document scored for every item."""
    read = [(d, Counter(terms(t))) for d, t in docs]
    read = [(d, c, sum(c.values())) for d, c in read if c]
    n_all, l_all = len(read), sum(n for _, _, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in read:
            m = 100 - 50 + (50 * n * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


ITEMS = [(1, " ".join(text_of(2).split()[5:30])), (2, "one"), (3, None), (4, ""), (5, "a b c A"), (7, text_of(7)), (7, text_of(7)),
         (None, text_of(5)), (8, "Ünï x"), (9, "zzzz notthere"), (10, text_of(1) + text_of(3, 40))]


@pytest.mark.parametrize("terms_bytes,query_block,k", [(1 << 20, 100, 3), (0, 4, 50)])
def test_search(spark, docs, no_docs, terms_bytes, query_block, k):
    items = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in ITEMS], "item_id long, text string, query int, term string, rank int")
    found = lexical.ranked(docs, items, k, terms_bytes=terms_bytes, query_block=query_block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = ranking([(r[0], r[1]) for r in rows_of()], ITEMS, k)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)
    assert lexical.ranked(no_docs, items).count() == 0
    assert lexical.ranked(docs, items.where("false")).count() == 0
    assert lexical.ranked(docs, items.where("item_id in (3, 4, 9)")).count() == 0


def test_search_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 150)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 120)))) for i in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=8))) for i in range(20)]
    found = lexical.ranked(spark.createDataFrame(texts, "doc_id long, text string").coalesce(2),
                           spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted(map(tuple, found.collect())) == sorted(ranking(texts, items, 10))


def test_blocks_are_skipped_without_loss(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(4)
    texts = [" ".join(["common"] * rng.randint(1, 3) + [f"x{rng.randint(0, 40)}" for _ in range(rng.randint(1, 60))]) for _ in range(2000)]
    texts[1000:1003] = ["rare common common"] * 3
    built = lexical.Builder(None)
    for i, t in enumerate(texts):
        built.add(i, t)
    names = [part.split()[0] for part in lexical.SEGMENT.split(", ")]
    segment = lexical.Segment(dict(zip(names, built.segment())), 2000, sum(len(t.split()) for t in texts))
    query, best = [(b"common", 5), (b"rare", 9000), (b"x7", 3)], lexical.Best(3)
    lexical.search(segment, query, best)
    assert set(best.ids.tolist()) == {1000, 1001, 1002}
    again, read = lexical.Best(3), set()
    again.add(best.scores, best.ids, best.no_id)  # a threshold from the start
    lexical.search(segment, query, again, read)
    assert 0 < len(read) < 10 < len(segment.blocks(segment.number[b"common"]))


def test_search_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    expected = con.execute(registry.ORACLE["op13_block_max_search"]).fetchall()
    found = registry.QUERIES["op13_block_max_search"](spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_very_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PART", 50)
    text = text_of(9, 60) + " Ünïcode-ß " * 20
    assert [t.decode() for part in lexical.terms_of(text) for t in part] == terms(text)


# --- whitening

def by_faddeev(matrix: list[list[int]]) -> list[int]:
    """Characteristic polynomial, lowest first, by traces of powers in fractions."""
    d = len(matrix)
    power, out = [[Fraction(i == j) for j in range(d)] for i in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        power = [[sum(matrix[i][m] * power[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(power[i][i] for i in range(d)) / k
        out.append(c)
        for i in range(d):
            power[i][i] += c
    return [int(x) for x in reversed(out)]


def test_characteristic_polynomial_is_exact(spark):
    rng = random.Random(5)
    for d, rank in ((1, 1), (2, 2), (6, 6), (7, 3)):
        rows = [[rng.randint(-10 ** 7, 10 ** 7) for _ in range(d)] for _ in range(rank)]
        matrix = [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]
        poly = whitening.characteristic_polynomial(spark, matrix)
        assert poly == by_faddeev(matrix)
        assert whitening.roots_above(poly, 0, 0) == rank
        assert whitening.roots_above(poly, -1, 0) == d


def test_roots_repeated_and_close():
    roots = [9, 9, 9, 5, 5, 4, 0, 0]
    poly = [1]
    for r in roots:  # times (x - r)
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    for k, r in enumerate(roots, 1):
        assert whitening.kth_root(poly, k, sum(roots), 40) == r << 40
    poly = [2, -4, 1]  # 2 +- sqrt(2)
    for k, r in ((1, 2 + Fraction(math.isqrt(2 << 200), 1 << 100)), (2, 2 - Fraction(math.isqrt(2 << 200), 1 << 100))):
        assert abs(Fraction(whitening.kth_root(poly, k, 4, 80), 1 << 80) - r) <= Fraction(1, 1 << 79)


def check_whitened(found, x: np.ndarray, ids: list[int], components: int) -> None:
    n, centred = len(x), x - x.mean(0)
    v = centred.T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1]
    white = np.zeros((n, components))
    for r in found:
        i = ids.index(r.vec_id)
        white[i, r.component - 1] = r.whitened
        assert r.n == n and int(r.deviation) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], x.sum(0)))
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-8
    # components are eigenvectors: whitened values reproduce v's products
    unit = np.linalg.lstsq(white * np.sqrt(values[:components]), centred, rcond=None)[0]
    assert np.allclose(unit @ unit.T, np.eye(components), atol=1e-8)
    assert np.allclose(unit @ v, values[:components, None] * unit, atol=1e-6 * values[0])


def test_whitening(spark, sf):
    rows = table(spark, sf, "embeddings")
    found = whitening.whiten(rows).collect()
    read = rows.collect()
    x = np.floor(1024 * np.array([r.embedding for r in read], float)) + 100_000
    assert len(found) == 8 * len(read)
    check_whitened(found, x, [r.vec_id for r in read], 8)


def test_whitening_of_repeated_variances(spark):
    """Two pairs of equal variances: any orthogonal directions of a plane are right."""
    x = [(i, [a / 1024, b / 1024, c / 1024, d / 1024]) for i, (a, b, c, d) in enumerate(
        [(s * (k == 0) * 90, s * (k == 1) * 90, s * (k == 2) * 40, s * (k == 3) * 40) for k in range(4) for s in (1, -1)])]
    found = whitening.whiten(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()
    check_whitened(found, np.array([[v * 1024 + 100_000 for v in r[1]] for r in x]), [r[0] for r in x], 4)


def test_whitening_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.1, 1.5, 3.0]), (3, [7.0, 1e-9, 1e5]), (3, [7.0, 1e-9, 1e5]), (None, [0.0, -3.0, 0.25]), (5, [1e9, 2e9, -4e10])]
    bad = [(10, None), (11, [1.0, None, 2.0]), (12, [nan, 1.0, 1.0]), (13, [1.0, inf, 1.0]), (14, [1.0, -inf, 1.0]), (15, []), (16, [1.0, 2.0]), (17, [1.0, 1e300, 1.0])]
    kind = "vec_id long, embedding array<double>, k0 long, v int, vector string, deviation int, component int, n int"
    rows = spark.createDataFrame([r + (1, 2, "x", 3, 4, 5) for r in good + bad], kind).repartition(3)
    found = whitening.whiten(rows).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x)]
    assert Counter((r.vec_id, r.component) for r in found) == Counter((g[0], c) for g in good for c in (1, 2, 3))
    exact = {g[0]: sum((n * a - b) ** 2 for a, b in zip(v, s)) for g, v in zip(good, x)}
    assert all(int(r.deviation) == exact[r.vec_id] and r.n == n and r.identity_error < 1e-4 for r in found)
    assert whitening.whiten(rows.where("vec_id = 3")).count() == 0  # equal vectors: no variance
    assert whitening.whiten(rows.where("vec_id = 2")).count() == 0
    assert whitening.whiten(rows.where("vec_id = 15")).count() == 0
    assert whitening.whiten(rows.where("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_limbs_of_large_sums():
    for v in (0, 1, -1, 2 ** 60, -2 ** 60 - 1, 12345 ** 20, -(7 ** 90)):
        assert sum(x << 60 * i for i, x in enumerate(whitening.limbs(v))) == v
    y = np.array([[2 ** 61, -3], [2 ** 61, 5]], np.int64)
    assert whitening.exact_products(y) == [[2 ** 123, 2 ** 62], [2 ** 62, 34]]


# --- personal data

RULES = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def valid(kind: str, s: str) -> bool:
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        back = digits[::-1]
        return 12 <= len(digits) <= 19 and (sum(back[::2]) + sum(sum(divmod(2 * x, 10)) for x in back[1::2])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    return sorted((m.start(), i, m.end()) for i, (k, r) in enumerate(RULES.items()) for m in r.finditer(text or "") if valid(k, m[0]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{list(RULES)[k]}:{a}:{b}" for a, k, b in spans)


HARD = ["", "a@b", "x@y.z", "a@b.c_d@e.f, a.b+c%d@e-f.g.h.", "@x.y a@.b", "1.2.3", "1.2.3.4.5.6.7.8", "256.1.2.3.4 0255.000.1.2 300.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "41111111111111110000 12", "+1 (269) 555-3296 4524132264652876",
        "+1 (608) 555-2280 37.92.178.161", "+49 30 123456", "+12345678", "+1.234.567.890 - + 5", "ßÜ 😀 +1 (017) 555-7713 😀 me@mäil.example.com x@mail.example.com",
        "a" * 5000 + "@" + "b." * 3000 + "c", "1" * 30000, "1." * 20000 + "1", "+1" + "(" * 20000, "a." * 20000, "1 2-3 " * 8000, "0 at x.com"]


def luhn_card(rng: random.Random) -> str:
    while not valid("card", s := "4" + "".join(rng.choice("0123456789") for _ in range(15))):
        pass
    return s


def planted() -> list[tuple[int, str]]:
    """Texts with one item each, numbers of no kind, and some whose items stand side by side."""
    rng, out = random.Random(6), []
    phone = lambda: f"+1 ({rng.randint(0, 999):03d}) 555-{rng.randint(0, 9999):04d}"
    ip = lambda: ".".join(str(rng.randint(10, 255)) for _ in range(4))
    for i in range(1200):
        item = [lambda: luhn_card(rng), phone, ip, lambda: f"{rng.randint(1000, 10 ** 9)}", lambda: f"n{i}.x@mail{i % 9}.example.com",
                lambda: "7" + f"{rng.randint(0, 10 ** 15):015d}"][i % 6]()
        out.append((i, text_of(i, 1)[:40] + " " + item + " " + text_of(i + 5000, 1)[:30]))
    for i in range(2000, 2012):
        out.append((i, "word " + phone() + " " + luhn_card(rng) + " more"))
    return out


def test_personal_base_rules_equal_the_patterns(spark, docs):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(1000 + i, r[1]) for i, r in enumerate(rows_of())]
    kind = "doc_id long, text string, spans int, text_key int, kind int, score int, label int, start int"
    found = personal_data.personal_data(spark.createDataFrame([r + (1,) * 6 for r in rows], kind)).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r.base_spans] == base_spans(texts[r.doc_id]), r.doc_id
        assert [tuple(s) for s in r.spans] == [tuple(s) for s in r.base_spans]  # too few to judge more


def test_personal_candidates_beyond_the_base(spark):
    rows = planted()
    found = {r.doc_id: r for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base, spans = ([tuple(s) for s in x] for x in (found[i].base_spans, found[i].spans))
        assert base == base_spans(text) and set(base) <= set(spans)
        if i < 1200:
            assert spans == base, text  # numbers of no kind stay
        else:
            got = {text[a:b] for a, _, b in spans}
            assert text[5:22] in got and text[23:39] in got, (text, got)


def test_personal_query(spark, docs, no_docs, sf):
    found = registry.QUERIES["op11_personal_data"](spark, sf)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(","))
    assert personal_data.personal_data(docs).count() == docs.count()  # repeated rows and rows without id
    assert personal_data.personal_data(no_docs).count() == 0
