"""Small tables with the awkward cases that every operator and stage has to take: nulls in any
column, empty and very long texts, copies, repeated rows, and columns whose names clash."""

from __future__ import annotations

import random

import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, _id long, fp long, "
        "part int, shard int, bucket int, score double, words string, hash long, k0 string, "
        "_found_id long, _found_hash long, _found_row long, row string, text_key string, of_id long, row_hash long")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


def text_of(seed: int, sentences: int = 12) -> str:
    rng = random.Random(seed)
    return "\n".join(sentence(rng, rng.randint(6, 14)).capitalize() for _ in range(sentences))


def rows_of() -> list[tuple]:
    texts = {
        1: text_of(1), 2: text_of(2), 3: text_of(1), 4: None, 5: "", 6: " \n\t ", 7: text_of(3, 4000), 8: "one",
        9: "Licensed under the Apache License, Version 2.0.\n" + text_of(4), 10: "\x00 a\u00a0b Ünï \U0001f600 <|endoftext|> x",
        11: text_of(2) + " tail", 12: text_of(5), 13: "a b c " * 400, 14: text_of(6) + "\r\n\r\n", 15: text_of(7),
    }
    rows = [(i, t, None if i == 12 else "en" if i % 2 else "de", None if i == 14 else f"s{i % 3}", None if i == 2 else len(t or ""))
            for i, t in texts.items()]
    rows += [(15, texts[15], "en", "s0", 1), (None, text_of(8), "en", "s1", 5)]  # a repeated row, a row without id
    return [r + (7, 1, 2, 3, 4, 0.5, "w", 6, "k", 1, 2, 3, "r", "t", 4, 5) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows_of(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
