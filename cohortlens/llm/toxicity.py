"""Toxicity by multiple-instance learning.

A document is a bag of sentences (pieces between ``.``, ``!``, ``?`` and line ends). A sentence has
the probability sigmoid(bias + sum of the weights of its distinct words' features); the document's score is
their noisy-or, 1 - prod(1 - p). Only document labels are needed: the weights are fitted by
gradient steps on the likelihood of the labels under the noisy-or, and the fitted sentence
probabilities then name the offending sentences.

Fitting uses a bounded sample: about ``SAMPLE`` labelled documents of each class, chosen by a hash
of the id (all of them while there are fewer), and of these, in the hash's order, those that begin
within the first ``SAMPLE_WORDS`` words of their class; weighted back to the class sizes. Of rows that share an id, one
is in the sample. Word statistics of that sample are counted by Spark; words and word beginnings whose class difference is significant,
at most ``VOCABULARY`` of them, become features. Scoring reads every word of every text. The sample's ids
are broadcast (bounded by its size), texts are never shuffled.

Null and empty texts have no sentence and score 0. Words are maximal runs of letters, lower-cased.
Repeated rows are scored each; a document that is labelled more than once is toxic if one label
says so. Without two classes in the labels every score is 0. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import ship, stage
from .registry import register

SAMPLE = 8_000
SAMPLE_WORDS = 4_000_000  # words of each class, so that long documents cannot outgrow the driver
VOCABULARY = 2_000
LEAST_G2 = 12.0
LEAST_DOCS = 3
STEPS, RATE, SHRINK = 300, 0.3, 1e-3
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
STOPS = frozenset(".!?\n")
ship(__name__)


class Known(dict):
    """Word -> its features among ``names`` (the word, and its first four and five letters, so that
    inflected and compound words count). Looked-up words are remembered, up to a bound."""

    def __init__(self, names, most: int = 100_000):
        super().__init__()
        self.names, self.most = names, most

    def __missing__(self, word: str) -> tuple:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = tuple(f for f in features(word) if f in self.names)
        return found


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (4, 5) if len(word) >= n)]


def bag(text: str | None, known: Known) -> tuple[list[list], int]:
    """The sentences with a known feature, as ``[first, last, features of their distinct words]``
    (places of the first and behind the last letter in the lower-cased text), and the number of
    other sentences."""
    low = (text or "").lower()
    tokens = TOKEN.findall(low)
    hits, rest, words, any_known = [], 0, False, False
    for t in tokens:
        if t not in STOPS:
            words = True
            if known[t]:
                any_known = True
                break
        elif words:
            rest, words = rest + 1, False
    if not any_known:
        return [], rest + words
    rest, first, last, seen = 0, None, 0, set()

    def close():
        nonlocal rest
        if first is not None:
            found = [f for w in sorted(seen) for f in known[w]]
            if found:
                hits.append([first, last, found])
            else:
                rest += 1

    for m in TOKEN.finditer(low):
        t = m.group()
        if t in STOPS:
            close()
            first, seen = None, set()
        else:
            first = m.start() if first is None else first
            last = m.end()
            seen.add(t)
    close()
    return hits, rest


def chosen(labels: DataFrame, sample: int) -> DataFrame:
    """A hash sample ``(doc_id, toxic, weight)`` of about ``sample`` labelled ids of each class."""
    one = (labels.where("doc_id is not null and toxic is not null")
           .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    one = stage(one, "toxicity-labels")
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share: Column = F.lit(1.0)
    for c, n in sizes.items():
        share = F.when(F.col("toxic") == c, F.lit(min(1.0, sample / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1e6
    return one.where(place < share).select("doc_id", "toxic", (1 / share).alias("weight"))


def vocabulary(bags: DataFrame, most: int) -> dict[str, int]:
    """The words whose share of documents differs most between the classes (G2 statistic)."""
    words = bags.select("toxic", "weight", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(
        F.count("*").alias("n"), F.sum(F.expr("if(toxic = 1, weight, 0)")).alias("a"),
        F.sum(F.expr("if(toxic = 0, weight, 0)")).alias("b"), F.sum("weight").alias("w"))
    total = bags.agg(F.sum(F.expr("if(toxic = 1, weight, 0)")).alias("ta"), F.sum(F.expr("if(toxic = 0, weight, 0)")).alias("tb"))
    seen = counts.where(f"n >= {LEAST_DOCS}").join(F.broadcast(total))  # one row of totals
    part = lambda o, e: f"if({o} > 0, {o} * ln({o} / ({e})), 0)"
    t = "(ta + tb)"
    g2 = "2 * (" + " + ".join([part("a", f"w * ta / {t}"), part("b", f"w * tb / {t}"),
                               part("(ta - a)", f"({t} - w) * ta / {t}"), part("(tb - b)", f"({t} - w) * tb / {t}")]) + ")"
    best = seen.select("word", F.expr(g2).alias("g2")).where(f"g2 >= {LEAST_G2}").orderBy(F.desc("g2"), "word").limit(most)
    return {r["word"]: i for i, r in enumerate(best.collect())}


class Bags:
    """Labelled bags as flat arrays, from ``(label, weight, number of features of each sentence that
    has some, the numbers of these features, number of other sentences)``."""

    def __init__(self, rows: list[tuple]):
        self.label = np.array([r[0] for r in rows], float)
        self.weight = np.array([r[1] for r in rows], float)
        self.weight /= self.weight.sum()
        self.rest = np.array([r[4] for r in rows], float)
        sizes = [np.frombuffer(r[2], np.int32) for r in rows]
        self.doc = np.repeat(np.arange(len(rows)), [len(s) for s in sizes])
        self.sentence = np.repeat(np.arange(len(self.doc)), np.concatenate([*sizes, np.empty(0, np.int32)]))
        self.word = np.concatenate([*(np.frombuffer(r[3], np.int32) for r in rows), np.empty(0, np.int32)])


def loss_and_gradient(theta, bags: Bags):
    """Weighted negative log-likelihood of the labels under the noisy-or, with a penalty of the
    weights; ``theta`` has the weights and, last, the bias."""
    size = len(theta) - 1
    z = theta[-1] + np.bincount(bags.sentence, theta[bags.word], minlength=len(bags.doc))
    soft = lambda x: np.logaddexp(0, x)  # noqa: E731  -log(1 - p)
    safe = np.bincount(bags.doc, soft(z), minlength=len(bags.label)) + bags.rest * soft(theta[-1])
    safe = np.clip(safe, 1e-9, 50)
    toxic = bags.label > 0
    loss = (bags.weight * np.where(toxic, -np.log(-np.expm1(-safe)), safe)).sum()
    # d loss / d safe: 1 for label 0, -1 / (exp(safe) - 1) for label 1
    outer = bags.weight * np.where(toxic, -1 / np.expm1(safe), 1.0)
    inner = outer[bags.doc] / (1 + np.exp(-z))
    grad = np.append(np.bincount(bags.word, inner[bags.sentence], minlength=size),
                     inner.sum() + (outer * bags.rest).sum() / (1 + np.exp(-theta[-1])))
    penalty = SHRINK / max(size, 1)
    grad[:-1] += penalty * theta[:-1]
    return loss + penalty / 2 * (theta[:-1] ** 2).sum(), grad


def fit(bags: Bags, size: int):
    """Weights and bias by Adam steps."""
    theta = np.zeros(size + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        _, grad = loss_and_gradient(theta, bags)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, words: int = SAMPLE_WORDS) -> tuple[dict[str, float], float]:
    """Word weights and bias from the labelled documents among ``labels(doc_id, toxic)``."""
    ids = stage(chosen(labels, sample), "toxicity-sample")
    if ids.select("toxic").distinct().count() < 2:
        return {}, float("-inf")
    one = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
           .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "weight")
           .agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    one = stage(one.withColumn("n", F.size(F.split("text", r"\s+"))), "toxicity-texts")
    # at most the sample's rows: their places in the hash's order, by words
    upto = F.expr("sum(n) over (partition by toxic order by xxhash64(doc_id, 'toxicity'), doc_id) - n")
    within = one.select("doc_id", "toxic", "weight", upto.alias("before")).withColumn("all", F.expr("sum(weight) over (partition by toxic)"))
    within = within.where(F.col("before") < words).withColumn("weight", F.expr("weight * all / sum(weight) over (partition by toxic)"))
    texts = one.drop("toxic", "weight").join(F.broadcast(within.select("doc_id", "toxic", "weight")), "doc_id").select("text", "toxic", "weight")
    texts = stage(texts, "toxicity-sample-texts")

    def distinct_words(batches):
        for pdf in batches:
            pdf["words"] = [sorted({f for w in set(TOKEN.findall((x or "").lower())) - STOPS for f in features(w)})
                            for x in pdf["text"]]
            yield pdf[["words", "toxic", "weight"]]

    numbers = vocabulary(texts.mapInPandas(distinct_words, "words array<string>, toxic int, weight double"), VOCABULARY)

    def bags(batches):
        known = Known(numbers)
        for pdf in batches:
            found = [bag(x, known) for x in pdf["text"]]
            pdf["sizes"] = [np.array([len(s[2]) for s in hits], np.int32).tobytes() for hits, _ in found]
            pdf["features"] = [np.array([numbers[w] for s in hits for w in s[2]], np.int32).tobytes() for hits, _ in found]
            pdf["rest"] = [rest for _, rest in found]
            yield pdf[["toxic", "weight", "sizes", "features", "rest"]]

    rows = texts.mapInPandas(bags, "toxic int, weight double, sizes binary, features binary, rest int")
    # at most the sample's words, four bytes each; in an order that does not depend on the partitions
    weights, bias = fit(Bags(sorted(map(tuple, rows.collect()))), len(numbers))
    return {w: float(weights[i]) for w, i in numbers.items()}, bias


def score(text: str | None, known: Known, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Noisy-or of the sentences, and the sentences of probability 1/2 or more."""
    if bias == float("-inf"):
        return 0.0, []
    hits, rest = bag(text, known)
    weights = known.names
    soft = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    safe, found = rest * soft(bias), []
    for first, last, names in hits:
        z = bias + sum(weights[f] for f in names)
        safe += soft(z)
        if z >= 0:
            found.append((first, last, 1 / (1 + math.exp(-z))))
    return -math.expm1(-safe), found


def judged(text: Column, model: tuple[dict[str, float], float]) -> Column:
    """``struct<score, offending>`` of a text column: its score and its offending sentences."""
    weights, bias = model

    @F.pandas_udf("struct<score double, offending array<struct<first int, last int, p double>>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known(weights)
        for texts in batches:
            found = [score(x, known, bias) for x in texts]
            yield pd.DataFrame({"score": [s for s, _ in found], "offending": [
                [{"first": a, "last": b, "p": p} for a, b, p in o] for _, o in found]})
    return judge(text)


def held_out(doc_id: Column) -> Column:
    """The fold that labels are not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score below 1/2, all columns as they were; labels of the held-out fold
    are not used."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), id_col, text_col)
    return docs.where(judged(F.col(text_col), model)["score"] < 0.5)


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", judged(F.col("text"), model).alias("j"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "j.score",
                      (F.col("j.score") >= 0.5).cast("int").alias("predicted"), "j.offending")
