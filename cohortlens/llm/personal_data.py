"""Personal data: high-recall candidates judged by boosted trees (DataFrame functions only).

Base rules find e-mail addresses, IP addresses, card and phone numbers, leftmost and without
overlap in a kind, and drop matches that fail a kind's check. They miss what stands too close
together: a phone number before a card number is one match of too many digits.

- *Candidates.* Runs of digits and their punctuation are cut at spaces; every stretch of one to five
  parts with a fitting number of digits is proposed as a phone and as a card number, every part of
  four short numbers as an IP address. Further, addresses with ``@``, ``(at)``, ``[at]`` or `` at ``.
  Candidates of different lengths and kinds overlap.
- *Labels.* A candidate that is a base span is personal data; one that touches a match that was
  dropped, but is another span, is of unknown label; the others are not personal data.
- *Trees.* Boosted trees see the format (digits, groups, punctuation, check sum, length of the
  name, labels of the domain) and the context (the characters before and after, digits near by), but
  neither the plus sign nor the kind of at sign, which alone would repeat the base rules. They are
  fitted on four of five texts: the different combinations of features and label with their counts,
  at most ``FIT_ROWS`` of them, chosen by a hash.
- *Thresholds.* On the fifth text the scores of each kind are gone through from above; the threshold
  is the lowest score for which at least ``PRECISION`` of the labelled candidates above it, and at
  least ``LEAST`` of them, are personal data (no threshold: the kind gets no further spans).
- *Selection.* Candidates beyond the threshold that touch no base span are added; of a chain of
  overlapping ones, the best scored.

Base spans always stay. Positions are code points, the end is exclusive. Equal texts are judged once.
Null and empty texts have no spans. Repeated rows give a row each; rows without an id too. Empty
tables give no rows. Without labelled candidates of both classes only base spans are returned.
Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import let, stage
from .registry import register

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# A match can only begin where a run of its first class begins or the last match ended; the
# possessive quantifiers give the same matches as plain ones, without deep recursion.
NAME = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
PATTERNS = (
    NAME + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
OCTETS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
RUN = r"[+(]?[0-9](?:[\x20().+-]{0,3}+[0-9])*+"
SHORT_PARTS = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
LOOSE_EMAIL = (NAME + r"(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++"
               r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++")
PARTS = 5  # parts of a run in one candidate
NEAR = 12  # characters of context to each side
FIT_ROWS = 50_000
TREES, DEPTH = 20, 4
PRECISION, LEAST = 0.98, 20
BASE, DROPPED, CANDIDATE = range(3)
SPAN = "array<struct<what:int,kind:int,start:int,end:int,s:string,before:string,after:string>>"
FEATURES = ("kind", "chars", "digits", "spaces", "dots", "hyphens", "parens", "first_group", "last_group", "longest_group",
            "check_sum", "octets", "name", "name_digits", "domain_labels", "last_label", "last_label_letters",
            "char_before", "char_after", "digits_before", "digits_after", "assigned")


def prefix_sums(numbers: Column) -> Column:
    """Running sums of an array of longs, by doubling."""
    def add(a: Column, step: Column) -> Column:
        return F.transform(a, lambda x, i: x + F.when(i >= step, F.get(a, i - step)).otherwise(F.lit(0)))

    rounds = F.ceil(F.log2(F.size(numbers) + 1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), rounds), numbers, lambda a, k: add(a, F.pow(F.lit(2), k).cast("int")))


def matches(text: Column, pattern: str) -> Column:
    """All matches: ``(start, end, s, before, after)``, the context up to the next match."""
    def places(x: Column) -> Column:
        sizes = F.transform(x["gap"], lambda g, i: (F.char_length(g) + F.when(
            i > 0, F.char_length(F.get(x["hit"], i - 1))).otherwise(F.lit(0))).cast("long"))
        return let(prefix_sums(sizes), lambda at: F.transform(x["hit"], lambda h, i: F.struct(
            F.get(at, i).cast("int").alias("start"), (F.get(at, i) + F.char_length(h)).cast("int").alias("end"), h.alias("s"),
            F.right(F.get(x["gap"], i), F.lit(NEAR)).alias("before"), F.left(F.get(x["gap"], i + 1), F.lit(NEAR)).alias("after"))))

    return let(F.struct(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")), places)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check sum."""
    def value(i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: int, s: Column) -> Column:
    """A base match's check."""
    if kind == IP:
        return s.rlike(OCTETS)
    if kind == CARD:
        return let(digits_of(s), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == PHONE:
        return F.length(digits_of(s)).between(9, 15)
    return F.lit(True)


def span(what: Column, kind: int, start: Column, end: Column, s: Column, before: Column, after: Column) -> Column:
    return F.struct(what.cast("int").alias("what"), F.lit(kind).alias("kind"), start.cast("int").alias("start"),
                    end.cast("int").alias("end"), s.alias("s"), before.alias("before"), after.alias("after"))


def base(text: Column, kind: int) -> Column:
    """The base matches of a kind, those that fail its check marked as dropped; the strings of the
    matches are not kept."""
    nothing = F.lit("")
    return F.transform(matches(text, PATTERNS[kind]), lambda m: span(
        F.when(passes(kind, m["s"]), F.lit(BASE)).otherwise(F.lit(DROPPED)), kind, m["start"], m["end"], nothing, nothing, nothing))


def addresses(text: Column) -> Column:
    return F.transform(matches(text, LOOSE_EMAIL), lambda m: span(
        F.lit(CANDIDATE), EMAIL, m["start"], m["end"], m["s"], m["before"], m["after"]))


def numbers(text: Column) -> Column:
    """Phone, card and IP candidates of the runs of digits."""
    def stretches(run: Column) -> Column:
        def of(t: Column) -> Column:
            pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(t["parts"]) - 1), lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(PARTS), F.size(t["parts"]) - i)), lambda k: F.struct(
                    i.alias("i"), k.alias("k"),
                    (F.get(t["digits"], i + k - 1) - F.when(i > 0, F.get(t["digits"], i - 1)).otherwise(F.lit(0))).alias("n")))))
            return F.transform(F.filter(pairs, lambda p: p["n"].between(4, 19)), lambda p: stretch(run, t, p["i"], p["k"], p["n"]))

        parts = F.split(run["s"], " ", -1)
        cut = let(parts, lambda x: F.struct(
            x.alias("parts"), prefix_sums(F.transform(x, lambda y: (F.char_length(y) + 1).cast("long"))).alias("ends"),
            prefix_sums(F.transform(x, lambda y: F.length(digits_of(y)).cast("long"))).alias("digits")))
        return let(cut, of)

    def stretch(run: Column, t: Column, i: Column, k: Column, n: Column) -> Column:
        """A stretch without punctuation at its ends (but for an opening plus sign or bracket)."""
        joined = F.array_join(F.slice(t["parts"], i + 1, k), " ")
        lead = F.char_length(F.regexp_extract(joined, r"^[^0-9+(]*", 0))
        s = F.regexp_extract(joined, r"[+(]*[0-9](?:.*[0-9])?", 0)
        start = run["start"] + F.when(i > 0, F.get(t["ends"], i - 1)).otherwise(F.lit(0)) + lead
        before = F.concat(F.when(i < 3, run["before"]).otherwise(F.lit("")), F.array_join(
            F.slice(t["parts"], F.greatest(i - 2, F.lit(1)), F.least(F.lit(3), i)), " "), F.when(i > 0, F.lit(" ")).otherwise(F.lit("")))
        more = F.size(t["parts"]) - i - k
        after = F.concat(F.when(more > 0, F.lit(" ")).otherwise(F.lit("")), F.array_join(
            F.slice(t["parts"], i + k + 1, F.greatest(F.least(F.lit(3), more), F.lit(0))), " "),
            F.when(more < 3, run["after"]).otherwise(F.lit("")))
        return F.struct(start.alias("start"), s.alias("s"), n.alias("n"), k.alias("k"),
                        F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

    def kinds(c: Column) -> Column:
        one = lambda kind: span(F.lit(CANDIDATE), kind, c["start"], c["start"] + F.char_length(c["s"]), c["s"],
                                c["before"], c["after"])
        proposed = F.array(F.when(c["n"].between(9, 15), one(PHONE)), F.when(c["n"].between(12, 19), one(CARD)),
                           F.when((c["k"] == 1) & c["s"].rlike(SHORT_PARTS), one(IP)))
        return F.filter(proposed, lambda x: x.isNotNull())

    runs = F.filter(matches(text, RUN), lambda r: F.length(digits_of(r["s"])) >= 4)
    return F.flatten(F.transform(F.flatten(F.transform(runs, stretches)), kinds))


def found_spans(text: Column) -> Column:
    """All base, dropped and candidate spans of a text. A pattern is only tried where the text has
    what every match of it has."""
    none = F.array().cast(SPAN)
    digits = text.rlike(r"[0-9]")
    at = text.contains("@")
    parts = [
        F.when(at, base(text, EMAIL)),
        F.when(digits & text.rlike(r"[0-9]\.[0-9]"), base(text, IP)),
        F.when(digits & text.rlike(r"[0-9][\x20-]?[0-9]"), base(text, CARD)),
        F.when(text.contains("+"), base(text, PHONE)),
        F.when(at | text.contains("(at)") | text.contains("[at]") | text.contains(" at "), addresses(text)),
        F.when(text.rlike(r"[0-9](?:[\x20().+-]{0,3}+[0-9]){3}"), numbers(text)),
    ]
    return F.concat(*[F.coalesce(p.cast(SPAN), none) for p in parts])


def char_class(c: Column) -> Column:
    return (F.when(F.length(c) == 0, 0).when(c == "\n", 1).when(c.rlike(r"^\s"), 2).when(c.rlike(r"^\p{L}"), 3)
            .when(c.rlike(r"^[0-9]"), 4).when(c.isin(".", ",", ";", "!", "?", ":"), 5).otherwise(6))


def with_features(spans: DataFrame) -> DataFrame:
    """The format and context of candidates, as integers."""
    s, of = F.col("s"), lambda kind, x: F.when(F.col("kind") == kind, x).otherwise(F.lit(-1))
    count = lambda chars: F.length(F.regexp_replace(s, f"[^{chars}]+", ""))
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: F.length(g) > 0)
    sizes = F.transform(groups, lambda g: F.length(g))
    whole = F.regexp_extract(s, r"^([A-Za-z0-9._%+-]+)", 1)
    domain = F.split(F.regexp_replace(F.regexp_extract(s, r"(?:@|\(at\)|\[at\]| at )\x20?(.*)$", 1), r"\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20", "."), r"\.")
    last = F.element_at(domain, -1)
    made = {
        "chars": F.char_length(s), "digits": count("0-9"), "spaces": of(PHONE, count(r"\x20")), "dots": count("."),
        "hyphens": count(r"\-"), "parens": count("()"),
        "first_group": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), "last_group": F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        "longest_group": F.coalesce(F.array_max(sizes), F.lit(0)),
        "check_sum": of(CARD, luhn(digits_of(s)).cast("int")), "octets": of(IP, s.rlike(OCTETS).cast("int")),
        "name": of(EMAIL, F.length(whole)), "name_digits": of(EMAIL, F.length(digits_of(whole))),
        "domain_labels": of(EMAIL, F.size(domain)), "last_label": of(EMAIL, F.length(last)),
        "last_label_letters": of(EMAIL, last.rlike("^[A-Za-z]+$").cast("int")),
        "char_before": char_class(F.right("before", F.lit(1))), "char_after": char_class(F.left("after", F.lit(1))),
        "digits_before": F.length(digits_of(F.col("before"))), "digits_after": F.length(digits_of(F.col("after"))),
        "assigned": F.col("before").rlike(r"[=:\"']\s*$").cast("int"),
    }
    return spans.select("text_key", "start", "end", "base", "label", "free",
                        *[made.get(f, F.col(f)).cast("int").alias(f) for f in FEATURES])


def candidates(found: DataFrame) -> DataFrame:
    """Each candidate of each different text once: with ``base`` (it is a base span), ``label`` (null:
    unknown) and ``free`` (it touches no base span)."""
    spans = (found.where(F.exists("spans", lambda s: s["what"] == CANDIDATE)).select("text_key", "spans").dropDuplicates(["text_key"])
             .select("text_key", F.inline("spans")))
    one = spans.groupBy("text_key", "kind", "start", "end").agg(
        F.max((F.col("what") == BASE).cast("int")).alias("base"), F.max((F.col("what") == DROPPED).cast("int")).alias("dropped"),
        F.max((F.col("what") == CANDIDATE).cast("int")).alias("proposed"), F.max("s").alias("s"),
        F.max("before").alias("before"), F.max("after").alias("after"))
    # two rows for a base span that is proposed too: as what others touch, and as a candidate
    sides = one.withColumn("side", F.explode(F.expr("filter(array(if(proposed = 1, 0, null), if(base = 1 or dropped = 1, 1, null)), x -> x is not null)")))
    place = F.when(F.col("side") == 0, F.col("end")).otherwise(F.col("start"))
    so_far = "over (partition by text_key{} order by place, side rows between unbounded preceding and current row)"
    met = (sides.withColumn("place", place)
           .withColumn("base_end", F.expr("max(if(side = 1 and base = 1, end, null)) " + so_far.format("")))
           .withColumn("dropped_end", F.expr("max(if(side = 1 and dropped = 1, end, null)) " + so_far.format(", kind"))))
    touched = lambda end: F.coalesce(F.col(end) > F.col("start"), F.lit(False))
    label = F.when(F.col("base") == 1, 1).when((F.col("dropped") == 1) | ~touched("dropped_end"), 0)
    return with_features(met.where("side = 0").withColumn("label", label).withColumn("free", ~touched("base_end")))


def fitted(known: DataFrame):
    """Boosted trees on counted combinations of features, or None without both classes."""
    from pyspark.ml.classification import GBTClassifier

    rows = (known.groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("weight"))
            .withColumn("at", F.xxhash64(*FEATURES, "label")).orderBy("at", *FEATURES, "label").limit(FIT_ROWS))
    rows = stage(rows.drop("at"), "personal-fit")
    if rows.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=11).fit(assembled(rows))


def assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def thresholds(scored: DataFrame) -> DataFrame:
    """``(kind, threshold)`` from labelled scores in steps of a thousandth."""
    steps = scored.groupBy("kind", F.floor(F.col("score") * 1000).alias("step")).agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    above = "over (partition by kind order by step desc)"
    upto = steps.select("kind", "step", F.expr(f"sum(n) {above}").alias("n"), F.expr(f"sum(good) {above}").alias("good"))
    return (upto.where((F.col("good") >= LEAST) & (F.col("good") >= PRECISION * F.col("n")))
            .groupBy("kind").agg((F.min("step") / 1000).alias("threshold")))


def added(rows: DataFrame) -> DataFrame:
    """``(text_key, more)``: the spans that the trees add to each text."""
    from pyspark.ml.functions import vector_to_array

    rows = stage(rows, "personal-candidates")
    held_out = F.crc32(F.col("text_key").cast("binary")) % 5 == 0
    model = fitted(rows.where(F.col("label").isNotNull() & ~held_out))
    if model is None:
        return rows.sparkSession.createDataFrame([], "text_key string, more array<struct<start:int,kind:int,end:int>>")
    scored = model.transform(assembled(rows)).withColumn("score", vector_to_array("probability")[1])
    scored = stage(scored.select("text_key", "kind", "start", "end", "base", "label", "free", "score"), "personal-scores")
    limits = thresholds(scored.where(held_out & F.col("label").isNotNull()))
    good = scored.where("base = 0 and free").join(F.broadcast(limits), "kind").where("score >= threshold")  # a row a kind
    before = "over (partition by text_key order by start, end, kind rows between unbounded preceding and 1 preceding)"
    chains = (good.withColumn("opens", F.expr(f"if(start < max(end) {before}, 0, 1)"))
              .withColumn("chain", F.expr("sum(opens) over (partition by text_key order by start, end, kind)")))
    best = chains.groupBy("text_key", "chain").agg(
        F.max(F.struct("score", (F.col("end") - F.col("start")).alias("chars"), -F.col("start"), -F.col("kind"),
                       F.struct("start", "kind", "end").alias("span")))["span"].alias("span"))
    return best.groupBy("text_key").agg(F.collect_list("span").alias("more"))


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base_spans, spans)`` of each row; both arrays of ``(start, kind, end)`` with the kind's
    place in ``KINDS``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), found_spans(text).alias("spans"), F.md5(text.cast("binary")).alias("text_key"))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    found = stage(found.withColumn("base_spans", F.sort_array(plain(F.filter("spans", lambda x: x["what"] == BASE)))), "personal-found")
    proposes = F.exists("spans", lambda s: s["what"] == CANDIDATE)
    more = added(candidates(found))
    with_more = found.where(proposes).drop("spans").join(more, "text_key", "left")
    without = found.where(~proposes).drop("spans").withColumn("more", F.lit(None).cast(more.schema["more"].dataType))
    every = F.sort_array(F.concat("base_spans", F.coalesce("more", F.array().cast(more.schema["more"].dataType))))
    return with_more.unionByName(without).select("doc_id", "base_spans", every.alias("spans"))


@register("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base_spans, s -> s.kind = {i})) as long) as n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base_spans")), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"))
