"""URL filter by the ratio of two character language models (DataFrame functions only).

Rules (host and beginning of the path) decide the URLs that they fit. All other URLs are judged by
two variable-order Markov models over whole URLs, scheme, query and fragment included, one of those
that rules accept and one of those they reject:
the probability of a character behind its last characters mixes the counts of every order from
``ORDER`` down to none by Witten-Bell smoothing, so a context that was never seen gives way to a
shorter one. A URL's score is the difference of both log-likelihoods per character. Its least
accepted value is calibrated: a part of the ruled URLs (a fold by a hash of the URL) is kept out of
the counts, and the limit is where this fold's accepted and rejected URLs part best.

Counts come from all ruled URLs: one pass counts the windows of ``ORDER + 1`` characters, with a
partial aggregate, and all lower orders follow from that table of distinct windows. The table of
windows with their scores is broadcast when its counted rows are within ``BROADCAST_ROWS``, else
joined by a shuffle. Log ratios are whole numbers of micronats, so that sums do not depend on their
order.

A null URL or one without ``://`` has an empty host and path; the models judge its text too (null:
empty). Repeated rows give a row each. Where rules accept (or reject) none outside the fold, unruled URLs are
allowed; where the fold lacks a class, the limit is zero. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import broadcast_if_small, stage, whole_rows
from .registry import register

ORDER = 4
SYMBOLS = 256  # the base of all orders is an equal share for so many characters
CALIBRATION = "012"  # first digits of the hash of URLs in the calibration fold (3 of 16)
BROADCAST_ROWS = 1_000_000
MOST_BIN = 1000  # scores are calibrated in bins of 0.01 nats up to this one
START, END = "\x02", "\x03"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (verdict, host, beginning of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def longest_first(rules) -> list[tuple[str, str, str]]:
    """A rule that blocks comes before one of the same length that allows."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))


def ruled(rules, what) -> Column:
    """``what(rule)`` of the longest rule that fits the columns ``host`` and ``path``; else null."""
    out = F.lit(None).cast("string")
    for r in reversed(longest_first(rules)):
        fits = ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def windows(text: Column, order: int) -> Column:
    """Each character with the ``order`` characters before it, the end sign included."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def model(counts: DataFrame, order: int) -> DataFrame:
    """``(window, ratio)``: the log ratio of the last character of each window, in micronats, from
    ``counts(window, a, b)``, the occurrences in accepted and rejected URLs."""
    level = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    grams = (counts.select(level, "window", "a", "b").withColumn("gram", F.expr("right(window, k + 1)"))
             .groupBy("k", "gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
             .withColumn("context", F.expr("left(gram, k)")))
    grams = stage(grams, "url-grams")
    contexts = grams.groupBy("k", "context").agg(
        F.sum("a").alias("all_a"), F.count_if(F.col("a") > 0).alias("kinds_a"),
        F.sum("b").alias("all_b"), F.count_if(F.col("b") > 0).alias("kinds_b"))
    known = stage(grams.join(contexts, ["k", "context"]).drop("context"), "url-contexts")
    per_level = (counts.select(level, "window").withColumn("gram", F.expr("right(window, k + 1)"))
                 .join(known, ["k", "gram"]))
    pick = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}")
            for k in range(order + 1) for c in ("a", "all_a", "kinds_a", "b", "all_b", "kinds_b")]
    found = per_level.groupBy("window").agg(*pick)
    for c in "ab":
        found = found.withColumn(f"p_{c}", F.lit(1.0 / SYMBOLS))
        for k in range(order + 1):
            found = found.withColumn(f"p_{c}", F.expr(mixed(c, k)))
    return found.select("window", F.expr("cast(floor(1e6 * ln(p_a / p_b) + 0.5) as bigint)").alias("ratio"))


def mixed(c: str, k: int) -> str:
    """Witten-Bell: the order's own counts, and the lower order by its number of kinds."""
    return (f"case when all_{c}_{k} > 0 then ({c}_{k} + kinds_{c}_{k} * p_{c}) / (all_{c}_{k} + kinds_{c}_{k}) "
            f"else p_{c} end")


_BEST = """
with bins as (select bin, sum(case when ruling = 'allow' then 1 else 0 end) as a,
        sum(case when ruling = 'block' then 1 else 0 end) as b from {scored} where calibrates group by bin),
cuts as (select bin, lag(bin) over (order by bin) as below,
        sum(a) over (order by bin rows between current row and unbounded following) as a_up,
        sum(b) over (order by bin rows between current row and unbounded following) as b_up,
        sum(a) over () as a_all, sum(b) over () as b_all from bins),
gains as (select bin, below, cast(a_up as double) / a_all - cast(b_up as double) / b_all as gain
        from cuts where a_all > 0 and b_all > 0)
select cast(floor((coalesce(below + 1, bin) + bin) / 2.0) as int) as least
from gains where gain = (select max(gain) from gains) order by bin limit 1
"""


def judged(pages: DataFrame, rules=RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url",
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, score)`` of every row; score is the log-likelihood
    difference in nats a character (of ruled URLs too, for information)."""
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    read = (pages.select(F.col(id_col).alias("page_id"), F.coalesce(url, F.lit("")).alias("url"),
                         host_of(url).alias("host"), path_of(url).alias("path"))
            .withColumn("ruling", ruled(rules, lambda r: r[0])))
    fold = F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*CALIBRATION)
    read = read.withColumn("calibrates", fold & F.col("ruling").isNotNull())
    text = F.col("url")
    counted = lambda v: F.sum((F.col("ruling").eqNullSafe(v) & ~F.col("calibrates")).cast("long"))
    counts = stage(read.select("ruling", "calibrates", F.explode(windows(text, order)).alias("window"))
                   .groupBy("window").agg(counted("allow").alias("a"), counted("block").alias("b")), "url-windows")
    seen = counts.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    both = bool(seen["a"] and seen["b"])
    ratios = broadcast_if_small(stage(model(counts, order), "url-model"), seen["n"], broadcast_rows)
    spread = read.select("page_id", "url", F.posexplode(windows(text, order)).alias("at", "window"))
    scored = (spread.join(ratios, "window").groupBy("page_id", "url")
              .agg(F.sum("ratio").alias("total"), F.count("*").alias("length"), F.count_if(F.col("at") == 0).alias("copies"))
              .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
              .select("*", ruled(rules, lambda r: r[1] + r[2]).alias("rule"), ruled(rules, lambda r: r[0]).alias("ruling"))
              .withColumn("calibrates", fold & F.col("ruling").isNotNull())
              .withColumn("bin", F.expr(f"cast(greatest(-{MOST_BIN}, least({MOST_BIN}, floor(total / (length * 1e4)))) as int)"))
              .select("*", F.explode(F.expr("sequence(1L, copies)")).alias("copy")))
    scored = stage(scored, "url-scores")
    best = spark.sql(_BEST.format(scored="{scored}"), scored=scored.select("bin", "ruling", "calibrates")).first()
    least = best["least"] if best else 0
    by_model = F.when(F.col("bin") >= least, "allow").otherwise("block") if both else F.lit("allow")
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("ruling", by_model).alias("verdict"),
                         F.expr("total / (length * 1e6)").alias("score"))


def allowed_pages(pages: DataFrame, rules=RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The rows whose URL is allowed, all columns as they were (an id and its URL name a row)."""
    found = judged(pages, rules, order, id_col, url_col)
    allowed = found.where("verdict = 'allow'").select("page_id", "url").distinct()
    rows = whole_rows(pages, of_id=F.col(id_col), of_url=F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    return rows.join(allowed, F.expr("of_id <=> page_id and of_url = url"), "left_semi").select("row.*")


def _sql() -> str:
    case = lambda what: "case " + " ".join(
        f"when (host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}') then '{what(r)}'"
        for r in longest_first(RULES)) + " end"
    pad = " || ".join(["chr(2)"] * ORDER)
    cols = ("a", "all_a", "kinds_a", "b", "all_b", "kinds_b")
    pick = ", ".join(f"max(case when k = {k} then {c} end) as {c}_{k}" for k in range(ORDER + 1) for c in cols)
    steps = ["p_m1 as (select *, 1.0::double / 256 as p_a, 1.0::double / 256 as p_b from levels)"]
    for k in range(ORDER + 1):
        prev = f"p_{k - 1}" if k else "p_m1"
        steps.append(f"p_{k} as (select * replace ({mixed('a', k)} as p_a, {mixed('b', k)} as p_b) from {prev})")
    return f"""
with parts as (select page_id, coalesce(url, '') as url, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{string.ascii_uppercase}',
        '{string.ascii_lowercase}') as host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) as path from pages),
r as (select row_number() over () as row, *, {case(lambda r: r[1] + r[2])} as rule, {case(lambda r: r[0])} as ruling,
        {pad} || url || chr(3) as padded from parts),
f as (select *, ruling is not null and substr(md5(url), 1, 1) in ('0', '1', '2') as calibrates from r),
w as (select row, ruling, calibrates, unnest(list_transform(range(1, length(padded) - {ORDER} + 1),
        lambda i: substr(padded, i, {ORDER + 1}))) as gram from f),
counts as (select gram as w, sum(case when ruling = 'allow' and not calibrates then 1 else 0 end)::double as a,
        sum(case when ruling = 'block' and not calibrates then 1 else 0 end)::double as b from w group by gram),
grams as (select k, right(w, k + 1) as gram, left(right(w, k + 1), k) as context, sum(a) as a, sum(b) as b
        from counts, (select unnest(range(0, {ORDER + 1}))::int as k) group by all),
contexts as (select k, context, sum(a) as all_a, count(*) filter (a > 0) as kinds_a, sum(b) as all_b,
        count(*) filter (b > 0) as kinds_b from grams group by all),
known as (select * from grams join contexts using (k, context)),
levels as (select w, {pick} from (select w from counts) join known on known.gram = right(w, k + 1) group by w),
{", ".join(steps)},
model as (select w, floor(1e6 * ln(p_a / p_b) + 0.5)::bigint as ratio from p_{ORDER}),
sums as (select row, sum(ratio)::bigint as total, count(*) as len from w join model on gram = model.w group by row),
scored as (select f.*, total, len, greatest(-{MOST_BIN}, least({MOST_BIN}, floor(total / (len * 1e4::double))))::int as bin
        from f join sums using (row)),
best as ({_BEST.format(scored="scored")})
select page_id, url, host, path, rule, coalesce(ruling, case when (select sum(a) > 0 and sum(b) > 0 from counts) then
        case when bin >= coalesce((select least from best), 0) then 'allow' else 'block' end else 'allow' end) as verdict,
        total / (len * 1e6::double) as score
from scored
"""


@register("op10_url_language_models", _sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
