"""Shards of nearly equal bytes by sampled splitters (DataFrame functions only).

Records are ordered by a hash of their text, copies by a hash of their id. A sample of keys, drawn
with chances in proportion to a record's size, gives the boundaries of many more ranges than shards;
a text that fills several quantiles of the sample becomes a range of its own. The bytes of every
range are then counted over all records. An overfull range is subdivided: one of several texts by a
second hash of the text, one that is a single text by the hash of the id, but only if it exceeds
``WHOLE`` of a shard. Neighbouring parts make a shard, cut where it is nearest to equal sizes, so that
a shard differs from the mean by about the size of the parts at its two ends. Copies of a text lie in
one shard unless they are more than ``WHOLE`` (1/16) of a shard.

Texts are read once and never shuffled: sizes, checksums and keys move alone. The driver holds the
boundaries and the sizes of the parts, some ``3 * FINE`` numbers a shard whatever the number of
records. Places in a shard are counted in buckets of about ``BUCKET_ROWS`` records and moved by the
sizes of the buckets before.

A null text has size 8 and the checksum of an empty one; a null id is an id like others. Repeated
rows get a place each, in any order among each other. An empty table gives no rows. Other columns
are ignored. A shard may stay empty when there are few records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import stage
from .registry import register

SHARDS = 24
FINE = 64  # ranges for each shard
DRAWS = 64  # expected draws for each range
OVERFULL = 1.25  # times the mean
WHOLE = 1 / 16  # of a shard: what copies of one text may be without being divided
BUCKET_ROWS = 50_000


def text_key(text: Column) -> Column:
    """53 bits of a hash, as quantiles are doubles."""
    return F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 11)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, text_key, row_key)`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("text_key"),
        F.xxhash64(F.lit("row"), F.col(id_col)).alias("row_key"))


def draws(total: int, expected: int) -> Column:
    """How often a row is drawn: its share of ``expected`` draws, rounded up or down by a hash."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "text_key", "row_key"), 11) / F.lit(float(1 << 53))
    return F.floor(F.col("size") * F.lit(expected / total) + u)


def boundaries(keys: DataFrame, total: int, ranges: int) -> tuple[list[int], set[int]]:
    """First keys of all ranges but the lowest, and the numbers of the ranges of one text."""
    drawn = (keys.withColumn("n", draws(total, ranges * DRAWS)).where("n > 0")
             .select("text_key", F.explode(F.expr("sequence(1L, n)"))))
    at = drawn.agg(F.percentile_approx("text_key", [i / ranges for i in range(1, ranges)], 100_000)).first()[0] or []
    cuts = sorted({c for b in at for c in ((b, b + 1) if at.count(b) > 1 else (b,))})
    return cuts, {cuts.index(b) + 1 for b in set(at) if at.count(b) > 1}


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts up to the key, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    pages = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    page = upto(F.lit([p[0] for p in pages]))
    inside = upto(F.element_at(F.array(*[F.lit(p) for p in pages]), page))
    return F.when(page == 0, 0).otherwise((page - 1) * step + inside)


def looked_up(values: list[int], at: Column) -> Column:
    return F.element_at(F.lit(values), at + 1)


def placed(keys: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``keys`` (a staged table of ``keyed``) with ``part``, ``shard`` and ``slot``."""
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = shards * FINE
    cuts, single = boundaries(keys, total, ranges) if rows else ([], set())
    limit = OVERFULL * total / ranges
    sizes = {r["range"]: r["bytes"] for r in keys.groupBy(range_of(F.col("text_key"), cuts).alias("range"))
             .agg(F.sum("size").alias("bytes")).collect()}  # a row for each range
    most = [max(limit, WHOLE * total / shards) if i in single else limit for i in range(len(cuts) + 1)]
    parts = [max(1, -(-sizes.get(i, 0) * ranges // total) if sizes.get(i, 0) > most[i] else 1) for i in range(len(cuts) + 1)]
    first = [sum(parts[:i]) for i in range(len(parts))]
    divided = F.when(looked_up([int(i in single) for i in range(len(parts))], F.col("range")) == 1, F.col("row_key")
                     ).otherwise(F.xxhash64(F.lit("part"), "text_key"))
    dealt = (keys.withColumn("range", range_of(F.col("text_key"), cuts))
             .withColumn("part", (looked_up(first, F.col("range"))
                                  + F.pmod(divided, looked_up(parts, F.col("range")))).cast("int")).drop("range"))
    dealt = stage(dealt, "shard-parts")
    filled = {r["part"]: (r["bytes"], r["n"]) for r in dealt.groupBy("part").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # a row for each part
    shard, buckets, before = [], [], 0
    for p in range(sum(parts)):
        size, n = filled.get(p, (0, 0))
        shard.append(min(shards - 1, (2 * before + size) * shards // (2 * max(total, 1))))
        buckets.append(n // BUCKET_ROWS + 1)
        before += size
    dealt = (dealt.withColumn("shard", looked_up(shard, F.col("part")))
             .withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "text_key", "row_key"), looked_up(buckets, F.col("part"))).cast("int")))
    counts = dealt.groupBy("shard", "part", "bucket").agg(F.count("*").alias("n"))
    offsets = stage(counts.select("part", "bucket", F.expr(
        "sum(n) over (partition by shard order by part, bucket) - n").alias("before")), "shard-buckets")
    inside = dealt.withColumn("inside", F.expr(
        "row_number() over (partition by part, bucket order by text_key, row_key, doc_id) - 1"))
    return (inside.join(offsets, ["part", "bucket"])
            .withColumn("slot", (F.col("before") + F.col("inside")).cast("long")).drop("before", "inside", "bucket"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents under ``path``, a folder for each shard, and read them back with the
    columns ``shard`` and ``slot`` (in place of such columns of their own). Places are joined to
    the rows by id and text key, and by number among rows that repeat both."""
    number = lambda of, key: F.expr(f"row_number() over (partition by {of}, {key} order by {key})")
    where = placed(stage(keyed(docs, id_col, text_col), "shard-keys"), shards).withColumn("nth", number("doc_id", "text_key"))
    own = [F.col(c) for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("of"), text_key(F.col(text_col)).alias("of_key"))
    rows = rows.withColumn("copy", number("of", "of_key"))
    out = (rows.join(where, F.expr("of <=> doc_id and of_key = text_key and copy = nth"))
           .select("row.*", "shard", "slot"))
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


@register("op8_sampled_splitters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = stage(keyed(table(spark, sf_dir, "documents")), "shard-keys")
    return placed(keys).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                               F.lit(None).cast("int").alias("grown_shard"))
