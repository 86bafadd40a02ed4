"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at a distance of at most ``radius`` bits meet in a point that is near to both:
every fingerprint emits the points within half the radius, equal points meet in one shuffle, and
all that meet in a point are linked to the smallest near one among them. For an odd radius
``2m + 1`` one side has to go ``m + 1`` bits: of ``2m + 1`` differing bits at least ``m + 1`` lie in
one half of the word, so these far points flip ``m + 1`` bits of the same half only (1 + 64 near and
992 far points for three bits instead of 2,081).

A group holds at most that many distinct fingerprints whatever the number of documents, each link
goes from a group's smallest near member to another member and is verified, and so the number of
links stays linear in the number of fingerprints; equal fingerprints are one node throughout.
Only fingerprints that can have a neighbour emit points: of ``radius + 4`` bit blocks, two
fingerprints within ``radius`` bits agree in four, so a fingerprint that shares no four blocks with
another one has no link (an exact test that spares most fingerprints the emission).

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows link to
themselves. Columns other than the id and the text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import broadcast_if_small, ship, stage, whole_rows
from .components import components
from .registry import register

BITS = 64
BROADCAST_IDS = 1_000_000
ship(__name__)


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included (a signed long)."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[s:e], seed)
                  for s, e in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at:at + (1 << 14)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42,
                 id_col: str = "doc_id", text_col: str = "text", row_hash: Column | None = None) -> DataFrame:
    """``(doc_id, fp)`` of every row, fp a signed long, and ``row_hash`` if given."""
    more = [] if row_hash is None else [row_hash.alias("row_hash")]
    names = ["doc_id", "fp", "row_hash"][:2 + len(more)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = pa.array([fingerprint(t.as_py(), shingle, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], names=names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return narrow.mapInArrow(run, "doc_id long, fp long" + ", row_hash long" * len(more))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def ball(radius: int) -> tuple[list[int], list[int]]:
    """Bit masks of the near points and of the far ones (none for an even radius)."""
    flips = lambda places, n: [sum(1 << p for p in c) for c in combinations(places, n)]
    near = [m for n in range(radius // 2 + 1) for m in flips(range(BITS), n)]
    half = BITS // 2
    far = [m for part in (range(half), range(half, BITS)) for m in flips(part, radius // 2 + 1)] if radius % 2 else []
    return [signed(m) for m in near], [signed(m) for m in far]


def with_possible_neighbour(nodes: DataFrame, radius: int) -> DataFrame:
    """The fingerprints ``(fp)`` that agree with another one in four of ``radius + 4`` bit blocks."""
    n = radius + 4
    cuts = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
    masks = [signed(reduce(int.__or__, c)) for c in combinations(blocks, 4)]
    keys = nodes.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])).alias("key"))
    shared = (keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
              .where("lo <> hi").select("key"))
    return keys.join(stage(shared, "simhash-keys"), "key", "left_semi").select("fp").distinct()


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Verified links ``(a, b)`` between distinct fingerprints ``nodes(fp)`` that have the same
    connected components as all pairs within ``radius`` bits."""
    near, far = ball(radius)
    points = F.transform(F.lit(near + far).cast("array<bigint>"), lambda m: F.col("fp").bitwiseXOR(m))
    met = (stage(with_possible_neighbour(nodes, radius), "simhash-suspects")
           .repartition("fp").select("fp", F.posexplode(points).alias("place", "point"))
           .select("point", "fp", F.when(F.col("place") < len(near), F.col("fp")).alias("near")))
    centre = F.expr("min(near) over (partition by point)")
    return (met.select("fp", centre.alias("centre"))
            .where("centre <> fp and bit_count(centre ^ fp) <= " + str(radius))
            .select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct())


def component_firsts(prints: DataFrame, key: Column, radius: int) -> DataFrame:
    """``(fp, first)`` of every fingerprint: the smallest key of its component."""
    nodes = stage(prints.groupBy("fp").agg(F.min(key).alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = stage(nodes.join(roots, "fp", "left")
                   .select("fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-roots")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return stage(rooted.select("fp", "root").join(stage(firsts, "simhash-firsts"), "root")
                 .select("fp", "first"), "simhash-components")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: documents whose fingerprints differ in at most
    ``radius`` bits are linked, ``component_id`` is the smallest id reachable over links."""
    prints = stage(fingerprints(docs, shingle, seed, id_col, text_col), "simhash-prints")
    return (prints.join(component_firsts(prints, F.col("doc_id"), radius), "fp")
            .select("doc_id", "fp", F.col("first").alias("component_id")))


def representatives(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each group: the one with the smallest id (null after all others), then
    fingerprint, then hash of the row; of rows equal in all columns, one. Map columns are not
    hashed. The rows that go are broadcast as (id, hash) when their counted number is within
    ``BROADCAST_IDS``, so that texts are not shuffled; else AQE splits the join."""
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    prints = stage(fingerprints(docs, shingle, seed, id_col, text_col, row_hash), "simhash-prints")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "row_hash")
    rows = stage(prints.join(component_firsts(prints, key, radius), "fp")
                 .groupBy("doc_id", "row_hash").agg(F.bool_or(key.eqNullSafe(F.col("first"))).alias("stays"), F.count("*").alias("n")),
                 "simhash-rows")
    gone, twice = (rows.where(x).select("doc_id", "row_hash") for x in ("not stays", "stays and n > 1"))
    n = rows.agg(F.count_if(~F.col("stays")), F.count_if(F.col("stays") & (F.col("n") > 1))).first()
    same = F.expr("of_id <=> doc_id and of_hash = row_hash")
    kept = (whole_rows(docs, of_id=F.col(id_col).cast("long"), of_hash=row_hash)
            .join(broadcast_if_small(gone, n[0], BROADCAST_IDS), same, "left_anti"))
    if not n[1]:
        return kept.select("row.*")
    twice = broadcast_if_small(twice, n[1], BROADCAST_IDS)
    return (kept.join(twice, same, "left_anti").select("row.*")
            .unionByName(kept.join(twice, same, "left_semi").select("row.*").dropDuplicates(plain)))


@register("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
