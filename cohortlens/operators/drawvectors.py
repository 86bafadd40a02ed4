"""Bootstrap of several metrics in one pass by draw vectors.

The Poisson(1) weight of a unit in a draw is a function of (unit, draw) alone, so a row needs no
join to its weights and no row per draw: a task turns its rows into one vector over all draws per
sum. Rows are range-partitioned and sorted by (group, score, salt); a task folds its run of scores into
at most three rows per group:

* its first and its last score, each alone, as a neighbouring task may hold rows of the same score
  (a hot score is spread over several tasks by the salt);
* all scores between them, which no other task has, with their pairs already counted.

These few rows are exploded over the draws, equal scores are added up, and a running sum over the
runs gives the negatives below each. AUROC (ties count half), Brier score and R2 of all draws
come out of it, and the point values as one more draw of weight one.

Rows with a null unit, outcome or score, or a NaN among them, are left out. A draw that leaves a
metric undefined counts for no summary of it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SALTS = 1 << 16
BLOCK_ROWS = 1000
SUMS = ("pos", "neg", "num", "sw", "sse", "sy", "syy")
METRICS = ("auroc", "brier", "r2")
POISSON_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(13)])
# Workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# MD5 (RFC 1321): rotations, constants and the word of the message that each step takes
TURNS = [t for ts in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in ts * 4]
ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
TAKEN = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
CELLS = 1 << 14  # hashes of one step: its arrays stay in the cache


def _md5_parts(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First eight bytes, as one number, of the MD5 of every start with every end: blocks of one
    message of 64 bytes, as 16 words a row, that have no bit in common."""
    words = []
    for k in range(16):
        w, v = starts[:, k, None], ends[None, :, k]
        words.append(w | v if w.any() and v.any() else w if w.any() else v)
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    shape = (len(starts), len(ends))
    a, b, c, d = (np.full(shape, x) for x in first)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, words[TAKEN[i]] + ADDED[i], out=f)
        np.left_shift(f, TURNS[i], out=g)
        np.right_shift(f, 32 - TURNS[i], out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    high, low = ((x + y).byteswap().astype(np.uint64) for x, y in zip((a, b), first))
    return high << np.uint64(32) | low


def md5_parts(units: Sequence[bytes], ends: Sequence[bytes]) -> np.ndarray:
    """First eight bytes of the MD5 of each unit with each end behind it, big-endian."""
    out = np.empty((len(units), len(ends)), np.uint64)
    places: dict[int, list[int]] = {}
    for i, unit in enumerate(units):
        places.setdefault(len(unit), []).append(i)
    for n, at in places.items():
        if n + max(map(len, ends), default=0) > 55:  # more than one block
            digests = b"".join(hashlib.md5(units[i] + end).digest()[:8] for i in at for end in ends)
            out[at] = np.frombuffer(digests, ">u8").reshape(len(at), len(ends))
            continue
        starts = np.zeros((len(at), 64), np.uint8)
        starts[:, :n] = np.frombuffer(b"".join(units[i] for i in at), np.uint8).reshape(len(at), n)
        tails = b"".join(((bytes(n) + end + b"\x80").ljust(56, b"\0") + (8 * (n + len(end))).to_bytes(8, "little"))
                         for end in ends)
        starts, tails = starts.view("<u4"), np.frombuffer(tails, "<u4").reshape(len(ends), 16)
        step = max(1, CELLS // max(1, len(ends)))
        for k in range(0, len(at), step):
            out[at[k:k + step]] = _md5_parts(starts[k:k + step], tails)
    return out


def draw_weights(units: Sequence[str], draws: int, seed: int) -> np.ndarray:
    """Weights (units x draws + 1): ones for the point value, then Poisson(1) of each draw, from the
    same hash as :func:`cohortlens.functions.hashing.uniform_parts`."""
    ends = [f"|{d}|p{seed}".encode() for d in range(draws)]
    u = ((md5_parts([unit.encode() for unit in units], ends) >> np.uint64(12)) + 0.5) / 2.0 ** 52
    weights = np.zeros((len(units), draws + 1))
    weights[:, 0] = 1
    counted = np.zeros(u.shape, np.uint8)
    for at in POISSON_CDF:
        counted += u > at
    weights[:, 1:] = counted
    return weights


class _Run:
    """What a task has seen of one group: scores come in ascending order."""

    def __init__(self, group: str, width: int):
        self.group, self.width = group, width
        self.totals = np.zeros((4, width))
        self.done: list[tuple] = []  # the first score
        self.inner = None            # [lo, hi, pos, neg, num]
        self.score, self.pos, self.neg = None, None, None

    def add(self, score: float, pos: np.ndarray, neg: np.ndarray) -> None:
        if score == self.score:
            self.pos, self.neg = self.pos + pos, self.neg + neg
            return
        self._close()
        self.score, self.pos, self.neg = score, pos, neg

    def _close(self) -> None:
        if self.score is None:
            return
        if not self.done:
            self.done.append((self.score, self.score, self.pos, self.neg, np.zeros(self.width)))
            return
        if self.inner is None:
            self.inner = [self.score, self.score, *np.zeros((3, self.width))]
        _, _, pos, neg, num = self.inner
        self.inner[1:] = [self.score, pos + self.pos, neg + self.neg, num + self.pos * (neg + self.neg / 2.0)]

    def rows(self) -> list[tuple]:
        found = [*self.done, *([tuple(self.inner)] if self.inner else []),
                 (self.score, self.score, self.pos, self.neg, np.zeros(self.width))]
        none = np.zeros((4, self.width))
        return [(self.group, *seg, *(self.totals if i == 0 else none)) for i, seg in enumerate(found)]


def _fold(draws: int, seed: int):
    """Rows ``(g, p, y, unit)`` of a task, sorted by the first three, to its runs."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        names = ["g", "lo", "hi", *SUMS]
        now: _Run | None = None
        for frame in frames:
            for at in range(0, len(frame), BLOCK_ROWS):
                part = frame.iloc[at:at + BLOCK_ROWS]
                g, p, y = part["g"].to_numpy(), part["p"].to_numpy(float) + 0.0, part["y"].to_numpy(float)
                w = draw_weights(part["unit"].tolist(), draws, seed)
                # rows alike in group, score and outcome differ by their weights only
                starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (y[1:] != y[:-1])]))
                sums = np.add.reduceat(w, starts)
                factors = np.stack([np.ones(len(y)), (y - p) ** 2, y, y * y], axis=1)[:, :, None]
                none = np.zeros(draws + 1)
                for i, s in enumerate(starts):
                    if now is None or now.group != g[s]:
                        if now is not None:
                            yield pd.DataFrame(now.rows(), columns=names)
                        now = _Run(g[s], draws + 1)
                    now.add(p[s], *((sums[i], none) if y[s] > 0 else (none, sums[i])))
                    now.totals += factors[s] * sums[i]
        if now is not None:
            # the run ends with the partition: its last score may go on in the next one
            yield pd.DataFrame(now.rows(), columns=names)

    return run


def draw_metrics(df: DataFrame, unit: str, y: str, p: str, draws: int = 1000, seed: int = 0,
                 by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``(by, draw, auroc, brier, r2)``, draw -1 with weight one for every row. The values of ``by``
    have to survive JSON (strings, numbers, booleans, dates). ``partitions``: of the score ranges
    (default: the session's)."""
    by = list(by)
    kind = StructType([df.schema[c] for c in by])
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    num = {c: F.col(c).cast("double") for c in (p, y)}
    rows = (df.where(F.col(unit).isNotNull() & F.col(y).isNotNull() & F.col(p).isNotNull()
                     & ~F.isnan(num[p]) & ~F.isnan(num[y]))
            .select(group.alias("g"), num[p].alias("p"), num[y].alias("y"), F.col(unit).cast("string").alias("unit")))
    ranges = ["g", "p", F.pmod(F.xxhash64("unit"), F.lit(SALTS))]
    rows = rows.repartitionByRange(partitions, *ranges) if partitions else rows.repartitionByRange(*ranges)
    runs = (rows.sortWithinPartitions("g", "p", "y")
            .mapInPandas(_fold(draws, seed), "g string, lo double, hi double, "
                         + ", ".join(f"{c} array<double>" for c in SUMS)))
    flat = (runs.select("g", "lo", "hi", F.posexplode(F.arrays_zip(*SUMS)).alias("draw", "v"))
            .groupBy("g", (F.col("draw") - 1).alias("draw"), "lo", "hi")
            .agg(*[F.sum(F.col(f"v.{c}")).alias(c) for c in SUMS]))
    lower = Window.partitionBy("g", "draw").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.when(F.col("lo") == F.col("hi"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("num"))
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0.0))
    total = (flat.select("g", "draw", *SUMS[:2], *SUMS[3:], (pairs + F.col("pos") * below).alias("pairs"))
             .groupBy("g", "draw").agg(*[F.sum(c).alias(c) for c in ("pairs", *SUMS[:2], *SUMS[3:])]))
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    return total.select(
        *[F.from_json("g", kind)[c].alias(c) for c in by], "draw",
        F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("pairs") / (F.col("pos") * F.col("neg"))).alias("auroc"),
        F.when(F.col("sw") > 0, F.col("sse") / F.col("sw")).alias("brier"),
        F.when((F.col("sw") > 0) & (spread > 0), 1 - F.col("sse") / spread).alias("r2"))


def bootstrap_metrics(df: DataFrame, unit: str, y: str, p: str, draws: int = 1000, seed: int = 0,
                      by: Sequence[str] = (), metrics: Sequence[str] = METRICS,
                      partitions: int | None = None) -> DataFrame:
    """``(by, metric, score, std, lower, mean, upper, n_draws)`` of every group and metric, all from
    one pass over the rows: the point value, and over the draws that define the metric the standard
    deviation (ddof 1), the mean and the 2.5 and 97.5 percentiles (linear interpolation)."""
    by = list(by)
    long = draw_metrics(df, unit, y, p, draws, seed, by, partitions).unpivot(
        [*by, "draw"], list(metrics), "metric", "value")
    drawn = F.when(F.col("draw") >= 0, F.col("value"))
    return long.groupBy(*by, "metric").agg(
        F.max(F.when(F.col("draw") < 0, F.col("value"))).alias("score"), F.stddev_samp(drawn).alias("std"),
        F.percentile(drawn, 0.025).alias("lower"), F.avg(drawn).alias("mean"),
        F.percentile(drawn, 0.975).alias("upper"), F.count(drawn).alias("n_draws"))
