"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Each entry c becomes the integer floor(1024 * c) + 100000. What the components need is the scatter
of these integers, n * sum(x x') - S S', n squared times the covariance: a symmetric integer matrix
whose size is that of a vector, whatever the number of rows. It is summed exactly (in limbs of 60
bits, partial sums in each task). Then:

1. Its characteristic polynomial is found modulo as many 31-bit primes as its coefficients' bound
   asks for, a prime a row: reduction to Hessenberg form and the recurrence of its leading minors.
   Chinese remaindering gives the exact integer coefficients.
2. All roots are real, so the sign changes of the polynomial's coefficients, shifted by a (Descartes),
   count the roots above a exactly, repeated ones included. Bisection with this count isolates the
   k-th largest root; the polynomial's sign refines a root that is alone in its interval.
3. A root's null space is found by inverse iteration in fixed-point integers of some hundred bits,
   with as many orthogonal vectors as equal roots.

Vectors that are null, empty or hold a null or non-finite entry, or one of 2^52 or more (its integer
is beyond a long), are left out; so are vectors that do not have the commonest length (the longer one
of two). Vectors without an id and repeated rows count and are returned each. A component without
variance cannot be whitened and is not given: one vector, or vectors that are all equal, give no
rows, as does an empty table. Further columns are not looked at.
"""

from __future__ import annotations

from math import comb, isqrt
from random import Random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import ship, stage
from .registry import register

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LIMB = 60
ROOT_BITS = 192  # of a root, below the trace
EQUAL_BITS = 128  # roots that agree to so many bits below the trace are one
WORK_BITS = 640  # of the inverse iteration, below the trace
ship(__name__)


def usable(vector: Column) -> Column:
    """Some entries, no null, NaN or infinity among them, and every scaled one fits a long."""
    inside = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < 2.0 ** 52)  # noqa: E731  NaN is above all numbers
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, inside)


def vectors(column, size: int) -> np.ndarray:
    """Scaled integers, without the shift that no centred value depends on, of an Arrow list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, size)


def exact_products(y: np.ndarray) -> list[list[int]]:
    """y'y in Python integers; 64-bit sums where they suffice."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 62:
        return np.einsum("ni,nj->ij", y, y).tolist()
    wide = y.astype(object)
    return wide.T.dot(wide).tolist()


def exact_sums(y: np.ndarray) -> list[int]:
    most = int(np.abs(y).max(initial=0))
    return (y if most * len(y) < 1 << 62 else y.astype(object)).sum(axis=0).tolist()


def limbs(value: int) -> list[int]:
    """Digits of 60 bits, lowest first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def moments(rows: DataFrame, col: str) -> DataFrame:
    """``(size, i, j, limb, value)``: exact sums over all vectors of each length; (-1, -1) is their
    number, (i, -1) the sum of entry i, (i, j) that of the products of entries i <= j."""
    def run(batches):
        import pyarrow as pa

        sums: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                y = vectors(batch.column(0).filter(pa.array(lengths == d)), d)
                have = sums.setdefault(d, [0, [0] * d, [[0] * d for _ in range(d)]])
                have[0] += len(y)
                have[1] = [a + b for a, b in zip(have[1], exact_sums(y))]
                have[2] = [[a + b for a, b in zip(p, q)] for p, q in zip(have[2], exact_products(y))]
        out = [(d, i, j, k, v) for d, (n, s, g) in sums.items()
               for i, j, x in [(-1, -1, n), *((i, -1, x) for i, x in enumerate(s)),
                               *((i, j, g[i][j]) for i in range(d) for j in range(i, d))]
               for k, v in enumerate(limbs(x))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["size", "i", "j", "limb", "value"])

    parts = rows.select(F.col(col).cast("array<double>").alias("v")).mapInArrow(
        run, "size int, i int, j int, limb int, value long")
    return parts.groupBy("size", "i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def is_prime(n: int) -> bool:
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):  # decides below 3.2e9
        x = pow(a, odd, n)
        if a % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest 31-bit primes whose product exceeds the bound."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients, lowest first, of det(x I - matrix) modulo a prime below 2^31."""
    d = len(matrix)
    h = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(d, d)
    for m in range(1, d - 1):  # similarity steps to Hessenberg form
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if i := int(below[0]):
            h[[m, m + i]] = h[[m + i, m]]
            h[:, [m, m + i]] = h[:, [m + i, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m][None, :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u[None, :] % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    minors[0, 0] = 1
    for k in range(d):
        now = -h[k, k] * minors[k] % p
        now[1:] += minors[k][:-1]
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            now -= int(h[i, k]) * below % p * minors[i] % p
        minors[k + 1] = now % p
    return minors[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, lowest first, of a positive semidefinite integer matrix: a prime a row,
    put together by Chinese remaindering."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # the k-th elementary symmetric function of non-negative roots is at most that of equal ones
    bound = max(comb(d, k) * (trace ** k // d ** k + 1) for k in range(d + 1))
    primes = primes_for(2 * bound + 1)

    def run(batches):
        for pdf in batches:
            pdf["rest"] = [polynomial_modulo(matrix, int(p)) for p in pdf["p"]]
            yield pdf

    found = (spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64), "p")
             .mapInPandas(run, "p long, rest array<long>").collect())  # as many rows as primes
    product = 1
    for p in primes:
        product *= p
    total = [0] * (d + 1)
    for r in found:
        part = product // r.p
        part *= pow(part, -1, r.p)
        total = [(t + part * c) % product for t, c in zip(total, r.rest)]
    out = [t - product if 2 * t > product else t for t in total]
    assert out[d] == 1 and out[d - 1] == -trace
    return out


def roots_above(poly: list[int], a: int, bits: int) -> int:
    """How many roots, repeated ones included, of a polynomial with real roots only lie above
    a / 2^bits: the sign changes of its coefficients after the shift."""
    d = len(poly) - 1
    c = [x << bits * (d - i) for i, x in enumerate(poly)]  # of x / 2^bits, times 2^(bits * d)
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(poly: list[int], a: int, bits: int) -> int:
    """The polynomial's sign at a / 2^bits."""
    value, scale = 0, 0
    for x in reversed(poly):
        value, scale = value * a + (x << scale), scale + bits
    return (value > 0) - (value < 0)


def kth_root(poly: list[int], k: int, trace: int, bits: int) -> int:
    """The k-th largest root (from 1), times 2^bits, rounded down."""
    low, high, step = -1, trace + 1, 0  # the root is in (low, high]; both times 2^step
    above_low, above_high = roots_above(poly, low, 0), 0
    while high - low > 1 or step < bits:
        if high - low <= 1:
            grow = min(16, bits - step)
            low, high, step = low << grow, high << grow, step + grow
            continue
        mid = (low + high) // 2
        if above_low - above_high == 1:  # alone: the sign tells the side
            at_mid = sign_at(poly, mid, step)
            above = above_low if at_mid and (at_mid > 0) == (above_low % 2 == 0) else above_high
        else:
            above = roots_above(poly, mid, step)
        if above >= k:
            low, above_low = mid, above
        else:
            high, above_high = mid, above
    return high if sign_at(poly, high, bits) == 0 else low


def null_vectors(matrix: list[list[int]], root: int, bits: int, count: int, work: int) -> list[list[int]]:
    """``count`` orthogonal unit vectors (times 2^work) of the null space of matrix - root / 2^bits,
    by inverse iteration in fixed point."""
    d = len(matrix)
    a = np.array([[x << work for x in row] for row in matrix], object).reshape(d, d)
    for i in range(d):
        a[i, i] -= root << work >> bits
    order, factors = [], []
    for k in range(d):  # elimination with row exchange; the factors are kept for the solutions
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        f = [(x << work) // a[k, k] for x in a[k + 1:, k]]
        for i, x in enumerate(f):
            if x:
                a[k + 1 + i, k:] -= (x * a[k, k:]) >> work
        order.append(best)
        factors.append(f)

    def solve(b: list[int]) -> list[int]:
        b = list(b)
        for k in range(d):
            b[k], b[order[k]] = b[order[k]], b[k]
            for i, x in enumerate(factors[k]):
                b[k + 1 + i] -= x * b[k] >> work
        for k in range(d - 1, -1, -1):
            b[k] = ((b[k] - (sum(a[k, j] * b[j] for j in range(k + 1, d)) >> work)) << work) // a[k, k]
        return b

    def unit(v: list[int]) -> list[int]:
        length = isqrt(sum(x * x for x in v)) or 1
        return [(x << work) // length for x in v]

    found: list[list[int]] = []
    start = Random(d)
    for _ in range(count):
        v = unit([start.getrandbits(62) - (1 << 61) for _ in range(d)])
        for _ in range(4):
            for u in found:
                dot = sum(x * y for x, y in zip(u, v)) >> work
                v = [y - (dot * x >> work) for x, y in zip(u, v)]
            v = unit(solve(unit(v)))
        for u in found:
            dot = sum(x * y for x, y in zip(u, v)) >> work
            v = [y - (dot * x >> work) for x, y in zip(u, v)]
        found.append(unit(v))
    return found


def signed(v: list[int], work: int) -> list[float]:
    """In doubles, the entry of the largest absolute value positive."""
    largest = max(v, key=abs)
    return [(x if largest > 0 else -x) / (1 << work) for x in v]


class Model:
    """What whitening needs: the number and exact sums of the vectors, the unit components, their
    variances and their shares of the whole variance."""

    def __init__(self, size: int, n: int, sums: list[int]):
        self.size, self.n, self.sums = size, n, sums
        self.components: list[list[float]] = []
        self.variances: list[float] = []
        self.explained: list[float] = []


def fit(rows: DataFrame, col: str, components: int = COMPONENTS) -> Model | None:
    """The model of the usable vectors of the commonest length; None without vectors. The driver
    gets the sums, (length + 1)^2 / 2 numbers."""
    spark = rows.sparkSession
    sums = stage(moments(rows, col), "whitening-moments")
    counts = sums.where("i = -1").groupBy("size").agg(F.sum(F.expr("value * power(2, limb * 60)")).alias("n"))
    commonest = counts.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not commonest:
        return None
    d = commonest[0]["size"]
    have: dict[tuple[int, int], int] = {}
    for r in sums.where(F.col("size") == d).collect():
        have[r.i, r.j] = have.get((r.i, r.j), 0) + (int(r.value) << LIMB * r.limb)
    model = Model(d, have[-1, -1], [have[i, -1] for i in range(d)])
    n, s = model.n, model.sums
    scatter = [[n * have[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    if trace == 0:
        return model
    poly = characteristic_polynomial(spark, scatter)
    found = min(components, roots_above(poly, 0, 0))
    bits = max(0, ROOT_BITS - trace.bit_length())
    work = max(WORK_BITS - trace.bit_length(), 128)

    def isolate(batches):
        for pdf in batches:
            pdf["root"] = [str(kth_root(poly, int(k), trace, bits)) for k in pdf["k"]]
            yield pdf

    each = spark.createDataFrame([(k,) for k in range(1, found + 1)], "k int").repartition(found, "k")
    roots = {r.k: int(r.root) for r in each.mapInPandas(isolate, "k int, root string").collect()}
    near = trace << bits >> EQUAL_BITS
    clusters: list[list[int]] = []
    for k in range(1, found + 1):
        if clusters and roots[clusters[-1][-1]] - roots[k] <= near:
            clusters[-1].append(k)
        else:
            clusters.append([k])

    def iterate(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, signed(v, work)) for first, number in zip(pdf["first"], pdf["number"])
                    for k, v in enumerate(null_vectors(scatter, roots[first], bits, number, work), first)]
            yield pd.DataFrame(rows, columns=["k", "component"])

    grouped = spark.createDataFrame([(c[0], len(c)) for c in clusters], "first int, number int")
    unit = {r.k: r.component for r in grouped.repartition(len(clusters), "first")
            .mapInPandas(iterate, "k int, component array<double>").collect()}
    model.components = [unit[k] for k in range(1, found + 1)]
    model.variances = [roots[k] / (n * n << bits) for k in range(1, found + 1)]
    model.explained = [roots[k] / (trace << bits) for k in range(1, found + 1)]
    return model


def projected(rows: DataFrame, model: Model, col: str, keep: list[Column]) -> DataFrame:
    """The vectors of the model's length as ``keep``, ``deviation`` (decimal, null beyond 38 digits)
    and ``whitened``, an array with a number for each component."""
    n, size, sums = model.n, model.size, model.sums
    turn = np.array(model.components).reshape(-1, size) / np.sqrt(model.variances)[:, None]
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        import pyarrow as pa
        from decimal import Decimal

        limit = max([abs(x) for x in sums] + [0])
        for batch in batches:
            y = vectors(batch.column(len(names)), size)
            most = (n * int(np.abs(y).max(initial=0)) + limit)
            if most * most * max(size, 1) < 1 << 62:
                off = n * y - np.array(sums, np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = n * y.astype(object) - np.array(sums, object)
                deviation = (off * off).sum(axis=1).tolist()
            white = np.einsum("ni,ki->nk", off.astype(np.float64) / n, turn)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)],
                 pa.array([Decimal(x) if x < 10 ** 38 else None for x in deviation], pa.decimal128(38, 0)),
                 pa.array(list(white), pa.list_(pa.float64()))], names=[*names, "deviation", "whitened"])

    alike = rows.where(F.size(col) == size).select(
        *[c.alias(x) for c, x in zip(keep, names)], F.col(col).cast("array<double>").alias("v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alike.schema.fields[:-1])
    return alike.mapInArrow(run, f"{kinds}, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    mean = white.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(components)]).first()
    off = [F.col("whitened")[i] - F.lit(mean[i]) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = white.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each
    usable vector and component, numbered from 1 by falling variance."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(usable(F.col("vector")))
    model = fit(rows, "vector", components)
    if model is None or not model.components:
        return embeddings.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    white = stage(projected(rows, model, "vector", [F.col("vec_id")]).withColumnRenamed("k0", "vec_id"), "whitened")
    error = identity_error(white, len(model.components))
    shares = F.array(*[F.lit(x) for x in model.explained])
    return (white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))


@register("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's deviation is a long, as asked; null where it does not fit one (the operator has
    it as a decimal)."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
