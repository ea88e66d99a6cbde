"""Embedding whitening from the exact characteristic polynomial of the scatter matrix.

Entries become integers, so the scatter matrix ``n * sum(x x') - sum(x) sum(x)'``
(the covariance times n squared) is exact. Its characteristic polynomial is found
modulo many primes, each by reduction to Hessenberg form, and put together by the
Chinese remainder theorem, with as many primes as a bound of the coefficients
needs. All its roots are real, so the number of roots beyond a point is exactly the
number of sign changes of the polynomial moved there (Descartes); halving by that
count isolates a root, and by the polynomial's sign, once it is alone, refines it to
``ROOT_BITS`` bits. The null space of the matrix less that root, by inverse
iteration in ``DIGITS`` decimal digits, gives the components; a root of multiplicity
m gives m orthogonal ones.

Scale: rows are read in a pass for sums and products (one small table a task, summed
by entry) and in a pass that projects them; primes and roots are rows that tasks
work on. The driver holds only what the dimension bounds: the scatter matrix,
the polynomial and up to 8 vectors.

Defined cases: vectors that are null or empty or hold null or non-finite entries
take no part, nor do those of another length than most have (the smaller length, if
tied). Repeated rows count again; ids may be null or repeat. Entries are
clamped to 2^62 / 1024 either way before they become integers. Components of
variance 0 are not returned (a single row, or equal rows, give none); a
deviation beyond 64 bits is null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from hearth.llm.common import map_rows, staged

#: x = floor(SCALE c) + SHIFT
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROOT_BITS, DIGITS = 220, 160
LIMB = 32
CLAMP = float(2**62)

SUMS = StructType([StructField("entry", IntegerType()), StructField("limb", IntegerType()), StructField("value", LongType())])
RESIDUES = StructType([StructField("prime", LongType()), StructField("coefficients", ArrayType(LongType()))])
ROOTS = StructType([StructField("component", IntegerType()), StructField("root", StringType()),
                    StructField("vector", ArrayType(DoubleType()))])


def integer_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (array of long) of the rows that take part."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    c = F.col(vector).cast("array<double>")
    rows = embeddings.select("vec_id", c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & ~F.exists("c", bad))
    most = rows.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    held = lambda v: F.greatest(F.least(v * SCALE, F.lit(CLAMP)), F.lit(-CLAMP))
    return (rows.where(F.size("c") == (most.d if most else 0))
            .select("vec_id", F.transform("c", lambda v: F.floor(held(v)) + F.lit(SHIFT).cast("long")).alias("x")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of x less the shift, which neither covariance nor deviation depends on."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) - SHIFT


def _products(y: np.ndarray) -> np.ndarray:
    """y' y of integer rows, exact, as Python integers where 64 bits may not do."""
    most = max(1, int(max(y.max(), -y.min())))
    if most * most * len(y) < 2**53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(y) < 2**63:
        return (y.T @ y).astype(object)
    big = y.astype(object)
    return big.T @ big


@dataclass(frozen=True)
class Scatter:
    """n, the sums of y = x - SHIFT, and n sum(y y') - sum(y) sum(y)', all exact."""

    n: int
    sums: list[int]
    matrix: np.ndarray  # of Python integers


def scatter(vectors: DataFrame) -> Scatter:
    """Exact sums and products: one pass, added up by entry in pieces of 32 bits."""
    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        total = None
        for b in batches:
            if len(b["x"]):
                y = _matrix(b["x"])
                part = _products(np.concatenate([np.ones((len(y), 1), np.int64), y], axis=1))
                total = part if total is None else total + part
        if total is None:
            return
        out: dict[str, list[int]] = {"entry": [], "limb": [], "value": []}
        for i, j in zip(*np.triu_indices(len(total)), strict=True):
            value, limb = total[i, j], 0
            while True:
                value, low = (0, value) if -(1 << LIMB) < value < 1 << LIMB else (value >> LIMB, value & ((1 << LIMB) - 1))
                for name, v in zip(out, (i * len(total) + j, limb, low), strict=True):
                    out[name].append(v)
                limb += 1
                if not value:
                    break
        yield out

    parts = map_rows(vectors.select("x"), SUMS, run).groupBy("entry", "limb").agg(F.sum("value").alias("value")).collect()
    if not parts:
        return Scatter(0, [], np.zeros((0, 0), object))
    size = max(r.entry for r in parts) + 1
    size = round(size**0.5)
    z = np.zeros((size, size), object)
    for r in parts:
        z[divmod(r.entry, size)] += r.value << (LIMB * r.limb)
    z = z + np.triu(z, 1).T
    n, sums = int(z[0, 0]), [int(v) for v in z[0, 1:]]
    s = np.array(sums, object)
    return Scatter(n, sums, n * z[1:, 1:] - np.outer(s, s))


def _is_prime(p: int) -> bool:
    """Miller-Rabin, exact below 3.4 * 10^14 with these bases."""
    d, r = p - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13, 17):
        x = pow(a, d, p)
        if x in (1, p - 1):
            continue
        for _ in range(r - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product is above ``bound``."""
    out, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(t - a) modulo the prime ``p`` < 2^31."""
    h, d = np.array(a % p, np.int64), len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        weight, run = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = h[i, k - 1] * run % p
            run = run * int(h[i, i - 1]) % p if i else 0
        polys[k] = (polys[k] - (weight[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Exact coefficients, lowest first, of det(t - a) for a positive semidefinite integer matrix."""
    d, trace = len(a), int(sum(a[i, i] for i in range(len(a))))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))  # of sums of products of k roots
    primes = primes_beyond(2 * bound)
    held = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for b in batches:
            mine = b["prime"].to_pylist()
            yield {"prime": mine, "coefficients": [polynomial_mod(held.value, p) for p in mine]}

    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(len(primes), 64))
    found = {r.prime: r.coefficients for r in map_rows(rows, RESIDUES, run).collect()}
    product = 1
    for p in primes:
        product *= p
    out = [0] * (d + 1)
    for p in primes:
        rest = product // p
        one = rest * pow(rest, -1, p)
        for k, c in enumerate(found[p]):
            out[k] += c * one
    return [c - product if (c := v % product) > product // 2 else c for v in out]


def _moved(poly: list[int], point: int, scale: int) -> list[int]:
    """2^(-scale d) poly(2^scale (t + point)) times a power of 2, with integer coefficients."""
    d = len(poly) - 1
    out = [c << (scale * k if scale >= 0 else -scale * (d - k)) for k, c in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            out[k] += point * out[k + 1]
    return out


def roots_beyond(poly: list[int], point: int, scale: int = 0) -> int:
    """Number of roots above ``point * 2^scale`` of a polynomial whose roots are all real."""
    signs = [c > 0 for c in _moved(poly, point, scale) if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], point: int, scale: int) -> int:
    d, value = len(poly) - 1, 0
    for k in range(d, -1, -1):
        value = value * point + (poly[k] << (scale * k if scale >= 0 else -scale * (d - k)))
    return (value > 0) - (value < 0)


def isolate(poly: list[int], j: int, top: int, bits: int = ROOT_BITS) -> tuple[Fraction, int, int]:
    """The ``j``-th largest root (from 1, positive) to ``bits`` bits, how many roots lie above the
    interval that holds it, and how many lie in it. ``top`` is no smaller than any root."""
    low, high, scale = 0, top, 0  # the root lies in (low, high] * 2^scale
    above, upto = 0, roots_beyond(poly, 0)
    alone_sign = 0
    while True:
        if high - low <= 1:
            if high.bit_length() > bits:
                break
            low, high, scale = low * 2, high * 2, scale - 1
        middle = (low + high) // 2
        if upto - above == 1:
            alone_sign = alone_sign or _sign(poly, low, scale)  # 0 if another root lies on ``low``
        if alone_sign:
            here = _sign(poly, middle, scale)
            if here != alone_sign:
                high = middle
            else:
                low, alone_sign = middle, here
            continue
        beyond = roots_beyond(poly, middle, scale)
        if beyond >= j:
            low, upto = middle, beyond
        else:
            high, above = middle, beyond
    return Fraction(low + high, 2) * Fraction(2) ** scale, above, upto - above


def null_space(a: np.ndarray, root: Fraction, size: int, digits: int = DIGITS) -> np.ndarray:
    """An orthonormal basis (``size`` rows) of the eigenvectors of ``a`` at ``root``, by inverse
    iteration from fixed starts with Decimal arithmetic."""
    d = len(a)
    with localcontext(Context(prec=digits, Emax=10**9, Emin=-10**9)):
        at = Decimal(root.numerator) / Decimal(root.denominator)
        m = np.array([[Decimal(int(v)) for v in row] for row in a], object)
        for i in range(d):
            m[i, i] -= at
        tiny = max(at, Decimal(1)).scaleb(-digits)
        order = np.arange(d)
        for k in range(d):  # triangular factors, kept in place
            pivot = k + int(np.argmax(np.abs(m[k:, k])))
            if pivot != k:
                m[[k, pivot]] = m[[pivot, k]]
                order[[k, pivot]] = order[[pivot, k]]
            if abs(m[k, k]) < tiny:
                m[k, k] = tiny
            if k + 1 < d:
                m[k + 1:, k] = m[k + 1:, k] / m[k, k]
                m[k + 1:, k + 1:] = m[k + 1:, k + 1:] - np.outer(m[k + 1:, k], m[k, k + 1:])

        def solve(v: np.ndarray) -> np.ndarray:
            w = v[order]
            for k in range(1, d):
                w[k] = w[k] - m[k, :k] @ w[:k]
            for k in range(d - 1, -1, -1):
                w[k] = (w[k] - (m[k, k + 1:] @ w[k + 1:] if k + 1 < d else 0)) / m[k, k]
            return w

        draw = np.random.default_rng(1).integers(1, 1 << 30, (size, d))
        basis = [np.array([Decimal(int(v)) for v in row], object) for row in draw]
        for _ in range(3):
            for r in range(size):
                w = solve(basis[r])
                for _ in range(2):
                    for q in basis[:r]:
                        w = w - (q @ w) * q
                    w = w / (w @ w).sqrt()
                basis[r] = w
        return np.array([[float(v) for v in w] for w in basis])


@dataclass(frozen=True)
class Whitener:
    """Components (rows) with the eigenvalues of the covariance, and each one's share of its trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener:
    """The leading components of ``vectors`` (``x`` of ``integer_vectors``)."""
    spark, s = vectors.sparkSession, scatter(vectors)
    trace = int(sum(s.matrix[i, i] for i in range(len(s.matrix))))
    if trace == 0:
        return Whitener(s.n, s.sums, np.zeros((0, len(s.sums))), [], [])
    poly = characteristic_polynomial(spark, s.matrix)
    count = min(components, roots_beyond(poly, 0))
    held = spark.sparkContext.broadcast((poly, s.matrix))

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        poly, a = held.value
        for b in batches:
            mine = b["component"].to_pylist()
            found = [isolate(poly, j, trace) for j in mine]
            vectors = [null_space(a, root, size)[j - above - 1] for j, (root, above, size) in zip(mine, found, strict=True)]
            yield {"component": mine, "root": [f"{r.numerator}/{r.denominator}" for r, _, _ in found],
                   "vector": [v if v[np.argmax(np.abs(v))] > 0 else -v for v in vectors]}

    rows = spark.createDataFrame([(j,) for j in range(1, count + 1)], "component int").repartition(count, "component")
    found = sorted(map_rows(rows, ROOTS, run).collect())
    roots = [Fraction(r.root) for r in found]
    return Whitener(s.n, s.sums, np.array([r.vector for r in found]),
                    [float(r / s.n**2) for r in roots], [float(r / trace) for r in roots])


def transform(vectors: DataFrame, w: Whitener) -> DataFrame:
    """Each row with ``deviation`` (sum of (n x - S)^2) and ``whitened`` (array, one value a component)."""
    held = vectors.sparkSession.sparkContext.broadcast(w)
    schema = StructType([vectors.schema["vec_id"], StructField("deviation", LongType()),
                         StructField("whitened", ArrayType(DoubleType()))])

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        w = held.value
        sums = np.array(w.sums, object)
        project = w.components.T / np.sqrt(np.array(w.eigenvalues))
        for b in batches:
            if not len(b["x"]):
                continue
            y = _matrix(b["x"])
            most = w.n * int(max(y.max(), -y.min())) + max(map(abs, w.sums))
            if most * most * y.shape[1] < 2**63:
                off = w.n * y - sums.astype(np.int64)
                deviation = (off * off).sum(1).tolist()
            else:
                off = w.n * y.astype(object) - sums
                deviation = [v if v < 2**63 else None for v in (off * off).sum(1)]
            yield {"vec_id": b["vec_id"], "deviation": deviation,
                   "whitened": list((off / w.n).astype(float) @ project)}

    return map_rows(vectors.select("vec_id", "x"), schema, run)


def identity_error(whitened: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity."""
    value = lambda i: F.col("whitened")[i]
    off = [F.abs(F.covar_pop(value(i), value(j)) - float(i == j)) for i in range(count) for j in range(i, count)]
    return float(whitened.agg(F.greatest(*off, F.lit(0.0)).alias("e")).first().e)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row that
    takes part and every component."""
    vectors = integer_vectors(embeddings)
    w = fit(vectors, components)
    count = len(w.eigenvalues)
    if not count:
        return transform(vectors.limit(0), w).select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation",
            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    rows = staged(transform(vectors, w), "whitened")
    error = identity_error(rows, count)
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, w.explained)), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
                       "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
