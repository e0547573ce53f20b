"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries become integers ``x = floor(64 * c) + 1000000``. Tasks add up exact integer sums and products, so n, the sums S
and the scatter ``C = n * sum(x x') - S S'`` (n * n times the covariance) have no rounding; as all results are of
``n * x - S``, the million cancels and is never added. Then, on matrices whose size is that of a vector and not of the
table:

1. The characteristic polynomial of C: modulo each of as many primes as its largest coefficient needs, C is brought to
   Hessenberg form and the polynomial read off by recurrence, a Spark task for each block of primes; the remainders meet
   in integers by the Chinese remainder theorem.
2. C is symmetric, so all roots are real, and by Descartes' rule the sign changes of ``p(x + a)`` count the roots above
   a, repeated ones included. Bisection at integers, then at ``2 ** -BITS``, isolates them; Newton's method narrows a
   simple root in fixed point.
3. Components are null vectors of ``C - e I``: inverse iteration in double precision, corrected by residuals in long
   integers, roots that agree to ``CLUSTER`` together as one space.

A last pass projects every row; its own covariance gives ``identity_error``.

Cases: rows whose vector is null, empty or holds null or non-finite entries take no part, nor do vectors of another
length than most rows have (of equally many, the longer); repeated rows count as often as they stand; null ids stay; components
of no variance cannot be whitened and are left out, so a table of one place gives no rows, as an empty one does; a
deviation beyond a long is null; further columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 64
COMPONENTS = 32
#: Bits behind the point of roots and vectors; relative distance of roots whose vectors are found together.
BITS, CLUSTER = 96, 1e-11
LIMB = 10**17
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _entries(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    """(ids, floor(SCALE * c)) of the rows of ``width`` finite entries."""
    vectors = batch.column("vector")
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.asarray(vectors.flatten().fill_null(math.nan), np.float64)
    starts = np.cumsum(lengths) - lengths
    rows = np.flatnonzero(lengths == width)
    values = np.floor(SCALE * flat[starts[rows][:, None] + np.arange(width)])
    good = np.isfinite(values).all(axis=1)
    return batch.column("vec_id").take(pa.array(rows[good])), values[good]


def _limbs(v: int) -> list[int]:
    """Digits of an integer to base LIMB, lowest first, all with its sign."""
    out, sign, v = [], (v > 0) - (v < 0), abs(v)
    while v:
        v, low = divmod(v, LIMB)
        out.append(sign * low)
    return out


def _products(width: int):
    """Exact sums of entries and of products of two, as (i, j, limb, digits); (-1, -1) counts rows."""

    def run(batches):
        n, total, gram = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = _entries(batch, width)[1]
            n += len(y)
            largest = np.abs(y).max(initial=1)
            # Sums of fewer than 2**53 are exact in doubles; larger entries go as integers.
            step = int(2**53 // max(1, int(largest)) ** 2)
            for lo in range(0, len(y), max(step, 1)):
                part = y[lo : lo + max(step, 1)]
                if not step:
                    part = np.array([[int(v) for v in r] for r in part], object)
                added = part.T @ part
                gram += added if not step else added.astype(np.int64).astype(object)
                sums = part.sum(axis=0)
                total += sums if not step else sums.astype(np.int64).astype(object)
        i, j = np.triu_indices(width)
        rows = [(-1, -1, n), *((-1, k, v) for k, v in enumerate(total)), *zip(i.tolist(), j.tolist(), gram[i, j])]
        rows = [(i, j, k, v) for i, j, whole in rows for k, v in enumerate(_limbs(int(whole)))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["i", "j", "limb", "value"])

    return run


def integer_moments(vectors: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of ``floor(SCALE * c)``, exactly; ``width`` squared numbers in all."""
    parts = vectors.mapInArrow(_products(width), "i int, j int, limb int, value long")
    found: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect():
        found[r.i, r.j] = found.get((r.i, r.j), 0) + int(r.total) * LIMB**r.limb
    gram = [[found.get((min(i, j), max(i, j)), 0) for j in range(width)] for i in range(width)]
    return found.get((-1, -1), 0), [found.get((-1, k), 0) for k in range(width)], gram


# The characteristic polynomial ---------------------------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while not d & 1:
        d, s = d >> 1, s + 1
    for a in (2, 3, 5, 7):  # enough below 3.2e9
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(count: int, top: int = 1 << 31) -> list[int]:
    out, n = [], top - 1
    while len(out) < count:
        if _is_prime(n):
            out.append(n)
        n -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo a prime below 2**31, lowest first."""
    h, n = matrix.copy() % p, len(matrix)
    for k in range(1, n - 1):
        pivots = np.flatnonzero(h[k:, k - 1])
        if not len(pivots):
            continue
        r = k + int(pivots[0])
        if r != k:
            h[[r, k]] = h[[k, r]]
            h[:, [r, k]] = h[:, [k, r]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, n + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - int(h[k - 1, k - 1]) * polys[k - 1]) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            polys[k] = (polys[k] - below * int(h[k - i - 1, k - 1]) % p * polys[k - i - 1]) % p
    return polys[n].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(xI - matrix) for a symmetric matrix, lowest first."""
    width = len(matrix)
    # All roots lie within the largest absolute row sum, so a coefficient is below (1 + that) ** width.
    bits = width * (max(sum(map(abs, r)) for r in matrix) + 1).bit_length() + 2
    primes = primes_below(bits // 30 + 1)
    flat = [str(v) for r in matrix for v in r]

    def run(batches):
        for batch in batches:
            for p in batch.column("p").to_pylist():
                rest = np.array([int(v) % p for v in flat], np.int64).reshape(width, width)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_mod(rest, p)], pa.list_(pa.int64()))], names=["p", "rest"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    by_prime = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, rest array<long>")
    value, product = [0] * (width + 1), 1
    for r in by_prime.collect():
        back = pow(product, -1, r.p)
        value = [v + product * ((x - v) * back % r.p) for v, x in zip(value, r.rest)]
        product *= r.p
    return [v - product if 2 * v > product else v for v in value]


# Roots ---------------------------------------------------------------------------------------------------------------


def _moved(p: list[int], a: int) -> list[int]:
    """Coefficients of p(x + a)."""
    q = p[:]
    for i in range(len(q) - 1):
        for k in range(len(q) - 2, i - 1, -1):
            q[k] += a * q[k + 1]
    return q


def roots_above(p: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only are greater than the integer a."""
    signs = [c > 0 for c in _moved(p, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(p: list[int], count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(root * 2 ** bits rounded down, multiplicity) of the greatest positive roots, falling; at least ``count`` in all.

    ``p`` is monic with integer coefficients and has real roots only. Roots that differ by less than 2 ** -bits count as one.
    """
    positive = roots_above(p, 0)
    top = 1
    while roots_above(p, top):
        top *= 2
    fine = [c << bits * (len(p) - 1 - k) for k, c in enumerate(p)]  # its roots are the others times 2 ** bits
    slope = [k * c for k, c in enumerate(fine)][1:]
    value = lambda q, x: _horner(q, x)
    out: list[tuple[int, int]] = []
    open_ = [(0, top << bits, 0, positive)]  # (low, high], roots above high, roots above low
    while open_ and sum(m for _, m in out) < count:
        low, high, above_high, above_low = open_.pop()
        if above_low == above_high:
            continue
        if high - low == 1:
            out.append((low, above_low - above_high))
            continue
        if above_low - above_high == 1 and high < low + (low >> 2):
            out.append((_narrowed(fine, slope, low, high, value), 1))
            continue
        middle = (low + high) // 2
        above = roots_above(p, middle >> bits) if not middle & ((1 << bits) - 1) else roots_above(fine, middle)
        open_ += [(low, middle, above, above_low), (middle, high, above_high, above)]
    return out


def _horner(q: list[int], x: int) -> int:
    v = 0
    for c in reversed(q):
        v = v * x + c
    return v


def _narrowed(p: list[int], slope: list[int], low: int, high: int, value) -> int:
    """The one root in (low, high], rounded down, by Newton steps that bisection replaces where they leave the interval."""
    at_high = value(p, high)
    if not at_high:
        return high
    x = (low + high) // 2
    while high - low > 1:
        v = value(p, x)
        if not v:
            return x
        if (v > 0) == (at_high > 0):
            high = x
        else:
            low = x
        d = value(slope, x)
        step = x - v // d if d else low
        # Both sides of a step tell whether the root lies next to it.
        x = step if low < step < high else (low + high) // 2
        if abs(step - high) <= 1 and low < high - 2:
            x = high - 2
        elif abs(step - low) <= 1 and low + 2 < high:
            x = low + 2
    return low


# Components ----------------------------------------------------------------------------------------------------------


def _fixed_product(matrix: list[list[int]], v: list[int]) -> list[int]:
    return [sum(a * b for a, b in zip(r, v) if a) for r in matrix]


def components(matrix: list[list[int]], roots: list[tuple[int, int]], bits: int = BITS) -> np.ndarray:
    """Unit null vectors of ``matrix - root I``, a row for each root and multiplicity, orthogonal where roots are close."""
    width, scale = len(matrix), float(max(max(map(abs, r)) for r in matrix))
    unit = 1 << bits
    near = np.array([[float(Fraction(v) / Fraction(scale)) for v in r] for r in matrix])
    out: list[np.ndarray] = []
    k = 0
    while k < len(roots):
        group = [roots[k]]
        while k + len(group) < len(roots) and roots[k][0] - roots[k + len(group)][0] <= CLUSTER * roots[0][0]:
            group.append(roots[k + len(group)])
        k += len(group)
        many = sum(m for _, m in group)
        centre = sum(r * m for r, m in group) // many
        mu = float(Fraction(centre, unit) / Fraction(scale))
        shifted = near - (mu + 4 * np.finfo(float).eps * max(abs(mu), 1e-300)) * np.eye(width)
        q = np.linalg.qr(np.random.default_rng(7).standard_normal((width, many)))[0]
        for _ in range(4):
            q = np.linalg.qr(np.linalg.solve(shifted, q))[0]
        if many == 1:
            q = _refined(matrix, near, centre, mu, scale, q[:, 0], bits)[:, None]
        out += [q[:, c] * (1.0 if q[np.argmax(np.abs(q[:, c])), c] > 0 else -1.0) for c in range(many)]
    return np.array(out).reshape(-1, width)


def _refined(matrix, near, root: int, mu: float, scale: float, v: np.ndarray, bits: int) -> np.ndarray:
    """``v`` after corrections by residuals of (matrix - root) v in fixed point."""
    width, unit = len(matrix), 1 << bits
    bordered = np.block([[near - mu * np.eye(width), v[:, None]], [v[None], np.zeros((1, 1))]])
    fixed = [round(Fraction(float(x)) * unit) for x in v]
    for _ in range(3):
        residual = [unit * a - root * b for a, b in zip(_fixed_product(matrix, fixed), fixed)]
        right = np.array([float(Fraction(-r, unit * unit) / Fraction(scale)) for r in residual] + [0.0])
        change = np.linalg.solve(bordered, right)[:-1]
        fixed = [a + round(Fraction(float(c)) * unit) for a, c in zip(fixed, change)]
        if np.abs(change).max() < 1e-18:
            break
    length = math.isqrt(sum(x * x for x in fixed))
    return np.array([float(Fraction(x, length)) for x in fixed])


# The table -----------------------------------------------------------------------------------------------------------


def _whitened(width: int, n: int, sums: list[int], basis: np.ndarray):
    """(ids, deviations, whitened) of a batch; ``basis`` projects n * x - S."""
    total = np.array(sums, object)
    small = n * 2.0**40 < 2**62 and all(abs(s) < 2**62 for s in sums)

    def run(batch: pa.RecordBatch):
        ids, y = _entries(batch, width)
        if small and np.abs(y).max(initial=0) < 2**40:
            away = n * y.astype(np.int64) - total.astype(np.int64)
        else:
            away = np.array([[n * int(v) - s for v, s in zip(r, sums)] for r in y], object).reshape(len(y), width)
        if np.abs(away.astype(np.float64)).max(initial=0) ** 2 * width < 2**62:
            squares = (away.astype(np.int64) ** 2).sum(axis=1).tolist()
        else:
            squares = [sum(int(v) * int(v) for v in r) for r in away]
        return ids, [s if s < 1 << 63 else None for s in squares], away.astype(np.float64) @ basis.T

    return run


def whitened(vectors: DataFrame, most: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row and up to ``most`` components."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    common = vectors.where("size(vector) > 0").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common.width if common else 0
    n, sums, gram = integer_moments(vectors, width) if width else (0, [], [])
    scatter = [[n * gram[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    if not any(scatter[i][i] for i in range(width)):
        return spark.createDataFrame([], RESULT)
    roots = largest_roots(characteristic_polynomial(spark, scatter), min(most, width))
    axes = components(scatter, roots)[:most]
    values = [r for r, m in roots for _ in range(m)][:most]
    trace = sum(scatter[i][i] for i in range(width)) << BITS
    explained = np.array([float(Fraction(r, trace)) for r in values])
    # whitened = (n x - S) / n . v / sqrt(root / n**2): n cancels.
    basis = axes / np.sqrt([float(Fraction(r, 1 << BITS)) for r in values])[:, None]
    project, kept = _whitened(width, n, sums, basis), len(values)

    def spread(batches):
        added, total = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            w = project(batch)[2]
            added += w.T @ w
            total += w.sum(axis=0)
        rows = [(i, j, float(added[i, j])) for i in range(kept) for j in range(kept)] + [(-1, j, float(total[j])) for j in range(kept)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows])], names=["i", "j", "value"])

    found = vectors.mapInArrow(spread, "i int, j int, value double").groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,16)")).cast("double").alias("value")).collect()
    cells = {(r.i, r.j): r.value / n for r in found}
    error = max(abs(cells[i, j] - cells[-1, i] * cells[-1, j] - (i == j)) for i in range(kept) for j in range(kept))

    def scored(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                ids, squares, w = project(batch.slice(lo, 2048))
                rows = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(np.arange(rows), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)), pa.array(np.full(rows * kept, n)), pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(rows), kept))),
                     pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * kept, error))],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return vectors.mapInArrow(scored, RESULT)
