"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Tasks add up integer products of integer vectors, so the scatter n * sum(x x') - S S' is exact. Its characteristic polynomial
is found modulo many primes, each in a task of its own by reduction to Hessenberg form, and put together by Chinese
remaindering. All its roots are real, so the number of roots above t is exactly the number of sign changes of the shifted
polynomial p(x + t): bisection isolates the greatest roots to any precision. Inverse iteration in long decimals finds the
null spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Components returned; bits of a limb of an entry; rows multiplied at a time, so that sums of limb products stay exact in doubles.
COMPONENTS, LIMB, SLICE = 4, 20, 4096
#: Decimal digits of the inverse iteration, and bits to which a root is isolated relative to the greatest.
DIGITS, BITS = 90, 220
_CELLS = "cell int, power int, value decimal(38,0)"
_ROWS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integer_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x: the rows whose vector is not empty and has only finite entries c, as x = floor(256 c).

    Vectors that are null, empty, or hold a null, a non-finite entry or one beyond what a long holds (256 |c| < 2**63) are dropped.
    """
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: c * 256.0)
    rows = df.select(F.col(id).cast("bigint").alias("vec_id"), scaled.alias("c"))
    fits = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 63)))
    return rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & fits).select("vec_id", F.transform("c", lambda c: F.floor(c).cast("bigint")).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limbs(m: np.ndarray) -> list[np.ndarray]:
    """Integers as doubles of LIMB bits each, least first; the last carries the sign."""
    out = []
    while m.size and (m.max() >= 1 << LIMB or m.min() < -(1 << LIMB)):
        out.append((m & ((1 << LIMB) - 1)).astype(np.float64))
        m = m >> LIMB
    return [*out, m.astype(np.float64)]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of x x' (cells i * (d + 1) + j, j < d), of x (j = d) and the number of rows (cell -1), by powers of 2 ** LIMB."""
    total: dict[int, np.ndarray] = {}
    n = 0
    for batch in batches:
        m = matrix_of(batch.column("x")) if batch.num_rows else np.zeros((0, 0), np.int64)
        for at in range(0, len(m), SLICE):
            parts = limbs(m[at : at + SLICE])
            n += len(parts[0])
            for a, left in enumerate(parts):
                ones = np.ones((len(left), 1))
                for b, right in enumerate(parts):
                    own = left.T @ (np.concatenate([right, ones], axis=1) if b == 0 else np.concatenate([right, 0 * ones], axis=1))
                    held = total.get(a + b)
                    own = own.astype(np.int64)
                    total[a + b] = own.astype(object) if held is None else held + own
    cells, powers, values = [-1], [0], [n]
    for power, sums in total.items():
        at = np.flatnonzero(sums.ravel())
        cells += at.tolist()
        powers += [power] * len(at)
        values += [int(v) for v in sums.ravel()[at]]
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(powers, pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], ["cell", "power", "value"])


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n * sum(x x') - S S' over the rows (x) of fit, exactly. The driver sees these d * (d + 1) numbers only."""
    sums = fit.select("x").mapInArrow(_products, _CELLS).groupBy("cell", "power").agg(F.sum("value").alias("value"))
    found: dict[int, int] = {}
    for cell, power, value in sums.collect():
        found[cell] = found.get(cell, 0) + (int(value) << (LIMB * power))
    n, cell = found.get(-1, 0), lambda i, j: found.get(i * (d + 1) + j, 0)
    s = [cell(i, d) for i in range(d)]
    return n, s, [[n * cell(i, j) - s[i] * s[j] for j in range(d)] for i in range(d)]


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that settle every n below 2**32."""
    if n % 2 == 0:
        return n == 2
    s = ((n - 1) & -(n - 1)).bit_length() - 1
    for a in (2, 7, 61):
        x = pow(a, (n - 1) >> s, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(product: int) -> list[int]:
    """The greatest primes below 2**31 whose product is at least `product`."""
    out, held, p = [], 1, (1 << 31) - 1
    while held < product:
        if _is_prime(p):
            out.append(p)
            held *= p
        p -= 2
    return out


def hessenberg_polynomial(m: np.ndarray, p: int) -> list[int]:
    """Coefficients modulo p of det(t - m), constant first: m is brought to Hessenberg form, whose leading minors obey a recurrence."""
    h, d = m.astype(np.int64) % p, len(m)
    for k in range(1, d - 1):
        pivots = np.flatnonzero(h[k:, k - 1])
        if not len(pivots):
            continue
        if pivots[0]:
            i = k + int(pivots[0])
            h[[k, i]] = h[[i, k]]
            h[:, [k, i]] = h[:, [i, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k][None] % p) % p
        for at in range(0, len(u), 512):  # products are below 2**62, so they are added one reduced chunk at a time
            part = h[:, k + 1 + at : k + 1 + at + 512] * u[None, at : at + 512] % p
            h[:, k] = (h[:, k] + part.sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - int(h[k - 1, k - 1]) * minors[k - 1] % p) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            minors[k] = (minors[k] - chain * int(h[k - i - 1, k - 1]) % p * minors[k - i - 1] % p) % p
    return minors[d].tolist()


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t - m), constant first. Each prime is a row of a DataFrame; the driver gets d + 1 remainders of each.

    Coefficients are at most the elementary symmetric sums of the rows' lengths (Hadamard), which gives the number of primes.
    """
    d = len(m)
    bound = 1
    for row in m:
        bound *= 1 + isqrt(sum(v * v for v in row)) + 1
    moduli = primes(4 * bound)
    sent = spark.sparkContext.broadcast(m)  # d * d numbers

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                own = np.array([[v % p for v in row] for row in sent.value], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([hessenberg_polynomial(own, p)], pa.list_(pa.int64()))], ["p", "remainders"])

    parts = min(len(moduli), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in moduli], "p bigint").repartition(parts).mapInArrow(reduce, "p bigint, remainders array<bigint>")
    value, product = [0] * (d + 1), 1
    for p, remainders in rows.collect():
        inverse = pow(product % p, -1, p)
        value = [v + product * ((r - v) * inverse % p) for v, r in zip(value, remainders, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


def roots_above(polynomial: list[int], t: int) -> int:
    """How many roots of a polynomial with only real roots are greater than t: the sign changes of p(x + t)."""
    c = list(polynomial)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def value_at(polynomial: list[int], t: int) -> int:
    value = 0
    for c in reversed(polynomial):
        value = value * t + c
    return value


def greatest_roots(polynomial: list[int], count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(numerator, shift) of the `count` greatest positive roots of a monic polynomial with only real roots, repeated ones included.

    Each is isolated in an interval of width 2**-shift, whose middle numerator / 2**(shift + 1) is returned.
    """
    d = len(polynomial) - 1
    top = 1
    while roots_above(polynomial, top):
        top *= 2
    shift = max(8, bits - top.bit_length())
    scaled = [c << (shift * (d - k)) for k, c in enumerate(polynomial)]  # roots times 2**shift
    out: list[tuple[int, int]] = []
    for k in range(min(count, d)):
        if roots_above(scaled, 0) <= k:
            break
        low, high, alone = 0, top << shift, False  # more than k roots above low, at most k above high
        while high - low > 1:
            mid = (low + high) // 2
            if alone:  # one root in between: the sign tells on which side of it mid is
                above = (value_at(scaled, mid) > 0) if k % 2 else (value_at(scaled, mid) < 0)
                low, high = (mid, high) if above else (low, mid)
                continue
            above = roots_above(scaled, mid)
            low, high = (mid, high) if above > k else (low, mid)
            alone = (above == k + 1 if above > k else alone) and roots_above(scaled, high) == k
        out.append((2 * low + 1, shift))
    return out


def _eliminated(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU form of a matrix of Decimals, with the rows' order."""
    a, d = a.copy(), len(a)
    order = list(range(d))
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        a[[k, i]] = a[[i, k]]
        order[k], order[i] = order[i], order[k]
        if not a[k, k]:
            a[k, k] = Decimal(10) ** -(DIGITS - 5)
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x, d = b[order].copy(), len(b)
    for k in range(d):
        x[k] -= lu[k, :k] @ x[:k] if k else 0
    for k in reversed(range(d)):
        x[k] = (x[k] - (lu[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) / lu[k, k]
    return x


def null_vectors(m: list[list[int]], roots: list[tuple[int, int]]) -> tuple[np.ndarray, list[Decimal]]:
    """Unit eigenvectors (rows) and eigenvalues for the roots, greatest first, by inverse iteration in DIGITS decimal digits.

    Vectors of roots that are equal span that root's null space: each is made orthogonal to those before it. The entry of
    greatest size is positive.
    """
    d = len(m)
    with localcontext() as c:
        c.prec = DIGITS
        exact = np.array([[Decimal(v) for v in row] for row in m], object)
        values = [Decimal(a) / Decimal(1 << (s + 1)) for a, s in roots]
        found: list[np.ndarray] = []
        scale = values[0] if values else Decimal(1)
        for k, value in enumerate(values):
            lu, order = _eliminated(exact - np.array([[value if i == j else Decimal(0) for j in range(d)] for i in range(d)], object))
            same = [v for v, other in zip(found, values, strict=False) if abs(other - value) <= scale * Decimal(2) ** -(BITS - 16)]
            best = None
            for start in range(d):
                x = np.array([Decimal(1 if (i + start) % d == 0 else 0) + Decimal((i * 7 + start + k) % 11) / 97 for i in range(d)], object)
                for _ in range(3):
                    for v in same:
                        x = x - (x @ v) * v
                    x = _solved(lu, order, x / (x @ x).sqrt())
                    x = x / (x @ x).sqrt()
                for v in same:
                    x = x - (x @ v) * v
                length = (x @ x).sqrt()
                if length > Decimal("1e-20"):
                    best = x / length
                    break
            sign = 1 if best[max(range(d), key=lambda i: (abs(best[i]), -i))] > 0 else -1
            found.append(best * sign)
        return np.array([[float(v) for v in x] for x in found]).reshape(len(found), d), values


def _centred(m: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, as longs where these hold it, else as Python's integers."""
    most = max(int(m.max(initial=0)), -int(m.min(initial=0)), 1)
    if n * most + max(map(abs, s), default=0) < 1 << 62:
        return m * n - np.array(s, np.int64)
    return m.astype(object) * n - np.array(s, object)


def _deviation(c: np.ndarray) -> pa.Array:
    """Sums of squares of rows; null where a long does not hold the sum."""
    most = max(int(c.max(initial=0)), -int(c.min(initial=0)), 1)
    if c.dtype == np.int64 and most * most * max(1, c.shape[1]) < 1 << 62:
        return pa.array((c * c).sum(1), pa.int64())
    return pa.array([v if v < 1 << 63 else None for v in (sum(int(x) * int(x) for x in row) for row in c)], pa.int64())


def _doubles(c: np.ndarray) -> np.ndarray:
    return c.astype(np.float64)


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Entries c become x = floor(256 c). The fit is over each distinct x once: n vectors with sums S. Components are those of
    the greatest eigenvalues of the covariance (divisor n), numbered from 1; at most `components` and at most those whose
    eigenvalue is positive, since others cannot be scaled: a table with one distinct vector, or none, gives no rows. Of equal
    eigenvalues the vectors are some orthonormal basis, the same for all rows. deviation is null where a long cannot hold it.

    Vectors that integer_vectors() drops, and those of another length than the most frequent (of equally frequent lengths
    the greatest), give no rows. Rows with a null or repeated id are rows like others. Repeated rows count once in the fit
    and come out each. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = integer_vectors(df, id, vector)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not length:
        return spark.createDataFrame([], _ROWS)
    d = length[0]
    rows = rows.where(F.size("x") == d)
    fit = materialise(rows.select("x").distinct())
    n, s, m = scatter(fit, d)
    trace = sum(m[i][i] for i in range(d))
    if not trace:
        return spark.createDataFrame([], _ROWS)
    vectors, values = null_vectors(m, greatest_roots(characteristic_polynomial(spark, m), components))
    # (x - S / n) v / sqrt(e), where e is the root over n * n
    basis = vectors.T / np.array([float(v.sqrt()) for v in values])[None, :]
    explained = [float(v / trace) for v in values]
    k = len(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                y = np.concatenate([_doubles(_centred(matrix_of(batch.column("x")), n, s)) @ basis, np.ones((batch.num_rows, 1))], axis=1)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "value"])

    sums = dict(fit.mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect())
    moment = np.array([sums[c] for c in range((k + 1) ** 2)]).reshape(k + 1, k + 1) / n
    error = float(np.abs(moment[:k, :k] - np.outer(moment[k, :k], moment[k, :k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _centred(matrix_of(batch.column("x")), n, s) if batch.num_rows else np.zeros((0, d), np.int64)
            y, at = _doubles(c) @ basis, pa.array(np.repeat(np.arange(len(c)), k))
            own = [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), len(c)), pa.int32()), pa.array(np.full(len(c) * k, n), pa.int64()), _deviation(c).take(at), pa.array(y.ravel()), pa.array(np.tile(explained, len(c)), pa.float64()), pa.array(np.full(len(c) * k, error))]
            yield pa.RecordBatch.from_arrays(own, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, _ROWS)
