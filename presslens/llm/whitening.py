"""Whitening by exact arithmetic: characteristic polynomial, isolated roots, null-space iteration.

Every entry ``c`` of a vector becomes the whole number ``x = floor(64 c) + 1000000``. Tasks sum
``x`` and its products as whole numbers, so the scatter ``n * sum(x x') - S S'`` (n squared times the
covariance) is exact. Its characteristic polynomial is found modulo many primes, one Spark
row each, by reduction to Hessenberg form, and put together by Chinese remainders. All roots
are real, so the changes of sign in the polynomial shifted to a point count the roots above
it; halving isolates every root and then narrows it to far more digits than a double has.
A component is the null vector of the scatter less its root, by inverse iteration in
fixed-point numbers of ``BITS`` bits, again one Spark row each.

Only sums over dimensions (their square, whatever the rows) reach the driver; ``DIMENSIONS``
is refused beyond. Dropped: null vectors, null or non-finite entries, and vectors of another length
than the commonest (of equally common ones the longest). ``x`` outside a long is its nearest long. Components with
eigenvalue 0 don't exist, so constant or too few vectors give fewer components or no row.
Equal eigenvalues get orthogonal components in a fixed order. Repeated rows count as often
as they occur, null ids are kept. ``deviation`` is null where a long can't hold it.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SCALE, SHIFT = 64, 1_000_000
DIMENSIONS = 1024
BITS = 320
LIMB = 60
ROWS_AT_ONCE = 4096
LONG = 2**63


# ---- whole-number vectors ----


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows with a whole vector of the commonest length, and that length (0 without a row)."""
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fine)
    common = kept.groupBy(F.size(vector).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if common is None:
        return kept, 0
    if common["d"] > DIMENSIONS:
        raise ValueError(f"vectors of {common['d']} entries; at most {DIMENSIONS} are whitened")
    return kept.where(F.size(vector) == common["d"]), common["d"]


def whole(vectors: pa.Array, d: int) -> np.ndarray:
    """``x - SHIFT`` row by row: 64-bit numbers, or Python's where they could be larger."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
    if not len(x) or np.abs(x).max() < 2**62:
        return x.astype(np.int64)
    top, low = LONG - 1 - SHIFT, -LONG - SHIFT
    exact = [top if c >= 2**63 else low if c <= -(2**63) else min(max(int(c), low), top) for c in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(-1, d)


def products(x: np.ndarray) -> np.ndarray:
    """``x' x`` as Python numbers, exact."""
    top = int(np.abs(x).max()) if len(x) else 0
    if len(x) * top * top < 2**53:
        wide = x.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    if len(x) * top * top < 2**62:
        return (x.T @ x).astype(object)
    wide = x.astype(object)
    return wide.T @ wide


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, part.column(column)


def scatter(rows: DataFrame, vector: str, d: int) -> tuple[int, list[int], list[list[int]]]:
    """``(n, sums, n * sum(x x') - S S')`` of the vectors less ``SHIFT``, exact."""
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(d, object), np.zeros((d, d), object)
        for _, part in _slices(batches, 0):
            x = whole(part, d)
            n += len(x)
            sums += x.astype(object).sum(axis=0)
            squares += products(x)
        if not n:
            return
        values = [n, *sums.tolist(), *[squares[i, j] for i, j in upper]]
        # two parts each, so that no sum over tasks outgrows a decimal
        columns = [range(len(values)), [int(v) >> LIMB for v in values], [int(v) & (2**LIMB - 1) for v in values]]
        kinds = [pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([*c], pa.int64()).cast(k) if k == pa.int32() else _decimals(c) for c, k in zip(columns, kinds)], ["place", "high", "low"])

    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(run, "place int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # d * d / 2 rows
    total = {r.place: (int(r.high) << LIMB) + int(r.low) for r in found}
    if not total:
        return 0, [], []
    n, sums = total[0], [total[1 + i] for i in range(d)]
    out = [[0] * d for _ in range(d)]
    for k, (i, j) in enumerate(upper, 1 + d):
        out[i][j] = out[j][i] = n * total[k] - sums[i] * sums[j]
    return n, sums, out


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


# ---- the characteristic polynomial ----


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3 * 10**9."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return n == base
    return True


def primes_over(product: int) -> list[int]:
    """Primes below 2**31 from the greatest down until their product passes ``product``."""
    out, reach, n = [], 1, 2**31 - 1
    while reach <= product:
        if _is_prime(n):
            out.append(n)
            reach *= n
        n -= 2
    return out


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """The characteristic polynomial modulo ``p``, highest power first, by Hessenberg reduction."""
    d = len(matrix)
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    for k in range(d - 2):
        nonzero = np.flatnonzero(a[k + 1 :, k])
        if not len(nonzero):
            continue
        pivot = k + 1 + int(nonzero[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        ratio = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - ratio[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * ratio % p).sum(axis=1)) % p
    # row k of `found`: the polynomial of the leading k x k block, lowest power first
    found = np.zeros((d + 1, d + 2), np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):
        found[k, 1:] = found[k - 1, :-1]
        chain, factors = 1, np.empty(k, np.int64)
        for i in range(k - 1, -1, -1):
            factors[i] = int(a[i, k - 1]) * chain % p
            chain = chain * int(a[i, i - 1]) % p if i else 0
        found[k] = (found[k] - (factors[:, None] * found[:k] % p).sum(axis=0)) % p
    return found[d, d::-1].tolist()


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The exact characteristic polynomial of a positive semidefinite matrix, highest power first."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # roots are not negative, so a coefficient is at most that of d roots of trace / d
    bound = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes = primes_over(bound)
    shared = spark.sparkContext.broadcast(matrix)  # d * d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([polynomial_mod(shared.value, p) for p in kept], pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(_tasks(spark, len(primes)))
    residues = rows.mapInArrow(run, "p long, c array<bigint>").collect()  # d + 1 numbers a prime
    values, modulus = [0] * (d + 1), 1
    for p, found in sorted(residues):
        inverse = pow(modulus, -1, p)
        for k in range(d + 1):
            part = found[k] if k % 2 == 0 else -found[k]  # signs alternate
            values[k] += modulus * ((part - values[k]) * inverse % p)
        modulus *= p
    return [v if k % 2 == 0 else -v for k, v in enumerate(values)]


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(1, min(rows, spark.sparkContext.defaultParallelism))


# ---- roots ----


def sign_changes(values: list[int]) -> int:
    signs = [v > 0 for v in values if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def roots_above(poly: list[int], place: int) -> int:
    """How many roots of a polynomial with real roots only lie above ``place``, counted by Descartes' rule, equal ones separately."""
    c = list(poly)
    for end in range(len(c) - 1, 0, -1):
        for j in range(end):
            c[j + 1] += place * c[j]
    return sign_changes(c)


def _value(poly: list[int], place: int) -> int:
    out = 0
    for c in poly:
        out = out * place + c
    return out


def top_roots(poly: list[int], trace: int, wanted: int) -> tuple[list[tuple[int, int]], int]:
    """``([(y, times)], s)``: the greatest positive roots ``y / 2**s``, falling, at most ``wanted`` in all.

    ``y`` is rounded up to a whole number; roots that share one are taken as equal. The grid is made
    finer until the least root kept has 64 significant bits.
    """
    d = len(poly) - 1
    wanted = min(wanted, sign_changes(poly))
    bits = 160
    while wanted:
        s = max(0, bits - trace.bit_length())
        grid = [c << (s * j) for j, c in enumerate(poly)]
        top = trace << s
        found: list[tuple[int, int]] = []
        # (low, high] with the roots above each end; the upper half is looked at first
        todo = [(0, top, sign_changes(grid), 0)]
        while todo and sum(n for _, n in found) < wanted:
            low, high, above_low, above_high = todo.pop()
            times = above_low - above_high
            if not times:
                continue
            if high - low == 1:
                found.append((high, times))
            elif times == 1:
                found.append((_narrowed(grid, low, high, above_high), 1))
            else:
                middle = (low + high) // 2
                above = roots_above(grid, middle)
                todo.append((low, middle, above_low, above))
                todo.append((middle, high, above, above_high))
        if found[-1][0].bit_length() > 64 or bits > 64 * 160:
            return found, s
        bits *= 2
    return [], 0


def _narrowed(poly: list[int], low: int, high: int, above: int) -> int:
    """The single root in (low, high], rounded up. Beyond ``high`` lie ``above`` roots, which fix the sign."""
    sign = -1 if above % 2 else 1
    while high - low > 1:
        middle = (low + high) // 2
        if _value(poly, middle) * sign >= 0:
            high = middle
        else:
            low = middle
    return high


# ---- components ----


def null_vectors(matrix: list[list[int]], y: int, s: int, times: int, seed: int) -> list[list[float]]:
    """``times`` orthogonal unit vectors that ``matrix - y / 2**s`` sends to (nearly) nothing."""
    d = len(matrix)
    size = max(max(abs(v) for v in row) for row in matrix).bit_length() + s
    up = max(0, BITS - size)
    a = np.array([[v << (s + up) for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= y << up
    one = size + up  # the point of the fixed-point numbers
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            ratio = (a[k + 1 :, k] << one) // a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(ratio, a[k, k + 1 :]) >> one
            a[k + 1 :, k] = ratio
    rng, out = random.Random(seed), []
    for _ in range(times):
        v = np.array([rng.getrandbits(one) - (1 << (one - 1)) for _ in range(d)], object)
        for _ in range(3):
            v = _without(_solved(a, v[order], one), out, one)
        out.append(v)
    return [[int(x) / length for x in v] for v in out if (length := math.isqrt(sum(int(x) ** 2 for x in v)))]


def _solved(a: np.ndarray, b: np.ndarray, one: int) -> np.ndarray:
    d = len(b)
    x = b.copy()
    for i in range(1, d):
        x[i] -= int(np.dot(a[i, :i], x[:i])) >> one
    for i in range(d - 1, -1, -1):
        rest = x[i] - (int(np.dot(a[i, i + 1 :], x[i + 1 :])) >> one if i + 1 < d else 0)
        x[i] = (rest << one) // a[i, i]
    return _scaled(x, one)


def _scaled(v: np.ndarray, one: int) -> np.ndarray:
    top = max(abs(x) for x in v)
    return (v << one) // top if top else v


def _without(v: np.ndarray, others: list[np.ndarray], one: int) -> np.ndarray:
    """``v`` less its parts along the others."""
    for u in others:
        v = v - u * int(np.dot(u, v)) // int(np.dot(u, u))
    return _scaled(v, one)


def components(spark: SparkSession, matrix: list[list[int]], roots: list[tuple[int, int]], s: int) -> list[list[float]]:
    """Unit vectors of the roots, in their order."""
    shared = spark.sparkContext.broadcast(matrix)  # d * d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, y, times in zip(*(c.to_pylist() for c in batch.columns)):
                found = null_vectors(shared.value, int(y), s, times, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * times, pa.int32()), pa.array(range(times), pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["k", "i", "v"]
                )

    rows = spark.createDataFrame([(k, str(y), n) for k, (y, n) in enumerate(roots)], "k int, y string, times int")
    found = rows.repartition(_tasks(spark, len(roots))).mapInArrow(run, "k int, i int, v array<double>").collect()
    return [r.v for r in sorted(found, key=lambda r: (r.k, r.i))]


# ---- whitening ----


class Whitening:
    """What the fit found: n, sums (less ``SHIFT`` a row), eigenvalues, their shares, unit components."""

    def __init__(self, n: int, sums: list[int], values: list[float], shares: list[float], vectors: list[list[float]]):
        self.n, self.sums, self.values, self.shares = n, sums, values, shares
        self.vectors = np.array(vectors, np.float64).reshape(len(values), len(sums))
        self.mean = np.array([Fraction(v, n) for v in sums], np.float64) if n else np.zeros(len(sums))
        self.scaled = (self.vectors / np.sqrt(np.array(values))[:, None]).T if values else self.vectors.T

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n x - S) ** 2`` of every row; None beyond a long."""
        top = int(np.abs(x).max()) if len(x) else 0
        reach = self.n * top + max(map(abs, self.sums), default=0)
        if len(self.sums) * reach * reach < LONG:
            gap = self.n * x.astype(np.int64) - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        gap = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < LONG else None for v in (gap * gap).sum(axis=1).tolist()]


def fit(df: DataFrame, vector: str = "embedding", wanted: int = 32) -> tuple[Whitening, DataFrame]:
    """The whitening of all usable rows, and these rows."""
    spark = df.sparkSession
    rows, d = usable(df, vector)
    n, sums, matrix = scatter(rows, vector, d) if d else (0, [], [])
    trace = sum(matrix[i][i] for i in range(d)) if n else 0
    if not trace:
        return Whitening(n, sums, [], [], []), rows
    roots, s = top_roots(polynomial(spark, matrix), trace, wanted)
    vectors = components(spark, matrix, roots, s)[:wanted]
    listed = [y for y, times in roots for _ in range(times)][:wanted]
    values = [float(Fraction(y, n * n << s)) for y in listed]
    shares = [float(Fraction(y, trace << s)) for y in listed]
    return Whitening(n, sums, values, shares, vectors), rows


def identity_error(model: Whitening, rows: DataFrame, vector: str) -> float:
    """Greatest absolute entry of the whitened rows' covariance less the identity; their mean is 0 by construction."""
    k, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, part in _slices(batches, 0):
            w = model.whitened(whole(part, d))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["place", "v"])

    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(run, "place int, v double")
    found = parts.groupBy("place").agg(F.sum("v").alias("v")).collect()  # wanted * wanted rows
    return max((abs(r.v / model.n - (r.place // k == r.place % k)) for r in found), default=0.0)


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", wanted: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for usable rows and components."""
    model, rows = fit(df, vector, wanted)
    k, d = len(model.values), len(model.sums)
    id_type = df.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(model, rows, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _slices(batches, 1):
            x = whole(part, d)
            each = np.repeat(np.arange(len(x)), k)
            ids = batch.column(0).take(pa.array(each))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(each))
            constants = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(each), model.n)]
            columns = [
                ids, pa.array(constants[0]), pa.array(constants[1], pa.int64()), deviation, pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.shares, len(x))), pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)
