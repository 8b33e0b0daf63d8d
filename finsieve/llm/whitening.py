"""Whitening of embeddings through the exact characteristic polynomial of their integer scatter matrix.

Entries are put on an integer grid, ``floor(SCALE * entry) + SHIFT``. Over the distinct grid vectors Spark sums entries and
products exactly (20-bit limbs, so float products never round). From there all is exact or of chosen precision:

* scatter M = n * sum(x x') - S S', an integer matrix; the covariance is M / n**2;
* its characteristic polynomial modulo many primes, each by reduction to Hessenberg form, dealt to tasks by prime, joined by
  Chinese remaindering under a bound on the coefficients;
* all roots are real, so the sign changes of the polynomial moved by t count the roots above t exactly, multiple ones
  included: bisection isolates the largest roots and narrows them to 2**-_FINE of an integer eigenvalue;
* eigenvectors by inverse iteration on M minus the root in fixed point, with full pivoting; a multiple root gets as many vectors,
  made orthonormal. The entry of largest size is positive.

Work on the driver depends on the number of dimensions alone. Only sums, residues, and 16 x 16 moments reach it; executors get
the component matrix. Rows are read three times and shuffled once, for the distinct vectors, in 1 to 8 bytes an entry.

Rows whose vector is missing, empty, or holds missing or non-finite entries are dropped, and so are rows of another length than the most
frequent one (of ties the longest). Entries beyond 2**62 on the grid count as 2**62. Ids may be missing or repeated; each row is
answered. Components with no variance are not returned, so one distinct vector or none gives no rows. A deviation beyond a long
is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.session import materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
_LIMIT = 1 << 62
_LIMB = 20
_ROWS = 1 << 12
_FINE = 160
_SPARE = 256


# --- the grid -----------------------------------------------------------------------------------------------------------

def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Grid values without the shift, rows x size; rows with other lengths or entries that do not count must be gone."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.clip(np.floor(SCALE * values), -_LIMIT, _LIMIT).astype(np.int64)


def _pack(grid: np.ndarray) -> pa.Array:
    """Rows as bytes, each in the smallest of four widths that holds it, named by its first byte."""
    top = np.abs(grid).max(axis=1)
    out: list[bytes | None] = [None] * len(grid)
    for width, kind in ((1, "<i1"), (2, "<i2"), (4, "<i4"), (8, "<i8")):
        rows = np.flatnonzero((top < 1 << (8 * width - 1)) & ((top >= 1 << (4 * width - 1)) if width > 1 else True))
        data, step, name = grid[rows].astype(kind).tobytes(), grid.shape[1] * width, bytes([width])
        for k, r in enumerate(rows.tolist()):
            out[r] = name + data[k * step:(k + 1) * step]
    return pa.array(out, pa.binary())


def _unpack(column: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(column), size), np.int64)
    cells = column.to_pylist()
    widths = np.array([c[0] for c in cells], np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        data = b"".join(cells[r][1:] for r in rows.tolist())
        out[rows] = np.frombuffer(data, f"<i{width}").reshape(len(rows), size)
    return out


def _usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that count, lengths aside."""
    cells = F.col("vector")
    return rows.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        cells.isNotNull() & (F.size(cells) > 0) & F.forall(cells, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    )


# --- exact moments ------------------------------------------------------------------------------------------------------

def _limbs(value: int) -> list[int]:
    """Signed base-2**40 digits of an integer, lowest first, in six places."""
    out = []
    for _ in range(5):
        digit = value & ((1 << 40) - 1)
        out.append(digit)
        value = (value - digit) >> 40
    return [*out, value]


def _value(digits: list[int]) -> int:
    return sum(int(d) << (40 * k) for k, d in enumerate(digits))


def _split(grid: np.ndarray) -> list[np.ndarray]:
    """Parts of 20 bits with grid = sum(part * 2**(20 k)), as floats."""
    parts, rest = [], grid
    while True:
        if np.abs(rest).max(initial=0) < 1 << _LIMB:
            return [*parts, rest.astype(np.float64)]
        low = rest & ((1 << _LIMB) - 1)
        parts.append(low.astype(np.float64))
        rest = (rest - low) >> _LIMB


def products(grid: np.ndarray) -> np.ndarray:
    """sum(x x') as an object matrix of Python integers. A block's products stay below 2**52, so its float sums are exact."""
    total = np.zeros((grid.shape[1], grid.shape[1]), object)
    for lo in range(0, len(grid), _ROWS):
        parts = _split(grid[lo:lo + _ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return total


def moments(distinct: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, sum of products) of the packed vectors, exact; one partial matrix per task moves."""
    cells = [(i, j) for i in range(size) for j in range(i, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(size, object), np.zeros((size, size), object)
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                grid = _unpack(b.column("grid").slice(lo, _ROWS), size)
                n += len(grid)
                sums += sum(part.sum(axis=0).astype(np.int64).astype(object) << (_LIMB * k) for k, part in enumerate(_split(grid)))
                total += products(grid)
        if n == 0:
            return
        values = [n, *sums.tolist(), *(total[i, j] for i, j in cells)]
        digits = list(zip(*(_limbs(int(v)) for v in values), strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int64()), *(pa.array(d, pa.int64()) for d in digits)], names=["cell", *(f"d{k}" for k in range(6))]
        )

    summed = distinct.mapInArrow(run, "cell long, " + ", ".join(f"d{k} long" for k in range(6))).groupBy("cell").agg(
        *(F.sum(f"d{k}").alias(f"d{k}") for k in range(6))
    ).toArrow().to_pylist()
    values = {r["cell"]: _value([r[f"d{k}"] for k in range(6)]) for r in summed}
    if not values:
        return 0, [0] * size, np.zeros((size, size), object)
    total = np.zeros((size, size), object)
    for k, (i, j) in enumerate(cells):
        total[i, j] = total[j, i] = values[1 + size + k]
    return values[0], [values[1 + i] for i in range(size)], total


# --- characteristic polynomial ------------------------------------------------------------------------------------------

def _is_prime(n: int) -> bool:
    """Miller-Rabin; the bases decide every number below 2**32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2**31 whose product exceeds ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def hessenberg(matrices: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Upper Hessenberg forms, similar to ``matrices`` (primes x d x d) modulo their primes."""
    a = matrices.copy()
    many, d, _ = a.shape
    every, m3, m2 = np.arange(many), p[:, None, None], p[:, None]
    for m in range(1, d - 1):
        pivot = m + (a[:, m:, m - 1] != 0).argmax(axis=1)
        a[every, pivot], a[every, m] = a[every, m].copy(), a[every, pivot].copy()
        a[every, :, pivot], a[every, :, m] = a[every, :, m].copy(), a[every, :, pivot].copy()
        head = a[:, m, m - 1]
        inverse = np.array([pow(int(h), -1, int(q)) if h else 0 for h, q in zip(head, p, strict=True)], np.int64)
        factor = a[:, m + 1:, m - 1] * inverse[:, None] % m2
        a[:, m + 1:, :] = (a[:, m + 1:, :] - factor[:, :, None] * a[:, m, None, :] % m3) % m3
        a[:, :, m] = (a[:, :, m] + (a[:, :, m + 1:] * factor[:, None, :] % m3).sum(axis=2)) % m2
    return a


def hessenberg_polynomial(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - a), lowest first, modulo the primes (primes x d+1)."""
    many, d, _ = a.shape
    m2 = p[:, None]
    done = np.zeros((d + 1, many, d + 1), np.int64)
    done[0, :, 0] = 1
    for k in range(d):
        new = np.zeros((many, d + 1), np.int64)
        new[:, 1:] = done[k][:, :-1]
        new = (new - a[:, k, k, None] * done[k] % m2) % m2
        below = np.ones(many, np.int64)
        for i in range(k - 1, -1, -1):
            below = below * a[:, i + 1, i] % p
            new = (new - (a[:, i, k] * below % p)[:, None] * done[i] % m2) % m2
        done[k + 1] = new
    return done[d]


def _residues(matrix: list[list[int]], chosen: list[int]) -> np.ndarray:
    p = np.array(chosen, np.int64)
    reduced = np.array([[[v % q for v in row] for row in matrix] for q in chosen], np.int64)
    return hessenberg_polynomial(hessenberg(reduced, p), p)


def remaindered(residues: np.ndarray, p: list[int]) -> list[int]:
    """The integers of least size with these residues (primes x values)."""
    product = 1
    for q in p:
        product *= q
    parts = [product // q for q in p]
    weights = [part * pow(part % q, -1, q) for part, q in zip(parts, p, strict=True)]
    out = []
    for column in residues.T.tolist():
        value = sum(w * r for w, r in zip(weights, column, strict=True)) % product
        out.append(value - product if 2 * value > product else value)
    return out


def characteristic_polynomial(spark, matrix: np.ndarray, per_task: int = 16) -> list[int]:
    """Coefficients of det(x - M), lowest first, for a symmetric integer matrix without negative eigenvalues.

    By Maclaurin's inequality a coefficient is at most C(d, k) * (trace / d)**k in size.
    """
    rows = [[int(v) for v in row] for row in matrix]
    d = len(rows)
    mean = sum(rows[i][i] for i in range(d)) // d + 1
    chosen = primes_beyond(2 * max(comb(d, k) * mean**k for k in range(d + 1)))
    groups = [chosen[k:k + per_task] for k in range(0, len(chosen), per_task)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for primes in b.column("primes").to_pylist():
                found = _residues(rows, primes)
                yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["prime", "residues"])

    dealt = spark.createDataFrame([(g,) for g in groups], "primes array<long>").repartition(len(groups))
    got = dealt.mapInArrow(run, "prime long, residues array<long>").toArrow().to_pylist()
    by_prime = {r["prime"]: r["residues"] for r in got}
    return remaindered(np.array([by_prime[q] for q in chosen], dtype=np.int64), chosen)


# --- roots --------------------------------------------------------------------------------------------------------------

def roots_above(coefficients: list[int], t: int) -> int:
    """How many roots exceed ``t``: sign changes of the polynomial moved by t, exact as all roots are real."""
    c = list(reversed(coefficients))
    for last in range(len(c), 1, -1):
        for k in range(1, last):
            c[k] += t * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def _value_at(coefficients: list[int], t: int) -> int:
    out = 0
    for c in reversed(coefficients):
        out = out * t + c
    return out


def largest_roots(coefficients: list[int], count: int) -> list[tuple[int, int]]:
    """(root * 2**_FINE rounded down, multiplicity) of the largest positive roots, at least ``count`` of them if there are.

    Two roots closer than 2**-_FINE count as one multiple root.
    """
    zeros = next(k for k, c in enumerate(coefficients) if c)
    c = coefficients[zeros:]
    d = len(c) - 1
    if d == 0:
        return []
    c = [v << (_FINE * (d - k)) for k, v in enumerate(c)]
    top = 1
    while top <= -c[d - 1]:
        top *= 2
    out, todo = [], [(0, top, d, 0)]
    while todo and sum(m for _, m in out) < count:
        low, high, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if inside == 0:
            continue
        if inside == 1:
            # right of the root the polynomial has the sign of an even or odd number of roots above
            while high - low > 1:
                middle = (low + high) // 2
                v = _value_at(c, middle)
                if v == 0:
                    high = middle
                    break
                low, high = (low, middle) if (v > 0) == (above_high % 2 == 0) else (middle, high)
            out.append((high, 1))
        elif high - low == 1:
            out.append((high, inside))
        else:
            middle = (low + high) // 2
            n = roots_above(c, middle)
            todo += [(low, middle, above_low, n), (middle, high, n, above_high)]
    return out


# --- vectors ------------------------------------------------------------------------------------------------------------

def _factor(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LU with full pivoting in fixed point (in place); (factors, row order, column order)."""
    d = len(a)
    rows, columns = np.arange(d), np.arange(d)
    for k in range(d):
        flat = int(np.abs(a[k:, k:]).argmax())
        i, j = k + flat // (d - k), k + flat % (d - k)
        a[[k, i]], rows[[k, i]] = a[[i, k]], rows[[i, k]]
        a[:, [k, j]], columns[[k, j]] = a[:, [j, k]], columns[[j, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            a[k + 1:, k] = (a[k + 1:, k] << bits) // a[k, k]
            a[k + 1:, k + 1:] -= (a[k + 1:, k, None] * a[None, k, k + 1:]) >> bits
    return a, rows, columns


def _solve(lu: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray, bits: int) -> np.ndarray:
    a, rows, columns = lu
    y = b[rows].copy()
    for k in range(len(y)):
        y[k + 1:] -= (a[k + 1:, k] * y[k]) >> bits
    for k in range(len(y) - 1, -1, -1):
        y[k] = (y[k] << bits) // a[k, k]
        y[:k] -= (a[:k, k] * y[k]) >> bits
    out = np.zeros(len(y), object)
    out[columns] = y
    return out


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    size = isqrt(int((v * v).sum()))
    return (v << bits) // size


def null_vectors(matrix: np.ndarray, root: int, multiplicity: int) -> list[np.ndarray]:
    """Orthonormal vectors of M for a root given times 2**_FINE, by inverse iteration in fixed point."""
    d = len(matrix)
    bits = _FINE + _SPARE
    moved = matrix.astype(object) << bits
    moved[np.arange(d), np.arange(d)] -= root << _SPARE
    lu = _factor(moved, bits)
    rng = np.random.default_rng(13)
    found = [_unit(np.array([int(x) for x in rng.integers(1, 1 << 30, d)], object), bits) for _ in range(multiplicity)]
    for _ in range(3):
        for k in range(multiplicity):
            v = _unit(_solve(lu, found[k], bits), bits)
            for _twice in range(2):
                for other in found[:k]:
                    v = v - ((other * (int((v * other).sum()) >> bits)) >> bits)
                v = _unit(v, bits)
            found[k] = v
    out = []
    for v in found:
        x = np.array([float(t) for t in (int(t) / (1 << bits) for t in v)])
        out.append(-x if x[np.abs(x).argmax()] < 0 else x)
    return out


def components(spark, matrix: np.ndarray, count: int) -> tuple[list[float], np.ndarray]:
    """(eigenvalues of the integer matrix by size, their unit vectors as rows), at most ``count``, only positive ones."""
    if len(matrix) == 0 or not any(matrix[i, i] for i in range(len(matrix))):
        return [], np.zeros((0, len(matrix)))
    values, vectors = [], []
    for root, multiplicity in largest_roots(characteristic_polynomial(spark, matrix), count):
        found = null_vectors(matrix, root, multiplicity)
        values += [root / (1 << _FINE)] * multiplicity
        vectors += found
    return values[:count], np.array(vectors[:count])


# --- whole job ----------------------------------------------------------------------------------------------------------

def _scores(grid: np.ndarray, n: int, sums: list[int], basis: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """(whitened rows x components, exact deviations)."""
    largest = n * int(np.abs(grid).max(initial=0)) + max(map(abs, sums), default=0)
    if largest * largest * grid.shape[1] < 1 << 63:
        centred = n * grid - np.array(sums, np.int64)
        deviation = (centred * centred).sum(axis=1).tolist()
        shifted = centred / n
    else:
        exact = grid.astype(object) * n - np.array(sums, object)
        deviation = [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1).tolist()]
        shifted = np.array([[v / n for v in row] for row in exact.tolist()])
    return shifted @ basis.T / spread, deviation


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component."""
    spark = rows.sparkSession
    kind = f"vec_id {dict(rows.dtypes)[id_column]}"
    result = f"{kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = _usable(rows, id_column, vector)
    lengths = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return spark.createDataFrame([], result)
    size = lengths["size"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), _pack(_matrix(b.column("vector"), size))], names=["vec_id", "grid"])

    grid = materialize(usable.filter(F.size("vector") == size).mapInArrow(packed, f"{kind}, grid binary"), "whitening-grid")
    distinct = materialize(grid.select("grid").distinct(), "whitening-distinct")
    n, sums, total = moments(distinct, size)
    s = np.array(sums, object)
    values, basis = components(spark, total * n - s[:, None] * s[None, :], count)
    if not values:
        return spark.createDataFrame([], result)
    trace = sum(int(total[i, i]) * n - sums[i] * sums[i] for i in range(size))
    spread = np.array([sqrt(v) / n for v in values])
    explained = [v / trace for v in values]
    wide = len(values)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moment = np.zeros((wide, wide))
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                z, _ = _scores(_unpack(b.column("grid").slice(lo, _ROWS), size), n, sums, basis, spread)
                moment += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(wide * wide), pa.int32()), pa.array(moment.ravel())], names=["cell", "value"])

    seen = distinct.mapInArrow(outer, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow().to_pylist()
    covariance = np.zeros(wide * wide)
    for r in seen:
        covariance[r["cell"]] = r["value"] / n
    error = float(np.abs(covariance.reshape(wide, wide) - np.eye(wide)).max())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                z, deviation = _scores(_unpack(part.column("grid"), size), n, sums, basis, spread)
                rows_of = np.repeat(np.arange(part.num_rows), wide)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), part.num_rows)),
                     pa.array(np.full(len(rows_of), n)), pa.array(deviation, pa.int64()).take(pa.array(rows_of)), pa.array(z.ravel()),
                     pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(len(rows_of), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return grid.mapInArrow(answer, result)
