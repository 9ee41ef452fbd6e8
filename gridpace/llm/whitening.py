"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Components become integers, so the scatter n * sum(x x') - S S', n * n times the covariance, is exact. Its characteristic
polynomial is computed modulo many primes, in tasks, by reduction to Hessenberg form, and put together by Chinese remaindering.
All its roots are real, so the sign changes of the shifted polynomial count the roots above a point: bisection
isolates the largest ones to PRECISION bits. A component is the null-space vector of the
scatter less its root, by inverse iteration in fixed-point integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm.common import query, save, table
from gridpace.llm.vectors import EXACT_FLOAT, LARGEST, batched, finite_rows, floors

# Scale, offset and components of the contract.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
MOST_DIM = 512  # the polynomial takes dim**3 steps for each prime, the digits of its roots dim**2 more
PRECISION = 140  # bits of a root
ROWS = 4096  # rows of a batch


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, y): rows whose vector is there and has finite entries only, as floor(SCALE * entry)."""
    def convert(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, size, values = finite_rows(b.column(1))
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(floors(values, SCALE)))], ["vec_id", "size", "y"])
    v = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    return v.mapInArrow(batched(convert, ROWS), "vec_id bigint, size int, y array<bigint>")


def padded(b: pa.RecordBatch, dim: int) -> np.ndarray:
    """Vectors of a batch as rows; a missing component is an entry 0."""
    flat, size = b.column("y").flatten().to_numpy(), b.column("size").to_numpy()
    if flat.size == dim * b.num_rows:
        return flat.reshape(b.num_rows, dim)
    out = np.zeros((b.num_rows, dim), np.int64)
    out[np.repeat(np.arange(b.num_rows), size), np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def moments(rows: DataFrame, dim: int, largest: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of all vectors, exact: tasks fold their rows, Spark adds the tasks."""
    i, j = np.triu_indices(dim)
    exact = max(1, (EXACT_FLOAT - 1) // max(1, largest * largest))  # rows whose products add up exactly in doubles
    step = min(ROWS, exact)
    flush = max(1, ((1 << 62) // max(1, largest * largest)) // ROWS)  # batches before the totals might not fit a long

    def fold(batches):
        n, s, p, held = 0, np.zeros(dim, np.int64), np.zeros((dim, dim), np.int64), 0

        def part():
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.int64())), pa.array([p[i, j].tolist()], pa.list_(pa.int64()))], ["n", "s", "p"])
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                y = padded(b.slice(a, ROWS), dim)
                n, held = n + len(y), held + 1
                s += y.sum(axis=0)
                for k in range(0, len(y), step):
                    z = y[k: k + step].astype(np.float64)
                    p += (z.T @ z).astype(np.int64) if exact > 1 else y[k: k + step].T @ y[k: k + step]
                if held >= flush:
                    yield part()
                    n, held = 0, 0
                    s[:], p[:] = 0, 0
        if n:
            yield part()
    parts = save(rows.select("size", "y").mapInArrow(fold, "n bigint, s array<bigint>, p array<bigint>"), "moments")
    n = parts.agg(F.sum("n")).first()[0] or 0

    def total(name: str) -> dict[int, int]:
        g = parts.select(F.posexplode(name).alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        return {r["k"]: int(r["v"]) for r in g.collect()}  # dim or dim * (dim + 1) / 2 rows
    s, p = total("s"), total("p")
    full = [[0] * dim for _ in range(dim)]
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        full[a][b] = full[b][a] = p[k]
    return n, [s[k] for k in range(dim)], full


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2**31."""
    out, n = [], (1 << 31) - 1
    while len(out) < count:
        if all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7)) and _strong(n):
            out.append(n)
        n -= 2
    return out


def _strong(n: int) -> bool:
    """Miller-Rabin to the bases 2, 3, 5 and 7, which decides below 3,215,031,751."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def characteristic_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - m) modulo the prime ``p`` < 2**31, by reduction to Hessenberg form."""
    h, d = m.copy() % p, len(m)
    for c in range(d - 2):
        below = np.flatnonzero(h[c + 1:, c])
        if not below.size:
            continue
        k = c + 1 + int(below[0])
        if k != c + 1:
            h[[c + 1, k]] = h[[k, c + 1]]
            h[:, [c + 1, k]] = h[:, [k, c + 1]]
        f = h[c + 2:, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2:] = (h[c + 2:] - f[:, None] * h[c + 1][None, :] % p) % p
        # the inverse column step: column c + 1 gains f times the columns after it; halves keep the sums in a long
        high, low = h[:, c + 2:] >> 16, h[:, c + 2:] & 0xFFFF
        gain = (((high * f % p).sum(axis=1) % p << 16) + (low * f % p).sum(axis=1)) % p
        h[:, c + 1] = (h[:, c + 1] + gain) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # polys[k]: of the leading k x k block
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1] % p) % p
        t = 1
        for i in range(1, k):
            t = t * int(h[k - i, k - i - 1]) % p
            polys[k] = (polys[k] - t * int(h[k - i - 1, k - 1]) % p * polys[k - i - 1] % p) % p
    return polys[d]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients, lowest first, of det(x - m) of a positive semidefinite integer matrix; one prime per row of a Spark job."""
    d, trace = len(m), sum(m[k][k] for k in range(len(m)))
    # a coefficient is at most comb(d, k) * (trace / d) ** k, being an elementary symmetric polynomial of roots >= 0
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    ps = primes(math.ceil((bound.bit_length() + 2) / 30.9) + 1)

    def work(batches):
        for b in batches:
            got = [characteristic_mod(np.array([[x % p for x in row] for row in m], np.int64), p).tolist() for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], ["p", "c"])
    jobs = spark.createDataFrame([(p,) for p in ps], "p bigint").repartition(min(len(ps), 4 * spark.sparkContext.defaultParallelism))
    value, modulus = [0] * (d + 1), 1
    for r in jobs.mapInArrow(work, "p bigint, c array<bigint>").collect():  # a row per prime, dim + 1 numbers each
        p = r["p"]
        inv = pow(modulus, -1, p)
        value = [v + modulus * ((c - v) * inv % p) for v, c in zip(value, r["c"])]
        modulus *= p
    return [v - modulus if v > modulus // 2 else v for v in value]


def roots_above(poly: list[int], a: int) -> int:
    """Number of roots above ``a``, counted with multiplicity, of a polynomial with real roots only: sign changes of poly(x + a)."""
    c = list(poly)
    if a:
        for k in range(len(c) - 1):
            for i in range(len(c) - 2, k - 1, -1):
                c[i] += a * c[i + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], most: int) -> tuple[list[int], int]:
    """The ``most`` largest positive roots, falling, equal ones repeated, each as an integer over 2**shift with PRECISION bits or more."""
    most = min(most, roots_above(poly, 0))
    if not most:
        return [], 0
    d = len(poly) - 1
    top = abs(poly[d - 1]).bit_length()  # the sum of all roots
    shift = 0
    scaled = lambda s: [c << (s * (d - k)) for k, c in enumerate(poly)]  # noqa: E731  roots times 2**s
    while roots_above(scaled(shift), 1) < most:
        shift += 32
    p = scaled(shift)
    lo, hi = 0, top + shift
    while hi - lo > 1:  # the last wanted root is above 2**lo
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if roots_above(p, 1 << mid) >= most else (lo, mid)
    more = max(0, PRECISION - lo)
    shift += more
    p = scaled(shift)
    found: list[int] = []

    def isolate(a: int, b: int, above_a: int, above_b: int) -> None:
        """Roots in (a, b]; those after the first ``most`` are left out."""
        if above_a == above_b or above_b >= most:
            return
        if b - a == 1:
            found.extend([b] * (min(above_a, most) - above_b))
            return
        mid = (a + b) // 2
        n = roots_above(p, mid)
        isolate(mid, b, n, above_b)
        isolate(a, mid, above_a, n)
    isolate(0, 1 << (top + shift), roots_above(p, 0), 0)
    return found, shift


def null_vectors(m: list[list[int]], root: int, shift: int, count: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors that ``m`` multiplies by ``root / 2**shift``, by inverse iteration in fixed-point integers."""
    d = len(m)
    bits = 2 * PRECISION + 64
    one = 1 << bits
    # the shift of the matrix is off the root by a part in 2**(PRECISION - 20), so no pivot vanishes and one step gains that factor
    off = root + max(1, root >> (PRECISION - 20))
    scale = max(1, off >> shift)
    a = [[(((m[i][j] << shift) - (off if i == j else 0)) << bits) // (scale << shift) for j in range(d)] for i in range(d)]
    order = list(range(d))
    for c in range(d):  # elimination with row pivots, factors kept below the diagonal
        k = max(range(c, d), key=lambda r: abs(a[r][c]))
        a[c], a[k], order[c], order[k] = a[k], a[c], order[k], order[c]
        pivot = a[c][c] or 1
        row = a[c]
        for r in range(c + 1, d):
            f = (a[r][c] << bits) // pivot
            if f:
                x = a[r]
                x[c + 1:] = [u - (f * v >> bits) for u, v in zip(x[c + 1:], row[c + 1:])]
            a[r][c] = f

    def solve(b: list[int]) -> list[int]:
        y = [b[k] for k in order]
        for c in range(d):
            for r in range(c + 1, d):
                y[r] -= a[r][c] * y[c] >> bits
        for c in range(d - 1, -1, -1):
            y[c] = (y[c] << bits) // (a[c][c] or 1)
            for r in range(c):
                y[r] -= a[r][c] * y[c] >> bits
        return y

    def unit(v: list[int]) -> list[int]:
        length = math.isqrt(sum(x * x for x in v)) or 1
        return [(x << bits) // length for x in v]
    rng = np.random.default_rng(13)
    out: list[list[int]] = []
    while len(out) < count:
        v = unit([int(x) for x in rng.integers(-(1 << 40), 1 << 40, d)])
        for _ in range(3):
            v = solve(v)
            v = unit(v)
            for u in out:
                dot = sum(x * y for x, y in zip(u, v)) >> bits
                v = [y - (dot * x >> bits) for x, y in zip(u, v)]
            v = unit(v)
        out.append(v)
    got = [np.array([x / one for x in v]) for v in out]
    return [v * (1 if v[np.abs(v).argmax()] > 0 else -1) for v in got]


@dataclass
class Whitening:
    """A fitted whitening: counts, sums of y = x - OFFSET, eigenvalues of the covariance, unit components and shares of the variance."""
    n: int
    sums: list[int]
    values: list[float]
    components: np.ndarray  # a row each
    explained: list[float]

    @property
    def dim(self) -> int:
        return len(self.sums)


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of saved ``rows`` (vec_id, size, y); None where there is no row. Components with no variance are left out."""
    info = rows.agg(F.max("size").alias("dim"), F.max(F.greatest(F.abs(F.array_max("y")), F.abs(F.array_min("y")))).alias("largest")).first()
    if info["dim"] is None:
        return None
    dim = info["dim"]
    if dim > MOST_DIM:
        raise ValueError(f"more than {MOST_DIM} dimensions")
    if not dim:
        return Whitening(rows.count(), [], [], np.zeros((0, 0)), [])
    n, s, p = moments(rows, dim, info["largest"] or 0)
    scatter = [[n * p[i][j] - s[i] * s[j] for j in range(dim)] for i in range(dim)]
    trace = sum(scatter[k][k] for k in range(dim))
    if not trace:
        return Whitening(n, s, [], np.zeros((0, dim)), [])
    found, shift = largest_roots(characteristic(rows.sparkSession, scatter), most)
    components, k = [], 0
    while k < len(found):
        same = found.count(found[k])
        components += null_vectors(scatter, found[k], shift, same)
        k += same
    values = [r / (n * n << shift) for r in found]  # big integers divide to the nearest double
    return Whitening(n, s, values, np.array(components), [r / (trace << shift) for r in found])


def projected(w: Whitening, y: np.ndarray) -> np.ndarray:
    """Whitened coordinates of integer vectors: centred exactly, then divided, projected and scaled in doubles."""
    centred = (w.n * y - np.array(w.sums, np.int64)) / w.n
    return centred @ w.components.T / np.sqrt(w.values)


def deviations(w: Whitening, y: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2 of each row; it fits a long below about 9.2e18 and is null beyond."""
    d = w.n * y - np.array(w.sums, np.int64)
    widest = int(np.abs(d).max(initial=0))
    if widest * widest * max(1, d.shape[1]) < 1 << 63:
        return np.einsum("nd,nd->n", d, d).tolist()
    exact = [sum(int(x) ** 2 for x in row) for row in d]
    return [x if x < 1 << 63 else None for x in exact]


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity; tasks fold sums, Spark adds them."""
    c = len(w.values)

    def fold(batches):
        s, p = np.zeros(c), np.zeros((c, c))
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                z = projected(w, padded(b.slice(a, ROWS), w.dim))  # centred before multiplying
                s += z.sum(axis=0)
                p += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([s, p.ravel()]).tolist()], pa.list_(pa.float64()))], ["v"])
    parts = rows.select("size", "y").mapInArrow(fold, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    v = np.zeros(c + c * c)
    for r in parts.collect():  # components + components ** 2 rows
        v[r["k"]] = r["v"]
    mean = v[:c] / w.n
    return float(np.abs(v[c:].reshape(c, c) / w.n - np.outer(mean, mean) - np.eye(c)).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, n, deviation, whitened array, explained array, identity_error) of each usable row of ``vectors`` (vec_id, embedding).

    Rows whose vector is null or holds null or non-finite entries take no part; other columns are ignored. Shorter vectors are padded with entries 0 to
    the longest. Repeated rows and null ids are rows of their own. Arrays hold a place for each component, up to ``most``, with a variance above 0: one
    row alone, or equal rows, have none. Equal eigenvalues get orthonormal components of their space. An empty table gives no rows. A
    deviation beyond a long is null; a component beyond vectors.LARGEST / SCALE stops the job, and so do more than MOST_DIM dimensions.
    """
    rows = save(usable(vectors), "whitening-rows")
    w = fit(rows, most)
    schema = "vec_id bigint, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    if w is None:
        return vectors.sparkSession.createDataFrame([], schema)
    if w.n * LARGEST >= 1 << 62:
        raise OverflowError("more rows than sums of a long allow")  # 3.4e10 rows
    error = identity_error(rows, w) if w.values else 0.0

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        y = padded(b, w.dim)
        z = projected(w, y) if w.values else np.zeros((len(y), 0))
        k, c = len(y), z.shape[1]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * c), pa.array(x))
        return pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.full(k, w.n)), pa.array(deviations(w, y), pa.int64()), lists(z.ravel()), lists(np.tile(w.explained, k)), pa.array(np.full(k, error))],
                                          ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(batched(settle, ROWS), schema)


@query("op13_characteristic_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    one = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return one.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
