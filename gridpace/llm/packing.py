"""Packed exchanges: documents dealt into chunks, and hashes sent from chunks to buckets as arrays.

A chunk is a few MB of whole documents that one call sees together. What a chunk tells about its
many windows travels as one row per bucket of the hash, with arrays in it, and the answers travel back to
the chunk the same way, so a shuffle moves a few bytes per window and no key is ever larger than a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpace.llm.common import partitions

CHUNK_BYTES = 4 << 20  # text per chunk
SEGMENT = 1 << 20  # bytes hashed at a time
U = np.uint64
_rng = np.random.default_rng(20240607)
LUT = _rng.integers(0, 1 << 64, 256, dtype=U, endpoint=False)
P = U(int(_rng.integers(1 << 62, 1 << 63)) | 1)
P_INV = U(pow(int(P), -1, 1 << 64))
Q = U(int(_rng.integers(1 << 62, 1 << 63)) | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        one = np.ones(size, U)
        a, b = one.copy(), one
        a[1:], b[1:] = P, P_INV
        _powers[size] = np.cumprod(a), np.cumprod(b)
    return _powers[size]


def text_bytes(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last ends; nulls are empty."""
    arr = pc.fill_null(col, "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every run without ``breaks`` inside a document, and each document's first word (and the end)."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(off.size, np.int64)
    space = breaks[data]
    edge = np.empty(data.size + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1]
    edge[off] = True
    begin = np.flatnonzero(~space & edge[:-1])
    edge[1:-1] = space[1:]
    edge[off] = True
    end = np.flatnonzero(~space & edge[1:]) + 1
    return begin, end, np.searchsorted(begin, off)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(begin.size, U)
    i = 0
    while i < begin.size:
        j = max(i + 1, int(np.searchsorted(end, begin[i] + SEGMENT, "right")))
        a = int(begin[i])
        part = LUT[data[a: end[j - 1]]]
        up, down = powers(part.size + 1)
        part *= up[: part.size]
        total = np.empty(part.size + 1, U)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        b, e = begin[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[b]) * down[b] + (e - b).astype(U) * Q)
        i = j
    return out


def rolling(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``k`` numbers; ``k - 1`` fewer than ``x``."""
    n = max(0, x.size - k + 1)
    acc = np.full(n, U(seed * 2 + 1))
    for j in range(k):
        acc *= Q
        acc += x[j: j + n]
    return mix(acc)


def starts_within(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of all items that begin a run of ``k`` inside their document; ``first``: each document's first item, and the end."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(first[:-1] - before, n)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash, in the order of the hashes."""
    return ((h >> U(32)) * U(n)) >> U(32)


def binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value per slice ``at[i]:at[i + 1]`` of an array."""
    return pa.Array.from_buffers(pa.large_binary(), at.size - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unbinary(col: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column made by ``binary``, and how many each row has."""
    arrs = [np.frombuffer(x.as_buffer(), dtype) for c in col.chunks for x in c]
    return (np.concatenate(arrs) if arrs else np.zeros(0, dtype)), np.array([a.size for a in arrs], np.int64)


def pick(values: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept values, the rows that keep any, and the slices of those rows."""
    at = np.append(0, np.cumsum(np.add.reduceat(np.append(keep, False), np.append(0, np.cumsum(sizes))[:-1], dtype=np.int64) if sizes.size else np.zeros(0, np.int64)))
    rows = np.flatnonzero(np.diff(at))
    return values[keep], rows, np.append(at[rows], at[-1])


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not ordered.size:
        return np.zeros(values.size, bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), ordered.size - 1)] == values


def ids(table: pa.Table, name: str = "doc_id") -> np.ndarray:
    """Integer ids; null is the smallest."""
    return pc.fill_null(table.column(name).cast(pa.int64()), -(1 << 63)).to_numpy()


def in_order(table: pa.Table) -> pa.Table:
    """The rows by doc_id, null first; rows of one id by text."""
    order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with ``_chunk``, dealt by it, and the bytes of all texts. A row's chunk depends on its id and text alone."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(docs.sparkSession)
    chunks = max(n, math.ceil(total / chunk_bytes))
    key = F.pmod(F.xxhash64(F.lit("chunk"), F.col("doc_id"), F.xxhash64("text")), F.lit(chunks))
    return docs.withColumn("_chunk", key).repartition(n, "_chunk"), total
