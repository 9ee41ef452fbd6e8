"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns VIRTUAL points of the 64-bit ring; a document lies at the hash of its text and belongs to the next point clockwise.
A shard takes documents in ring order until it is full; the rest go on clockwise to the next shard that is not full, round
after round. All documents between two points share their way round the ring, so the rounds run on the counts per
arc (shards * VIRTUAL numbers) and end as runs of consecutive places in ring order; a document's shard and slot follow from its place.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm.common import query, ranked, table

SHARDS = 40  # fixed value of the contract
OVERHEAD = 16  # fixed value of the contract: bytes of a document besides its text
VIRTUAL = 64  # points of a shard
MOST_POINTS = 1 << 20  # points of a ring: 16 MB in a task and on the driver


@dataclass
class Ring:
    points: np.ndarray  # ascending
    owner: np.ndarray  # shard of each point

    @classmethod
    def of(cls, shards: int, virtual: int = VIRTUAL) -> "Ring":
        """A shard's points depend on its number alone, so one more shard leaves the other points where they are."""
        if shards * virtual > MOST_POINTS:
            raise ValueError(f"more than {MOST_POINTS} points")
        at = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(virtual)]
        at.sort()
        return cls(np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int64))

    def arc(self, position: np.ndarray) -> np.ndarray:
        """Number of the arc that ends at the first point not before each position; positions after the last point are one arc more."""
        return np.searchsorted(self.points, position, "left")


@dataclass
class Runs:
    """Runs of consecutive places in ring order: first place, shard and first slot of each, ascending by place."""
    first: np.ndarray
    shard: np.ndarray
    slot: np.ndarray


def capacities(n: int, shards: int, slack: float) -> np.ndarray:
    """Rows a shard may hold: without slack exactly n in all, at most one apart; with slack the mean times 1 + slack, rounded up."""
    if slack > 0:
        return np.full(shards, int(np.ceil((1 + slack) * n / shards)), np.int64)
    return n // shards + (np.arange(shards) < n % shards).astype(np.int64)


def walk(ring: Ring, counts: np.ndarray, room: np.ndarray) -> Runs:
    """Fill the shards: ``counts`` documents per arc (one more arc than points) into shards that hold ``room`` documents."""
    room, taken, m = room.copy(), np.zeros_like(room), len(ring.points)
    start = np.concatenate([[0], np.cumsum(counts)])
    waiting = [(a % m, int(start[a]), int(counts[a])) for a in range(m + 1) if counts[a]]  # point, first place, length
    runs = []
    while waiting:
        nxt = np.full(m, -1)  # the first point at or after each one whose shard has room
        last = -1
        for p in range(2 * m - 1, -1, -1):
            if room[ring.owner[p % m]]:
                last = p % m
            if p < m:
                nxt[p] = last
        left = []
        for point, first, length in waiting:  # in ring order of the documents
            point = int(nxt[point])
            s = int(ring.owner[point])
            n = min(length, int(room[s]))
            if n:
                runs.append((first, s, int(taken[s])))
                room[s] -= n
                taken[s] += n
            if n < length:
                left.append((point, first + n, length - n))
        waiting = left
    runs.sort()
    return Runs(*(np.array([r[i] for r in runs], np.int64) for i in range(3)))


def place(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep`` columns, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text, ...).

    Without ``slack`` the shards' row counts are at most one apart; with it no shard holds more than the mean times 1 + slack and
    fewer rows move when a shard is added. Equal texts lie together on the ring, so they share a shard but where one fills up.
    A null text has no bytes and lies at a place of its own; repeated rows are rows of their own and take
    consecutive slots. Slots count from 0 without gaps in ring order. An empty table gives no rows. Other columns are dropped unless kept; size,
    text_crc32, shard and slot of the input are replaced.
    """
    made = ("size", "text_crc32", "shard", "slot")
    keep = [c for c in keep if c not in (*made, "doc_id")]
    text = F.col("text")
    keyed = docs.select("doc_id", *keep, (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
                        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
                        F.xxhash64(text).alias("_h"), F.xxhash64(F.lit("text"), text).alias("_h2"), F.rand(17).alias("_salt"))
    # the salt only orders rows equal in id and text, which are interchangeable: no single task sorts them
    placed = ranked(keyed, [F.col(c) for c in ("_h", "_h2", "doc_id", "_salt")], "ring").drop("_h2", "_salt")
    ring = Ring.of(shards, virtual)

    def per_arc(batches):
        total = np.zeros(len(ring.points) + 1, np.int64)
        for b in batches:
            total += np.bincount(ring.arc(b.column(0).to_numpy()), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["arc", "n"])
    counts = np.zeros(len(ring.points) + 1, np.int64)
    for r in placed.select("_h").mapInArrow(per_arc, "arc bigint, n bigint").groupBy("arc").agg(F.sum("n").alias("n")).collect():  # a row per arc
        counts[r["arc"]] = r["n"]
    runs = walk(ring, counts, capacities(int(counts.sum()), shards, slack))

    def settle(batches):
        for b in batches:
            rank = b.column("rank").to_numpy()
            i = np.searchsorted(runs.first, rank, "right") - 1
            held = [b.column(n) for n in b.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*held, pa.array(runs.shard[i].astype(np.int32)), pa.array(runs.slot[i] + rank - runs.first[i])], [*b.schema.names[:-1], "shard", "slot"])
    cols = placed.select("doc_id", *keep, "size", "text_crc32", "rank")
    return cols.mapInArrow(settle, ", ".join([*(f"`{n}` {t}" for n, t in cols.dtypes[:-1]), "shard int", "slot bigint"]))


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """The documents, all columns, as Parquet folders ``shard=N`` under ``path``. Rows lie in ring order, so no second shuffle is needed."""
    place(docs, keep=tuple(docs.columns), **how).write.partitionBy("shard").parquet(path)


@query("op12_bounded_load_ring")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = place(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
