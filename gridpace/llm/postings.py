"""Nearest neighbours by inner product over balanced posting lists.

Centroids are fitted to a bounded sample and kept in memory in a neighbour graph. Every vector goes to the list of its nearest
centroid, and a vector near a boundary to several lists. A query searches the graph for near centroids, prunes them by the ratio
of their distance to the nearest one's, and scans the lists that stay. Long lists are cut into parts, and so are the queries that
meet at a list, so no task holds more than about PART vectors and PART queries; equal vectors are one entry with their smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpace.llm.common import query, save, table

NEAREST = 20
SAMPLE = 20_000  # vectors that the centroids are fitted to
LIST = 100  # vectors per list, as far as MOST_LISTS goes
MOST_LISTS = 2048  # centroids of all tasks' graph: 0.5 MB at 64 dimensions
REPLICAS, NEAR = 4, 1.12  # a vector is kept in up to REPLICAS lists whose distance is within NEAR times the nearest
PROBES, PRUNE = 96, 1.35  # a query scans up to PROBES lists whose distance is within PRUNE times the nearest
PART = 20_000  # vectors of a list, and queries to it, in one task
LINKS, FAR_LINKS, BEAM = 20, 4, 128


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: id and vector there, all components finite, one not 0."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return v.where(finite & F.exists("v", lambda x: x != 0))


def matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, n = arr.flatten().to_numpy(zero_copy_only=False), len(arr)
    if flat.size == n * dim:
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    size = np.diff(arr.offsets.to_numpy())
    out[np.repeat(np.arange(n), size), np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component that gives all the same length, so that nearest means largest inner product."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]])


def fit(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centroids of a sample, by Lloyd's rounds that charge for crowded lists, in proportion to the sample's spread, and restart empty ones."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)]
    load, spread = np.zeros(k), float(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(axis=1) - 2 * b @ c.T + load).argmin(axis=1) for b in np.array_split(x, max(1, len(x) // 4096))])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
        load = 0.05 * spread * (size / max(1.0, size.mean()) - 1).clip(0, 4)
    return c


class Graph:
    """Centroids with links to near ones and a few far ones; searched by widening a beam."""

    def __init__(self, c: np.ndarray):
        self.c, self.norm = c, (c * c).sum(axis=1)
        k = len(c)
        rng = np.random.default_rng(11)
        d = self.norm[None, :] - 2 * c @ c.T + self.norm[:, None]
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(LINKS, k - 1)]
        far = rng.integers(0, k, (k, FAR_LINKS))
        self.links = np.hstack([near, far]).astype(np.int64)
        self.entry = rng.choice(k, min(k, 16), replace=False)

    def distance(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.maximum(self.norm[ids] - 2 * np.einsum("bd,bkd->bk", x, self.c[ids]) + (x * x).sum(axis=1)[:, None], 0)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``beam`` nearest centroids of each row, nearest first."""
        beam = min(beam, len(self.c))
        n = len(x)
        ids = np.repeat(self.entry[None, :], n, axis=0)
        d = self.distance(x, ids)
        order = np.argsort(d, axis=1)
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        seen = np.zeros((n, len(self.c)), bool)
        seen[np.arange(n)[:, None], ids] = True
        opened = np.zeros(ids.shape, bool)
        wide = 4
        while True:
            shut = np.where(opened, np.inf, d)
            pick = np.argsort(shut, axis=1)[:, :wide]
            live = np.isfinite(np.take_along_axis(shut, pick, 1))
            if not live.any():
                break
            np.put_along_axis(opened, pick, True, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
            fresh = np.repeat(live, self.links.shape[1], axis=1) & ~seen[np.arange(n)[:, None], new]
            seen[np.arange(n)[:, None], np.where(fresh, new, ids[:, :1])] = True
            nd = np.where(fresh, self.distance(x, new), np.inf)
            twice = np.argsort(new, axis=1, kind="stable")  # one centroid linked twice counts once
            s = np.take_along_axis(new, twice, 1)
            again = np.hstack([np.zeros((n, 1), bool), s[:, 1:] == s[:, :-1]])
            np.put_along_axis(nd, twice, np.where(again, np.inf, np.take_along_axis(nd, twice, 1)), 1)
            ids, d, opened = np.hstack([ids, new]), np.hstack([d, nd]), np.hstack([opened, ~np.isfinite(nd)])
            order = np.argsort(d, axis=1)[:, :beam]
            ids, d, opened = (np.take_along_axis(z, order, 1) for z in (ids, d, opened))
        return ids, np.sqrt(d)


def within(d: np.ndarray, ratio: float, most: int) -> np.ndarray:
    """Which of the sorted distances are within ``ratio`` times the first, up to ``most``."""
    keep = d <= np.maximum(d[:, :1], 1e-9) * ratio
    keep[:, most:] = False
    return keep & np.isfinite(d)


def best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, owners: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The ``k`` best (id, score) of each query: ``ids`` belong to rows ``owners`` of ``x``; a query's own id takes no part."""
    out = []
    for a in range(0, len(q), 512):
        rough = q[a: a + 512] @ x.T
        for i, row in enumerate(rough):
            j = min(k + 1, row.size) - 1
            edge = -np.partition(-row, j)[j]
            near = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
            exact = np.einsum("nd,d->n", x[near], q[a + i])
            lo, hi = np.searchsorted(owners, near), np.searchsorted(owners, near, "right")
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
            who, score = ids[at], np.repeat(exact, hi - lo)
            other = who != qid[a + i]
            who, score = who[other], score[other]
            order = np.lexsort((who, -score))[:k]
            out.append((int(qid[a + i]), who[order], score[order]))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` nearest found of all ``vectors`` but its own, by inner product.

    Both have vec_id and embedding. Vectors that are null, zero or hold null or non-finite components take no part, nor do null
    ids; shorter vectors are padded with zeros. A row that repeats id and vector counts once. Ties go to the smaller
    id. All candidates are returned where there are fewer than ``k``. An empty side gives no rows.
    """
    spark = vectors.sparkSession
    rows = save(usable(vectors).distinct(), "vectors")
    info = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not info["n"]:
        return spark.createDataFrame([], schema)
    dim, longest = info["dim"], info["longest"]
    v = F.col("v")
    key = [F.xxhash64(v).alias("k1"), F.xxhash64(F.lit("v"), v).alias("k2")]
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")  # the limit is applied before the shuffle too
    small = rows.select("vec_id", *key).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    entries = small.where("r = 1").select("vec_id", "k1", "k2").join(rows, "vec_id").where((F.xxhash64(v) == F.col("k1")) & (F.xxhash64(F.lit("v"), v) == F.col("k2")))
    ids = small.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    entries = save(entries.select("k1", "k2", "v").join(ids, ["k1", "k2"]), "entries")
    n = entries.count()
    draw = F.col("k1").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    drawn = entries.where(draw <= SAMPLE / n) if n > SAMPLE else entries
    sample = drawn.orderBy("k1", "k2").select("v").toArrow()  # about SAMPLE rows, in an order that reruns repeat
    x = lifted(matrix(sample.column("v"), dim), longest)
    lists = int(min(MOST_LISTS, max(1, n // LIST), len(x)))
    centroids = fit(x, lists)

    def placed(batches, most: int, ratio: float, beam: int, unit: bool):
        graph = Graph(centroids)
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                x = matrix(part.column("v"), dim)
                if unit:  # a query's length does not matter for the order
                    x = np.hstack([x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros((len(x), 1))])
                else:
                    x = lifted(x, longest)
                c, d = graph.search(x, beam)
                keep = within(d, ratio, most)
                row, col = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(c[row, col]), *(part.column(i).take(pa.array(row)) for i in range(part.num_columns))], ["list", *part.schema.names])

    stored = entries.select("k1", "v", "ids").mapInArrow(lambda it: placed(it, REPLICAS, NEAR, 32, False), "list bigint, k1 bigint, v array<double>, ids array<bigint>")
    stored = save(stored, "postings")
    sizes = {r["list"]: r["n"] for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
    asked = save(usable(queries).distinct(), "queries")
    wanted = min(k, rows.select("vec_id").distinct().count() - 1)

    def scan(t: pa.Table, q: pa.Table) -> pa.Table:
        found = []
        if t.num_rows and q.num_rows:
            ids = t.column("ids").combine_chunks()
            owners = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
            found = best(matrix(q.column("v"), dim), q.column("vec_id").to_numpy(), matrix(t.column("v"), dim), owners, ids.flatten().to_numpy(), k)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "ids": pa.array([f[1] for f in found], pa.list_(pa.int64())), "scores": pa.array([f[2] for f in found], pa.list_(pa.float64()))})

    def run(routed: DataFrame) -> DataFrame:
        asks = {r["list"]: r["n"] for r in routed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
        cut = F.broadcast(spark.createDataFrame([(int(c), -(-sizes[c] // PART), -(-n // PART)) for c, n in asks.items() if c in sizes], "list bigint, parts bigint, blocks bigint"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        here = stored.join(cut, "list").select("list", F.pmod(F.xxhash64("k1"), "parts").alias("part"), upto("blocks").alias("block"), "v", "ids")
        there = routed.join(cut, "list").select("list", upto("parts").alias("part"), F.pmod(F.xxhash64(F.lit("q"), "vec_id"), "blocks").alias("block"), "vec_id", "v")
        hits = here.groupBy("list", "part", "block").cogroup(there.groupBy("list", "part", "block")).applyInArrow(scan, "query_id bigint, ids array<bigint>, scores array<double>")
        h = hits.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("query_id", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score")).distinct()
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return h.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)

    routed = save(asked.mapInArrow(lambda it: placed(it, PROBES, PRUNE, BEAM, True), "list bigint, vec_id bigint, v array<double>"), "routed")
    got = save(run(routed), "found")
    short = asked.join(got.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    short = save(short, "short")
    if short.count():  # too few in the probed lists: these queries scan all lists
        every = short.select(F.explode(F.array(*[F.lit(int(c)).cast("bigint") for c in sorted(sizes)])).alias("list"), "vec_id", "v")
        got = got.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(run(every))
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op8_balanced_posting_lists")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(v, v.where("vec_id % 20 = 0"))
