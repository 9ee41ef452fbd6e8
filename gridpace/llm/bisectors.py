"""Centroid clustering over integer vectors: the nearest centroid by a tournament of bisecting planes.

For two centroids a < b every vector x lies on one side of the plane halfway between them: b is nearer exactly when
2 (b - a) . x > |b|^2 - |a|^2, all integers. Normals and thresholds of all pairs are computed once per task. Neighbours in
number meet first and winners go on, so k - 1 sign tests leave one centroid; a zero keeps the smaller number. Only the winner's
distance is computed. A round sends one row of sums per task and cluster to the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm.common import query, save, table
from gridpace.llm.vectors import EXACT_FLOAT, batched, finite_rows, floors, product

# Components, scale, centroids, rounds and seed of the contract.
DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
MOST_CENTROIDS = 256  # planes of all pairs: 17 MB in a task


class Tournament:
    """The planes between all pairs of centroids, and the winner of each vector."""

    def __init__(self, centroids: np.ndarray):
        self.c, k = centroids, len(centroids)
        self.a, self.b = np.triu_indices(k, 1)
        self.pair = np.zeros((k, k), np.int64)
        self.pair[self.a, self.b] = np.arange(len(self.a))
        norm = (centroids * centroids).sum(axis=1)
        self.normal = 2 * (centroids[self.b] - centroids[self.a])
        self.threshold = norm[self.b] - norm[self.a]
        self.widest = int(np.abs(centroids).max(initial=0))

    def winners(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row, the smaller one on a tie."""
        n, k = len(x), len(self.c)
        live = np.broadcast_to(np.arange(k), (n, k))  # ascending in every row, so the left of a pair has the smaller number
        bound = 4 * x.shape[1] * max(1, self.widest) * max(1, int(np.abs(x).max(initial=0)))
        small = bound < EXACT_FLOAT
        normal, xs = (self.normal.astype(np.float64), x.astype(np.float64)) if small else (self.normal, x)
        while live.shape[1] > 1:
            left, right = live[:, 0:-1:2], live[:, 1::2]
            if live.shape[1] == k:  # the first matches are the same for all rows
                p = self.pair[left[0], right[0]] if n else np.zeros(0, np.int64)
                side = product(x, self.normal[p].T, bound) > self.threshold[p]
            else:
                p = self.pair[left, right]
                side = np.empty(p.shape, bool)
                for j in range(p.shape[1]):
                    side[:, j] = np.einsum("nd,nd->n", xs, normal[p[:, j]]) > self.threshold[p[:, j]]
            live = np.hstack([np.where(side, right, left), live[:, 2 * left.shape[1]:]])
        return live[:, 0].astype(np.int64)

    def distance(self, x: np.ndarray, winner: np.ndarray) -> np.ndarray:
        d = x - self.c[winner]
        return np.einsum("nd,nd->n", d, d)


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the rows of ``vectors`` (vec_id, embedding) with exactly ``dim`` components, all finite, as floor(scale * component)."""
    def convert(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, size, values = finite_rows(b.column(1))
        full = size == dim
        x = floors(values[np.repeat(full, size)], scale)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[full])), pa.ListArray.from_arrays(pa.array(np.arange(full.sum() + 1, dtype=np.int32) * dim), pa.array(x))], ["vec_id", "x"])
    v = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    return v.mapInArrow(batched(convert), "vec_id bigint, x array<bigint>")


def unpacked(b: pa.RecordBatch) -> np.ndarray:
    flat = b.column("x").flatten().to_numpy()
    return flat.reshape(b.num_rows, flat.size // b.num_rows if b.num_rows else 1)


def first_centroids(ints: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, null ids last, rows of one id by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = ints.orderBy(h.asc_nulls_last(), "x").limit(k).select("x").collect()  # k rows
    return np.array([r["x"] for r in rows], np.int64)


def new_centroids(ints: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: componentwise floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    def fold(batches):
        t, sums, count = Tournament(centroids), np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                x = unpacked(b.slice(a, 4096))
                w = t.winners(x)
                order = np.argsort(w, kind="stable")
                at = np.flatnonzero(np.diff(w[order], prepend=-1))
                sums[w[order][at]] += np.add.reduceat(x[order], at, axis=0)
                count += np.bincount(w, minlength=len(count))
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], ["cluster", "n", "s"])
    part = ints.select("x").mapInArrow(fold, "cluster bigint, n bigint, s array<bigint>")
    total = part.select("cluster", "n", F.posexplode("s").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # at most k * dim rows
        out[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) of the vectors of ``vectors`` (vec_id, embedding) with ``dim`` finite components.

    Rows whose vector is null, has another length or holds null or non-finite components take no part; other columns are ignored. Repeated
    rows are vectors of their own, and so is a row with a null id (its hash counts as the largest). With fewer than ``k`` vectors all of
    them are centroids. An empty table gives no rows. Equal distances go to the smaller number. A component
    beyond LARGEST / scale stops the job, because squared distances would not fit a long.
    """
    if k > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    ints = save(integer_vectors(vectors, dim, scale), "integer-vectors")
    c = first_centroids(ints, k, seed)
    if not len(c):
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), c
    for _ in range(rounds):
        c = new_centroids(ints, c)

    def place(batches):
        t = Tournament(c)
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                x = unpacked(part)
                w = t.winners(x)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(w.astype(np.int32)), pa.array(t.distance(x, w))], ["vec_id", "cluster", "distance"])
    return save(ints.mapInArrow(place, "vec_id bigint, cluster int, distance bigint"), "clusters"), c


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``placed`` with the sum of distances of its cluster and of all, and the digest of its centroid."""
    spark = placed.sparkSession
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    per = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    every = F.broadcast(per.agg(F.sum("s").cast("bigint").alias("inertia")).withColumn("one", F.lit(1)))  # one row
    per = per.withColumn("one", F.lit(1)).join(every, "one").select("cluster", F.col("s").cast("bigint").alias("cluster_inertia"), "inertia")
    digest = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    return placed.join(F.broadcast(per.join(F.broadcast(digest), "cluster")), "cluster")  # at most MOST_CENTROIDS rows


def _sql() -> str:
    """The same rounds as a chain of common table expressions, sums and distances in exact integers."""
    near = "row_number() over (partition by {key} order by list_sum(list_transform(list_zip({x}, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster) as r"
    parts = [f"""ints as materialized (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::hugeint) as x from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIM})""", f"""c0 as materialized (
  select (row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, x) - 1)::integer as cluster, x from ints
  qualify row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, x) <= {CENTROIDS})"""]
    for i in range(ROUNDS):
        parts += [f"a{i} as materialized (select i, x, cluster from (select i, v.x, c.cluster, {near.format(key='i', x='v.x')} from ints v cross join c{i} c) where r = 1)",
                  f"s{i} as materialized (select cluster, d, sum(e) as s, count(*) as n from (select cluster, unnest(x) as e, generate_subscripts(x, 1) as d from a{i}) group by all)",
                  f"""c{i + 1} as materialized (select c.cluster, coalesce(m.x, c.x) as x from c{i} c left join
  (select cluster, list(((s - ((s % n) + n) % n) // n)::hugeint order by d) as x from s{i} group by cluster) m using (cluster))"""]
    last = f"c{ROUNDS}"
    parts.append(f"""z as materialized (select vec_id, cluster, cx, list_sum(list_transform(list_zip(x, cx), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance
  from (select vec_id, v.x, c.x as cx, c.cluster, {near.format(key='i', x='v.x')} from ints v cross join {last} c) where r = 1)""")
    return "with " + ",\n".join(parts) + """
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
       sha256(array_to_string(list_transform(cx, lambda e: e::varchar), ',')) as centroid_sha256 from z"""


@query("op11_bisector_tournament", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))
