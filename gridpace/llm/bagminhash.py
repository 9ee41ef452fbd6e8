"""Near-duplicate classes of documents by BagMinHash.

A text is the multiset of its runs of five words. Every run carries independent Poisson processes over the blocks
[0,1), [1,2), [2,4), ... of its possible counts, each at the rate of its block's length; points beyond the
count are left out. The first point to reach each of ``M`` registers is the signature: two texts share a
register with the probability of their weighted Jaccard similarity. Bands of registers propose pairs,
which are verified on the multisets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm import packing as pk
from gridpace.llm.common import hinted, query, ranked, save, table, text_key

SHINGLE = 5  # words
SIMILARITY = 0.8
BANDS, ROWS = 24, 4  # a pair at the threshold is missed by all bands once in 300,000
STARS = 2  # rounds against one leader per bucket before the pairs that are left are listed
BATCH_BYTES = 2 << 20  # text signed at a time, or one longer document
PART_ROWS = 100_000  # edges per partition
PAIRS = 512  # pairs compared at a time
BLOCK = 256  # members of a bucket compared with as many others in one step
BROADCAST_ROWS = 200_000  # keys of 24 bytes sent to every task; more are shuffled
U = np.uint64
G = U(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):  # what separates words, after lower-casing A-Z
    BREAK[_a: _b + 1] = True


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of every distinct run of ``k`` words, or of all words of a shorter text."""
    data = LOWER[data]
    begin, end, first = pk.words(data, off, BREAK)
    x = pk.word_hashes(data, begin, end)
    at = pk.starts_within(first, k)
    doc, h = np.searchsorted(first, at, "right") - 1, pk.rolling(x, k)[at]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if short.size:
        doc = np.append(doc, short)
        h = np.append(h, [pk.rolling(x[first[d]: first[d + 1]], int(n[d]), 1)[0] for d in short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if h.size else np.zeros(0, np.int64)
    return doc[head], h[head], np.diff(np.append(head, h.size))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """The ``m`` registers of each document: the identity of the first point to reach each; all 0 for an empty one."""
    out = np.zeros((n_docs, m), U)
    total = np.bincount(doc, count, n_docs)
    limit = m * (math.log(m) + 3) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        sel = np.flatnonzero(todo[doc])
        blocks = np.where(count[sel] > 1, np.ceil(np.log2(np.maximum(count[sel], 1))).astype(np.int64), 0) + 1
        who = np.repeat(sel, blocks)
        block = np.arange(who.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
        size = np.where(block > 0, start, 1)
        state = pk.mix(h[who] + (block + 1).astype(U) * G)
        d, room = doc[who], count[who] - start
        time = np.zeros(who.size)
        best = np.full(n_docs * m, np.inf)
        name = np.zeros(n_docs * m, U)
        while d.size:
            state = state + G
            r = pk.mix(state)
            time = time - np.log1p(-((r >> U(11)).astype(np.float64) * 2.0 ** -53)) / size
            on = time <= limit[d]
            d, room, size, state, time, r = d[on], room[on], size[on], state[on], time[on], r[on]
            place = pk.mix(r ^ G)
            register = d * m + (((place >> U(32)) * U(m)) >> U(32)).astype(np.int64)
            level = ((place & U(0xFFFFFFFF)) * size.astype(U)) >> U(32)
            fits = level.astype(np.int64) < room
            reg, t, r = register[fits], time[fits], r[fits]
            np.minimum.at(best, reg, t)
            won = best[reg] == t
            name[reg[won]] = r[won]
        full = np.isfinite(best.reshape(n_docs, m)).all(axis=1)
        done = todo & full
        out[done] = name.reshape(n_docs, m)[done]
        todo &= ~full
        limit = limit * 2
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), U)
    for b in range(bands):
        keys[:, b] = pk.rolling(np.ascontiguousarray(sig[:, b * rows: (b + 1) * rows]).ravel(), rows, b)[::rows]
    return keys


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, keys, sig) of every document; no keys for a text without words. ``sig`` has 16 bits of each register."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BATCH_BYTES, "right")))
                part = batch.slice(i, j - i)
                data, off = pk.text_bytes(part.column("text"))
                d, h, c = shingles(data, off)
                sig = signatures(d, h, c, part.num_rows, BANDS * ROWS)
                keys = band_keys(sig, BANDS, ROWS).view(np.int64)
                some = np.bincount(d, minlength=part.num_rows) > 0
                at = np.append(0, np.cumsum(some * BANDS)).astype(np.int32)
                short = pa.ListArray.from_arrays(pa.array(at * ROWS), pa.array(sig[some].ravel().astype(np.uint16).view(np.int16)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k1"), part.column("k2"), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].ravel())), short],
                                                 ["doc_id", "k1", "k2", "keys", "sig"])
                i = j
    return docs.select("doc_id", *text_key(F.col("text")), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 bigint, k2 bigint, keys array<bigint>, sig array<smallint>")


def matches(least: float) -> int:
    """Registers in which signatures agree, but for one pair of that similarity in a million."""
    m = BANDS * ROWS
    return math.floor(m * least - 4.9 * math.sqrt(m * least * (1 - least)))


def likely(a: Column, b: Column, least: float) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) >= matches(least)


class Bags:
    """The multisets of some texts."""

    def __init__(self, text: pa.Array):
        data, off = pk.text_bytes(text)
        doc, self.h, self.count = shingles(data, off)
        self.first = np.searchsorted(doc, np.arange(off.size))
        self.total = np.bincount(doc, self.count, off.size - 1)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among ``rows``, hash, count) of everything that the rows hold."""
        n = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(rows.size), n), self.h[at], self.count[at]


def weighted_jaccard(a: Bags, i: np.ndarray, b: Bags, j: np.ndarray) -> np.ndarray:
    """Similarity of text ``i`` of ``a`` and text ``j`` of ``b``, pair by pair."""
    out = []
    for k in range(0, i.size, PAIRS):
        x, y = i[k: k + PAIRS], j[k: k + PAIRS]
        (p, h, c), (q, g, d) = a.pick(x), b.pick(y)
        p, c = np.append(p, q), np.append(c, d)
        v = pk.mix(np.append(h, g) ^ pk.mix(p.astype(U) + U(1)))
        order = np.argsort(v)
        same = v[order][1:] == v[order][:-1]
        one, two = order[:-1][same], order[1:][same]
        low = np.bincount(p[one], np.minimum(c[one], c[two]), x.size)
        out.append(low / np.maximum(a.total[x] + b.total[y] - low, 1))
    return np.concatenate(out) if out else np.zeros(0)


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have at least that similarity."""
    j = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PAIRS):
                part = batch.slice(k, PAIRS)
                at = np.arange(part.num_rows)
                yield part.select(["a", "b"]).filter(pa.array(weighted_jaccard(Bags(part.column("ta")), at, Bags(part.column("tb")), at) >= least))
    return j.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def compared(rest: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The links (a, b) among all members of different components of each bucket of ``rest`` (key, node, root, block).

    Buckets are compared block by block, so a task holds two blocks at a time and only links leave it. A pair that shares several
    buckets is compared in the first of them.
    """
    m = rest.join(texts, "node").groupBy("key", "block").agg(F.collect_list(F.struct("node", "root", "keys", "sig", "text")).alias("m"))
    two = m.join(m.select(F.col("key").alias("key2"), F.col("block").alias("block2"), F.col("m").alias("m2")), (F.col("key") == F.col("key2")) & (F.col("block") <= F.col("block2")))
    enough = matches(least)

    def members(x: pa.Array):
        node, root = x.field("node").to_numpy(), x.field("root").to_numpy()
        keys, sig = x.field("keys").flatten().to_numpy().reshape(len(x), BANDS), x.field("sig").flatten().to_numpy().reshape(len(x), BANDS * ROWS)
        return node, root, keys, sig, Bags(x.field("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, alone = batch.column("key")[k].as_py(), batch.column("block")[k].as_py() == batch.column("block2")[k].as_py()
                na, ra, ka, sa, bags_a = members(batch.column("m")[k].values)
                nb, rb, kb, sb, bags_b = members(batch.column("m2")[k].values)
                band = int(np.argmax(ka[0] == key))
                found = []
                for x in range(na.size):
                    near = (rb != ra[x]) & ((sb == sa[x]).sum(axis=1) >= enough) & ~(kb[:, :band] == ka[x, :band]).any(axis=1)
                    if alone:
                        near[: x + 1] = False
                    y = np.flatnonzero(near)
                    y = y[weighted_jaccard(bags_a, np.full(y.size, x), bags_b, y) >= least]
                    found.append(np.stack([np.full(y.size, na[x]), nb[y]]))
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
    return two.select("key", "block", "m", "block2", "m2").mapInArrow(run, "a bigint, b bigint").distinct()


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its rows are worth."""
    return df.coalesce(max(1, math.ceil(rows / PART_ROWS)))


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(node, root) for every node of about ``rows`` edges (a, b), by alternating large and small stars; every round is a written table."""
    e = save(few(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), rows), "edges")
    before = None
    while True:
        # every edge points to the least neighbour of its lower end, then every node to its least lower neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        e = save(few(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows), "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def links(buckets: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame | None:
    """Roots (node, root) of the nodes that verified pairs connect; ``buckets`` has key, node, degree and sig.

    In each of STARS rounds every bucket takes a leader and compares it with its members of other components; members once
    joined need no further pair. First the leader is the member that shares most buckets, like the text that copies were made of,
    then any. What is then still apart in a bucket is compared block by block, so no link is lost.
    """
    roots, edges, n_edges = None, None, 0
    for turn in range(STARS + 1):
        b = buckets if roots is None else buckets.join(roots, "node", "left")
        b = b.select("key", "node", "degree", "sig", F.coalesce("root", "node").alias("root") if roots is not None else F.col("node").alias("root"))
        first = F.struct(F.col("degree") if turn == 0 else F.xxhash64(F.lit(turn), "node", "key"), F.col("node"), F.col("root"), F.col("sig"))
        mixed = b.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.max(first).alias("lead")).where("lo <> hi")
        if turn < STARS:
            lead = mixed.select(F.col("key").alias("key2"), F.col("lead.node").alias("other"), F.col("lead.root").alias("oroot"), F.col("lead.sig").alias("osig"))
            p = b.join(lead, (F.col("key") == F.col("key2")) & (F.col("root") != F.col("oroot")) & likely(F.col("sig"), F.col("osig"), least))
            p = p.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
            e = verified(p, texts, least)
        else:
            rest = b.join(mixed.select("key", "n"), "key").select("key", "node", "root", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("block"))
            e = compared(rest, texts, least)
        e = save(e, f"links-{turn}")
        edges = e if edges is None else edges.unionByName(e)
        found = e.count()
        if found:
            n_edges += found
            roots = components(edges, n_edges)
    return roots


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, k1, k2, class_id, kept) per row of ``docs`` (doc_id, text, ...).

    ``class_id`` is the least doc_id of the documents that are equal or linked by pairs of at least that similarity; ``kept``
    marks the one text that stays for its class. Null, empty and wordless texts are classes of their own, with their own id,
    and kept. A class whose ids are all null has a null class_id. Repeated rows are members of one class and marked
    alike. Texts are read whole. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    s = save(signed(docs), "signatures")
    u = s.where(F.size("keys") > 0).groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    u = save(ranked(u, [F.col("k1"), F.col("k2")], "texts", "node"), "nodes")
    b = u.select("node", F.explode("keys").alias("key"))
    b = save(b.join(b.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared-keys")
    degree = save(b.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    b = save(b.select("key", "node").join(degree, "node").join(u.select("node", "sig"), "node"), "buckets")
    active = degree.select("node").join(u.select("node", "k1", "k2"), "node")
    n = degree.count()
    roots = None
    if n:
        t = docs.where("text is not null").select(*text_key(F.col("text")), "text")
        t = t.join(hinted(active, n, BROADCAST_ROWS), ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text")).join(u.select("node", "keys", "sig"), "node")
        roots = links(b, save(t, "active-texts"), least)
    r = u.select("node", "k1", "k2", "id")
    r = r.withColumn("root", F.col("node")) if roots is None else r.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    head = r.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "node")).alias("h"))
    c = r.join(head, "root").select("k1", "k2", F.col("h.id").alias("class_id"), (F.col("node") == F.col("h.node")).alias("first"), F.lit(True).alias("some"))
    out = s.withColumn("worded", F.size("keys") > 0).join(c, ["k1", "k2"], "left")
    return out.select("doc_id", "k1", "k2", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(F.col("worded"), F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).otherwise(True).alias("kept"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` without all but one document of each class; of rows repeated in every column one stays."""
    c = save(classes(docs, least), "classes")
    gone = c.where(~F.col("kept")).groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("n"))
    twice = c.where("kept").groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    mark = save(gone.select("doc_id", "k1", "k2", F.lit(0).alias("_m")).unionByName(twice.select("doc_id", "k1", "k2", F.lit(2).alias("_m"))), "marks")
    mark = mark.select(F.col("doc_id").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), "_m")
    k1, k2 = text_key(F.col("text"))
    mark = hinted(mark, mark.count(), BROADCAST_ROWS)
    d = docs.withColumns({"_k1": k1, "_k2": k2}).join(mark, (F.col("_k1") == F.col("_1")) & (F.col("_k2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    once = d.where("_m is null").select(*docs.columns)
    worded = d.where("_m = 2").select(*docs.columns)
    return once.unionByName(worded.dropDuplicates(["doc_id", "text"]))


@query("op4_bagminhash_classes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
