"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``BLOCK`` words; the blocks are indexed by hash and probed with
every rolling run of ``BLOCK`` words. Of two equal windows of ``WINDOW >= 2 * BLOCK - 1`` words each holds a whole
block of itself that the other one probes, so windows without a hit are unique. The hits are extended over all windows
that hold them, those are compared, and all but the first occurrence of each is removed: that
covers maximal repeats exactly, however many documents share them, without listing pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm import packing as pk
from gridpace.llm.common import partitions, query, table

WINDOW = 20  # words of a repeat
BLOCK = 10  # words of an anchor
BUCKET_WINDOWS = 1 << 20  # hashes per bucket, on average
U = np.uint64


def _words(docs: pa.Table):
    data, off = pk.text_bytes(docs.column("text"))
    begin, end, first = pk.words(data, off)
    return data, off, begin, end, first, pk.word_hashes(data, begin, end)


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash and 32 further bits of it, in one number."""
    return (pk.bucket_of(h, buckets) << U(32)) | (h & U(0xFFFFFFFF))


def _slices(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), bucket.size) if bucket.size else np.zeros(1, np.int64)
    return bucket[at[:-1]].astype(np.int64), at


def removal(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_removed and kept_text; clashing columns are replaced.

    A word goes if any window of ``window`` words over it also starts earlier: in a smaller doc_id, or earlier in the same
    document. A null id is the smallest. Rows that repeat an id are one document to that rule: equal starts are not earlier.
    Null, empty and short texts lose nothing, and ``kept_text`` joins the kept words by a space. Whole texts are
    read, a chunk of about CHUNK_BYTES or one longer document at a time. An empty table gives no rows.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must be 2 * block - 1 words at least")
    made = ("n_words", "n_removed", "kept_text")
    docs = docs.select(*[c for c in docs.columns if c not in (*made, "_chunk")])
    cols = docs.columns
    dealt, total = pk.chunked(docs)
    buckets = max(partitions(docs.sparkSession), math.ceil(total / 6 / BUCKET_WINDOWS))

    def probes(t: pa.Table) -> pa.Table:
        _, _, _, _, first, h = _words(t)
        at = pk.starts_within(first, block)
        doc = np.searchsorted(first, at, "right") - 1
        v = (_keys(pk.rolling(h, block)[at], buckets) << U(1)) | ((at - first[doc]) % block == 0).astype(U)
        v.sort()
        last = np.flatnonzero(np.append(v[1:] >> U(1) != v[:-1] >> U(1), True)) if v.size else np.zeros(0, np.int64)
        flag = (v[last] & U(1)).astype(np.uint8) | ((np.diff(last, prepend=-1) > 1).astype(np.uint8) << 1)
        key = v[last] >> U(1)
        bucket, cut = _slices(key >> U(32))
        chunk = t.column("_chunk")[0].as_py()
        return pa.table({"bucket": bucket, "chunk": np.full(bucket.size, chunk, np.int64), "h": pk.binary(key.astype(np.uint32), cut), "flag": pk.binary(flag, cut)})

    def index(t: pa.Table) -> pa.Table:
        h, sizes = pk.unbinary(t.column("h"), np.uint32)
        flag, _ = pk.unbinary(t.column("flag"), np.uint8)
        _, inv, count = np.unique(h, return_inverse=True, return_counts=True)
        blocks = np.bincount(inv, flag & 1, count.size) > 0
        hit = (blocks & (count + np.bincount(inv, flag >> 1, count.size) >= 2))[inv]
        kept, rows, cut = pk.pick(h, sizes, hit)
        t = t.select(["bucket", "chunk"]).take(pa.array(rows))
        return pa.table({"bucket": t.column("bucket"), "chunk": t.column("chunk"), "h": pk.binary(kept, cut)})

    def candidates(t: pa.Table, hits: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "h": pa.array([], pa.binary()), "d": pa.array([], pa.binary()), "s": pa.array([], pa.binary())})
        if not hits.num_rows or not t.num_rows:
            return empty
        t = pk.in_order(t)
        _, _, _, _, first, h = _words(t)
        low, sizes = pk.unbinary(hits.column("h"), np.uint32)
        hot = np.sort((np.repeat(hits.column("bucket").to_numpy().astype(U), sizes) << U(32)) | low)
        at = pk.starts_within(first, block)
        hit = np.zeros(h.size + 1, np.int64)
        hit[at + 1] = pk.is_in(_keys(pk.rolling(h, block)[at], buckets), hot)
        hit = np.cumsum(hit)
        at = pk.starts_within(first, window)
        at = at[hit[at + window - block + 1] > hit[at]]
        if not at.size:
            return empty
        w = pk.rolling(h, window, 1)[at]
        order = np.argsort(w, kind="stable")
        order = order[np.append(True, w[order][1:] != w[order][:-1])]  # the first of each in this chunk
        at, w = at[order], w[order]
        doc = np.searchsorted(first, at, "right") - 1
        bucket, cut = _slices(pk.bucket_of(w, buckets))
        return pa.table({"bucket": bucket, "chunk": np.full(bucket.size, t.column("_chunk")[0].as_py(), np.int64), "h": pk.binary(w, cut),
                         "d": pk.binary(pk.ids(t)[doc], cut), "s": pk.binary((at - first[doc]).astype(np.int64), cut)})

    def later(t: pa.Table) -> pa.Table:
        h, sizes = pk.unbinary(t.column("h"), U)
        d, s = pk.unbinary(t.column("d"), np.int64)[0], pk.unbinary(t.column("s"), np.int64)[0]
        order = np.lexsort((s, d, h))
        hs, ds, ss = h[order], d[order], s[order]
        head = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
        of = np.repeat(head, np.diff(np.append(head, hs.size)))
        after = np.empty(h.size, bool)
        after[order] = (ds != ds[of]) | (ss != ss[of])
        kept, rows, cut = pk.pick(h, sizes, after)
        return pa.table({"chunk": t.column("chunk").take(pa.array(rows)), "h": pk.binary(kept, cut)})

    def remove(t: pa.Table, repeats: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.select(cols).append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("kept_text", pa.array([], pa.string()))
        t = pk.in_order(t)
        data, off, begin, end, first, h = _words(t)
        gone = np.zeros(h.size + 1, np.int64)
        at = pk.starts_within(first, window)
        if at.size:
            w = pk.rolling(h, window, 1)[at]
            hot = np.sort(pk.unbinary(repeats.column("h"), U)[0])
            again = pk.is_in(w, hot)
            order = np.argsort(w, kind="stable")
            ws = w[order]
            head = np.flatnonzero(np.append(True, ws[1:] != ws[:-1]))
            of = order[np.repeat(head, np.diff(np.append(head, ws.size)))]
            doc = np.searchsorted(first, at, "right") - 1
            d, s = pk.ids(t)[doc], at - first[doc]
            again[order] |= (d[order] != d[of]) | (s[order] != s[of])
            np.add.at(gone, at[again], 1)
            np.subtract.at(gone, at[again] + window, 1)
        gone = np.cumsum(gone)[:-1] > 0
        n_gone = np.append(0, np.cumsum(gone))[first]
        raw, kept = data.tobytes(), []
        for i in range(t.num_rows):
            ws = raw[off[i]: off[i + 1]].split()
            if n_gone[i + 1] > n_gone[i]:
                ws = [x for x, g in zip(ws, gone[first[i]: first[i + 1]]) if not g]
            kept.append(b" ".join(ws))
        out = t.select(cols)
        return (out.append_column("n_words", pa.array(np.diff(first), pa.int64())).append_column("n_removed", pa.array(np.diff(n_gone), pa.int64()))
                .append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string())))

    by_chunk = dealt.groupBy("_chunk")
    sent = by_chunk.applyInArrow(probes, "bucket bigint, chunk bigint, h binary, flag binary")
    hits = sent.groupBy("bucket").applyInArrow(index, "bucket bigint, chunk bigint, h binary")
    found = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(candidates, "bucket bigint, chunk bigint, h binary, d binary, s binary")
    repeats = found.groupBy("bucket").applyInArrow(later, "chunk bigint, h binary")
    schema = docs.select("*", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.lit("").alias("kept_text")).schema
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(remove, schema)


SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)),
r as (select doc_id, i, row_number() over (partition by h order by doc_id, i) as rn from g),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from r where rn > 1),
k as (select doc_id, len(w) as n, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from w where len(w) > 0),
kept as (select k.doc_id, count(*) as n_kept, string_agg(x, ' ' order by k.p) as t from k left join gone on k.doc_id = gone.doc_id and k.p = gone.p where gone.p is null group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n_kept, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""


@query("op10_fixed_block_anchors", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
