"""Suffix-array dedup: repeated byte strings by blockwise suffix sorting with a difference cover.

The suffixes that matter are the windows of ``WINDOW`` bytes. Each window belongs to its anchor, the gram of least hash in
it, so equal windows meet in one bucket at the same distance from equal anchors, and windows whose anchor occurs once
are unique. A bucket holds, for each run of windows of one anchor, the text they cover. Inside it the suffixes are sorted one
suffix bucket at a time, a suffix bucket being the windows at one distance from their anchors. Ranks of the strings at the
positions of a difference cover are made beforehand; a suffix is sorted by its few bytes before its next
cover position and after the ranked string, and the rank there settles the long tie. So memory is
that of a bucket, whatever the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm import packing as pk
from gridpace.llm.common import partitions, query, table

WINDOW = 100  # bytes of a repeat
GRAM = 24  # bytes of an anchor
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31  # every difference modulo 31 is one of two members
BUCKET_RUNS = 1 << 17  # runs per bucket if all text were repeated
HOT = 1 << 14  # an anchor with as many occurrences has its windows dealt out one by one, by their hashes
SEGMENT = 1 << 18  # bytes hashed at a time
ROWS = 1 << 12  # strings that are laid out at a time
U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of every run of GRAM = 24 bytes, by doubling."""
    power = lambda n: U(pow(int(pk.Q), n, 1 << 64))
    x = {1: pk.LUT[data]}
    for n in (1, 2, 4, 8):
        x[2 * n] = x[n][:-n] * power(n) + x[n][n:]
        if n < 8:
            del x[n]
    h = x[16][:-8] * power(8) + x[8][16:]
    h ^= h >> U(32)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    return h


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    n, m = 1, x
    while 2 * n <= k:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: x.size - k + 1], m[k - n: k - n + x.size - k + 1])


def anchored(data: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows inside documents that share an anchor: first start, number, place of the anchor, its hash."""
    span, size = window - GRAM + 1, data.size
    inside = np.zeros(size, bool)
    fits = off[1:] - off[:-1] >= window
    for a, b in zip(off[:-1][fits], off[1:][fits]):
        inside[a: b - window + 1] = True
    out = [[], [], [], []]
    for a in range(0, size - window + 1, SEGMENT):
        b = min(a + SEGMENT, size - window + 1)
        h = gram_hashes(data[a: b + window - 1])
        key = (h & U(0xFFFFFFFF00000000)) | np.arange(h.size, dtype=U)  # the least hash, the first of equal ones
        at = (sliding_min(key, span) & U(0xFFFFFFFF)).astype(np.int64)
        i = np.flatnonzero(inside[a:b])
        if not i.size:
            continue
        p = at[i]
        head = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)))
        out[0].append(i[head] + a), out[1].append(np.diff(np.append(head, i.size))), out[2].append(p[head] + a), out[3].append(pk.mix(h[p[head]]))  # mixed, as least hashes are all small
    return tuple(np.concatenate(x) if x else np.zeros(0, U if k == 3 else np.int64) for k, x in enumerate(out))


def window_hashes(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The hash of the window at each of the sorted starts."""
    out, i = np.empty(at.size, U), 0
    while i < at.size:
        a = int(at[i])
        j = int(np.searchsorted(at, a + SEGMENT))
        part = pk.LUT[data[a: int(at[j - 1]) + window]]
        up, down = pk.powers(part.size + 1)
        total = np.append(U(0), np.cumsum(part * up[: part.size]))
        k = at[i:j] - a
        out[i:j] = pk.mix((total[k + window] - total[k]) * down[k])
        i = j
    return out


def aligned(body: np.ndarray, begin: np.ndarray, length: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes with the string of ``length`` from ``begin`` at ``column``; ROWS at a time, as indices take 8 bytes for each byte."""
    rows = np.zeros((length.size, width), np.uint8)
    for i in range(0, length.size, ROWS):
        n = length[i: i + ROWS]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows[i: i + ROWS][np.repeat(np.arange(n.size), n), np.repeat(column[i: i + ROWS], n) + within] = body[np.repeat(begin[i: i + ROWS], n) + within]
    return rows


def cover_ranks(rows: np.ndarray, length: int, columns: range) -> dict[int, np.ndarray]:
    """For every cover position among ``columns``: the rank of each row's string of ``length`` from there."""
    out = {}
    for c in columns:
        if c % PERIOD not in COVER:
            continue
        strings = np.ascontiguousarray(rows[:, c: c + length])
        enc = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(rows), [None, pa.py_buffer(strings)]).dictionary_encode()
        order = pc.sort_indices(enc.dictionary.cast(pa.binary())).to_numpy()
        rank = np.empty(order.size, np.uint64)
        rank[order] = np.arange(order.size, dtype=np.uint64)
        out[c] = rank[enc.indices.to_numpy()]
    return out


def repeated(rows: np.ndarray, offset: np.ndarray, length: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which windows of each row also start earlier.

    ``rows`` are aligned on their anchors, at column ``window - GRAM``, and sorted by (doc, at), the place of the anchor;
    ``offset`` is the anchor's place in the row's text. Column s of the result is the window from column s.
    """
    lead = window - GRAM
    gap = max(b - a for a, b in zip(COVER, [*COVER[1:], PERIOD]))
    ranked = window - gap + 1  # what is ranked fits in every window behind its first cover position
    rank = cover_ranks(rows, ranked, range(0, lead + gap))
    flags = np.zeros((len(rows), lead + 1), bool)
    for s in range(lead + 1):  # one suffix bucket
        sel = np.flatnonzero((lead - offset <= s) & (lead - offset + length >= s + window))
        if sel.size < 2:
            continue
        c = next(x for x in range(s, s + gap) if x % PERIOD in COVER)
        rest = np.zeros((sel.size, 12), np.uint8)
        few = np.hstack([rows[sel, s:c], rows[sel, c + ranked: s + window]])
        rest[:, : few.shape[1]] = few
        k1 = np.ascontiguousarray(rest[:, :8]).view(">u8").ravel().astype(U)
        k2 = (np.ascontiguousarray(rest[:, 8:]).view(">u4").ravel().astype(U) << U(32)) | rank[c][sel]
        order = np.lexsort((k2, k1))  # stable: the earliest of equal windows stays first
        a, b, o = k1[order], k2[order], sel[order]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        of = o[np.repeat(head, np.diff(np.append(head, o.size)))]
        flags[o, s] = (doc[o] != doc[of]) | (at[o] != at[of])
    return flags


def covered(size: int, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes lie under any of the strings."""
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, pos, 1)
    np.add.at(depth, pos + length, -1)
    np.cumsum(depth, out=depth)
    return depth[:-1] > 0


def flags_in(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags each slice has; no running sum, which would take 8 bytes for each flag."""
    return np.fromiter((np.count_nonzero(flags[a:b]) for a, b in zip(off[:-1], off[1:])), np.int64, off.size - 1)


def flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of every run of set flags."""
    d = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(d == 1)
    return row, a, np.nonzero(d == -1)[1] - a


SENT = "bucket bigint, chunk bigint, body binary, len binary, off binary, doc binary, start binary, pos binary"


def removal(docs: DataFrame, window: int = WINDOW, common: int = HOT, in_place: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes, n_removed, n_spans and kept_bytes; clashing columns are replaced.

    Texts are UTF-8 bytes. A byte goes if any string of ``window`` bytes over it also starts earlier: in a smaller doc_id,
    or earlier in the same document. A null id is the smallest; rows that repeat an id are one document to that rule: equal
    starts are not earlier. Null, empty and short texts lose nothing; a null text is empty. ``n_spans`` counts
    maximal removed runs. Texts are read whole, a chunk of about CHUNK_BYTES or one longer document at a
    time. An empty table gives no rows. Windows whose anchor occurs ``common`` times or more are compared by 64-bit hashes, so that no bucket
    gathers them; the result is the same. With ``in_place`` what is kept replaces the text, whole characters only, and kept_bytes is empty.
    """
    if not 2 * PERIOD + GRAM <= window <= 255 - window + GRAM:
        raise ValueError("the window must be from 86 to 139 bytes")
    made = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    docs = docs.select(*[c for c in docs.columns if c not in (*made, "_chunk")])
    cols = docs.columns
    dealt, total = pk.chunked(docs)
    buckets = max(partitions(docs.sparkSession), math.ceil(total / 39 / BUCKET_RUNS))
    lead = window - GRAM

    def keys(h: np.ndarray) -> np.ndarray:
        return (pk.bucket_of(h, buckets) << U(32)) | (h & U(0xFFFFFFFF))

    def slices(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), bucket.size) if bucket.size else np.zeros(1, np.int64)
        return bucket[at[:-1]].astype(np.int64), at

    def anchors(t: pa.Table) -> pa.Table:
        _, _, place, h = anchored(*pk.text_bytes(t.column("text")), window)
        h = h[np.append(True, place[1:] != place[:-1])] if place.size else h
        key, count = np.unique(keys(h), return_counts=True)
        bucket, cut = slices(key >> U(32))
        return pa.table({"bucket": bucket, "chunk": np.full(bucket.size, t.column("_chunk")[0].as_py(), np.int64),
                         "h": pk.binary(key.astype(np.uint32), cut), "n": pk.binary(count.astype(np.uint32), cut)})

    def counts(t: pa.Table) -> pa.Table:
        h, sizes = pk.unbinary(t.column("h"), np.uint32)
        n, _ = pk.unbinary(t.column("n"), np.uint32)
        _, inv = np.unique(h, return_inverse=True)
        total = np.bincount(inv, n)[inv]
        kept, rows, cut = pk.pick(h, sizes, total >= 2)
        t = t.select(["bucket", "chunk"]).take(pa.array(rows))
        return pa.table({"bucket": t.column("bucket"), "chunk": t.column("chunk"), "h": pk.binary(kept, cut), "hot": pk.binary((total >= common)[total >= 2].astype(np.uint8), cut)})

    def sent(chunk: int, bucket: np.ndarray, cut: np.ndarray, **values) -> pa.Table:
        """Rows to the buckets; ``body`` is given with its own slices."""
        none = pa.nulls(bucket.size, pa.binary())
        body = values.pop("body", none)
        made = {"bucket": bucket, "chunk": np.full(bucket.size, chunk, np.int64), "body": body}
        return pa.table(made | {k: pk.binary(values[k], cut) if k in values else none for k in ("len", "off", "doc", "start", "pos")})

    def runs(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows or not hits.num_rows:
            return sent(0, np.zeros(0, np.int64), np.zeros(1, np.int64))
        t = pk.in_order(t)
        chunk = t.column("_chunk")[0].as_py()
        data, off = pk.text_bytes(t.column("text"))
        first, n, place, h = anchored(data, off, window)
        low, sizes = pk.unbinary(hits.column("h"), np.uint32)
        known = (np.repeat(hits.column("bucket").to_numpy().astype(U), sizes) << U(32)) | low
        order = np.argsort(known)
        known, hot = known[order], pk.unbinary(hits.column("hot"), np.uint8)[0][order]
        key = keys(h)
        k = np.minimum(np.searchsorted(known, key), known.size - 1)
        found = known[k] == key
        doc_of = np.searchsorted(off, first, "right") - 1
        doc = pk.ids(t)
        parts, again, n_again = [], [], []
        # strings: every distinct one once, at its first place in the chunk
        sel = np.flatnonzero(found & (hot[k] == 0))
        raw, seen, lone = data.tobytes(), {}, []
        for i in sel:
            a = first[i]
            j = seen.setdefault(raw[a: a + n[i] + window - 1], i)
            if j == i:
                lone.append(i)
            elif doc[doc_of[j]] != doc[doc_of[i]] or first[j] - off[doc_of[j]] != a - off[doc_of[i]]:
                again.append(a), n_again.append(n[i])
            else:
                lone.append(i)
        del seen  # before the strings are copied once more
        if lone:
            i = np.array(lone)
            i = i[np.argsort(pk.bucket_of(h[i], buckets), kind="stable")]
            bucket, cut = slices(pk.bucket_of(h[i], buckets))
            at = np.append(0, np.cumsum(n[i] + window - 1))
            joined = b"".join(raw[first[x]: first[x] + n[x] + window - 1] for x in i)
            body = pk.binary(np.frombuffer(joined, np.uint8), at[cut])
            parts.append(sent(chunk, bucket, cut, body=body, len=(n[i] + window - 1).astype(np.uint8), off=(place[i] - first[i]).astype(np.uint8), doc=doc[doc_of[i]],
                              start=(place[i] - off[doc_of[i]]).astype(np.uint32), pos=first[i].astype(np.uint32)))
        # windows of very common anchors: each by its own hash
        i = np.flatnonzero(found & (hot[k] == 1))
        if i.size:
            at = np.repeat(first[i] - (np.cumsum(n[i]) - n[i]), n[i]) + np.arange(int(n[i].sum()))
            w = window_hashes(data, at, window)
            d = np.searchsorted(off, at, "right") - 1
            order = np.argsort(w, kind="stable")
            ws = w[order]
            head = np.flatnonzero(np.append(True, ws[1:] != ws[:-1]))
            of = order[np.repeat(head, np.diff(np.append(head, ws.size)))]
            dup = np.zeros(w.size, bool)
            dup[order] = (doc[d[order]] != doc[d[of]]) | (at[order] - off[d[order]] != at[of] - off[d[of]])
            gone = at[dup]
            cut = np.flatnonzero(np.append(True, gone[1:] != gone[:-1] + 1)) if gone.size else np.zeros(0, np.int64)
            again += gone[cut].tolist()
            n_again += np.diff(np.append(cut, gone.size)).tolist()
            order = order[~dup[order]]
            bucket, cut = slices(pk.bucket_of(w[order], buckets))
            parts.append(sent(chunk, bucket + buckets, cut, body=pk.binary(w[order], cut), doc=doc[d[order]], start=(at[order] - off[d[order]]).astype(np.uint32), pos=at[order].astype(np.uint32)))
        if again:
            parts.append(sent(chunk, np.array([-1 - chunk]), np.array([0, len(again)]), pos=np.array(again, np.uint32), len=np.array(n_again, np.uint32)))
        return pa.concat_tables(parts) if parts else sent(0, np.zeros(0, np.int64), np.zeros(1, np.int64))

    def answer(chunk: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.Table:
        order = np.argsort(chunk, kind="stable")
        who, cut = slices(chunk[order])
        return pa.table({"chunk": who, "pos": pk.binary(pos[order].astype(np.uint32), cut), "n": pk.binary(n[order].astype(np.uint32), cut)})

    def later(t: pa.Table) -> pa.Table:
        bucket, chunk = t.column("bucket")[0].as_py(), t.column("chunk").to_numpy()
        if bucket < 0:
            return pa.table({"chunk": chunk, "pos": t.column("pos"), "n": t.column("len")})
        doc, sizes = pk.unbinary(t.column("doc"), np.int64)
        at, pos = pk.unbinary(t.column("start"), np.uint32)[0].astype(np.int64), pk.unbinary(t.column("pos"), np.uint32)[0].astype(np.int64)
        who = np.repeat(chunk, sizes)
        if bucket >= buckets:
            h = pk.unbinary(t.column("body"), U)[0]
            order = np.lexsort((at, doc, h))
            head = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            of = order[np.repeat(head, np.diff(np.append(head, h.size)))]
            dup = order[(doc[order] != doc[of]) | (at[order] != at[of])]
            dup.sort()
            return answer(who[dup], pos[dup], np.ones(dup.size, np.int64))
        length, offset = (pk.unbinary(t.column(c), np.uint8)[0].astype(np.int64) for c in ("len", "off"))
        body, _ = pk.unbinary(t.column("body"), np.uint8)
        order = np.lexsort((at, doc))  # the strings by the place of their anchors
        begin = (np.cumsum(length) - length)[order]
        doc, at, pos, who, length, offset = (x[order] for x in (doc, at, pos, who, length, offset))
        width = 2 * lead + GRAM + 2
        rows = aligned(body, begin, length, lead - offset, width)
        rows[:, -2], rows[:, -1] = length, offset
        code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).dictionary_encode().indices.to_numpy()
        _, one = np.unique(code, return_index=True)  # codes count up by first appearance, so these are in order
        of = one[code]
        whole = (doc != doc[of]) | (at != at[of])
        flags = repeated(rows[one], offset[one], length[one], doc[one], at[one], window)
        row, a, n = flag_runs(flags)
        # runs of the first places, also for rows that repeat a document
        own = np.flatnonzero(~whole)
        lo, hi = np.searchsorted(row, code[own]), np.searchsorted(row, code[own], "right")
        pick = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
        own = np.repeat(own, hi - lo)
        w = np.flatnonzero(whole)
        return answer(np.append(who[w], who[own]), np.append(pos[w], pos[own] + a[pick] - (lead - offset[own])), np.append(length[w] - window + 1, n[pick]))

    def remove(t: pa.Table, repeats: pa.Table) -> pa.Table:
        t = pk.in_order(t) if t.num_rows else t
        data, off = pk.text_bytes(t.column("text"))
        gone = np.zeros(data.size, bool)
        if repeats.num_rows and t.num_rows:
            pos, n = (pk.unbinary(repeats.column(c), np.uint32)[0].astype(np.int64) for c in ("pos", "n"))
            gone = covered(data.size, pos, n + window - 1)
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = off[(off > 0) & (off < data.size)]
        head[inner] = gone[inner]
        n_gone, n_head = flags_in(gone, off), flags_in(head, off)
        held = pk.binary(data[~gone], np.append(0, np.cumsum(np.diff(off) - n_gone)))
        out = t.select(cols)
        if in_place:
            text = [b.as_py().decode("utf-8", "ignore") if x.is_valid else None for b, x in zip(held, t.column("text"))]
            held = pa.array([b""] * len(held), pa.binary())
            out = out.set_column(cols.index("text"), "text", pa.array(text, pa.string()))
        out = out.append_column("n_bytes", pa.array(np.diff(off), pa.int64())).append_column("n_removed", pa.array(n_gone))
        return out.append_column("n_spans", pa.array(n_head)).append_column("kept_bytes", held)

    by_chunk = dealt.groupBy("_chunk")
    counted = by_chunk.applyInArrow(anchors, "bucket bigint, chunk bigint, h binary, n binary").groupBy("bucket").applyInArrow(counts, "bucket bigint, chunk bigint, h binary, hot binary")
    strings = by_chunk.cogroup(counted.groupBy("chunk")).applyInArrow(runs, SENT)
    repeats = strings.groupBy("bucket").applyInArrow(later, "chunk bigint, pos binary, n binary")
    long = F.lit(0).cast("bigint")
    schema = docs.select("*", long.alias("n_bytes"), long.alias("n_removed"), long.alias("n_spans"), F.lit(b"").alias("kept_bytes")).schema
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(remove, schema)


def shortened(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated bytes cut from their text, and with what is left of a cut character; other columns stay.

    A null text stays null.
    """
    return removal(docs, window, in_place=True).select(*docs.columns)


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
