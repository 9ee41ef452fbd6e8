"""Quality classifier: heuristic labellers weighed by expectation-maximisation teach a hashed linear scorer.

Eight heuristics vote good, bad or nothing on every document. Their joint votes are counted over all documents; expectation-
maximisation on those counts estimates how each labeller votes on good and bad documents. The posterior of a
document's votes is its weak label, and a logistic scorer over hashed word shapes is fitted to the weak labels of a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm import packing as pk
from gridpace.llm.common import query, save, table

BAD, GOOD, NONE = 0, 1, 2
BITS = 14  # the scorer has 2**BITS weights
SAMPLE = 6000  # documents that the scorer is fitted to, expected
LEAST = 0.5  # documents that score less are rejected
BATCH_BYTES = 2 << 20  # text read at a time, or one longer document
BLOCK = 100  # words over which different ones are counted
ROUNDS, RATE, DECAY = 300, 0.5, 1e-4
U = np.uint64

# classes of bytes: 0 white space, 1 letter, 2 capital, 3 digit, 4 light and 5 heavy punctuation
CLASS = np.full(256, 5, np.uint8)
CLASS[128:] = 1
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[pk.SPACE] = 0
CLASS[list(b".,;:'\"-()?!")] = 4
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[CLASS == 1], SHAPE[CLASS == 2], SHAPE[CLASS == 3] = ord("a"), ord("A"), ord("0")


class Reading:
    """What a batch of texts shows: counts per document and the words with their shapes."""

    def __init__(self, text: pa.Array):
        data, off = pk.text_bytes(text)
        kind = CLASS[data]
        per = lambda mask: np.diff(np.append(0, np.cumsum(mask))[off])
        self.bytes = np.maximum(np.diff(off), 1)
        self.kinds = [per(kind == k) for k in range(6)]
        same = np.zeros(data.size, bool)
        same[1:] = data[1:] == data[:-1]
        self.doubled = per(same & (kind >= 4))
        self.pipes = per(data == ord("|"))
        begin, end, self.first = pk.words(data, off)
        self.words = np.diff(self.first)
        per_word = lambda x: np.diff(np.append(0, np.cumsum(x))[self.first])
        size = end - begin
        self.length, self.short = per_word(size), per_word(size <= 3)
        h = pk.word_hashes(data, begin, end)
        inner = np.ones(h.size, bool)
        inner[self.first[:-1][self.words > 0]] = False
        self.again = np.append(False, h[1:] == h[:-1])[: h.size] & inner
        self.repeats = per_word(self.again)
        self.doc = np.repeat(np.arange(self.words.size), self.words)
        place = np.arange(h.size) - self.first[self.doc]
        v = pk.mix(h ^ pk.mix((self.doc.astype(U) << U(32)) | (place // BLOCK).astype(U)))
        _, one = np.unique(v, return_index=True)
        self.distinct = np.bincount(self.doc[one], minlength=self.words.size)
        self.known = np.ones(h.size, bool)  # the word has occurred in its block
        self.known[one] = False
        shape = SHAPE[data]
        kept = np.ones(data.size, bool)
        kept[1:] = (shape[1:] != shape[:-1]) | (kind[1:] >= 4)
        kept[begin] = True
        at = np.append(0, np.cumsum(kept))
        self.shapes = pk.word_hashes(shape[kept], at[begin], at[end])

    def votes(self) -> np.ndarray:
        """The votes of each document as one number to base 3; texts without words get none."""
        w, b = np.maximum(self.words, 1), self.bytes
        letters = np.maximum(self.kinds[1] + self.kinds[2], 1)
        some, many = self.words >= 3, self.words >= 20

        def vote(bad, good, where):
            return np.where(~where, NONE, np.where(bad, BAD, np.where(good, GOOD, NONE)))
        cast = [
            vote(self.kinds[5] / b > 0.04, self.kinds[5] / b < 0.01, some),
            vote(self.kinds[2] / letters > 0.5, self.kinds[2] / letters < 0.2, some & (letters >= 20)),
            vote(self.distinct / w < 0.25, self.distinct / w > 0.45, many),
            vote(self.pipes / w > 0.1, self.pipes == 0, some),
            vote(self.doubled / w > 0.1, self.doubled / w < 0.01, some),
            vote((self.length / w < 2.5) | (self.length / w > 12), (self.length / w >= 3) & (self.length / w <= 9), some),
            vote(self.short / w < 0.05, (self.short / w > 0.1) & (self.short / w < 0.7), many),
            vote(self.repeats / w > 0.2, self.repeats / w < 0.05, many),
        ]
        code = np.zeros(w.size, np.int64)
        for v in cast:
            code = code * 3 + v
        return code

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, bucket, value): hashed shapes, pairs of shapes, repeated and known words; of length 1 per document."""
        pair = pk.mix(self.shapes[:-1] * pk.Q + self.shapes[1:]) if self.shapes.size else self.shapes
        inside = self.doc[1:] == self.doc[:-1] if self.doc.size else np.zeros(0, bool)
        repeat, known = self.doc[self.again], self.doc[self.known]
        doc = np.concatenate([self.doc, self.doc[1:][inside], repeat, known])
        h = np.concatenate([self.shapes, pair[inside], np.full(repeat.size, U(1) << U(50)), np.full(known.size, U(2) << U(50))])
        key, count = np.unique((doc << BITS) | (h >> U(64 - BITS)).astype(np.int64), return_counts=True)
        doc, bucket = key >> BITS, key & ((1 << BITS) - 1)
        x = np.sqrt(count)
        return doc, bucket, x / np.sqrt(np.maximum(np.bincount(doc, x * x, self.words.size), 1e-9))[doc]


N_VOTERS = 8


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Reading]]:
    for batch in batches:
        size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BATCH_BYTES, "right")))
            yield batch.slice(i, j - i), Reading(batch.column("text").slice(i, j - i))
            i = j


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per code, accuracy table [labeller, truth, vote], share of good) by expectation-maximisation."""
    votes = np.stack([(codes // 3 ** (N_VOTERS - 1 - k)) % 3 for k in range(N_VOTERS)], axis=1)
    post = 1 / (1 + 9.0 ** ((votes == BAD).sum(axis=1) - 1))  # to begin with, one bad vote is open and two are bad
    table_ = np.zeros((N_VOTERS, 2, 3))
    share = 0.5
    for _ in range(rounds):
        for k in range(N_VOTERS):
            for v in range(3):
                on = votes[:, k] == v
                table_[k, GOOD, v] = (counts * post)[on].sum() + 1
                table_[k, BAD, v] = (counts * (1 - post))[on].sum() + 1
        table_[:, :, NONE] = 0  # no vote says nothing
        table_ /= table_.sum(axis=2, keepdims=True)
        share = ((counts * post).sum() + 1) / (counts.sum() + 2)
        cast = np.where(votes == NONE, GOOD, votes)
        ln = np.log(share / (1 - share)) + sum(np.where(votes[:, k] == NONE, 0, np.log(table_[k, GOOD, cast[:, k]] / table_[k, BAD, cast[:, k]])) for k in range(N_VOTERS))
        post = 1 / (1 + np.exp(-np.clip(ln, -500, 500)))
    return post, table_, share


def train(doc: np.ndarray, bucket: np.ndarray, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer, by full-batch descent with per-weight step sizes."""
    w, g2 = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    for _ in range(ROUNDS):
        z = np.bincount(doc, x * w[bucket], label.size) + w[-1]
        e = (1 / (1 + np.exp(-z)) - label) / max(1, label.size)
        g = np.append(np.bincount(bucket, e[doc] * x, 1 << BITS), e.sum()) + DECAY * w
        g2 += g * g
        w -= RATE * g / np.sqrt(g2)
    return w


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good per vote code, counted over all documents, and the weights fitted to about ``sample`` of them."""
    total = docs.count()
    draw = F.xxhash64(F.lit("quality"), F.col("doc_id"), F.length("text")).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    d = docs.where("text is not null").select("text", (draw < sample / max(total, 1)).alias("drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, r in read_batches(batches):
            worded = r.words > 0
            doc, bucket, x = r.features()
            drawn = batch.column("drawn").to_numpy(zero_copy_only=False)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            feats = [(bucket[cut[i]: cut[i + 1]], x[cut[i]: cut[i + 1]]) if drawn[i] else (None, None) for i in np.flatnonzero(worded)]
            yield pa.RecordBatch.from_arrays([pa.array(r.votes()[worded]), pa.array([f[0] for f in feats], pa.list_(pa.int64())), pa.array([f[1] for f in feats], pa.list_(pa.float64()))], ["code", "bucket", "x"])
    read = save(d.mapInArrow(run, "code bigint, bucket array<bigint>, x array<double>"), "votes")
    counts = read.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").toArrow()  # 3**8 rows at most
    if not counts.num_rows:
        return {}, np.zeros((1 << BITS) + 1)
    codes, n = counts.column("code").to_numpy(), counts.column("n").to_numpy()
    post, _, _ = estimate(codes, n)
    of = dict(zip(codes.tolist(), post.tolist()))
    rows = read.where("bucket is not null").orderBy("code", F.xxhash64("bucket", "x")).toArrow()
    if not rows.num_rows:
        return of, np.zeros((1 << BITS) + 1)
    size = np.diff(rows.column("bucket").combine_chunks().offsets.to_numpy())
    doc = np.repeat(np.arange(size.size), size)
    return of, train(doc, rows.column("bucket").combine_chunks().flatten().to_numpy(), rows.column("x").combine_chunks().flatten().to_numpy(), np.array([of[c] for c in rows.column("code").to_pylist()]))


def score(docs: DataFrame, posterior: dict[int, float], weights: np.ndarray, least: float = LEAST) -> DataFrame:
    """``docs`` with quality_score (the scorer's probability of good), weak_label and rejected; clashing columns are replaced.

    Null, empty and wordless texts have quality_score 0, a null weak_label, and are rejected. Repeated rows are scored
    alike, ``least`` itself is kept. Texts are read whole, a batch of about BATCH_BYTES or one longer document at a time. An empty
    table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("quality_score", "weak_label", "rejected")]
    docs = docs.select(*keep)
    schema = docs.select("*", F.lit(0.0).alias("quality_score"), F.lit(None).cast("double").alias("weak_label"), F.lit(False).alias("rejected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, r in read_batches(batches):
            doc, bucket, x = r.features()
            p = 1 / (1 + np.exp(-(np.bincount(doc, x * weights[bucket], batch.num_rows) + weights[-1])))
            p = np.where(r.words > 0, p, 0.0)
            weak = [posterior.get(c) if n else None for c, n in zip(r.votes().tolist(), r.words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(weak, pa.float64()), pa.array((p < least) | (r.words == 0))], [*batch.schema.names, "quality_score", "weak_label", "rejected"])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the classifier, fitted to them, does not reject, with their own columns."""
    cols = docs.columns
    return score(docs.select("*"), *fit(docs)).where(~F.col("rejected")).select(*cols)


@query("op2_weak_label_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *fit(docs)).drop("text")
