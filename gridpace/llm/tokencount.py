"""Token counts per section: whole documents encoded once, tokens joined to sections by their byte spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm.common import query, table

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.enc = tiktoken.Encoding("gridpace", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token of the text ends; tokens cover it without gaps."""
        return np.cumsum(self.length[self.enc.encode_to_numpy(text, disallowed_special=())])


def lines(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines, each with its newline; an empty text has none."""
    cut = np.flatnonzero(raw == 10) + 1
    ends = np.append(cut, raw.size) if raw.size and (not cut.size or cut[-1] < raw.size) else cut
    return np.append(0, ends[:-1]) if ends.size else ends, ends


def char_to_byte(raw: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets; those beyond the text are cut to its end."""
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), raw.size)
    return at[np.clip(chars, 0, at.size - 1)]


def allocate(ends: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Tokens per section, tokens that cross a boundary, tokens outside.

    Sections are sorted and disjoint. A token that touches several goes to the one that holds most of its bytes, the
    first of them on a tie; one that touches none is outside.
    """
    begins = np.append(0, ends[:-1]) if ends.size else ends
    first = np.searchsorted(s1, begins, "right")
    last = np.searchsorted(s0, ends, "left") - 1
    where = np.where(last >= first, first, -1)
    several = np.flatnonzero(last > first)
    for t in several:
        i = np.arange(first[t], last[t] + 1)
        where[t] = i[np.argmax(np.minimum(s1[i], ends[t]) - np.maximum(s0[i], begins[t]))]
    edge = (where >= 0) & ((s0[where] > begins) | (s1[where] < ends)) if s0.size else np.zeros(ends.size, bool)
    return np.bincount(where[where >= 0], minlength=s0.size)[: s0.size], int(edge.sum()), int((where < 0).sum())


def token_counts(docs: DataFrame, ranks: dict[bytes, int], sections: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, section_tokens, n_crossing and n_outside; clashing columns are replaced.

    Sections are the lines of the text, or the column named by ``sections``: an array of structs (start, end) in
    characters, end excluded, where null entries and empty spans count 0 tokens and a span that starts before the end of
    an earlier one is cut to start there. ``section_tokens`` follows the order of the sections. Null and empty texts have
    0 tokens. Special strings in a text are plain text. Texts are encoded whole, one row at a time; repeated rows alike. An empty table gives no rows.
    """
    made = ("n_tokens", "section_tokens", "n_crossing", "n_outside")
    keep = [c for c in docs.columns if c not in made]
    docs = docs.select(*keep)
    schema = docs.select("*", F.lit(0).cast("bigint").alias(made[0]), F.array().cast("array<bigint>").alias(made[1]),
                         F.lit(0).cast("bigint").alias(made[2]), F.lit(0).cast("bigint").alias(made[3])).schema

    def given(raw: np.ndarray, spans: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        spans = spans or []
        ok = [i for i, s in enumerate(spans) if s and s["start"] is not None and s["end"] is not None and s["end"] > s["start"]]
        ok.sort(key=lambda i: (spans[i]["start"], i))
        a = char_to_byte(raw, np.array([spans[i]["start"] for i in ok], np.int64))
        b = char_to_byte(raw, np.array([spans[i]["end"] for i in ok], np.int64))
        if a.size:
            a = np.maximum(a, np.append(0, np.maximum.accumulate(b)[:-1]))
        full = b > a
        return a[full], b[full], np.array(ok, np.int64)[full], len(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks)
        for batch in batches:
            text = batch.column("text")
            n, per, crossing, outside = [], [], [], []
            for i in range(batch.num_rows):
                t = text[i].as_py() or ""
                raw, ends = np.frombuffer(t.encode(), np.uint8), enc.ends(t)
                if sections is None:
                    s0, s1 = lines(raw)
                    counts, c, o = allocate(ends, s0, s1)
                else:
                    s0, s1, at, size = given(raw, batch.column(sections)[i].as_py())
                    got, c, o = allocate(ends, s0, s1)
                    counts = np.zeros(size, np.int64)
                    counts[at] = got
                n.append(ends.size), per.append(counts), crossing.append(c), outside.append(o)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(per, pa.list_(pa.int64())), pa.array(crossing, pa.int64()), pa.array(outside, pa.int64())],
                                             [*batch.schema.names, *made])
    return docs.mapInArrow(run, schema)


@query("op5_section_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return token_counts(docs, read_ranks()).drop("text")
