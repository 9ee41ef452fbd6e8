"""Language identification by compression: the language whose dictionary compresses a text best."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm.common import query, table

SAMPLE_DOCS = 400  # training documents per language, expected
SLICE = 1024  # characters taken from each of them, from its middle
DICT_BYTES = 128 << 10  # dictionary per language, at most: about 128 full slices of one-byte letters
FOLDS, FIT_SLICES, FIT_LEAST = 5, 60, 3  # short dictionaries: folds and slices per language that fit a factor, and slices it must win back
LEVEL, SHORT_LEVEL, SHORT = 3, 12, 4096  # zstd levels; texts under SHORT bytes are cheap enough for the higher one
MARGIN = 0.02  # a prediction whose winner saves less than this share over the next is marked rejected
BYTES_PER_NAT = 8.0  # how many bytes saved make the winner e times as likely


def training_slices(train: DataFrame, docs: int = SAMPLE_DOCS, size: int = SLICE) -> dict[str, list[str]]:
    """Slices of about ``docs`` texts per language, drawn by hash: a bounded sample, whatever the table's size."""
    t = train.where("lang is not null and text is not null")
    counts = t.groupBy("lang").agg(F.count("*").alias("n"))
    draw = (F.xxhash64(F.lit("langid"), F.col("doc_id"), F.length("text")).bitwiseAND(F.lit((1 << 31) - 1))) / float(1 << 31)
    picked = (t.join(F.broadcast(counts), "lang").where(draw < docs / F.col("n"))
              .select("lang", F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - size) / 2)).cast("int"), F.lit(size)).alias("t")))
    out: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", F.xxhash64("t"), "t").collect():  # languages x docs x size characters
        out.setdefault(r["lang"], []).append(r["t"])
    return out


class Dictionaries(dict):
    """One raw-content dictionary per language; ``factors`` has, for languages with short ones, what sizes under them count times."""

    def __init__(self, dicts: dict[str, bytes], factors: dict[str, float] | None = None):
        super().__init__(dicts)
        self.factors = factors or {}

    def __reduce__(self):
        return Dictionaries, (dict(self), self.factors)


def dictionaries(slices: dict[str, list[str]], size: int = DICT_BYTES) -> Dictionaries:
    """Every language's own text up to ``size`` bytes; one with less than the longest gets a factor from the training slices."""
    dicts = {k: d for k, v in sorted(slices.items()) if (d := _joined(v, size)).strip()}
    short = sorted((k for k in dicts if len(dicts[k]) < max(map(len, dicts.values()))), key=lambda k: (-len(dicts[k]), k))
    return Dictionaries(dicts, _factors({k: slices[k] for k in dicts}, short, size) if short else {})


def _joined(slices: list[str], size: int) -> bytes:
    return "\n".join(slices).encode()[-size:]


def _factors(slices: dict[str, list[str]], short: list[str], size: int) -> dict[str, float]:
    """What makes up for a short dictionary: the factor with the fewest errors on slices that the dictionaries have not seen.

    Slices of every language, FIT_SLICES at most, are compressed under dictionaries without their fold. All count
    alike, so a factor that takes slices from other languages must win back more; one that wins back under FIT_LEAST is
    left at 1, so a language with a few texts, or mislabelled ones, does not take others' texts.
    """
    rows: list[tuple[str, dict[str, float]]] = []
    for fold in range(FOLDS):
        rest = {k: d for k, v in slices.items() if (d := _joined([t for i, t in enumerate(v) if i % FOLDS != fold], size)).strip()}
        coder = Coder(rest)
        for k, v in slices.items():
            if k in rest:
                rows += [(k, dict(zip(coder.langs, coder.sizes(t)))) for t in v[fold:FIT_SLICES:FOLDS] if any(map(str.isalpha, t))]
    factors: dict[str, float] = {}
    for x in short:
        cuts = []  # at a factor under cut, x takes the slice: a gain if it is its own, a loss if another language had it right
        for k, s in rows:
            others = {o: z * factors.get(o, 1.0) for o, z in s.items() if o != x}
            if x in s and others:
                best = min(others, key=lambda o: (others[o], o))
                cuts.append((others[best] / s[x], (k == x) - (k == best)))
        cuts = sorted(c for c in cuts if c[0] <= 1.0)[::-1]
        net, most, at = 0, FIT_LEAST - 1, 1.0
        for i, (cut, gain) in enumerate(cuts):
            net += gain
            after = cuts[i + 1][0] if i + 1 < len(cuts) else 0.98 * cut
            if net > most and after < cut:
                most, at = net, (cut + after) / 2
        if at < 1.0:
            factors[x] = at
    return factors


class Coder:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, dicts: dict[str, bytes]):
        self.langs = sorted(dicts)
        self.factors = [getattr(dicts, "factors", {}).get(k, 1) for k in self.langs]
        self.order = sorted(range(len(dicts)), key=lambda i: (-len(dicts[self.langs[i]]), i))  # of ties
        self.levels = {}
        for level in (LEVEL, SHORT_LEVEL):
            made = []
            for k in self.langs:
                d = zstandard.ZstdCompressionDict(dicts[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
            self.levels[level] = made

    def sizes(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        return [len(c.compress(raw)) for c in self.levels[SHORT_LEVEL if len(raw) < SHORT else LEVEL]]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        s = [x * f for x, f in zip(self.sizes(text), self.factors)]
        best = min(self.order, key=s.__getitem__)
        score = 1.0 / sum(math.exp(max(-700.0, -(x - s[best]) / BYTES_PER_NAT)) for x in s)
        rest = sorted(s)[1] if len(s) > 1 else None
        return self.langs[best], score, rest is not None and (rest - s[best]) < MARGIN * rest


def identify(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, from the text alone; clashing columns are replaced.

    Null texts and texts without a letter get ``und``, score 0 and rejected, as do all texts where no language was
    learned. A tie goes to the longer dictionary, then to the language first by name, and is rejected: ``rejected`` marks a margin under MARGIN. Texts are
    compressed whole, one row at a time, repeated rows alike. An empty table gives no rows. The dictionaries take
    DICT_BYTES per language and travel with the task.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*keep)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(dicts)
        for b in batches:
            lang, score, rejected = [], [], []
            for i in range(b.num_rows):
                x = coder.judge(b.column("text")[i].as_py())
                lang.append(x[0]), score.append(x[1]), rejected.append(x[2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             [*b.schema.names, "lang_pred", "score", "rejected"])
    return docs.mapInArrow(run, schema)


def held_out() -> "F.Column":
    """The contract's fold: crc32 of the id as text, modulo 3, is 1; a null id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query("op1_compression_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dicts = dictionaries(training_slices(docs.where(~held_out())))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), dicts).drop("text")
