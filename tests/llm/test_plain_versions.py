"""Language and quality against plain versions that loop over texts; the pipeline's stages on odd tables; texts over 4 MB."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

import corpus_pipeline as pipeline
from gridpace.llm import anchors, bagminhash, decontaminate, langid, mixing, quality, suffixes, tokencount
from gridpace.llm import packing as pk

SF = "/root/testdata/sf0.001"
WORDS = "the of and a to in river stone garden window letter market music winter summer paper".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (f"{r.randint(0, 99)}" if r.random() < 0.1 else "") for _ in range(n))


def plain_language(text, dicts, factors):
    """Sizes by a direct loop over the dictionaries, each compressor made anew."""
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", True
    raw, sizes = text.encode(), {}
    for k, d in dicts.items():
        level = 12 if len(raw) < 4096 else 3
        z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z.precompute_compress(level=level)
        c = zstandard.ZstdCompressor(level=level, dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes[k] = len(c.compress(raw)) * factors.get(k, 1)
    best = min(sizes, key=lambda k: (sizes[k], -len(dicts[k]), k))
    rest = sorted(sizes.values())
    return best, len(rest) > 1 and rest[1] - rest[0] < 0.02 * rest[1]


def test_language_equals_a_loop_over_dictionaries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    dicts = langid.dictionaries(langid.training_slices(docs.where(~langid.held_out())))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, None), (-2, "12 34"), (-3, "x")]
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), dicts).collect()}
    assert got == {d: plain_language(t, dict(dicts), dicts.factors) for d, t in rows}


def plain_votes(text):
    """The eight votes by string operations; 0 bad, 1 good, 2 none."""
    raw = text.encode()
    kind = lambda b: 1 if b >= 128 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 0 if b in b" \t\n\x0b\x0c\r" else 4 if b in b".,;:'\"-()?!" else 5
    kinds = Counter(map(kind, raw))
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    w, b = max(len(words), 1), max(len(raw), 1)
    letters = max(kinds[1] + kinds[2], 1)
    distinct = sum(len(set(words[i: i + 100])) for i in range(0, len(words), 100))
    pipes = raw.count(b"|")
    doubled = sum(x == y and kind(x) >= 4 for x, y in zip(raw, raw[1:]))
    length = sum(map(len, words))
    short = sum(len(x) <= 3 for x in words)
    repeats = sum(x == y for x, y in zip(words, words[1:]))
    some, many = len(words) >= 3, len(words) >= 20
    vote = lambda bad, good, where: 2 if not where else 0 if bad else 1 if good else 2
    return [vote(kinds[5] / b > 0.04, kinds[5] / b < 0.01, some), vote(kinds[2] / letters > 0.5, kinds[2] / letters < 0.2, some and letters >= 20),
            vote(distinct / w < 0.25, distinct / w > 0.45, many), vote(pipes / w > 0.1, pipes == 0, some), vote(doubled / w > 0.1, doubled / w < 0.01, some),
            vote(length / w < 2.5 or length / w > 12, 3 <= length / w <= 9, some), vote(short / w < 0.05, 0.1 < short / w < 0.7, many), vote(repeats / w > 0.2, repeats / w < 0.05, many)]


def plain_em(rows):
    """Posterior of good of each vote list, a document at a time and labeller by labeller."""
    post = [1 / (1 + 9.0 ** (v.count(0) - 1)) for v in rows]
    for _ in range(100):
        share = (sum(post) + 1) / (len(rows) + 2)
        acc = []
        for k in range(8):
            n = {(t, v): 1.0 for t in (0, 1) for v in (0, 1)}
            for p, v in zip(post, rows):
                if v[k] != 2:
                    n[(1, v[k])] += p
                    n[(0, v[k])] += 1 - p
            acc.append({(t, v): n[(t, v)] / (n[(t, 0)] + n[(t, 1)]) for t, v in n})
        post = [1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(math.log(acc[k][(1, x)] / acc[k][(0, x)]) for k, x in enumerate(v) if x != 2)))) for v in rows]
    return post


def test_votes_and_posteriors_equal_plain_ones(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    texts += ["", "   ", "A B", "|| || || ||", "aa aa aa aa " * 10, "ÄÖÜ " * 30, "WORD " * 25]
    import pyarrow as pa
    codes = quality.Reading(pa.array(texts)).votes()
    rows = [plain_votes(t) for t in texts]
    assert [[int(c) // 3 ** (7 - k) % 3 for k in range(8)] for c in codes] == rows
    code, n = np.unique(codes, return_counts=True)
    post, _, _ = quality.estimate(code, n)
    want = dict(zip(codes.tolist(), plain_em(rows)))
    assert np.allclose(post, [want[c] for c in code.tolist()], rtol=0, atol=1e-9)


def test_quality_of_repeated_rows_and_at_the_threshold(spark):
    docs = spark.createDataFrame([(1, prose(1, 60)), (1, prose(1, 60)), (2, prose(2, 80)), (3, "|| || !! || " * 20)], "doc_id long, text string")
    out = quality.score(docs, *quality.fit(docs)).collect()
    assert len(out) == 4 and out[0]["quality_score"] == out[1]["quality_score"]
    same = quality.score(docs, *quality.fit(docs), least=out[0]["quality_score"]).collect()
    assert not same[0]["rejected"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, taken long, size long, class_id long"


@pytest.mark.parametrize("name,stage", pipeline.STAGES, ids=[s[0] for s in pipeline.STAGES])
def test_stages_take_odd_tables(spark, name, stage):
    long = prose(7, 40)
    rows = [(1, None, "en", "a", 0, 7, 7, 7), (2, "", None, None, None, 7, 7, 7), (3, long, "en", "a", len(long), 7, 7, 7), (3, long, "en", "a", len(long), 7, 7, 7),
            (None, prose(8, 50), "en", "b", 5, 7, 7, 7), (4, prose(9, 50), "en", None, 5, 7, 7, 7)]
    docs = spark.createDataFrame(rows, ODD)
    out = stage(spark, docs, SF)
    got = out.collect()
    if name != "mixing":
        assert out.columns == docs.columns and {r["taken"] for r in got} <= {7}
    kept = {r["doc_id"] for r in got}
    assert {3, 4} & kept and kept <= {1, 2, 3, 4, None}
    if name in ("suffix-array", "decontamination"):
        assert len(got) == len(rows)
    if name == "near-dedup":
        assert sum(r["doc_id"] == 3 for r in got) == 1
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_document_of_over_four_megabytes(spark):
    long = prose(1, 800_000)
    assert len(long) > pk.CHUNK_BYTES > quality.BATCH_BYTES
    tail = prose(2, 30)
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, long + " " + tail, "en", "a"), (3, prose(3, 40), "en", "b")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: 800_000, 2: 800_030, 3: 40}
    assert quality.score(docs, *quality.fit(docs)).count() == 3
    classes = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()}
    assert classes[1] == classes[2] != classes[3]
    bench = spark.createDataFrame([("x", " ".join(long.split()[400_000:400_030]))], "item_id string, text string")
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert hits == {1: (800_000, 30, False), 2: (800_030, 30, False), 3: (40, 0, False)}
    short = {r["doc_id"]: r["text"] for r in suffixes.shortened(docs).collect()}
    assert short[1] == long and len(short[2]) <= len(tail) + 1 and tail.endswith(short[2][-20:])
    removed = {r["doc_id"]: r["n_removed"] for r in anchors.removal(docs).collect()}
    assert removed[1] == 0 and removed[2] == 800_000
    assert tokencount.token_counts(docs.where("doc_id <> 2"), tokencount.read_ranks()).count() == 2
