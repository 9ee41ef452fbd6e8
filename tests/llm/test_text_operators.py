"""Byte and word dedup, decontamination and near-dedup against plain versions, on texts made to repeat."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from gridpace.llm import anchors, bagminhash, decontaminate, suffixes

SCHEMA = "doc_id long, text string"


def made_texts(seed: int, words: int, parts: int, most: int) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(words)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(1, most))] for _ in range(parts)]
    return [r.choice([" ", "\n"]).join(w for _ in range(r.randint(0, 4)) for w in r.choice(passages)) for _ in range(60)]


EDGES = [(None, "null id " * 30), (7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "x" * 5000), (12, "ab " * 2000), (13, "null id " * 30), (13, "null id " * 30)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs():
    texts = made_texts(1, 400, 12, 60) + made_texts(2, 5, 6, 90)
    return EDGES + [(i + 100, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("common", [suffixes.HOT, 3])
def test_suffixes(spark, docs, common):
    df = spark.createDataFrame(docs, SCHEMA)
    got = suffixes.removal(df.withColumns({"n_removed": F.lit("old"), "_chunk": F.lit(1)}), common=common)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    assert rows(got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256))) == sorted(brute.byte_dedup(docs), key=repr)


def test_suffixes_shortened(spark):
    text = "é" * 200
    out = dict(rows(suffixes.shortened(spark.createDataFrame([(1, text), (2, text + "x"), (3, None)], SCHEMA))))
    assert out == {1: "é" * 50, 2: "x", 3: None} or (out[2], out[3]) == ("x", None) and set(out[1]) == {"é"}


def test_anchors(spark, docs):
    got = anchors.removal(spark.createDataFrame(docs, SCHEMA).withColumn("kept_text", F.lit(1)))
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"]
    assert rows(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == sorted(brute.word_dedup(docs), key=repr)


def test_decontamination(spark, docs):
    r = random.Random(3)
    items = [(None, docs[20][1]), (1, None), (2, ""), (3, "Null  ID"), (4, "One."), (5, "absent words here")]
    items += [(10 + i, t[: r.randint(0, 300)]) for i, (_, t) in enumerate(docs[9:40:3])] + [(10, (docs[9][1] or "")[:50])]
    got = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA).withColumn("n_hit", F.lit("old")), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got.drop("text")) == sorted(brute.contamination(docs, items), key=repr)
    shuffled = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=0)
    assert rows(shuffled.drop("text")) == rows(got.drop("text"))


def test_near_duplicates(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs, base = [], [[r.choice(words) for _ in range(r.randint(3, 150))] for _ in range(25)]
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "..."), (203, "tic " * 300), (204, "tic " * 350), (205, "Tic " * 700), (206, "a b"), (207, "A, B!")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = bagminhash.classes(df)
    assert {r_["doc_id"]: r_["class_id"] for r_ in got.collect()} == brute.near_classes(docs)
    kept = bagminhash.keep_one(df.unionByName(df.where("doc_id < 30")).withColumn("class_id", F.lit("own")))
    assert kept.columns == ["doc_id", "text", "class_id"]
    assert sorted(x[0] for x in kept.select("doc_id").collect()) == sorted(set(brute.near_classes(docs).values()))


def test_near_duplicates_that_stay_apart_after_the_stars(spark):
    docs = [(i, t) for i, t in enumerate(["a b c d e f g h"] * 2)]
    df = spark.createDataFrame([(5, 1, 9, [1] * 96), (5, 2, 3, [1] * 96), (5, 3, 3, [1] * 96)], "key long, node long, degree long, sig array<smallint>")
    texts = spark.createDataFrame([(1, "p q r s t u", [5] * 24, [1] * 96), (2, docs[0][1], [5] * 24, [1] * 96), (3, docs[1][1], [5] * 24, [1] * 96)], "node long, text string, keys array<long>, sig array<smallint>")
    assert rows(bagminhash.links(df, texts)) == [(2, 2), (3, 2)]


@pytest.mark.parametrize("n", [1, 3])
def test_components_of_paths(spark, n):
    edges = [(i, i + 1) for i in range(0, 40) if i % (40 // n)]
    roots = dict(rows(bagminhash.components(spark.createDataFrame(edges, "a long, b long"), len(edges))))
    want = {}
    for a, b in edges:
        want.setdefault(a, a)
        want[b] = want[a]
    assert roots == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (suffixes.removal(none), anchors.removal(none), bagminhash.classes(none), bagminhash.keep_one(none), decontaminate.contamination(none, items)):
        assert df.count() == 0
    some = spark.createDataFrame([(1, "a b")], SCHEMA)
    assert not decontaminate.contamination(some, items).first()["contaminated"]
