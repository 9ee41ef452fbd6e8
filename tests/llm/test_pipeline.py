"""The pipeline's stages on a small table, each against what it was given."""

import brute

import corpus_pipeline as pipeline
from gridpace.llm.common import save

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, before = docs.columns, docs.count()
    seen = {}
    for name, stage in pipeline.STAGES:
        out = save(stage(spark, docs, SF), name)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == cols
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        seen[name] = (docs, out)
        docs = out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in seen["quality"][1].select("doc_id").collect()}
    assert sum(q == 1 and d not in kept for d, q in labels.items()) == 0 and before > len(kept)
    given, out = ([(r["doc_id"], r["text"]) for r in d.collect()] for d in seen["near-dedup"])
    assert sorted(d for d, _ in out) == sorted(set(brute.near_classes(given).values()))
    given, out = seen["suffix-array"]
    want = {d: (n, r) for d, n, r, _, _ in brute.byte_dedup([(r["doc_id"], r["text"]) for r in given.collect()])}
    for r in out.collect():
        n, removed = want[r["doc_id"]]
        assert n - removed - 6 <= len(r["text"].encode()) <= n - removed and r["n_chars"] == len(r["text"])
    given, out = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.contamination([(r["doc_id"], r["text"]) for r in given.collect()], items) if r[-1]}
    assert {r["doc_id"] for r in given.collect()} - {r["doc_id"] for r in out.collect()} == dirty
    given, out = (d.toPandas() for d in seen["mixing"])
    sizes = given.text.map(lambda t: len(t.split())).groupby(given.source).sum().to_dict()
    taken = out.groupby("source").taken.sum()
    for s, t in brute.mix_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 1
