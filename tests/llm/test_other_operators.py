"""Language, quality, tokens, mixing, urls and neighbours: exact rules, held-out accuracy, recall."""

import math
import random

import brute
import numpy as np
from pyspark.sql import functions as F

from gridpace.llm import langid, mixing, packing, postings, quality, tokencount, urlrep

SF = "/root/testdata/sf0.01"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    out = langid.op1(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    dicts = langid.dictionaries({"x": ["the cat sat on the mat " * 20], "y": ["der hund lief in den wald " * 20]})
    odd = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "123 !", "z"), (4, "der wald und der hund", None), (4, "der wald und der hund", None)], "doc_id long, text string, score string")
    got = [tuple(r) for r in langid.identify(odd, dicts).select("doc_id", "lang_pred", "rejected").collect()]
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "y", False), (4, "y", False)]
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(odd.limit(0), dicts).count() == 0
    assert langid.training_slices(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) == {}


def test_short_languages_neither_shrink_the_others_nor_lose_to_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    slices = langid.training_slices(docs.where(~langid.held_out()))
    sure = docs.where(langid.held_out() & F.col("lang").isNotNull() & (F.length("text") > 100))

    def right(dicts):
        got = langid.identify(sure, dicts).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x"))
        return {r["lang"]: r["x"] for r in got.collect()}
    whole = langid.dictionaries(slices)
    rare = next(iter(slices))
    tiny = langid.dictionaries(slices | {"aa": [slices[rare][0][:20]]})
    assert {k: tiny[k] for k in whole} == dict(whole) and len(tiny["aa"]) <= 80 and "aa" not in tiny.factors
    assert min(right(tiny).values()) > 0.95
    for k in slices:
        few = langid.dictionaries(slices | {k: slices[k][:8]})
        assert len(few[k]) < min(len(few[o]) for o in few if o != k)
        assert min(right(few).values()) > 0.9


def test_quality(spark):
    got = quality.op2(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id")
    right = got.select(F.avg((F.col("rejected") == (F.col("quality") == 0)).cast("int"))).first()[0]
    assert right > 0.97
    assert got.where("quality = 1 and rejected").count() <= 2
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (None, "some plain words", 1)], "doc_id long, text string, rejected int")
    out = quality.score(odd, *quality.fit(odd))
    assert out.columns == ["doc_id", "text", "quality_score", "weak_label", "rejected"]
    assert [r["rejected"] for r in out.collect()][:3] == [True] * 3
    assert quality.score(odd.limit(0), *quality.fit(odd.limit(0))).count() == 0


def test_estimated_accuracies_follow_the_voters():
    r = np.random.default_rng(1)
    truth = r.random(20000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.8])
    votes = np.where(r.random((20000, 8)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[r.random(votes.shape) < 0.2] = quality.NONE
    codes, counts = np.unique(votes @ (3 ** np.arange(7, -1, -1)), return_counts=True)
    post, table, share = quality.estimate(codes, counts)
    assert abs(share - 0.7) < 0.02
    good = table[:, quality.GOOD, quality.GOOD] / table[:, quality.GOOD, :2].sum(axis=1)
    assert np.abs(good - right).max() < 0.03


def test_tokens(spark):
    ranks = tokencount.read_ranks()
    enc = tokencount.Encoder(ranks)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(100)
    for r in tokencount.token_counts(docs, ranks).collect():
        assert r["n_tokens"] == len(enc.enc.encode_ordinary(r["text"])) == sum(r["section_tokens"])
        assert len(r["section_tokens"]) == len(r["text"].splitlines()) or "\r" in r["text"] or "\x0b" in r["text"]
    text, rnd = "Zwölf Boxkämpfer jagen\n\n  Viktor quer über — den großen Sylter Deich. " * 3, random.Random(2)
    spans, at = [], 0
    while at < len(text):
        end = at + rnd.randint(1, 9)
        spans.append((at, end))
        at = end + rnd.choice([0, 0, 2])
    got = tokencount.token_counts(spark.createDataFrame([(1, text, spans), (2, None, spans), (3, "", None), (4, "ab", [(5, 9), None, (1, 1), (0, 2)])],
                                                        "n_tokens int, text string, parts array<struct<start:int,end:int>>"), ranks, "parts").collect()
    ends = enc.ends(text).tolist()
    want, outside = [0] * len(spans), 0
    size = [len(text[:i].encode()) for i in range(len(text) + 1)]
    for a, b in zip([0, *ends], ends):
        over = [max(0, min(b, size[min(e, len(text))]) - max(a, size[min(s, len(text))])) for s, e in spans]
        if max(over):
            want[over.index(max(over))] += 1
        else:
            outside += 1
    assert got[0]["section_tokens"] == want and got[0]["n_outside"] == outside and got[0]["n_tokens"] == len(ends)
    assert [r["n_tokens"] for r in got[1:3]] == [0, 0]
    assert got[3]["section_tokens"] == [0, 0, 0, 1]


def test_mixture(spark):
    r = random.Random(4)
    docs = [(i, " ".join("w" * r.randint(0, 60)) or None, r.choice(["a", "b", "B", "é", None, "tiny"] if i else ["tiny"])) for i in range(400)]
    docs = [(i, t if s != "tiny" else "one two", s) for i, t, s in docs] + [(900, None, "empty"), (901, "x y z", "a"), (901, "x y z", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("target", F.lit("old"))
    out = mixing.mix(df, block_words=50, shard_words=1500)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken", "shards", "order_keys"]
    got = out.toPandas()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute.mix_targets(sizes)
    for s, g in got.groupby(got.source.fillna("~")):
        s = None if s == "~" else s
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= 3
    assert len(got) == len(docs) and (got.taken <= 3 * got["size"]).all()
    copies = -(-got.taken // got["size"].clip(lower=1))
    assert (got.shards.map(len) == copies).all() and (got.order_keys.map(len) == copies).all()
    assert len({s for x in got.shards for s in x}) >= 4
    again = mixing.mix(df.repartition(7), block_words=50, shard_words=1500).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("source = 'empty'")).first()["taken"] == 0


def test_shuffled_joins_of_the_mixture_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * (i % 40), f"s{i % 5}") for i in range(200)], "doc_id long, text string, source string")
    one = mixing.mix(df, 40, 900).drop("order_keys").collect()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(one) == sorted(mixing.mix(df, 40, 900).drop("order_keys").collect())


def test_sources_beyond_one_array(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 2)  # arrays of 4 sources, three levels
    df = spark.createDataFrame([(i, "word " * 20, f"s{i % 37}") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(df, 20, 600).toPandas()
    assert got.taken.sum() == sum(round(t) for t in got.groupby("source").target.first())
    assert (got.shards.map(len) == -(-got.taken // got["size"])).all()


def test_hypergeometric_draws(spark):
    long = lambda n: F.lit(n).cast("long")
    n = 40000
    d = spark.range(n).select(mixing.hypergeometric(long(3), long(7), long(4), mixing._uniform(F.col("id"))).alias("a"),
                              mixing.hypergeometric(long(30000), long(100000), long(50000), mixing._uniform(F.lit(1), F.col("id"))).alias("b"))
    got = d.groupBy("a").count().toPandas().set_index("a")["count"]
    for k, p in enumerate([1 / 35, 12 / 35, 18 / 35, 4 / 35]):
        assert abs(got[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n)
    b = d.select(F.avg("b"), F.variance("b")).first()
    assert abs(b[0] - 15000) < 5 * 72.5 / math.sqrt(n) and abs(b[1] / (50000 * 0.3 * 0.7 * 50000 / 99999) - 1) < 0.05
    edge = spark.range(1).select(*[mixing.hypergeometric(long(g), long(t), long(x), F.lit(0.3)) for g, t, x in ((0, 5, 3), (5, 5, 3), (2, 5, 5), (2, 5, 0), (0, 0, 0))]).first()
    assert tuple(edge) == (0, 3, 2, 0, 0)


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://A.Example.NET/en/x?q"), (2, "https://example.net"), (3, "x://b.net/de/"), (4, "x://example.com/de/1#a"), (5, "x://shop.org/fr/"), (6, None), (7, "no scheme"),
        (8, "http://notexample.com/de/"), (9, "http://h.io?u://z/"), (9, "http://h.io?u://z/"), (10, "://"), (11, "http://bad.io/"), (12, "http://bad.io/x"), (None, "http://bad.io/y")], "page_id long, url string").withColumn("host", F.lit(1))
    labels = spark.createDataFrame([(i, 0, 0) for i in (11, 12)] + [(9, 1, 0), (6, 0, 0), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrep.judge(pages, urlrep.label_outcomes(labels)).collect()}
    assert got == {(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "", None, "allow"), (3, "b.net", "/de/", "net/", "block"), (4, "example.com", "/de/1", "example.com/de/", "block"),
                   (5, "shop.org", "/fr/", "org/fr/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "notexample.com", "/de/", None, "allow"), (9, "h.io", "", None, "allow"),
                   (10, "", "", None, "allow"), (11, "bad.io", "/", None, "block"), (12, "bad.io", "/x", None, "block"), (None, "bad.io", "/y", None, "block")}
    assert urlrep.judge(pages.limit(0), urlrep.label_outcomes(labels.limit(0))).count() == 0


def test_reputation_keeps_suffixes_ports_and_addresses_apart_and_splits_hot_hosts(spark):
    import duckdb
    hosts = ["spam.co.uk", "a.spam.co.uk", "nice.co.uk", "co.uk", "10.0.0.1", "10.0.0.2:8080", "[::1]:80", "shop.io:81", "shop.io", "b.shop.io", "x", "x.com.au", "deep.y.x.com.au"]
    want = [("spam.co.uk", "co.uk"), ("spam.co.uk", "co.uk"), ("nice.co.uk", "co.uk"), ("co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1"), ("10.0.0.2", "10.0.0.2"), ("[::1]", "[::1]"),
            ("shop.io", "io"), ("shop.io", "io"), ("shop.io", "io"), ("x", "x"), ("x.com.au", "com.au"), ("x.com.au", "com.au")]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: (r["domain"], r["suffix"]) for r in df.select("host", *urlrep.levels(F.col("host"))).collect()} == dict(zip(hosts, want))
    r = np.random.default_rng(2)
    h = r.choice(len(hosts) + 1, 4000, p=[0.4] + [0.6 / len(hosts)] * len(hosts))
    rows = [(i, f"http://{'hot.co.uk' if k == 0 else hosts[k - 1]}/p") for i, k in enumerate(h)] + [(7, "http://hot.co.uk/p")] * 500
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"_part": F.lit(1), "_n": F.lit("x"), "_parts": F.lit(2)})
    labels = [(i, int(r.random() < 0.7 - 0.04 * h[i]), 0) for i in range(0, 4000, 2)]
    got = urlrep.judge(pages, urlrep.label_outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got.columns[:5] == ["page_id", "url", "_part", "_n", "_parts"]
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    con.execute("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    cols = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, con.execute(f"select {', '.join(cols)} from ({urlrep.SQL})").fetchall()))
    assert got.select("verdict").distinct().count() == 2
    p = pages.select("page_id", F.lit("hot").alias("host"))
    met = urlrep.meet(p, spark.createDataFrame([("hot", 0.5)], "host string, bad_bound double"))
    assert met.count() == 4500 and met.where("bad_bound is null").isEmpty()


def test_queries_of_a_list_in_blocks_find_the_same(spark, monkeypatch):
    x = np.random.default_rng(11).normal(size=(1500, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, postings.search(df, df.where("vec_id % 5 = 0")).collect()))
    monkeypatch.setattr(postings, "PART", 40)
    assert sorted(map(tuple, postings.search(df, df.where("vec_id % 5 = 0")).collect())) == one


def test_neighbours(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(40, 16))
    x = (centers[r.integers(0, 40, 3000)] + 0.5 * r.normal(size=(3000, 16))) * r.uniform(0.5, 2, (3000, 1))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3020, [0.0] * 16), (3040, [None] + [1.0] * 15), (3060, [float("nan")] + [1.0] * 15), (None, [1.0] * 16), (120, x[120].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = postings.search(df, df.where("vec_id % 20 = 0")).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 20)) and (got.groupby("query_id").size() == 20).all()
    hit = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
        hit += len(set(order) & set(g.vec_id))
        assert np.allclose(g.score, score[g.vec_id], rtol=0, atol=1e-12) and g["rank"].tolist() == list(range(1, 21))
    assert hit / (20 * 150) >= 0.9
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [(r_["rank"], r_["vec_id"]) for r_ in postings.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert postings.search(few.limit(0), few).count() == 0
    assert postings.search(few, few.limit(0)).count() == 0


def test_neighbours_of_reruns_clashing_names_and_one_id_twice(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(2000, 8))
    rows = [(i, v.tolist(), 1, "p", 0.5) for i, v in enumerate(x)] + [(20, x[5].tolist(), 1, "p", 0.5)]  # id 20 has two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, part string, v double")
    one = sorted(map(tuple, postings.search(df, df.where("vec_id % 20 = 0")).collect()))
    two = sorted(map(tuple, postings.search(df.repartition(7), df.where("vec_id % 20 = 0")).collect()))
    assert one == two and len({r_[0] for r_ in one}) == 100
    tiny = postings.fit(x[:500] * 1e-6, 20), postings.fit(x[:500], 20)
    assert np.allclose(tiny[0] * 1e6, tiny[1])


def test_graph_search_finds_near_centroids():
    c = np.random.default_rng(5).normal(size=(500, 12))
    x = np.random.default_rng(6).normal(size=(200, 12))
    ids, d = postings.Graph(c).search(x, 64)
    true = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    best = np.argsort(true, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(best, ids)]) > 0.95
    assert np.allclose(d[:, 0] ** 2, np.take_along_axis(true, ids[:, :1], 1)[:, 0])


def test_words_and_hashes_do_not_depend_on_place():
    import pyarrow as pa
    data, off = packing.text_bytes(pa.array(["a bc", None, "", "bc a\tbc ", "é"]))
    begin, end, first = packing.words(data, off)
    assert [data[a:b].tobytes().decode() for a, b in zip(begin, end)] == ["a", "bc", "bc", "a", "bc", "é"] and first.tolist() == [0, 2, 2, 2, 5, 6]
    h = packing.word_hashes(data, begin, end)
    assert h[0] == h[3] and h[1] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert packing.starts_within(first, 2).tolist() == [0, 2, 3]
