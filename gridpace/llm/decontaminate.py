"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every text keeps the smallest hash of each run of ``WINDOW - K + 1`` k-grams. Two texts that share
``WINDOW`` consecutive words then share such a fingerprint, so joining fingerprints finds
every document with a shared window; the hits are extended to whole windows and compared as words.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm.common import hinted, let, query, save, table, text_key

# Words, window and threshold of the contamination rule.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
K = 5  # words of a hashed gram
BROADCAST_ROWS = 200_000  # benchmark rows (24 bytes a fingerprint, about 100 a window) sent to every task; more are shuffled


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null and empty texts have none."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(F.coalesce(low, F.lit("")), NOT_WORD), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    """The hash of every run of ``n`` words; empty for shorter texts."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
                  ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(h: Column, span: int) -> Column:
    """The distinct smallest hashes of all runs of ``span`` gram hashes."""
    return F.when(F.size(h) >= span, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda i: F.array_min(F.slice(h, i, span))))).otherwise(F.array().cast("array<bigint>"))


def runs(w: Column, n: Column | int, starts: Column) -> Column:
    """(start, the ``n`` words from there) for each start, counted from 1."""
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(w, i, n), " ").alias("run")))


def every_run(w: Column, *, n: int) -> Column:
    return F.when(F.size(w) >= n, runs(w, n, F.sequence(F.lit(1), F.size(w) - (n - 1))))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """One row per distinct window: its words, its length and the ids of the items that hold it."""
    w = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    all_starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return (w.select("item_id", n.alias("len"), F.explode(runs(F.col("w"), n, all_starts)).alias("r"))
            .groupBy("len", F.col("r.run").alias("run")).agg(F.collect_set("item_id").alias("items")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated; clashing columns are replaced.

    A window is ``window`` consecutive words of an item, or a whole shorter item. A document word inside an
    occurrence of any window is hit; ``contaminated`` means at least one hit and 20 * n_hit >= n_words.
    Null, empty and wordless texts have 0 words and are clean. Items without words or id are left out, repeated items
    count once. Repeated document rows are judged once by text and each returned; an empty table gives no rows.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*made)
    windows = save(item_windows(items, window), "windows")
    counts = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    n_windows = sum(counts.values())
    span = window - k + 1
    bench = (windows.where(F.col("len") == window)
             .select(F.array_min(grams(F.split("run", " "), k)).alias("fp")).distinct())
    text = F.col("text")
    # Copies of a text meet before the shuffle, so one row per text and task moves.
    unique = docs.where("text is not null").select(*text_key(text), text).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    marked = unique.select("k1", "k2", let(words(text), lambda w: F.struct(
        F.size(w).alias("n"), let(grams(w, k), lambda h: fingerprints(h, span)).alias("fps"))).alias("x"))
    seen = (marked.select("k1", "k2", F.col("x.n").alias("n_words"), F.explode_outer("x.fps").alias("fp"))
            .join(hinted(bench.withColumn("hit", F.lit(True)), n_windows, broadcast_rows), "fp", "left")
            .groupBy("k1", "k2", "n_words").agg(F.collect_set(F.when(F.col("hit"), F.col("fp"))).alias("fps")))

    def near(w: Column, fps: Column) -> Column:
        """Starts of the windows around each matched gram, within the text."""
        at = let(grams(w, k), lambda h: F.filter(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_contains(fps, F.element_at(h, i))))
        return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(
            F.greatest(p - (span - 1), F.lit(1)), F.greatest(F.least(p, F.size(w) - (window - 1)), F.greatest(p - (span - 1), F.lit(1)))))))

    parts = []
    if window in counts:
        held = seen.where(F.size("fps") > 0).select("k1", "k2", "fps").join(unique, ["k1", "k2"])
        parts.append(held.select("k1", "k2", F.lit(window).alias("len"), F.explode(let(
            words(text), lambda w: runs(w, window, near(w, F.col("fps"))))).alias("r")))
    for n in sorted(set(counts) - {window}):  # whole items that are shorter than a window have no fingerprint of its span
        parts.append(unique.select("k1", "k2", F.lit(n).alias("len"), F.explode(let(words(text), partial(every_run, n=n))).alias("r")))
    found = None
    for p in parts:
        p = p.select("k1", "k2", "len", F.col("r.start").alias("start"), F.col("r.run").alias("run"))
        p = p.join(hinted(windows, n_windows, broadcast_rows), ["len", "run"])
        found = p if found is None else found.unionByName(p)
    key = docs.select("*", *[c.alias(f"_{n}") for c, n in zip(text_key(text), ("k1", "k2"))])
    if found is None:
        per_text = seen.select("k1", "k2", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("ids"))
    else:
        covered = F.aggregate(
            F.array_sort("at"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["len"]).alias("end"),
                                  (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n")))["n"]
        hits = (found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "len")).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
                .select("k1", "k2", covered.cast("bigint").alias("n_hit"), F.array_sort("ids").alias("ids")))
        per_text = seen.select("k1", "k2", "n_words").join(hits, ["k1", "k2"], "left")
    per_text = per_text.withColumnRenamed("k1", "_k1").withColumnRenamed("k2", "_k2")
    none = F.array().cast("array<string>")
    out = key.join(per_text, ["_k1", "_k2"], "left").select(
        *docs.columns, F.coalesce(F.col("n_words").cast("bigint"), F.lit(0).cast("bigint")).alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.size(F.coalesce("ids", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return contamination(docs.select("*"), items).where(~F.col("contaminated")).select(*docs.columns)


SQL = r"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
bw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
bi as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as run
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from bw where len(w) > 0)),
lens as (select distinct n from bi),
di as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as run
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)),
hit as (select d.doc_id, d.n, d.i, b.item_id from di d join bi b on d.n = b.n and d.run = b.run),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
ids as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join pos using (doc_id) left join ids using (doc_id)
"""


@query("op9_winnowing_decontamination", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
