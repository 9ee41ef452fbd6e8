"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

Every source's documents lie in an order permuted by hash and cut into blocks. The mix takes each source's blocks in that
order, whole rounds first, until the source's target is reached. The exact numbers of taken blocks per source are then
split in halves down a binary tree: the left half of a node gets a multivariate-hypergeometric
draw of its blocks, as if the whole mix had been shuffled. A leaf is an output shard, which
holds disjoint runs of each source's blocks and orders its documents by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpace.llm.common import hinted, let, query, ranked, save, table

# Word pattern, weights by source rank, and the most a source or document is repeated.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3

BLOCK_WORDS = 1 << 16  # mean words of a block
SHARD_WORDS = 1 << 24  # mean words of an output shard
SEED = 20240607
FAN = 10  # sources meet in arrays of at most 2**FAN, level by level
BROADCAST_ROWS = 100_000  # rows (under 100 bytes each) sent to every task; more are shuffled


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def weight(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")).cast("bigint")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, rank, target): shares by weight; what is over MOST times a size is shared again by weight.

    Every round needs three sums over the sources. The share never falls, so a source that
    stops stays stopped and the rounds end.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = save(ranked(per, [F.col("source").asc_nulls_last()], "sources").withColumn("weight", weight(F.col("rank"))), "source-ranks")
    over = F.lit(False)
    share, stopped = 0.0, -1
    while True:
        r = src.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, MOST * F.col("source_size"))).alias("held"),
                    F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == stopped or not r["weight"]:
            break
        stopped, share = r["n"], ((r["total"] or 0) - (r["held"] or 0)) / r["weight"]
        over = share * F.col("weight") > MOST * F.col("source_size")
    return src.select("source", "source_size", "rank", F.least(share * F.col("weight"), (MOST * F.col("source_size")).cast("double")).alias("target"))


def block_of(h: Column, source_size: Column, block_words: int) -> Column:
    """Blocks of a source are equal ranges of the hash; the order of blocks is the order of the hash."""
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.greatest(source_size, F.lit(1)) / F.lit(float(block_words)))))).cast("int")
    return F.when(bits <= 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", h, 63 - bits))


def block_table(sized: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """One row per block that holds words: its place among its source's blocks and the words before it."""
    b = (sized.where("size > 0").join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
         .groupBy("source", "rank", "source_size", "target", "n_sources", block_of(F.col("h"), F.col("source_size"), block_words).alias("block"))
         .agg(F.sum("size").alias("words")).withColumn("group", F.shiftright("block", 10)))
    b = save(b, "blocks")
    group = b.groupBy("rank", "group").agg(F.sum("words").alias("gw"), F.count("*").alias("gn"))
    before = Window.partitionBy("rank").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    group = group.select("rank", "group", F.coalesce(F.sum("gw").over(before), F.lit(0)).alias("gw0"), F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("gn0"))
    inside = Window.partitionBy("rank", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({"w0": F.coalesce(F.sum("words").over(inside), F.lit(0)), "n0": F.coalesce(F.count("words").over(inside), F.lit(0))})
    return b.join(group, ["rank", "group"]).select(
        "rank", "source", "source_size", "target", "n_sources", "block", "words", (F.col("w0") + F.col("gw0")).alias("before"), (F.col("n0") + F.col("gn0")).alias("place"))


def quotas(b: DataFrame) -> DataFrame:
    """``b`` with whole rounds, words of the last, partial round, and whether the last round takes, cuts or leaves the block."""
    goal = F.round("target").cast("bigint")
    b = b.withColumn("rounds", F.least(F.floor(goal / F.col("source_size")), F.lit(MOST)).cast("bigint"))
    b = b.withColumn("rest", goal - F.col("rounds") * F.col("source_size"))
    return b.withColumn("part", F.when(F.col("before") >= F.col("rest"), 0).when(F.col("before") + F.col("words") >= F.col("rest"), 1).otherwise(2))


def _ln_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def _uniform(*parts: Column) -> Column:
    return (F.xxhash64(F.lit(SEED), *parts).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Number of good blocks among ``draws`` of ``total``, by inversion outwards from the mode; bigints in and out."""
    f = lambda c: c.cast("double")
    lo, hi = F.greatest(F.lit(0), draws - total + good), F.least(draws, good)
    mode = F.least(F.greatest(F.floor((f(draws) + 1) * (f(good) + 1) / (f(total) + 2)).cast("bigint"), lo), hi)
    sd = F.sqrt(F.greatest(f(draws) * f(good) / f(total) * (1 - f(good) / f(total)) * (f(total - draws) / F.greatest(f(total) - 1, F.lit(1.0))), F.lit(0.0)))

    def from_mode(s: Column) -> Column:
        m = s["m"]
        p = F.exp(_ln_factorial(good) - _ln_factorial(m) - _ln_factorial(good - m) + _ln_factorial(total - good) - _ln_factorial(draws - m)
                  - _ln_factorial(total - good - draws + m) - _ln_factorial(total) + _ln_factorial(draws) + _ln_factorial(total - draws))

        def step(a: Column, i: Column) -> Column:
            k, j = f(m + i - 1), f(m - i + 1)
            up = a["up"] * (f(good) - k) * (f(draws) - k) / ((k + 1) * (f(total - good - draws) + k + 1))
            down = a["down"] * j * (f(total - good - draws) + j) / ((f(good) - j + 1) * (f(draws) - j + 1))
            return let(F.struct(up.alias("up"), down.alias("down")), lambda q: F.struct(
                (a["u"] - q["up"] - q["down"]).alias("u"),
                F.when(a["x"] >= 0, a["x"]).when(a["u"] < q["up"], m + i).when(a["u"] < q["up"] + q["down"], m - i).otherwise(a["x"]).alias("x"),
                q["up"].alias("up"), q["down"].alias("down")))

        def walk(p0: Column) -> Column:
            x = F.aggregate(F.sequence(F.lit(1), s["n"]), F.struct((u - p0).alias("u"), F.lit(-1).cast("bigint").alias("x"), p0.alias("up"), p0.alias("down")), step)["x"]
            return F.when((u < p0) | (s["n"] < 1), m).otherwise(let(x, lambda v: F.when(v < lo, m).when(v > hi, m).otherwise(v)))
        return let(p, walk)
    n = F.least(hi - lo, F.ceil(12 * sd).cast("bigint") + 50)
    return F.when(total <= 0, F.lit(0).cast("bigint")).otherwise(let(F.struct(mode.alias("m"), F.greatest(n, F.lit(1).cast("bigint")).alias("n")), from_mode))


def split_level(nodes: DataFrame, level: int, depth: int, total: int, n_sources: int) -> DataFrame:
    """``nodes`` (node, rank, q, start) of one level with ``x``, the blocks of each source that go left.

    The draw runs over the sources of a node one after the other, in arrays of at most 2**FAN: first over groups
    of sources, then inside each group, so its memory does not grow with the number of sources.
    """
    leaves = 1 << (depth - level)
    first = F.col("node") * leaves
    edge = lambda leaf: F.floor(leaf * F.lit(total) / (1 << depth)).cast("bigint")
    digits = max(1, math.ceil(math.log2(max(n_sources, 2)) / FAN))
    drawn = None
    for digit in reversed(range(digits)):
        kids = nodes.groupBy("node", F.shiftright("rank", FAN * (digit + 1)).alias("p"), F.shiftright("rank", FAN * digit).alias("c")).agg(F.sum("q").alias("q"))
        kids = kids.groupBy("node", "p").agg(F.sort_array(F.collect_list(F.struct("c", "q"))).alias("kids"), F.sum("q").alias("n"))
        kids = kids.withColumn("x", edge(first + leaves // 2) - edge(first)) if drawn is None else kids.join(drawn, ["node", "p"])

        salt = F.lit(digit)

        def fold(a: Column, k: Column) -> Column:
            x = hypergeometric(k["q"], a["left"], a["need"], _uniform(F.lit(level), salt, F.col("node"), k["c"]))  # noqa: B023  used at once
            return let(x, lambda v: F.struct((a["left"] - k["q"]).alias("left"), (a["need"] - v).alias("need"),
                                             F.array_append(a["out"], F.struct(k["c"].alias("c"), v.alias("x"))).alias("out")))
        start = F.struct(F.col("n").alias("left"), F.col("x").alias("need"), F.array().cast("array<struct<c:bigint,x:bigint>>").alias("out"))
        drawn = kids.select("node", F.explode(F.aggregate("kids", start, fold)["out"]).alias("k")).select("node", F.col("k.c").alias("p"), F.col("k.x").alias("x"))
    return nodes.join(drawn.withColumnRenamed("p", "rank"), ["node", "rank"])


def deal(copies: DataFrame, per_source: DataFrame, depth: int, total: int, n_sources: int) -> DataFrame:
    """``copies`` (rank, t, ...) of blocks, t counted per source from 0, with the shard of each: the node reached at the leaves."""
    nodes = per_source.select(F.lit(0).cast("bigint").alias("node"), "rank", "q", F.lit(0).cast("bigint").alias("start"))
    copies = copies.withColumn("node", F.lit(0).cast("bigint"))
    for level in range(depth):
        s = save(split_level(nodes, level, depth, total, n_sources), f"split-{level}")
        small = hinted(s.select("node", "rank", "start", "x"), n_sources << level, BROADCAST_ROWS)
        copies = copies.join(small, ["node", "rank"]).withColumn("node", 2 * F.col("node") + (F.col("t") >= F.col("start") + F.col("x")).cast("bigint")).drop("start", "x")
        halves = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("x").alias("q"), F.col("start").alias("start")),
                         F.struct((2 * F.col("node") + 1).alias("node"), (F.col("q") - F.col("x")).alias("q"), (F.col("start") + F.col("x")).alias("start")))
        nodes = s.select("rank", F.explode(halves).alias("h")).select("h.node", "rank", "h.q", "h.start").where("q > 0")
    return copies.withColumnRenamed("node", "shard")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, taken, shards and order_keys; clashing columns are replaced.

    ``size`` counts words (null or empty text: 0), ``taken`` the words that the mix takes, repeats counted, at most MOST
    times the size. ``shards`` has the output shard of each taken copy and ``order_keys`` its place within that shard. A null
    source is a source of its own, last. Each source takes its rounded target exactly, but for repeated rows at the cut, which
    take equal whole parts of what is left. Repeated rows are rows of their own. An empty table gives no rows; where all texts are empty nothing is taken.
    """
    made = ("size", "source_size", "target", "taken", "shards", "order_keys")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    h = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.xxhash64("text")).bitwiseAND(F.lit((1 << 63) - 1))
    sized = save(docs.select("source", word_count(F.col("text")).alias("size"), h.alias("h")), "sizes")
    t = save(source_targets(sized), "targets")
    n_sources = t.count()
    small = hinted(t, n_sources, BROADCAST_ROWS)
    b = save(quotas(block_table(sized, small.withColumn("n_sources", F.lit(n_sources)), block_words)), "quotas")
    # the cut: in the block where the last round ends, the hash of the document at which it ends
    cut = b.where((F.col("part") == 1)).select("source", "block", "source_size", F.col("rest").alias("rest_"), F.col("before").alias("before_"))
    at = (sized.where("size > 0").alias("s").join(hinted(cut, n_sources, BROADCAST_ROWS).alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))
          & (block_of(F.col("s.h"), F.col("c.source_size"), block_words) == F.col("c.block")))
          .groupBy(F.col("c.source").alias("source"), "rest_", "before_", "h").agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
    run = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)  # the documents of one block
    at = at.withColumn("left_", F.col("rest_") - F.col("before_") - F.coalesce(F.sum("words").over(run), F.lit(0)))
    at = at.where((F.col("left_") > 0) & (F.col("left_") <= F.col("words"))).select("source", F.col("h").alias("cut_h"), F.floor(F.col("left_") / F.col("rows")).cast("bigint").alias("cut_words"))
    goal = F.round("target").cast("bigint")
    plan = (t.alias("t").join(at.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source")), "left")
            .select("t.*", "a.cut_h", "a.cut_words")
            .withColumn("rounds", F.when(F.col("source_size") > 0, F.least(F.floor(goal / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("bigint"))
            .withColumn("rest", goal - F.col("rounds") * F.col("source_size")))
    plan = save(plan, "plan")
    # blocks and their copies
    q = b.groupBy("rank").agg((F.first("rounds") * F.count("*") + F.count(F.when(F.col("part") > 0, 1))).alias("q"), F.count("*").alias("n_blocks"))
    q = save(q, "block-quotas")
    sums = q.agg(F.sum("q").alias("q"), F.sum("n_blocks").alias("n")).first()
    words = t.agg(F.sum("target")).first()[0] or 0.0
    depth = max(0, math.ceil(math.log2(words / shard_words))) if words > 0 else 0
    rounds = F.when(F.col("rounds") + (F.col("part") > 0).cast("bigint") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("rounds") + (F.col("part") > 0).cast("bigint") - 1))
    copies = (b.join(hinted(q, n_sources, BROADCAST_ROWS), "rank").select("source", "rank", "block", "n_blocks", "place", F.explode(rounds).alias("round"))
              .withColumn("t", F.col("round") * F.col("n_blocks") + F.col("place")))
    shards = (deal(copies, q, depth, sums["q"] or 0, n_sources).groupBy("source", "block")
              .agg(F.array_sort(F.collect_list(F.struct("round", "shard"))).alias("s")).select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), F.col("s.shard").alias("shards_")))
    size, part = F.col("size"), F.when(F.col("rest") <= 0, 0).when(F.col("cut_h").isNull() | (F.col("_h") < F.col("cut_h")), F.col("size")).when(F.col("_h") == F.col("cut_h"), F.col("cut_words")).otherwise(0)
    d = docs.withColumns({"size": word_count(F.col("text")), "_h": h})
    plan = hinted(plan, n_sources, BROADCAST_ROWS).alias("p")
    d = d.alias("d").join(plan, F.col("d.source").eqNullSafe(F.col("p.source")), "left").select("d.*", "p.source_size", "p.target", "p.rounds", "p.rest", "p.cut_h", "p.cut_words")
    d = d.withColumns({"taken": (F.col("rounds") * size + part).cast("bigint"), "_b": block_of(F.col("_h"), F.col("source_size"), block_words)})
    d = d.join(hinted(shards, sums["n"] or 0, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("_b") == F.col("b_block")), "left")
    held = F.slice(F.coalesce("shards_", F.array().cast("array<bigint>")), F.lit(1), (F.col("rounds") + (part > 0).cast("bigint")).cast("int"))
    d = d.withColumn("shards", F.when(F.col("taken") > 0, held).otherwise(F.array().cast("array<bigint>")))
    key = F.transform("shards", lambda s, i: F.xxhash64(F.lit(SEED), s, i, F.col("_h")))
    return d.withColumn("order_keys", key).select(*docs.columns, *made)


@query("op3_mix_to_target_weights")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text", "source", "order_keys")
