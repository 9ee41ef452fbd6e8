"""Helpers shared by the operators: staged tables, let-bindings, text keys, query registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpace.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with SQL for the same rows where SQL can say it."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: lineage ends at files every executor can read."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also where ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hinted(df: DataFrame, rows: int, at_most: int) -> DataFrame:
    """Broadcast ``df`` where its counted ``rows`` are at most ``at_most``; else Spark shuffles both sides of the join."""
    return F.broadcast(df) if rows <= at_most else df


def ranked(df: DataFrame, order: list[Column], name: str, rank: str = "rank") -> DataFrame:
    """``df``, saved, with its 0-based place in a global order.

    Rows are range-partitioned and sorted; a place is the offset of its partition plus the place in it, so only one
    row per partition is added up in one task.
    """
    s = save(df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), name)
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    return s.join(F.broadcast(at), "_p").withColumn(rank, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")
