"""Readers and writers of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpace.functions.expr import finite_or_null
from gridpace.session import stage_path

# Split files that share the folder with the circuit files.
RESERVED = ("train", "dev", "test")

LAP_CSV = "Driver string, LapNumber int, LapTime double, Compound string, TyreLife int, year int, round_number string"


def write_circuit_csvs(laps: DataFrame, name_col: str, path: str) -> str:
    """One CSV folder per circuit, named ``file=<circuit>.csv``."""
    (laps.withColumn("file", F.concat(F.col(name_col), F.lit(".csv"))).drop(name_col)
     .hint("rebalance", "file").write.partitionBy("file").option("header", True).csv(path))
    return path


def read_circuit_csvs(spark: SparkSession, path: str, schema: str = LAP_CSV) -> DataFrame:
    """Many files, explicit schema; the file's name becomes the location and reserved names are skipped."""
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    loc = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"file=([^/]+)\.csv/", 1)
    return raw.select("*", loc.alias("location")).filter(~F.col("location").isin(*RESERVED))


def append_aligned(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append new rows under the existing header: missing columns become null, unknown ones are dropped."""
    return existing.unionByName(new, allowMissingColumns=True).select(*existing.columns)


def not_loaded(schedule: DataFrame, loaded: DataFrame) -> DataFrame:
    """(venue, year, round) rows still to ingest. A venue-year whose rounds are all unreadable counts as loaded."""
    rounds = loaded.select("venue", "year", F.expr("try_cast(round_text as int)").alias("round_no"))
    dark = rounds.groupBy("venue", "year").agg(F.count("round_no").alias("known")).filter("known = 0")
    return (schedule.join(rounds.filter("round_no is not null"), ["venue", "year", "round_no"], "left_anti")
            .join(dark, ["venue", "year"], "left_anti"))


def strict_json(df: DataFrame) -> DataFrame:
    """Every top-level double that is NaN or infinite becomes null before it is written as JSON."""
    return df.select(*[finite_or_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def round_trip(df: DataFrame, fmt: str, name: str, partition_by: str | None = None, **options) -> DataFrame:
    """Write a table in a format and scan it back with its own schema."""
    path = stage_path(df.sparkSession, name)
    w = df.write.format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).options(**options).load(path)
