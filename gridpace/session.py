"""Session helpers: the shared work folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "gridpace", **conf) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local session may go without: it gets a folder of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gridpace-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def clear_staged(spark: SparkSession) -> bool:
    """Delete the tables that this session has staged; for the end of a session."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/gridpace/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/gridpace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: str | None = None, cluster: list[str] | None = None) -> DataFrame:
    """Write a derived table once to the shared folder and return a scan of it.

    Lineage ends at files, so a lost executor costs a re-read, not a recompute.
    With ``cluster`` the rows stay in the partitions they are in, sorted by
    those columns; without it AQE evens out and splits a heavy season.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    if partition_by:
        df = df.sortWithinPartitions(partition_by, *cluster) if cluster else df.hint("rebalance", partition_by)
        df.write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
