"""The registry of queries and the per-session context they read from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from gridpace.constants import PART_LAPS

QUERIES: dict[str, Callable[["Context"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(ctx) -> DataFrame`` under ``name`` with its ANSI SQL twin, if it has one."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def _files(spark: SparkSession, folder: str) -> tuple:
    """Name, length and time of the tables in a folder, as Spark's file system shows them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found or ()))


class Context:
    """Lazy access to the driver tables and the tables derived from them, staged once per session."""

    _live: dict[tuple[str, str], tuple[tuple, "Context"]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, block_laps: int | None = None):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._block_laps = block_laps
        self._made: dict[str, object] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Context":
        """The session's context of a folder; a new one once any file in it has changed."""
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        state = _files(spark, sf_dir)
        if key not in cls._live or cls._live[key][0] != state:
            cls._live[key] = (state, cls(spark, sf_dir))
        return cls._live[key][1]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def memo(self, key: str, make: Callable[[], object]):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    @cached_property
    def shape(self):
        from gridpace.sources.lapview import lap_shape
        return lap_shape(self, self._block_laps)

    @property
    def blk(self) -> str | None:
        """Block column to add to per-driver windows, or None when every lap series is short."""
        return "blk" if self.shape.blocked else None

    @property
    def parts(self) -> int:
        """Partitions for rows that are dealt by race: enough that one's rows are sorted in memory, however many laps there are."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.shape.n_laps // PART_LAPS))

    @cached_property
    def weather(self) -> DataFrame:
        from gridpace.sources.lapview import weather_view
        return weather_view(self)

    @cached_property
    def raw_laps(self) -> DataFrame:
        from gridpace.session import stage
        from gridpace.sources.lapview import lap_view
        return stage(lap_view(self), "laps", "year", None if self.blk else ["race_no", "drv", "lap"])

    @cached_property
    def laps(self) -> DataFrame:
        """The feature table: every lap with its derived columns."""
        from gridpace.operators.features import prepare
        from gridpace.session import stage
        from gridpace.sources.lapview import bare_laps, labelled
        # short races go from the lines to here in one shuffle and one job, without what follows from the other columns
        df = prepare(self, self.raw_laps) if self.blk else labelled(prepare(self, bare_laps(self), dealt=True))
        return stage(df, "lap_features", "year", None if self.blk else ["race_no", "drv", "lap"])


