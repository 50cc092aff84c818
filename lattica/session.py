"""The engine's context: a Spark session with its settings, stores and local data."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lattica.errors import Disposed

#: Settings of a context by the names that callers use.
SETTINGS = {
    "name": "spark.app.name",
    "master": "spark.master",
    "queue": "spark.yarn.queue",
    "node_label": "spark.yarn.executor.nodeLabelExpression",
    "min_executors": "spark.dynamicAllocation.minExecutors",
    "max_executors": "spark.dynamicAllocation.maxExecutors",
    "cores_per_executor": "spark.executor.cores",
    "executor_memory": "spark.executor.memory",
    "driver_memory": "spark.driver.memory",
    "speculation": "spark.speculation",
    "intermediate_codec": "spark.io.compression.codec",
    "output_codec": "spark.sql.parquet.compression.codec",
    "shuffle_partitions": "spark.sql.shuffle.partitions",
    "checkpoint_dir": "spark.checkpoint.dir",
    "task_failures": "spark.task.maxFailures",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; only a local master may go without one."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """df from reliable storage: the rows are fixed, and what made them isn't run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Context:
    """Opens stores and local data as datasets; closes its session if it made it."""

    def __init__(self, spark: SparkSession | None = None, environment: dict[str, str] | None = None, files: Iterable[str] = (), **settings):
        unknown = set(settings) - set(SETTINGS)
        if unknown:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        self._made = spark is None
        if spark is None:
            builder = SparkSession.builder.config("spark.sql.adaptive.enabled", "true")
            for name, value in settings.items():
                builder = builder.config(SETTINGS[name], str(value).lower() if isinstance(value, bool) else str(value))
            for name, value in (environment or {}).items():
                builder = builder.config(f"spark.executorEnv.{name}", value)
            spark = builder.getOrCreate()
        self._spark = spark
        for path in files:
            spark.sparkContext.addFile(path)

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            raise Disposed("the context is closed")
        return self._spark

    def from_store(self, uri: str, order_by=(), **options):
        """The dataset at a URI; the scheme or the ``format`` option tells how to read it."""
        from lattica.dataset import Dataset
        from lattica.sources.stores import read_store

        return Dataset(read_store(self.spark, uri, **options), order_by)

    def from_enumerable(self, rows: Iterable, schema: StructType | str | None = None, order_by=()):
        """Rows that the driver holds; scalars become a column ``value``."""
        from lattica.dataset import Dataset

        data = list(rows)
        if data and not isinstance(data[0], (tuple, list, dict)) and not hasattr(data[0], "__fields__"):
            data = [(v,) for v in data]
            schema = schema or ["value"]
        return Dataset(self.spark.createDataFrame(data, schema), order_by)

    def submit(self, *writes) -> None:
        """Runs the writes prepared by Dataset.to_store together; see lattica.sources.stores.submit."""
        from lattica.sources.stores import submit

        submit(self.spark, writes).wait()

    def close(self) -> None:
        if self._spark is not None and self._made:
            self._spark.stop()
        self._spark = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
