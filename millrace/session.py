"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


# Rows of a part of a dealt table, if it has the rows.
LEAST_ROWS, MOST_ROWS = 25_000, 500_000


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, as ``spark.checkpoint.dir`` or ``setCheckpointDir`` names it.

    Only a local session without one gets a temporary folder: on a cluster a
    machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write the table once to the shared folder and read it back.

    Cuts the lineage and fixes every row (and partition number) it holds, and
    survives the loss of any executor. Parquet keeps later passes to the columns
    they need.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Intermediate tables of one piece of work, deleted at its end.

        with Tables(spark) as tables:
            once = tables.keep(df)
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, label: str = "table") -> DataFrame:
        path = fresh_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def deal(self, df: DataFrame, label: str = "table") -> DataFrame:
        """Keep a table that is read many times, dealt over the cores.

        Narrow rows make small files, and Spark would read these in one task however
        many rows they hold.
        """
        rows, cores = df.count(), self.spark.sparkContext.defaultParallelism
        return self.keep(df.repartition(max(1, min(2 * cores, rows // LEAST_ROWS), rows // MOST_ROWS)), label)

    def drop(self, but: int = 0) -> None:
        """Delete all tables but the last ones."""
        done, self.paths = self.paths[: len(self.paths) - but], self.paths[len(self.paths) - but :]
        for path in done:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def __enter__(self) -> "Tables":
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.drop()
