"""Session set-up, table loading and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_roots: list[str] = []


def build_session(app: str = "framewright", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FRAMEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all runs on one machine (tests) a
    temporary folder is made, and removed when the process ends; on a cluster
    a missing name is an error, as no other folder is shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("the session names no shared folder: set spark.checkpoint.dir")
    root = tempfile.mkdtemp(prefix="framewright-")
    _local_roots.append(root)
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@atexit.register
def _clean() -> None:
    for root in _local_roots:
        shutil.rmtree(root, ignore_errors=True)


def parallel_tasks(spark: SparkSession) -> int:
    """Tasks for a stage whose cost lies in computing, not in bytes: two for each core, or the session's shuffle partitions."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """A scan cut for costly row work: files too few for the cores are dealt out, large inputs stay where they are."""
    spark = df.sparkSession
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(parallel_tasks(spark))


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of a session, once, so they need no path of their own."""
    context = spark.sparkContext
    if getattr(context, "_framewright_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="framewright-code-")
    _local_roots.append(folder)  # the driver serves the file to the executors
    path = os.path.join(folder, "framewright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._framewright_shipped = True


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors, is compressed and columnar,
    and can be dropped as soon as its successor stands.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
