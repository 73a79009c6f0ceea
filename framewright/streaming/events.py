"""The event log as a stream: late-tolerant deduplication, windowed counts and keyed merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from framewright.operators.merge import latest_per_key
from framewright.session import Scratch


def event_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """The files of an event table, a file or a folder, ``files`` per batch, with ``at`` as the event time."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # a single file is read through its folder and name
    folder, _, name = path.rpartition("/")
    stream = reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def without_repeats(stream: DataFrame, key: str, tolerance: str) -> DataFrame:
    """Insert or ignore: the first event of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark("at", tolerance).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, window: str, tolerance: str | None, *keys: str) -> DataFrame:
    """Counts per window and keys. With a tolerance, events later than it are dropped and their windows forgotten; without one none are."""
    held = stream if tolerance is None else stream.withWatermark("at", tolerance)
    return (
        held.groupBy(F.window("at", window).alias("w"), *keys)
        .agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 6).alias("total_value"), F.max("at").alias("last_at"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n_events", "total_value", "last_at")
    )


def closed_windows(spark: SparkSession, counts: DataFrame, *keys: str) -> DataFrame:
    """The last state of every window that ended before the newest event: files in any order, and in any number of batches, give the same."""
    every = run_available(spark, counts, "update")
    last = latest_per_key(every, ["window_start", *keys], ["epoch"])
    newest = last.agg(F.max("last_at").alias("newest"))
    return last.join(F.broadcast(newest), F.col("window_end") <= F.col("newest")).drop("newest", "epoch")  # one row


def inserted_once(spark: SparkSession, stream: DataFrame, key: str) -> DataFrame:
    """Insert or ignore over a whole stream: one event of each key, however late its repeats come.

    The keys seen lie in the written table, not in the state of the stream; a
    batch that is run again writes the same folder again.
    """
    root = Scratch(spark, "once").root

    def keep(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates([key])
        if epoch:
            before = _written(spark, f"{root}/out", batch.schema).where(F.col("epoch") < epoch)
            fresh = fresh.join(before.select(key), key, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return _written(spark, f"{root}/out", stream.schema).drop("epoch")


def _written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the batches of a stream wrote, with their epoch; no rows where none came."""
    whole = StructType([*schema.fields, StructField("epoch", IntegerType())])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def run_available(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all that is there and return what it wrote.

    The sink and its checkpoint lie in the shared folder, so a lost executor
    or a restarted driver goes on where it was.
    """
    root = Scratch(spark, "stream").root
    if mode == "append":
        query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{root}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    query = out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return _written(spark, f"{root}/out", out.schema)


def merge_batches(keys: list[str], order: list[str], read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]):
    """A foreachBatch sink that merges each batch into a keyed table, last observation wins; safe to repeat after a failure."""

    def merge(batch: DataFrame, epoch: int) -> None:
        current = read()
        fresh = batch if current is None else current.unionByName(batch)
        write(latest_per_key(fresh, keys, order))

    return merge
