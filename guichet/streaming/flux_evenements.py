"""Streaming faces of batch operators: windowed event counts with late data, tickets merged as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from guichet.operators.instantane import merge
from guichet.session import remove


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """``window_start, event_type, n, total`` of tumbling windows; events later than ``late`` behind the newest are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    by = timed.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_windows(spark: SparkSession, source: str, folder: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The windows of all files of ``source``, read as a stream until nothing is left; the table written under ``folder``.

    Each micro-batch replaces the states of its windows (update mode, keyed by window and type), so a batch
    that is replayed after a failure changes nothing. ``source`` is a Parquet file or folder.
    """
    known = spark.read.parquet(source).schema
    path, name = (source, "*") if _is_folder(spark, source) else source.rsplit("/", 1)
    events = spark.readStream.schema(known).option("pathGlobFilter", name).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/lots/lot={number:010d}")

    q = windowed(events, size, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/reprise").trigger(availableNow=True).start()
    q.awaitTermination()
    states = spark.read.option("basePath", f"{folder}/lots").parquet(f"{folder}/lots")
    last = F.max_by(F.struct("n", "total"), "lot")
    return states.groupBy("window_start", "event_type").agg(last.alias("s")).select("window_start", "event_type", "s.n", "s.total")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def upsert_stream(arriving: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merges arriving tickets into a Parquet stock; each batch writes the next version, named by its batch id.

    A batch that is replayed rewrites its own version from the one before, so the result is the same. Of older
    versions only that one is kept. Every version is the whole stock: for large stocks let batches be large.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = merge(spark.read.parquet(f"{folder}/v{number - 1}"), batch) if number else merge(batch.limit(0), batch)
        merged.write.mode("overwrite").parquet(f"{folder}/v{number}")
        if number > 1:
            remove(spark, f"{folder}/v{number - 2}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
