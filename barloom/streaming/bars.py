"""Structured Streaming: resampling, sessions and exactly-once appends over the same semantics as the batch operators."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.common import epoch_of, shared_folder, symbol_of


def resampled(readings: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Coarser bars of a stream of intraday bars; a window is final once the watermark has passed it, later rows are dropped."""
    rows = readings.where("close is not null").select(symbol_of("symbol").alias("symbol"), F.timestamp_seconds(epoch_of("bar_stamp")).alias("ts"), "open", "high", "low", "close", "volume", "bar_seq").where("symbol is not null and ts is not null")
    order = F.struct("ts", "bar_seq")
    g = rows.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w"))
    out = g.agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("readings"))
    return out.select("symbol", F.unix_seconds("w.start").alias("slot"), "open", "high", "low", "close", "volume", "readings")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user in a stream of events."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return g.select("user_id", F.unix_seconds("s.start").alias("from_s"), F.unix_seconds("s.end").alias("to_s"), "events", "value")


def run_available(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now and return what it has made final (written to the shared folder)."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def append_once(stream: DataFrame, path: str, state: str, keys: list[str]):
    """Append rows whose key isn't there yet; a key that comes again with other content is refused.

    The files of a batch carry a name of the stream's ``state`` and the batch's number. A batch is written beside the others first, then
    its files are moved in; one that runs again after a failure begins by removing what it had moved, so it leaves each row once. What other
    batches wrote is compared by key; streams that write to one ``path`` at the same time don't see each other's unfinished batches.
    """
    owner = hashlib.sha256(state.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        spark, mine = batch.sparkSession, f"batch-{owner}-{number}-"
        place = spark._jvm.org.apache.hadoop.fs.Path
        fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
        there = [x.getPath() for x in fs.listStatus(place(path))] if fs.exists(place(path)) else []
        for p in there:
            if p.getName().startswith(mine):
                fs.delete(p, False)
        rows = batch.dropDuplicates()
        if any(p.getName().startswith("batch-") and not p.getName().startswith(mine) for p in there):
            old = spark.read.schema(batch.schema).parquet(path)
            rest = [c for c in batch.columns if c not in keys]
            same = rows.join(old.withColumnsRenamed({c: f"_{c}" for c in rest}), keys)
            other = ~(F.struct(*(F.col(c).alias(c) for c in rest)).eqNullSafe(F.struct(*(F.col(f"_{c}").alias(c) for c in rest))))
            if not same.where(other).isEmpty():
                raise ValueError("a record is there already with other content")
            rows = rows.join(old, keys, "left_anti")
        staged = f"{path}/_{mine}staged"
        rows.write.mode("overwrite").parquet(staged)
        for x in fs.listStatus(place(staged)):
            if x.getPath().getName().startswith("part-"):
                fs.rename(x.getPath(), place(f"{path}/{mine}{x.getPath().getName()}"))
        fs.delete(place(staged), True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
