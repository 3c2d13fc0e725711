"""Event streams: windows, sessions and de-duplication with watermarks; an extension beyond batch work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_place

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder as they come; a path that is one file is the stream of that file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(SCHEMA)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(hadoop.getParent().toString())
    return reader.parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total per window of event time; rows later than ``late`` are dropped by the stream."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    counted = seen.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    counted = seen.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen before."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream makes of all input there is, read back from the shared checkpoint folder."""
    spark = stream.sparkSession
    place = new_place(spark, "stream")
    out = f"{place}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
