"""Structured Streaming: windowed telemetry with watermarks; what needs an order is in stateful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT, files_a_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream; ts becomes an event time (watermarks need a timestamp with a zone)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events a window and type; rows later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything the stream has, as a table in the shared folder.

    A batch writes its own part and writes it anew if it runs again; in complete
    mode the last batch has everything.  The stream's progress is kept beside it.
    """
    path = fresh_path(stream.sparkSession, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else f'batch={n}'}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.lastProgress is None:  # no file, no batch
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/all" if mode == "complete" else f"{path}/batch=*")


def exposition(values: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Lines of a metrics page: name{label="value"} number; backslashes, quotes and line ends of values are escaped."""

    def escaped(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))

    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels])
    return values.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col("value").cast("string")).alias("line"))
