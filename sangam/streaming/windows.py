"""Extension: event streams in Structured Streaming (the language has none).

Windowed aggregates with a watermark; the state is bounded by the watermark,
and results go to a table by complete replacement of each trigger's result, so
that a restarted query gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder, or one file, as a stream; the schema is that of the files now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def window_counts(events: DataFrame, time: str = "ts", value: str = "value", keys: tuple[str, ...] = ("event_type",), window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows, count and total per window and key; rows later than `late` are left out."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = stamped.groupBy(span.alias("span"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return grouped.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *keys, "n", "total")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now, then stop; the result as a DataFrame."""
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
