"""Streaming forms of batch operators. The reference results are batch; these give the same rows from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def windowed_counts(spark: SparkSession, path: str, every: str = "1 day", files_per_trigger: int = 1000) -> DataFrame:
    """Events a window and type, from a stream of event files read to its present end.

    Files hold times in any order, so no event counts as late: state (a row a window and type) stays to
    the end of the run. Events without a time are counted under a null day. Update mode writes each
    window's last count; the latest batch of each window counts.
    """
    root = shared_folder(spark, "stream")
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, the path may also be one file
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("timed", F.col("ts").isNotNull())
    when = F.coalesce("ts", F.lit("1970-01-01").cast("timestamp"))  # a window drops rows without a time
    counts = events.withColumn("ts", when).groupBy(F.window("ts", every), "timed", "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    flat = counts.select(F.when(F.col("timed"), F.col("window.start").cast("date")).alias("day"), "event_type", "n_events", "total")

    def publish(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    flat.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("day", "event_type").agg(F.max_by("n_events", "batch").alias("n_events"), F.max_by("total", "batch").alias("total"))
