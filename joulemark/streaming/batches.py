"""Batches of the apply period, scored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..models.baseline import UsagePredictor
from ..operators.alignment import impact


def score_batches(spark: SparkSession, source: str, schema: str, model: UsagePredictor, sink: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """A stream over source's Parquet files that writes each batch's impact below sink and ends when all are done.

    A batch that is tried again overwrites its own folder, so nothing is counted twice."""
    features = [c for c in model.columns]

    def run(batch: DataFrame, number: int) -> None:
        prediction = model.predict(batch.select(features))
        impact(prediction, batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_ingest(events: DataFrame, late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Hourly sums by site of a stream of readings, complete once late readings can no longer come."""
    per = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).groupBy("site_id", F.window("_t", "1 hour").alias("w"))
    return per.agg(F.sum("value").alias("consumption")).select("site_id", F.col("w.start").cast("timestamp_ntz").alias("ts"), "consumption")


