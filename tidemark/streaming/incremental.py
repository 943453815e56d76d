"""Streams of event files: each micro-batch goes through the same incremental run as a batch does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans import pipeline
from tidemark.plans.tables import Store


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_stream(stream: DataFrame, store: Store, plan: dict[str, pipeline.Model], checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to the table ``raw`` by day, once however often it is tried, and build the models whose
    cost grows with what is new from their checkpoints. Others wait for :func:`finish`."""

    def batch(rows: DataFrame, number: int) -> None:
        store.append("raw", rows, batch=f"{number:08d}", by_day="occurred_at")
        pipeline.run(rows.sparkSession, store, plan, store.read("raw"), only=pipeline.incremental)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(spark: SparkSession, store: Store, plan: dict[str, pipeline.Model]) -> dict[str, DataFrame]:
    """Build the models that are built as a whole, from what the stream's batches have left; all tables by name."""
    return pipeline.run(spark, store, plan, store.read("raw"), only=lambda m: not pipeline.incremental(m))


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each visitor as they close: start, end and page views, with a watermark for late events."""
    views = stream.where("event_type = 'web_request'").withWatermark("occurred_at", late)
    found = views.groupBy(F.session_window("occurred_at", gap).alias("w"), "anonymised_user_agent_and_ip").agg(F.count(F.lit(1)).alias("page_views"))
    return found.select("anonymised_user_agent_and_ip", F.col("w.start").alias("session_started_at"), F.col("w.end").alias("session_ended_at"), "page_views")
