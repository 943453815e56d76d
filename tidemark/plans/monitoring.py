"""Snapshots of a pipeline's state, appended to monitoring tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import PipelineConfig


def table_snapshot(checks: DataFrame, events: DataFrame, cfg: PipelineConfig, as_of: Column, project: str = "local", dataset: str = "default") -> DataFrame:
    """The latest check of each table, with what the pipeline as a whole did with hidden data in the last week."""
    last = Window.partitionBy("entity_table_name").orderBy(F.desc("checksum_calculated_at"))
    rows = checks.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    week = events.where(F.to_date("occurred_at") >= F.date_sub(F.to_date(as_of), 7)).agg(F.bool_or(F.coalesce(F.size("hidden_data"), F.lit(0)) > 0).alias("hidden_pii_streamed_within_the_last_week"))
    none = F.when(F.col("database_row_count") > 0, 0)
    return rows.crossJoin(F.broadcast(week)).select(
        as_of.alias("workflow_executed_at"), F.lit(project).alias("project_name"), F.lit(cfg.source_name).alias("event_source_name"), F.lit(dataset).alias("output_dataset_name"), "entity_table_name",
        "checksum_calculated_at", F.coalesce(F.col("database_checksum") == F.col("warehouse_checksum"), F.lit(False)).alias("matching_checksums"), F.col("database_row_count").alias("number_of_rows"),
        F.coalesce("number_of_missing_rows", none).alias("number_of_missing_rows"), F.coalesce("number_of_extra_rows", none).alias("number_of_extra_rows"), "weekly_change_in_number_of_rows",
        "weekly_change_in_number_of_missing_rows", "weekly_change_in_number_of_extra_rows", "error_rate", "twelve_week_projected_error_rate", "hidden_pii_streamed_within_the_last_week",
        F.lit(bool(cfg.hidden_policy)).alias("hidden_pii_configured"),
    )


def pipeline_snapshot(snapshots: DataFrame, clients: DataFrame, cfg: PipelineConfig, version: str = "1") -> DataFrame:
    """One row for each run of the source that is some table's latest snapshot: totals over its tables."""
    last = Window.partitionBy("entity_table_name").orderBy(F.desc("workflow_executed_at"))
    rows = snapshots.where(F.col("event_source_name") == cfg.source_name).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    client = clients.where("valid_to is null").agg(F.max_by("version", "valid_from").alias("client_version"))
    keys = ["workflow_executed_at", "project_name", "event_source_name", "client_version", "output_dataset_name", "hidden_pii_streamed_within_the_last_week", "hidden_pii_configured"]
    sums = ["number_of_missing_rows", "number_of_extra_rows", "number_of_rows", "weekly_change_in_number_of_rows", "weekly_change_in_number_of_missing_rows", "weekly_change_in_number_of_extra_rows"]
    found = rows.crossJoin(F.broadcast(client)).groupBy(*keys).agg(
        F.count_distinct("entity_table_name").alias("number_of_tables"), F.sum(F.col("matching_checksums").cast("int")).alias("number_of_tables_with_matching_checksums"), *[F.sum(c).alias(c) for c in sums],
        F.max("error_rate").alias("largest_error_rate_for_any_table"), F.max_by("entity_table_name", "error_rate").alias("table_with_largest_error_rate"),
        F.max("twelve_week_projected_error_rate").alias("largest_twelve_week_projected_error_rate_for_any_table"),
        F.max_by("entity_table_name", "twelve_week_projected_error_rate").alias("table_with_largest_twelve_week_projected_error_rate"),
    )
    return found.withColumns({"checksum_enabled": F.col("number_of_tables") > 0, "pipeline_version": F.lit(version), "pipeline_parameters": F.lit(repr(cfg))})
