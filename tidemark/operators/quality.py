"""Assertions: queries that return the rows that break a rule, so an empty result is a pass. Times are given, not taken
from the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BUILT_IN_EVENTS, Entity, PipelineConfig
from tidemark.functions import kv
from tidemark.operators import cdc

#: Seconds between the first and last events of a mistake that a switch of configuration explains.
GRACE_SECONDS = 60


def not_fresh(rows: DataFrame, as_of: Column, days: int, at: str = "occurred_at") -> DataFrame:
    """One row with the latest time if that is more than ``days`` ago; an empty table breaks no rule."""
    return rows.agg(F.max(at).alias("last_occurred_at")).where(F.col("last_occurred_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))


def heartbeat_not_fresh(heartbeat: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Heartbeats older than ``hours``; any one is a failure, and so is a table without one (a row with a NULL)."""
    found = heartbeat.agg(F.min("_airbyte_extracted_at").alias("last_sync_at"))
    return found.where(F.col("last_sync_at").isNull() | (F.col("last_sync_at") < as_of - F.expr(f"INTERVAL {hours} HOURS")))


def columns_not_configured(log: DataFrame, entity: Entity, primary_key: str = "id") -> DataFrame:
    """``entity_table_name, column_name, rows_with_a_value``: columns of a change log that the entity's keys lack, with
    the rows that would be lost; a column that is always NULL counts too."""
    extra = cdc.schema_drift(log.columns, entity.keys, primary_key)[0]
    if not extra:
        return log.limit(0).select(F.lit(entity.name).alias("entity_table_name"), F.lit("").alias("column_name"), F.lit(0).cast("bigint").alias("rows_with_a_value"))
    counts = log.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(extra)])
    each = F.inline(F.array(*[F.struct(F.lit(entity.name).alias("entity_table_name"), F.lit(c).alias("column_name"), F.col(f"c{k}").alias("rows_with_a_value")) for k, c in enumerate(extra)]))
    return counts.select(each)


def columns_missing(log: DataFrame, entity: Entity, primary_key: str = "id") -> DataFrame:
    """``entity_table_name, column_name, rows_without``: configured keys that a change log lacks, and its rows."""
    lacking = cdc.schema_drift(log.columns, entity.keys, primary_key)[1]
    names = F.explode(F.array(*[F.lit(c) for c in lacking]).cast("array<string>")).alias("column_name")
    return log.agg(F.count(F.lit(1)).alias("rows_without")).select(F.lit(entity.name).alias("entity_table_name"), names, "rows_without")


def expected_fields(spark: SparkSession, cfg: PipelineConfig) -> DataFrame:
    """(entity_name, expected_key) for every key that isn't historic; as large as the configuration."""
    rows = [(e.name, k.name) for e in cfg.entities for k in e.keys if not k.historic]
    return spark.createDataFrame(rows, "entity_name string, expected_key string")


def missing_expected_fields(events: DataFrame, cfg: PipelineConfig, as_of: Column) -> DataFrame:
    """Expected keys that yesterday's and today's changes of an entity lack, unless the key was introduced in between:
    then all events without it come before all with it."""
    expected = F.broadcast(expected_fields(events.sparkSession, cfg))
    recent = events.where(F.col("event_type").isin("create_entity", "update_entity", "import_entity") & (F.to_date("occurred_at") >= F.date_sub(F.to_date(as_of), 1)))
    keys = F.transform(kv.combined("data", "hidden_data"), lambda e: e["key"])
    met = recent.select("entity_table_name", "occurred_at", keys.alias("keys")).join(expected, F.col("entity_table_name") == F.col("entity_name"))
    have = F.array_contains("keys", F.col("expected_key"))
    at = F.col("occurred_at")
    found = met.groupBy("entity_name", "expected_key").agg(
        F.count_if(have).alias("updates_with_key"), F.count_if(~have).alias("updates_without_key"), F.min(F.when(have, at)).alias("first_with"), F.max(F.when(have, at)).alias("last_with"),
        F.min(F.when(~have, at)).alias("first_without"), F.max(F.when(~have, at)).alias("last_without"),
    )
    introduced = (F.col("updates_with_key") > 0) & (F.col("first_with") >= F.col("last_without"))
    return found.where((F.col("updates_without_key") > 0) & ~F.coalesce(introduced, F.lit(False))).orderBy("entity_name", "expected_key")


def unhandled_fields(events: DataFrame, cfg: PipelineConfig, as_of: Column) -> DataFrame:
    """Keys (and entities) that yesterday's changes had and the configuration doesn't."""
    known = F.lit(None).cast("array<string>")
    for e in cfg.entities:
        names = [*{e.id_key, "id", "created_at", "updated_at"}, *[n for k in e.keys for n in (k.name, *k.past_names)]]
        known = F.when(F.col("entity_table_name") == e.name, F.array(*[F.lit(n) for n in sorted(set(names))])).otherwise(known)
    recent = events.where(F.col("event_type").isin("create_entity", "update_entity", "import_entity") & (F.to_date("occurred_at") == F.date_sub(F.to_date(as_of), 1)))
    each = recent.select("entity_table_name", "occurred_at", known.alias("known"), F.explode(kv.combined("data", "hidden_data")).alias("e"))
    extra = each.where(~F.coalesce(F.array_contains("known", F.col("e.key")), F.lit(False)))
    return extra.groupBy("entity_table_name", F.col("e.key").alias("key_missing_from_pipeline")).agg(F.count_distinct("occurred_at").alias("updates_made_yesterday_with_this_key"))


def unhandled_custom_events(events: DataFrame, cfg: PipelineConfig, as_of: Column) -> DataFrame:
    """Event types of yesterday that are neither built in nor configured."""
    known = [*BUILT_IN_EVENTS, *[e.event_type for e in cfg.custom_events]]
    recent = events.where((F.to_date("occurred_at") == F.date_sub(F.to_date(as_of), 1)) & ~F.col("event_type").isin(*known))
    return recent.groupBy(F.col("event_type").alias("unexpected_event_type")).agg(F.count_distinct("occurred_at").alias("updates_made_yesterday"))


def hidden_mismatch(events: DataFrame, cfg: PipelineConfig, custom: bool = False, since: Column | None = None, before: Column | None = None) -> DataFrame:
    """Configured keys whose values stand in hidden data although they shouldn't, or in data although they should; of
    events of the day ``since`` and later, and of days before ``before``.

    A hidden key may be seen in data until shortly before it is first hidden, as the application switches over. What a
    mistake of long ago has left is looked for in a sample of blocks, see :func:`tidemark.plans.tables.block_sample`.
    """
    own = [(c.event_type if custom else c.name, k.name, k.hidden) for c in (cfg.custom_events if custom else cfg.entities) for k in c.keys if not k.historic]
    configured = F.broadcast(events.sparkSession.createDataFrame(own, "name string, key_configured string, hidden_configured boolean"))
    name = "event_type" if custom else "entity_table_name"
    rows = events if since is None else events.where(F.to_date("occurred_at") >= since)
    rows = rows if before is None else rows.where(F.to_date("occurred_at") < before)
    rows = rows if custom else rows.where(F.col("event_type").isin("create_entity", "update_entity", "import_entity"))
    met = rows.select(name, "occurred_at", "data", "hidden_data").join(configured, F.col(name) == F.col("name"))
    hidden, shown = (F.exists(kv.entries(f), lambda e: e["key"] == F.col("key_configured")) for f in ("hidden_data", "data"))
    at = F.col("occurred_at")
    found = met.groupBy("name", "key_configured", "hidden_configured").agg(
        F.count_if(hidden).alias("updates_hidden"), F.count_if(shown).alias("updates_not_hidden"), F.min(F.when(hidden, at)).alias("first_hidden"), F.max(F.when(hidden, at)).alias("last_hidden"),
        F.min(F.when(shown, at)).alias("first_not_hidden"), F.max(F.when(shown, at)).alias("last_not_hidden"),
    )
    switched = F.timestamp_diff("SECOND", F.col("first_hidden"), F.col("last_not_hidden")) <= GRACE_SECONDS
    wrong = (~F.col("hidden_configured") & (F.col("updates_hidden") > 0)) | (F.col("hidden_configured") & (F.col("updates_not_hidden") > 0) & ~F.coalesce(switched, F.lit(False)))
    return found.where(wrong)


def not_backfilled(events: DataFrame, cfg: PipelineConfig, checks: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Configured entities of which nothing of an import was ever streamed, with how many days they are kept and, of
    ``checks``, the counts of the day's check against the database (NULL without one)."""
    days = cfg.expiration_days if cfg.expiration_days is not False else None
    expected = events.sparkSession.createDataFrame([(e.name, e.expiration_days or days) for e in cfg.entities], "entity_table_name string, expiry_days int")
    imports = events.where("event_type in ('import_entity', 'import_entity_table_check')").groupBy("entity_table_name").agg(F.count(F.lit(1)).alias("number_of_import_events"))
    found = expected.join(imports, "entity_table_name", "left").withColumn("number_of_import_events", F.coalesce("number_of_import_events", F.lit(0))).where("number_of_import_events = 0")
    if checks is None:
        return found
    today = checks.where(F.to_date("checksum_calculated_at") == F.to_date(as_of)).select("entity_table_name", "warehouse_row_count", "database_row_count")
    return found.join(today, "entity_table_name", "left")


def not_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def null_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows) for columns that must not be NULL and are; one pass."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in columns])).alias("x"))
    return each.select("x.column", "x.rows").where(F.col("rows") > 0)


def failing_rows(rows: DataFrame, condition: str) -> DataFrame:
    """Rows for which a condition isn't true."""
    return rows.where(~F.coalesce(F.expr(condition), F.lit(False)))
