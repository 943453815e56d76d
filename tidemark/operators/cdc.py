"""Change-data capture: versions from an append-only change log, and deletions inferred from full refreshes.

Columns of the log: the key and fields, updated_at, created_at, _airbyte_raw_id, _airbyte_extracted_at, _airbyte_meta
(JSON with sync_id), _ab_cdc_updated_at, _ab_cdc_deleted_at, _ab_cdc_lsn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import Cdc, Key

_META = ["_airbyte_raw_id", "_airbyte_extracted_at", "cdc_updated_at"]


def key_cast(key: Key) -> Column:
    """A source column as the configured type; keys kept for history only are typed NULLs."""
    kinds = {"string": "string", "boolean": "boolean", "integer": "bigint", "float": "double", "date": "date", "timestamp": "timestamp", "json": "string", "integer_array": "array<bigint>"}
    if key.historic:
        return F.lit(None).cast(kinds[key.data_type]).alias(key.output)
    return F.col(key.name).try_cast(kinds[key.data_type]).alias(key.output)


def _log(source: DataFrame, keys: list[Key], since: Column | None, id_col: str) -> DataFrame:
    if since is not None:
        source = source.where(F.col("_airbyte_extracted_at") > since)
    stamp = lambda c: F.col(c).try_cast("timestamp")
    return source.select(
        F.col(id_col).alias("id"), *[key_cast(k) for k in keys], "created_at", "updated_at", "_airbyte_raw_id", "_airbyte_extracted_at",
        stamp("_ab_cdc_updated_at").alias("cdc_updated_at"), stamp("_ab_cdc_deleted_at").alias("deleted_at"),
    )


def cdc_versions(source: DataFrame, keys: list[Key], since: Column | None = None, carried: DataFrame | None = None, id_col: str = "id", legacy: DataFrame | None = None) -> DataFrame:
    """Versions of an entity from its change log.

    Of rows with one id and updated_at the last extracted counts (full refreshes repeat rows). A version ends at the
    next one's updated_at, or when the id was deleted if that is later. ``is_current``: the last version of an id that
    isn't deleted.

    ``since``: only rows that were extracted later are read. ``carried`` has versions made before, of which the last one
    of each id goes on: it is replaced if its row came again, ended by what came after it, and new versions go on from
    its number. What is returned are those last versions and all new ones. A row older than the last version of its id
    can't be placed so, see :func:`late_rows`.

    ``legacy``: versions of an older stream, with the columns of flattened versions, that come before: of one id and
    time the log's row counts.
    """
    log = _log(source, keys, since, id_col)
    deletions = log.where("deleted_at is not null").select("id", "deleted_at")
    live = log.where("deleted_at is null").drop("deleted_at").withColumns({"_rank": F.lit(0), "_number": F.lit(None).cast("int")})
    own = [c for c in live.columns if c not in ("_rank", "_number")]
    if carried is not None:
        last = carried.where("is_current or is_deleted")
        deletions = deletions.unionByName(last.where("is_deleted").select("id", "deleted_at"))
        live = live.unionByName(last.select(*own, F.lit(1).alias("_rank"), F.col("version_number").alias("_number")))
    if legacy is not None:
        kinds = {f.name: f.dataType for f in live.schema.fields}
        given = {"updated_at": F.col("valid_from"), "cdc_updated_at": F.col("updated_at") if "updated_at" in legacy.columns else F.lit(None), "_airbyte_raw_id": F.lit(None), "_airbyte_extracted_at": F.lit(None)}
        old = [given.get(c, F.col(c) if c in legacy.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in own]
        live = live.unionByName(legacy.select(*old, F.lit(2).alias("_rank"), F.lit(None).cast("int").alias("_number")))
    live = live.repartition("id")  # serves the windows and the join
    same = Window.partitionBy("id", "updated_at").orderBy("_rank", F.desc("_airbyte_extracted_at"), F.desc("_airbyte_raw_id"))
    live = live.withColumns({"_n": F.row_number().over(same), "_number": F.max("_number").over(Window.partitionBy("id"))}).where("_n = 1").drop("_n", "_rank")
    order = Window.partitionBy("id").orderBy("updated_at")
    ended = deletions.groupBy("id").agg(F.max("deleted_at").alias("_deleted"))
    rows = live.join(ended, "id", "left").withColumn("_next", F.lead("updated_at").over(order))
    gone = F.col("_next").isNull() & F.coalesce(F.col("_deleted") > F.col("updated_at"), F.lit(False))
    rows = rows.withColumns(
        {
            "valid_from": F.col("updated_at"), "valid_to": F.coalesce("_next", F.when(gone, F.col("_deleted"))), "deleted_at": F.when(gone, F.col("_deleted")), "is_deleted": gone,
            "is_current": F.col("_next").isNull() & ~gone, "version_number": F.row_number().over(order) + F.coalesce("_number", F.lit(1)) - 1,
        }
    )
    return rows.drop("_next", "_deleted", "_number")


def late_rows(source: DataFrame, carried: DataFrame, since: Column, id_col: str = "id") -> DataFrame:
    """Rows of the log since then that are older than the last version of their id; full refreshes bring none."""
    log = source.where((F.col("_airbyte_extracted_at") > since) & F.col("_ab_cdc_deleted_at").isNull()).select(F.col(id_col).alias("id"), "updated_at")
    last = carried.where("is_current or is_deleted").select("id", F.col("valid_from").alias("_last"))
    return log.join(last, "id").where("updated_at < _last")


def merge_legacy(new: DataFrame, legacy: DataFrame, cutoff: Column) -> DataFrame:
    """Versions of an older stream up to a cutoff together with those of the new one, which wins where both have one."""
    old = legacy.where(F.col("valid_from") <= cutoff).withColumn("_old", F.lit(True))
    every = new.withColumn("_old", F.lit(False)).unionByName(old, allowMissingColumns=True).repartition("id")  # serves both windows
    won = F.col("id").isNotNull() & ~F.min("_old").over(Window.partitionBy("id", "valid_from"))
    every = every.withColumn("_won", won).where("not (_old and _won)").drop("_old", "_won")
    order = Window.partitionBy("id").orderBy("valid_from")
    end = F.coalesce(F.lead("valid_from").over(order), F.col("valid_to"))
    return every.withColumns({"valid_to": end, "version_number": F.row_number().over(order), "is_current": F.lead("valid_from").over(order).isNull() & ~F.coalesce("is_deleted", F.lit(False))})


def cdc_latest(versions: DataFrame) -> DataFrame:
    rows = versions.where("valid_to is null").withColumnRenamed("_airbyte_extracted_at", "last_streamed_event_occurred_at")
    return rows.drop("_airbyte_raw_id", "valid_from", "valid_to", "is_current", "is_deleted", "version_number", "cdc_updated_at")


def full_refreshes(source: DataFrame, versions: DataFrame, as_of: Column, cdc: Cdc) -> DataFrame:
    """Snapshots in the log: log positions without deletions that hold a large enough share of the live rows.

    Only the last days are read, and snapshots that ended a while ago, so that none is still under way.
    """
    window = F.expr(f"INTERVAL {cdc.detection_window_days} DAYS")
    recent = source.where(F.col("_airbyte_extracted_at") >= as_of - window)
    sync = F.get_json_object("_airbyte_meta", "$.sync_id")
    found = recent.groupBy(F.col("_ab_cdc_lsn").alias("lsn")).agg(
        F.count_distinct(cdc.primary_key).alias("row_count"), F.count_distinct(sync).alias("sync_count"), F.count_if(F.col("_ab_cdc_deleted_at").isNotNull()).alias("_deletions"),
        F.min("_airbyte_extracted_at").alias("snapshot_started_at"), F.max("_airbyte_extracted_at").alias("snapshot_finished_at"),
    )
    live = versions.where("valid_to is null").agg(F.count(F.lit(1)).alias("live_row_count"))
    found = found.where("_deletions = 0").crossJoin(F.broadcast(live)).withColumn("fraction_of_live", F.try_divide(F.col("row_count").cast("double"), F.col("live_row_count").cast("double")))
    done = F.col("snapshot_finished_at") <= as_of - F.expr(f"INTERVAL {cdc.min_snapshot_age_minutes} MINUTES")
    return found.where((F.col("fraction_of_live") >= cdc.min_live_fraction) & done).drop("_deletions")


def reconcile_deletes(source: DataFrame, versions: DataFrame, refreshes: DataFrame, as_of: Column, id_col: str = "id", known: DataFrame | None = None) -> DataFrame:
    """Live ids that the latest snapshot no longer has and that began before it. ``known``: those logged already."""
    latest = refreshes.orderBy(F.desc("snapshot_finished_at"), F.desc("lsn")).limit(1).select(F.col("lsn").alias("snapshot_lsn"), "snapshot_started_at", "snapshot_finished_at")
    members = source.join(F.broadcast(latest), (F.col("_ab_cdc_lsn") == F.col("snapshot_lsn")) & F.col("_airbyte_extracted_at").between(F.col("snapshot_started_at"), F.col("snapshot_finished_at")))
    members = members.select(F.col(id_col).alias("id")).distinct()
    live = versions.where("valid_to is null").select("id", "valid_from").crossJoin(F.broadcast(latest)).where("valid_from < snapshot_started_at")
    gone = live.join(members, "id", "left_anti").select("id", "snapshot_lsn", "snapshot_started_at", F.col("snapshot_finished_at").alias("deleted_at_assumed"), as_of.alias("detected_at"))
    return gone if known is None else gone.join(known, ["id", "snapshot_lsn"], "left_anti")


def exceeds_safe_volume(deletes: DataFrame, versions: DataFrame, cdc: Cdc) -> DataFrame:
    """The circuit breaker: a row for each snapshot that would delete too large a share of the live rows."""
    live = versions.where("valid_to is null").select("id", "valid_from")
    pending = deletes.join(live, "id").groupBy("snapshot_lsn").agg(F.count(F.lit(1)).alias("pending_delete_count"))
    total = live.agg(F.count(F.lit(1)).alias("live_row_count"))
    found = pending.crossJoin(F.broadcast(total)).withColumn("delete_fraction", F.try_divide(F.col("pending_delete_count").cast("double"), F.col("live_row_count").cast("double")))
    return found.where((F.col("delete_fraction") > cdc.max_delete_fraction) & ~F.col("snapshot_lsn").eqNullSafe(F.lit(cdc.force_snapshot_lsn)))


def apply_deletes(versions: DataFrame, deletes: DataFrame) -> DataFrame:
    """Open versions of deleted ids closed at the end of the earliest snapshot without them. Applying twice changes nothing."""
    first = deletes.groupBy(F.col("id").alias("_id")).agg(F.min("deleted_at_assumed").alias("_gone"))
    rows = versions.join(first, F.col("id") == F.col("_id"), "left")
    hit = F.col("valid_to").isNull() & F.col("_gone").isNotNull() & (F.col("valid_from") < F.col("_gone"))
    return rows.withColumns({"is_deleted": F.when(hit, True).otherwise(F.col("is_deleted")), "is_current": ~hit & F.col("is_current"), "deleted_at": F.when(hit, F.col("_gone")).otherwise(F.col("deleted_at")), "valid_to": F.when(hit, F.col("_gone")).otherwise(F.col("valid_to"))}).drop("_id", "_gone")


def schema_drift(source_columns: list[str], keys: list[Key], primary_key: str = "id") -> tuple[list[str], list[str]]:
    """(columns of the source that aren't configured, configured ones that the source lacks); optional ones don't count."""
    optional = {"id", primary_key, "created_at", "updated_at", "_airbyte_raw_id", "_airbyte_extracted_at", "_airbyte_meta", "_airbyte_generation_id", "_ab_cdc_updated_at", "_ab_cdc_deleted_at", "_ab_cdc_lsn"}
    configured = {k.name for k in keys if not k.historic}
    known = configured | {k.name for k in keys} | {p for k in keys for p in k.past_names}
    return sorted(set(source_columns) - known - optional), sorted(configured - set(source_columns) - optional)
