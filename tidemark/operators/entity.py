"""Entity histories: versions, flattening, latest rows, rows at a time, and changes field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import ENTITY_EVENTS, CustomEvent, Entity, Key
from tidemark.functions import kv, scalar
from tidemark.operators import intervals
from tidemark.operators.events import REQUEST_CONTEXT

ID = ["entity_table_name", "entity_id"]


def entity_id(entities: list[Entity]) -> Column:
    """The configured key of the event's entity, from data or else hidden data; NULL for entities not configured."""
    out = F.lit(None).cast("string")
    for entity in entities:
        found = F.coalesce(kv.extract("data", entity.id_key), kv.extract("hidden_data", entity.id_key))
        out = F.when(F.col("entity_table_name") == entity.name, found).otherwise(out)
    return out


def versions(events: DataFrame, entities: list[Entity], carried: DataFrame | None = None) -> DataFrame:
    """One row for each version of each entity, [valid_from, valid_to).

    All entity events order the history; deletions only end the version before them. Versions without length are left
    out. Events of entities that aren't configured, or without an id, take no part. ``carried`` has versions that were
    still open: they join the window, so that only open history need be read again.
    """
    present = [c for c in REQUEST_CONTEXT if c in events.columns]
    both = kv.combined("data", "hidden_data")
    rows = events.where(F.col("event_type").isin(*ENTITY_EVENTS)).withColumn("entity_id", entity_id(entities)).where("entity_id is not null")
    # Texts first: an expression over lambdas is computed as often as it is referred to.
    stamps = ["created_at", "updated_at"]
    rows = rows.select(F.col("occurred_at").alias("valid_from"), "event_type", *ID, *[kv.values_of(both, s).alias(s) for s in stamps], "data", "hidden_data", *present)
    rows = rows.withColumns({s: F.array_join(s, ",") for s in stamps})
    rows = rows.withColumns({s: scalar.string_to_timestamp(s) for s in stamps})
    if carried is not None:
        rows = rows.unionByName(carried.where("valid_to is null").select(rows.columns))
    closed = intervals.close_intervals(rows, ID, "valid_from", ["event_type"])
    return closed.where(intervals.not_empty() & (F.col("event_type") != "delete_entity")).select("valid_from", "valid_to", *[c for c in rows.columns if c != "valid_from"])


def upsert_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Versions after an incremental run, whose ``new`` has all that were open in ``old`` again (if still of length)."""
    return old.where("valid_to is not null").unionByName(new)


def key_columns(keys: list[Key], *fields: str, values: dict[str, Column] | None = None) -> list[Column]:
    """A column for each key: its name first, then past names in order, from the payload fields together; ``values`` has
    all values of each name, if they are known already."""
    both = kv.combined(*fields)
    out = []
    for key in keys:
        names = [key.name, *key.past_names]
        found = [kv.typed(values[n] if values else kv.values_of(both, n), key.data_type, key.is_array) for n in names]
        if key.is_array:
            picked = found[-1]
            for f in reversed(found[:-1]):
                picked = F.when(F.size(f) > 0, f).otherwise(picked)
        else:
            picked = F.coalesce(*found)
        out.append(picked.alias(key.output, metadata={"hidden": key.hidden} | ({"comment": key.description} if key.description else {})))
    return out


def flatten_versions(history: DataFrame, entity: Entity) -> DataFrame:
    """Versions of one entity with a typed column for each key."""
    own = history.where(F.col("entity_table_name") == entity.name)
    context = [c for c in REQUEST_CONTEXT if c in history.columns]
    stamps = ["created_at", "updated_at"] if entity.has_timestamps else []
    # Values first: an expression over lambdas is computed as often as it is referred to.
    names = {n: f"_values_{i}" for i, n in enumerate(n for key in entity.keys for n in (key.name, *key.past_names))}
    both = kv.combined("data", "hidden_data")
    own = own.withColumns({c: kv.values_of(both, n) for n, c in names.items()}) if names else own
    keys = key_columns(entity.keys, "data", "hidden_data", values={n: F.col(c) for n, c in names.items()})
    return own.select("valid_from", "valid_to", "event_type", F.col("entity_id").alias("id"), *stamps, *context, *keys)


def latest(flat: DataFrame) -> DataFrame:
    """Rows as they are now, without the request context."""
    out = flat.where("valid_to is null").withColumnsRenamed({"valid_from": "last_streamed_event_occurred_at", "event_type": "last_streamed_event_type"})
    return out.drop("valid_to", *REQUEST_CONTEXT)


def at_time(flat: DataFrame, when: Column) -> DataFrame:
    """Rows as they were at a time: the version that had begun and not yet ended."""
    return flat.where(intervals.valid_at(when)).drop("valid_from", "valid_to", "event_type", *REQUEST_CONTEXT)


def at_function(name: str, flat: DataFrame) -> None:
    """Register ``name(at TIMESTAMP)`` as a table function of the session's SQL: the entity's rows as they were then.

    ``flat``, versions of the entity, becomes the temporary view ``name_versions`` that the function reads.
    """
    spark, view = flat.sparkSession, f"{name}_versions"
    flat.createOrReplaceTempView(view)
    columns = [f for f in flat.schema.fields if f.name not in ("valid_from", "valid_to", "event_type", *REQUEST_CONTEXT)]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    picked = ", ".join(f"`{f.name}`" for f in columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(at TIMESTAMP) RETURNS TABLE ({typed}) RETURN SELECT {picked} FROM {view} WHERE valid_from <= {name}.at AND (valid_to IS NULL OR valid_to > {name}.at)")


def field_updates(history: DataFrame, flat: Entity | None = None) -> DataFrame:
    """One row for each field that an update changed, with its value before and after.

    Compares a created or updated version with the one before it, over keys that both have; updated_at is no change,
    and first versions have none. Arrays of values are compared as texts in which NULL reads 'null'. Entries are
    compared within the row, so that a row is repeated for its changes only, not for all its keys.

    With ``flat`` the changes of that entity, each with the entity's fields right after it: what
    :func:`flatten_field_updates` finds by a join, read from the version that changed.
    """
    if flat is not None:
        history = history.where(F.col("entity_table_name") == flat.name)
    order = Window.partitionBy(*ID).orderBy("valid_from", "event_type")
    before = {f"previous_{new}": F.lag(old).over(order) for new, old in (("data", "data"), ("hidden_data", "hidden_data"), ("occurred_at", "valid_from"), ("event_type", "event_type"))}
    rows = history.withColumns(before).where("previous_occurred_at is not null and event_type in ('create_entity', 'update_entity')")
    text = lambda entry: F.array_join(entry["value"], ",", "null")
    as_texts = lambda *fields: F.transform(kv.combined(*fields), lambda e: F.struct(e["key"].alias("key"), text(e).alias("text")))

    def changes_of(new: Column, old: Column) -> Column:
        differs = lambda x, y: (x["key"] == y["key"]) & ~x["text"].eqNullSafe(y["text"])
        pair = lambda x: F.transform(F.filter(old, lambda y: differs(x, y)), lambda y: F.struct(x["key"].alias("key"), x["text"].alias("new"), y["text"].alias("old")))
        return F.flatten(F.transform(F.filter(new, lambda x: x["key"] != "updated_at"), pair))

    rows = rows.withColumns({"_new": as_texts("data", "hidden_data"), "_old": as_texts("previous_data", "previous_hidden_data")})
    rows = rows.select("*", F.explode(changes_of(F.col("_new"), F.col("_old"))).alias("_change")).drop("_new", "_old")
    rows = rows.withColumns({"key_updated": F.col("_change.key"), "new_value": F.col("_change.new"), "previous_value": F.col("_change.old")})
    at = F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    seconds = lambda a, b: F.timestamp_diff("SECOND", a, b)
    own = [*ID, "created_at", "updated_at"] if flat is None else ["entity_id", "created_at"]
    return rows.select(
        F.md5(F.concat_ws("|", "entity_table_name", "entity_id", at, "key_updated")).alias("update_id"), F.col("valid_from").alias("occurred_at"), "event_type", *own,
        *[c for c in REQUEST_CONTEXT if c in history.columns], "key_updated", F.nullif("new_value", F.lit("")).alias("new_value"), F.nullif("previous_value", F.lit("")).alias("previous_value"),
        "previous_occurred_at", "previous_event_type", seconds(F.col("previous_occurred_at"), F.col("valid_from")).alias("seconds_since_previous_update"),
        seconds(F.col("created_at"), F.col("valid_from")).alias("seconds_since_created"), *(key_columns(flat.keys, "data", "hidden_data") if flat is not None else []),
    )


def flatten_field_updates(updates: DataFrame, flat: DataFrame, entity: Entity) -> DataFrame:
    """Changes of one entity, each with the entity's fields right after it.

    A change happens when its version begins, so the lookup at a time is an equi-join on id and start.
    """
    own = updates.where(F.col("entity_table_name") == entity.name).drop("entity_table_name", "updated_at")
    keys = [k.output for k in entity.keys]
    now = flat.select(F.col("id").alias("_id"), F.col("valid_from").alias("_from"), *keys)
    return own.join(now, (own["entity_id"] == F.col("_id")) & (own["occurred_at"] == F.col("_from")), "left").drop("_id", "_from")


def flatten_custom_event(events: DataFrame, event: CustomEvent, since: Column | None = None) -> DataFrame:
    """Events of one custom type with a typed column for each key."""
    own = events.where(F.col("event_type") == event.event_type)
    if since is not None:
        own = own.where(F.col("occurred_at") > since)
    return own.select("occurred_at", *[c for c in REQUEST_CONTEXT if c in events.columns], *key_columns(event.keys, "data", "hidden_data"))
