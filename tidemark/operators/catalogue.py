"""What the stream says about itself: the client's versions over time, and a schema inferred from values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import kv, scalar


def configuration_history(events: DataFrame) -> DataFrame:
    """``valid_from, valid_to, version`` of the streaming client.

    Versions begin with initialise_analytics events; before the first one lies an interval without a version that
    begins with the first event of all. A version ends where the next one begins: within its day, or on the next day
    that has one, so that only one row a day is ordered in one task.
    """
    starts = events.where("event_type = 'initialise_analytics'").select(F.col("occurred_at").alias("valid_from"), kv.extract("data", "analytics_version").alias("version"))
    starts = starts.withColumn("_day", F.to_date("valid_from"))
    days = starts.groupBy("_day").agg(F.min("valid_from").alias("_first"))
    days = days.select("_day", F.lead("_first").over(Window.partitionBy(F.lit(0)).orderBy("_day")).alias("_after"))
    order = Window.partitionBy("_day").orderBy("valid_from", "version")
    known = starts.withColumn("_next", F.lead("valid_from").over(order)).join(days, "_day", "left")
    known = known.select("valid_from", F.coalesce("_next", "_after").alias("valid_to"), "version")
    ends = starts.agg(F.min("valid_from").alias("valid_to"))
    first = events.agg(F.min("occurred_at").alias("valid_from")).crossJoin(F.broadcast(ends)).withColumn("version", F.lit(None).cast("string"))
    return known.unionByName(first.where("valid_from is not null and (valid_to is null or valid_from < valid_to)")).select("valid_from", "valid_to", "version")


def infer_types(events: DataFrame) -> DataFrame:
    """``entity_table_name, key, data_type``: the narrowest type that all values of a key can be read as.

    In order: none (all values are empty), boolean, integer, float, timestamp, date, integer_array, string. Each value
    is told by the narrowest type that it can be read as, so that no further type is tried for it: integers are floats
    as well, timestamps are dates, and there is no other overlap. Values are counted by type, which combines before the
    shuffle.
    """
    both = events.where("entity_table_name is not null").select("entity_table_name", F.explode(kv.combined("data", "hidden_data")).alias("e"))
    found = both.select("entity_table_name", F.col("e.key").alias("key"), F.explode("e.value").alias("value"))
    value, first = F.col("value"), F.ascii("value")
    # What begins neither like a number, a quoted time nor a list is a word: most are no type's but a string's.
    word = ~(first.between(48, 57) | first.isin(43, 45, 46, 34, 91) | (first <= 32))
    worded = F.when(F.length(value) > 8, "string").when(scalar.safe_bool(value).isNotNull(), "boolean").when(scalar.safe_float(value).isNotNull(), "float").otherwise("string")
    kind = F.when(value.isNull() | (value == ""), F.lit(None).cast("string")).when(word, worded)
    kind = kind.when(scalar.safe_int(value).isNotNull(), "integer").when(scalar.safe_float(value).isNotNull(), "float").when(scalar.string_to_timestamp(value).isNotNull(), "timestamp")
    kind = kind.when(scalar.string_to_date(value).isNotNull(), "date").when(value.rlike(r"^\[(\s*-?\d+\s*(,\s*-?\d+\s*)*)?\]$"), "integer_array").otherwise("string")
    kinds = ("boolean", "integer", "float", "timestamp", "date", "integer_array", "string")
    found = found.select("entity_table_name", "key", kind.alias("_kind"))
    found = found.groupBy("entity_table_name", "key").agg(F.count("_kind").alias("known"), *[F.count_if(F.col("_kind") == k).alias(k) for k in kinds])
    every = F.when(F.col("known") == 0, F.lit(None).cast("string"))
    for name, parts in (("boolean", ("boolean",)), ("integer", ("integer",)), ("float", ("integer", "float")), ("timestamp", ("timestamp",)), ("date", ("timestamp", "date")), ("integer_array", ("integer_array",))):
        every = every.when(sum((F.col(p) for p in parts[1:]), F.col(parts[0])) == F.col("known"), name)
    return found.select("entity_table_name", "key", every.otherwise("string").alias("data_type"))


def schema_text(types: DataFrame) -> DataFrame:
    """One row: the inferred schema as JSON text, entities and keys in order. It has a line for each known key."""
    key = F.struct(F.col("key").alias("keyName"), F.col("data_type").alias("dataType"))
    entities = types.groupBy("entity_table_name").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    whole = F.array_sort(F.collect_list(F.struct(F.col("entity_table_name").alias("entityTableName"), "keys")))
    return entities.agg(F.to_json(whole).alias("data_schema_json"))
