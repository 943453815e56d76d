"""Reconciliation of streamed entities with the application database by row counts and checksums."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import Entity
from tidemark.functions import kv, scalar

EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"


def ordered_md5(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``key, md5``: checksum of the texts ``value`` of each ``key`` (a long), in the order of ``at`` and then themselves.
    NULL texts are left out. See :func:`ordered_md5s`."""
    one = rows.select(key, at, value, F.lit(0).alias("_from"), F.lit(1).alias("_until"))
    return ordered_md5s(one, key, at, value, "_from", "_until").select(key, "md5")


def ordered_md5s(rows: DataFrame, key: str, at: str, value: str, first: str, until: str) -> DataFrame:
    """``key, slot, md5``: of each key the checksums of several slots; a row counts in those from ``first`` on, before
    ``until``. Texts are taken in the order of ``at`` and then themselves.

    The digest of an ordered text can only be taken in order, so one key is one task's; but its rows are sorted by
    Spark, which spills, and folded as they pass, once for all slots, so a task holds a batch of them and one digest
    a slot, however many they are.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digests = None, {}
        done: list[tuple[int, int, str]] = []
        for batch in batches:
            keys, lows, highs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in itertools.pairwise(cuts):
                if keys[lo] != now:
                    done += [(int(now), slot, d.hexdigest()) for slot, d in digests.items()]
                    now, digests = keys[lo], {}
                texts = np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), object)
                for slot in range(int(lows[lo:hi].min()), int(highs[lo:hi].max())):
                    own = texts[(lows[lo:hi] <= slot) & (slot < highs[lo:hi])]
                    if len(own):
                        digests.setdefault(slot, hashlib.md5(usedforsecurity=False)).update("".join(own).encode())
        done += [(int(now), slot, d.hexdigest()) for slot, d in digests.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in done], pa.int64()), pa.array([s for _, s, _ in done], pa.int32()), pa.array([d for _, _, d in done], pa.string())], names=[key, "slot", "md5"])

    known = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull() & (F.col(first) < F.col(until)))
    ordered = known.select(key, at, value, F.col(first).alias("_f"), F.col(until).alias("_u")).repartition(key).sortWithinPartitions(key, at, value)
    return ordered.select(key, value, "_f", "_u").mapInArrow(fold, f"`{key}` long, slot int, md5 string")


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, a table of checks, marked for broadcasting if it has at most so many rows; the count is taken first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _payload(name: str, kind: str = "string") -> Column:
    return kv.extract(kv.combined("data", "hidden_data"), name, kind)


def check_events(raw: DataFrame, event_type: str, since: Column | None = None) -> DataFrame:
    """The checks that the application streamed, typed: counts, checksum, when and in what order it was taken."""
    own = raw.where(F.col("event_type") == event_type)
    if since is not None:
        own = own.where(F.to_date("occurred_at") >= since)
    return own.select(
        "occurred_at", "entity_table_name", *(["event_tags"] if "event_tags" in raw.columns else []), _payload("row_count", "integer").alias("database_row_count"),
        _payload("checksum").alias("database_checksum"), _payload("checksum_calculated_at", "timestamp").alias("checksum_calculated_at"), F.lower(_payload("order_column")).alias("order_column"),
    )


def compare_scheduled(checks: DataFrame, history: DataFrame) -> DataFrame:
    """Nightly checks against the versions that were valid when each was taken.

    ``checks`` as from :func:`check_events`, the last of each table and day counts. Rows that changed at or after the
    time of a check (by its order column) are counted as excluded and left out of the checksum.

    A version is valid at a run of a table's checks in order of time, whichever they are: it meets the short list of
    these times, once, and is counted and digested with the first and last of its run, not copied to each check. The
    versions of an id must not overlap, as those of a history don't.
    """
    day = Window.partitionBy("entity_table_name", F.to_date("occurred_at")).orderBy(F.desc("occurred_at"))
    checks = checks.withColumn("_n", F.row_number().over(day)).where("_n = 1").drop("_n", "occurred_at", "event_tags")
    checks = checks.withColumn("_by", F.coalesce("order_column", F.lit("updated_at")))
    slots = checks.groupBy("entity_table_name", "_by").agg(F.array_sort(F.collect_set("checksum_calculated_at")).alias("_times")).withColumn("_group", F.xxhash64("entity_table_name", "_by"))
    rows = history.select(F.col("entity_table_name").alias("_table"), F.col("entity_id").alias("_id"), "valid_from", "valid_to", "created_at", "updated_at").where("_id is not null")
    met = few(slots).join(rows, F.col("entity_table_name") == F.col("_table"))
    at = F.when(F.col("_by") == "created_at", F.col("created_at")).when(F.col("_by") == "updated_at", F.col("updated_at"))
    milli = lambda c: F.date_trunc("MILLISECOND", c)

    def ahead(of: Callable[[Column], Column]) -> Column:
        """How many of the table's checks come before the first one for which ``of`` isn't true."""
        return F.size(F.filter("_times", lambda t: F.coalesce(of(t), F.lit(False))))

    met = met.withColumns(
        {
            "_first": ahead(lambda t: t < F.col("valid_from")), "_until": F.when(F.col("valid_to").isNull(), F.size("_times")).otherwise(ahead(lambda t: t < F.col("valid_to"))), "_at": milli(at),
            "_late": ahead(lambda t: t <= at), "_kept": F.when(F.col("_by") == "id", 0).when(at.isNull(), F.size("_times")).otherwise(ahead(lambda t: milli(t) <= milli(at))),
        }
    ).where("_first < _until")
    spans = met.groupBy("_group", "_first", "_until", "_late").agg(F.count(F.lit(1)).alias("_rows"))
    slot = F.posexplode("_times").alias("slot", "checksum_calculated_at")
    each = slots.select("entity_table_name", "_by", "_group", slot)
    of = (F.col("slot") >= F.col("_first")) & (F.col("slot") < F.col("_until"))
    counts = each.join(spans, "_group", "left").groupBy("_group", "slot").agg(F.coalesce(F.sum(F.when(of, F.col("_rows"))), F.lit(0)).alias("warehouse_row_count"), F.coalesce(F.sum(F.when(of & (F.col("slot") < F.col("_late")), F.col("_rows"))), F.lit(0)).alias("_excluded"))
    sums = ordered_md5s(met.withColumn("_first", F.greatest("_first", "_kept")), "_group", "_at", "_id", "_first", "_until")
    found = each.join(counts, ["_group", "slot"]).join(sums, ["_group", "slot"], "left").drop("_group", "slot")
    found = checks.join(found, ["entity_table_name", "_by", "checksum_calculated_at"]).withColumns({"warehouse_checksum": F.coalesce("md5", F.lit(EMPTY_MD5)), "rows_excluded_as_changed": F.when(F.col("_by") != "id", F.col("_excluded")), "checksum_calculated_on": F.to_date("checksum_calculated_at")})
    return with_trends(found.drop("md5", "_by", "_excluded"))


def with_trends(found: DataFrame) -> DataFrame:
    """Missing and extra rows, their change over seven checks of the table, and error rates now and in twelve weeks."""
    have, want = F.col("warehouse_row_count"), F.col("database_row_count")
    found = found.withColumns({"number_of_missing_rows": F.when(want > have, want - have), "number_of_extra_rows": F.when(want < have, have - want)})
    week = Window.partitionBy("entity_table_name").orderBy("checksum_calculated_on", "checksum_calculated_at")

    def change(name: str) -> Column:
        return F.col(name) - F.lag(name, 7).over(week)

    found = found.withColumns(
        {"weekly_change_in_number_of_missing_rows": change("number_of_missing_rows"), "weekly_change_in_number_of_extra_rows": change("number_of_extra_rows"), "weekly_change_in_number_of_rows": change("database_row_count")}
    )

    def later(name: str, drift: str) -> Column:
        return F.col(name) + 12 * F.col(drift)

    ahead = F.coalesce(later("number_of_missing_rows", "weekly_change_in_number_of_missing_rows"), later("number_of_extra_rows", "weekly_change_in_number_of_extra_rows"), F.lit(0))
    now = F.coalesce("number_of_missing_rows", "number_of_extra_rows", F.lit(0))
    return found.withColumns(
        {"error_rate": F.try_divide(now.cast("double"), want.cast("double")), "twelve_week_projected_error_rate": F.try_divide(ahead.cast("double"), later("database_row_count", "weekly_change_in_number_of_rows").cast("double"))}
    )


def import_events(raw: DataFrame, entities: list[Entity], since: Column | None = None) -> DataFrame:
    """The events of imports, typed: rows, that is events with one tag, the import's id, and the checks that came with
    them. ``entity_ids`` has the values of the entity's configured key (NULL for entities that aren't configured).

    What later runs need of imports is kept in this form, so that a run reads only what was streamed since the last.
    """
    tag, both = F.get("event_tags", F.lit(0)), kv.combined("data", "hidden_data")
    own = raw.where("(event_type = 'import_entity' and size(event_tags) = 1) or event_type = 'import_entity_table_check'")
    if since is not None:
        own = own.where(F.col("occurred_at") > since)
    ids, check = F.lit(None).cast("array<string>"), F.col("event_type") == "import_entity_table_check"
    for e in entities:
        ids = F.when(F.col("entity_table_name") == e.name, kv.values_of(both, e.id_key)).otherwise(ids)
    stamp = lambda name: scalar.string_to_timestamp(_payload(name))
    of_check = {"database_row_count": _payload("row_count", "integer"), "database_checksum": _payload("checksum"), "checksum_calculated_at": _payload("checksum_calculated_at", "timestamp"), "order_column": F.lower(_payload("order_column"))}
    of_row = {"id": _payload("id"), "created_at": stamp("created_at"), "updated_at": stamp("updated_at"), "entity_ids": ids}
    return own.select(
        tag.alias("import_id"), "entity_table_name", "occurred_at", check.alias("is_check"), *[F.when(check, c).alias(n) for n, c in of_check.items()], *[F.when(~check, c).alias(n) for n, c in of_row.items()]
    )


def touched_imports(events: DataFrame, since: Column | None) -> DataFrame:
    """Of :func:`import_events` those of imports that anything was streamed of since then; all without a time.

    Imports are few and named in the scan's filter, so that of a table by import only their folders are read.
    """
    if since is None:
        return events
    new = events.where(F.col("occurred_at") > since).select("import_id").distinct().collect()  # a row an import
    return events.where(F.col("import_id").isin([r.import_id for r in new])) if new else events.limit(0)


def compare_imports(events: DataFrame) -> DataFrame:
    """Imports against the checks that came with them, by import id; of :func:`import_events`.

    Of an id that an import has more than once, the latest row counts. The id is always the key ``id``.
    """
    checks = events.where("is_check").select("import_id", "entity_table_name", "database_row_count", "database_checksum", "order_column", "checksum_calculated_at", F.col("occurred_at").alias("_checked"))
    last = Window.partitionBy("import_id", "entity_table_name", "id").orderBy(F.desc(F.coalesce("updated_at", "created_at", "occurred_at")), F.desc("occurred_at"))
    rows = events.where("not is_check and id is not null").select("import_id", "entity_table_name", "occurred_at", "id", "created_at", "updated_at")
    rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    by = F.coalesce(F.col("order_column"), F.lit("updated_at"))
    at = F.when(by == "created_at", F.col("created_at")).when(by == "updated_at", F.col("updated_at"))
    keep = F.col("id").isNotNull() & F.when(by == "id", True).otherwise(F.coalesce(F.date_trunc("MILLISECOND", at) < F.date_trunc("MILLISECOND", F.col("checksum_calculated_at")), F.lit(False)))
    own = ["import_id", "entity_table_name", "database_row_count", "database_checksum", "order_column", "checksum_calculated_at"]
    met = few(checks.groupBy(*own).agg(F.max("_checked").alias("_checked"))).join(rows, ["import_id", "entity_table_name"], "right").where("_checked is not null")
    number = F.xxhash64(*own).alias("_check")
    sums = ordered_md5(met.where(keep).select(number, F.date_trunc("MILLISECOND", at).alias("_at"), "id"), "_check", "_at", "id")
    counts = met.groupBy(number).agg(F.count_distinct("id").alias("warehouse_row_count"), F.max("occurred_at").alias("_last"))
    found = checks.groupBy(*own).agg(F.max("_checked").alias("_checked")).withColumn("_check", number)
    found = found.join(counts, "_check", "left").join(sums, "_check", "left")
    return found.select(*own, F.coalesce("warehouse_row_count", F.lit(0)).alias("warehouse_row_count"), F.greatest("_last", "_checked").alias("final_import_event_received_at"), F.coalesce("md5", F.lit(EMPTY_MD5)).alias("warehouse_checksum"))


def imported_ids(events: DataFrame) -> DataFrame:
    """``import_id, entity_table_name, entity_id`` of every row of every import, by each entity's configured key; of
    :func:`import_events`.

    An event that has several values of the key is a row for each; without one it is none.
    """
    found = events.where("not is_check").select("import_id", "entity_table_name", F.explode("entity_ids").alias("entity_id"))
    return found.where("entity_id is not null")


def infer_deletions(history: DataFrame, imports: DataFrame, imported: DataFrame) -> DataFrame:
    """``history`` with open versions closed that later complete imports no longer have.

    ``imports``: compared imports; complete are those whose checksums match. ``imported``: (import_id,
    entity_table_name, entity_id) of their rows. A version that began before a complete import of its table was taken,
    and whose id is in none of these, ends when the first of them was taken. The imports of a table are one short list
    of times (their number is that of imports, not of rows), so versions are joined by id alone, once.
    """
    complete = imports.where("database_checksum = warehouse_checksum").select("import_id", "entity_table_name", F.col("checksum_calculated_at").alias("_taken")).distinct()
    present = imported.select("import_id", "entity_table_name", "entity_id").join(few(complete), ["import_id", "entity_table_name"])
    present = present.groupBy("entity_table_name", "entity_id").agg(F.max("_taken").alias("_present"))
    times = few(complete.groupBy("entity_table_name").agg(F.array_sort(F.collect_set("_taken")).alias("_times")))
    joined = history.join(present, ["entity_table_name", "entity_id"], "left").join(times, "entity_table_name", "left")
    first = F.get(F.filter("_times", lambda t: t > F.col("valid_from")), F.lit(0))
    ended = F.when(~F.coalesce(F.col("_present") > F.col("valid_from"), F.lit(False)), first)
    return joined.withColumn("valid_to", F.coalesce(F.col("valid_to"), ended)).select(history.columns)


def mismatches(compared: DataFrame) -> DataFrame:
    """Checks whose checksum or count differs, with the reason in words."""
    more, less = F.col("number_of_missing_rows") > 0, F.col("number_of_extra_rows") > 0
    if "number_of_missing_rows" not in compared.columns:
        more, less = F.col("database_row_count") > F.col("warehouse_row_count"), F.col("database_row_count") < F.col("warehouse_row_count")
    why = F.when(more, "rows are missing").when(less, "there are rows too many").otherwise("as many rows, but other ids or another order")
    return compared.where("database_checksum <> warehouse_checksum or database_row_count <> warehouse_row_count").withColumn("issue", why)
