import os
import time
from datetime import date, datetime, timedelta
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tidemark.config import Cdc, CustomEvent, Entity, Key, PipelineConfig
from tidemark.operators import cdc, checks, entity, events, intervals, keys, quality, web
from tidemark.plans import migration, pipeline
from tidemark.plans.assertions import assertions, blocked, broken
from tidemark.plans.tables import Store, block_sample
from tidemark.sources.adapters import RAW
from tidemark.streaming import incremental

T0 = datetime(2024, 1, 1, 9)
CFG = PipelineConfig("shop", "www.own.org", entities=[Entity("user", [Key("name", past_names=("title",)), Key("age", "integer")])], funnel_depth=3, attribution=("utm_source", "utm_medium", "utm_campaign", "utm_content"))
UA = "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Firefox/1"


def raw(spark, *rows):
    schema = ", ".join(f"{k} {v}" for k, v in RAW.items())
    return spark.createDataFrame([tuple(r.get(k) for k in RAW) for r in rows], schema)


def change(minute, kind, key, **fields):
    return {"occurred_at": T0 + timedelta(minutes=minute), "event_type": f"{kind}_entity", "entity_table_name": "user", "data": [("id", [key]), *[(k, [v]) for k, v in fields.items()]], "hidden_data": []}


def view(minute, uuid, path, referer=None, user=None, visitor="v", **more):
    own = {"occurred_at": T0 + timedelta(minutes=minute), "event_type": "web_request", "request_uuid": uuid, "request_path": path, "request_referer": referer and f"https://www.own.org{referer}", "user_id": user}
    return own | {"anonymised_user_agent_and_ip": visitor, "response_content_type": "text/html", "response_status": "200", "request_user_agent": UA, "request_query": [], "data": [], "hidden_data": []} | more


def test_versions(spark):
    rows = raw(spark, change(0, "create", "1", name="a"), change(5, "update", "1", name="b"), change(5, "update", "2", title="x", age="7"), change(9, "delete", "1"), change(12, "create", "1", name="c"), {**change(1, "create", "9"), "entity_table_name": "other"})
    found = entity.versions(rows, CFG.entities)
    got = sorted((r.entity_id, r.valid_from.minute, r.valid_to.minute if r.valid_to else None) for r in found.collect())
    assert got == [("1", 0, 5), ("1", 5, 9), ("1", 12, None), ("2", 5, None)]
    flat = entity.flatten_versions(found, CFG.entity("user"))
    assert {(r.id, r.name, r.age) for r in entity.latest(flat).collect()} == {("1", "c", None), ("2", "x", 7)}
    at = lambda m: {r.name for r in entity.at_time(flat, F.lit(T0 + timedelta(minutes=m))).where("id = '1'").collect()}
    assert at(5) == {"b"} and at(9) == set() and at(0) == {"a"}
    changes = entity.field_updates(found).collect()
    assert [(r.key_updated, r.previous_value, r.new_value, r.seconds_since_previous_update) for r in sorted(changes, key=lambda r: r.occurred_at)] == [("name", "a", "b", 300), ("name", "b", "c", 420)]


def test_same_instant_leaves_the_later_version(spark):
    found = entity.versions(raw(spark, change(0, "create", "1", name="a"), change(0, "update", "1", name="b")), CFG.entities).collect()
    assert [(r.event_type, r.valid_to) for r in found] == [("update_entity", None)]


def test_events_take_their_requests_context(spark):
    rows = raw(spark, view(0, "r1", "/later"), view(-1, "r1", "/first", user="u"), {"occurred_at": T0, "event_type": "login", "request_uuid": "r1", "data": [], "hidden_data": []})
    got = {r.event_type: (r.request_path, r.request_user_id, r.device_category) for r in events.enrich(rows).where("event_type = 'login'").collect()}
    assert got == {"login": ("/first", "u", "desktop")}


def funnel(spark, *rows):
    found = web.funnels(web.page_views(events.enrich(raw(spark, *rows))), CFG)
    return {r.request_uuid: r for r in found.collect()}


def test_funnels(spark):
    got = funnel(spark, view(0, "a", "/x"), view(1, "b", "/y/12", "/x"), view(2, "c", "/y/12", "/x"), view(3, "d", "/z", "/q"))
    assert set(got) == {"a", "b", "d"}  # c repeats b
    assert (got["a"].preceding_request_path_grouped_1, got["a"].following_request_path_grouped_1, got["a"].following_request_path_grouped_2) == ("Arrived on site", "/y/UID", "Other route")
    assert got["b"].following_request_path_grouped_1 == "Other route" and got["d"].following_request_path_grouped_1 == "Left site"
    assert got["b"].seconds_since_preceding_step_1 == 60.0 and got["a"].newly_arrived == "Newly arrived traffic" and got["b"].medium is None
    alone = funnel(spark, view(0, "a", "/x"))["a"]
    assert (alone.preceding_request_path_grouped_1, alone.following_request_path_grouped_1, alone.next_step) == ("Arrived on site", "Left site", "Left site immediately after this")


def test_session_gaps(spark):
    near, far = view(30, "b", "/y", user="u"), view(61 + 30, "c", "/z", user="u")
    near["occurred_at"] += timedelta(seconds=59)
    rows = web.session_details(events.enrich(raw(spark, view(0, "a", "/x", user="u"), near, far)), CFG)
    got = sorted((r.start_page, r.exit_page, r.count_pages_visited, r.session_time_in_seconds) for r in rows.collect())
    assert got == [("/x", "/y", 2, 1859), ("/z", "/z", 1, None)]
    linked = web.session_details(events.enrich(raw(spark, view(0, "a", "/x", user="u"), view(50, "b", "/y", "/x", user="u"))), CFG).collect()
    assert [r.count_pages_visited for r in linked] == [2]


def test_users_are_imputed(spark):
    rows = raw(spark, view(0, "a", "/x"), view(10, "b", "/y", user="u"), view(20, "c", "/z"), view(90, "d", "/w"))
    found = web.impute_users(web.following_pages(web.numbered(web.visits(events.enrich(rows))))).collect()
    assert {r.path: r.estimated_user for r in found} == {"/x": "u", "/y": "u", "/z": "u", "/w": None}


def log_row(key, minute, extracted, name="n", deleted=None, lsn="L"):
    at = T0 + timedelta(minutes=minute)
    text = lambda t: t and t.strftime("%Y-%m-%d %H:%M:%S")
    return (key, name, T0, at, f"{key}-{extracted}", T0 + timedelta(minutes=extracted), '{"sync_id": "1"}', text(at), text(deleted), lsn)


def test_cdc(spark):
    schema = "id long, name string, created_at timestamp, updated_at timestamp, _airbyte_raw_id string, _airbyte_extracted_at timestamp, _airbyte_meta string, _ab_cdc_updated_at string, _ab_cdc_deleted_at string, _ab_cdc_lsn string"
    gone = T0 + timedelta(minutes=9)
    rows = [log_row(1, 0, 1), log_row(1, 5, 6, "m"), log_row(1, 9, 10, deleted=gone), log_row(2, 0, 1), log_row(2, 0, 100, lsn="S"), log_row(3, 0, 1)]
    source = spark.createDataFrame(rows, schema)
    found = cdc.cdc_versions(source, [Key("name")])
    got = sorted((r.id, r.valid_from.minute, r.valid_to and r.valid_to.minute, r.is_deleted, r.version_number) for r in found.collect())
    assert got == [(1, 0, 5, False, 1), (1, 5, 9, True, 2), (2, 0, None, False, 1), (3, 0, None, False, 1)]
    as_of, options = F.lit(T0 + timedelta(days=1)), Cdc("d", min_live_fraction=0.5, max_delete_fraction=0.4)
    refreshes = cdc.full_refreshes(source, found, as_of, options)
    assert [r.lsn for r in refreshes.collect()] == ["S"]
    deletes = cdc.reconcile_deletes(source, found, refreshes, as_of)
    assert [r.id for r in deletes.collect()] == [3]
    assert [r.delete_fraction for r in cdc.exceeds_safe_volume(deletes, found, options).collect()] == [0.5]
    assert cdc.exceeds_safe_volume(deletes, found, Cdc("d", max_delete_fraction=0.4, force_snapshot_lsn="S")).isEmpty()
    once = cdc.apply_deletes(found, deletes)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, cdc.apply_deletes(once, deletes).collect()), key=str)
    assert once.where("valid_to is null").count() == 1


def test_runner_incremental_and_full_agree(spark, tmp_path):
    first = raw(spark, view(0, "a", "/x"), change(0, "create", "1", name="a"), change(1, "create", "2", name="z"), {"occurred_at": T0, "event_type": "initialise_analytics", "data": [("analytics_version", ["v1"])], "hidden_data": []})
    later = raw(spark, view(2000, "b", "/y"), change(2000, "update", "1", name="b"), change(2001, "delete", "2"))
    plan = pipeline.models(CFG, F.lit(T0 + timedelta(days=9)))
    store, whole = Store(spark, str(tmp_path / "inc")), Store(spark, str(tmp_path / "full"))
    pipeline.run(spark, store, plan, first)
    built = pipeline.run(spark, store, plan, first.unionByName(later))
    reference = pipeline.run(spark, whole, plan, first.unionByName(later))
    for name in ("events_shop", "shop_entity_version", "user_latest_shop", "pageview_with_funnels_shop", "sessions_shop", "client_history_shop"):
        a, b = (sorted(map(str, map(tuple, d[name].select(sorted(d[name].columns)).collect()))) for d in (built, reference))
        assert a == b and a, name


def test_stream(spark, tmp_path):
    """Two batches: the second one reads what is new of raw only, and models that are built as a whole wait for the end."""
    raw(spark, view(0, "a", "/x"), change(0, "create", "1", name="a")).write.parquet(str(tmp_path / "in/1"))
    schema = spark.read.parquet(str(tmp_path / "in/1")).schema
    store, plan = Store(spark, str(tmp_path / "out")), pipeline.models(CFG, F.lit(T0 + timedelta(days=9)))

    def go():
        incremental.run_stream(incremental.read_events(spark, str(tmp_path / "in/*"), schema), store, plan, str(tmp_path / "cp")).awaitTermination()

    go()
    assert store.read("events_shop").count() == 2 and not store.exists("user_latest_shop")
    raw(spark, view(3000, "b", "/y"), change(3000, "update", "1", name="b")).write.parquet(str(tmp_path / "in/2"))
    go()
    assert store.read("raw").count() == 4 and store.read("events_shop").count() == 4 and len({p["_day"] for p in store.partitions("raw")}) == 2
    later = store.read("raw", F.lit((T0 + timedelta(days=1)).date()))
    assert files_read(later) < files_read(store.read("raw")) and later.count() == 2
    built = incremental.finish(spark, store, plan)
    assert [r.name for r in built["user_latest_shop"].collect()] == ["b"] and store.read("shop_entity_version").count() == 2


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    store.merge("t", store.read("t").where("k = 2").withColumn("v", F.lit("c")), ["k"])
    store.append("t", spark.createDataFrame([(3, "d")], "k int, v string"))
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert store.expire("t", F.col("k") > 1) == 1 and store.expire("t", F.col("k") > 1) == 0
    assert store.read("t").count() == 2 and store.checkpoint("t", "k") == 3
    store.append("t", spark.createDataFrame([(4, 0.5)], "k int, w double"))
    assert sorted(((r.k, r.v, r.w) for r in store.read("t").collect()), key=str) == [(2, "c", None), (3, "d", None), (4, None, 0.5)]
    store.replace("t", store.read("t").where("k = 4"))  # computed from the table itself
    assert [r.k for r in store.read("t").collect()] == [4]
    for _ in range(2):  # a batch that is tried again is there once
        for n, k in (("0", 1), ("1", 2)):
            store.append("s", spark.createDataFrame([(k, T0)], "k int, at timestamp"), batch=n, by_day="at")
    assert sorted(r.k for r in store.read("s").collect()) == [1, 2] and len(store.partitions("s")) == 2


def files(store, name):
    return {f: os.path.getmtime(unquote(f.removeprefix("file://"))) for f in store._table(name).inputFiles()}


def test_merge_writes_touched_partitions_only(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, g string, at timestamp")
    day, store = lambda d: T0 + timedelta(days=d), Store(spark, str(tmp_path))
    store.replace("m", rows((1, "a", "x", day(0)), (2, "b", "y", day(0)), (3, "c", "x", day(1)), (4, "d", "it's", day(2)), (5, "e", None, None)), ["g"], by_day="at")
    before = files(store, "m")
    new = rows((1, "A", "x", day(0)), (6, "f", "z", day(0))).withColumn("_day", F.to_date("at"))
    assert store.merge("m", new, ["k"]) == 2
    after = files(store, "m")
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 2 and all(after[f] == before[f] for f in set(before) & set(after))
    got = lambda: sorted((r.k, r.v) for r in store.read("m").collect())
    assert got() == [(1, "A"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f")]
    moved = rows((3, "C", "y", day(1)), (4, "D", "x", day(1))).withColumn("_day", F.to_date("at"))  # from other partitions
    assert store.merge("m", moved, ["k"], within="_day >= '2024-01-02'") == 3
    assert got() == [(1, "A"), (2, "b"), (3, "C"), (4, "D"), (5, "e"), (6, "f")] and len(store.partitions("m")) == 6
    plan = store.read("m", F.lit(day(1)))._jdf.queryExecution().toString()
    assert plan.rpartition("PartitionFilters: [")[2].partition("]")[0].count("_day") >= 1


def test_expired_days_are_dropped_partitions(spark, tmp_path):
    """Whole days and types go without a file being written; others' files stay as they are."""
    rows = [(k, T0 + timedelta(days=k // 3), ("a", "b", "c")[k % 3]) for k in range(12)]
    store = Store(spark, str(tmp_path))
    store.replace("x", spark.createDataFrame(rows, "k int, at timestamp, kind string"), ["kind"], by_day="at")
    before = files(store, "x")
    assert store.drop_days("x", (T0 + timedelta(days=1)).date()) == 3
    assert set(files(store, "x")) < set(before) and not any(os.path.exists(f.removeprefix("file://")) for f in set(before) - set(files(store, "x")))
    kept = (F.col("kind") != "a") | (F.to_date("at") >= F.lit((T0 + timedelta(days=3)).date()))
    assert store.expire("x", kept) == 2 and set(files(store, "x")) < set(before)
    assert sorted(r.k for r in store.read("x").collect()) == [4, 5, 7, 8, 9, 10, 11]
    assert store.expire("x", F.col("k") != 7) == 1 and sorted(r.k for r in store.read("x").collect()) == [4, 5, 8, 9, 10, 11]
    assert store.drop_days("nothing", T0.date()) == 0


def test_stored_history_is_bucketed(spark, tmp_path):
    """Changes of fields and looks at a time need no shuffle of the stored history."""
    rows = raw(spark, *[change(k + m, "update" if m else "create", str(k), name=str(m % 3)) for k in range(20) for m in range(5)])
    plan, store = {n: m for n, m in pipeline.models(CFG, F.lit(T0 + timedelta(days=9))).items() if n in ("events_shop", "import_events_shop", "entity_table_check_import_shop", "shop_entity_version")}, Store(spark, str(tmp_path))
    pipeline.run(spark, store, plan, rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = entity.field_updates(store.read("shop_entity_version"))
        assert found.count() == entity.field_updates(entity.versions(events.enrich(rows), CFG.entities)).count() > 0
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Window" in text and "SelectedBucketsCount" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_block_sample(spark, tmp_path):
    """The rows of whole files; others aren't opened, and the choice is the same each time."""
    spark.range(4000).repartition(40).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    some = block_sample(table, 0.3)
    rows = some.collect()
    names = {r.f for r in some.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert 4 <= len(names) <= 22 and sorted(rows) == sorted(spark.read.parquet(*names).collect()) == sorted(block_sample(table, 0.3).collect())
    assert files_read(some) == len(names) < files_read(table)
    assert block_sample(table, 0.0).count() == 0 and block_sample(table, 1.0).count() == 4000


def files_read(df):
    """Files that the scan of a plan lists once it has run; of a plan of its own, as metrics start anew in each run."""
    df = df.select("*")
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


CHANGES = "id long, name string, created_at timestamp, updated_at timestamp, _airbyte_raw_id string, _airbyte_extracted_at timestamp, _airbyte_meta string, _ab_cdc_updated_at string, _ab_cdc_deleted_at string, _ab_cdc_lsn string"


def test_runner_of_change_data(spark, tmp_path):
    """Reconciled deletions are applied, logged once over two runs, and stopped by the guard."""
    rows = [log_row(k, 0, 1) for k in range(10)] + [log_row(k, 0, 100, lsn="S") for k in range(9)]
    logs, as_of = {"user_cdc": spark.createDataFrame(rows, CHANGES)}, F.lit(T0 + timedelta(days=1))
    config = lambda **o: PipelineConfig("shop", entities=[Entity("user", [Key("name")])], sessions=False, session_details=False, transform_entities=False, cdc=Cdc("d", reconcile=True, **o))
    plan, store = pipeline.models(config(), as_of), Store(spark, str(tmp_path / "a"))
    for _ in range(2):
        built = pipeline.run(spark, store, plan, raw(spark), logs=logs)
        assert [r.id for r in built["user_implied_deletions_shop"].collect()] == [9]
        assert sorted(r.id for r in built["user_cdc_latest_shop"].collect()) == list(range(9)) and built["user_cdc_version_shop"].count() == 10
    store = Store(spark, str(tmp_path / "b"))
    with pytest.raises(pipeline.ChecksFailed, match="user_implied_deletions"):
        pipeline.run(spark, store, pipeline.models(config(max_delete_fraction=0.05), as_of), raw(spark), logs=logs)
    assert store.exists("user_cdc_version_shop") and not store.exists("user_reconciled_version_shop")


def test_assertions_and_retention(spark, tmp_path):
    cfg = PipelineConfig("shop", sessions=False, session_details=False, transform_entities=False, expiration_days=9, entities=[Entity("user", [Key("name"), Key("colour")], freshness_days=1)], custom_events=[CustomEvent("login", freshness_days=5, freshness_off_in_quiet_ranges=True)])
    rows = raw(spark, change(0, "update", "1", name="a", age="7"), {"occurred_at": T0, "event_type": "odd", "data": [], "hidden_data": []}, {"occurred_at": T0 - timedelta(days=8), "event_type": "login", "data": [], "hidden_data": []})
    as_of = F.lit(T0 + timedelta(days=1))
    built = pipeline.run(spark, Store(spark, str(tmp_path)), pipeline.models(cfg, as_of), rows)
    assert built["events_shop"].count() == 3
    named = assertions(cfg, as_of, date(2024, 5, 1))
    assert set(broken(built, named)) == {"login_not_fresh", "fields_missing", "fields_unhandled", "custom_events_unhandled", "entities_not_backfilled"}
    assert "login_not_fresh" not in assertions(cfg, as_of, date(2024, 12, 25))
    later = F.lit(T0 + timedelta(days=2))
    built = pipeline.run(spark, Store(spark, str(tmp_path)), pipeline.models(cfg, later), rows.limit(0))
    assert sorted(r.event_type for r in built["events_shop"].collect()) == ["odd", "update_entity"]
    assert {"events_not_fresh", "user_not_fresh"} <= set(broken(built, assertions(cfg, F.lit(T0 + timedelta(days=4)), date(2024, 5, 1))))


def test_assertions_are_nodes_of_the_graph(spark, tmp_path):
    """One that blocks keeps what needs it from being built and no other; one that warns is reported."""
    cfg = PipelineConfig("shop", entities=[Entity("user", [Key("name"), Key("colour")], freshness_days=1)], sessions=False, session_details=False, transform_entities=False, cdc=Cdc("d"))
    log = spark.createDataFrame([log_row(1, 0, 1)], CHANGES).withColumn("colour", F.lit("red"))
    as_of, beat = F.lit(T0 + timedelta(days=9)), spark.createDataFrame([(T0,)], "_airbyte_extracted_at timestamp")
    plan = pipeline.with_assertions(pipeline.models(cfg, as_of), assertions(cfg, as_of, date(2024, 5, 1)), blocked(cfg))
    built = pipeline.run(spark, Store(spark, str(tmp_path / "a")), plan, raw(spark, change(0, "create", "1", name="a")), logs={"user_cdc": log, "heartbeat": beat})
    assert built["user_cdc_latest_shop"].count() == 1
    assert {n for n, m in plan.items() if m.mode == "assertion" and not built[n].isEmpty()} == {"heartbeat_not_fresh", "user_changes_not_fresh", "events_not_fresh", "user_not_fresh", "entities_not_backfilled"}
    with pytest.raises(pipeline.ChecksFailed, match="user_columns_not_configured") as caught:
        pipeline.run(spark, Store(spark, str(tmp_path / "b")), plan, raw(spark, change(0, "create", "1", name="a")), logs={"user_cdc": log.withColumn("secret", F.lit("x")), "heartbeat": beat.limit(0)})
    assert caught.value.skipped == ["user_cdc_version_shop", "user_cdc_latest_shop"] and set(caught.value.failed) == {"user_columns_not_configured"}
    assert caught.value.built["events_shop"].count() == 1 and caught.value.built["heartbeat_not_fresh"].count() == 1
    with pytest.raises(LookupError, match="heartbeat"):
        pipeline.run(spark, Store(spark, str(tmp_path / "c")), plan, raw(spark), logs={"user_cdc": log})
    quiet = PipelineConfig("shop", entities=cfg.entities, sessions=False, session_details=False, cdc=Cdc("d", freshness_off_in_quiet_ranges=True))
    assert "heartbeat_not_fresh" not in assertions(quiet, as_of, date(2024, 12, 25)) and "heartbeat_not_fresh" in assertions(quiet, as_of, date(2024, 5, 1))


def test_hidden_data_assertions_by_day(spark, tmp_path):
    """A mistake of yesterday is told by one assertion, one of long ago by the other, over a sample of blocks."""
    cfg = PipelineConfig("shop", entities=[Entity("user", [Key("name", hidden=True)])], sessions=False, session_details=False, transform_entities=False, hidden_policy="pii")
    store = Store(spark, str(tmp_path))
    store.replace("events_shop", events.enrich(raw(spark, change(0, "update", "1", name="a"))), ["event_type"], by_day="occurred_at")
    named = assertions(cfg, F.lit(T0 + timedelta(days=1)), date(2024, 1, 2))
    built = {"events_shop": store.read("events_shop")}
    assert named["hidden_mismatch_yesterday"].build(built, None).count() == 1 and named["hidden_mismatch_historic"].build(built, None).count() == 0
    whole = quality.hidden_mismatch(block_sample(built["events_shop"], 1.0), cfg, before=F.lit(date(2024, 1, 9)))
    assert [(r["name"], r.key_configured) for r in whole.collect()] == [("user", "name")]


def test_imports_since_yesterday(spark):
    cfg = PipelineConfig("shop", entities=[Entity("user")], sessions=False, session_details=False, compare_checksums=True)
    rows = spark.createDataFrame([("a", "user", "x", "y", 1, 1, T0), ("b", "user", "x", "y", 2, 1, T0 + timedelta(days=5))], "import_id string, entity_table_name string, database_checksum string, warehouse_checksum string, database_row_count long, warehouse_row_count long, checksum_calculated_at timestamp")
    named = assertions(cfg, F.lit(T0 + timedelta(days=6)), date(2024, 1, 7))["imported_ids_do_not_match"]
    assert [r.import_id for r in named.build({"entity_table_check_import_shop": rows}, None).collect()] == ["b"]


def test_change_data_goes_on_from_its_history(spark, tmp_path):
    """Runs over a growing log give what one run gives: new versions, full refreshes, deletions, returns; and only a row
    that is older than what its id has makes a run build all anew."""
    rows = [log_row(k, m, m + 1, lsn="L", name=f"n{m}") for k in range(6) for m in (0, 10)]
    more = [log_row(k, 10, 50, lsn="S", name="n10") for k in range(4)] + [log_row(4, 40, 51, deleted=T0 + timedelta(minutes=40)), log_row(0, 60, 61, name="z"), log_row(9, 60, 61, name="new")]
    last = [log_row(4, 70, 71, name="back"), log_row(1, 80, 81, deleted=T0 + timedelta(minutes=80)), log_row(5, 10, 90, lsn="S2", name="n10")]
    old = [log_row(2, 5, 100, name="late")]
    config = PipelineConfig("shop", entities=[Entity("user", [Key("name")])], sessions=False, session_details=False, transform_entities=False, cdc=Cdc("d"))
    plan = {n: m for n, m in pipeline.models(config, F.lit(T0)).items() if "cdc" in n}
    store, seen = Store(spark, str(tmp_path)), []
    for k, new in enumerate((rows, more, last, old)):
        seen += new
        log = spark.createDataFrame(seen, CHANGES)
        closed = {f for f in files(store, "user_cdc_version_shop") if "run-" in f} if k else set()
        built = pipeline.run(spark, store, plan, raw(spark), logs={"user_cdc": log})["user_cdc_version_shop"]
        whole = cdc.cdc_versions(log, [Key("name")])
        order = sorted(whole.columns)
        assert sorted(map(str, built.select(order).collect())) == sorted(map(str, whole.select(order).collect())), k
        assert (closed <= set(files(store, "user_cdc_version_shop"))) == (k < 3)
    assert max(r.version_number for r in built.collect()) == 3


def test_change_data_after_a_cutoff(spark, tmp_path):
    """The event stream's versions up to the cutoff come before the log's, which count where both have one."""
    config = PipelineConfig("shop", entities=[Entity("user", [Key("name")])], sessions=False, session_details=False, cdc=Cdc("d", legacy_cutoff="2024-01-01 09:30:00"))
    stream = raw(spark, change(0, "create", "1", name="a"), change(20, "update", "1", name="b"), change(40, "update", "1", name="gone"), change(5, "create", "2", name="x"))
    log = spark.createDataFrame([log_row(1, 20, 31, name="B"), log_row(1, 50, 51, name="c"), log_row(2, 60, 61, deleted=T0 + timedelta(minutes=60)), log_row(3, 10, 11, name="before")], CHANGES).withColumn("id", F.col("id").cast("string"))
    built = pipeline.run(spark, Store(spark, str(tmp_path)), pipeline.models(config, F.lit(T0 + timedelta(days=1))), stream, logs={"user_cdc": log})["user_cdc_version_shop"]
    at = lambda m: T0 + timedelta(minutes=m)
    got = sorted((r.id, r.valid_from, r.valid_to, r["name"], r.version_number, r.is_current, r.is_deleted) for r in built.collect())
    assert got == [("1", at(0), at(20), "a", 1, False, False), ("1", at(20), at(50), "B", 2, False, False), ("1", at(50), None, "c", 3, True, False), ("2", at(5), at(60), "x", 1, False, True)]


def test_imports_are_carried_state(spark, tmp_path):
    """An import that is streamed over two runs is compared whole, though the second run reads new events only."""
    import hashlib

    def event(minute, kind, **data):
        return {"occurred_at": T0 + timedelta(minutes=minute), "event_type": kind, "entity_table_name": "user", "event_tags": ["i"], "hidden_data": [], "data": [(k, [v]) for k, v in data.items()]}

    check = event(3000, "import_entity_table_check", row_count="3", checksum=hashlib.md5(b"123").hexdigest(), checksum_calculated_at="2024-01-02T00:00:00+00:00", order_column="id")
    first, later = [event(0, "import_entity", id="1"), event(1, "import_entity", id="2")], [event(2999, "import_entity", id="3"), check, event(3000, "import_entity", id="9") | {"event_tags": ["i", "j"]}]
    names = ("events_shop", "import_events_shop", "entity_table_check_import_shop", "shop_entity_version")
    plan = {n: m for n, m in pipeline.models(PipelineConfig("shop", entities=[Entity("user")], sessions=False, session_details=False), F.lit(T0 + timedelta(days=9))).items() if n in names}
    store = Store(spark, str(tmp_path))
    assert pipeline.run(spark, store, plan, raw(spark, *first))["entity_table_check_import_shop"].count() == 0
    store.append("raw", raw(spark, *later), by_day="occurred_at")  # what came before isn't there any more
    found = pipeline.run(spark, store, plan, store.read("raw"))["entity_table_check_import_shop"].collect()
    assert [(r.import_id, r.warehouse_row_count, r.database_checksum == r.warehouse_checksum) for r in found] == [("i", 3, True)]


def test_tables_say_what_they_are(spark, tmp_path):
    """Descriptions of tables and columns, labels and declared keys, from the catalogue; and orphans as an assertion."""
    cfg = PipelineConfig("shop", entities=[Entity("user", [Key("name", description="it's a name"), Key("boss", foreign_key_table="user")], description="People")], sessions=False, session_details=False)
    store, as_of = Store(spark, str(tmp_path)), F.lit(T0 + timedelta(days=9))
    plan = pipeline.with_assertions(pipeline.models(cfg, as_of), {n: m for n, m in assertions(cfg, as_of, date(2024, 5, 1)).items() if "without" in n})
    built = pipeline.run(spark, store, plan, raw(spark, change(0, "create", "1", name="a", boss="2"), change(1, "create", "2", name="b", boss="7")))
    assert [(r.column_name, r.value) for r in built["user_boss_without_user"].collect()] == [("boss", "7")]
    said = store.properties("user_latest_shop")
    assert said["primary_key"] == "id" and said["foreign_key.boss"] == "user_latest_shop.id" and said["eventsource"] == "shop" and said["entitytype"] == "latest"
    columns = {c.name: c.description for c in spark.catalog.listColumns(store._name("user_version_shop"))}
    assert columns["name"] == "it's a name" and spark.catalog.getTable(store._name("user_version_shop")).description == "People"


def test_requests_beyond_the_seam_and_late_events(spark, tmp_path):
    """A later run finds the request of the day before its checkpoint; events older than that wait for a full run, which
    leaves protected tables alone."""
    plan = {n: m for n, m in pipeline.models(CFG, F.lit(T0 + timedelta(days=9))).items() if n == "events_shop"}
    plan["kept"] = pipeline.Model("kept", lambda i, cp: i["events_shop"].select("occurred_at", "request_uuid"), ("events_shop",), "append", protected=True)
    store, night = Store(spark, str(tmp_path)), 14 * 60 + 50  # minutes from T0 to 23:50
    first, late = [view(night, "r", "/x"), view(night + 12, "q", "/y")], {**view(5, "old", "/late")}
    order = {"occurred_at": T0 + timedelta(minutes=night + 30), "event_type": "order", "request_uuid": "r", "data": [], "hidden_data": []}
    store.append("raw", raw(spark, *first), by_day="occurred_at")
    pipeline.run(spark, store, plan, store.read("raw"))
    store.append("raw", raw(spark, order, late), by_day="occurred_at")
    built = pipeline.run(spark, store, plan, store.read("raw"))["events_shop"]
    assert {(r.event_type, r.request_uuid): r.request_path for r in built.collect()} == {("web_request", "r"): "/x", ("web_request", "q"): "/y", ("order", "r"): "/x"}
    before = store.read("kept").count()
    built = pipeline.run(spark, store, plan, store.read("raw"), full=True)
    assert built["events_shop"].count() == 4 and built["kept"].count() == before + 4  # goes on, as it has no checkpoint


def test_foreign_keys(spark):
    entity_of = Entity("order", [Key("customer", foreign_key_table="customer"), Key("n")])
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "c")], "id int, customer string")
    other = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "id string")
    (key,) = keys.foreign_keys(entity_of)
    assert [tuple(r) for r in keys.orphans(rows, key, other).collect()] == [("customer", "b", 2)]
    assert keys.orphans(rows.limit(0), key, other).count() == 0 and keys.orphans(rows, key, other.limit(0)).count() == 3
    twice = spark.createDataFrame([(1, 2), (1, 2), (3, None), (4, 5)], "a int, b int")
    assert sorted(map(str, keys.broken_primary_key(twice, ["a", "b"]).collect())) == ["Row(a=1, b=2, rows=2)", "Row(a=3, b=None, rows=1)"]


def test_as_of_join(spark):
    """Against every pair: ties, gaps, times before all versions, repeated rows, NULLs, clashing and odd names."""
    import random

    rng = random.Random(4)
    at = lambda m: None if m is None else T0 + timedelta(minutes=m)
    versions = [(k, at(m), at(m + rng.choice([5, 3])), f"{k}{m}") for k in "ab" for m in range(0, 40, 5)] + [("c", at(3), None, "c"), (None, at(0), None, "n")]
    rows = [(rng.choice(["a", "b", "c", "d", None]), at(rng.choice([*range(-3, 45), None])), i) for i in range(200)] * 2
    left = spark.createDataFrame(rows, "k string, at timestamp, `x y` int")
    right = spark.createDataFrame(versions, "k string, valid_from timestamp, valid_to timestamp, v string")
    want = [(k, t, i, next((v for q, a, b, v in versions if k is not None and q == k and t is not None and a <= t and (b is None or t < b)), None)) for k, t, i in rows]
    got = intervals.as_of_join(left, right, ["k"], "at")
    assert sorted(map(str, ((r.k, r.at, r["x y"], r.v) for r in got.collect()))) == sorted(map(str, want)) and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert intervals.as_of_join(left, right, ["k"], "at", "inner").count() == sum(w[3] is not None for w in want)


def test_checks_against_versions(spark):
    """Counts, exclusions and checksums of several checks a table, by all orders, as if each looked at all versions."""
    import hashlib
    import random

    rng = random.Random(7)
    at = lambda m: None if m is None else T0 + timedelta(minutes=m)
    history = []
    for i in range(60):
        cuts = sorted(rng.sample(range(0, 9000), 3))
        for a, b in zip(cuts, [*cuts[1:], rng.choice([None, 9500])], strict=True):
            history.append(("user" if i % 3 else "cat", str(i), at(a), at(b), at(rng.choice([a, a - 50, None])), at(rng.choice([a, a + 3000, None]))))
    taken = [(t, o, at(m)) for t, o, m in (("user", None, 1500), ("user", "updated_at", 3000), ("user", "created_at", 4500), ("user", "id", 6000), ("cat", "id", 1500), ("cat", "id", 7000), ("dog", None, 1500))]
    log = raw(spark, *[{"occurred_at": t, "event_type": "entity_table_check", "entity_table_name": n, "hidden_data": [], "data": [("row_count", ["20"]), ("checksum", ["x"]), ("checksum_calculated_at", [t.isoformat() + "+00:00"]), *([("order_column", [o])] if o else [])]} for n, o, t in taken])
    versions = spark.createDataFrame(history, "entity_table_name string, entity_id string, valid_from timestamp, valid_to timestamp, created_at timestamp, updated_at timestamp")
    found = {(r.entity_table_name, r.checksum_calculated_at): (r.warehouse_row_count, r.rows_excluded_as_changed, r.warehouse_checksum) for r in checks.compare_scheduled(checks.check_events(log, "entity_table_check"), versions).collect()}
    for n, o, t in taken:
        valid = [(c if o == "created_at" else u, i) for e, i, a, b, c, u in history if e == n and a <= t and (b is None or b > t)]
        kept = sorted(i for _, i in valid) if o == "id" else [i for _, i in sorted((x, i) for x, i in valid if x is not None and x < t)]
        late = None if o == "id" else sum(x is not None and x >= t for x, _ in valid)
        assert found[n, t] == (len(valid), late, hashlib.md5("".join(kept).encode()).hexdigest()), (n, o, t)
    assert len(found) == len(taken)


def test_anonymous_visits_of_one_page(spark):
    """Many visits of a page by nobody known: strangers end nobody's followers, and no key gathers them."""
    rows = raw(spark, *[view(m, f"{m}", "/x", visitor=None if m % 2 else f"v{m}") for m in range(400)], view(500, "f", "/y", "/x", visitor="v0"))
    visits = web.numbered(web.visits(events.enrich(rows)))
    found = web.following_pages(visits)
    assert {r.visitor: r.following_pages for r in found.where("following_pages > 0").collect()} == {"v0": 1}
    details = web.session_details(events.enrich(rows), CFG)
    assert details.count() == 400 and details.where("session_id is null").count() == 200


def test_inferred_deletions(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    history = spark.createDataFrame([("user", "1", at(0), None), ("user", "2", at(0), None), ("user", "3", at(0), at(5)), ("user", "4", at(30), None), ("cat", "1", at(0), None)], "entity_table_name string, entity_id string, valid_from timestamp, valid_to timestamp")
    imports = spark.createDataFrame([("a", "user", "x", "x", at(10)), ("b", "user", "x", "x", at(20)), ("c", "user", "x", "y", at(8)), ("d", "user", "x", "x", at(-5))], "import_id string, entity_table_name string, database_checksum string, warehouse_checksum string, checksum_calculated_at timestamp")
    imported = spark.createDataFrame([("b", "user", "2"), ("d", "user", "1"), ("c", "user", "1")], "import_id string, entity_table_name string, entity_id string")
    got = {(r.entity_table_name, r.entity_id): r.valid_to for r in checks.infer_deletions(history, imports, imported).collect()}
    assert got == {("user", "1"): at(10), ("user", "2"): None, ("user", "3"): at(5), ("user", "4"): None, ("cat", "1"): None}


def test_imported_ids(spark):
    row = lambda *tags, **data: {"event_type": "import_entity", "entity_table_name": "user", "event_tags": list(tags), "data": [(k, v) for k, v in data.items()], "hidden_data": []}
    rows = raw(spark, row("i", id=["1"]), row("i", id=["2", "3"]), row("i", other=["4"]), row("i", "j", id=["5"]), {**row("i", id=["6"]), "entity_table_name": "cat"}, {**row("i", id=["7"]), "event_type": "create_entity"})
    assert sorted(map(tuple, checks.imported_ids(checks.import_events(rows, CFG.entities)).collect())) == [("i", "user", "1"), ("i", "user", "2"), ("i", "user", "3")]


def test_ordered_md5(spark):
    """Rows in any order and number of batches, ties, NULLs and tables without rows."""
    import hashlib

    rows = [(k, T0 + timedelta(seconds=i * 7 % 50), str(i)) for i in range(3000) for k in (1, -2)] + [(1, None, "x"), (1, T0, None), (None, T0, "y"), (3, None, None)]
    found = spark.createDataFrame(rows, "k long, at timestamp, id string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    got = dict(map(tuple, checks.ordered_md5(found, "k", "at", "id").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    listed = lambda key: "".join(i for _, i in sorted((a or datetime.min, i) for k, a, i in rows if k == key and i is not None))
    assert got == {k: hashlib.md5(listed(k).encode()).hexdigest() for k in (1, -2)}
    assert checks.ordered_md5(found.limit(0), "k", "at", "id").collect() == []


def test_histories_write_only_what_is_open_or_new(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, until int")
    store = Store(spark, str(tmp_path))
    store.carry("h", rows((1, "a", 5), (1, "b", None), (2, "c", None)), "until is null", ["v"], buckets=(["k"], 2))
    assert sorted(r.k for r in store.read_open("h").collect()) == [1, 2]
    closed = {f for f in files(store, "h") if "_part=run-000001" in f}
    store.carry("h", rows((1, "b", 9), (2, "c", None)), "until is null", ["v"])
    assert closed and closed < set(files(store, "h")) and len(store.partitions("h")) == 3
    got = lambda: sorted((r.k, r.v, r.until) for r in store.read("h").collect())
    assert got()[:2] == [(1, "a", 5), (1, "b", 9)] and got()[2] == (2, "c", None)
    spark.sql(f"ALTER TABLE {store._name('h')} SET TBLPROPERTIES ('tidemark.runs' = '1')")  # the run died before it counted
    store.carry("h", rows((1, "b", 9), (2, "c", None)), "until is null", ["v"])
    assert len(got()) == 3
    store.carry("h", rows().where("k > 0"), "until is null", ["v"])  # nothing is open any more
    assert got() == [(1, "a", 5), (1, "b", 9)] and store.read_open("h").count() == 0
    assert store.expire("h", F.col("until") > 5) == 1 and got() == [(1, "b", 9)] and store.expire("h", F.col("until") > 5) == 0
    store.carry("h", rows((7, "z", None)), "until is null", ["v"], full=True)
    assert got() == [(7, "z", None)]


def test_days_are_replaced(spark, tmp_path):
    """Rows of the first day named and later ones are replaced, twice over; earlier days and rows without one stay."""
    rows = lambda *r: spark.createDataFrame([(k, T0 + timedelta(days=d) if d is not None else None) for k, d in r], "k int, at timestamp")
    day, store = lambda d: (T0 + timedelta(days=d)).date(), Store(spark, str(tmp_path))
    got = lambda **o: sorted(r.k for r in store.read("d", **o).collect())
    store.replace("d", rows((1, 0), (2, 1), (3, 2), (4, None)), by_day="at")
    store.replace_days("d", rows((5, 1), (6, 3)), day(1), "at")
    assert got() == [1, 4, 5, 6] and got(first_day=F.lit(day(1))) == [5, 6]
    store.replace_days("d", rows((7, 2)), day(2), "at")
    assert got() == [1, 4, 5, 7]
    store.append("d", rows((8, 0), (9, 9)), by_day="at")
    assert got() == [1, 4, 5, 7, 8, 9]
    assert store.expire("d", F.col("k") != 5) == 1 and got() == [1, 4, 7, 8, 9]
    store.replace_days("d", store.read("d").where("k = 9").unionByName(rows((6, 0))), day(0), "at")
    assert got() == [4, 6, 9]


def test_session_details_go_on_from_the_last_days(spark, tmp_path):
    """A later run that adds pages to a session over midnight gives what one run gives, and rewrites late days only."""
    night, began = 14 * 60 + 55, time.time()  # minutes from T0 to 23:55
    first = [view(0, "a", "/x", user="u"), view(1, "b", "/y", "/x", user="u"), view(3 * 1440 + night, "c", "/x", user="u"), view(3 * 1440 + night + 10, "d", "/z", user="w", visitor="o")]
    later = [view(3 * 1440 + night + 20, "e", "/y", "/x", user="u"), view(6 * 1440, "f", "/x", user="u")]
    plan = {n: m for n, m in pipeline.models(CFG, F.lit(T0 + timedelta(days=9))).items() if n in ("events_shop", "session_details_shop")}
    store, whole = Store(spark, str(tmp_path / "inc")), Store(spark, str(tmp_path / "full"))
    pipeline.run(spark, store, plan, raw(spark, *first))
    old = set(files(store, "session_details_shop"))
    built = pipeline.run(spark, store, plan, raw(spark, *first, *later))
    reference = pipeline.run(spark, whole, plan, raw(spark, *first, *later))
    left = os.path.join(spark.conf.get("spark.checkpoint.dir"), "tables")
    assert not [f for f in os.listdir(left) if f.startswith(("visits", "days")) and os.path.getmtime(os.path.join(left, f)) > began]
    a, b = (sorted(map(str, map(tuple, d["session_details_shop"].collect()))) for d in (built, reference))
    assert a == b and len(a) == 4
    assert old & set(files(store, "session_details_shop"))


def test_hidden_data_migration(spark, tmp_path):
    """Older events follow the configuration, today's and checks stay; events of yesterday in the wrong field stop it."""
    cfg = PipelineConfig("shop", entities=[Entity("user", [Key("name", hidden=True), Key("age")])], custom_events=[CustomEvent("login", [Key("k", hidden=True)])], sessions=False, session_details=False, hidden_policy="pii")
    login = {"occurred_at": T0, "event_type": "login", "data": [("k", ["1"])], "hidden_data": []}
    check = {**change(3, "entity_table", "1", row_count="5"), "event_type": "entity_table_check"}
    rows = raw(spark, change(0, "update", "1", name="a", age="7"), check, login, change(5000, "update", "1", name="b"))
    store, at = Store(spark, str(tmp_path)), lambda d: F.lit(T0 + timedelta(days=d))
    store.replace("e", rows, by_day="occurred_at")
    with pytest.raises(pipeline.ChecksFailed, match="name"):
        migration.migrate_hidden(store, "e", cfg, at(1))
    found = lambda: sorted((r.occurred_at, r.event_type, [k.key for k in r.data], [k.key for k in r.hidden_data]) for r in store.read("e").collect())
    assert [x[3] for x in found()] == [[]] * 4
    want = [(T0, "login", [], ["k"]), (T0, "update_entity", ["id", "age"], ["name"]), (T0 + timedelta(minutes=3), "entity_table_check", ["id", "row_count"], []), (T0 + timedelta(minutes=5000), "update_entity", ["id", "name"], [])]
    for _ in range(2):
        migration.migrate_hidden(store, "e", cfg, at(3))
        assert found() == want


def test_runner_infers_deletions(spark, tmp_path):
    """An id that a complete import lacks ends when that was taken, in a whole run and in a later one."""
    import hashlib

    def imported(*ids):
        at = T0 + timedelta(hours=1)
        own = {"occurred_at": at, "entity_table_name": "user", "event_tags": ["i1"], "hidden_data": []}
        check = own | {"event_type": "import_entity_table_check", "data": [("row_count", [str(len(ids))]), ("checksum", [hashlib.md5("".join(ids).encode()).hexdigest()]), ("checksum_calculated_at", ["2024-01-01T10:00:00+00:00"]), ("order_column", ["id"])]}
        return [check, *[own | {"event_type": "import_entity", "data": [("id", [i])]} for i in ids]]

    first = [change(0, "create", "1", name="a"), change(0, "create", "2", name="b")]
    plan = pipeline.models(PipelineConfig("shop", entities=[Entity("user", [Key("name")])], sessions=False, session_details=False), F.lit(T0 + timedelta(days=1)))
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    pipeline.run(spark, a, plan, raw(spark, *first))
    for store in (a, b):
        built = pipeline.run(spark, store, plan, raw(spark, *first, *imported("1")))
        got = {r.entity_id: r.valid_to for r in built["shop_entity_version"].where("event_type = 'create_entity'").collect()}
        assert got["2"] == T0 + timedelta(hours=1)


def test_snapshots_are_merged(spark, tmp_path):
    """A run that is repeated for the same time leaves one snapshot; another day's adds a partition and touches no other."""
    check = {"occurred_at": T0, "event_type": "entity_table_check", "entity_table_name": "user", "hidden_data": [], "data": [("row_count", ["1"]), ("checksum", ["x"]), ("checksum_calculated_at", ["2024-01-01T10:00:00+00:00"])]}
    rows, store = raw(spark, change(0, "create", "1", name="a"), check), Store(spark, str(tmp_path))
    config = PipelineConfig("shop", entities=[Entity("user", [Key("name")])], sessions=False, session_details=False)
    names = ("pipeline_table_snapshots_shop", "pipeline_snapshots_shop")
    for day in (1, 1, 2):
        before = [files(store, n) for n in names] if store.exists(names[1]) else []
        built = pipeline.run(spark, store, pipeline.models(config, F.lit(T0 + timedelta(days=day))), rows)
    assert [built[n].count() for n in names] == [2, 2] and all(len(store.partitions(n)) == 2 for n in names)
    assert all(set(b) <= set(files(store, n)) for b, n in zip(before, names, strict=True))


def test_enrichment_shuffles_once_by_request(spark):
    """Where nothing is small enough to be broadcast, repeats are removed in the join's partitions, and events without a
    request aren't gathered by their NULL."""
    order = {"occurred_at": T0, "event_type": "order", "request_uuid": "r", "data": [], "hidden_data": []}
    rows = raw(spark, view(0, "r", "/x"), order, order, *[{**order, "request_uuid": None, "occurred_at": T0 + timedelta(seconds=i // 2)} for i in range(100)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = events.enrich(rows)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        kept = found.collect()
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(kept) == 52 and {r.request_path for r in kept if r.request_uuid} == {"/x"} and "SortMergeJoin" in plan + text
    assert text.partition("Initial Plan")[0].count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("turned", [False, True])
def test_users_within_one_second_are_imputed_in_order_of_time(spark, turned):
    at = lambda s, us: T0 + timedelta(seconds=s, microseconds=us)
    rows = [("v", "a", at(0, 1)), ("v", "b", at(0, 2)), ("v", None, at(60, 0)), ("v", "c", at(120, 1)), ("v", "d", at(120, 2)), ("w", "a", at(0, 1)), ("w", "b", at(0, 2)), ("w", None, at(60, 0))]
    rows = [(visitor, user, when, f"/{i}", f"/{i}", i, None) for i, (visitor, user, when) in enumerate(rows)]
    schema = "visitor string, user string, occurred_at timestamp, page string, path string, visit long, first_following_user struct<f_at: timestamp, f_page: string, f_user: string>"
    found = web.impute_users(spark.createDataFrame(rows[::-1] if turned else rows, schema).coalesce(1))
    assert {r.visitor: r.estimated_user for r in found.where("user is null").collect()} == {"v": "c", "w": "b"}


def test_change_log_reads_its_lines_once(spark):
    from tidemark.sources import adapters

    log = adapters.order_changes(spark, "/root/testdata/sf0.001")
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("l_shipdate#") and plan.count("sf0.001/lineitem.parquet") == 1
    assert {r["_ab_cdc_lsn"][0]: r["n"] for r in log.groupBy(F.col("_ab_cdc_lsn").substr(1, 1).alias("_ab_cdc_lsn")).agg(F.count(F.lit(1)).alias("n")).collect()}.keys() == {"L", "D", "S"}


def test_legacy_versions_are_merged_in_one_shuffle(spark):
    schema = "id string, valid_from timestamp, valid_to timestamp, status string, is_deleted boolean"
    at = lambda m: T0 + timedelta(minutes=m)
    new = spark.createDataFrame([("1", at(2), None, "new", False), ("2", at(9), None, "new", False), (None, at(1), None, "new", False)], schema)
    old = spark.createDataFrame([("1", at(0), at(2), "old", False), ("1", at(2), None, "old", False), ("1", at(8), None, "late", False), (None, at(1), None, "old", False)], schema)
    merged = cdc.merge_legacy(new, old, F.lit(at(5)))
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    got = sorted((r.id or "", r.valid_from.minute, r.status, r.version_number) for r in merged.collect())
    assert [g[:3] for g in got] == [("", 1, "new"), ("", 1, "old"), ("1", 0, "old"), ("1", 2, "new"), ("2", 9, "new")] and [g[3] for g in got[2:]] == [1, 2, 1]


def test_types_are_inferred_beside_an_entry_without_values(spark):
    from tidemark.operators import catalogue

    row = change(0, "create", "1", flag="true", half="-.5", many="9" * 30, when="2024-05-01T10:00:00Z", day="1 May 2024", both="2024-05-01", list="[1, -2]", word="x1", none="", odd=" 7 ", nan="NaN")
    row["data"].append(("gone", None))
    more = change(1, "update", "1", flag="FALSE", half="3", both="2024-05-01T10:00:00Z", word="5", nan="inf", odd='"1 May 2024 3:30pm"')
    got = {r["key"]: r.data_type for r in catalogue.infer_types(raw(spark, row, more)).collect()}
    expected = {"flag": "boolean", "half": "float", "many": "float", "when": "timestamp", "day": "date", "both": "date", "list": "integer_array", "word": "string", "none": None, "odd": "string", "nan": "float", "id": "integer"}
    assert {k: v for k, v in got.items() if k != "gone"} == expected


def test_flattened_changes_are_read_from_the_version_that_changed(spark):
    rows = raw(spark, change(0, "create", "1", name="a", age="1"), change(5, "update", "1", title="x", age="2"), change(6, "update", "1", title="y", age="2", updated_at="z"), change(9, "update", "2", name="b"))
    history, user = entity.versions(rows, CFG.entities), CFG.entity("user")
    found = entity.field_updates(history, user)
    joined = entity.flatten_field_updates(entity.field_updates(history), entity.flatten_versions(history, user), user)
    assert found.columns == joined.columns and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, found.collect())) == sorted(map(str, joined.collect())) and found.count() == 2
