"""The registered queries: every model and assertion over inputs derived from the driver's tables, with SQL twins.

Times are compared as microseconds and arrays as texts, which both engines print alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Cdc, CustomEvent, Entity, Key, PipelineConfig
from tidemark.functions import kv, scalar
from tidemark.operators import catalogue, cdc, checks, entity, events, hidden, intervals, keys, quality, web
from tidemark.plans import monitoring
from tidemark.plans.tables import Store, block_sample, shared_folder, written_once
from tidemark.sources import adapters

ORDERS = Entity("orders", [Key("status"), Key("priority", alias="order_priority"), Key("total_cents", "integer"), Key("customer", "integer", hidden=True)])
PURCHASE = CustomEvent("purchase", [Key("cents", "integer"), Key("k", "integer"), Key("user", hidden=True)])
CONFIG = PipelineConfig("shop", adapters.OWN_SITE, entities=[ORDERS], custom_events=[PURCHASE], funnel_depth=4, hidden_policy="pii")
CDC_KEYS = [Key("status"), Key("priority"), Key("cents", "integer")]
CDC = Cdc("log", reconcile=True, min_snapshot_age_minutes=60, detection_window_days=7)
AS_OF = "2013-06-02 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that DuckDB should agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def stored(spark: SparkSession) -> Store:
    """A store of its own in the folder that the cluster shares."""
    name = f"q_{uuid.uuid4().hex}"
    return Store(spark, f"{shared_folder(spark)}/{name}", name)


def us(name: str, alias: str | None = None):
    return F.unix_micros(name).alias(alias or f"{name}_us")


_PATH = "CASE WHEN k % 3 = 0 THEN '/courses/' || CAST(k % 9 AS VARCHAR) WHEN k % 3 = 1 THEN '/apply' ELSE '/search' END"
_QUERY = "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '?page=' || CAST(k % 3 AS VARCHAR) WHEN 2 THEN '?utm_source=news&utm_medium=email' ELSE '?gclid=g' || CAST(k AS VARCHAR) END"
S = f"""s AS (SELECT event_id, user_id AS u, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  {adapters.START_US} + (epoch_us(ts) - {adapters.START_US}) // {adapters.SPEED} AS us FROM events)"""
W = f"""{S}, w1 AS (SELECT *, {_PATH} AS path, {_QUERY} AS qs FROM s WHERE kind IN ('click', 'view', 'error')),
w AS (SELECT event_id, us, make_timestamp(us) AS happened, CAST(make_timestamp(us) AS DATE) AS day, 'r' || CAST(event_id AS VARCHAR) AS uuid, path, qs, k, u,
  CASE WHEN event_id % 5 = 0 THEN CASE (event_id // 5) % 3 WHEN 0 THEN '{adapters.REFERERS[0]}' WHEN 1 THEN '{adapters.REFERERS[1]}' ELSE '{adapters.REFERERS[2]}' END
    ELSE 'https://{adapters.OWN_SITE}' || lag(path || qs) OVER (PARTITION BY u ORDER BY us, event_id) END AS referer,
  md5(CAST(u // 2 AS VARCHAR)) AS visitor, CASE WHEN event_id % 3 <> 0 THEN CAST(u AS VARCHAR) END AS usr,
  CASE WHEN k % 11 = 0 THEN 'application/json' ELSE 'text/html; charset=utf-8' END AS content, CASE WHEN k % 13 = 0 THEN '302' WHEN k % 17 = 0 THEN '404' ELSE '200' END AS status,
  CASE u % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' WHEN 2 THEN 'bot' ELSE 'unknown' END AS device FROM w1)"""
#: Path and sorted query of a referer: those of the inputs are sorted already but for the two utm parameters.
_SORTED = "CASE {x} WHEN '?utm_source=news&utm_medium=email' THEN '?utm_medium=email&utm_source=news' ELSE {x} END"
_REFERER_PQ = "CASE WHEN event_id % 5 = 0 THEN CASE (event_id // 5) % 3 WHEN 0 THEN '/search?q=a b' WHEN 1 THEN '/x' ELSE '/' END ELSE replace(replace(referer, 'https://www.example.gov.uk', ''), 'utm_source=news&utm_medium=email', 'utm_medium=email&utm_source=news') END"


@query(f"WITH {W} SELECT uuid AS request_uuid, us AS occurred_at_us, path AS request_path, usr AS user_id FROM w")
def events_earliest_request(spark, d):
    rows = events.earliest_requests(adapters.web_requests(spark, d))
    return rows.select("request_uuid", us("occurred_at"), "request_path", "user_id")


@query(
    f"""WITH {W}, e AS (SELECT uuid, 'web_request' AS kind, us, path, qs, usr, referer, device, event_id FROM w
  UNION ALL SELECT 'r' || CAST(s.event_id - 1 AS VARCHAR), s.kind, s.us, w.path, w.qs, coalesce(CASE WHEN s.event_id % 3 <> 0 THEN CAST(s.u AS VARCHAR) END, w.usr), w.referer, coalesce(w.device, 'unknown'), w.event_id
  FROM s LEFT JOIN w ON w.event_id = s.event_id - 1 WHERE s.kind IN ('signup', 'purchase'))
  SELECT uuid AS request_uuid, kind AS event_type, us AS occurred_at_us, usr AS request_user_id, path || {_SORTED.format(x="qs")} AS request_path_and_query,
  CASE WHEN regexp_matches(referer, 'https?://[^/]+') THEN regexp_extract(referer, 'https?://([^/]+)', 1) END AS request_referer_domain, {_REFERER_PQ} AS request_referer_path_and_query, device AS device_category FROM e"""
)
def events_enriched(spark, d):
    rows = events.enrich(adapters.stream(spark, d), "main")
    return rows.select("request_uuid", "event_type", us("occurred_at"), "request_user_id", "request_path_and_query", "request_referer_domain", "request_referer_path_and_query", "device_category")


@query(f"WITH {W} SELECT path || {_SORTED.format(x='qs')} AS request_path_and_query, count(*) AS requests FROM w GROUP BY ALL")
def standardise_path_query(spark, d):
    rows = adapters.web_requests(spark, d)
    full = F.concat("request_path", F.coalesce(F.concat(F.lit("?"), kv.query_text("request_query")), F.lit("")))
    return rows.groupBy(scalar.standardise_path_query(full).alias("request_path_and_query")).agg(F.count(F.lit(1)).alias("requests"))


@query(f"WITH {W} SELECT device AS device_category, count(*) AS requests FROM w GROUP BY ALL")
def device_categories(spark, d):
    return adapters.web_requests(spark, d).groupBy(scalar.device_category("request_user_agent").alias("device_category")).agg(F.count(F.lit(1)).alias("requests"))


@query(
    f"""WITH {W} SELECT t.*, count(*) AS requests FROM w JOIN (VALUES (0, 'pc', 'Chrome', '120.0.0.0', 'Windows', 'Microsoft', '10.0'), (1, 'smartphone', 'Safari', '17.0', 'iPhone', 'Apple', '17.0'),
  (2, 'unknown', 'curl', '8.0', 'unknown', 'unknown', 'unknown'), (3, 'unknown', 'unknown', 'unknown', 'unknown', 'unknown', 'unknown')) a(kind, category, name, version, os, vendor, os_version) ON u % 4 = kind,
  LATERAL (SELECT category, name, version, os, vendor, os_version) t GROUP BY ALL"""
)
def user_agents(spark, d):
    agent = scalar.parse_user_agent("request_user_agent")
    return adapters.web_requests(spark, d).groupBy(agent.alias("a")).agg(F.count(F.lit(1)).alias("requests")).select("a.*", "requests")


@query(f"WITH {W} SELECT uuid AS request_uuid, replace(referer, '%20', ' ') AS referer FROM w")
def decode_uri(spark, d):
    return adapters.web_requests(spark, d).select("request_uuid", scalar.decode_uri("request_referer").alias("referer"))


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority, {_CENTS} AS total_cents, CAST(NULL AS BIGINT) AS bad_integer, o_orderpriority || ',' || CAST({_CENTS} AS VARCHAR) AS twice,
  epoch_us(o_orderdate) AS created_at_us, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_on, true AS has_status, false AS has_other, o_orderpriority AS by_prefix, 'X' AS replaced, 7 AS n_replaced FROM orders"""
)
def kv_functions(spark, d):
    rows = adapters.order_events(spark, d).where("event_type = 'create_entity'")
    doubled = F.concat(F.col("data"), adapters.pairs(priority=kv.extract("data", "total_cents")))
    changed = kv.replace_key(F.concat("data", "hidden_data"), "status", "X")
    return rows.select(
        kv.extract("data", "id").alias("id"), kv.extract("data", "priority").alias("priority"), kv.extract("data", "total_cents", "integer").alias("total_cents"), kv.extract("data", "priority", "integer").alias("bad_integer"),
        kv.extract(doubled, "priority").alias("twice"), F.unix_micros(kv.extract("data", "created_at", "timestamp")).alias("created_at_us"), kv.extract("data", "created_at", "date").cast("string").alias("created_on"),
        kv.has_key("data", "status").alias("has_status"), kv.has_key("data", "other").alias("has_other"), kv.extract_prefix("data", "prio").alias("by_prefix"), kv.extract(changed, "status").alias("replaced"), F.size(changed).alias("n_replaced"),
    )


E = f"""e AS (SELECT o_orderkey AS id, 'create_entity' AS et, o_orderdate AS happened, 'O' AS status, o_orderpriority AS priority, {_CENTS} AS cents, o_custkey AS customer, o_orderdate AS ordered, o_orderstatus AS final FROM orders
  UNION ALL SELECT o_orderkey, 'update_entity', l_shipdate, max(l_linestatus), o_orderpriority, {_CENTS}, o_custkey, o_orderdate, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate GROUP BY ALL
  UNION ALL SELECT o_orderkey, 'delete_entity', o_orderdate + INTERVAL 2000 DAY, 'F', o_orderpriority, {_CENTS}, o_custkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus = 'F')"""
V = f"""{E}, v0 AS (SELECT *, lead(happened) OVER (PARTITION BY id ORDER BY happened, et) AS vt FROM e), v AS (SELECT * FROM v0 WHERE (vt IS NULL OR vt <> happened) AND et <> 'delete_entity')"""


def _versions(spark, d):
    return entity.versions(adapters.order_events(spark, d), [ORDERS])


def _flat(spark, d):
    return entity.flatten_versions(_versions(spark, d), ORDERS)


@query(f"WITH {V} SELECT CAST(id AS VARCHAR) AS entity_id, et AS event_type, epoch_us(happened) AS valid_from_us, epoch_us(vt) AS valid_to_us, epoch_us(ordered) AS created_at_us FROM v")
def entity_version(spark, d):
    return _versions(spark, d).select("entity_id", "event_type", us("valid_from"), us("valid_to"), us("created_at"))


_FLAT = "CAST(id AS VARCHAR) AS id, status, priority AS order_priority, cents AS total_cents, customer"


@query(f"WITH {V} SELECT {_FLAT}, et AS event_type, epoch_us(happened) AS valid_from_us, epoch_us(vt) AS valid_to_us FROM v")
def flattened_entity_version(spark, d):
    return _flat(spark, d).select("id", "status", "order_priority", "total_cents", "customer", "event_type", us("valid_from"), us("valid_to"))


@query(f"WITH {V} SELECT {_FLAT}, epoch_us(happened) AS last_streamed_us, et AS last_streamed_event_type FROM v WHERE vt IS NULL")
def entity_latest(spark, d):
    return entity.latest(_flat(spark, d)).select("id", "status", "order_priority", "total_cents", "customer", us("last_streamed_event_occurred_at", "last_streamed_us"), "last_streamed_event_type")


@query(f"WITH {V} SELECT {_FLAT} FROM v WHERE happened <= TIMESTAMP '1998-06-15' AND (vt IS NULL OR vt > TIMESTAMP '1998-06-15')")
def entity_at(spark, d):
    return entity.at_time(_flat(spark, d), F.lit("1998-06-15").cast("timestamp")).select("id", "status", "order_priority", "total_cents", "customer")


U = f"""{V}, l AS (SELECT *, lag(status) OVER w AS old, lag(happened) OVER w AS old_at, lag(et) OVER w AS old_et FROM v WINDOW w AS (PARTITION BY id ORDER BY happened, et)),
u AS (SELECT * FROM l WHERE old_at IS NOT NULL AND et IN ('create_entity', 'update_entity') AND status <> old)"""
_UPDATE = "CAST(id AS VARCHAR) AS entity_id, epoch_us(happened) AS occurred_at_us, 'status' AS key_updated, status AS new_value, old AS previous_value, epoch_us(old_at) AS previous_occurred_at_us, old_et AS previous_event_type, (epoch_us(happened) - epoch_us(old_at)) // 1000000 AS seconds_since_previous_update, (epoch_us(happened) - epoch_us(ordered)) // 1000000 AS seconds_since_created"


@query(f"WITH {U} SELECT {_UPDATE} FROM u")
def entity_field_updates(spark, d):
    rows = entity.field_updates(_versions(spark, d))
    return rows.select("entity_id", us("occurred_at"), "key_updated", "new_value", "previous_value", us("previous_occurred_at"), "previous_event_type", "seconds_since_previous_update", "seconds_since_created")


@query(f"WITH {U} SELECT CAST(id AS VARCHAR) AS entity_id, epoch_us(happened) AS occurred_at_us, old AS previous_value, status, cents AS total_cents FROM u")
def flattened_field_updates(spark, d):
    rows = entity.field_updates(_versions(spark, d), ORDERS)
    return rows.select("entity_id", us("occurred_at"), "previous_value", "status", "total_cents")


@query(f"WITH {U} SELECT CAST(id AS VARCHAR) AS entity_id, epoch_us(happened) AS occurred_at_us, status AS as_of_status FROM u")
def as_of_join(spark, d):
    versions = written_once(_versions(spark, d).select("valid_from", "valid_to", "event_type", *entity.ID, "created_at", "updated_at", "data", "hidden_data"), "versions")
    changes = entity.field_updates(versions).select("entity_id", "occurred_at")
    found = intervals.as_of_join(changes, versions.select("entity_id", "valid_from", "valid_to", kv.extract("data", "status").alias("as_of_status")), ["entity_id"], "occurred_at")
    return found.select("entity_id", us("occurred_at"), "as_of_status")


@query(f"WITH {S} SELECT us AS occurred_at_us, 'r' || CAST(event_id - 1 AS VARCHAR) AS request_uuid, CAST(round(value * 100) AS BIGINT) AS cents, k, CAST(u AS VARCHAR) AS \"user\" FROM s WHERE kind = 'purchase'")
def custom_event_flattened(spark, d):
    return entity.flatten_custom_event(adapters.custom_events(spark, d), PURCHASE).select(us("occurred_at"), "request_uuid", "cents", "k", "user")


def _clients(spark, d):
    """Events, of which every signup announces a client version too."""
    rows = adapters._stream(spark, d, "signup")
    starts = adapters.as_raw(rows, occurred_at=F.timestamp_micros("us"), event_type=F.lit("initialise_analytics"), data=adapters.pairs(analytics_version=F.concat(F.lit("v1."), F.col("k"))))
    return adapters.custom_events(spark, d).unionByName(starts)


@query(
    f"""WITH {S}, i AS (SELECT us, 'v1.' || CAST(k AS VARCHAR) AS version FROM s WHERE kind = 'signup')
  SELECT us AS valid_from_us, lead(us) OVER (ORDER BY us, version) AS valid_to_us, version FROM i UNION ALL SELECT min(us), (SELECT min(us) FROM i), NULL FROM s WHERE kind IN ('signup', 'purchase') HAVING (SELECT min(us) FROM i) IS NULL OR min(us) < (SELECT min(us) FROM i)"""
)
def configuration_history(spark, d):
    return catalogue.configuration_history(_clients(spark, d)).select(us("valid_from"), us("valid_to"), "version")


@query("SELECT * FROM (VALUES ('created_at', 'timestamp'), ('customer', 'integer'), ('id', 'integer'), ('priority', 'string'), ('status', 'string'), ('total_cents', 'integer'), ('updated_at', 'timestamp')) t(\"key\", data_type)")
def schema_inference(spark, d):
    return catalogue.infer_types(adapters.order_events(spark, d)).select("key", "data_type")


@query(
    """SELECT '[{"entityTableName":"orders","keys":[' || string_agg('{"keyName":"' || k || '","dataType":"' || t || '"}', ',' ORDER BY k) || ']}]' AS data_schema_json
  FROM (VALUES ('created_at', 'timestamp'), ('customer', 'integer'), ('id', 'integer'), ('priority', 'string'), ('status', 'string'), ('total_cents', 'integer'), ('updated_at', 'timestamp')) v(k, t)"""
)
def schema_proposal(spark, d):
    return catalogue.schema_text(catalogue.infer_types(adapters.order_events(spark, d)))


DAY = "1998-06-16"


def _config_with(*extra: Key) -> PipelineConfig:
    return PipelineConfig("shop", adapters.OWN_SITE, entities=[Entity("orders", [*ORDERS.keys, *extra])], custom_events=[PURCHASE], hidden_policy="pii")


@query(f"WITH {E} SELECT 'orders' AS entity_name, 'colour' AS expected_key, CAST(0 AS BIGINT) AS updates_with_key, count(*) AS updates_without_key FROM e WHERE et IN ('create_entity', 'update_entity') AND CAST(happened AS DATE) >= DATE '{DAY}' - 1 HAVING count(*) > 0")
def missing_expected_fields(spark, d):
    rows = quality.missing_expected_fields(adapters.order_events(spark, d), _config_with(Key("colour")), F.lit(DAY).cast("timestamp"))
    return rows.select("entity_name", "expected_key", "updates_with_key", "updates_without_key")


@query(f"WITH {E} SELECT 'orders' AS entity_table_name, 'priority' AS key_missing_from_pipeline, count(DISTINCT happened) AS updates_made_yesterday_with_this_key FROM e WHERE et IN ('create_entity', 'update_entity') AND CAST(happened AS DATE) = DATE '{DAY}' - 1 HAVING count(*) > 0")
def unhandled_fields(spark, d):
    config = PipelineConfig("shop", adapters.OWN_SITE, entities=[Entity("orders", [k for k in ORDERS.keys if k.name != "priority"])], hidden_policy="pii")
    return quality.unhandled_fields(adapters.order_events(spark, d), config, F.lit(DAY).cast("timestamp"))


@query(f"WITH {S} SELECT 'signup' AS unexpected_event_type, count(DISTINCT us) AS updates_made_yesterday FROM s WHERE kind = 'signup' AND CAST(make_timestamp(us) AS DATE) = DATE '2024-01-01' HAVING count(*) > 0")
def unhandled_custom_events(spark, d):
    return quality.unhandled_custom_events(adapters.stream(spark, d), CONFIG, F.lit("2024-01-02").cast("timestamp"))


@query(
    f"""WITH {E} SELECT 'orders' AS name, t.key AS key_configured, t.h AS hidden_configured, CASE WHEN t.key = 'customer' THEN count(*) ELSE 0 END AS updates_hidden, CASE WHEN t.key = 'customer' THEN 0 ELSE count(*) END AS updates_not_hidden
  FROM e, (VALUES ('customer', false), ('status', true)) t("key", h) WHERE et IN ('create_entity', 'update_entity') GROUP BY t.key, t.h"""
)
def hidden_mismatch(spark, d):
    swapped = PipelineConfig("shop", adapters.OWN_SITE, entities=[Entity("orders", [Key("status", hidden=True), Key("customer")])], hidden_policy="pii")
    rows = quality.hidden_mismatch(adapters.order_events(spark, d), swapped)
    return rows.select("name", "key_configured", "hidden_configured", "updates_hidden", "updates_not_hidden")


_SWAPPED = PipelineConfig("shop", adapters.OWN_SITE, entities=[Entity("orders", [Key("status", hidden=True), Key("customer")])], hidden_policy="pii")
_MISMATCH = """SELECT 'orders' AS name, t.key AS key_configured, t.h AS hidden_configured, CASE WHEN t.key = 'customer' THEN count(*) ELSE 0 END AS updates_hidden, CASE WHEN t.key = 'customer' THEN 0 ELSE count(*) END AS updates_not_hidden
  FROM e, (VALUES ('customer', false), ('status', true)) t("key", h) WHERE et IN ('create_entity', 'update_entity')"""


@query(f"WITH {E} {_MISMATCH} AND CAST('0x' || substr(md5('_block=' || CAST(id % 64 AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 1000000 < 100000 GROUP BY t.key, t.h")
def hidden_mismatch_sample(spark, d):
    """Over a tenth of 64 stored blocks: files of others aren't opened."""
    rows = adapters.order_events(spark, d).withColumn("_block", kv.extract("data", "id", "integer") % 64)
    stored = written_once(rows, "blocks", partition_by=["_block"])
    found = quality.hidden_mismatch(block_sample(stored, 0.1, block="_block=[0-9]+"), _SWAPPED)
    return found.select("name", "key_configured", "hidden_configured", "updates_hidden", "updates_not_hidden")


@query(f"WITH {E} {_MISMATCH} AND CAST(happened AS DATE) >= DATE '{DAY}' - 1 GROUP BY t.key, t.h")
def hidden_mismatch_yesterday(spark, d):
    rows = quality.hidden_mismatch(adapters.order_events(spark, d), _SWAPPED, since=F.date_sub(F.lit(DAY).cast("date"), 1))
    return rows.select("name", "key_configured", "hidden_configured", "updates_hidden", "updates_not_hidden")


@query("SELECT 'refunds' AS entity_table_name, CAST(0 AS BIGINT) AS number_of_import_events")
def not_backfilled(spark, d):
    config = PipelineConfig("shop", adapters.OWN_SITE, entities=[Entity("1-URGENT"), Entity("refunds")])
    return quality.not_backfilled(adapters.priority_rows(spark, d), config).select("entity_table_name", F.col("number_of_import_events").cast("bigint").alias("number_of_import_events"))


@query(f"WITH {S} SELECT max(us) AS last_occurred_at_us FROM s WHERE kind IN ('signup', 'purchase') HAVING max(us) < epoch_us(TIMESTAMP '2024-02-01') - 86400000000")
def data_freshness(spark, d):
    return quality.not_fresh(adapters.custom_events(spark, d), F.lit("2024-02-01").cast("timestamp"), 1).select(us("last_occurred_at"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark, d):
    return quality.not_unique(adapters.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


TABLES = [Entity(t) for t in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]


def _priority_versions(spark, d):
    return entity.versions(adapters.priority_rows(spark, d, "create_entity"), TABLES)


_K = """a AS (SELECT o_orderpriority AS t, count(*) AS n, md5(string_agg(CAST(o_orderkey AS VARCHAR), '' ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR))) AS c FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS t, count(*) AS n, md5(string_agg(CAST(o_orderkey AS VARCHAR), '' ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR))) AS c FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0) GROUP BY 1)"""


@query(
    f"""WITH {_K} SELECT a.t AS entity_table_name, a.n AS database_row_count, b.n AS warehouse_row_count, a.c AS database_checksum, b.c AS warehouse_checksum, CASE WHEN a.n > b.n THEN a.n - b.n END AS number_of_missing_rows,
  CAST(NULL AS BIGINT) AS number_of_extra_rows, CAST(a.n - b.n AS DOUBLE) / CAST(a.n AS DOUBLE) AS error_rate FROM a JOIN b USING (t)"""
)
def entity_table_check_scheduled(spark, d):
    rows = checks.compare_scheduled(checks.check_events(adapters.table_checks(spark, d), "entity_table_check"), _priority_versions(spark, d))
    return rows.select("entity_table_name", "database_row_count", "warehouse_row_count", "database_checksum", "warehouse_checksum", "number_of_missing_rows", "number_of_extra_rows", "error_rate")


def _import_events(spark, d):
    return checks.import_events(adapters.table_checks(spark, d, "import_entity_table_check").unionByName(adapters.priority_rows(spark, d)), TABLES)


def _imports(spark, d):
    return checks.compare_imports(_import_events(spark, d))


@query(f"WITH {_K} SELECT 'import1' AS import_id, a.t AS entity_table_name, a.n AS database_row_count, b.n AS warehouse_row_count, a.c AS database_checksum, b.c AS warehouse_checksum FROM a JOIN b USING (t)")
def entity_table_check_import(spark, d):
    return _imports(spark, d).select("import_id", "entity_table_name", "database_row_count", "warehouse_row_count", "database_checksum", "warehouse_checksum")


@query(f"WITH {_K} SELECT a.t AS entity_table_name, 'rows are missing' AS issue FROM a JOIN b USING (t) WHERE a.n <> b.n")
def ids_do_not_match(spark, d):
    return checks.mismatches(_imports(spark, d)).select("entity_table_name", "issue")


#: Every fifth order also stands for a row under the negative id that no import has.
_GONE = "WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0)"


@query(
    f"""SELECT o_orderpriority AS entity_table_name, CAST(o_orderkey AS VARCHAR) AS entity_id, CAST(NULL AS BIGINT) AS valid_to_us FROM orders {_GONE}
  UNION ALL SELECT o_orderpriority, '-' || CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderpriority <> '1-URGENT' THEN epoch_us(TIMESTAMP '2010-01-01') END FROM orders {_GONE} AND o_orderkey % 5 = 0"""
)
def inferred_deletions(spark, d):
    streamed = written_once(_import_events(spark, d), "imports")
    compared = written_once(checks.compare_imports(streamed), "compared")
    made = adapters.priority_rows(spark, d, "create_entity")
    key = kv.extract("data", "id")
    gone = made.where(key.cast("bigint") % 5 == 0).withColumn("data", kv.replace_key("data", "id", F.concat(F.lit("-"), key)))
    versions = entity.versions(made.unionByName(gone), TABLES)
    found = checks.infer_deletions(versions, compared, checks.imported_ids(streamed))
    return found.select("entity_table_name", "entity_id", us("valid_to"))


@query(
    f"""WITH {_K}, late AS (SELECT o_orderpriority AS t, count(*) AS late FROM orders {_GONE} AND o_orderkey % 7 = 0 GROUP BY 1),
  x AS (SELECT a.t, i, a.n + i AS want, b.n AS have, late, CASE WHEN a.n + i > b.n THEN a.n + i - b.n END AS missing FROM a JOIN b USING (t) JOIN late USING (t), range(8) r(i))
  SELECT t AS entity_table_name, CAST(i AS INTEGER) AS check_day, want AS database_row_count, have AS warehouse_row_count, CASE WHEN i <= 3 THEN late ELSE 0 END AS rows_excluded_as_changed, missing AS number_of_missing_rows,
  want - lag(want, 7) OVER o AS weekly_change_in_number_of_rows, missing - lag(missing, 7) OVER o AS weekly_change_in_number_of_missing_rows FROM x WINDOW o AS (PARTITION BY t ORDER BY i)"""
)
def entity_table_check_weekly(spark, d):
    """Eight daily checks of each table, whose count grows by one a day while some rows change on the fourth day."""
    taken = checks.check_events(adapters.table_checks(spark, d), "entity_table_check")
    days = spark.range(8).select(F.col("id").cast("int").alias("i"))
    later = lambda c: F.timestamp_add("DAY", F.col("i"), F.col(c))
    daily = taken.crossJoin(F.broadcast(days)).withColumns({"occurred_at": later("occurred_at"), "checksum_calculated_at": later("checksum_calculated_at"), "database_row_count": F.col("database_row_count") + F.col("i")}).drop("i")
    changed = F.when(F.col("entity_id").cast("bigint") % 7 == 0, F.lit("2010-01-04").cast("timestamp")).otherwise(F.col("updated_at"))
    rows = checks.compare_scheduled(daily, _priority_versions(spark, d).withColumn("updated_at", changed))
    day = F.datediff("checksum_calculated_on", F.lit("2010-01-01").cast("date")).alias("check_day")
    return rows.select("entity_table_name", day, "database_row_count", "warehouse_row_count", "rows_excluded_as_changed", "number_of_missing_rows", "weekly_change_in_number_of_rows", "weekly_change_in_number_of_missing_rows")


def _pages(spark, d):
    return web.page_views(events.enrich(adapters.web_requests(spark, d)), before=F.lit("2024-03-01").cast("date"))


P = f"""{W}, p0 AS (SELECT *, lag(path || ' ' || qs) OVER (PARTITION BY visitor, day ORDER BY us, uuid) AS before FROM w WHERE contains(content, 'text/html') AND day < DATE '2024-03-01'),
p AS (SELECT *, path || qs AS page, CASE WHEN event_id % 5 <> 0 THEN replace(referer, 'https://{adapters.OWN_SITE}', '') END AS own_referer, regexp_replace(path, '[0-9a-zA-Z]*[0-9][0-9a-zA-Z]*', 'UID', 'g') AS grp FROM p0 WHERE before IS NULL OR before <> path || ' ' || qs)"""


@query(f"WITH {P} SELECT uuid AS request_uuid, us AS occurred_at_us, path AS request_path FROM p")
def pageview_dedup(spark, d):
    return _pages(spark, d).select("request_uuid", us("occurred_at"), "request_path")


#: A referer is the whole request before it; that of a search is read with its blank, and matches no own page.
_STEP = "CASE WHEN {next}.own_referer IS NOT NULL AND {next}.own_referer = {prev}.page THEN 1 ELSE 0 END"
N = f"""{P}, n AS (SELECT *, row_number() OVER v AS i, count(*) OVER (PARTITION BY visitor, day) AS c FROM p WINDOW v AS (PARTITION BY visitor, day ORDER BY us, uuid)),
f AS (SELECT x.*, b1.grp AS b1g, b1.us AS b1us, b2.grp AS b2g, b2.us AS b2us, f1.grp AS f1g, f1.us AS f1us, f2.grp AS f2g, least(x.i - 1, 4) AS tb, least(x.c - x.i, 4) AS tf,
  {_STEP.format(next="x", prev="b1")} AS kb1, {_STEP.format(next="b1", prev="b2")} AS kb2, {_STEP.format(next="f1", prev="x")} AS kf1, {_STEP.format(next="f2", prev="f1")} AS kf2
  FROM n x LEFT JOIN n b1 ON b1.visitor = x.visitor AND b1.day = x.day AND b1.i = x.i - 1 LEFT JOIN n b2 ON b2.visitor = x.visitor AND b2.day = x.day AND b2.i = x.i - 2
  LEFT JOIN n f1 ON f1.visitor = x.visitor AND f1.day = x.day AND f1.i = x.i + 1 LEFT JOIN n f2 ON f2.visitor = x.visitor AND f2.day = x.day AND f2.i = x.i + 2)"""
_EXTERNAL = f"(referer IS NULL OR NOT contains(referer, '{adapters.OWN_SITE}'))"
_MEDIUM = f"""CASE WHEN contains(referer, '{adapters.OWN_SITE}') THEN NULL WHEN qs LIKE '%gclid%' THEN 'PPC' WHEN qs LIKE '%utm_medium=email%' THEN 'Email' WHEN contains(referer, 't.co') THEN 'Social' WHEN contains(referer, 'google') THEN 'Organic' WHEN referer IS NOT NULL THEN 'Referral' ELSE 'Direct or unknown' END"""


@query(
    f"""WITH {N} SELECT uuid AS request_uuid, CASE WHEN kb1 = 1 THEN b1g WHEN tb > 0 THEN 'Other route' ELSE 'Arrived on site' END AS preceding_1, CASE WHEN kf1 = 1 THEN f1g WHEN tf > 0 THEN 'Other route' ELSE 'Left site' END AS following_1,
  CASE WHEN kb1 = 1 AND kb2 = 1 THEN b2g WHEN kb1 = 1 AND tb = 2 THEN 'Other route' WHEN kb1 = 1 THEN 'Arrived on site' END AS preceding_2, CASE WHEN kf1 = 1 AND kf2 = 1 THEN f2g WHEN kf1 = 1 AND tf = 2 THEN 'Other route' WHEN kf1 = 1 THEN 'Left site' END AS following_2,
  CASE WHEN kb1 = 1 THEN (us - b1us) / 1000000.0 END AS seconds_since, CASE WHEN kb1 = 1 AND kb2 = 1 THEN (b1us - b2us) / 1000000.0 END AS seconds_between,
  CASE WHEN {_EXTERNAL} THEN 'Newly arrived traffic' ELSE 'Traffic already on site' END AS newly_arrived, CASE WHEN tf = 0 THEN 'Left site immediately after this' ELSE 'Visited subsequent pages' END AS next_step, {_MEDIUM} AS medium FROM f"""
)
def pageview_funnels(spark, d):
    rows = web.funnels(_pages(spark, d), CONFIG)
    return rows.select(
        "request_uuid", F.col("preceding_request_path_grouped_1").alias("preceding_1"), F.col("following_request_path_grouped_1").alias("following_1"), F.col("preceding_request_path_grouped_2").alias("preceding_2"),
        F.col("following_request_path_grouped_2").alias("following_2"), F.col("seconds_since_preceding_step_1").alias("seconds_since"), F.col("seconds_between_preceding_steps_1_and_2").alias("seconds_between"),
        "newly_arrived", "next_step", "medium",
    )


@query(
    f"""WITH {P}, l AS (SELECT visitor, string_agg(DISTINCT usr, ', ' ORDER BY usr) AS user_ids FROM w WHERE usr IS NOT NULL GROUP BY visitor),
  z AS (SELECT p.*, l.user_ids FROM p LEFT JOIN l USING (visitor) WHERE {_EXTERNAL})
  SELECT uuid AS landing_request_uuid, us AS session_started_at_us, lead(us) OVER (PARTITION BY coalesce('u' || user_ids, 'v' || visitor) ORDER BY us, uuid) AS next_session_started_at_us, user_ids, {_MEDIUM} AS medium FROM z"""
)
def sessions_attributed(spark, d):
    found = events.enrich(adapters.web_requests(spark, d))
    rows = web.sessions(web.funnels(_pages(spark, d), CONFIG), found, CONFIG)
    return rows.select("landing_request_uuid", us("session_started_at"), us("next_session_started_at"), "user_ids", "medium")


#: Visits with the first page that follows each, and users imputed from later and earlier ones.
_VISITS = f"""{W}, x AS (SELECT *, path || {_SORTED.format(x="qs")} AS page, {_REFERER_PQ} AS rpage FROM w WHERE contains(content, 'text/html') AND status NOT LIKE '3__' AND status NOT LIKE '4__' AND device <> 'bot'),
x1 AS (SELECT *, coalesce(CASE WHEN usr IS NOT NULL THEN lead(us) OVER (PARTITION BY usr, page, day ORDER BY us) END, lead(us) OVER (PARTITION BY visitor, page, day ORDER BY us)) AS again FROM x),
x2 AS (SELECT a.event_id, min(f.us) AS f_us, count(f.us) AS n_following, arg_min(f.usr, f.us) FILTER (WHERE f.usr IS NOT NULL) AS f_usr FROM x1 a LEFT JOIN x f ON a.page = f.rpage AND a.day = f.day AND (a.visitor = f.visitor OR a.usr = f.usr) AND a.us < f.us AND (a.again IS NULL OR f.us < a.again) GROUP BY a.event_id),
x3 AS (SELECT x.*, n_following, f_usr, first_value(usr IGNORE NULLS) OVER (PARTITION BY visitor ORDER BY us // 1000000 RANGE BETWEEN CURRENT ROW AND 1800 FOLLOWING) AS ahead,
  last_value(usr IGNORE NULLS) OVER (PARTITION BY visitor ORDER BY us // 1000000 RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS behind,
  (lead(us) OVER o - us) // 60000000 AS gap_after, (us - lag(us) OVER o) // 60000000 AS gap_before FROM x JOIN x2 USING (event_id) WINDOW o AS (PARTITION BY visitor ORDER BY us, page, path)),
x4 AS (SELECT *, coalesce(usr, CASE WHEN gap_after <= 30 THEN ahead ELSE f_usr END, CASE WHEN gap_before <= 30 THEN behind END) AS est FROM x3)"""


@query(f"WITH {_VISITS} SELECT us AS occurred_at_us, visitor, page, n_following AS following_pages, est AS estimated_user FROM x4")
def session_user_imputation(spark, d):
    rows = web.impute_users(web.following_pages(web.numbered(web.visits(events.enrich(adapters.web_requests(spark, d))))))
    return rows.select(us("occurred_at"), "visitor", "page", "following_pages", "estimated_user")


@query(
    f"""WITH {_VISITS}, y AS (SELECT *, coalesce('u' || est, 'v' || visitor) AS who FROM x4),
  y1 AS (SELECT *, lead(us) OVER o IS NOT NULL AND ((lead(us) OVER o - us) // 60000000 <= 30 OR n_following > 0) AS goes_on FROM y WINDOW o AS (PARTITION BY who ORDER BY us, page, path)),
  y2 AS (SELECT *, CASE WHEN lag(goes_on) OVER (PARTITION BY who ORDER BY us, page, path) THEN 0 ELSE 1 END AS starts FROM y1),
  y3 AS (SELECT *, sum(starts) OVER (PARTITION BY who ORDER BY us) AS number FROM y2)
  SELECT min(est) AS user_id, min(us) AS session_start_us, max(us) AS final_page_us, CASE WHEN max(us) > min(us) THEN (max(us) - min(us)) // 1000000 END AS session_time_in_seconds, count(*) AS count_pages_visited, arg_min(path, us) AS start_page, arg_max(path, us) AS exit_page FROM y3 GROUP BY who, number"""
)
def session_details(spark, d):
    rows = web.session_details(events.enrich(adapters.web_requests(spark, d)), CONFIG)
    return rows.select("user_id", us("session_start_timestamp", "session_start_us"), us("final_session_page_timestamp", "final_page_us"), "session_time_in_seconds", "count_pages_visited", "start_page", "exit_page")


@query(
    ORACLE["session_details"].rpartition("SELECT min(est)")[0]
    + """, y4 AS (SELECT *, lead(us) OVER (PARTITION BY who, number ORDER BY us, page, path) AS exit_us FROM y3)
  SELECT us AS page_entry_us, exit_us AS page_exit_us, (exit_us - us) // 1000000 AS duration, path AS page, visitor FROM y4"""
)
def session_pages(spark, d):
    """Every page of every session, with when it was left."""
    rows = web.session_details(events.enrich(adapters.web_requests(spark, d)), CONFIG)
    each = rows.select(F.explode("pages_visited_details").alias("p"))
    return each.select(us("p.page_entry_time", "page_entry_us"), us("p.page_exit_time", "page_exit_us"), "p.duration", "p.page", F.col("p.anonymised_user_agent_and_ip").alias("visitor"))


#: Versions from the change log: deletions come 4,000 days after the order, later than all else.
D = f"""{E}, c0 AS (SELECT *, lead(happened) OVER (PARTITION BY id ORDER BY happened) AS nxt, row_number() OVER (PARTITION BY id ORDER BY happened) AS n FROM e WHERE et <> 'delete_entity'),
c AS (SELECT *, coalesce(nxt, CASE WHEN final = 'F' THEN ordered + INTERVAL 4000 DAY END) AS vt, nxt IS NULL AND final = 'F' AS gone FROM c0)"""


def _cdc(spark, d):
    source = adapters.order_changes(spark, d)
    return source, cdc.cdc_versions(source, CDC_KEYS)


@query(f"WITH {D} SELECT id, epoch_us(happened) AS valid_from_us, epoch_us(vt) AS valid_to_us, status, cents, gone AS is_deleted, nxt IS NULL AND NOT gone AS is_current, CAST(n AS INTEGER) AS version_number FROM c")
def cdc_version(spark, d):
    return _cdc(spark, d)[1].select("id", us("valid_from"), us("valid_to"), "status", "cents", "is_deleted", "is_current", "version_number")


@query(f"WITH {D} SELECT id, status, priority, cents FROM c WHERE vt IS NULL")
def cdc_latest(spark, d):
    return cdc.cdc_latest(_cdc(spark, d)[1]).select("id", "status", "priority", "cents")


@query(f"WITH {D} SELECT id, epoch_us(happened) AS valid_from_us, status, CAST(n AS INTEGER) AS version_number FROM c")
def cdc_legacy_merge(spark, d):
    versions = written_once(_cdc(spark, d)[1].select("id", "valid_from", "valid_to", "status", "is_current", "is_deleted", "version_number"), "versions")
    cutoff = F.lit("1998-01-01").cast("timestamp")
    merged = cdc.merge_legacy(versions.where(F.col("valid_from") > cutoff), versions, cutoff)
    return merged.select("id", us("valid_from"), "status", "version_number")


def _refreshes(spark, d):
    source = written_once(adapters.order_changes(spark, d), "changes")
    versions = written_once(cdc.cdc_versions(source, CDC_KEYS), "versions")
    return source, versions, written_once(cdc.full_refreshes(source, versions, F.lit(AS_OF).cast("timestamp"), CDC), "refreshes")


_R = "r AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 10 <> 0), live AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F')"


@query(f"WITH {_R} SELECT 'S1' AS lsn, r.n AS row_count, CAST(1 AS BIGINT) AS sync_count, live.n AS live_row_count, CAST(r.n AS DOUBLE) / live.n AS fraction_of_live FROM r, live WHERE CAST(r.n AS DOUBLE) / live.n >= 0.8")
def cdc_full_refreshes(spark, d):
    return _refreshes(spark, d)[2].select("lsn", "row_count", "sync_count", "live_row_count", "fraction_of_live")


@query("SELECT o_orderkey AS id, 'S1' AS snapshot_lsn FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 10 = 0")
def cdc_reconcile_deletes(spark, d):
    source, versions, refreshes = _refreshes(spark, d)
    return cdc.reconcile_deletes(source, versions, refreshes, F.lit(AS_OF).cast("timestamp")).select("id", "snapshot_lsn")


@query(f"WITH {_R} SELECT 'S1' AS snapshot_lsn, live.n - r.n AS pending_delete_count, live.n AS live_row_count FROM r, live WHERE CAST(live.n - r.n AS DOUBLE) / live.n > 0.05")
def cdc_volume_guard(spark, d):
    source, versions, refreshes = _refreshes(spark, d)
    deletes = cdc.reconcile_deletes(source, versions, refreshes, F.lit(AS_OF).cast("timestamp"))
    return cdc.exceeds_safe_volume(deletes, versions, Cdc("log", max_delete_fraction=0.05)).select("snapshot_lsn", "pending_delete_count", "live_row_count")


@query(f"WITH {D} SELECT id, epoch_us(happened) AS valid_from_us, epoch_us(CASE WHEN vt IS NULL AND id % 10 = 0 THEN TIMESTAMP '2013-06-01' ELSE vt END) AS valid_to_us, gone OR (vt IS NULL AND id % 10 = 0) AS is_deleted FROM c")
def cdc_apply_deletes(spark, d):
    source, versions, refreshes = _refreshes(spark, d)
    deletes = cdc.reconcile_deletes(source, versions, refreshes, F.lit(AS_OF).cast("timestamp"))
    return cdc.apply_deletes(versions, deletes).select("id", us("valid_from"), us("valid_to"), "is_deleted")


_UNCONFIGURED = "SELECT 'orders' AS entity_table_name, 'priority' AS column_name, count(o_orderpriority) AS rows_with_a_value FROM (SELECT o_orderpriority FROM orders UNION ALL SELECT o_orderpriority FROM orders JOIN (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem) ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 10 <> 0)"


@query(f"WITH x AS ({_UNCONFIGURED}) SELECT column_name, 'not configured' AS issue, rows_with_a_value AS rows FROM x UNION ALL SELECT 'colour', 'not in the source', rows_with_a_value FROM x")
def schema_drift(spark, d):
    """Columns of the log that no key is configured for and keys that it lacks, each with the rows that this concerns."""
    log, own = adapters.order_changes(spark, d), Entity("orders", [Key("status"), Key("cents", "integer"), Key("colour")])
    extra = quality.columns_not_configured(log, own).select("column_name", F.lit("not configured").alias("issue"), F.col("rows_with_a_value").alias("rows"))
    return extra.unionByName(quality.columns_missing(log, own).select("column_name", F.lit("not in the source").alias("issue"), F.col("rows_without").alias("rows")))


@query(f"WITH {E} SELECT CAST(id AS VARCHAR) AS id, epoch_us(happened) AS at_us, et AS event_type, 'customer,created_at,updated_at' AS shown_wanted, CAST(customer AS VARCHAR) AS customer, status AS hidden_status FROM e")
def hidden_rearranged(spark, d):
    swapped = PipelineConfig("shop", adapters.OWN_SITE, entities=[Entity("orders", [Key("status", hidden=True), Key("customer")])], hidden_policy="pii")
    rows = hidden.rearrange(adapters.order_events(spark, d), swapped)
    names = F.transform("data", lambda e: e["key"])
    wanted = F.array_join(F.filter(F.array(*[F.lit(x) for x in ("customer", "created_at", "updated_at")]), lambda n: F.array_contains(names, n)), ",")
    return rows.select(kv.extract(kv.combined("data", "hidden_data"), "id").alias("id"), us("occurred_at", "at_us"), "event_type", wanted.alias("shown_wanted"), kv.extract("data", "customer").alias("customer"), kv.extract("hidden_data", "status").alias("hidden_status"))


def _snapshot(spark, d):
    found = checks.compare_scheduled(checks.check_events(adapters.table_checks(spark, d), "entity_table_check"), _priority_versions(spark, d))
    return monitoring.table_snapshot(found, adapters.custom_events(spark, d), CONFIG, F.lit("2024-01-05").cast("timestamp"))


@query(f"WITH {_K} SELECT a.t AS entity_table_name, a.c = b.c AS matching_checksums, a.n AS number_of_rows, a.n - b.n AS number_of_missing_rows, CAST(0 AS BIGINT) AS number_of_extra_rows, true AS hidden_pii_streamed_within_the_last_week FROM a JOIN b USING (t)")
def pipeline_table_snapshot(spark, d):
    rows = _snapshot(spark, d)
    return rows.select("entity_table_name", "matching_checksums", "number_of_rows", "number_of_missing_rows", "number_of_extra_rows", "hidden_pii_streamed_within_the_last_week")


@query(f"WITH {_K} SELECT count(*) AS number_of_tables, CAST(sum(CASE WHEN a.c = b.c THEN 1 ELSE 0 END) AS BIGINT) AS number_of_tables_with_matching_checksums, CAST(sum(a.n) AS BIGINT) AS number_of_rows, CAST(sum(a.n - b.n) AS BIGINT) AS number_of_missing_rows FROM a JOIN b USING (t)")
def pipeline_snapshot(spark, d):
    rows = monitoring.pipeline_snapshot(_snapshot(spark, d), catalogue.configuration_history(_clients(spark, d)), CONFIG)
    return rows.select("number_of_tables", "number_of_tables_with_matching_checksums", "number_of_rows", "number_of_missing_rows")


@query(f"WITH {W} SELECT uuid AS request_uuid FROM w WHERE date_diff('day', CAST(happened AS DATE), DATE '2024-01-03') <= 1 UNION ALL SELECT 'r' || CAST(event_id - 1 AS VARCHAR) FROM s WHERE kind = 'signup' OR (kind = 'purchase' AND date_diff('day', CAST(make_timestamp(us) AS DATE), DATE '2024-01-03') <= 0)")
def retention(spark, d):
    return events.retain(adapters.stream(spark, d), F.lit("2024-01-03").cast("timestamp"), 30, 1, event_days={"purchase": 0}).select("request_uuid")


@query(ORACLE["entity_version"].replace(", epoch_us(ordered) AS created_at_us", ""))
def incremental_equals_full(spark, d):
    """Versions built in two batches of events, open ones carried over: the same as in one."""
    cut = F.lit("1998-06-15").cast("timestamp")
    rows = adapters.order_events(spark, d)
    first = entity.versions(rows.where(F.col("occurred_at") <= cut), [ORDERS])
    second = entity.versions(rows.where(F.col("occurred_at") > cut), [ORDERS], first)
    return entity.upsert_versions(first, second).select("entity_id", "event_type", us("valid_from"), us("valid_to"))


@query(f"WITH {_K} SELECT 'import1' AS import_id, a.t AS entity_table_name, 'rows are missing' AS issue FROM a JOIN b USING (t) WHERE a.n <> b.n")
def imported_ids_since_yesterday(spark, d):
    """Of imports that differ only those checked since yesterday: the same log twice, once with a check of a year ago."""
    old = adapters.table_checks(spark, d, "import_entity_table_check").withColumns({"event_tags": F.array(F.lit("import0")), "data": kv.replace_key("data", "checksum_calculated_at", F.lit("2009-01-01T00:00:00+00:00"))})
    found = checks.compare_imports(_import_events(spark, d).unionByName(checks.import_events(old, TABLES)))
    recent = found.where(F.to_date("checksum_calculated_at") >= F.date_sub(F.lit("2010-01-02").cast("date"), 1))
    return checks.mismatches(recent).select("import_id", "entity_table_name", "issue")


@query("SELECT epoch_us(max(w)) AS last_updated_us FROM (SELECT l_shipdate AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate UNION ALL SELECT o_orderdate FROM orders UNION ALL SELECT o_orderdate + INTERVAL 4000 DAY FROM orders WHERE o_orderstatus = 'F') HAVING max(w) < TIMESTAMP '2013-06-02' - INTERVAL 1 DAY")
def cdc_freshness(spark, d):
    found = quality.not_fresh(adapters.order_changes(spark, d), F.lit(AS_OF).cast("timestamp"), 1, "updated_at")
    return found.select(us("last_occurred_at", "last_updated_us"))


@query(_UNCONFIGURED)
def columns_not_configured(spark, d):
    return quality.columns_not_configured(adapters.order_changes(spark, d), Entity("orders", [Key("status"), Key("cents", "integer")]))


@query(f"WITH {E} SELECT 'refunds' AS entity_table_name, CAST(30 AS INTEGER) AS expiry_days, CAST(0 AS BIGINT) AS number_of_import_events, a.n AS warehouse_row_count, a.n AS database_row_count FROM (SELECT count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW') a")
def not_backfilled_today(spark, d):
    """An entity of which no import was streamed, with the day's check: that of the last priority under another name."""
    config = PipelineConfig("shop", adapters.OWN_SITE, entities=[Entity("1-URGENT"), Entity("refunds", expiration_days=30)])
    found = checks.compare_scheduled(checks.check_events(adapters.table_checks(spark, d), "entity_table_check"), _priority_versions(spark, d))
    renamed = found.withColumn("entity_table_name", F.when(F.col("entity_table_name") == "5-LOW", "refunds").otherwise(F.col("entity_table_name")))
    rows = quality.not_backfilled(adapters.priority_rows(spark, d), config, renamed, F.lit("2010-01-01").cast("timestamp"))
    return rows.select("entity_table_name", "expiry_days", F.col("number_of_import_events").cast("bigint").alias("number_of_import_events"), "warehouse_row_count", "database_row_count")


@query("SELECT 'customer' AS column_name, CAST(o_custkey AS VARCHAR) AS value, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def foreign_key_orphans(spark, d):
    """Customers of the orders as they are now that the customers in credit lack."""
    latest = entity.latest(_flat(spark, d))
    other = adapters.read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    every = adapters.read(spark, d, "orders").select(F.col("o_custkey").alias("customer")).join(latest.select(F.col("customer").alias("_c")).distinct(), F.col("customer") == F.col("_c"), "left").drop("_c")
    return keys.orphans(every, keys.ForeignKey("customer", "customer"), other)


@query("SELECT 'lineitem' AS table_name, CAST(l_orderkey AS BIGINT) AS l_orderkey, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def primary_key_broken(spark, d):
    return keys.broken_primary_key(adapters.read(spark, d, "lineitem"), ["l_orderkey"]).select(F.lit("lineitem").alias("table_name"), F.col("l_orderkey").cast("bigint").alias("l_orderkey"), "rows")


@query(ORACLE["entity_at"])
def entity_at_function(spark, d):
    """The same through SQL: SELECT * FROM orders_at(TIMESTAMP '...')."""
    entity.at_function("orders_at", _flat(spark, d))
    return spark.sql("SELECT id, status, order_priority, total_cents, customer FROM orders_at(TIMESTAMP '1998-06-15')")


@query(ORACLE["cdc_version"])
def cdc_incremental_equals_full(spark, d):
    """Versions from a log read in three parts by time of extraction, each going on from the last: the same as from all."""
    log, cuts = adapters.order_changes(spark, d), [F.lit(t).cast("timestamp") for t in ("1996-01-01", "2006-06-15")]
    last, closed = None, []
    for lo, hi in ((None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)):
        part = log if hi is None else log.where(F.col("_airbyte_extracted_at") <= hi)
        rows = written_once(cdc.cdc_versions(part, CDC_KEYS, lo, last), "versions")
        closed.append(rows.where("not (is_current or is_deleted)"))
        last = rows.where("is_current or is_deleted")
    found = last
    for part in closed:
        found = found.unionByName(part)
    return found.select("id", us("valid_from"), us("valid_to"), "status", "cents", "is_deleted", "is_current", "version_number")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price, extract(year FROM o_orderdate) = 1995 AS moved FROM orders")
def merged_partitions(spark, d):
    """A table of orders by year into which those of 1995 are merged again: only that year's files are written."""
    orders = adapters.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"), F.lit(False).alias("moved"), F.year("o_orderdate").alias("y"))
    store = stored(spark)
    store.replace("orders", orders, ["y"])
    store.merge("orders", orders.where("y = 1995").withColumn("moved", F.lit(True)), ["id"])
    return store.read("orders").select("id", "price", "moved")


@query(ORACLE["entity_field_updates"])
def field_updates_of_stored_history(spark, d):
    """Changes from a history that is stored in buckets by id: no shuffle but the one that wrote it."""
    store = stored(spark)
    store.carry("history", _versions(spark, d), "valid_to is null", ["entity_table_name"], ["entity_id", "valid_from"], buckets=(["entity_id"], int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = entity.field_updates(store.read("history"))
    return rows.select("entity_id", us("occurred_at"), "key_updated", "new_value", "previous_value", us("previous_occurred_at"), "previous_event_type", "seconds_since_previous_update", "seconds_since_created")


@query("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def expired_days(spark, d):
    """Orders by month of which those before 1997 are dropped as partitions."""
    orders = adapters.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.trunc("o_orderdate", "MM").alias("month"))
    store = stored(spark)
    store.replace("orders", orders, by_day="month")
    store.drop_days("orders", date(1997, 1, 1))
    return store.read("orders").select("id", F.col("day").cast("string").alias("day"))
