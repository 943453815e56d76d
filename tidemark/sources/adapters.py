"""Event streams and change logs derived from star-schema tables, as inputs for the models.

``web_requests`` and ``custom_events`` compress the events table's time twentyfold so that sessions have several
pages; ``order_events`` tells each order's life as entity events, ``order_changes`` as a change log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.kv import KV
from tidemark.operators.checks import ordered_md5

START_US, SPEED = 1_704_067_200_000_000, 20
#: Columns of the raw stream and their types.
RAW = {
    "occurred_at": "timestamp", "event_type": "string", "environment": "string", "namespace": "string", "user_id": "string", "request_uuid": "string", "request_method": "string", "request_path": "string",
    "request_user_agent": "string", "request_referer": "string", "request_query": KV, "response_content_type": "string", "response_status": "string", "anonymised_user_agent_and_ip": "string",
    "entity_table_name": "string", "event_tags": "array<string>", "data": KV, "hidden_data": KV,
}
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile/15E148 Safari/604.1",
    "curl/8.0",
)
REFERERS = ("https://www.google.com/search?q=a%20b", "https://t.co/x", "https://partner.example.org/")
OWN_SITE = "www.example.gov.uk"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_raw(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` in the raw stream's schema; columns that aren't given are typed NULLs."""
    return rows.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in RAW.items()])


def pairs(**values: Column) -> Column:
    """A payload with one value for each key."""
    return F.array(*[F.struct(F.lit(k).alias("key"), F.array(v.cast("string")).alias("value")) for k, v in values.items()]).cast(KV)


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _stream(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    events = read(spark, sf_dir, "events").where(F.col("event_type").isin(*types))
    us = F.lit(START_US) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {START_US}) div {SPEED}")
    return events.select("event_id", F.col("user_id").alias("u"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"), us.alias("us"))


def web_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "click", "view", "error")
    k, e, u = F.col("k"), F.col("event_id"), F.col("u")
    path = F.when(k % 3 == 0, F.concat(F.lit("/courses/"), k % 9)).when(k % 3 == 1, "/apply").otherwise("/search")
    query = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("?page="), k % 3)).when(k % 4 == 2, "?utm_source=news&utm_medium=email").otherwise(F.concat(F.lit("?gclid=g"), k))
    kv = F.when(k % 4 == 0, F.array().cast(KV)).when(k % 4 == 1, pairs(page=k % 3)).when(k % 4 == 2, pairs(utm_source=F.lit("news"), utm_medium=F.lit("email"))).otherwise(pairs(gclid=F.concat(F.lit("g"), k)))
    rows = rows.withColumn("path", path).withColumn("query", query)
    before = F.lag(F.concat("path", "query")).over(Window.partitionBy("u").orderBy("us", "event_id"))
    third = F.expr("event_id div 5") % 3
    outside = F.when(third == 0, REFERERS[0]).when(third == 1, REFERERS[1]).otherwise(REFERERS[2])
    rows = rows.withColumn("referer", F.when(e % 5 == 0, outside).otherwise(F.concat(F.lit(f"https://{OWN_SITE}"), before)))
    return as_raw(
        rows, occurred_at=F.timestamp_micros("us"), event_type=F.lit("web_request"), environment=F.lit("production"), namespace=F.lit("main"), user_id=F.when(e % 3 != 0, u.cast("string")),
        request_uuid=F.concat(F.lit("r"), e), request_method=F.lit("GET"), request_path=F.col("path"), request_query=kv, request_referer=F.col("referer"),
        request_user_agent=F.when(u % 4 == 0, AGENTS[0]).when(u % 4 == 1, AGENTS[1]).when(u % 4 == 2, AGENTS[2]),
        response_content_type=F.when(k % 11 == 0, "application/json").otherwise("text/html; charset=utf-8"), response_status=F.when(k % 13 == 0, "302").when(k % 17 == 0, "404").otherwise("200"),
        anonymised_user_agent_and_ip=F.md5(F.expr("u div 2").cast("string")), data=F.array().cast(KV), hidden_data=F.array().cast(KV),
    )


def custom_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "signup", "purchase")
    e, u = F.col("event_id"), F.col("u")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return as_raw(
        rows, occurred_at=F.timestamp_micros("us"), event_type=F.col("event_type"), environment=F.lit("production"), namespace=F.lit("main"), user_id=F.when(e % 3 != 0, u.cast("string")),
        request_uuid=F.concat(F.lit("r"), e - 1), data=pairs(cents=cents, k=F.col("k")), hidden_data=pairs(user=u),
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_requests(spark, sf_dir).unionByName(custom_events(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ordered"), F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("final"),
    )


def _order_life(spark: SparkSession, sf_dir: str, deleted: bool = True) -> DataFrame:
    """(id, event_type, at, status, priority, cents, customer, ordered) of each order's changes.

    Lines are dealt by order before they are grouped, as hardly any two share a day: that serves the join too.
    """
    orders = _orders(spark, sf_dir)
    created = orders.select("*", F.lit("create_entity").alias("event_type"), F.col("ordered").alias("at"), F.lit("O").alias("status"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_linestatus").alias("status")).repartition("id")
    shipped = lines.groupBy("id", "at").agg(F.max("status").alias("status")).join(orders, "id").where("at > ordered").withColumn("event_type", F.lit("update_entity"))
    life = created.unionByName(shipped)
    if not deleted:
        return life
    gone = orders.where("final = 'F'").select("*", F.lit("delete_entity").alias("event_type"), (F.col("ordered") + F.expr("INTERVAL 2000 DAYS")).alias("at"), F.lit("F").alias("status"))
    return life.unionByName(gone)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_life(spark, sf_dir)
    data = pairs(id=F.col("id"), status=F.col("status"), priority=F.col("priority"), total_cents=F.col("cents"), created_at=iso(F.col("ordered")), updated_at=iso(F.col("at")))
    return as_raw(rows, occurred_at=F.col("at"), event_type=F.col("event_type"), environment=F.lit("production"), namespace=F.lit("main"), entity_table_name=F.lit("orders"), data=data, hidden_data=pairs(customer=F.col("customer")))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of the orders: changes, deletions after 4,000 days, and one full refresh that lacks a tenth."""
    life = _order_life(spark, sf_dir, deleted=False)
    rows = life.select("id", "status", "priority", "cents", F.col("ordered").alias("created_at"), F.col("at").alias("updated_at"), "final")
    hour, second = F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 SECOND")
    at = F.col("updated_at")

    def log(df: DataFrame, extracted: Column, cdc: Column, deleted: Column, lsn: Column, sync: Column) -> DataFrame:
        stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return df.select(
            "id", "status", "priority", "cents", "created_at", "updated_at", F.concat_ws("-", lsn, "id", F.date_format("updated_at", "yyyyMMdd")).alias("_airbyte_raw_id"), extracted.alias("_airbyte_extracted_at"),
            F.concat(F.lit('{"sync_id": "'), sync, F.lit('"}')).alias("_airbyte_meta"), stamp(cdc).alias("_ab_cdc_updated_at"), stamp(deleted).alias("_ab_cdc_deleted_at"), lsn.alias("_ab_cdc_lsn"),
        )

    none = F.lit(None).cast("timestamp")
    last = rows.withColumn("last", F.lead("updated_at").over(Window.partitionBy("id").orderBy("updated_at")).isNull())
    again = F.col("last") & (F.col("final") != "F") & (F.col("id") % 10 != 0)  # the refresh reads the same rows
    each = last.withColumn("full", F.explode(F.when(again, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    lsn = F.when(F.col("full"), "S1").otherwise(F.concat(F.lit("L"), F.unix_seconds(at).cast("string")))
    changes = log(each, F.when(F.col("full"), F.lit("2013-06-01").cast("timestamp")).otherwise(at + hour), at + second, none, lsn, F.when(F.col("full"), "3").otherwise("1"))
    gone = _orders(spark, sf_dir).where("final = 'F'").select("id", F.lit("O").alias("status"), "priority", "cents", F.col("ordered").alias("created_at"), (F.col("ordered") + F.expr("INTERVAL 4000 DAYS")).alias("updated_at"))
    deletions = log(gone, at + F.expr("INTERVAL 1 DAY"), at, at, F.concat(F.lit("D"), F.col("id").cast("string")), F.lit("2"))
    return changes.unionByName(deletions)


def table_checks(spark: SparkSession, sf_dir: str, event_type: str = "entity_table_check") -> DataFrame:
    """A checksum event for each order priority taken as a table of its own, as the database would send it."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("t"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    sums = ordered_md5(rows.withColumn("key", F.xxhash64("t")), "key", "at", "id").withColumnRenamed("md5", "checksum")
    found = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("t")).join(sums, "key")
    data = pairs(row_count=F.col("n"), checksum=F.col("checksum"), checksum_calculated_at=F.lit("2010-01-01T00:00:00+00:00"), order_column=F.lit("UPDATED_AT"))
    return as_raw(found, occurred_at=F.lit("2010-01-01 00:00:05").cast("timestamp"), event_type=F.lit(event_type), entity_table_name=F.col("t"), event_tags=F.array(F.lit("import1")), data=data)


def priority_rows(spark: SparkSession, sf_dir: str, event_type: str = "import_entity") -> DataFrame:
    """The orders as rows of these tables; of the first one every 97th is missing."""
    rows = read(spark, sf_dir, "orders").where("not (o_orderpriority = '1-URGENT' and o_orderkey % 97 = 0)")
    at = F.col("o_orderdate").cast("timestamp")
    return as_raw(rows, occurred_at=at, event_type=F.lit(event_type), entity_table_name=F.col("o_orderpriority"), event_tags=F.array(F.lit("import1")), data=pairs(id=F.col("o_orderkey"), updated_at=iso(at), created_at=iso(at)))
