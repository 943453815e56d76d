"""Event enrichment: every event with the context of the web request that caused it, clean URLs and device classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import kv, scalar

#: Context that an event takes from its web request where it has none of its own: (output, input).
_CONTEXT = {
    "request_path": "request_path", "request_user_id": "user_id", "request_method": "request_method", "request_user_agent": "request_user_agent", "request_referer": "request_referer",
    "response_content_type": "response_content_type", "response_status": "response_status", "anonymised_user_agent_and_ip": "anonymised_user_agent_and_ip",
}
AGENT_COLUMNS = ("browser_name", "browser_version", "operating_system_name", "operating_system_vendor", "operating_system_version")
REQUEST_CONTEXT = (
    "request_uuid", "request_path", "request_user_id", "request_method", "request_user_agent", "request_referer", "request_query", "response_content_type", "response_status",
    "anonymised_user_agent_and_ip", "device_category", *AGENT_COLUMNS,
)


def earliest_requests(raw: DataFrame, *tiebreak: str) -> DataFrame:
    """The first web request of each request id; ties by the path and the further columns given."""
    order = Window.partitionBy("request_uuid").orderBy("occurred_at", "request_path", *tiebreak)
    requests = raw.where("event_type = 'web_request' and request_uuid is not null")
    return requests.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def enrich(raw: DataFrame, namespace: str | None = None, since: Column | None = None) -> DataFrame:
    """Enriched events after ``since`` (all if None).

    Requests are looked for from the day before ``since`` on, so that a request on the other side of the seam is
    found. The join is an equi-join on the request id with the event type as a condition of the left side, so web
    requests themselves pass through unchanged. Events without a request id are dealt by a hash of their own, and not
    to one task; repeated events are removed within the join's partitions, without a further shuffle.
    """
    if namespace is not None:
        raw = raw.where(F.col("namespace") == namespace)
    events, requests = raw, raw
    if since is not None:
        events = raw.where(F.col("occurred_at") > since)
        requests = raw.where(F.to_date("occurred_at") >= F.date_sub(F.to_date(since), 1))
    context = earliest_requests(requests).select(
        F.col("request_uuid").alias("_uuid"), F.col("request_query").alias("_request_query"), *[F.col(source).alias(f"_{out}") for out, source in _CONTEXT.items()]
    )
    own_key = F.concat(F.lit("?"), F.xxhash64("occurred_at", "event_type", "entity_table_name", "data").cast("string"))
    events = events.withColumn("_key", F.coalesce("request_uuid", own_key))
    wanted = (F.col("_key") == F.col("_uuid")) & (F.col("event_type") != "web_request") & F.col("request_uuid").isNotNull()
    joined = events.join(context, wanted, "left")
    joined = joined.withColumns({out: F.coalesce(F.col(source), F.col(f"_{out}")) for out, source in _CONTEXT.items()})
    joined = joined.withColumn("request_query", F.when(F.size("request_query") > 0, F.col("request_query")).otherwise(F.col("_request_query")))
    full = F.concat("request_path", F.coalesce(F.concat(F.lit("?"), F.replace(kv.query_text("request_query"), F.lit(" "), F.lit("+"))), F.lit("")))
    agent = scalar.parse_user_agent("request_user_agent")
    joined = joined.withColumns(
        {
            "request_path_and_query": scalar.standardise_path_query(full),
            "request_referer_domain": scalar.url_domain("request_referer"),
            "request_referer_path_and_query": scalar.standardise_path_query(scalar.decode_uri(scalar.url_path_and_query("request_referer"))),
            "_agent": agent,
        }
    ).withColumn("device_category", scalar.device_category("request_user_agent", F.col("_agent.category")))
    parts = ("name", "version", "os", "vendor", "os_version")
    joined = joined.withColumns({name: F.col(f"_agent.{part}") for name, part in zip(AGENT_COLUMNS, parts, strict=True)})
    own = ("occurred_at", "request_uuid", "event_type", "environment", "namespace", "data", "hidden_data", "entity_table_name")
    urls = ("request_path_and_query", "request_referer_domain", "request_referer_path_and_query")
    return joined.select("_key", *own, *[c for c in REQUEST_CONTEXT if c != "request_uuid"], *urls).dropDuplicates().drop("_key")


def kept(as_of: Column, days: int | None = None, web_days: int | None = None, entity_days: dict[str, int] | None = None, event_days: dict[str, int] | None = None) -> Column:
    """Whether an event isn't yet to be deleted at ``as_of``: a general limit and shorter ones for web requests, for the
    events of some entities and for some custom event types (whole days)."""
    age = F.datediff(F.to_date(as_of), F.to_date("occurred_at"))
    keep = F.lit(True) if days is None else age <= days
    if web_days is not None:
        keep &= (F.col("event_type") != "web_request") | (age <= web_days)
    for name, limit in (entity_days or {}).items():
        keep &= ~F.coalesce(F.col("entity_table_name") == name, F.lit(False)) | (age <= limit)
    for name, limit in (event_days or {}).items():
        keep &= (F.col("event_type") != name) | (age <= limit)
    return keep


def retain(events: DataFrame, as_of: Column, days: int | None = None, web_days: int | None = None, entity_days: dict[str, int] | None = None, event_days: dict[str, int] | None = None) -> DataFrame:
    """Events that are :func:`kept`."""
    return events.where(kept(as_of, days, web_days, entity_days, event_days))
