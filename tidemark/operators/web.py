"""Web analytics: page views with funnels, sessions with attribution, and sessions page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import PipelineConfig
from tidemark.functions import kv, scalar
from tidemark.plans.tables import written_once

NEW, KNOWN = "Newly arrived traffic", "Traffic already on site"
LEFT, STAYED = "Left site immediately after this", "Visited subsequent pages"
#: The visitor's next step where no user is known (the reports' own spelling).
STAYED_UNKNOWN = "Visited Subsequent Pages"
_VISITOR_DAY = ("anonymised_user_agent_and_ip", "_day")
_GAP_MINUTES, _GAP_SECONDS = 30, 1800


def page_views(events: DataFrame, tiebreak: str = "request_uuid", before: Column | None = None, after: Column | None = None) -> DataFrame:
    """Requests for pages, by visitor and day, without those that repeat path and query of the one before.

    ``before`` and ``after`` bound whole days.
    """
    rows = events.where("event_type = 'web_request'").where(F.lower("response_content_type").contains("text/html")).withColumn("_day", F.to_date("occurred_at"))
    if before is not None:
        rows = rows.where(F.col("_day") < before)
    if after is not None:
        rows = rows.where(F.col("_day") > after)
    rows = rows.withColumn("request_query", kv.flatten_pairs("request_query")).withColumn("request_referer", F.replace(scalar.decode_uri("request_referer"), F.lit("+"), F.lit(" ")))
    order = Window.partitionBy(*_VISITOR_DAY).orderBy("occurred_at", tiebreak)
    rows = rows.withColumn("_path", F.lag("request_path").over(order)).withColumn("_query", F.lag("request_query").over(order))
    moved = (F.col("request_path") != F.col("_path")) | (F.col("_path").isNull() & F.col("request_path").isNotNull())
    return rows.where(F.coalesce(moved, F.lit(False)) | ~kv.pairs_equal("request_query", "_query")).drop("_path", "_query")


def with_referer(views: DataFrame, grouping: str) -> DataFrame:
    """Path and query pairs of the referer, and the path with identifiers made one."""
    pair = lambda s: F.struct(scalar.extract_or_null(s, "^([^=]+)=").alias("key"), scalar.extract_or_null(s, "=([^=]+)$").alias("value"))
    return views.withColumns(
        {
            "request_referer_path": scalar.extract_or_null("request_referer", r"[^:/](/[^?]*)(?:\?|$)"),
            "request_referer_query": F.transform(F.regexp_extract_all("request_referer", F.lit("[?&]([^&]+)"), F.lit(1)), pair),
            "request_path_grouped": F.regexp_replace("request_path", grouping, "UID"),
        }
    )


def _refers(earlier: Column, later: Column) -> Column:
    """Whether the later request's referer is the earlier one; not known is no."""
    same = (later["request_referer_path"] == earlier["request_path"]) & kv.pairs_equal(earlier["request_query"], later["request_referer_query"])
    return F.coalesce(same, F.lit(False))


def _unbroken(links: Column) -> Column:
    """How many links hold from the first on."""
    broken = F.array_position(links, False)
    return F.when(broken > 0, broken - 1).otherwise(F.size(links)).cast("int")


def funnels(views: DataFrame, cfg: PipelineConfig, tiebreak: str = "request_uuid") -> DataFrame:
    """Each page view with the steps before and after it, as far as each step refers to the one before.

    The preceding and following requests are collected by bounded frames over the window that also removes repeats, so
    one shuffle by visitor and day serves all. Step 1 is nearest; labels say how a chain ends.
    """
    depth = cfg.funnel_depth
    views = with_referer(views, cfg.path_grouping)
    order = Window.partitionBy(*_VISITOR_DAY).orderBy("occurred_at", tiebreak)
    own = F.struct("occurred_at", "request_path", "request_path_grouped", "request_query", "request_referer_path", "request_referer_query")
    rows = views.withColumn("_own", own)
    rows = rows.withColumn("_back", F.reverse(F.collect_list("_own").over(order.rowsBetween(-depth, -1)))).withColumn("_on", F.collect_list("_own").over(order.rowsBetween(1, depth)))
    back = F.transform("_back", lambda x, i: _refers(x, F.when(i == 0, F.col("_own")).otherwise(F.get("_back", i - 1))))
    on = F.transform("_on", lambda x, i: _refers(F.when(i == 0, F.col("_own")).otherwise(F.get("_on", i - 1)), x))
    rows = rows.withColumns({"_nb": _unbroken(back), "_no": _unbroken(on), "_tb": F.size("_back"), "_to": F.size("_on")})

    def seconds(a: Column, b: Column) -> Column:
        return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1_000_000.0)

    def step(steps: str, kept: str, i: int, name: str) -> Column:
        return F.when(F.col(kept) >= i, F.get(steps, F.lit(i - 1))[name])

    out: dict[str, Column] = {}
    sides = (("preceding", "_back", "_nb", "_tb", "Arrived on site"), ("following", "_on", "_no", "_to", "Left site"))
    for i in range(1, depth + 1):
        for side, steps, kept, total, end in sides:
            label = F.when(step(steps, kept, i, "request_path_grouped").isNotNull(), step(steps, kept, i, "request_path_grouped"))
            if i == 1:
                label = label.when(F.col(total) > 0, "Other route").otherwise(end)
            else:
                reached = step(steps, kept, i - 1, "request_path_grouped").isNotNull()
                label = label.when(reached & (F.col(total) == i), "Other route").when(reached, end)
            out[f"{side}_request_path_grouped_{i}"] = label
        if i > 1:
            later, earlier = F.get("_back", F.lit(i - 2))["occurred_at"], F.get("_back", F.lit(i - 1))["occurred_at"]
            out[f"seconds_between_preceding_steps_{i - 1}_and_{i}"] = F.when(F.col("_nb") >= i, seconds(earlier, later))
            earlier, later = F.get("_on", F.lit(i - 2))["occurred_at"], F.get("_on", F.lit(i - 1))["occurred_at"]
            out[f"seconds_between_following_steps_{i - 1}_and_{i}"] = F.when(F.col("_no") >= i, seconds(earlier, later))
    out["seconds_since_preceding_step_1"] = seconds(step("_back", "_nb", 1, "occurred_at"), F.col("occurred_at"))
    out["seconds_until_following_step_1"] = seconds(F.col("occurred_at"), step("_on", "_no", 1, "occurred_at"))

    referer, own_site = F.col("request_referer"), cfg.own_site
    external = referer.isNull() | ~referer.rlike(own_site)
    domain = F.get(F.split(referer, "/"), F.lit(2))
    params = kv.attribution("request_query", list(cfg.attribution), external)
    out |= params
    out["newly_arrived"] = F.when(external, NEW).otherwise(KNOWN)
    out["next_step"] = F.when(F.col("_to") == 0, LEFT).otherwise(STAYED)
    out["medium"] = scalar.traffic_medium(referer, domain, params, own_site, excluded=cfg.excluded_domains)
    out["referer_domain"] = F.when(~referer.rlike(own_site) & ~referer.rlike(cfg.excluded_domains), domain)
    return rows.withColumns(out).drop("_own", "_back", "_on", "_nb", "_no", "_tb", "_to", "_day", "data", "entity_table_name")


def sessions(pages: DataFrame, events: DataFrame, cfg: PipelineConfig, tiebreak: str = "request_uuid") -> DataFrame:
    """Page views that arrived from elsewhere, with the users ever linked to the visitor and the next session's start.

    Users are gathered to one row for each visitor before the join, so the join never multiplies rows.
    """
    users = events.where("request_user_id is not null and anonymised_user_agent_and_ip is not null").groupBy("anonymised_user_agent_and_ip")
    users = users.agg(F.array_join(F.array_sort(F.collect_set("request_user_id")), ", ").alias("user_ids"))
    new = pages.where((F.col("newly_arrived") == NEW) & F.col("anonymised_user_agent_and_ip").isNotNull()).join(users, "anonymised_user_agent_and_ip", "left")
    who = F.when(F.col("user_ids").isNull(), F.concat(F.lit("v"), F.col("anonymised_user_agent_and_ip"))).otherwise(F.concat(F.lit("u"), F.col("user_ids")))
    order = Window.partitionBy(who).orderBy("occurred_at", tiebreak)
    agent = ["device_category", "browser_name", "browser_version", "operating_system_name", "operating_system_vendor", "operating_system_version"]
    return new.select(
        F.col("occurred_at").alias("session_started_at"), F.lead("occurred_at").over(order).alias("next_session_started_at"), "anonymised_user_agent_and_ip", "user_ids",
        F.col("request_uuid").alias("landing_request_uuid"), F.col("request_path").alias("landing_page_path"), F.col("request_user_agent").alias("user_agent"), *[c for c in agent if c in pages.columns],
        *cfg.attribution, "medium", "referer_domain", "next_step",
    )


def visits(events: DataFrame, since: Column | None = None) -> DataFrame:
    """Requests that count as page visits: no bots, pages only, neither redirects nor client errors."""
    rows = events.where("event_type = 'web_request' and device_category <> 'bot'").where(F.lower("response_content_type").contains("text/html"))
    rows = rows.where(~F.col("response_status").like("3__") & ~F.col("response_status").like("4__"))
    if since is not None:
        rows = rows.where(F.col("occurred_at") > since)
    referer = F.col("request_referer_path_and_query")
    bare = F.when(F.right(referer, F.lit(1)) == "?", F.get(F.split(referer, r"\?"), F.lit(0))).otherwise(referer)
    return rows.select(
        F.col("anonymised_user_agent_and_ip").alias("visitor"), F.col("request_user_id").alias("user"), "occurred_at", "namespace", F.col("request_path").alias("path"), F.col("request_query").alias("query"),
        F.col("request_path_and_query").alias("page"), F.col("request_referer_domain").alias("referer_domain"), bare.alias("referer"), F.to_date("occurred_at").alias("day"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Visits with a number each, ``visit``, written once: what follows reads them twice."""
    return written_once(rows.withColumn("visit", F.monotonically_increasing_id()), "visits")


def _someone(name: str, prefix: str) -> Column:
    """A key of a visit's user or visitor; who isn't known is nobody else, so that such visits have keys of their own."""
    return F.coalesce(F.concat(F.lit(prefix), F.col(name)), F.concat(F.lit("?"), F.col("visit").cast("string")))


def following_pages(rows: DataFrame) -> DataFrame:
    """Visits with the later pages that refer to them: ``first_following`` (time, page, user), the first one with a user,
    and ``following_pages``, their number. Of visits with numbers, see :func:`numbered`.

    A page follows a visit if it refers to the visit's page on the same day, by the same visitor or user, before the
    page is visited again. Both sides are told by (who, page, day), for the visitor and for the user, so that one join
    by equality finds all followers; one by both is taken once. Visits without a user end no other visit's followers.
    """
    own = [c for c in rows.columns if c not in ("visit", "day")]
    by_visitor = Window.partitionBy(_someone("visitor", "v"), "page", "day").orderBy("occurred_at")
    by_user = Window.partitionBy(_someone("user", "u"), "page", "day").orderBy("occurred_at")
    again = rows.withColumn("again", F.lead("occurred_at").over(by_visitor)).withColumn("again", F.coalesce(F.lead("occurred_at").over(by_user), "again"))
    who = F.explode(F.filter(F.array(F.concat(F.lit("v"), F.col("visitor")), F.concat(F.lit("u"), F.col("user"))), lambda k: k.isNotNull())).alias("who")
    every = again.select("*", F.explode_outer(F.filter(F.array(F.concat(F.lit("v"), F.col("visitor")), F.concat(F.lit("u"), F.col("user"))), lambda k: k.isNotNull())).alias("who"))
    later = rows.where("referer is not null").select(who, F.col("referer").alias("page"), "day", F.col("occurred_at").alias("f_at"), F.col("page").alias("f_page"), F.col("user").alias("f_user"), F.col("visitor").alias("f_visitor"))
    joined = every.join(later, ["who", "page", "day"], "left")
    when = (F.col("occurred_at") < F.col("f_at")) & (F.col("again").isNull() | (F.col("f_at") < F.col("again")))
    once = F.col("who").startswith("v") | ~F.coalesce(F.col("visitor") == F.col("f_visitor"), F.lit(False))
    one = F.when(F.coalesce(when & once, F.lit(False)), F.struct("f_at", "f_page", "f_user"))
    found = joined.groupBy("visit").agg(
        F.any_value(F.struct(*own)).alias("own"), F.min(one).alias("first_following"), F.min(F.when(one.getField("f_user").isNotNull(), one)).alias("first_following_user"), F.count(one).alias("following_pages")
    )
    return found.select("visit", "own.*", "first_following", "first_following_user", "following_pages")


def impute_users(rows: DataFrame) -> DataFrame:
    """Visits with ``estimated_user``: the own user, else the next one within 30 minutes (if the visitor goes on within
    30 whole minutes) or that of the first following page with a user, else the last one within 30 minutes.

    The frames count whole seconds; of visits within one second the first in time is the next one, and the last in time
    the last one, so that the result doesn't depend on the order of the input."""
    visitor = _someone("visitor", "v")
    order = Window.partitionBy(visitor).orderBy("occurred_at", "page", "path")
    seconds = Window.partitionBy(visitor).orderBy(F.unix_seconds("occurred_at"))
    known = F.when(F.col("user").isNotNull(), F.struct("occurred_at", "page", "path", "user"))
    ahead = F.min(known).over(seconds.rangeBetween(0, _GAP_SECONDS))["user"]
    behind = F.max(known).over(seconds.rangeBetween(-_GAP_SECONDS, 0))["user"]
    after = F.timestamp_diff("MINUTE", F.col("occurred_at"), F.lead("occurred_at").over(order))
    before = F.timestamp_diff("MINUTE", F.lag("occurred_at").over(order), F.col("occurred_at"))
    next_user = F.when(after <= _GAP_MINUTES, ahead).otherwise(F.col("first_following_user.f_user"))
    return rows.withColumn("estimated_user", F.coalesce("user", next_user, F.when(before <= _GAP_MINUTES, behind)))


def _sessionise(rows: DataFrame) -> DataFrame:
    """Number the sessions of each ``who``: a visit is the last of its session if nothing follows within 30 whole
    minutes and no page refers to it."""
    order = Window.partitionBy("who").orderBy("occurred_at", "page", "path")
    gap = F.timestamp_diff("MINUTE", F.col("occurred_at"), F.lead("occurred_at").over(order))
    goes_on = F.lead("occurred_at").over(order).isNotNull() & ((gap <= _GAP_MINUTES) | (F.col("following_pages") > 0))
    rows = rows.withColumn("next_step", F.when(goes_on, F.when(F.col("estimated_user").isNull(), STAYED_UNKNOWN).otherwise(STAYED)).otherwise(LEFT))
    starts = F.coalesce(F.lag("next_step").over(order) == LEFT, F.lit(True))
    return rows.withColumn("_starts", starts).withColumn("number", F.count(F.when(F.col("_starts"), 1)).over(Window.partitionBy("who").orderBy("occurred_at"))).drop("_starts")


def session_details(events: DataFrame, cfg: PipelineConfig, since: Column | None = None) -> DataFrame:
    """Sessions with their pages in order, by user where one is known or estimated, else by visitor.

    From the numbering of sessions on all is dealt by who they are of. A visit of neither a known user nor visitor is a
    session of its own, without an id.
    """
    rows = impute_users(following_pages(numbered(visits(events, since))))
    who = F.coalesce(F.concat(F.lit("u"), F.col("estimated_user")), _someone("visitor", "v"))
    every = _sessionise(rows.withColumn("who", who))
    external = F.col("referer_domain").isNull() | ~F.col("referer_domain").rlike(cfg.own_site)
    params = kv.attribution("query", list(cfg.attribution), external, flat=False)
    medium = scalar.traffic_medium(F.col("referer_domain"), F.col("referer_domain"), params, cfg.own_site, excluded=cfg.excluded_domains)
    utm = ("utm_source", "utm_medium", "utm_campaign", "utm_content")
    order = Window.partitionBy("who", "number").orderBy("occurred_at", "page", "path")
    left = F.lead("occurred_at").over(order)
    pages = every.select(
        "who", "number", F.col("estimated_user").alias("user_id"), F.coalesce("estimated_user", "visitor").alias("name"),
        F.struct(
            F.col("occurred_at").alias("page_entry_time"), "page", F.col("path").alias("page_path"), F.col("visitor").alias("anonymised_user_agent_and_ip"), F.col("referer_domain").alias("previous_page_domain"),
            scalar.extract_or_null("referer", r"^([^?]+)").alias("previous_page"), left.alias("page_exit_time"), F.timestamp_diff("SECOND", F.col("occurred_at"), left).alias("duration"), "next_step",
            "namespace", *[params.get(p, F.lit(None).cast("string")).alias(p) for p in utm], medium.alias("medium"),
        ).alias("p"),
    )
    found = pages.groupBy("who", "number").agg(F.array_sort(F.collect_list("p")).alias("p"), F.any_value("user_id").alias("user_id"), F.any_value("name").alias("name"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    start, end = first["page_entry_time"], last["page_entry_time"]
    detail = F.transform(
        "p",
        lambda x: F.struct(
            x["anonymised_user_agent_and_ip"].alias("anonymised_user_agent_and_ip"), x["page_path"].alias("page"), x["previous_page_domain"].alias("previous_page_domain"), x["previous_page"].alias("previous_page"),
            x["page_entry_time"].alias("page_entry_time"), x["page_exit_time"].alias("page_exit_time"), x["duration"].alias("duration"), x["next_step"].alias("next_step"),
        ),
    )
    return found.select(
        F.concat("name", F.lit("-"), F.date_format(start, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("session_id"), "user_id", first["namespace"].alias("session_namespace"), first["previous_page_domain"].alias("session_referer_domain"), first["page_path"].alias("start_page"), *[first[p].alias(p) for p in utm],
        first["medium"].alias("medium"), last["page_path"].alias("exit_page"), start.alias("session_start_timestamp"), end.alias("final_session_page_timestamp"),
        F.when(start != end, F.timestamp_diff("SECOND", start, end)).alias("session_time_in_seconds"), F.size("p").cast("long").alias("count_pages_visited"), detail.alias("pages_visited_details"),
    )
