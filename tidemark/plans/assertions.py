"""The assertions of a configuration as nodes of its graph: each gives the rows that break it.

Those that block keep what needs them from being built; others warn.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig, in_quiet_range
from tidemark.operators import checks, keys, quality
from tidemark.plans.pipeline import Model
from tidemark.plans.tables import block_sample

#: Share of the blocks of past events in which keys in the wrong place are looked for.
HISTORIC_SAMPLE = 0.01


def assertions(cfg: PipelineConfig, as_of: Column, today: date) -> dict[str, Model]:
    """By name. ``as_of`` is the time they are judged at and ``today`` its day, which decides on quiet ranges: freshness
    that is switched off in them is not asserted then. A change-data source needs its ``heartbeat`` table among the logs."""
    s, quiet, out = cfg.source_name, in_quiet_range(today, cfg.quiet_ranges), {}
    events, yesterday = f"events_{s}", F.date_sub(F.to_date(as_of), 1)

    def add(name: str, needs: tuple[str, ...], rows: Callable[[dict[str, DataFrame]], DataFrame], warns: bool = True) -> None:
        out[name] = Model(name, lambda b, _: rows(b), needs, "assertion", warns=warns)

    def fresh(name: str, days: int | None, off: bool, needs: str, rows: Callable[[dict[str, DataFrame]], DataFrame], at: str = "occurred_at") -> None:
        if days is not None and not (off and quiet):
            add(f"{name}_not_fresh", (needs,), lambda b: quality.not_fresh(rows(b), as_of, days, at))

    fresh("events", cfg.events_freshness_days, cfg.freshness_off_in_quiet_ranges, events, lambda b: b[events])
    for c in cfg.custom_events:
        fresh(c.event_type, c.freshness_days, c.freshness_off_in_quiet_ranges, events, lambda b, c=c: b[events].where(F.col("event_type") == c.event_type))
    for e in cfg.entities:
        fresh(e.name, e.freshness_days, e.freshness_off_in_quiet_ranges, events, lambda b, e=e: b[events].where(F.col("entity_table_name") == e.name))
    scheduled, imported = f"entity_table_check_scheduled_{s}", f"entity_table_check_import_{s}"
    compared = cfg.transform_entities and bool(cfg.entities)
    if cfg.entities:
        add("fields_missing", (events,), lambda b: quality.missing_expected_fields(b[events], cfg, as_of))
        add("fields_unhandled", (events,), lambda b: quality.unhandled_fields(b[events], cfg, as_of))
        add("entities_not_backfilled", (events, scheduled) if compared else (events,), lambda b: quality.not_backfilled(b[events], cfg, b.get(scheduled), as_of))
    add("custom_events_unhandled", (events,), lambda b: quality.unhandled_custom_events(b[events], cfg, as_of))
    if cfg.hidden_policy:
        for custom, name, configured in ((False, "hidden_mismatch", cfg.entities), (True, "hidden_mismatch_of_custom_events", cfg.custom_events)):
            if any(c.keys for c in configured):
                add(f"{name}_yesterday", (events,), lambda b, c=custom: quality.hidden_mismatch(b[events], cfg, c, since=yesterday))
                add(f"{name}_historic", (events,), lambda b, c=custom: quality.hidden_mismatch(block_sample(b[events], HISTORIC_SAMPLE), cfg, c, before=yesterday))
    if cfg.compare_checksums and compared:
        add("ids_do_not_match", (scheduled,), lambda b: checks.mismatches(b[scheduled]))
        add("imported_ids_do_not_match", (imported,), lambda b: checks.mismatches(b[imported].where(F.to_date("checksum_calculated_at") >= yesterday)))
    if compared:
        for e in cfg.entities:
            for k in keys.foreign_keys(e):
                own, other = f"{e.name}_latest_{s}", f"{k.entity}_latest_{s}"
                add(f"{e.name}_{k.column}_without_{k.entity}", (own, other), lambda b, k=k, own=own, other=other: keys.orphans(b[own], k, b[other]))
    if cfg.cdc:
        if not (cfg.cdc.freshness_off_in_quiet_ranges and quiet):
            add("heartbeat_not_fresh", ("heartbeat",), lambda b: quality.heartbeat_not_fresh(b["heartbeat"], as_of, cfg.cdc.heartbeat_hours))
        for e in cfg.entities:
            log = f"{e.name}{cfg.cdc.suffix}"
            fresh(f"{e.name}_changes", e.freshness_days, e.freshness_off_in_quiet_ranges, log, lambda b, log=log: b[log], "updated_at")
            add(f"{e.name}_columns_not_configured", (log,), lambda b, e=e, log=log: quality.columns_not_configured(b[log], e, cfg.cdc.primary_key), warns=False)
            add(f"{e.name}_columns_missing", (log,), lambda b, e=e, log=log: quality.columns_missing(b[log], e, cfg.cdc.primary_key))
    return out


def blocked(cfg: PipelineConfig) -> dict[str, tuple[str, ...]]:
    """By assertion, models that are built only if it holds: versions from a change log wait for new columns to be
    configured, which may hold personal data."""
    return {f"{e.name}_columns_not_configured": (f"{e.name}_cdc_version_{cfg.source_name}",) for e in cfg.entities} if cfg.cdc else {}


def broken(built: dict[str, DataFrame], named: dict[str, Model]) -> dict[str, DataFrame]:
    """Those assertions that rows break, with the rows. ``built`` as from the runner."""
    found = {name: m.build(built, None) for name, m in named.items()}
    return {name: rows for name, rows in found.items() if not rows.isEmpty()}
