"""Configuration of a pipeline: entities and their keys, custom events, funnels, change-data source. Checked when made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from datetime import date

from tidemark.functions.kv import TYPES

BUILT_IN_EVENTS = (
    "create_entity", "update_entity", "delete_entity", "import_entity", "initialise_analytics", "entity_table_check", "import_entity_table_check", "web_request",
)
ENTITY_EVENTS = ("create_entity", "update_entity", "delete_entity", "import_entity")
RESERVED_KEYS = frozenset(
    "id created_at updated_at valid_from valid_to event_type request_uuid request_path request_user_id request_method request_user_agent request_referer request_query response_content_type response_status anonymised_user_agent_and_ip device_category browser_name browser_version operating_system_name operating_system_vendor operating_system_version entity_table_name entity_id occurred_at previous_occurred_at previous_event_type key_updated new_value previous_value update_id".split()
)
RESERVED_EVENT_KEYS = RESERVED_KEYS - {"id", "created_at", "updated_at", "valid_from", "valid_to"}
#: School holidays, nearly: (from month, from day, to month, to day).
QUIET_RANGES = ((7, 25, 9, 1), (3, 29, 4, 14), (12, 22, 1, 7))
ATTRIBUTION = ("utm_source", "utm_campaign", "utm_medium", "utm_content", "gclid", "gcsrc", "fbclid", "dclid", "gad_source", "ds_rl", "gbraid", "msclkid")


class ConfigError(ValueError):
    pass


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _positive(value, name: str) -> None:
    _require(isinstance(value, int) and not isinstance(value, bool) and value > 0, f"{name} must be a positive integer, not {value!r}")


@dataclass
class Key:
    """One field of an entity or a custom event."""

    name: str
    data_type: str = "string"
    is_array: bool = False
    alias: str | None = None
    past_names: tuple[str, ...] = ()
    historic: bool = False
    hidden: bool = False
    hidden_policy: str | None = None
    description: str = ""
    foreign_key_name: str | None = None
    foreign_key_table: str | None = None

    @property
    def output(self) -> str:
        return self.alias or self.name

    def __post_init__(self):
        _require(self.data_type in TYPES, f"{self.name}: data type {self.data_type!r} is none of {', '.join(TYPES)}")
        _require(not (self.is_array and self.data_type == "integer_array"), f"{self.name}: an integer_array cannot be an array again")
        _require(isinstance(self.hidden, bool), f"{self.name}: hidden must be true or false")
        _require(isinstance(self.historic, bool) and isinstance(self.is_array, bool), f"{self.name}: flags must be true or false")


@dataclass
class Entity:
    """A table of the application database whose rows' changes are streamed."""

    name: str
    keys: list[Key] = field(default_factory=list)
    primary_key: str | None = None
    hide_primary_key: bool = False
    freshness_days: int | None = None
    freshness_off_in_quiet_ranges: bool = False
    materialisation: str = "table"
    expiration_days: int | None = None
    has_timestamps: bool = True
    description: str = ""

    @property
    def id_key(self) -> str:
        return self.primary_key or "id"

    def __post_init__(self):
        _require(self.materialisation in ("table", "view"), f"{self.name}: materialisation must be table or view")
        _require(self.primary_key != "id", f"{self.name}: leave the primary key out if it is id")
        if self.freshness_days is not None:
            _positive(self.freshness_days, f"{self.name}: freshness_days")
        if self.expiration_days is not None:
            _positive(self.expiration_days, f"{self.name}: expiration_days")
        for key in self.keys:
            _require(key.output not in RESERVED_KEYS, f"{self.name}.{key.name}: {key.output} is a reserved name; give an alias")
            _require(not (key.hidden and key.name == self.id_key), f"{self.name}.{key.name}: hide the primary key with hide_primary_key")
        _require(len({k.output for k in self.keys}) == len(self.keys), f"{self.name}: output names must differ")


@dataclass
class CustomEvent:
    event_type: str
    keys: list[Key] = field(default_factory=list)
    freshness_days: int | None = None
    freshness_off_in_quiet_ranges: bool = False
    expiration_days: int | None = None
    description: str = ""

    def __post_init__(self):
        _require(self.event_type not in BUILT_IN_EVENTS, f"{self.event_type} is a built-in event type")
        for value, name in ((self.freshness_days, "freshness_days"), (self.expiration_days, "expiration_days")):
            if value is not None:
                _positive(value, f"{self.event_type}: {name}")
        for key in self.keys:
            _require(key.output not in RESERVED_EVENT_KEYS, f"{self.event_type}.{key.name}: {key.output} is a reserved name; give an alias")


@dataclass
class Cdc:
    """A change-data-capture source: one typed, append-only table for each entity."""

    dataset: str
    suffix: str = "_cdc"
    primary_key: str = "id"
    legacy_cutoff: str | None = None
    heartbeat_hours: int = 12
    freshness_off_in_quiet_ranges: bool = False
    reconcile: bool = False
    min_live_fraction: float = 0.8
    max_delete_fraction: float = 0.2
    min_snapshot_age_minutes: int = 60
    detection_window_days: int = 7
    force_snapshot_lsn: str | None = None

    def __post_init__(self):
        _require(bool(self.dataset), "the change-data source needs a dataset")
        _require(isinstance(self.reconcile, bool), "reconcile must be true or false")
        _require(0 <= self.max_delete_fraction <= 1 and 0 <= self.min_live_fraction <= 1, "fractions lie between 0 and 1")


@dataclass
class PipelineConfig:
    source_name: str
    own_site: str | None = None
    expiration_days: int | bool = False
    web_request_expiration_days: int | None = None
    namespace: str | None = None
    entities: list[Entity] = field(default_factory=list)
    custom_events: list[CustomEvent] = field(default_factory=list)
    events_freshness_days: int = 1
    freshness_off_in_quiet_ranges: bool = False
    compare_checksums: bool = False
    transform_entities: bool = True
    sessions: bool = True
    session_details: bool = True
    monitoring: bool = True
    funnel_depth: int = 10
    path_grouping: str = "[0-9a-zA-Z]*[0-9][0-9a-zA-Z]*"
    attribution: tuple[str, ...] = ATTRIBUTION
    excluded_domains: str = "(?i)(signin.education.gov.uk)"
    hidden_policy: str | None = None
    quiet_ranges: tuple = QUIET_RANGES
    cdc: Cdc | None = None

    def __post_init__(self):
        _require(re.fullmatch("[A-Za-z0-9_]*", self.source_name or "") is not None, "source_name may hold letters, digits and _ only")
        days = self.expiration_days
        _require(days is False or (isinstance(days, int) and not isinstance(days, bool) and days >= 0), "expiration_days must be an integer or False")
        limit = 0 if days is False else days
        if self.web_request_expiration_days is not None:
            _positive(self.web_request_expiration_days, "web_request_expiration_days")
            _require(self.web_request_expiration_days <= limit, "web requests may not be kept longer than everything else")
        for own in [*self.entities, *self.custom_events]:
            if own.expiration_days is not None and limit:
                _require(own.expiration_days <= limit, f"{getattr(own, 'name', None) or own.event_type} may not be kept longer than everything else")
        _positive(self.events_freshness_days, "events_freshness_days")
        _positive(self.funnel_depth, "funnel_depth")
        if self.sessions:
            _require(bool(self.own_site), "sessions need own_site")
            bare = (self.own_site or "").replace("(?i)", "").replace("(?:", "(")
            _require(":" not in bare and "/" not in bare, "own_site is a domain, without : or /")
            taken = {"medium", "referer_domain", "newly_arrived", "next_step", "occurred_at", "request_path", "request_referer"}
            _require(not taken & set(self.attribution), "an attribution parameter has the name of a funnel column")
        for entity in self.entities:
            hidden = entity.hide_primary_key or any(k.hidden for k in entity.keys)
            policies = [k.hidden_policy for k in entity.keys if k.hidden] or [None]
            _require(not hidden or bool(self.hidden_policy) or all(policies), f"{entity.name}: hidden keys need a hidden_policy")
        if self.cdc and self.cdc.legacy_cutoff:
            _require(not any(k.is_array for e in self.entities for k in e.keys), "rows before the cutoff cannot be merged if a key is an array")

    def entity(self, name: str) -> Entity:
        return next(e for e in self.entities if e.name == name)


def from_dict(options: dict) -> PipelineConfig:
    """A configuration from plain dictionaries; unknown options are errors."""

    def build(kind, given: dict, **parts):
        known = {f.name for f in fields(kind)}
        _require(not set(given) - known, f"unknown option(s) {sorted(set(given) - known)} for {kind.__name__}")
        return kind(**{**given, **parts})

    def keys(given: dict) -> dict:
        return {"keys": [build(Key, k) for k in given.get("keys", [])]}

    parts = {
        "entities": [build(Entity, e, **keys(e)) for e in options.get("entities", [])],
        "custom_events": [build(CustomEvent, e, **keys(e)) for e in options.get("custom_events", [])],
    }
    if options.get("cdc"):
        parts["cdc"] = build(Cdc, options["cdc"])
    return build(PipelineConfig, options, **parts)


def in_quiet_range(today: date, ranges=QUIET_RANGES) -> bool:
    """Whether a day lies in one of the ranges, ends included.

    A range is (from month, from day, to month, to day), and may run over the new year, or a pair of dates in order.
    """
    for r in ranges:
        if len(r) == 2:
            _require(r[0] <= r[1], f"{r[0]} is after {r[1]}")
            if r[0] <= today <= r[1]:
                return True
            continue
        start, end, now = (r[0], r[1]), (r[2], r[3]), (today.month, today.day)
        if (start <= now <= end) if start <= end else (now >= start or now <= end):
            return True
    return False
