"""Moving values between data and hidden data after the configuration of hidden keys has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ENTITY_EVENTS, PipelineConfig
from tidemark.functions import kv


def rearrange(events: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Events with each key where the configuration has it now.

    Keys configured as visible are shown; keys configured as hidden, and keys that aren't configured for the entity or
    custom event, are hidden. Events that are neither, checks of an entity's table among them, are left as they are.
    """
    shown, hidden = _keys_of(cfg, False), _keys_of(cfg, True)
    every = kv.combined("data", "hidden_data")

    def among(keys: Column) -> Column:
        return lambda e: F.coalesce(F.array_contains(keys, e["key"]), F.lit(False))

    visible = F.filter(every, among(shown))
    rest = F.filter(every, lambda e: among(hidden)(e) | ~among(shown)(e))
    known = shown.isNotNull()
    return events.withColumns({"data": F.when(known, visible).otherwise(F.col("data")), "hidden_data": F.when(known, rest).otherwise(F.col("hidden_data"))})


def _keys_of(cfg: PipelineConfig, hidden: bool) -> Column:
    out = F.lit(None).cast("array<string>")
    for e in cfg.entities:
        names = {n for k in e.keys if k.hidden == hidden for n in (k.name, *k.past_names)}
        names |= {"created_at", "updated_at"} if not hidden else set()
        names |= {e.id_key} if e.hide_primary_key == hidden else set()
        out = F.when(F.col("event_type").isin(*ENTITY_EVENTS) & (F.col("entity_table_name") == e.name), _texts(names)).otherwise(out)
    for c in cfg.custom_events:
        names = {n for k in c.keys if k.hidden == hidden for n in (k.name, *k.past_names)}
        out = F.when(F.col("event_type") == c.event_type, _texts(names)).otherwise(out)
    return out


def _texts(names: set[str]) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")


def masked(rows: DataFrame) -> DataFrame:
    """Rows with the columns whose metadata says hidden as NULL."""
    return rows.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.metadata.get("hidden") else F.col(f.name) for f in rows.schema])
