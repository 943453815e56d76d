"""Stored events moved to where the present configuration has their keys, hidden or visible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig
from tidemark.operators import hidden, quality
from tidemark.plans.pipeline import ChecksFailed
from tidemark.plans.tables import Store


def migrate_hidden(store: Store, name: str, cfg: PipelineConfig, as_of: Column) -> None:
    """Rearrange the events of table ``name`` up to the day before ``as_of``; later ones stay as they were streamed.

    Nothing is written if yesterday's events still came with keys in the wrong place: the application must stream by
    the configuration before what is stored can follow it. The table is replaced as a whole or not at all, so a run
    that dies leaves it as it was. Running it again changes nothing; an empty table stays empty.
    """
    rows, yesterday = store.read(name), F.date_sub(F.to_date(as_of), 1)
    for custom, configured in ((False, cfg.entities), (True, cfg.custom_events)):
        if not any(c.keys for c in configured):
            continue
        wrong = quality.hidden_mismatch(rows.where(F.to_date("occurred_at") == yesterday), cfg, custom=custom).limit(5).collect()
        if wrong:
            raise ChecksFailed(f"{name}: streamed yesterday in the wrong field: {[(r['name'], r['key_configured']) for r in wrong]}")
    old = F.coalesce(F.to_date("occurred_at") <= yesterday, F.lit(False))
    moved = hidden.rearrange(rows.select("*", F.col("data").alias("_data"), F.col("hidden_data").alias("_hidden")), cfg)
    placed = {c: F.when(old, F.col(c)).otherwise(F.col(was)) for c, was in (("data", "_data"), ("hidden_data", "_hidden"))}
    store.replace(name, moved.withColumns(placed).select(rows.columns), ["event_type"], by_day="occurred_at")
