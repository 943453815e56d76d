"""The models of a pipeline as a graph, and a runner that builds them in order, whole or from where they stood."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, timedelta
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Cdc, Entity, PipelineConfig
from tidemark.operators import catalogue, cdc, checks, entity, events, quality, web
from tidemark.operators.keys import ForeignKey, foreign_keys
from tidemark.plans import monitoring
from tidemark.plans.tables import Store, temporaries, written_once


class ChecksFailed(RuntimeError):
    """``failed``: by node, rows that broke it; ``skipped``: nodes that needed one of them; ``built``: all others."""

    def __init__(self, message: str, failed: dict[str, list] = None, skipped: list[str] = (), built: dict[str, DataFrame] = None):
        super().__init__(message)
        self.failed, self.skipped, self.built = failed or {}, list(skipped), built or {}


@dataclass
class Model:
    """``build(inputs, since)`` gives the rows; ``since`` is the checkpoint of an incremental run, None for all."""

    name: str
    build: Callable[[dict[str, DataFrame], Column | None], DataFrame]
    needs: tuple[str, ...] = ()
    mode: str = "table"  # table, view, append, merge, history, days (the last days are built again) or assertion
    keys: tuple[str, ...] = ()
    within: str | None = None  # of a merge: the partitions in which rows to be replaced may stand
    still_open: str | None = None  # of a history: the rows that each run rebuilds, given as an input under its own name
    checkpoint: str | None = None
    partition_by: tuple[str, ...] = ()
    by_day: str | None = None  # the time by whose days the table is dealt
    days_again: int = 1  # of a model by days: days before the checkpoint's that a run builds again
    recent: dict[str, int] = field(default_factory=dict)  # inputs read from so many days before the checkpoint's on
    sort_by: tuple[str, ...] = ()
    buckets: tuple[str, ...] = ()  # columns by which a table is bucketed
    protected: bool = False
    restart: Callable[[dict[str, DataFrame], Column], DataFrame] | None = None  # rows for which a run must build all anew
    warns: bool = False  # of an assertion: its rows are reported, but block no other node
    checks: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    guard: Callable[[dict[str, DataFrame], DataFrame], DataFrame] | None = None  # of the inputs and the table; as a check
    sees_itself: bool = False  # an append model that is given its own table as an input, under its own name
    retain: Column | None = None  # true for rows that stay in the table after each run
    first_day: Column | None = None  # of a table by days: earlier days are dropped after each run
    description: str = ""
    labels: dict[str, str] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()


def models(cfg: PipelineConfig, as_of: Column) -> dict[str, Model]:
    """All models of a configuration. ``raw`` is the stream itself, given to the runner; with a change-data source, so
    are the logs, one for each entity, named by the entity and the source's suffix."""
    s, out = cfg.source_name, {}

    def add(model: Model) -> None:
        out[model.name] = model

    unique_versions = [lambda d: quality.not_unique(d, ["entity_table_name", "entity_id", "valid_from"]), lambda d: quality.null_values(d, ["valid_from", "entity_table_name", "entity_id"])]
    add(
        Model(
            f"events_{s}", lambda i, cp: events.enrich(i["raw"], cfg.namespace, cp), ("raw",), "append", checkpoint="occurred_at", by_day="occurred_at", recent={"raw": 1}, partition_by=("event_type",),
            retain=_retention(cfg, as_of), first_day=None if cfg.expiration_days is False else F.date_sub(F.to_date(as_of), cfg.expiration_days),
        )
    )
    add(Model(f"client_history_{s}", lambda i, cp: catalogue.configuration_history(i[f"events_{s}"]), (f"events_{s}",)))
    for c in cfg.custom_events:
        add(Model(f"{c.event_type}_{s}", lambda i, cp, c=c: entity.flatten_custom_event(i[f"events_{s}"], c, cp), (f"events_{s}",), "append", checkpoint="occurred_at", by_day="occurred_at", recent={f"events_{s}": 0}))
    if cfg.transform_entities and cfg.entities:
        versions, imports, streamed = f"{s}_entity_version", f"entity_table_check_import_{s}", f"import_events_{s}"

        def build_versions(i: dict[str, DataFrame], cp: Column | None) -> DataFrame:
            rows = i[f"events_{s}"] if cp is None else i[f"events_{s}"].where(F.col("occurred_at") > cp)
            found, complete = entity.versions(rows, cfg.entities, i.get(versions)), i[imports]
            if cp is not None:  # open versions have met earlier imports in earlier runs
                complete = complete.where(F.coalesce(F.col("final_import_event_received_at") > F.date_sub(F.to_date(cp), 1), F.lit(False)))
            return checks.infer_deletions(found, complete, checks.imported_ids(i[streamed]))

        needs = (f"events_{s}", imports, streamed)
        add(Model(streamed, lambda i, cp: checks.import_events(i["raw"], cfg.entities, cp), ("raw",), "append", checkpoint="occurred_at", recent={"raw": 0}, partition_by=("import_id",)))
        add(
            Model(
                versions, build_versions, needs, "history", still_open="valid_to is null", checkpoint="valid_from", recent={f"events_{s}": 0}, partition_by=("entity_table_name",), sort_by=("entity_id", "valid_from"),
                buckets=("entity_id",), checks=unique_versions, retain=_version_retention(cfg, as_of),
            )
        )
        add(Model(f"{s}_entity_field_updates", lambda i, cp: entity.field_updates(i[versions]), (versions,)))
        add(Model(f"{s}_data_schema_latest", lambda i, cp: catalogue.schema_text(catalogue.infer_types(i[f"events_{s}"])), (f"events_{s}",)))
        add(Model(f"entity_table_check_scheduled_{s}", lambda i, cp: checks.compare_scheduled(checks.check_events(i["raw"], "entity_table_check", F.date_sub(F.to_date(as_of), 8)), i[versions]), ("raw", versions)))
        add(Model(imports, lambda i, cp: checks.compare_imports(checks.touched_imports(i[streamed], cp)), (streamed,), "append", checkpoint="final_import_event_received_at"))
        tables, scheduled = f"pipeline_table_snapshots_{s}", f"entity_table_check_scheduled_{s}"
        if cfg.monitoring:
            add(Model(tables, lambda i, cp: monitoring.table_snapshot(i[scheduled], i[f"events_{s}"], cfg, as_of), (scheduled, f"events_{s}"), "merge", keys=("workflow_executed_at", "entity_table_name"), by_day="workflow_executed_at"))
            add(Model(f"pipeline_snapshots_{s}", lambda i, cp: monitoring.pipeline_snapshot(i[tables].where(F.col("workflow_executed_at") == as_of), i[f"client_history_{s}"], cfg), (tables, f"client_history_{s}"), "merge", keys=("workflow_executed_at",), by_day="workflow_executed_at"))
        for e in cfg.entities:
            flat = f"{e.name}_version_{s}"
            said = lambda kind, e=e: {"description": e.description, "labels": {"eventsource": s.lower(), "sourcetype": "stream", "entitytype": kind}}
            refers = tuple(replace(k, entity=f"{k.entity}_latest_{s}") for k in foreign_keys(e))
            add(Model(flat, lambda i, cp, e=e: entity.flatten_versions(i[versions], e), (versions,), e.materialisation, primary_key=("id", "valid_from"), **said("version")))
            add(
                Model(
                    f"{e.name}_latest_{s}", lambda i, cp, flat=flat: entity.latest(i[flat]), (flat,), e.materialisation, primary_key=("id",), foreign_keys=refers,
                    checks=[lambda d: quality.not_unique(d, ["id"])], **said("latest"),
                )
            )
            changes = f"{s}_entity_field_updates"
            add(Model(f"{e.name}_field_updates_{s}", lambda i, cp, e=e, flat=flat: entity.flatten_field_updates(i[f"{s}_entity_field_updates"], i[flat], e), (changes, flat), e.materialisation, **said("field_updates")))
    if cfg.sessions:
        pages = f"pageview_with_funnels_{s}"

        def build_pages(i: dict[str, DataFrame], cp: Column | None) -> DataFrame:
            return web.funnels(web.page_views(i[f"events_{s}"], before=F.to_date(as_of), after=None if cp is None else F.to_date(cp)), cfg)

        add(Model(pages, build_pages, (f"events_{s}",), "append", checkpoint="occurred_at", by_day="occurred_at", recent={f"events_{s}": 0}, sort_by=("newly_arrived",), first_day=None if cfg.expiration_days is False else F.date_sub(F.to_date(as_of), cfg.expiration_days)))
        add(Model(f"sessions_{s}", lambda i, cp: web.sessions(i[pages], i[f"events_{s}"], cfg), (pages, f"events_{s}"), by_day="session_started_at"))
    if cfg.session_details:

        def build_details(i: dict[str, DataFrame], cp: Column | None) -> DataFrame:
            """Of a later run the sessions from the day before the last one's start on, as these may go on; they are
            told from the day before that on. What a session's pages more than a day ago say isn't looked at again."""
            rows = web.session_details(i[f"events_{s}"], cfg)
            return rows if cp is None else rows.where(F.to_date("session_start_timestamp") >= F.date_sub(F.to_date(cp), 1))

        add(Model(f"session_details_{s}", build_details, (f"events_{s}",), "days", checkpoint="session_start_timestamp", by_day="session_start_timestamp", recent={f"events_{s}": 2}))
    if cfg.cdc:
        for e in cfg.entities:
            for model in change_data_models(e, cfg.cdc, s, as_of):
                add(model)
    return out


def _retention(cfg: PipelineConfig, as_of: Column) -> Column | None:
    """Shorter times than all events have: whole days and types of events go as partitions, entities' rows one by one."""
    limits = {
        "days": None, "web_days": cfg.web_request_expiration_days,
        "entity_days": {e.name: e.expiration_days for e in cfg.entities if e.expiration_days is not None},
        "event_days": {c.event_type: c.expiration_days for c in cfg.custom_events if c.expiration_days is not None},
    }
    return events.kept(as_of, **limits) if any(v is not None and v != {} for v in limits.values()) else None


def _version_retention(cfg: PipelineConfig, as_of: Column) -> Column | None:
    age, keep = F.datediff(F.to_date(as_of), F.to_date("valid_from")), None
    if cfg.expiration_days is not False:
        keep = age <= cfg.expiration_days
    for e in cfg.entities:
        if e.expiration_days is not None:
            own = (F.col("entity_table_name") != e.name) | (age <= e.expiration_days)
            keep = own if keep is None else keep & own
    return keep


def change_data_models(e: Entity, source: Cdc, s: str, as_of: Column) -> list[Model]:
    """Versions of an entity from its change log; with reconciliation also the deletions that full refreshes imply.

    The versions are a history by time of extraction: a run reads the log's rows that were extracted after the last
    one that it has, carries the last version of each id over, and goes on with its number. Only a log that brings a
    row older than the last version of its id makes a run build all anew. With a cutoff, versions of the event stream
    up to it come before those of the log, where all is built.

    Implied deletions are applied where the history is read (a view), so that it is never written again for them. They
    are judged by the guard together with those logged already, and logged only if no snapshot among
    them would delete too large a share of the live rows.
    """
    log, versions, refreshes, deletes = f"{e.name}{source.suffix}", f"{e.name}_cdc_version_{s}", f"{e.name}_full_refreshes_{s}", f"{e.name}_implied_deletions_{s}"
    current, found, legacy = versions, [], f"{e.name}_version_{s}"
    checks_of = [lambda d: quality.not_unique(d, ["id", "valid_from"]), lambda d: quality.null_values(d, ["id", "valid_from"])]

    def build(i: dict[str, DataFrame], cp: Column | None) -> DataFrame:
        if cp is not None:
            return cdc.cdc_versions(i[log], e.keys, cp, i[versions], source.primary_key)
        if source.legacy_cutoff is None:
            return cdc.cdc_versions(i[log], e.keys, id_col=source.primary_key)
        cutoff = F.lit(source.legacy_cutoff).cast("timestamp")
        return cdc.cdc_versions(i[log], e.keys, cutoff, id_col=source.primary_key, legacy=i[legacy].where(F.col("valid_from") <= cutoff))

    needs = (log, legacy) if source.legacy_cutoff else (log,)
    late = lambda i, cp: cdc.late_rows(i[log], i[versions], cp, source.primary_key)
    found.append(Model(versions, build, needs, "history", still_open="is_current or is_deleted", checkpoint="_airbyte_extracted_at", sort_by=("id", "valid_from"), buckets=("id",), restart=late, checks=checks_of))
    if source.reconcile:
        current = f"{e.name}_reconciled_version_{s}"
        found += [
            Model(refreshes, lambda i, cp: cdc.full_refreshes(i[log], i[versions], as_of, source), (log, versions)),
            Model(
                deletes, lambda i, cp: cdc.reconcile_deletes(i[log], i[versions], i[refreshes], as_of, source.primary_key, i[deletes].select("id", "snapshot_lsn") if deletes in i else None), (log, versions, refreshes), "append",
                guard=lambda i, rows: cdc.exceeds_safe_volume(rows, i[versions], source), sees_itself=True,
            ),
            Model(current, lambda i, cp: cdc.apply_deletes(i[versions], i[deletes]), (versions, deletes), "view"),
        ]
    return [*found, Model(f"{e.name}_cdc_latest_{s}", lambda i, cp: cdc.cdc_latest(i[current]), (current,), e.materialisation, checks=[lambda d: quality.not_unique(d, ["id"])])]


def with_assertions(plan: dict[str, Model], assertions: dict[str, Model], before: dict[str, tuple[str, ...]] | None = None) -> dict[str, Model]:
    """A plan with assertions as nodes. ``before``: by assertion, models that are built only if it holds."""
    out = plan | assertions
    for name, models_of in (before or {}).items():
        for m in models_of:
            if name in out and m in out:
                out[m] = replace(out[m], needs=(*out[m].needs, name))
    return out


def incremental(model: Model) -> bool:
    """Whether a run's cost grows with what is new rather than with all."""
    return model.mode in ("append", "merge", "history", "days")


def run(spark: SparkSession, store: Store, plan: dict[str, Model], raw: DataFrame, full: bool = False, logs: dict[str, DataFrame] | None = None, only: Callable[[Model], bool] | None = None) -> dict[str, DataFrame]:
    """Build every model after those it needs. A node whose rows break a check, a guard or an assertion keeps all that
    need it from being built, and no others; they are named by the error that ends the run. Assertions that only warn
    block nothing: their rows are in the result under their names.

    Append, merge and history models go on from their checkpoint unless ``full``, protected ones in any case. A merge
    model is given its own table as an input and a history its open rows, to carry them over. A model by days replaces
    the days from ``days_again`` before the checkpoint's on. ``logs``: change logs by name. ``only``: models that are
    built in this run; of others the table that stands is taken, if there is one.
    """
    built: dict[str, DataFrame] = {"raw": raw, **(logs or {})}
    given, failed, skipped = set(built), {}, []
    for name in TopologicalSorter({m.name: set(m.needs) for m in plan.values()}).static_order():
        if name in given:
            continue
        if name not in plan:
            raise LookupError(f"the input {name} isn't given")
        model = plan[name]
        if any(n in failed and not (n in plan and plan[n].warns) or n in skipped for n in model.needs):
            skipped.append(name)
            continue
        if only is not None and not only(model):
            if store.exists(name):
                built[name] = store.read(name)
            else:
                skipped.append(name)
            continue
        if model.mode == "assertion":
            rows = model.build(built, None)
            built[name] = rows
            if broken := rows.limit(5).collect():
                failed[name] = broken
            continue
        if model.mode == "view":
            rows = _build(store, model, built, full)
        else:
            with temporaries():
                rows = _build(store, model, built, full)
        if isinstance(rows, list):
            failed[name] = rows
            continue
        if model.mode == "view":
            rows.createOrReplaceTempView(name)
        built[name] = rows
        for check in model.checks:
            if broken := check(rows).limit(5).collect():
                failed[name] = broken
                break
    stopped = {n: rows for n, rows in failed.items() if not plan[n].warns}
    if stopped:
        raise ChecksFailed("; ".join(f"{n}: {rows}" for n, rows in stopped.items()), stopped, skipped if only is None else [], built)
    return built


def _build(store: Store, model: Model, built: dict[str, DataFrame], full: bool) -> DataFrame | list:
    """The model's table after the run, or the rows by which its guard stops it."""
    name, since = model.name, None
    inputs = {n: built[n] for n in model.needs if n in built}
    resumed = incremental(model) and store.exists(name) and (not full or model.protected)
    if resumed:
        at = store.checkpoint(name, model.checkpoint) if model.checkpoint else None
        since = F.lit(at) if at is not None else None
        if model.mode == "history":
            inputs[name] = store.read_open(name)
        elif model.mode == "merge" or model.sees_itself:
            inputs[name] = store.read(name)
        if since is not None and model.restart is not None and not model.restart(inputs, since).isEmpty():
            resumed, since = False, None
        if since is not None:
            inputs |= {n: _since(store, n, built[n], F.date_sub(F.to_date(since), days)) for n, days in model.recent.items()}
    rows = model.build(inputs, since)
    if model.mode == "view":
        return rows
    if model.guard is not None:  # judged before anything is stored
        rows = written_once(rows, "guarded")
        every = store.read(name).unionByName(rows) if resumed else rows
        if broken := model.guard(inputs, every).limit(5).collect():
            return broken
    buckets = (list(model.buckets), int(store.spark.conf.get("spark.sql.shuffle.partitions"))) if model.buckets else None
    if model.mode == "history":
        store.carry(name, rows, model.still_open, model.partition_by, model.sort_by, full=not resumed, buckets=buckets)
    elif model.mode == "merge" and resumed:
        store.merge(name, store.dealt(rows, model.by_day)[0], list(model.keys), model.sort_by, model.within)
    elif model.mode == "append" and resumed:
        store.append(name, rows, model.partition_by, model.sort_by, by_day=model.by_day)
    elif model.mode == "days" and since is not None:
        last = store.checkpoint(name, F.to_date(model.checkpoint))
        store.replace_days(name, rows, last - timedelta(days=model.days_again), model.by_day, model.sort_by)
    else:
        store.replace(name, rows, model.partition_by, model.sort_by, by_day=model.by_day, buckets=buckets)
    declared = {"primary_key": ", ".join(model.primary_key)} if model.primary_key else {}
    declared |= {f"foreign_key.{k.column}": f"{k.entity}.{k.other_column}" for k in model.foreign_keys}
    store.describe(name, model.description, {**model.labels, **declared})
    if model.first_day is not None:
        store.drop_days(name, _day(store.spark, model.first_day))
    if model.retain is not None:
        store.expire(name, model.retain, model.sort_by)
    return store.read(name)


def _since(store: Store, name: str, rows: DataFrame, day: Column) -> DataFrame:
    """An input from a day on: of a table of the store only the folders of that day and later."""
    return store.read(name, day) if store.exists(name) else rows.where(F.to_date("occurred_at") >= day)


def _day(spark: SparkSession, day: Column) -> date:
    return spark.range(1).select(F.to_date(day)).first()[0]
