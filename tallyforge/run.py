"""One run: ledger, extract, stage, quality, gate, transform and publish, with a manifest and an event log whatever happens."""

from __future__ import annotations

import subprocess
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import gates, quality, staging, warehouse
from tallyforge.operators.mappings import mappings
from tallyforge.plans.views import apply_views, check_views
from tallyforge.schemas import STAGED, staging_spec
from tallyforge.sources.adapters import PullResult, SnapshotSource, SourceAdapter, get_source_adapter
from tallyforge.sources.commits import Commit
from tallyforge.sources.events import EventLog
from tallyforge.sources.files import Files
from tallyforge.sources.landing import Landing, open_window
from tallyforge.sources.snapshot import snapshot_root_for_key
from tallyforge.sources.storage import Change, Warehouse, as_json
from tallyforge.sources.window import DEFAULT_OVERLAP, ExtractionWindow, resolve_window


class GateFailed(RuntimeError):
    pass


@dataclass(frozen=True)
class RunSpec:
    """snapshot_root, where given, stands in for the source in every mode; snapshot_key names one for snapshot mode.

    transform_step names what is built; publish_views: whether the session gets the views; views_dir: a folder of further views;
    buckets: into how many a new fact table is dealt; resume: an incremental run goes on with a pull that did not end."""

    mode: str = "snapshot"
    snapshot_root: str | None = None
    runs_root: str = "runs"
    since: datetime | None = None
    until: datetime | None = None
    overlap: timedelta = DEFAULT_OVERLAP
    source_system: str = "dummyjson"
    snapshot_key: str | None = "v1"
    page_size: int = 100
    watermark_column: str = "order_ts"
    transform_step: str = "build_all"
    publish_views: bool = True
    views_dir: str | None = None
    buckets: int = 16
    resume: bool = True

    def resolved_snapshot_root(self) -> str | None:
        if self.snapshot_root:
            return str(self.snapshot_root)
        return snapshot_root_for_key(self.snapshot_key or "v1") if self.mode == "snapshot" else None

    def arguments(self) -> dict:
        return {"page_size": self.page_size, "since": self.since, "until": self.until, "overlap_s": self.overlap.total_seconds(), "snapshot_root": self.resolved_snapshot_root(), "runs_root": str(self.runs_root), "transform_step": self.transform_step, "publish_views": self.publish_views}


@dataclass
class RunManifest:
    run_id: str
    mode: str
    status: str = "running"
    error: str | None = None
    window: dict | None = None
    source: dict = field(default_factory=dict)
    counts: dict = field(default_factory=dict)
    rejects: dict = field(default_factory=dict)
    dq: dict = field(default_factory=dict)
    gate: dict = field(default_factory=dict)
    transform: dict = field(default_factory=dict)
    published: dict = field(default_factory=dict)
    seconds: dict = field(default_factory=dict)
    artifacts: dict = field(default_factory=dict)


def adapter_of(spec: RunSpec) -> SourceAdapter:
    root = spec.resolved_snapshot_root()
    return SnapshotSource(root) if root else get_source_adapter(spec.source_system)


def git_sha() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=5).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def load_batches(store: Warehouse, run_id: str, pulled: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame, dict[str, dict[str, int]]]:
    """(staged tables, rejects, counts by table and branch) of pulled records.

    Each table is mapped, split into first rows, repeats and rejects and written in one pass, in which its rows are counted too;
    what is staged already serves as the lookup of what comes next.
    """
    staged: dict[str, DataFrame] = {}
    splits: dict[str, dict[str, DataFrame]] = {}
    counts: dict[str, dict[str, int]] = {}

    def load(table: str, tagged: DataFrame) -> None:
        splits[table], counts[table] = store.stage_split(table, staging.branches(tagged, STAGED[table]), run_id)
        staged[table] = splits[table]["first"].select(*STAGED[table].names)

    for table, make in mappings(pulled):
        load(table, make(staged))
    rejects = [staging.rejects_of(s, t) for t, s in splits.items()]
    every = rejects[0]
    for r in rejects[1:]:
        every = every.unionByName(r)
    at = F.lit(datetime.now(timezone.utc)).cast("timestamp")
    return staged, store.stage("reject_rows", every.withColumns({"run_id": F.lit(run_id), "rejected_at": at}), run_id), counts


def run_table_dq(store: Warehouse, run_id: str, table: str) -> dict:
    """Measure one staged table of a run again and replace its stored metrics; their summary."""
    staging_spec(table)
    staged = {t: store.run_rows(t, run_id) for t in STAGED}
    rows = quality.table_dq(staged, store.run_rows("reject_rows", run_id), table).withColumns({"run_id": F.lit(run_id), "created_at": F.lit(datetime.now(timezone.utc)).cast("timestamp")})
    fresh = store.stage("work/dq", rows, f"{run_id}-{table}")
    if store.files.exists(f"dq_results/run_id={run_id}"):
        old = store.run_rows("dq_results", run_id).where(F.col("table_name") != table)
        fresh = store.stage("work/dq", old.unionByName(fresh.select(*old.columns)), f"{run_id}-all")
    store.stage("dq_results", fresh, run_id)
    return next(r.asDict() for r in quality.summary(fresh.where(F.col("table_name") == table)).collect())


def run_pipeline(spark: SparkSession, root: str | Path, spec: RunSpec, extract: Callable[[SparkSession], dict[str, DataFrame]] | None = None, adapter: SourceAdapter | None = None, echo: bool = False) -> RunManifest:
    """extract gives users, products and carts with source_ref and raw_payload, in the place of a source.

    Tables, views and the run's success are one commit, made last: if anything fails before, the run failed and the published
    state is the old one. The ledger holds a run from its start, and the manifest and the events are written in any case.
    """
    store, now = Warehouse(spark, root, spec.buckets), lambda: datetime.now(timezone.utc)
    out = RunManifest(str(uuid.uuid4()), spec.mode)
    runs = Files(spark, spec.runs_root)
    log = EventLog(runs, out.run_id, show=echo)
    out.artifacts = {"manifest": runs.path(f"{out.run_id}/manifest.json"), "events": runs.path(log.folder)}
    at = now()
    row = {"run_id": out.run_id, "source_system": spec.source_system, "mode": spec.mode, "snapshot_key": spec.snapshot_key if spec.mode == "snapshot" else None, "started_at": at, "finished_at": None, "status": "running", "git_sha": git_sha(), "args_json": as_json(spec.arguments())}

    def phase(name: str, work: Callable):
        got, out.seconds[name] = log.timed(name, work)
        return got

    def pull(source: SourceAdapter, window: ExtractionWindow | None) -> PullResult:
        if extract:
            return PullResult(extract(spark))

        def noted(state: dict) -> None:
            row["cursor_state_json"] = as_json(state)
            store.record(row)

        landing = Landing(store.files, spec.source_system, window, out.run_id, noted)
        return source.pull_incremental(spark, spec.page_size, window, landing) if window else source.pull_full(spark, spec.page_size, landing)

    def transform() -> Commit:
        def build(base: Commit) -> dict[str, Change]:
            made = warehouse.changes(staged, store.current(base), out.run_id, at, spec.mode, spec.transform_step)
            return {t: Change(rows, how, warehouse.RECONCILE.get(t)) for t, (how, rows) in made.items()}

        done = row | {"status": "succeeded", "finished_at": now()}
        check = (lambda c: check_views(spark, store, c, spec.views_dir)) if spec.publish_views else None
        commit = store.publish(done, build, check)
        out.transform = {"step": spec.transform_step, "tables": list(warehouse.STEPS[spec.transform_step])}
        out.status = "succeeded"
        return commit

    try:
        if spec.mode not in warehouse.MODES:
            raise ValueError(f"unknown mode {spec.mode!r}")
        store.record(row)
        log.add("run started", mode=spec.mode, source=spec.source_system)
        source = adapter or adapter_of(spec)
        window = None
        if spec.mode == "incremental":
            source.validate_watermark_column(spec.watermark_column)
            window = open_window(store.files, spec.source_system, spec.watermark_column) if spec.resume and not (spec.since or spec.until) else None
            if window is None:
                prior = store.prior_watermark(spec.source_system, spec.watermark_column)
                window = resolve_window(spec.watermark_column, prior, at, spec.since, spec.until, spec.overlap, source.default_high_watermark(spec.watermark_column, at))
            row |= {"watermark_column": spec.watermark_column, "watermark_low": window.low, "watermark_high": window.high}
            store.record(row)  # kept even if the run fails later
            out.window = window.meta()
        got = phase("extract", lambda: pull(source, window))
        out.source = got.meta
        out.counts |= {k: v for k, v in got.meta.items() if k.startswith("carts_")}
        staged, rejects, counts = phase("stage_load", lambda: load_batches(store, out.run_id, got.records))
        out.rejects = {t: {"loaded": n["first"], "duplicates": n["repeat"], "rejected": n["reject"]} for t, n in counts.items() if any(n.values())}
        out.counts |= {t: n["first"] for t, n in counts.items()}
        metrics = quality.run_stage_dq(staged, rejects).withColumns({"run_id": F.lit(out.run_id), "created_at": F.lit(now()).cast("timestamp")})
        dq = phase("dq", lambda: store.stage("dq_results", metrics, out.run_id))
        out.dq = {r["table_name"]: {"metrics_written": r["metrics_written"], "failed_metrics": r["failed_metrics"], "passed": r["passed"]} for r in quality.summary(dq).collect()}
        decision = phase("gate", lambda: gates.evaluate_frame(dq, spec.mode))
        out.gate = {"passed": decision.passed, "failures": decision.failures, "warnings": decision.warnings}
        if not decision.passed:
            raise GateFailed("; ".join(decision.failures))
        commit = phase("transform_publish", transform)
        out.published = {"commit": commit.number}
        if spec.publish_views:
            views = apply_views(spark, store, spec.views_dir)
            out.published |= {"views": views.views, "metrics": views.metrics}
    except Exception as e:  # the manifest, the ledger and the log tell what went wrong
        out.error = f"{type(e).__name__}: {e}"
        if out.status != "succeeded":  # after its commit a run has succeeded, whatever the session makes of it
            out.status = "failed"
            if spec.mode in warehouse.MODES:
                store.record(row | {"status": "failed", "finished_at": now(), "error_message": out.error})
    finally:
        log.add("run finished", message=out.error, status=out.status)
        log.flush()
        runs.write(f"{out.run_id}/manifest.json", as_json(out.__dict__))
    return out
