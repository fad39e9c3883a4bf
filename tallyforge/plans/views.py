"""Published views over one commit of the tables, and named metrics on top of them: built in, or .sql files of a folder."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.metrics import METRICS, metric_query
from tallyforge.plans.scripts import SqlExecutionError, bound, ordered, split_statements, sql_files
from tallyforge.schemas import DQ, WAREHOUSE
from tallyforge.sources.commits import Commit
from tallyforge.sources.storage import Warehouse
from tallyforge.sources.window import latest_succeeded


def of_latest_run(rows: DataFrame, ledger: DataFrame, column: str) -> DataFrame:
    """Rows whose run (in `column`) is the one that succeeded last; none if no run has."""
    latest = latest_succeeded(ledger).select(F.col("run_id").alias(column))
    return rows.join(F.broadcast(latest), column, "left_semi").select(*rows.columns)  # one row


def view_frames(tables: dict[str, DataFrame], dq: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """The six views. The *_latest names of facts are older names of *_current: facts are not filtered by run."""
    orders, items = tables["fact_orders"], tables["fact_order_items"]
    return {
        "v_dim_customer_latest": of_latest_run(tables["dim_customer"], ledger, "source_run_id"),
        "v_fact_orders_current": orders,
        "v_fact_order_items_current": items,
        "v_fact_orders_latest": orders,
        "v_fact_order_items_latest": items,
        "v_dq_results_latest": of_latest_run(dq, ledger, "run_id"),
    }


@dataclass(frozen=True)
class PublishResult:
    views: tuple[str, ...]
    metrics: tuple[str, ...]


@dataclass(frozen=True)
class MetricQueryResult:
    """rows is a DataFrame, so nothing is cut off and nothing comes to the driver unasked."""

    name: str
    columns: tuple[str, ...]
    rows: DataFrame


def relations(spark: SparkSession, store: Warehouse, commit: Commit | None = None) -> dict[str, DataFrame]:
    """Tables, ledger and views, all as of one commit (the latest). Before a commit is made, its run counts as succeeded."""
    commit = commit or store.log.latest()
    tables = {t: spark.createDataFrame([], ddl) for t, ddl in WAREHOUSE.items()} | store.current(commit)
    some = any(n.startswith("run_id=") for n in store.files.names("dq_results"))
    dq = spark.read.schema(DQ).option("basePath", f"{store.root}/dq_results").parquet(f"{store.root}/dq_results/run_id=*") if some else spark.createDataFrame([], DQ)
    ledger = store.ledger(commit)
    return tables | {"dq_results": dq, "run_ledger": ledger} | view_frames(tables, dq, ledger)


def published(spark: SparkSession, store: Warehouse) -> dict[str, DataFrame]:
    """The six views of the latest commit."""
    return {n: df for n, df in relations(spark, store).items() if n.startswith("v_")}


def _define(spark: SparkSession, frames: dict[str, DataFrame], sql_dir: str | Path | None, args: dict | None) -> tuple[str, ...]:
    """Register frames, then the folder's views by their files' names, each after those it needs; names of all views."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    own = _queries(sql_dir) if sql_dir else {}
    for wanted in own:
        for name in ordered(own, wanted):
            _one(spark, own[name], str(sql_dir), args).createOrReplaceTempView(name)
    return (*(n for n in frames if n.startswith("v_")), *own)


def _queries(folder: str | Path) -> dict[str, str]:
    """One query a file. More than one statement in a file is an error."""
    out = {}
    for name, path in sql_files(folder).items():
        statements = split_statements(path.read_text(encoding="utf-8"))
        if len(statements) != 1:
            raise ValueError(f"{path}: {len(statements)} statements, where one query is wanted")
        out[name] = statements[0]
    return out


def _one(spark: SparkSession, query: str, source: str, args: dict | None) -> DataFrame:
    try:
        return bound(spark, query, args)
    except Exception as e:
        raise SqlExecutionError(source, 1, query, e) from e


def check_views(spark: SparkSession, store: Warehouse, commit: Commit, sql_dir: str | Path | None = None, args: dict | None = None) -> None:
    """Define all views of a commit that is about to be made, in a session of its own: an error before, not after it."""
    inner = spark.newSession()
    inner_store = Warehouse(inner, store.root, store.buckets)
    _define(inner, relations(inner, inner_store, commit), sql_dir, args)


def apply_views(spark: SparkSession, store: Warehouse, sql_dir: str | Path | None = None, metrics_dir: str | Path | None = None, args: dict | None = None) -> PublishResult:
    """Register tables and views in the session, all as of the commit that is the latest now."""
    return PublishResult(_define(spark, relations(spark, store), sql_dir, args), tuple(list_metric_queries(metrics_dir)))


def list_metric_queries(metrics_dir: str | Path | None = None) -> list[str]:
    """Names of the built-in metrics and of the folder's; a file of a built-in name takes its place."""
    return sorted({*METRICS, *(sql_files(metrics_dir) if metrics_dir else ())})


def run_metric_query(spark: SparkSession, store: Warehouse, name: str, metrics_dir: str | Path | None = None, args: dict | None = None, sql_dir: str | Path | None = None) -> MetricQueryResult:
    """One metric over the latest commit. A file's query may read tables, views and other metrics of the folder, by name."""
    key = name.removesuffix(".sql")
    own = _queries(metrics_dir) if metrics_dir else {}
    if key not in own:
        if key not in METRICS:
            raise FileNotFoundError(f"no metric {name!r}; there are: {', '.join(list_metric_queries(metrics_dir))}")
        views = published(spark, store)
        rows = metric_query(key, views["v_fact_orders_latest"], views["v_fact_order_items_latest"])
        return MetricQueryResult(key, tuple(rows.columns), rows)
    inner = spark.newSession()
    _define(inner, relations(inner, Warehouse(inner, store.root, store.buckets)), sql_dir, args)
    for n in ordered(own, key):
        rows = _one(inner, own[n], f"{metrics_dir}/{n}.sql", args)
        rows.createOrReplaceTempView(n)
    return MetricQueryResult(key, tuple(rows.columns), rows)
