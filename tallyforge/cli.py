"""Command line: run (snapshot, live or incremental), db init, views, metric NAME, events."""

from __future__ import annotations

import argparse
import csv
import sys
from datetime import datetime

from tallyforge.operators.warehouse import STEPS
from tallyforge.plans.views import apply_views, run_metric_query
from tallyforge.run import RunSpec, run_pipeline
from tallyforge.session import get_session, warehouse_root
from tallyforge.sources.events import read_events
from tallyforge.sources.storage import Warehouse
from tallyforge.sources.window import DEFAULT_OVERLAP, parse_overlap


def overlap(text: str):
    try:
        return parse_overlap(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge")
    p.add_argument("--warehouse", help="folder or URI of the tables; else the environment's WAREHOUSE_ROOT")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="one run from extract to publish")
    r.add_argument("--mode", choices=("snapshot", "live", "incremental"), default="snapshot")
    r.add_argument("--snapshot", dest="snapshot_key", default="v1", help="name of a snapshot (snapshot mode)")
    r.add_argument("--snapshot-root", help="folder of a snapshot, in the place of the source in any mode")
    r.add_argument("--runs-root", default="runs")
    r.add_argument("--page-size", type=int, default=100)
    r.add_argument("--watermark-column", default="order_ts")
    r.add_argument("--since", type=datetime.fromisoformat)
    r.add_argument("--until", type=datetime.fromisoformat)
    r.add_argument("--source", default="dummyjson", help="source system: dummyjson or square_orders")
    r.add_argument("--step", choices=tuple(STEPS), default="build_all", help="what to build")
    r.add_argument("--views-dir", help="a folder of .sql files, each a further view")
    r.add_argument("--no-views", action="store_true", help="do not define the views")
    r.add_argument("--no-resume", action="store_true", help="begin a new window even if an earlier pull did not end")
    r.add_argument("--overlap", type=overlap, default=DEFAULT_OVERLAP, help="7d, 12h, 30m or a mix of them")
    db = sub.add_parser("db", help="the tables").add_subparsers(dest="action", required=True)
    db.add_parser("init", help="make empty typed tables where there are none").add_argument("--sql", help="a script to run after that")
    v = sub.add_parser("views", help="register and list the published views")
    v.add_argument("--sql-dir", help="a folder of .sql files, each a further view")
    e = sub.add_parser("events", help="events of runs")
    e.add_argument("--runs-root", default="runs")
    e.add_argument("--run", default="*")
    m = sub.add_parser("metric", help="one metric, whole")
    m.add_argument("name")
    m.add_argument("--metrics-dir", help="a folder of .sql files, each a metric")
    m.add_argument("--sql-dir", help="a folder of .sql files, each a view that metrics may use")
    m.add_argument("--arg", action="append", default=[], metavar="NAME=VALUE", help="a parameter of the query")
    m.add_argument("--output", help="a folder for CSV files; else the rows go to standard output, one by one")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    root = warehouse_root(a.warehouse)
    spark = get_session()
    store = Warehouse(spark, root)
    if a.command == "db":
        print("\n".join(store.initialize()))
        if a.sql:
            from tallyforge.plans.scripts import run_file

            run_file(spark, a.sql)
        return 0
    if a.command == "views":
        print("\n".join(apply_views(spark, store, a.sql_dir).views))
        return 0
    if a.command == "metric":
        given = dict(x.split("=", 1) for x in a.arg)
        try:
            got = run_metric_query(spark, store, a.name, a.metrics_dir, given, a.sql_dir)
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 2
        if a.output:
            got.rows.write.option("header", True).csv(a.output)
            return 0
        out = csv.writer(sys.stdout)
        out.writerow(got.columns)
        for row in got.rows.toLocalIterator():
            out.writerow(row)
        return 0
    if a.command == "events":
        for e in read_events(spark, a.runs_root, a.run).orderBy("at", "run_id", "seq").toLocalIterator():
            print(*(x for x in (e["at"], e["run_id"], e["kind"], e["phase"], e["seconds"], e["message"]) if x is not None))
        return 0
    m = run_pipeline(spark, root, RunSpec(a.mode, a.snapshot_root, a.runs_root, a.since, a.until, a.overlap, a.source, a.snapshot_key, a.page_size, a.watermark_column, a.step, not a.no_views, a.views_dir, resume=not a.no_resume))
    print(f"run_id={m.run_id} status={m.status} mode={m.mode} manifest={m.artifacts['manifest']} {m.error or ''}".rstrip())
    if m.window:
        print(f"  window: {m.window['low']} to {m.window['high']} ({m.source.get('carts_post_filter', '?')}/{m.source.get('carts_pre_filter', '?')} carts)")
    return 0 if m.status == "succeeded" else 1


if __name__ == "__main__":
    raise SystemExit(main())
