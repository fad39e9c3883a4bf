import json
import os
import threading
from datetime import datetime, timedelta

import pytest

from shop import bundle, cart, serving

from tallyforge import cli
from tallyforge.plans import scripts
from tallyforge.plans.views import apply_views, run_metric_query
from tallyforge.run import RunSpec, run_pipeline, run_table_dq
from tallyforge.sources import adapters, snapshot
from tallyforge.sources.events import read_events
from tallyforge.sources.storage import Warehouse
from tallyforge.sources.window import parse_overlap


def kinds(spark, root, m):
    return [(r.kind, r.phase) for r in read_events(spark, root, m.run_id).orderBy("seq").collect()]


def statuses(store):
    return {r.run_id: r.status for r in store.ledger().collect()}


def test_runs(spark, tmp_path):
    b, snap, root, rr = bundle(), tmp_path / "snap", tmp_path / "wh", f"file://{tmp_path}/runs"
    spec = dict(snapshot_root=str(snap), runs_root=rr)
    snapshot.write_snapshot(spark, b, snap)
    first = run_pipeline(spark, root, RunSpec("snapshot", **spec))
    assert first.status == "succeeded", first.error
    store = Warehouse(spark, root)
    assert store.current()["fact_orders"].count() == 1 and statuses(store) == {first.run_id: "succeeded"}
    assert first.transform == {"step": "build_all", "tables": ["dim_customer", "dim_date", "fact_orders", "fact_order_items"]} and first.published["commit"] == 0
    assert os.listdir(tmp_path / "runs" / first.run_id / "events") and json.load(open(tmp_path / "runs" / first.run_id / "manifest.json"))["status"] == "succeeded"

    # a failed gate leaves the published version as it is
    b["carts"].append(cart(105, 1.0, 77))
    snapshot.write_snapshot(spark, b, snap)
    failed = run_pipeline(spark, root, RunSpec("snapshot", **spec))
    log = kinds(spark, rr, failed)
    assert log[0] == ("run started", None) and ("phase finished", "gate") in log and log[-1] == ("run finished", None)
    assert failed.status == "failed" and "missing_customers" in failed.error
    assert store.log.latest().number == 0 and statuses(store)[failed.run_id] == "failed"

    # incremental: needs a mark or a start, then carries on from the mark
    assert "No prior" in run_pipeline(spark, root, RunSpec("incremental", **spec)).error
    b["carts"] = [cart(20, 5.0), cart(350, 10.0)]
    snapshot.write_snapshot(spark, b, snap)
    one = run_pipeline(spark, root, RunSpec("incremental", since=datetime(2024, 1, 1), **spec))
    assert one.status == "succeeded", one.error
    before = store.log.latest().tables["fact_orders"].parts
    b["carts"] = [cart(20, 6.0), cart(350, 12.0)]
    snapshot.write_snapshot(spark, b, snap)
    two = run_pipeline(spark, root, RunSpec("incremental", overlap=timedelta(days=30), **spec))
    assert two.status == "succeeded", two.error
    facts = {r.order_id: (str(r.total_usd), r.source_run_id) for r in store.current()["fact_orders"].collect()}
    assert facts == {57: ("30.00", first.run_id), 20: ("5.00", one.run_id), 350: ("12.00", two.run_id)}
    assert two.counts["carts_pre_filter"] == 2 and two.counts["stg_orders"] == 1
    # only the bucket of the order that came again has new files
    after = store.log.latest().tables["fact_orders"].parts
    assert sum(before[k] != after[k] for k in before) == 1 and before.keys() == after.keys()
    assert store.vacuum(1) and store.current()["fact_orders"].count() == 3


def test_live_run_pages_the_source(spark, tmp_path):
    b = bundle()
    b["carts"] += [cart(105, 5.0), cart(105, 7.0)]
    root, rr = tmp_path / "wh", str(tmp_path / "runs")
    store = Warehouse(spark, root)
    assert "dim_date" in store.initialize() and store.current()["fact_orders"].count() == 0
    with serving(b) as (url, asked):
        shop = adapters.ShopSource(url, interval_s=0)
        m = run_pipeline(spark, root, RunSpec("live", runs_root=rr, page_size=2), adapter=shop)
        # a repeated cart is a repeated key: more rejects than a live run may have
        assert m.status == "failed" and "reject_rate" in m.error and m.rejects["stg_orders"] == {"loaded": 2, "duplicates": 1, "rejected": 0}
        b["carts"].pop()
        asked.clear()
        m = run_pipeline(spark, root, RunSpec("live", runs_root=rr, page_size=1), adapter=shop)
        assert m.status == "succeeded", m.error
        assert asked.count("/carts?limit=1&skip=1") == 1 and m.source["records"]["carts"] == 2  # each page once, but for the first
        assert apply_views(spark, store).views == m.published["views"]
        assert {t: spark.table(t).count() for t in m.published["views"]} == {"v_dim_customer_latest": 1, "v_fact_orders_current": 2, "v_fact_order_items_current": 2, "v_fact_orders_latest": 2, "v_fact_order_items_latest": 2, "v_dq_results_latest": 19}
        assert run_metric_query(spark, store, "030_paid_vs_refunded_counts").rows.collect()[0].paid_orders == 2
        with pytest.raises(FileNotFoundError):
            run_metric_query(spark, store, "nothing")
        assert run_table_dq(store, m.run_id, "stg_orders") == {"table_name": "stg_orders", "metrics_written": 5, "failed_metrics": 0, "passed": True}
        assert store.run_rows("dq_results", m.run_id).count() == 19
        for run, table in (("none", "stg_orders"), (m.run_id, "other")):
            with pytest.raises(ValueError):
                run_table_dq(store, run, table)
        inc = run_pipeline(spark, root, RunSpec("incremental", runs_root=rr, since=datetime(2024, 2, 27), until=datetime(2024, 2, 28)), adapter=shop)
        assert inc.status == "succeeded" and (inc.source["carts_pre_filter"], inc.source["carts_post_filter"]) == (2, 1), inc.error
        wrong = run_pipeline(spark, root, RunSpec("incremental", runs_root=rr, watermark_column="x", since=datetime(2024, 4, 14)), adapter=shop)
        assert wrong.status == "failed" and "order_ts" in wrong.error
        assert run_pipeline(spark, root, RunSpec("other", runs_root=rr), adapter=shop).status == "failed"
        b["users"][0]["lastName"] = " "
        m = run_pipeline(spark, root, RunSpec("live", runs_root=rr), adapter=shop)
        assert m.status == "failed" and "invalid" in m.error
    with pytest.raises(ValueError):
        adapters.get_source_adapter("other")


def test_failing_views_fail_the_run(spark, tmp_path):
    snapshot.write_snapshot(spark, bundle(), tmp_path / "snap")
    (tmp_path / "views").mkdir()
    (tmp_path / "views" / "v_wrong.sql").write_text("SELECT nothing FROM fact_orders")
    spec = dict(snapshot_root=str(tmp_path / "snap"), runs_root=str(tmp_path / "runs"))
    store = Warehouse(spark, tmp_path / "wh")
    bad = run_pipeline(spark, tmp_path / "wh", RunSpec("snapshot", views_dir=str(tmp_path / "views"), **spec))
    assert bad.status == "failed" and "nothing" in bad.error and store.log.latest().number == -1
    assert statuses(store) == {bad.run_id: "failed"} and store.latest_run() is None and json.load(open(bad.artifacts["manifest"]))["status"] == "failed"
    (tmp_path / "views" / "v_wrong.sql").write_text("SELECT country, n FROM v_more")
    (tmp_path / "views" / "v_more.sql").write_text("SELECT country, count(*) AS n FROM v_fact_orders_current GROUP BY country")
    good = run_pipeline(spark, tmp_path / "wh", RunSpec("snapshot", views_dir=str(tmp_path / "views"), **spec))
    assert good.status == "succeeded" and "v_more" in good.published["views"], good.error
    assert tuple(spark.table("v_wrong").first()) == ("Portugal", 1) and store.latest_run() == good.run_id
    quiet = run_pipeline(spark, tmp_path / "wh", RunSpec("snapshot", publish_views=False, transform_step="build_dims", **spec))
    assert quiet.status == "succeeded" and quiet.published == {"commit": 1} and quiet.transform["tables"] == ["dim_customer", "dim_date"]


def test_runs_that_overtake_each_other(spark, tmp_path):
    """Two incremental runs publish at once: both see the same state before either commits."""
    root, store = tmp_path / "wh", Warehouse(spark, tmp_path / "wh")
    store.initialize()
    meet, errors, out = threading.Barrier(2, timeout=120), [], []
    plain = Warehouse.publish

    def publish(self, run, build, check=None, attempts=5):
        calls = []

        def together(base):
            calls.append(base.number)
            made = build(base)
            if len(calls) == 1:
                meet.wait()
            return made

        return plain(self, run, together, check, attempts)

    def one(k, order):
        try:
            b = bundle()
            b["carts"] = [cart(order, float(k)), cart(300, float(10 * k))]
            snapshot.write_snapshot(spark, b, tmp_path / f"snap{k}")
            out.append(run_pipeline(spark, root, RunSpec("incremental", str(tmp_path / f"snap{k}"), str(tmp_path / "runs"), since=datetime(2024, 1, 1), publish_views=False)))
        except BaseException as e:
            errors.append(e)

    Warehouse.publish = publish
    try:
        threads = [threading.Thread(target=one, args=x) for x in ((1, 11), (2, 12))]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        Warehouse.publish = plain
    assert not errors and [m.status for m in out] == ["succeeded"] * 2, [m.error for m in out]
    commits = [store.log.read(n) for n in store.log.numbers()]
    assert len(commits) == 3 and {c.run["run_id"] for c in commits[1:]} == {m.run_id for m in out}
    last = commits[-1].run["run_id"]
    facts = {r.order_id: r.source_run_id for r in store.current()["fact_orders"].collect()}
    assert set(facts) == {11, 12, 300} and facts[300] == last  # none is lost; the later commit has the shared order
    assert store.current()["fact_order_items"].count() == 3 and set(statuses(store).values()) == {"succeeded"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    snapshot.write_snapshot(spark, bundle(), tmp_path / "snap")
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    at, rr = ["--warehouse", str(tmp_path / "wh")], ["--runs-root", str(tmp_path / "runs")]
    assert cli.main([*at, "db", "init"]) == 0 and "fact_orders" in capsys.readouterr().out
    assert cli.main([*at, "run", "--snapshot-root", str(tmp_path / "snap"), *rr]) == 0
    assert "status=succeeded" in capsys.readouterr().out
    assert cli.main([*at, "metric", "010_revenue_by_day_country"]) == 0
    assert capsys.readouterr().out.splitlines() == ["day,country,paid_revenue_usd,paid_orders", "2024-02-27,Portugal,30.00,1"]
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "over.sql").write_text("SELECT order_id, note FROM base CROSS JOIN (SELECT :note AS note) WHERE total_usd > CAST(:least AS INT)")
    (tmp_path / "own" / "base.sql").write_text("SELECT * FROM fact_orders -- not over")
    assert cli.main([*at, "metric", "over", "--metrics-dir", str(tmp_path / "own"), "--arg", "least=20", "--arg", "note=a=b"]) == 0
    assert capsys.readouterr().out.splitlines() == ["order_id,note", "57,a=b"]
    assert cli.main([*at, "metric", "none", "--metrics-dir", str(tmp_path / "own")]) == 2
    assert "010_revenue_by_day_country" in (err := capsys.readouterr().err) and "over" in err
    (tmp_path / "own" / "base.sql").write_text("SELECT * FROM over")
    with pytest.raises(ValueError, match="base -> over -> base"):
        run_metric_query(spark, Warehouse(spark, tmp_path / "wh"), "base", tmp_path / "own")
    assert cli.main([*at, "run", "--snapshot", "none", *rr]) == 1
    assert cli.main([*at, "views"]) == 0
    capsys.readouterr()
    assert cli.main([*at, "events", *rr]) == 0 and "transform_publish" in capsys.readouterr().out


def order(k, **more):
    usd = lambda n: {"amount": n, "currency": "USD"}
    items = [{"uid": "a", "name": "Tea pot", "quantity": "2", "catalog_object_id": "T1", "base_price_money": usd(1250), "gross_sales_money": usd(2500), "total_discount_money": usd(500)}]
    return {"id": f"ord-{k}", "customer_id": "c-1", "state": "COMPLETED", "created_at": f"2024-03-0{k}T10:00:00Z", "total_money": usd(2000), "line_items": items} | more


def test_search_orders_from_pull_to_facts(spark, tmp_path):
    pages = [[order(1), order(2, state="OPEN", customer_id=None, tenders=[{"amount_money": {"amount": 500}}])], [order(3, refunds=[{"amount_money": {"amount": 100}}]), order(4, state="CANCELED", line_items=[])]]
    asked, broken = [], [1]

    def post(url, body, headers):
        k = int(body.get("cursor", 0))
        asked.append(k)
        if k in broken:
            raise ConnectionError("gone")
        return {"orders": pages[k]} | ({"cursor": str(k + 1)} if k + 1 < len(pages) else {})

    source = adapters.OrderSearchSource("t", ("a",), post=post)
    root = tmp_path / "wh"
    spec = dict(runs_root=str(tmp_path / "runs"), source_system="square_orders", watermark_column="updated_at", page_size=2)
    cut = run_pipeline(spark, root, RunSpec("incremental", since=datetime(2024, 3, 1), **spec), adapter=source)
    store = Warehouse(spark, root)
    assert cut.status == "failed" and json.loads(store.ledger().first().cursor_state_json)["next"] == "1"
    broken.clear()
    asked.clear()
    m = run_pipeline(spark, root, RunSpec("incremental", **spec), adapter=source)
    assert m.status == "succeeded", m.error
    assert asked == [1] and m.window["high"] == cut.window["high"] and m.source["pages_of_earlier_pulls"] == 1
    facts = sorted((str(r.order_ts), r.status, str(r.total_usd)) for r in store.current()["fact_orders"].collect())
    assert facts == [("2024-03-01 10:00:00", "paid", "20.00"), ("2024-03-02 10:00:00", "pending", "20.00"), ("2024-03-03 10:00:00", "refunded", "20.00"), ("2024-03-04 10:00:00", "canceled", "20.00")]
    items = store.current()["fact_order_items"].collect()
    assert [(r.qty, str(r.unit_price_usd), str(r.gross_usd), str(r.net_usd)) for r in items] == [(2, "12.50", "25.00", "20.00")] * 3
    assert sorted(r.full_name for r in store.current()["dim_customer"].collect()) == ["customer c-1", "guest"]
    # the next window begins at the mark of this one
    later = run_pipeline(spark, root, RunSpec("incremental", overlap=timedelta(0), **spec), adapter=source)
    assert later.status == "succeeded" and later.window["low"] == m.window["high"], later.error
    # faults are rejected, and too many of them close the gate
    usd = pages[0][0]["line_items"][0]
    pages[:] = [[order(5, total_money={"amount": 1, "currency": "EUR"}), order(6, line_items=[usd | {"quantity": "0.5"}, usd | {"quantity": "x"}, usd | {"name": " ", "catalog_object_id": None}, usd]), order(7, id=" "), order(8, created_at=None)]]
    bad = run_pipeline(spark, root, RunSpec("incremental", overlap=timedelta(0), **spec), adapter=source)
    got = {(r.table_name, r.reason_code) for r in store.run_rows("reject_rows", bad.run_id).collect()}
    assert bad.status == "failed" and got == {("stg_orders", "unsupported_currency"), ("stg_orders", "missing_order_id"), ("stg_orders", "missing_order_time"), ("stg_order_items", "rejected_order"), ("stg_order_items", "fractional_quantity"), ("stg_order_items", "invalid_quantity"), ("stg_order_items", "unknown_product")}


def test_scripts(spark, tmp_path):
    text = "-- one; two\nSELECT ';' AS a, 'it''s' AS b;\n/* x; */ ;\nSELECT :run_id AS r"
    assert len(scripts.split_statements(text)) == 2
    got = scripts.run_text(spark, text, args={"run_id": "r1"})
    assert tuple(got[0].first()) == (";", "its") or tuple(got[0].first()) == (";", "it's")
    assert got[1].first().r == "r1"
    (tmp_path / "b.sql").write_text("SELECT 1")
    (tmp_path / "a.sql").write_text("SELECT 2")
    assert scripts.run_folder(spark, tmp_path) == ["a.sql", "b.sql"]
    (tmp_path / "c.sql").write_text("SELECT 1; SELECT nothing FROM nowhere")
    with pytest.raises(scripts.SqlExecutionError) as e:
        scripts.run_file(spark, tmp_path / "c.sql")
    assert e.value.index == 2 and "nowhere" in e.value.statement
    with pytest.raises(FileNotFoundError):
        scripts.run_folder(spark, tmp_path / "none")


def test_scripts_run_whole_or_not_at_all(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shop LOCATION 'file://{tmp_path}/db'")
    try:
        spark.sql("USE shop")
        scripts.run_text(spark, "CREATE TABLE t USING parquet AS SELECT 1 AS x; INSERT INTO t VALUES (2); CREATE TEMPORARY VIEW seen AS SELECT * FROM range(3)")
        rows = lambda t: sorted(r[0] for r in spark.table(t).collect())
        assert rows("t") == [1, 2] and rows("seen") == [0, 1, 2]
        tables = lambda: sorted(t.name for t in spark.catalog.listTables("shop") if not t.isTemporary)
        databases = len(spark.catalog.listDatabases())
        bad = "CREATE TABLE u USING parquet AS SELECT x + 1 AS x FROM t; INSERT INTO t SELECT x FROM u; SELECT nothing FROM t; DROP TABLE t"
        with pytest.raises(scripts.SqlExecutionError) as e:
            scripts.run_text(spark, bad)
        assert e.value.index == 3 and rows("t") == [1, 2] and tables() == ["t"] and len(spark.catalog.listDatabases()) == databases
        with pytest.raises(scripts.SqlExecutionError):
            scripts.run_text(spark, "DROP TABLE t; CREATE TEMPORARY VIEW lost AS SELECT 1; SELECT 1 FROM t")
        assert rows("t") == [1, 2] and not spark.catalog.tableExists("lost")
        scripts.run_text(spark, bad.replace("nothing", "x").replace("DROP TABLE t", "CREATE TABLE IF NOT EXISTS t (y INT) USING parquet"))
        assert rows("t") == [1, 2, 2, 3] and rows("u") == [2, 3]
        with pytest.raises(scripts.SqlExecutionError, match="there already"):
            scripts.run_text(spark, "CREATE TABLE u (z INT) USING parquet")
        scripts.run_text(spark, "DROP TABLE u; INSERT OVERWRITE t SELECT 9; SELECT x FROM seen JOIN t ON x > id")
        assert tables() == ["t"] and rows("t") == [9]
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE shop CASCADE")


@pytest.mark.parametrize("text,seconds", [("7D", 604800), (" 2d6h30m ", 196200), ("90m", 5400), ("0h", 0)])
def test_overlaps(text, seconds):
    assert parse_overlap(text).total_seconds() == seconds


@pytest.mark.parametrize("text", ["", "7", "d", "1h2d", "1d1d", "1w", "-1d", "1.5d"])
def test_wrong_overlaps(text):
    with pytest.raises(ValueError):
        parse_overlap(text)
