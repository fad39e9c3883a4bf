from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import gates, mappings, quality, warehouse
from tallyforge.schemas import RECORDS, STAGED

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)


def records(spark, name, rows):
    return spark.createDataFrame(rows, RECORDS[name] + ", source_ref int, raw_payload string")


def staged(spark, carts, products=((10, "Tea", "Groceries", "4.99", "3"),), users=((1, "Ada", "Lovelace"),)):
    u = records(spark, "users", [(str(i), f, l, None, None, None, (None, "UK"), None, k, "{}") for k, (i, f, l) in enumerate(users, 1)])
    p = records(spark, "products", [(str(i), t, c, price, stock, None, None, None, k, "{}") for k, (i, t, c, price, stock) in enumerate(products, 1)])
    c = records(spark, "carts", [(str(i), str(user), "9.98", total, str(len(lines)), "2", [(str(pid), None, str(q), "4.99", "9.98", None, "9.98") for pid, q in lines], k, "{}") for k, (i, user, total, lines) in enumerate(carts, 1)])
    return mappings.stage_all({"users": u, "products": p, "carts": c})


def test_smoke_and_gates(spark):
    tables, rejects = staged(spark, [(104, 1, "9.98", [(10, 2)])])
    assert [t.count() for t in tables.values()] == [1, 1, 1, 1] and rejects.count() == 0
    dq = quality.run_stage_dq(tables, rejects)
    assert dq.count() == 19 and dq.where("not passed").count() == 0
    assert gates.evaluate_frame(dq, "snapshot").passed
    i = tables["stg_order_items"].first()
    assert (i.sku, i.qty, i.discount_pct, i.gross_usd, i.net_usd) == ("SKU-groceries-tea-10", 2, Decimal("0.0000"), Decimal("9.98"), Decimal("9.98"))


def test_rejects_and_positions(spark):
    tables, rejects = staged(spark, [(1, 1, "1", [(10, 0), (99, 1)]), (2, 1, "1", [(99, 0), (10, 1)]), (2, 1, "2", [(10, 1), (10, 1), (10, 5)])])
    got = {(r.reason_code, r.source_ref) for r in rejects.collect()}
    assert got == {("invalid_quantity", 1), ("unknown_product", 2), ("invalid_quantity", 3), ("duplicate_key", 3), ("duplicate_key", 6)}
    # the repeated cart's header is dropped, its further lines stay
    assert sorted((r.order_id, r.line_id) for r in tables["stg_order_items"].collect()) == [(2, 1), (2, 2), (2, 3)]


def test_incremental_items_keep_untouched_orders(spark):
    def facts(rows, run):
        return spark.createDataFrame([(o, i, Decimal(n), run) for o, i, n in rows], "order_id long, line_id int, net_usd decimal(12,2), run string")

    old, new = facts([(10, 1, "5"), (10, 2, "6"), (20, 1, "40")], "r1"), facts([(10, 1, "12")], "r2")
    got = sorted(map(tuple, warehouse.reconcile_items(old, new, "incremental").collect()))
    assert got == [(10, 1, Decimal("12.00"), "r2"), (20, 1, Decimal("40.00"), "r1")]
    assert warehouse.reconcile_items(old, new, "snapshot").count() == 1
    assert warehouse.reconcile_items(old, new.limit(0), "incremental").count() == 3  # touched, but without items: stale ones stay
    with pytest.raises(ValueError):
        warehouse.reconcile_orders(old, new, "other")


@pytest.mark.parametrize("mode,rate,passed,warned", [("snapshot", "0.000001", False, 0), ("live", "0.005000", True, 0), ("live", "0.005001", True, 1), ("incremental", "0.010000", True, 1), ("live", "0.010001", False, 0)])
def test_gate_rates(mode, rate, passed, warned):
    m = {}
    for t in STAGED:
        m |= {(t, "row_count"): 1, (t, "duplicate_keys.count"): 0, (t, "reject_rows.reject_rate"): Decimal(0)}
        m |= {(t, x): 0 for x in gates.RELATIONS.get(t, ())}
    m["stg_orders", "reject_rows.reject_rate"] = Decimal(rate)
    d = gates.evaluate(m, mode)
    assert d.passed == passed and len(d.warnings) == warned
    with pytest.raises(ValueError):
        gates.evaluate({}, mode)


def test_calendar_of_null_times_is_empty(spark):
    assert warehouse.calendar(spark.createDataFrame([(None,)], "order_ts timestamp")).count() == 0
    assert warehouse.calendar(spark.range(1).select(F.lit("2024-04-14").cast("timestamp").alias("order_ts"))).first().week_start.isoformat() == "2024-04-08"
