"""Dimensions and facts, and their reconciliation with an earlier version."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.derive import date_parts

MODES = ("snapshot", "live", "incremental")
#: Steps of a run, and the tables each of them builds, in order.
STEPS = {"build_dims": ("dim_customer", "dim_date"), "build_facts": ("fact_orders", "fact_order_items"), "build_all": ("dim_customer", "dim_date", "fact_orders", "fact_order_items")}


def dim_customer(customers: DataFrame, run_id: str, at: datetime) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.coalesce("full_name", F.trim(F.concat(blank("first_name"), F.lit(" "), blank("last_name"))))
    return customers.select("customer_id", "first_name", "last_name", name.alias("full_name"), "email", "phone", "city", "country", "company", F.lit(run_id).alias("source_run_id"), F.lit(at).cast("timestamp").alias("built_at"))


def calendar(orders: DataFrame) -> DataFrame:
    """Every day between the first and the last order, with its attributes; none without order times."""
    ends = orders.agg(F.min("order_ts").cast("date").alias("lo"), F.max("order_ts").cast("date").alias("hi"))
    days = ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"))
    return days.select("date", *(c.alias(n) for n, c in date_parts(F.col("date")).items()))


def append_new(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert, leaving existing keys as they are."""
    return new if old is None else old.unionByName(new.join(old.select(*key), key, "left_anti"))


def upsert(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    return new if old is None else old.join(new.select(*key), key, "left_anti").unionByName(new)


def fact_orders(orders: DataFrame, run_id: str, at: datetime) -> DataFrame:
    return orders.select("order_id", "customer_id", F.col("order_ts").cast("date").alias("date"), "order_ts", "country", "status", "total_usd", F.lit(run_id).alias("source_run_id"), F.lit(at).cast("timestamp").alias("built_at"))


def fact_order_items(items: DataFrame, orders: DataFrame, run_id: str, at: datetime) -> DataFrame:
    """Items with customer and date of this run's orders; null where the order is not staged."""
    o = orders.select("order_id", "customer_id", F.col("order_ts").cast("date").alias("date"))
    return items.join(o, "order_id", "left").select("order_id", "line_id", "customer_id", "date", "product_id", "sku", "qty", "unit_price_usd", "gross_usd", "net_usd", F.lit(run_id).alias("source_run_id"), F.lit(at).cast("timestamp").alias("built_at"))


def reconcile_orders(old: DataFrame | None, new: DataFrame, mode: str) -> DataFrame:
    """Snapshot and live runs replace everything; incremental runs only add and update."""
    _known(mode)
    return upsert(old, new, ["order_id"]) if mode == "incremental" else new


def reconcile_items(old: DataFrame | None, new: DataFrame, mode: str) -> DataFrame:
    """Incremental: all items of an order with at least one staged item are replaced; other orders keep theirs."""
    _known(mode)
    if mode != "incremental" or old is None:
        return new
    return old.join(new.select("order_id").distinct(), "order_id", "left_anti").unionByName(new)


def _known(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")


def changes(staged: dict[str, DataFrame], old: dict[str, DataFrame], run_id: str, at: datetime, mode: str, step: str = "build_all") -> dict[str, tuple[str, DataFrame]]:
    """What a step changes in each of its tables: (how, new rows). replace: they are the table; append: they come to it; merge:
    they replace what the reconciliation of the mode says they replace."""
    _known_step(step)
    _known(mode)
    out: dict[str, tuple[str, DataFrame]] = {}
    orders, items = staged["stg_orders"], staged["stg_order_items"]
    if step != "build_facts":
        out["dim_customer"] = ("replace", dim_customer(staged["stg_customers"], run_id, at))
        days = calendar(orders).withColumn("built_at", F.lit(at).cast("timestamp"))
        known = old.get("dim_date")
        out["dim_date"] = ("append", days if known is None else days.join(known.select("date"), "date", "left_anti"))
    if step != "build_dims":
        how = "merge" if mode == "incremental" else "replace"
        out["fact_orders"] = (how, fact_orders(orders, run_id, at))
        out["fact_order_items"] = (how, fact_order_items(items, orders, run_id, at))
    return out


#: How the old rows of the touched buckets of a merged table and the new ones become one table.
RECONCILE = {"fact_orders": lambda old, new: reconcile_orders(old, new, "incremental"), "fact_order_items": lambda old, new: reconcile_items(old, new, "incremental")}


def _known_step(step: str) -> None:
    if step not in STEPS:
        raise ValueError(f"unknown step {step!r}; known: {', '.join(STEPS)}")
