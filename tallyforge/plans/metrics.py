"""Published metrics over the current facts. Order by null position is always explicit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _paid(orders: DataFrame) -> DataFrame:
    return orders.where("status = 'paid'")


def revenue_by_day_country(orders: DataFrame, items: DataFrame) -> DataFrame:
    out = _paid(orders).groupBy(F.col("date").alias("day"), "country").agg(F.sum("total_usd").alias("paid_revenue_usd"), F.count(F.lit(1)).alias("paid_orders"))
    return out.orderBy(F.asc_nulls_last("day"), F.asc_nulls_last("country"))


def top_products_per_week(orders: DataFrame, items: DataFrame) -> DataFrame:
    """All products of each week by revenue (the name notwithstanding, none is cut off)."""
    o = _paid(orders).select("order_id", F.date_trunc("week", "date").cast("date").alias("week_start"))
    out = items.select("order_id", "sku", "qty", "net_usd").join(o, "order_id").groupBy("week_start", "sku").agg(F.sum("qty").alias("units"), F.sum("net_usd").alias("revenue_usd"))
    return out.orderBy(F.asc_nulls_last("week_start"), F.desc_nulls_first("revenue_usd"), F.asc_nulls_last("sku"))


def paid_vs_refunded(orders: DataFrame, items: DataFrame) -> DataFrame:
    out = orders.groupBy("country").agg(F.count_if(F.col("status") == "paid").alias("paid_orders"), F.count_if(F.col("status") == "refunded").alias("refunded_orders"))
    return out.orderBy(F.desc_nulls_first("paid_orders"), F.asc_nulls_last("country"))


def distinct_paid_customers(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct customers with a paid order, for every country."""
    out = orders.groupBy("country").agg(F.count_distinct(F.when(F.col("status") == "paid", F.col("customer_id"))).alias("distinct_paid_customers"))
    return out.orderBy(F.desc_nulls_first("distinct_paid_customers"), F.asc_nulls_last("country"))


def fanout_wrong(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Wrong on purpose: an order's total counts once for each of its items."""
    out = _paid(orders).select("order_id", F.col("date").alias("day"), "total_usd").join(items.select("order_id"), "order_id").groupBy("day").agg(F.sum("total_usd").alias("paid_revenue_usd_wrong"))
    return out.orderBy(F.asc_nulls_last("day"))


def fanout_right(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Items are summed to order grain before the join."""
    by_order = items.groupBy("order_id").agg(F.sum("net_usd").alias("net_usd"))
    out = _paid(orders).select("order_id", F.col("date").alias("day")).join(by_order, "order_id").groupBy("day").agg(F.sum("net_usd").alias("paid_revenue_usd_right"))
    return out.orderBy(F.asc_nulls_last("day"))


METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "010_revenue_by_day_country": revenue_by_day_country,
    "020_top_products_per_week": top_products_per_week,
    "030_paid_vs_refunded_counts": paid_vs_refunded,
    "040_distinct_customers_with_purchases": distinct_paid_customers,
    "050_fanout_trap_wrong": fanout_wrong,
    "051_fanout_trap_right": fanout_right,
}


def metric_query(name: str, orders: DataFrame, items: DataFrame) -> DataFrame:
    key = name.removesuffix(".sql")
    if key not in METRICS:
        raise FileNotFoundError(f"no metric {name!r}; there are: {', '.join(sorted(METRICS))}")
    return METRICS[key](orders, items)
