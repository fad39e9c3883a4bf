"""Which staged table comes from which records, in the order in which they are loaded."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import search_orders, staging
from tallyforge.schemas import STAGED

Make = Callable[[dict[str, DataFrame]], DataFrame]


def mappings(pulled: dict[str, DataFrame]) -> list[tuple[str, Make]]:
    """(table, function of the tables staged so far -> tagged rows). pulled: users, products and carts, or orders."""
    if "orders" in pulled:
        o = pulled["orders"]
        return [("stg_customers", lambda s: search_orders.tag_customers(o)), ("stg_products", lambda s: search_orders.tag_products(o)), ("stg_orders", lambda s: search_orders.tag_orders(o)), ("stg_order_items", lambda s: search_orders.tag_items(o))]
    carts = lambda s: staging.tag_carts(pulled["carts"], s["stg_customers"].select("customer_id", "country"), s["stg_products"].select("product_id", "sku"))
    return [("stg_customers", lambda s: staging.tag_users(pulled["users"])), ("stg_products", lambda s: staging.tag_products(pulled["products"])), ("stg_orders", lambda s: carts(s)[0]), ("stg_order_items", lambda s: carts(s)[1])]


def stage_all(pulled: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The four staged tables and all rejects of records; nothing is written."""
    staged: dict[str, DataFrame] = {}
    rejects: list[DataFrame] = []
    for table, make in mappings(pulled):
        rows = staging.branches(make(staged), STAGED[table])
        staged[table] = rows.where("branch = 'first'").select(*STAGED[table].names)
        rejects.append(staging.rejects_of({b: rows.where(F.col("branch") == b) for b in ("repeat", "reject")}, table))
    return staged, reduce(DataFrame.unionByName, rejects)
