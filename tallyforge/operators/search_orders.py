"""Staging of nested search orders: customers and products from within the orders, money from minor units, faults as rejects.

Ids of the service are text; a staged id is 64 bits of the text's hash, so that it is the same in every run. Of two ids with one
hash, the later row of a run is rejected as a repeated key, with its payload. Orders without a customer are those of customer 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import derive as D
from tallyforge.operators.staging import with_reason
from tallyforge.schemas import SEARCH_ORDER

#: The currency that is staged, and its minor units.
CURRENCY, MINOR = "USD", 100
#: Positions of line items within an order's.
LINE_SPAN = 10_000


def parsed(orders: DataFrame) -> DataFrame:
    """The fields of each order's raw_payload (JSON), with source_ref and raw_payload. They come out of a generator: a filter on
    fields of a plain from_json is pushed below it, and then parses the payload again for every field that it names."""
    return orders.select("source_ref", "raw_payload", F.inline(F.array(F.from_json("raw_payload", SEARCH_ORDER))))


def surrogate(kind: str, text: Column) -> Column:
    return F.xxhash64(F.lit(kind), text)


def customer_id(text: Column) -> Column:
    """0 for guests."""
    given = D.normalize_text(text)
    return F.when(given.isNull(), F.lit(0).cast("bigint")).otherwise(surrogate("customer", given))


def product_key(item: Column) -> Column:
    """The catalogue's id, or for items that stand in no catalogue their name."""
    return F.coalesce(D.normalize_text(item["catalog_object_id"]), F.concat(F.lit("name:"), F.lower(D.normalize_text(item["name"]))))


def major(minor: Column) -> Column:
    """Minor units as money."""
    return D.money(minor.cast("decimal(20,0)") / F.lit(MINOR))


def foreign(money: Column) -> Column:
    return F.coalesce(money["currency"] != CURRENCY, F.lit(False))


def order_fault(o: DataFrame) -> Column:
    return (
        F.when(D.normalize_text(o["id"]).isNull(), "missing_order_id")
        .when(o["created_at"].isNull(), "missing_order_time")
        .when(o["total_money"]["amount"].isNull(), "missing_total")
        .when(foreign(o["total_money"]), "unsupported_currency")
    )


def status(o: DataFrame) -> Column:
    """canceled, or refunded as soon as something was given back, or paid when complete or covered by tenders, else pending."""
    add = lambda of, keep: F.aggregate(F.coalesce(of, F.array()), F.lit(0).cast("bigint"), lambda s, x: s + F.when(keep(x), F.coalesce(x["amount_money"]["amount"], F.lit(0))).otherwise(0))
    back = add(o["refunds"], lambda x: ~F.coalesce(x["status"], F.lit("")).isin("REJECTED", "FAILED"))
    paid = add(o["tenders"], lambda x: F.lit(True))
    return F.when(o["state"] == "CANCELED", "canceled").when(back > 0, "refunded").when((o["state"] == "COMPLETED") | (paid >= o["total_money"]["amount"]), "paid").otherwise("pending")


def tag_orders(orders: DataFrame) -> DataFrame:
    o = orders
    quantity = F.aggregate(F.coalesce(o["line_items"], F.array()), F.lit(0).cast("decimal(20,5)"), lambda s, x: (s + F.coalesce(x["quantity"].try_cast("decimal(18,5)"), F.lit(0))).cast("decimal(20,5)"))
    rows = o.select(
        surrogate("order", D.normalize_text(o["id"])).alias("order_id"), customer_id(o["customer_id"]).alias("customer_id"), o["created_at"].alias("order_ts"), _country(o).alias("country"), status(o).alias("status"),
        major(o["total_money"]["amount"]).alias("total_usd"), F.coalesce(F.size("line_items"), F.lit(0)).alias("total_products"), F.floor(quantity).cast("int").alias("total_quantity"), "source_ref", "raw_payload", order_fault(o).alias("__fault"),
    )
    return with_reason(rows, F.col("__fault"), F.concat(F.lit("order cannot be staged: "), F.col("__fault"))).drop("__fault")


def _country(o: DataFrame) -> Column:
    return D.normalize_text(F.get(o["fulfillments"], F.lit(0))["shipment_details"]["recipient"]["address"]["country"])


def _lines(orders: DataFrame) -> DataFrame:
    o = orders.withColumn("__fault", order_fault(orders))
    return o.select(surrogate("order", D.normalize_text(o["id"])).alias("order_id"), "__fault", "source_ref", F.posexplode("line_items").alias("pos", "x"))


def item_fault(of_order: Column, x: Column) -> Column:
    qty = x["quantity"].try_cast("decimal(18,5)")
    return (
        F.when(of_order.isNotNull(), "rejected_order")
        .when(qty.isNull() | (qty <= 0), "invalid_quantity")
        .when(qty != F.floor(qty), "fractional_quantity")
        .when(product_key(x).isNull(), "unknown_product")
        .when(foreign(x["base_price_money"]) | foreign(x["gross_sales_money"]) | foreign(x["total_discount_money"]), "unsupported_currency")
    )


def rejects(orders: DataFrame) -> DataFrame:
    """The rejects of tag_orders and of tag_items, in one pass over the orders: each is followed by its line items."""
    o = orders.withColumn("__fault", order_fault(orders))
    items = F.coalesce("line_items", F.array())
    rows = o.select("__fault", "source_ref", "raw_payload", F.posexplode(F.concat(F.slice(F.array_append(items, F.lit(None)), -1, 1), items)).alias("pos", "x"))
    whole = F.col("pos") == 0
    why = F.when(whole, F.col("__fault")).otherwise(item_fault(F.col("__fault"), F.col("x")))
    bad = rows.withColumn("reason_code", why).where("reason_code is not null")
    return bad.select(
        F.when(whole, "stg_orders").otherwise("stg_order_items").alias("table_name"), F.when(whole, F.col("source_ref")).otherwise(F.col("source_ref") * LINE_SPAN + F.col("pos")).alias("source_ref"),
        F.when(whole, F.col("raw_payload")).otherwise(F.to_json("x")).alias("raw_payload"), "reason_code", F.concat(F.when(whole, "order cannot be staged: ").otherwise("line item cannot be staged: "), "reason_code").alias("reason_detail"),
    )


def tag_items(orders: DataFrame) -> DataFrame:
    """Line items. Items of an order that is not staged are rejected with it."""
    lines = _lines(orders)
    x, qty = F.col("x"), F.col("x.quantity").try_cast("decimal(18,5)")
    gross = F.coalesce(x["gross_sales_money"]["amount"], x["base_price_money"]["amount"] * F.floor(qty).cast("bigint"))
    off = F.greatest(F.lit(0).cast("bigint"), F.least(F.coalesce(x["total_discount_money"]["amount"], F.lit(0)), gross))
    fault = item_fault(F.col("__fault"), x)
    product = surrogate("product", product_key(x))
    share = D.fraction(F.when(gross > 0, off.cast("decimal(20,6)") / F.when(gross > 0, gross)).otherwise(F.lit(0)))
    rows = lines.select(
        "order_id", (F.col("pos") + 1).alias("line_id"), product.alias("product_id"), D.sku(product, F.lit("uncategorized"), x["name"]).alias("sku"), F.when(qty == F.floor(qty), qty).cast("int").alias("qty"),
        major(x["base_price_money"]["amount"]).alias("unit_price_usd"), share.alias("discount_pct"), major(gross).alias("gross_usd"), major(gross - off).alias("net_usd"),
        (F.col("source_ref") * LINE_SPAN + F.col("pos") + 1).alias("source_ref"), F.to_json("x").alias("raw_payload"), fault.alias("__why"),
    )
    return with_reason(rows, F.col("__why"), F.concat(F.lit("line item cannot be staged: "), F.col("__why"))).drop("__why")


def _untagged(rows: DataFrame) -> DataFrame:
    return with_reason(rows, F.lit(None).cast("string"), F.lit(None).cast("string"))


def tag_customers(orders: DataFrame) -> DataFrame:
    """One customer for each id in the orders that can be staged, as its first order tells of them."""
    o = orders.where(order_fault(orders).isNull())
    name = D.normalize_text(F.get(o["fulfillments"], F.lit(0))["shipment_details"]["recipient"]["display_name"])
    first = o.select(customer_id(o["customer_id"]).alias("customer_id"), F.struct(name.alias("name"), _country(o).alias("country"), D.normalize_text(o["customer_id"]).alias("given"), "source_ref").alias("v")).groupBy("customer_id").agg(F.min_by("v", "v.source_ref").alias("v"))
    null = F.lit(None).cast("string")
    full = F.coalesce("v.name", F.when(F.col("v.given").isNull(), "guest").otherwise(F.concat(F.lit("customer "), F.col("v.given"))))
    return _untagged(first.select("customer_id", null.alias("first_name"), null.alias("last_name"), full.alias("full_name"), null.alias("email"), null.alias("phone"), null.alias("city"), F.col("v.country").alias("country"), null.alias("company"), F.col("v.source_ref").alias("source_ref"), F.to_json("v").alias("raw_payload")))


def tag_products(orders: DataFrame) -> DataFrame:
    """One product for each key among the line items of orders that can be staged, as its first line item tells of it."""
    x = F.col("x")
    lines = _lines(orders).where(F.col("__fault").isNull() & product_key(x).isNotNull())
    seen = F.struct((F.col("source_ref") * LINE_SPAN + F.col("pos") + 1).alias("source_ref"), D.normalize_text(x["name"]).alias("name"), x["base_price_money"]["amount"].alias("price"))
    first = lines.select(surrogate("product", product_key(x)).alias("product_id"), seen.alias("v")).groupBy("product_id").agg(F.min_by("v", "v.source_ref").alias("v"))
    null = F.lit(None)
    return _untagged(first.select("product_id", D.sku(F.col("product_id"), F.lit("uncategorized"), F.col("v.name")).alias("sku"), F.coalesce("v.name", F.lit("unnamed")).alias("title"), null.cast("string").alias("brand"), F.lit("uncategorized").alias("category"), major(F.col("v.price")).alias("price_usd"), null.cast("decimal(8,4)").alias("discount_pct"), null.cast("decimal(6,3)").alias("rating"), null.cast("int").alias("stock"), F.col("v.source_ref").alias("source_ref"), F.to_json("v").alias("raw_payload")))
