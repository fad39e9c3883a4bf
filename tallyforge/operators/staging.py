"""Mapping source records to staged rows and rejects, and first-wins deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import derive as D
from tallyforge.schemas import STAGED, TableSpec


def _reject(df: DataFrame, table: str, code: str | Column, detail: str | Column) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.lit(table).alias("table_name"), "source_ref", "raw_payload", as_col(code).alias("reason_code"), as_col(detail).alias("reason_detail"))


def with_reason(rows: DataFrame, code: Column, detail: Column) -> DataFrame:
    """rows with reason_code and reason_detail: null for those to stage, else why not."""
    return rows.withColumns({"reason_code": code, "reason_detail": F.when(code.isNotNull(), detail)})


def parted(tagged: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows to stage, rejects) of tagged rows."""
    good = F.col("reason_code").isNull()
    return tagged.where(good).drop("reason_code", "reason_detail"), _reject(tagged.where(~good), table, F.col("reason_code"), F.col("reason_detail"))


def tag_users(users: DataFrame) -> DataFrame:
    """Mapped users: id, firstName, ..., source_ref, raw_payload."""
    u = users.select(
        F.col("id").cast("bigint").alias("customer_id"),
        D.normalize_text(F.col("firstName")).alias("first_name"),
        D.normalize_text(F.col("lastName")).alias("last_name"),
        D.full_name(F.col("firstName"), F.col("lastName")).alias("full_name"),
        D.normalize_email(F.col("email")).alias("email"),
        D.normalize_text(F.col("phone")).alias("phone"),
        D.normalize_text(F.col("address.city")).alias("city"),
        D.normalize_text(F.col("address.country")).alias("country"),
        D.normalize_text(F.col("company.name")).alias("company"),
        F.col("source_ref").cast("bigint").alias("source_ref"),
        "raw_payload",
    )
    return with_reason(u, F.when(F.col("full_name").isNull(), "missing_name"), F.lit("first and last name are both blank"))


def map_users(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parted(tag_users(users), "stg_customers")


def tag_products(products: DataFrame) -> DataFrame:
    p = products.withColumn("t", D.normalize_text(F.col("title"))).withColumn("c", D.normalize_text(F.col("category")))
    rows = p.select(
        F.col("id").cast("bigint").alias("product_id"),
        D.sku(F.col("id").cast("bigint"), F.col("c"), F.col("t")).alias("sku"),
        F.col("t").alias("title"),
        D.normalize_text(F.col("brand")).alias("brand"),
        F.col("c").alias("category"),
        D.money(F.col("price").cast("double")).alias("price_usd"),
        D.discount_fraction(F.col("discountPercentage").cast("double")).alias("discount_pct"),
        F.col("rating").cast("double").cast("decimal(6,3)").alias("rating"),
        F.col("stock").cast("double").cast("int").alias("stock"),
        F.col("source_ref").cast("bigint").alias("source_ref"),
        "raw_payload",
    )
    return with_reason(rows, F.when(F.col("title").isNull() | F.col("category").isNull(), "missing_product_fields"), F.lit("title or category is blank"))


def map_products(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parted(tag_products(products), "stg_products")


def first_seen(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the one of the lowest source_ref."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), "source_ref").alias("r")).select(key, "r.*")


def tag_carts(carts: DataFrame, countries: DataFrame, skus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders, tagged items) of carts. countries: customer_id, country; skus: product_id, sku; one row for each key.

    A cart is staged even if all of its lines are rejected. A line's source_ref is its position among all lines: a running sum
    of the carts' line counts (carts are ordered by source_ref) and its position within the cart.
    """
    c = carts.select(
        F.col("id").cast("bigint").alias("order_id"),
        F.col("userId").cast("bigint").alias("customer_id"),
        F.col("discountedTotal").cast("double").alias("paid"),
        F.col("totalProducts").cast("double").cast("int").alias("total_products"),
        F.col("totalQuantity").cast("double").cast("int").alias("total_quantity"),
        "products",
        F.col("source_ref").cast("bigint").alias("source_ref"),
        "raw_payload",
    )
    orders = c.join(countries, "customer_id", "left").select(
        "order_id",
        "customer_id",
        D.order_ts(F.col("order_id"), F.col("customer_id")).alias("order_ts"),
        "country",
        D.order_status(F.col("order_id"), F.col("total_products"), F.col("total_quantity")).alias("status"),
        D.money(F.col("paid")).alias("total_usd"),
        "total_products",
        "total_quantity",
        "source_ref",
        "raw_payload",
    )
    sized = running_offset(c.withColumn("n", F.coalesce(F.size("products"), F.lit(0))), "source_ref", "n", "before")
    lines = sized.select("order_id", "before", F.posexplode("products").alias("pos", "p")).select(
        "order_id",
        (F.col("pos") + 1).alias("line_id"),
        (F.col("before") + F.col("pos") + 1).alias("source_ref"),
        F.col("p.id").cast("bigint").alias("product_id"),
        F.col("p.quantity").cast("double").cast("int").alias("qty"),
        F.col("p.price").cast("double").alias("price"),
        F.col("p.total").cast("double").alias("total"),
        F.col("p.discountedTotal").cast("double").alias("discounted"),
        F.to_json("p").alias("raw_payload"),
    )
    return with_reason(orders, F.lit(None).cast("string"), F.lit(None).cast("string")), tag_lines(lines.join(skus, "product_id", "left"))


def map_carts(carts: DataFrame, users: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, items, item rejects), with the first mapped user and product of each id."""
    countries = first_seen(users.select("customer_id", "country", "source_ref"), "customer_id").drop("source_ref")
    skus = first_seen(products.select("product_id", "sku", "source_ref"), "product_id").drop("source_ref")
    orders, lines = tag_carts(carts, countries, skus)
    return (parted(orders, "stg_orders")[0], *parted(lines, "stg_order_items"))


def tag_lines(joined: DataFrame) -> DataFrame:
    """Items of lines that carry the looked-up sku (null: unknown product). A quantity fault comes first."""
    reason = F.when(F.col("qty") <= 0, "invalid_quantity").when(F.col("sku").isNull(), "unknown_product")
    detail = F.when(F.col("qty") <= 0, F.format_string("cart line %d has non-pos qty=%d", "line_id", "qty")).otherwise(
        F.format_string("product_id %d was referenced by cart %d but not found in the product lookup", "product_id", "order_id")
    )
    gross = D.gross_usd(F.col("qty"), F.col("price"))
    discount = D.line_discount(F.col("total"), F.col("discounted"))
    items = joined.select(
        "order_id", "line_id", "product_id", "sku", "qty",
        D.money(F.col("price")).alias("unit_price_usd"), discount.alias("discount_pct"), gross.alias("gross_usd"),
        D.net_usd(gross, discount, F.col("discounted")).alias("net_usd"), "source_ref", "raw_payload",
    )
    return with_reason(items, reason, detail)


def split_lines(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parted(tag_lines(joined), "stg_order_items")


def running_offset(df: DataFrame, order: str, size: str, name: str, bits: int = 20) -> DataFrame:
    """df with the sum of `size` over all rows of smaller `order` (a whole number, distinct, not below zero).

    Numbers are taken in ranges of 2^bits: a window sums within a range, another over the ranges of 2^bits ranges, and one over
    these. With numbers as close as positions are, no window holds more than 2^bits rows up to 2^60 rows; nothing is computed
    before the plan runs.
    """
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near, far = (F.expr(f"shiftright(`{order}`, {k * bits})").cast("bigint") for k in (1, 2))
    rows = df.withColumn("__near", near)
    sums = df.groupBy(near.alias("__near"), far.alias("__far")).agg(F.sum(size).alias("__n"))
    tops = sums.groupBy("__far").agg(F.sum("__n").alias("__m"))
    base = sums.withColumn("__base", before("__n", W.partitionBy("__far").orderBy("__near"))).join(tops.select("__far", before("__m", W.orderBy("__far")).alias("__top")), "__far")
    out = rows.withColumn("__at", before(size, W.partitionBy("__near").orderBy(order)))
    return out.join(base.select("__near", (F.col("__base") + F.col("__top")).alias("__base")), "__near").withColumn(name, F.col("__at") + F.col("__base")).drop("__at", "__base", "__near")


def duplicate_detail(key: tuple[str, ...]) -> Column:
    return F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in key)))


def ranked(rows: DataFrame, key: tuple[str, ...], order: list[Column | str] | None = None) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*(order or [F.asc_nulls_last("source_ref")]))))


def dedup(rows: DataFrame, spec: TableSpec, order: list[Column | str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, the others as duplicate_key rejects)."""
    r = ranked(rows, spec.key, order)
    return r.where("__rn = 1").select(*spec.names), _reject(r.where("__rn > 1"), spec.name, "duplicate_key", duplicate_detail(spec.key))


def branches(tagged: DataFrame, spec: TableSpec) -> DataFrame:
    """Tagged rows with branch: first (the row of a key to stage), repeat (another one of its key) or reject, by one window.

    Payloads and positions are kept for what becomes a reject only. Rejected rows never count as the first of a key, and are
    dealt out over 64 parts of it, as they may share one (a null, say)."""
    bad = F.col("reason_code").isNotNull()
    rn = F.row_number().over(W.partitionBy(*spec.key, F.when(bad, F.pmod("source_ref", F.lit(64)))).orderBy(F.asc_nulls_last("source_ref")))
    out = tagged.withColumn("__rn", rn).withColumn("branch", F.when(bad, "reject").when(F.col("__rn") == 1, "first").otherwise("repeat"))
    again, kept = F.col("branch") == "repeat", F.col("branch") != "first"
    return out.select(
        *spec.names, "branch", F.when(kept, F.col("source_ref")).alias("source_ref"), F.when(kept, F.col("raw_payload")).alias("raw_payload"),
        F.when(again, "duplicate_key").otherwise(F.col("reason_code")).alias("reason_code"), F.when(again, duplicate_detail(spec.key)).otherwise(F.col("reason_detail")).alias("reason_detail"),
    )


def rejects_of(split: dict[str, DataFrame], table: str) -> DataFrame:
    """Rejects among the branches of one table."""
    return _reject(split["repeat"].unionByName(split["reject"]), table, F.col("reason_code"), F.col("reason_detail"))


def map_all(users: DataFrame, products: DataFrame, carts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Mapped rows of the four tables, with source_ref and raw_payload, and the rejects of mapping."""
    u, bad_u = map_users(users)
    p, bad_p = map_products(products)
    o, i, bad_i = map_carts(carts, u, p)
    return dict(zip(STAGED, (u, p, o, i))), bad_u.unionByName(bad_p).unionByName(bad_i)


def load_results(tagged: dict[str, DataFrame]) -> DataFrame:
    """table_name, inserted_count, duplicate_reject_count, explicit_reject_count of each table that has rows, in one pass each."""
    counts = [F.count_if(F.col("branch") == b).alias(n) for b, n in (("first", "inserted_count"), ("repeat", "duplicate_reject_count"), ("reject", "explicit_reject_count"))]
    every = [branches(rows, STAGED[t]).agg(*counts).select(F.lit(t).alias("table_name"), "*") for t, rows in tagged.items()]
    return reduce(DataFrame.unionByName, every).where("inserted_count + duplicate_reject_count + explicit_reject_count > 0")
