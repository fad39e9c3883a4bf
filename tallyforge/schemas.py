"""Schemas of source records, staged tables and warehouse tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

LINE = "struct<id:string,title:string,quantity:string,price:string,total:string,discountPercentage:string,discountedTotal:string>"
#: Numbers are read as strings and cast, so that lax values ("12") load and wrong ones are counted instead of lost.
RECORDS = {
    "users": "id string, firstName string, lastName string, email string, phone string, birthDate string, address struct<city:string,country:string>, company struct<name:string>",
    "products": "id string, title string, category string, price string, stock string, brand string, discountPercentage string, rating string",
    "carts": f"id string, userId string, total string, discountedTotal string, totalProducts string, totalQuantity string, products array<{LINE}>",
}

_MONEY = "struct<amount:bigint,currency:string>"
#: An order of a search service: money in minor units, line items, tenders and refunds within the order.
SEARCH_ORDER = (
    "id string, location_id string, customer_id string, state string, created_at timestamp, updated_at timestamp, closed_at timestamp, "
    f"total_money {_MONEY}, line_items array<struct<uid:string,name:string,quantity:string,catalog_object_id:string,base_price_money:{_MONEY},gross_sales_money:{_MONEY},total_discount_money:{_MONEY},total_money:{_MONEY}>>, "
    f"tenders array<struct<id:string,type:string,amount_money:{_MONEY}>>, refunds array<struct<id:string,status:string,amount_money:{_MONEY}>>, "
    "fulfillments array<struct<type:string,shipment_details:struct<recipient:struct<display_name:string,address:struct<country:string>>>>>"
)


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: str
    key: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return columns_of(self.columns)


STAGED = {
    t.name: t
    for t in (
        TableSpec("stg_customers", "customer_id bigint, first_name string, last_name string, full_name string, email string, phone string, city string, country string, company string", ("customer_id",)),
        TableSpec("stg_products", "product_id bigint, sku string, title string, brand string, category string, price_usd decimal(12,2), discount_pct decimal(8,4), rating decimal(6,3), stock int", ("product_id",)),
        TableSpec("stg_orders", "order_id bigint, customer_id bigint, order_ts timestamp, country string, status string, total_usd decimal(12,2), total_products int, total_quantity int", ("order_id",)),
        TableSpec("stg_order_items", "order_id bigint, line_id int, product_id bigint, sku string, qty int, unit_price_usd decimal(12,2), discount_pct decimal(8,4), gross_usd decimal(12,2), net_usd decimal(12,2)", ("order_id", "line_id")),
    )
}
REJECTS = "run_id string, table_name string, source_ref bigint, raw_payload string, reason_code string, reason_detail string, rejected_at timestamp"
DQ = "run_id string, table_name string, check_name string, metric_name string, metric_value decimal(18,6), passed boolean, details_json string, created_at timestamp"
LEDGER = "run_id string, source_system string, mode string, snapshot_key string, started_at timestamp, finished_at timestamp, status string, error_message string, git_sha string, args_json string, watermark_column string, watermark_low timestamp, watermark_high timestamp, cursor_state_json string"
WAREHOUSE = {
    "dim_customer": "customer_id bigint, first_name string, last_name string, full_name string, email string, phone string, city string, country string, company string, source_run_id string, built_at timestamp",
    "dim_date": "date date, year int, month int, day int, iso_week int, iso_dow int, quarter int, week_start date, month_start date, built_at timestamp",
    "fact_orders": "order_id bigint, customer_id bigint, date date, order_ts timestamp, country string, status string, total_usd decimal(12,2), source_run_id string, built_at timestamp",
    "fact_order_items": "order_id bigint, line_id int, customer_id bigint, date date, product_id bigint, sku string, qty int, unit_price_usd decimal(12,2), gross_usd decimal(12,2), net_usd decimal(12,2), source_run_id string, built_at timestamp",
}
#: Fact tables are dealt into buckets by their order, so that a run rewrites those of its orders only.
BUCKET_KEY = {"fact_orders": "order_id", "fact_order_items": "order_id"}
KEYS = {"dim_customer": ["customer_id"], "dim_date": ["date"], "fact_orders": ["order_id"], "fact_order_items": ["order_id", "line_id"]}


def columns_of(ddl: str) -> list[str]:
    return [f.name for f in _parse_datatype_string(ddl).fields]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns and types of a table; a column that is missing is an error."""
    fields = _parse_datatype_string(ddl).fields
    if missing := [f.name for f in fields if f.name not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


def staging_spec(name: str) -> TableSpec:
    if name not in STAGED:
        raise ValueError(f"unknown staging table {name!r}; known: {', '.join(STAGED)}")
    return STAGED[name]
