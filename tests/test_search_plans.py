"""Search orders are parsed once a row, and their rejects are found in one pass."""

from pyspark.sql import functions as F

from tallyforge.operators import search_orders, staging
from tallyforge.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payload_is_parsed_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    for name, times in (("search_order_headers", 1), ("search_order_items", 1), ("search_order_rejects", 1), ("search_order_dimensions", 2)):
        assert plan(queries.QUERIES[name](spark, SF)).count("from_json") == times, name


def test_rejects_in_one_pass(spark):
    """Every fault, an order without lines, with null lines, and a payload that is no JSON."""
    usd = '{"amount": 100, "currency": "USD"}'
    eur = usd.replace("USD", "EUR")
    item = lambda q, m=usd, more='"name": "n"': f'{{"uid": "1", "quantity": "{q}", "base_price_money": {m}, {more}}}'
    order = lambda i, m=usd, lines="null", at='"2024-01-01T00:00:00Z"': f'{{"id": {i}, "created_at": {at}, "total_money": {m}, "line_items": {lines}}}'
    payloads = [order('"a"', lines=f"[{item(1)}, {item(0)}, null, {item('1.5')}, {item(2, eur)}, {item(3, more='\"uid\": \"2\"')}]"), order('"b"', eur, f"[{item(1)}]"), order("null", lines="[]"), order('"c"', at="null"), order('"d"', "null"), "no json", order('"e"')]
    raw = spark.createDataFrame(list(enumerate(payloads, 1)), "source_ref bigint, raw_payload string")
    o = search_orders.parsed(raw)
    two = staging.parted(search_orders.tag_orders(o), "stg_orders")[1].unionByName(staging.parted(search_orders.tag_items(o), "stg_order_items")[1])
    rows = lambda df: sorted((r.table_name, r.source_ref, r.reason_code, r.reason_detail, r.raw_payload or "") for r in df.collect())
    assert rows(search_orders.rejects(o)) == rows(two) and two.count() == 11
    plain = raw.select(F.from_json("raw_payload", search_orders.SEARCH_ORDER).alias("r"), "source_ref", "raw_payload").select("r.*", "source_ref", "raw_payload")
    assert sorted(map(repr, o.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
