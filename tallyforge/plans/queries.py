"""Every operator applied to the driver's star-schema tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import derive as D
from tallyforge.operators import constraints, gates, quality, search_orders, staging, warehouse
from tallyforge.operators.constraints import Rules
from tallyforge.plans import metrics, views
from tallyforge.schemas import STAGED

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


class Tables:
    """Staged relations mapped from the star schema."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")

    def customers(self) -> DataFrame:
        c = self.read("customer").join(F.broadcast(self.read("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows at every scale
        null = F.lit(None).cast("string")
        return c.select(F.col("c_custkey").alias("customer_id"), null.alias("first_name"), null.alias("last_name"), D.full_name(F.col("c_name"), null).alias("full_name"), null.alias("email"), null.alias("phone"), null.alias("city"), F.col("n_name").alias("country"), D.normalize_text(F.col("c_mktsegment")).alias("company"))

    def products(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("product_id"), D.sku(F.col("p_partkey"), F.col("p_type"), F.col("p_name")).alias("sku"), F.col("p_name").alias("title"), D.money(F.col("p_retailprice")).alias("price_usd"))

    def orders(self) -> DataFrame:
        where = self.customers().select("customer_id", "country")
        one = F.lit(1)
        o = self.read("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("order_ts"), D.order_status(F.col("o_orderkey"), one, one).alias("status"), D.money(F.col("o_totalprice")).alias("total_usd"))
        return o.join(where, "customer_id", "left")

    def lines(self) -> DataFrame:
        l, d = F.col, D.money(F.col("l_extendedprice"))  # noqa: E741
        pct = D.fraction(l("l_discount"))
        return self.read("lineitem").select(
            l("l_orderkey").alias("order_id"), l("l_linenumber").alias("line_id"), l("l_partkey").alias("product_id"), l("l_suppkey").alias("supplier_id"),
            l("l_quantity").cast("int").alias("qty"), pct.alias("discount_pct"), d.alias("gross_usd"), D.money(d * (F.lit(1).cast("decimal(8,4)") - pct)).alias("net_usd"), "l_shipdate", "l_tax",
        )

    LINE_ORDER = ("product_id", "supplier_id", "qty", "gross_usd", "discount_pct", "l_shipdate", "l_tax")

    def items(self) -> DataFrame:
        """First line of each (order_id, line_id), with its sku."""
        first = staging.ranked(self.lines(), ("order_id", "line_id"), [F.asc_nulls_last(c) for c in self.LINE_ORDER]).where("__rn = 1")
        return first.join(self.products().select("product_id", "sku"), "product_id", "left")

    def fact_orders(self) -> DataFrame:
        return warehouse.fact_orders(self.orders(), "r1", AT)

    def fact_items(self) -> DataFrame:
        return warehouse.fact_order_items(self.items().withColumn("unit_price_usd", F.lit(None).cast("decimal(12,2)")), self.orders(), "r1", AT)


MONEY = lambda x: f"CAST(CAST({x} AS DECIMAL(20,6)) AS DECIMAL(12,2))"
SLUG = lambda x: f"coalesce(nullif(trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"
STATUS = "CASE WHEN o_orderkey % 20 = 0 THEN 'refunded' WHEN o_orderkey % 20 BETWEEN 1 AND 3 THEN 'pending' ELSE 'paid' END"
WITH = f"""WITH c AS (SELECT c_custkey AS customer_id, trim(c_name) AS full_name, n_name AS country, trim(c_mktsegment) AS company FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT p_partkey AS product_id, 'SKU-' || {SLUG('p_type')} || '-' || {SLUG('p_name')} || '-' || p_partkey AS sku FROM part),
o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts, CAST(o_orderdate AS DATE) AS date, {STATUS} AS status, {MONEY('o_totalprice')} AS total_usd, c.country FROM orders LEFT JOIN c ON c.customer_id = o_custkey),
l0 AS (SELECT l_orderkey AS order_id, l_linenumber AS line_id, l_partkey AS product_id, l_suppkey AS supplier_id, CAST(l_quantity AS INTEGER) AS qty, CAST(l_discount AS DECIMAL(8,4)) AS discount_pct, {MONEY('l_extendedprice')} AS gross_usd, l_shipdate, l_tax FROM lineitem),
l AS (SELECT *, CAST(gross_usd * (CAST(1 AS DECIMAL(8,4)) - discount_pct) AS DECIMAL(12,2)) AS net_usd, row_number() OVER (PARTITION BY order_id, line_id ORDER BY product_id NULLS LAST, supplier_id NULLS LAST, qty NULLS LAST, gross_usd NULLS LAST, discount_pct NULLS LAST, l_shipdate NULLS LAST, l_tax NULLS LAST) AS rn FROM l0),
i AS (SELECT l.*, p.sku FROM l LEFT JOIN p USING (product_id) WHERE rn = 1),
fi AS (SELECT i.order_id, i.line_id, o.customer_id, o.date, i.product_id, i.sku, i.qty, i.gross_usd, i.net_usd FROM i LEFT JOIN o USING (order_id))
"""


@query(f"SELECT p_partkey, {SLUG('p_type')} AS type_slug, 'SKU-' || {SLUG('p_type')} || '-' || {SLUG('p_name')} || '-' || p_partkey AS sku, lower(trim(p_brand)) AS brand_mail, trim(p_name) || ' ' || trim(p_brand) AS full_name FROM part")
def derive_text_and_sku(spark, d):
    c = F.col
    return Tables(spark, d).read("part").select("p_partkey", D.slugify(c("p_type")).alias("type_slug"), D.sku(c("p_partkey"), c("p_type"), c("p_name")).alias("sku"), D.normalize_email(c("p_brand")).alias("brand_mail"), D.full_name(c("p_name"), c("p_brand")).alias("full_name"))


@query(f"SELECT o_orderkey, {STATUS} AS status, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 365 AS INTEGER)) + to_minutes((o_custkey * 17 + o_orderkey) % 1440) + to_seconds(o_orderkey % 60), '%Y-%m-%d %H:%M:%S') AS order_ts FROM orders")
def derive_order_fields(spark, d):
    c, one = F.col, F.lit(1)
    return Tables(spark, d).read("orders").select("o_orderkey", D.order_status(c("o_orderkey"), one, one).alias("status"), F.date_format(D.order_ts(c("o_orderkey"), c("o_custkey")), "yyyy-MM-dd HH:mm:ss").alias("order_ts"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS ship, {MONEY('l_extendedprice')} AS gross_usd,
CAST(round(CAST(l_discount AS DECIMAL(8,4)), 4) AS DECIMAL(8,4)) AS discount_pct,
CAST({MONEY('l_extendedprice')} * (CAST(1 AS DECIMAL(8,4)) - CAST(l_discount AS DECIMAL(8,4))) AS DECIMAL(12,2)) AS net_usd, CAST(l_tax AS DECIMAL(8,4)) AS tax FROM lineitem""")
def derive_line_money(spark, d):
    c = F.col
    gross, pct = D.money(c("l_extendedprice")), D.fraction(c("l_discount"))
    return Tables(spark, d).read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_shipdate").cast("date").alias("ship"), gross.alias("gross_usd"), pct.alias("discount_pct"), D.net_usd(gross, pct, F.lit(None).cast("double")).alias("net_usd"), D.fraction(c("l_tax")).alias("tax"))


@query("""WITH n AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS line_id FROM lineitem),
s AS (SELECT order_id, coalesce(sum(n) OVER (ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT order_id, count(*) AS n FROM n GROUP BY 1))
SELECT n.order_id, CAST(line_id AS INTEGER) AS line_id, CAST(before + line_id AS BIGINT) AS source_ref, product_id, qty FROM n JOIN s USING (order_id)""")
def cart_flatten(spark, d):
    """Lines nested into carts, then flattened with their position in the cart and over all lines."""
    l = Tables(spark, d).read("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))).alias("products"))  # noqa: E741
    sized = staging.running_offset(l.withColumn("n", F.size("products")), "order_id", "n", "before")
    return sized.select("order_id", "before", F.posexplode("products").alias("pos", "p")).select("order_id", (F.col("pos") + 1).alias("line_id"), (F.col("before") + F.col("pos") + 1).alias("source_ref"), F.col("p.l_partkey").alias("product_id"), F.col("p.l_quantity").cast("int").alias("qty"))


def _looked_up(spark, d):
    t = Tables(spark, d)
    known = t.products().where("product_id % 10 <> 0").select("product_id", "sku")
    lines = t.lines().withColumn("qty", F.when(F.col("qty") <= 2, 0).otherwise(F.col("qty")))
    return lines.join(known, "product_id", "left").withColumns({"price": F.col("gross_usd").cast("double"), "total": F.col("gross_usd").cast("double"), "discounted": F.col("net_usd").cast("double"), "source_ref": F.lit(1), "raw_payload": F.lit("{}")})


@query(WITH + """, x AS (SELECT l0.order_id, l0.line_id, l0.product_id, CASE WHEN l0.qty <= 2 THEN 0 ELSE l0.qty END AS qty, p.sku FROM l0 LEFT JOIN p ON p.product_id = l0.product_id AND p.product_id % 10 <> 0)
SELECT CASE WHEN qty <= 0 THEN 'invalid_quantity' ELSE 'unknown_product' END AS reason_code, CASE WHEN qty <= 0 THEN 'cart line ' || line_id || ' has non-pos qty=' || qty ELSE 'product_id ' || product_id || ' was referenced by cart ' || order_id || ' but not found in the product lookup' END AS reason_detail FROM x WHERE qty <= 0 OR sku IS NULL""")
def lookup_enrich_rejects(spark, d):
    return staging.split_lines(_looked_up(spark, d))[1].select("reason_code", "reason_detail")


@query(WITH + """, x AS (SELECT l0.*, p.sku FROM l0 LEFT JOIN p ON p.product_id = l0.product_id AND p.product_id % 10 <> 0)
SELECT order_id, line_id, product_id, sku, qty, gross_usd FROM x WHERE qty > 2 AND sku IS NOT NULL""")
def lookup_enrich_items(spark, d):
    return staging.split_lines(_looked_up(spark, d))[0].select("order_id", "line_id", "product_id", "sku", "qty", F.col("unit_price_usd").alias("gross_usd"))


@query(WITH + "SELECT order_id, line_id, product_id, supplier_id, qty, gross_usd, discount_pct FROM l WHERE rn = 1")
def dedup_first_wins(spark, d):
    t = Tables(spark, d)
    return staging.ranked(t.lines(), ("order_id", "line_id"), [F.asc_nulls_last(c) for c in t.LINE_ORDER]).where("__rn = 1").select("order_id", "line_id", "product_id", "supplier_id", "qty", "gross_usd", "discount_pct")


DUP = "SELECT 'stg_order_items' AS table_name, 'duplicate_key' AS reason_code, 'duplicate key: order_id=' || order_id || ', line_id=' || line_id AS reason_detail FROM l WHERE rn > 1"


def _dup_rejects(spark, d):
    t = Tables(spark, d)
    rows = t.lines().withColumns({"sku": F.lit(""), "unit_price_usd": F.col("gross_usd"), "source_ref": F.lit(1), "raw_payload": F.lit("{}")})
    return staging.dedup(rows, STAGED["stg_order_items"], [F.asc_nulls_last(c) for c in t.LINE_ORDER])[1]


@query(WITH + DUP)
def dedup_rejects(spark, d):
    return _dup_rejects(spark, d).select("table_name", "reason_code", "reason_detail")


@query(WITH + f"SELECT reason_code, count(*) AS n FROM ({DUP}) GROUP BY 1")
def reject_counts_by_reason(spark, d):
    return quality.reject_counts(_dup_rejects(spark, d))


@query("""SELECT 'stg_customers' AS table_name, 'row_count' AS metric_name, CAST(count(*) AS DECIMAL(18,6)) AS metric_value, count(*) > 0 AS passed FROM customer
UNION ALL SELECT 'stg_customers', 'duplicate_keys.count', CAST(count(*) AS DECIMAL(18,6)), count(*) = 0 FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1)
UNION ALL SELECT 'stg_products', 'row_count', CAST(count(*) AS DECIMAL(18,6)), count(*) > 0 FROM part
UNION ALL SELECT 'stg_products', 'duplicate_keys.count', CAST(count(*) AS DECIMAL(18,6)), count(*) = 0 FROM (SELECT 1 FROM part GROUP BY p_partkey HAVING count(*) > 1)
UNION ALL SELECT 'stg_orders', 'row_count', CAST(count(*) AS DECIMAL(18,6)), count(*) > 0 FROM orders
UNION ALL SELECT 'stg_orders', 'duplicate_keys.count', CAST(count(*) AS DECIMAL(18,6)), count(*) = 0 FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'stg_order_items', 'row_count', CAST(count(*) AS DECIMAL(18,6)), count(*) > 0 FROM lineitem
UNION ALL SELECT 'stg_order_items', 'duplicate_keys.count', CAST(count(*) AS DECIMAL(18,6)), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def dq_volume_keys(spark, d):
    t = Tables(spark, d)
    out = None
    for name, rows in (("stg_customers", t.customers()), ("stg_products", t.products()), ("stg_orders", t.orders()), ("stg_order_items", t.lines())):
        m = quality.volume_and_keys(rows, name).select("table_name", "metric_name", "metric_value", "passed")
        out = m if out is None else out.unionByName(m)
    return out


RATE = f"""r AS ({DUP}), n AS (SELECT (SELECT count(*) FROM r) AS rejects, (SELECT count(*) FROM l WHERE rn = 1) AS staged)
SELECT 'stg_order_items' AS table_name, 'reject_rows.total' AS metric_name, CAST(rejects AS DECIMAL(18,6)) AS metric_value, rejects = 0 AS passed FROM n
UNION ALL SELECT 'stg_order_items', 'reject_rows.reject_rate', CAST((2 * CAST(rejects AS HUGEINT) * 1000000 + staged) // (2 * staged) AS DECIMAL(18,6)) / 1000000, rejects = 0 FROM n
UNION ALL SELECT 'stg_order_items', 'reason_code.duplicate_key.count', CAST(rejects AS DECIMAL(18,6)), false FROM n WHERE rejects > 0"""


@query(WITH + ", " + RATE.replace("SELECT 'stg_order_items', 'reject_rows.reject_rate', CAST((", "SELECT 'stg_order_items', 'reject_rows.reject_rate', CAST(CAST((").replace("(2 * staged) AS DECIMAL(18,6)) / 1000000", "(2 * staged) AS DOUBLE) / 1000000 AS DECIMAL(18,6))"))
def dq_reject_rate(spark, d):
    t = Tables(spark, d)
    staged = staging.ranked(t.lines(), ("order_id", "line_id"), [F.asc_nulls_last(c) for c in t.LINE_ORDER]).where("__rn = 1")
    return quality.reject_metrics(staged, _dup_rejects(spark, d), "stg_order_items").select("table_name", "metric_name", "metric_value", "passed")


def _missing_sql(table: str, metric: str, child: str, key: str, parent: str, pkey: str) -> str:
    return f"SELECT '{table}' AS table_name, '{metric}' AS metric_name, CAST(count(*) AS DECIMAL(18,6)) AS metric_value, count(*) = 0 AS passed FROM {child} WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {pkey} = {key} AND {pkey} % 10 <> 0)"


def _missing(child: DataFrame, parent: DataFrame, key: str, table: str, metric: str) -> DataFrame:
    return quality.missing(child, parent.where(f"{key} % 10 <> 0"), key, table, metric).select("table_name", "metric_name", "metric_value", "passed")


@query(_missing_sql("stg_orders", "missing_customers.count", "orders", "o_custkey", "customer", "c_custkey"))
def dq_missing_customers(spark, d):
    t = Tables(spark, d)
    return _missing(t.orders(), t.customers(), "customer_id", "stg_orders", "missing_customers.count")


@query(_missing_sql("stg_order_items", "missing_products.count", "lineitem", "l_partkey", "part", "p_partkey"))
def dq_missing_products(spark, d):
    t = Tables(spark, d)
    return _missing(t.lines(), t.products(), "product_id", "stg_order_items", "missing_products.count")


@query(_missing_sql("stg_order_items", "orphan_orders.count", "lineitem", "l_orderkey", "orders", "o_orderkey"))
def dq_orphan_orders(spark, d):
    t = Tables(spark, d)
    return _missing(t.lines(), t.orders(), "order_id", "stg_order_items", "orphan_orders.count")


@query("""SELECT 'stg_order_items' AS table_name, 'duplicate_keys.count' AS metric_name, CAST(count(*) AS DECIMAL(18,6)) AS metric_value, 'hard' AS severity FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) <> 0
UNION ALL SELECT 'stg_orders', 'missing_customers.count', CAST(count(*) AS DECIMAL(18,6)), 'hard' FROM orders WHERE o_custkey % 10 = 0 HAVING count(*) <> 0""")
def gate_failures(spark, d):
    t = Tables(spark, d)
    dq = quality.volume_and_keys(t.lines(), "stg_order_items").unionByName(quality.missing(t.orders(), t.customers().where("customer_id % 10 <> 0"), "customer_id", "stg_orders", "missing_customers.count"))
    return gates.gate_rows(dq, "live")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def window_filter(spark, d):
    from tallyforge.sources.window import in_window

    return in_window(Tables(spark, d).read("orders"), F.col("o_orderdate"), datetime(1995, 1, 1), datetime(1996, 1, 1)).select("o_orderkey", "o_totalprice")


@query(WITH + "SELECT customer_id, full_name, country, company, 'r1' AS source_run_id FROM c")
def dim_customer(spark, d):
    return warehouse.dim_customer(Tables(spark, d).customers(), "r1", AT).select("customer_id", "full_name", "country", "company", "source_run_id")


@query("""SELECT CAST(d AS DATE) AS date, CAST(isoyear(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(week(d) AS INTEGER) AS iso_week, CAST(isodow(d) AS INTEGER) AS iso_dow, CAST(quarter(d) AS INTEGER) AS quarter, CAST(date_trunc('week', d) AS DATE) AS week_start, CAST(date_trunc('month', d) AS DATE) AS month_start
FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)""")
def dim_date(spark, d):
    return warehouse.calendar(Tables(spark, d).orders())


FO = "SELECT order_id, customer_id, date, country, status, total_usd"


@query(WITH + FO + " FROM o")
def fact_orders_snapshot(spark, d):
    return Tables(spark, d).fact_orders().drop("order_ts", "source_run_id", "built_at")


@query(WITH + FO + ", CASE WHEN date >= DATE '1997-01-01' THEN 'r2' ELSE 'r1' END AS source_run_id FROM o")
def fact_orders_incremental(spark, d):
    t = Tables(spark, d)
    new = warehouse.fact_orders(t.orders().where("order_ts >= '1997-01-01'"), "r2", AT)
    return warehouse.reconcile_orders(t.fact_orders(), new, "incremental").drop("order_ts", "built_at")


@query(WITH + "SELECT * FROM fi")
def fact_items_snapshot(spark, d):
    return Tables(spark, d).fact_items().drop("unit_price_usd", "source_run_id", "built_at")


@query(WITH + ", touched AS (SELECT DISTINCT order_id FROM fi WHERE date >= DATE '1997-01-01' AND line_id % 2 = 1) SELECT *, 'r1' AS source_run_id FROM fi WHERE order_id NOT IN (SELECT order_id FROM touched) UNION ALL SELECT *, 'r2' FROM fi WHERE date >= DATE '1997-01-01' AND line_id % 2 = 1")
def fact_items_incremental(spark, d):
    t = Tables(spark, d)
    old = t.fact_items()
    new = old.where("date >= '1997-01-01' and line_id % 2 = 1").withColumn("source_run_id", F.lit("r2"))
    return warehouse.reconcile_items(old, new, "incremental").drop("unit_price_usd", "built_at")


def _metric(name: str, sql: str):
    def run(spark, d):
        t = Tables(spark, d)
        return metrics.metric_query(name, t.fact_orders(), t.fact_items())

    run.__name__ = "metric_" + name[4:]
    return query(WITH + sql)(run)


_metric("010_revenue_by_day_country", "SELECT date AS day, country, CAST(sum(total_usd) AS DECIMAL(22,2)) AS paid_revenue_usd, count(*) AS paid_orders FROM o WHERE status = 'paid' GROUP BY 1, 2")
_metric("020_top_products_per_week", "SELECT CAST(date_trunc('week', o.date) AS DATE) AS week_start, fi.sku, CAST(sum(qty) AS BIGINT) AS units, CAST(sum(net_usd) AS DECIMAL(22,2)) AS revenue_usd FROM fi JOIN o USING (order_id) WHERE o.status = 'paid' GROUP BY 1, 2")
_metric("030_paid_vs_refunded_counts", "SELECT country, count(*) FILTER (WHERE status = 'paid') AS paid_orders, count(*) FILTER (WHERE status = 'refunded') AS refunded_orders FROM o GROUP BY 1")
_metric("040_distinct_customers_with_purchases", "SELECT country, count(DISTINCT customer_id) FILTER (WHERE status = 'paid') AS distinct_paid_customers FROM o GROUP BY 1")
_metric("050_fanout_trap_wrong", "SELECT o.date AS day, CAST(sum(o.total_usd) AS DECIMAL(22,2)) AS paid_revenue_usd_wrong FROM o JOIN fi USING (order_id) WHERE status = 'paid' GROUP BY 1")
_metric("051_fanout_trap_right", "SELECT o.date AS day, CAST(sum(x.net) AS DECIMAL(32,2)) AS paid_revenue_usd_right FROM o JOIN (SELECT order_id, sum(net_usd) AS net FROM fi GROUP BY 1) x USING (order_id) WHERE status = 'paid' GROUP BY 1")


# Source records nested from the star schema, so that mapping, lookups and loading run as they do on a source.


#: What orders the lines of an order, and all that its line items are made of: they travel as these numbers, and become text behind the shuffle.
LINE_SORT = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_tax")


def records(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """users, products and carts as a source would give them (numbers as text), with faults: blank names, blank titles, lines
    without quantity, lines without a discounted total, carts without lines."""
    read, c = Tables(spark, d).read, F.col
    text = lambda x: x.cast("string")
    null = F.lit(None).cast("string")
    pad = lambda x: F.concat(F.lit("\t "), x, F.lit("\u00a0"))
    named = read("customer").join(F.broadcast(read("nation").select("n_nationkey", "n_name")), c("c_nationkey") == c("n_nationkey"))  # nation: 25 rows at every scale
    blank = c("c_custkey") % 50 == 0
    users = named.select(
        text(c("c_custkey")).alias("id"), F.when(blank, " ").otherwise(pad(c("c_name"))).alias("firstName"), F.when(blank, "").otherwise(F.when(c("c_custkey") % 3 > 0, c("c_mktsegment"))).alias("lastName"),
        F.concat(F.lit(" "), c("c_name"), F.lit("@Mail.COM")).alias("email"), null.alias("phone"), F.struct(c("c_mktsegment").alias("city"), c("n_name").alias("country")).alias("address"), F.struct(pad(c("c_mktsegment")).alias("name")).alias("company"),
        (c("c_custkey") + 1).cast("bigint").alias("source_ref"), F.lit("{}").alias("raw_payload"),
    )
    products = read("part").select(
        text(c("p_partkey")).alias("id"), F.when(c("p_partkey") % 40 == 0, " ").otherwise(c("p_name")).alias("title"), c("p_type").alias("category"), text(D.money(c("p_retailprice"))).alias("price"), text(c("p_size")).alias("stock"), c("p_brand").alias("brand"),
        text(c("p_size")).alias("discountPercentage"), text((c("p_size") / 10).cast("decimal(6,3)")).alias("rating"), (c("p_partkey") + 1).cast("bigint").alias("source_ref"), F.lit("{}").alias("raw_payload"),
    )

    def line(x):
        ext = D.money(x["l_extendedprice"])
        paid = D.money(ext * (F.lit(1).cast("decimal(8,4)") - D.fraction(x["l_discount"])))
        return F.struct(
            text(x["l_partkey"]).alias("id"), null.alias("title"), text(F.when(x["l_quantity"] <= 2, 0).otherwise(x["l_quantity"]).cast("int")).alias("quantity"), text(ext).alias("price"), text(ext).alias("total"),
            null.alias("discountPercentage"), text(F.when(x["l_linenumber"] % 3 > 0, paid)).alias("discountedTotal"),
        )

    lines = read("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*LINE_SORT))), line).alias("products"), F.sum(F.when(c("l_quantity") <= 2, 0).otherwise(c("l_quantity")).cast("int")).alias("q"))
    empty = F.expr("cast(array() as array<struct<id:string,title:string,quantity:string,price:string,total:string,discountPercentage:string,discountedTotal:string>>)")
    carts = read("orders").join(lines, "o_orderkey", "left").select(
        text(c("o_orderkey")).alias("id"), text(c("o_custkey")).alias("userId"), text(D.money(c("o_totalprice"))).alias("total"), text(D.money(c("o_totalprice"))).alias("discountedTotal"),
        text(F.coalesce(F.size("products"), F.lit(0))).alias("totalProducts"), text(F.coalesce("q", F.lit(0))).alias("totalQuantity"), F.coalesce("products", empty).alias("products"), (c("o_orderkey") + 1).cast("bigint").alias("source_ref"), F.lit("{}").alias("raw_payload"),
    )
    return {"users": users, "products": products, "carts": carts}


def mapped(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    r = records(spark, d)
    return staging.map_all(r["users"], r["products"], r["carts"])


MAPPED = f"""WITH u0 AS (SELECT c_custkey, c_name, c_mktsegment, n_name, c_custkey % 50 = 0 AS blank FROM customer JOIN nation ON c_nationkey = n_nationkey),
u AS (SELECT c_custkey AS customer_id, c_name AS first_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS last_name, c_name || CASE WHEN c_custkey % 3 > 0 THEN ' ' || c_mktsegment ELSE '' END AS full_name,
  lower(c_name) || '@mail.com' AS email, c_mktsegment AS city, n_name AS country, c_mktsegment AS company FROM u0 WHERE NOT blank),
p AS (SELECT p_partkey AS product_id, 'SKU-' || {SLUG('p_type')} || '-' || {SLUG('p_name')} || '-' || p_partkey AS sku, p_name AS title, p_brand AS brand, p_type AS category, {MONEY('p_retailprice')} AS price_usd,
  CAST(p_size / 100.0 AS DECIMAL(8,4)) AS discount_pct, CAST(p_size / 10.0 AS DECIMAL(6,3)) AS rating, p_size AS stock FROM part WHERE p_partkey % 40 <> 0),
l1 AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate, l_tax) AS line_id, l_partkey AS product_id,
  CASE WHEN l_quantity <= 2 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS qty, {MONEY('l_extendedprice')} AS ext, CASE WHEN l_linenumber % 3 > 0 THEN CAST({MONEY('l_extendedprice')} * (CAST(1 AS DECIMAL(8,4)) - CAST(l_discount AS DECIMAL(8,4))) AS DECIMAL(12,2)) END AS disc FROM lineitem),
n AS (SELECT o_orderkey AS order_id, count(l1.order_id) AS lines, coalesce(sum(qty), 0) AS quantity FROM orders LEFT JOIN l1 ON l1.order_id = o_orderkey GROUP BY 1),
b AS (SELECT order_id, lines, quantity, coalesce(sum(lines) OVER (ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 365 AS INTEGER)) + to_minutes((o_custkey * 17 + o_orderkey) % 1440) + to_seconds(o_orderkey % 60), '%Y-%m-%d %H:%M:%S') AS order_ts, u.country,
  CASE WHEN lines = 0 OR quantity = 0 THEN 'canceled' ELSE {STATUS} END AS status, {MONEY('o_totalprice')} AS total_usd, CAST(lines AS INTEGER) AS total_products, CAST(quantity AS INTEGER) AS total_quantity
  FROM orders JOIN b ON b.order_id = o_orderkey LEFT JOIN u ON u.customer_id = o_custkey),
x AS (SELECT l1.*, CAST(before + line_id AS BIGINT) AS source_ref, p.sku FROM l1 JOIN b USING (order_id) LEFT JOIN p USING (product_id)),
i AS (SELECT order_id, CAST(line_id AS INTEGER) AS line_id, source_ref, product_id, sku, qty, ext AS unit_price_usd,
  CASE WHEN disc IS NULL OR ext <= 0 THEN CAST(0 AS DECIMAL(8,4)) ELSE CAST(CAST((20000 * CAST((ext - disc) * 100 AS HUGEINT) + CAST(ext * 100 AS HUGEINT)) // (2 * CAST(ext * 100 AS HUGEINT)) AS DOUBLE) / 10000 AS DECIMAL(8,4)) END AS discount_pct,
  CAST(ext * qty AS DECIMAL(12,2)) AS gross_usd, coalesce(disc, CAST(ext * qty AS DECIMAL(12,2))) AS net_usd FROM x WHERE qty > 0 AND sku IS NOT NULL),
r AS (SELECT 'stg_customers' AS table_name, CAST(c_custkey + 1 AS BIGINT) AS source_ref, 'missing_name' AS reason_code FROM u0 WHERE blank
  UNION ALL SELECT 'stg_products', CAST(p_partkey + 1 AS BIGINT), 'missing_product_fields' FROM part WHERE p_partkey % 40 = 0
  UNION ALL SELECT 'stg_order_items', source_ref, CASE WHEN qty <= 0 THEN 'invalid_quantity' ELSE 'unknown_product' END FROM x WHERE qty <= 0 OR sku IS NULL)
"""


@query(MAPPED + "SELECT * FROM u")
def map_users(spark, d):
    return staging.map_users(records(spark, d)["users"])[0].select("customer_id", "first_name", "last_name", "full_name", "email", "city", "country", "company")


@query(MAPPED + "SELECT * FROM p")
def map_products(spark, d):
    return staging.map_products(records(spark, d)["products"])[0].drop("source_ref", "raw_payload")


@query(MAPPED + "SELECT * FROM o")
def map_cart_orders(spark, d):
    return mapped(spark, d)[0]["stg_orders"].drop("source_ref", "raw_payload").withColumn("order_ts", F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss"))


@query(MAPPED + "SELECT * FROM i")
def map_cart_items(spark, d):
    """Items with all of their money, and with their position among all lines of all carts."""
    return mapped(spark, d)[0]["stg_order_items"].drop("raw_payload")


@query(MAPPED + "SELECT * FROM r")
def map_rejects(spark, d):
    return mapped(spark, d)[1].select("table_name", "source_ref", "reason_code")


@query(MAPPED + """, c AS (SELECT 'stg_customers' AS table_name, count(*) AS n, 0 AS again FROM u UNION ALL SELECT 'stg_products', count(*), 0 FROM p UNION ALL SELECT 'stg_orders', count(*), count(*) FILTER (WHERE order_id % 10 = 0) FROM o UNION ALL SELECT 'stg_order_items', count(*), count(*) FILTER (WHERE order_id % 10 = 0) FROM i),
bad AS (SELECT table_name FROM r UNION ALL SELECT 'stg_order_items' FROM x WHERE order_id % 10 = 0 AND (qty <= 0 OR sku IS NULL))
SELECT c.table_name, c.n AS inserted_count, CAST(any_value(again) AS BIGINT) AS duplicate_reject_count, count(bad.table_name) AS explicit_reject_count FROM c LEFT JOIN bad USING (table_name) GROUP BY 1, 2""")
def load_results(spark, d):
    """Every tenth cart comes twice: its header and its lines are repeats the second time, and its faulty lines rejects again."""
    r = records(spark, d)
    again = r["carts"].where("cast(id as bigint) % 10 = 0").withColumn("source_ref", F.col("source_ref") + (1 << 40))
    users, products = staging.tag_users(r["users"]), staging.tag_products(r["products"])
    known = lambda rows, *columns: rows.where("reason_code is null").select(*columns)
    orders, items = staging.tag_carts(r["carts"].unionByName(again), known(users, "customer_id", "country"), known(products, "product_id", "sku"))
    return staging.load_results(dict(zip(STAGED, (users, products, orders, items))))


SUMMARY = """, t AS (SELECT table_name, count(*) AS rejects, count(DISTINCT reason_code) AS reasons FROM r GROUP BY 1), c AS (SELECT 'stg_customers' AS table_name, 0 AS relations, 0 AS broken UNION ALL SELECT 'stg_products', 0, 0
UNION ALL SELECT 'stg_orders', 1, CAST((SELECT count(*) FROM o WHERE customer_id NOT IN (SELECT customer_id FROM u)) > 0 AS INTEGER) UNION ALL SELECT 'stg_order_items', 2, 0)
SELECT c.table_name, CAST(4 + relations + coalesce(reasons, 0) AS BIGINT) AS metrics_written, CAST(broken + CASE WHEN rejects > 0 THEN 2 + reasons ELSE 0 END AS BIGINT) AS failed_metrics, broken = 0 AND rejects IS NULL AS passed FROM c LEFT JOIN t USING (table_name)"""


@query(MAPPED + SUMMARY)
def dq_summary(spark, d):
    rows, bad = mapped(spark, d)
    return quality.summary(quality.run_stage_dq(rows, bad))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of as many runs as there are orders."""
    c = F.col
    o = Tables(spark, d).read("orders").select("o_orderkey", "o_orderstatus", c("o_orderdate").cast("timestamp").alias("at"))
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c("o_orderkey") % 86400).cast("int"))
    return o.select(
        c("o_orderkey").cast("string").alias("run_id"), F.concat(F.lit("s"), c("o_orderkey") % 3).alias("source_system"), F.element_at(F.array(*map(F.lit, ("snapshot", "live", "incremental", "incremental"))), (c("o_orderkey") % 4 + 1).cast("int")).alias("mode"),
        F.when(c("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"), c("at").alias("started_at"), F.when(c("o_orderkey") % 11 > 0, c("at") + second).alias("finished_at"),
        F.when(c("o_orderkey") % 5 > 0, "order_ts").otherwise("other").alias("watermark_column"), F.when(c("o_orderkey") % 7 > 0, c("at")).alias("watermark_high"),
    )


LEDGER = """WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 's' || o_orderkey % 3 AS source_system, ['snapshot', 'live', 'incremental', 'incremental'][o_orderkey % 4 + 1] AS mode, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'failed' END AS status, o_orderdate AS started_at,
CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate + to_seconds(o_orderkey % 86400) END AS finished_at, CASE WHEN o_orderkey % 5 > 0 THEN 'order_ts' ELSE 'other' END AS watermark_column, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS watermark_high FROM orders), """
LATEST = "latest AS (SELECT run_id FROM l WHERE status = 'succeeded' ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS FIRST LIMIT 1) "


@query(LEDGER + "w AS (SELECT run_id, strftime(watermark_high, '%Y-%m-%d %H:%M:%S') AS watermark_high FROM l WHERE status = 'succeeded' AND mode = 'incremental' AND source_system = 's1' AND watermark_column = 'order_ts' AND watermark_high IS NOT NULL ORDER BY finished_at DESC NULLS FIRST, started_at DESC NULLS FIRST, run_id DESC LIMIT 1) SELECT * FROM w")
def latest_watermark(spark, d):
    from tallyforge.sources.window import latest_watermark as top

    return top(ledger(spark, d), "s1", "order_ts").select("run_id", F.date_format("watermark_high", "yyyy-MM-dd HH:mm:ss").alias("watermark_high"))


@query(LEDGER + LATEST + "SELECT run_id FROM latest")
def latest_succeeded_run(spark, d):
    from tallyforge.sources.window import latest_succeeded

    return latest_succeeded(ledger(spark, d)).select("run_id")


def _views(spark, d) -> dict[str, DataFrame]:
    """The views over dimension and quality rows of all runs of the ledger: a customer's row is of the run that ended last in its
    nation, and each run has stored two metrics of its lines."""
    t, c = Tables(spark, d), F.col
    runs = ledger(spark, d)
    of_nation = t.read("customer").select("c_custkey", c("c_nationkey").alias("nation"))
    ended = runs.where("status = 'succeeded'").join(t.read("orders").select(c("o_orderkey").cast("string").alias("run_id"), c("o_custkey").alias("c_custkey")), "run_id").join(of_nation, "c_custkey")
    # by the end, nulls last, then by the start
    last = ended.groupBy("nation").agg(F.max_by("run_id", F.struct(F.coalesce(c("finished_at"), F.lit("0001-01-01").cast("timestamp")).alias("a"), c("started_at").alias("b"))).alias("source_run_id"))
    dim = warehouse.dim_customer(t.customers(), "x", AT).drop("source_run_id").join(of_nation.withColumnRenamed("c_custkey", "customer_id").join(F.broadcast(last), "nation"), "customer_id").drop("nation")  # a row for each of 25 nations
    lines = t.read("lineitem").groupBy(c("l_orderkey").cast("string").alias("run_id"), "l_linenumber").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.sum("n").alias("rows"), F.count_if(c("n") > 1).alias("repeated"))
    metric = lambda name, value: F.struct(F.lit(name).alias("metric_name"), D.six_places(c(value)).alias("metric_value"))
    dq = lines.select("run_id", F.explode(F.array(metric("row_count", "rows"), metric("duplicate_keys.count", "repeated"))).alias("m")).select("run_id", "m.*")
    return views.view_frames({"dim_customer": dim, "fact_orders": t.fact_orders(), "fact_order_items": t.fact_items()}, dq, runs)


@query(LEDGER + LATEST + """, n AS (SELECT c_nationkey AS nation, run_id AS source_run_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS FIRST) AS k FROM l JOIN orders ON CAST(o_orderkey AS VARCHAR) = run_id JOIN customer ON c_custkey = o_custkey WHERE status = 'succeeded')
SELECT c_custkey AS customer_id, trim(c_name) AS full_name, n_name AS country, source_run_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN n ON n.nation = c_nationkey AND k = 1 WHERE source_run_id IN (SELECT run_id FROM latest)""")
def view_dim_customer_latest(spark, d):
    return _views(spark, d)["v_dim_customer_latest"].select("customer_id", "full_name", "country", "source_run_id")


@query(WITH + FO + " FROM o")
def view_fact_orders_current(spark, d):
    return _views(spark, d)["v_fact_orders_current"].drop("order_ts", "source_run_id", "built_at")


@query(WITH + FO + " FROM o")
def view_fact_orders_latest(spark, d):
    return _views(spark, d)["v_fact_orders_latest"].drop("order_ts", "source_run_id", "built_at")


@query(WITH + "SELECT * FROM fi")
def view_fact_order_items_current(spark, d):
    return _views(spark, d)["v_fact_order_items_current"].drop("unit_price_usd", "source_run_id", "built_at")


@query(WITH + "SELECT * FROM fi")
def view_fact_order_items_latest(spark, d):
    return _views(spark, d)["v_fact_order_items_latest"].drop("unit_price_usd", "source_run_id", "built_at")


@query(LEDGER + LATEST + """, k AS (SELECT l_linenumber, count(*) AS n FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT run_id FROM latest) GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) FILTER (WHERE n > 1) AS repeated FROM k HAVING count(*) > 0)
SELECT run_id, 'row_count' AS metric_name, CAST(n AS DECIMAL(18,6)) AS metric_value FROM latest, s UNION ALL SELECT run_id, 'duplicate_keys.count', CAST(repeated AS DECIMAL(18,6)) FROM latest, s""")
def view_dq_results_latest(spark, d):
    return _views(spark, d)["v_dq_results_latest"].select("run_id", "metric_name", "metric_value")


@query(WITH + ", y AS (SELECT DISTINCT date FROM o WHERE date < DATE '1997-01-01') SELECT date, 'r1' AS built FROM y UNION ALL SELECT CAST(d AS DATE), 'r2' FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM o) WHERE CAST(d AS DATE) NOT IN (SELECT date FROM y)")
def dim_date_append_only(spark, d):
    """Dates that are there already keep their row; the others come with the new run."""
    t = Tables(spark, d)
    old = t.fact_orders().where("date < '1997-01-01'").select("date").distinct().withColumn("built", F.lit("r1"))
    return warehouse.append_new(old, warehouse.calendar(t.orders()).select("date", F.lit("r2").alias("built")), ["date"])


#: Promises about the star schema, some of which its rows break.
STAR_RULES = {
    "customer": Rules(("c_custkey", "c_name"), (), ("c_custkey",), (("c_nationkey", "nation", "n_nationkey"),)),
    "orders": Rules(("o_orderkey", "o_custkey"), (("status", "o_orderstatus in ('F', 'O')"), ("price", "o_totalprice > 1000")), ("o_orderkey",), (("o_custkey", "customer", "c_custkey"),)),
    "lineitem": Rules(("l_orderkey", "l_linenumber"), (("quantity", "l_quantity between 1 and 40"),), ("l_orderkey", "l_linenumber"), (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"))),
    "events": Rules(("event_id", "user_id"), (), (), (("user_id", "part", "p_partkey"),)),
}


def _rules_sql() -> str:
    out = []
    for table, r in STAR_RULES.items():
        row = lambda rule, n: f"SELECT '{table}' AS table_name, '{rule}' AS rule, {n} AS n"  # noqa: B023, E731
        out += [row(f"not_null({c})", "count(*)") + f" FROM {table} WHERE {c} IS NULL" for c in r.not_null]
        out += [row(f"check({name})", "count(*)") + f" FROM {table} WHERE NOT ({sql})" for name, sql in r.checks]
        if r.key:
            out.append(row(f"unique({', '.join(r.key)})", "count(*)") + f" FROM (SELECT 1 FROM {table} GROUP BY {', '.join(r.key)} HAVING count(*) > 1)")
        out += [row(f"references({c}: {other}.{key})", "count(*)") + f" FROM {table} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM {other})" for c, other, key in r.references]
    return " UNION ALL ".join(out)


@query(_rules_sql())
def constraint_violations(spark, d):
    read = Tables(spark, d).read
    return constraints.violations({t: read(t) for t in (*STAR_RULES, "nation", "part")}, STAR_RULES)


def search_orders_of(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a search service gives them, as JSON: guests, foreign money, tenders, refunds, and lines without a quantity, with
    a broken one, in no catalogue, or without a gross amount."""
    read, c = Tables(spark, d).read, F.col
    cents = lambda x: (D.money(x) * 100).cast("bigint")
    text = lambda x: x.cast("string")
    usd = lambda x: F.struct(x.alias("amount"), F.lit("USD").alias("currency"))

    def line(x):
        qty, base = x["l_quantity"].cast("int"), cents(x["l_extendedprice"])
        gross = base * qty
        return F.struct(
            text(x["l_linenumber"]).alias("uid"), F.concat(F.lit(" part "), text(x["l_partkey"])).alias("name"), F.when(qty <= 2, "0").when(qty == 13, "13.5").otherwise(text(qty)).alias("quantity"), F.when(x["l_partkey"] % 5 > 0, F.concat(F.lit("P-"), text(x["l_partkey"]))).alias("catalog_object_id"),
            usd(base).alias("base_price_money"), F.when(x["l_linenumber"] % 3 > 0, usd(gross)).alias("gross_sales_money"), F.when(x["l_linenumber"] % 2 > 0, usd(F.floor(gross * (x["l_discount"] * 100).cast("decimal(4,0)") / 100).cast("bigint"))).alias("total_discount_money"),
        )

    lines = read("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*LINE_SORT))), line).alias("line_items"))
    total, key = cents(c("o_totalprice")), c("o_orderkey")
    pay = lambda when, amount: F.when(when, F.array(F.struct(F.lit("COMPLETED").alias("status"), usd(amount).alias("amount_money"))))
    orders = read("orders").join(lines, "o_orderkey", "left").select(
        (key + 1).alias("source_ref"),
        F.to_json(F.struct(
            F.concat(F.lit("O-"), text(key)).alias("id"), F.when(c("o_custkey") % 10 > 0, F.concat(F.lit("C-"), text(c("o_custkey")))).alias("customer_id"), F.element_at(F.create_map(*(F.lit(x) for x in ("F", "COMPLETED", "O", "OPEN", "P", "CANCELED"))), c("o_orderstatus")).alias("state"),
            F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.struct(total.alias("amount"), F.when(key % 97 == 0, "EUR").otherwise("USD").alias("currency")).alias("total_money"), "line_items",
            pay(key % 4 == 0, total).alias("tenders"), pay(key % 20 == 0, F.lit(100).cast("bigint")).alias("refunds"),
        )).alias("raw_payload"),
    )
    return search_orders.parsed(orders)


SEARCHED = f"""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate, l_tax) AS line_id, CAST(l_quantity AS INTEGER) AS q,
  CAST({MONEY('l_extendedprice')} * 100 AS BIGINT) AS base, CAST(l_discount * 100 AS DECIMAL(4,0)) AS pct FROM lineitem),
g AS (SELECT *, CASE WHEN l_linenumber % 3 > 0 THEN base * q WHEN q <= 2 THEN 0 ELSE base * q END AS gross, CASE WHEN l_linenumber % 2 > 0 THEN CAST(floor(CAST(base * q AS HUGEINT) * CAST(pct AS HUGEINT) // 100) AS BIGINT) ELSE 0 END AS off FROM l),
i AS (SELECT g.*, CASE WHEN l_orderkey % 97 = 0 THEN 'rejected_order' WHEN q <= 2 THEN 'invalid_quantity' WHEN q = 13 THEN 'fractional_quantity' END AS why FROM g),
n AS (SELECT l_orderkey, count(*) AS lines, sum(CASE WHEN q <= 2 THEN 0 WHEN q = 13 THEN 13.5 ELSE q END) AS units FROM l GROUP BY 1)
"""


@query(SEARCHED + f"""SELECT CAST(o_orderkey + 1 AS BIGINT) AS source_ref, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS order_ts, CASE WHEN o_orderstatus = 'P' THEN 'canceled' WHEN o_orderkey % 20 = 0 THEN 'refunded' WHEN o_orderstatus = 'F' OR o_orderkey % 4 = 0 THEN 'paid' ELSE 'pending' END AS status, {MONEY('o_totalprice')} AS total_usd,
CAST(coalesce(lines, 0) AS INTEGER) AS total_products, CAST(floor(coalesce(units, 0)) AS INTEGER) AS total_quantity, o_custkey % 10 = 0 AS guest FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WHERE o_orderkey % 97 > 0""")
def search_order_headers(spark, d):
    rows = staging.parted(search_orders.tag_orders(search_orders_of(spark, d)), "stg_orders")[0]
    return rows.select("source_ref", F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss").alias("order_ts"), "status", "total_usd", "total_products", "total_quantity", (F.col("customer_id") == 0).alias("guest"))


@query(SEARCHED + """SELECT CAST((l_orderkey + 1) * 10000 + line_id AS BIGINT) AS source_ref, CAST(line_id AS INTEGER) AS line_id, q AS qty, CAST(base / 100.0 AS DECIMAL(12,2)) AS unit_price_usd, CAST(gross / 100.0 AS DECIMAL(12,2)) AS gross_usd, CAST((gross - least(off, gross)) / 100.0 AS DECIMAL(12,2)) AS net_usd,
CAST(CAST(CASE WHEN gross > 0 THEN (20000 * CAST(least(off, gross) AS HUGEINT) + gross) // (2 * CAST(gross AS HUGEINT)) ELSE 0 END AS DOUBLE) / 10000 AS DECIMAL(8,4)) AS discount_pct FROM i WHERE why IS NULL""")
def search_order_items(spark, d):
    return staging.parted(search_orders.tag_items(search_orders_of(spark, d)), "stg_order_items")[0].select("source_ref", "line_id", "qty", "unit_price_usd", "gross_usd", "net_usd", "discount_pct")


@query(SEARCHED + "SELECT 'stg_orders' AS table_name, CAST(o_orderkey + 1 AS BIGINT) AS source_ref, 'unsupported_currency' AS reason_code FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'stg_order_items', CAST((l_orderkey + 1) * 10000 + line_id AS BIGINT), why FROM i WHERE why IS NOT NULL")
def search_order_rejects(spark, d):
    return search_orders.rejects(search_orders_of(spark, d)).select("table_name", "source_ref", "reason_code")


@query(SEARCHED + """, k AS (SELECT DISTINCT CASE WHEN l_partkey % 5 > 0 THEN 'P-' || l_partkey ELSE 'name:part ' || l_partkey END AS key, 'part ' || l_partkey AS title FROM l WHERE l_orderkey % 97 > 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)),
p AS (SELECT title, count(*) AS products FROM k GROUP BY 1) SELECT 'product' AS kind, title AS name, products AS n FROM p
UNION ALL SELECT 'customer', CASE WHEN o_custkey % 10 = 0 THEN 'guest' ELSE 'customer C-' || o_custkey END, 1 FROM orders WHERE o_orderkey % 97 > 0 GROUP BY 1, 2""")
def search_order_dimensions(spark, d):
    """Customers and products that the orders tell of, once each."""
    o = search_orders_of(spark, d)
    named = lambda rows, kind, name: rows.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return named(search_orders.tag_products(o), "product", "title").unionByName(named(search_orders.tag_customers(o), "customer", "full_name"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["metric_revenue_by_day_country"](spark, d)
