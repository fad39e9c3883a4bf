"""Data-quality metrics of staged tables, one DataFrame of metric rows a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.derive import six_places
from tallyforge.schemas import staging_spec


def _metric(df: DataFrame, table: str, check: str, name: str | Column, value: Column, passed: Column, details: dict[str, Column] | None = None) -> DataFrame:
    n = F.lit(name) if isinstance(name, str) else name
    more = F.to_json(F.struct(*(c.alias(k) for k, c in details.items()))) if details else F.lit("{}")
    return df.select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), n.alias("metric_name"), six_places(value).alias("metric_value"), passed.alias("passed"), more.alias("details_json"))


def duplicate_groups(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """n: number of keys that stand in more than one row."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"))


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_first("n"), F.asc_nulls_last("reason_code"))


def _rows_of(one: DataFrame, table: str, metrics: list[tuple[str, str, Column, Column, dict[str, Column]]]) -> DataFrame:
    """Several metrics (check, name, value, passed, details) of a one-row aggregate, without computing it again for each."""
    as_row = lambda check, name, value, passed, details: F.struct(F.lit(check).alias("check_name"), F.lit(name).alias("metric_name"), six_places(value).alias("metric_value"), passed.alias("passed"), (F.to_json(F.struct(*(c.alias(k) for k, c in details.items()))) if details else F.lit("{}")).alias("details_json"))
    return one.select(F.explode(F.array(*(as_row(*m) for m in metrics))).alias("m")).select(F.lit(table).alias("table_name"), "m.*")


def table_size(rows: DataFrame, table: str) -> DataFrame:
    """n, repeated: rows, and keys that stand in more than one of them, in one scan."""
    by_key = rows.groupBy(*staging_spec(table).key).agg(F.count(F.lit(1)).alias("c"))
    return by_key.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 1).alias("repeated"))


def _size_metrics(table: str) -> list[tuple]:
    key = F.array(*map(F.lit, staging_spec(table).key))
    return [
        ("stage_volume", "row_count", F.col("n"), F.col("n") > 0, {}),
        ("stage_keys", "duplicate_keys.count", F.col("repeated"), F.col("repeated") == 0, {"key": key}),
    ]


def volume_and_keys(rows: DataFrame, table: str) -> DataFrame:
    return _rows_of(table_size(rows, table), table, _size_metrics(table))


def _reject_metrics(table: str) -> list[tuple]:
    """Total and rate (rejects to staged rows; 0 without staged rows) from the columns rejects and n."""
    rate = F.when(F.col("n") > 0, F.col("rejects").cast("decimal(18,6)") / F.when(F.col("n") > 0, F.col("n"))).otherwise(F.lit(0))
    return [
        ("stage_rejects", "reject_rows.total", F.col("rejects"), F.col("rejects") == 0, {}),
        ("stage_rejects", "reject_rows.reject_rate", rate, rate == 0, {"rejects": F.col("rejects"), "staged_rows": F.col("n")}),
    ]


def _reasons(rejects: DataFrame, table: str) -> DataFrame:
    return rejects.where(F.col("table_name") == table).groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


def _with_rejects(size: DataFrame, reasons: DataFrame) -> DataFrame:
    return size.crossJoin(reasons.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rejects")))  # one row each


def _reason_metrics(reasons: DataFrame, table: str) -> DataFrame:
    return _metric(reasons, table, "stage_rejects", F.concat(F.lit("reason_code."), "reason_code", F.lit(".count")), F.col("n"), F.lit(False), {"reason_code": F.col("reason_code")})


def reject_metrics(rows: DataFrame, rejects: DataFrame, table: str) -> DataFrame:
    """Total, rate and one metric for each reason seen."""
    reasons = _reasons(rejects, table)
    one = _with_rejects(rows.agg(F.count(F.lit(1)).alias("n")), reasons)
    return _rows_of(one, table, _reject_metrics(table)).unionByName(_reason_metrics(reasons, table))


def missing(child: DataFrame, parent: DataFrame, key: str, table: str, metric: str) -> DataFrame:
    """Rows of child whose non-null key is not in parent, as a left anti join."""
    found = child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return _metric(found, table, "stage_relations", metric, F.col("n"), F.col("n") == 0, {"join_key": F.lit(key), "missing_rows": F.col("n")})


#: table -> (parent, key, metric) of its relations.
RELATIONS = {
    "stg_orders": (("stg_customers", "customer_id", "missing_customers.count"),),
    "stg_order_items": (("stg_products", "product_id", "missing_products.count"), ("stg_orders", "order_id", "orphan_orders.count")),
}


def table_dq(staged: dict[str, DataFrame], rejects: DataFrame, table: str) -> DataFrame:
    """All metrics of one staged table: its rows are read once for size, keys and rate, and once for each relation."""
    staging_spec(table)
    reasons = _reasons(rejects, table)
    out = _rows_of(_with_rejects(table_size(staged[table], table), reasons), table, _size_metrics(table) + _reject_metrics(table))
    out = out.unionByName(_reason_metrics(reasons, table))
    for parent, key, metric in RELATIONS.get(table, ()):
        out = out.unionByName(missing(staged[table], staged[parent], key, table, metric))
    return out


def run_stage_dq(staged: dict[str, DataFrame], rejects: DataFrame) -> DataFrame:
    """All metrics of the four staged tables."""
    return reduce(DataFrame.unionByName, (table_dq(staged, rejects, t) for t in staged))


def summary(dq: DataFrame) -> DataFrame:
    """table_name, metrics_written, failed_metrics, passed."""
    return dq.groupBy("table_name").agg(F.count(F.lit(1)).alias("metrics_written"), F.count_if(~F.col("passed")).alias("failed_metrics"), F.every("passed").alias("passed"))
