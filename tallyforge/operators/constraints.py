"""Constraints of tables: columns that may not be null, conditions, keys and references, each violation named and counted.

Conditions on single rows are aggregates, so all of a table's are counted in one pass, or, as an Observation, in the pass that
writes it. A key costs one grouping, a reference one anti join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    def __init__(self, table: str, broken: dict[str, int]):
        super().__init__(f"{table}: " + "; ".join(f"{rule} broken {n} times" for rule, n in sorted(broken.items())))
        self.table, self.broken = table, broken


@dataclass(frozen=True)
class Rules:
    not_null: tuple[str, ...] = ()
    #: name -> SQL condition; null counts as fulfilled
    checks: tuple[tuple[str, str], ...] = ()
    key: tuple[str, ...] = ()
    #: (column, other table, its column); null refers to nothing
    references: tuple[tuple[str, str, str], ...] = ()


#: What the tables promise. Values of modes and statuses are fixed.
RULES = {
    "run_ledger": Rules(("run_id", "source_system", "mode", "started_at", "status", "args_json"), (("mode", "mode in ('snapshot', 'live', 'incremental')"), ("status", "status in ('running', 'succeeded', 'failed')"), ("window", "watermark_low <= watermark_high")), ("run_id",)),
    "stg_customers": Rules(("customer_id",), (), ("customer_id",)),
    "stg_products": Rules(("product_id",), (), ("product_id",)),
    "stg_orders": Rules(("order_id", "customer_id"), (), ("order_id",)),
    "stg_order_items": Rules(("order_id", "line_id"), (), ("order_id", "line_id")),
    "reject_rows": Rules(("run_id", "table_name", "source_ref", "raw_payload", "reason_code", "reason_detail", "rejected_at"), (), (), (("run_id", "run_ledger", "run_id"),)),
    "dq_results": Rules(("run_id", "table_name", "check_name", "metric_name", "metric_value", "passed", "details_json", "created_at"), (), ("run_id", "table_name", "check_name", "metric_name"), (("run_id", "run_ledger", "run_id"),)),
    "dim_customer": Rules(("customer_id", "source_run_id", "built_at"), (), ("customer_id",)),
    "dim_date": Rules(("date", "year", "month", "day", "iso_week", "iso_dow", "quarter", "week_start", "month_start", "built_at"), (("iso_dow", "iso_dow between 1 and 7"),), ("date",)),
    "fact_orders": Rules(("order_id", "customer_id", "source_run_id", "built_at"), (), ("order_id",)),
    "fact_order_items": Rules(("order_id", "line_id", "source_run_id", "built_at"), (), ("order_id", "line_id")),
}


def row_rules(table: str) -> Rules:
    return RULES.get(table, Rules())


def observed(rules: Rules) -> dict[str, Column]:
    """rule -> count of the rows that break it, of each rule on single rows."""
    broken = {f"not_null({c})": F.col(c).isNull() for c in rules.not_null} | {f"check({name})": ~F.expr(sql) for name, sql in rules.checks}
    return {rule: F.count_if(x).alias(rule) for rule, x in broken.items()}


def violations(tables: dict[str, DataFrame], rules: dict[str, Rules] = RULES) -> DataFrame:
    """table_name, rule, n of every rule of the tables given; n is 0 where it holds."""
    out: list[DataFrame] = []
    for name, rows in tables.items():
        r = rules.get(name, Rules())
        if counts := observed(r):
            one = rows.agg(*counts.values())
            out.append(one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in counts))).alias("v")).select(F.lit(name).alias("table_name"), "v.*"))
        if r.key:
            groups = rows.groupBy(*r.key).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
            out.append(groups.select(F.lit(name).alias("table_name"), F.lit(f"unique({', '.join(r.key)})").alias("rule"), "n"))
        for column, other, key in r.references:
            if other in tables:
                lost = rows.where(F.col(column).isNotNull()).join(tables[other].select(F.col(key).alias(column)), column, "left_anti")
                out.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(f"references({column}: {other}.{key})").alias("rule"), "n"))
    if not out:
        raise ValueError("no table with rules")
    return reduce(DataFrame.unionByName, out)


def enforce(tables: dict[str, DataFrame], rules: dict[str, Rules] = RULES) -> None:
    """An error that names every rule of a table that is broken."""
    for r in violations(tables, rules).where("n > 0").orderBy("table_name").groupBy("table_name").agg(F.map_from_entries(F.collect_list(F.struct("rule", "n"))).alias("broken")).collect():  # a row for each table
        raise ConstraintError(r["table_name"], r["broken"])
