"""Pass or fail from stored metrics. The metric table has a few tens of rows, so it is judged on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.schemas import STAGED

#: Limits of the reject rate outside snapshot mode.
HARD_RATE, WARN_RATE = Decimal("0.010000"), Decimal("0.005000")
RELATIONS = {"stg_orders": ("missing_customers.count",), "stg_order_items": ("missing_products.count", "orphan_orders.count")}


@dataclass(frozen=True)
class GateDecision:
    passed: bool
    failures: tuple[str, ...] = ()
    warnings: tuple[str, ...] = field(default=())


def evaluate(metrics: dict[tuple[str, str], Decimal], mode: str) -> GateDecision:
    """metrics: (table, metric) -> value. A metric that is missing is an error, not a pass."""

    def value(table: str, name: str) -> Decimal:
        if (table, name) not in metrics:
            raise ValueError(f"metric {name} of {table} is missing")
        return Decimal(metrics[table, name])

    hard, soft = [], []
    for t in STAGED:
        if value(t, "row_count") == 0:
            soft.append(f"{t}: row_count is 0")
        if value(t, "duplicate_keys.count") != 0:
            hard.append(f"{t}: duplicate keys")
        rate = value(t, "reject_rows.reject_rate")
        if mode == "snapshot":
            if rate != 0:
                hard.append(f"{t}: reject_rate {rate} in a snapshot")
        elif rate > HARD_RATE:
            hard.append(f"{t}: reject_rate {rate} > {HARD_RATE}")
        elif rate > WARN_RATE:
            soft.append(f"{t}: reject_rate {rate} > {WARN_RATE}")
        for m in RELATIONS.get(t, ()):
            if value(t, m) != 0:
                hard.append(f"{t}: {m} is {value(t, m)}")
    return GateDecision(not hard, tuple(hard), tuple(soft))


def evaluate_frame(dq: DataFrame, mode: str) -> GateDecision:
    return evaluate({(r["table_name"], r["metric_name"]): r["metric_value"] for r in dq.select("table_name", "metric_name", "metric_value").collect()}, mode)


def gate_rows(dq: DataFrame, mode: str) -> DataFrame:
    """The same judgement as rows: table_name, metric_name, metric_value, severity (hard or soft) of each metric that offends."""
    v, m = F.col("metric_value"), F.col("metric_name")
    rate = m == "reject_rows.reject_rate"
    strict = m.isin("duplicate_keys.count", "missing_customers.count", "missing_products.count", "orphan_orders.count")
    hard = (strict & (v != 0)) | (rate & (v != 0 if mode == "snapshot" else v > F.lit(HARD_RATE)))
    soft = ((m == "row_count") & (v == 0)) | (rate & (v > F.lit(WARN_RATE)) & F.lit(mode != "snapshot"))
    return dq.withColumn("severity", F.when(hard, "hard").when(soft, "soft")).where("severity is not null").select("table_name", "metric_name", "metric_value", "severity")
