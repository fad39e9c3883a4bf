"""Snapshots: one JSON envelope a resource, {resource: [...], total, skip, limit}."""

from __future__ import annotations

import itertools
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.schemas import RECORDS
from tallyforge.sources.files import Files

#: Conditions that every record must meet; one that does not fails the whole page.
_int = lambda c, low: f"coalesce(try_cast({c} as decimal(38,6)) = floor(try_cast({c} as decimal(38,6))) and try_cast({c} as decimal(38,6)) >= {low}, false)"
_num = lambda c: f"coalesce(try_cast({c} as double) >= 0 and not isnan(try_cast({c} as double)), false)"
_opt = lambda c, rule: f"({c} is null or {rule})"
_text = lambda c: f"coalesce(trim({c}) <> '', false)"
_pct = lambda c: _opt(c, f"coalesce(try_cast({c} as double) between 0 and 100, false)")
VALID = {
    "users": " and ".join([_int("id", 1), _text("firstName"), _text("lastName")]),
    "products": " and ".join([_int("id", 1), _text("title"), _text("category"), _num("price"), _int("stock", 0), _pct("discountPercentage"), _opt("rating", _num("rating"))]),
    "carts": " and ".join([_int("id", 1), _int("userId", 1), _num("total"), _num("discountedTotal"), _int("totalProducts", 0), _int("totalQuantity", 0), "products is not null", f"forall(products, p -> {' and '.join([_int('p.id', 1), _int('p.quantity', 0), _num('p.price'), _num('p.total'), _pct('p.discountPercentage'), _opt('p.discountedTotal', _num('p.discountedTotal'))])})"]),
}


def checked_records(rows: DataFrame, name: str, where: str) -> DataFrame:
    """rows, or an error if any of them is invalid: one bad record fails its whole source."""
    bad = rows.where(f"not ({VALID[name]})").agg(F.count(F.lit(1)).alias("n"), F.min("source_ref").alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{where}: {bad['n']} invalid records, the first at position {bad['first']}")
    return rows


def read_resource(spark: SparkSession, root: str | Path, name: str) -> DataFrame:
    """Records of a resource with source_ref (1-based position) and raw_payload. Raises if any record is invalid.

    <root>/<name>.json is one envelope, read by one task. For large inputs, <root>/<name>.jsonl is a folder of JSON Lines and
    <root>/<name>.parquet one of Parquet files, read in parallel; their rows carry their source_ref.
    """
    files = Files(spark, root)
    for kind, reader in (("jsonl", "json"), ("parquet", "parquet")):
        if files.exists(f"{name}.{kind}"):
            rows = spark.read.schema(f"{RECORDS[name]}, source_ref bigint").format(reader).load(files.path(f"{name}.{kind}"))
            fields = [c for c in rows.columns if c != "source_ref"]
            return checked_records(rows.withColumn("raw_payload", F.to_json(F.struct(*fields))), name, f"{name}.{kind}")
    if not files.exists(f"{name}.json"):
        raise FileNotFoundError(files.path(f"{name}.json"))
    page = spark.read.schema(f"{name} array<struct<{', '.join(c.replace(' ', ':', 1) for c in _fields(RECORDS[name]))}>>, total string, skip string, limit string").option("multiLine", True).json(files.path(f"{name}.json"))
    ok = page.select(F.expr(f"{name} is not null and {_int('total', 0)} and {_int('skip', 0)} and {_int('limit', 1)}").alias("ok")).collect()
    if len(ok) != 1 or not ok[0]["ok"]:
        raise ValueError(f"{name}.json is not a page of {name}")
    rows = page.select(F.posexplode(name).alias("pos", "r")).select("r.*", (F.col("pos") + 1).cast("bigint").alias("source_ref"), F.to_json("r").alias("raw_payload"))
    return checked_records(rows, name, f"{name}.json")


def snapshot_root_for_key(key: str, base: str | Path | None = None) -> str:
    """The folder of a named snapshot."""
    return f"{str(base or 'data/snapshots').rstrip('/')}/dummyjson/{key}"


def _fields(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for ch in ddl + ",":
        if ch == "," and depth == 0:
            out.append(word.strip())
            word = ""
            continue
        depth += (ch == "<") - (ch == ">")
        word += ch
    return out


def read_snapshot(spark: SparkSession, root: str | Path) -> dict[str, DataFrame]:
    return {n: read_resource(spark, root, n) for n in RECORDS}


def write_resource(root: str | Path, name: str, rows: DataFrame, page_size: int) -> str:
    """One envelope of a resource's records (source_ref, raw_payload), in their order, put in place whole, on any file system.

    Records pass through the driver one by one, as an envelope is one JSON document; a resource too large for that is written
    with rows.write as JSON Lines instead, which read_resource reads as well.
    """
    files = Files(rows.sparkSession, root)
    ordered = rows.orderBy("source_ref").select("raw_payload").persist()
    try:
        n = ordered.count()
        head = json.dumps({"limit": page_size or max(n, 1), "skip": 0, "total": n})[:-1]
        records = (r["raw_payload"] for r in ordered.toLocalIterator())
        pieces = itertools.chain([f"{head}, {json.dumps(name)}: [\n"], (f"{', ' if k else ''}{x}\n" for k, x in enumerate(records)), ["]}\n"])
        files.write_all(f"{name}.json", pieces)
    finally:
        ordered.unpersist()
    return files.path(f"{name}.json")


def write_snapshot(spark: SparkSession, bundle: dict[str, list[dict]], root: str | Path, page_size: int | None = None) -> dict[str, str]:
    """A snapshot of records that are at hand; the files written, by resource."""
    out = {}
    for name, records in bundle.items():
        rows = spark.createDataFrame([(k, json.dumps(x, sort_keys=True)) for k, x in enumerate(records, 1)], "source_ref bigint, raw_payload string")
        out[name] = write_resource(root, name, rows, page_size or 0)
    return out
