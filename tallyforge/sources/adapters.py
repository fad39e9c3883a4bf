"""Source systems behind one contract, and the registry of those that runs may name."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.derive import ORDER_TS_HIGH, order_ts
from tallyforge.operators import search_orders
from tallyforge.schemas import RECORDS
from tallyforge.session import counted, package_on_workers
from tallyforge.sources.landing import Landing
from tallyforge.sources.pages import PagedResource
from tallyforge.sources.snapshot import checked_records, read_snapshot, write_resource
from tallyforge.sources.window import ExtractionWindow, in_window


@dataclass(frozen=True)
class PullResult:
    """records: users, products and carts, or orders, with source_ref and raw_payload. meta: what was pulled, and how."""

    records: dict[str, DataFrame]
    meta: dict[str, Any] = field(default_factory=dict)


class SourceAdapter(Protocol):
    source_system: str

    def validate_watermark_column(self, column: str) -> None: ...

    def default_high_watermark(self, column: str, run_started_at: datetime) -> datetime | None: ...

    def pull_full(self, spark: SparkSession, page_size: int, landing: Landing) -> PullResult: ...

    def pull_incremental(self, spark: SparkSession, page_size: int, window: ExtractionWindow, landing: Landing) -> PullResult: ...


def parsed(raw: DataFrame, name: str) -> DataFrame:
    """Records of one resource, as a snapshot's would be, of source_ref and raw_payload."""
    rows = raw.select(F.from_json("raw_payload", RECORDS[name]).alias("r"), "source_ref", "raw_payload").select("r.*", "source_ref", "raw_payload")
    return checked_records(rows, name, name)


class ShopSource:
    """The three paged resources of the demo shop. It keeps no change times, so an incremental pull is a full pull whose carts are
    filtered by their derived order time; users and products stay whole.

    Executors read the pages and write them to the run's landing folder, once; no page comes to the driver.
    """

    source_system = "dummyjson"

    def __init__(self, url: str | None = None, **options: object):
        """options: of the data source (readers, interval_s, max_pages)."""
        self.options = {"url": url or os.environ.get("SHOP_BASE_URL", "https://dummyjson.com")} | {k: str(v) for k, v in options.items()}

    def validate_watermark_column(self, column: str) -> None:
        if column != "order_ts":
            raise ValueError(f"watermark column {column!r}: this source only has order_ts")

    def default_high_watermark(self, column: str, run_started_at: datetime) -> datetime | None:
        self.validate_watermark_column(column)
        return ORDER_TS_HIGH

    def pages(self, spark: SparkSession, name: str, page_size: int) -> DataFrame:
        """source_ref, raw_payload of a resource; every action asks for its pages again."""
        package_on_workers(spark)
        spark.dataSource.register(PagedResource)
        return spark.read.format("paged_resource").options(**self.options, resource=name, page_size=str(page_size)).load()

    def _pull(self, spark: SparkSession, page_size: int, landing: Landing) -> tuple[dict[str, DataFrame], dict]:
        records, counts = {}, {}
        for name in RECORDS:
            seen = Observation()
            self.pages(spark, name, page_size).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(landing.path(name))
            counts[name] = counted(seen, "n")["n"]
            records[name] = parsed(spark.read.schema("source_ref bigint, raw_payload string").parquet(landing.path(name)), name)
        return records, {"source_system": self.source_system, "selection": "all pages", "page_size": page_size, "records": counts, "landing": landing.path()}

    def pull_full(self, spark: SparkSession, page_size: int, landing: Landing) -> PullResult:
        return PullResult(*self._pull(spark, page_size, landing))

    def pull_incremental(self, spark: SparkSession, page_size: int, window: ExtractionWindow, landing: Landing) -> PullResult:
        self.validate_watermark_column(window.watermark_column)
        records, meta = self._pull(spark, page_size, landing)
        carts = in_window(records["carts"], order_ts(F.col("id").cast("bigint"), F.col("userId").cast("bigint")), window.low, window.high)
        meta |= {"selection": "all pages, carts of the window kept", "carts_pre_filter": meta["records"]["carts"], "carts_post_filter": carts.count()} | window.meta()
        return PullResult(records | {"carts": carts}, meta)


class SnapshotSource:
    """A snapshot folder in the place of the shop: the same windows, over files."""

    source_system = "dummyjson"

    def __init__(self, root: str):
        self.root = root

    validate_watermark_column = ShopSource.validate_watermark_column
    default_high_watermark = ShopSource.default_high_watermark

    def pull_full(self, spark: SparkSession, page_size: int = 100, landing: Landing | None = None) -> PullResult:
        return PullResult(read_snapshot(spark, self.root), {"source_system": self.source_system, "selection": "snapshot", "snapshot_root": str(self.root)})

    def pull_incremental(self, spark: SparkSession, page_size: int, window: ExtractionWindow, landing: Landing | None = None) -> PullResult:
        self.validate_watermark_column(window.watermark_column)
        got = self.pull_full(spark, page_size)
        every = got.records["carts"]
        carts = in_window(every, order_ts(F.col("id").cast("bigint"), F.col("userId").cast("bigint")), window.low, window.high)
        return PullResult(got.records | {"carts": carts}, got.meta | {"carts_pre_filter": every.count(), "carts_post_filter": carts.count()} | window.meta())


#: The time fields that an order search may run by, and the names it sorts by.
SEARCH_FIELDS = {"created_at": "CREATED_AT", "updated_at": "UPDATED_AT", "closed_at": "CLOSED_AT"}


class OrderSearchSource:
    """Orders from a search service that filters by time on its side and hands out cursors. Both ends of its window are inclusive.

    One reader follows the cursors (each is only known from the page before it) and lands page after page; what has landed is
    read by all executors. A pull that ended early goes on behind its last landed page.
    """

    source_system = "square_orders"

    def __init__(self, access_token: str, location_ids: tuple[str, ...], version: str = "2026-01-22", base_url: str = "https://connect.squareupsandbox.com", post: Callable[[str, dict, dict], dict] | None = None, max_pages: int = 100_000):
        self.location_ids, self.base_url, self.max_pages = tuple(location_ids), base_url.rstrip("/"), max_pages
        self.headers = {"Authorization": f"Bearer {access_token}", "Square-Version": version, "Content-Type": "application/json", "Accept": "application/json"}
        self.post = post or _post

    @classmethod
    def from_env(cls) -> OrderSearchSource:
        places = (x.strip() for x in os.environ["SQUARE_LOCATION_IDS"].split(","))
        return cls(os.environ["SQUARE_ACCESS_TOKEN"], tuple(x for x in places if x))

    def validate_watermark_column(self, column: str) -> None:
        if column not in SEARCH_FIELDS:
            raise ValueError(f"watermark column {column!r}: one of {', '.join(sorted(SEARCH_FIELDS))}")

    def default_high_watermark(self, column: str, run_started_at: datetime) -> datetime | None:
        self.validate_watermark_column(column)
        return run_started_at

    def request(self, window: ExtractionWindow, page_size: int, cursor: str | None = None) -> dict:
        column = window.watermark_column
        body = {
            "location_ids": list(self.location_ids),
            "limit": min(page_size, 1000),
            "return_entries": False,
            "query": {"filter": {"date_time_filter": {column: {"start_at": window.low.isoformat(), "end_at": window.high.isoformat()}}}, "sort": {"sort_field": SEARCH_FIELDS[column], "sort_order": "ASC"}},
        }
        return body | ({"cursor": cursor} if cursor else {})

    def page(self, window: ExtractionWindow, page_size: int, cursor: str | None) -> tuple[list[dict], str | None]:
        """(orders, next cursor) of the page behind a cursor."""
        answer = self.post(f"{self.base_url}/v2/orders/search", self.request(window, page_size, cursor), self.headers)
        return answer.get("orders", []), answer.get("cursor")

    def pull_full(self, spark: SparkSession, page_size: int, landing: Landing) -> PullResult:
        raise NotImplementedError("orders are searched by a window; run this source incrementally")

    def pull_incremental(self, spark: SparkSession, page_size: int, window: ExtractionWindow, landing: Landing) -> PullResult:
        self.validate_watermark_column(window.watermark_column)
        pages, before = landing.pull(lambda cursor: self.page(window, page_size, cursor), self.max_pages)
        raw = landing.records(spark)
        orders = search_orders.parsed(raw)
        meta = {"source_system": self.source_system, "selection": "search by time, both ends included", "sorted_by": SEARCH_FIELDS[window.watermark_column], "pages": pages, "pages_of_earlier_pulls": before, "landing": landing.path()}
        return PullResult({"orders": orders}, meta | window.meta())


def _post(url: str, body: dict, headers: dict) -> dict:
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST"), timeout=30) as r:
        return json.load(r)


REGISTRY: dict[str, Callable[[], SourceAdapter]] = {ShopSource.source_system: ShopSource, OrderSearchSource.source_system: OrderSearchSource.from_env}


def get_source_adapter(name: str) -> SourceAdapter:
    if name not in REGISTRY:
        raise ValueError(f"unknown source system {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]()


def extract_snapshots(spark: SparkSession, root: str, source: ShopSource | None = None, page_size: int = 100) -> dict[str, str]:
    """Pull the shop's resources and keep them as a snapshot; the files written, by resource."""
    source = source or ShopSource()
    return {n: write_resource(root, n, source.pages(spark, n, page_size), page_size) for n in RECORDS}
