"""A paged HTTP resource as a Spark data source: page ranges are partitions, read by executors under one request rate.

    spark.dataSource.register(PagedResource)
    spark.read.format("paged_resource").options(url="https://host", resource="users", page_size=100).load()

The first page is asked for when the read is planned: its total and limit say which ranges there are. Every page must then tell
the same total and start where it was asked to; else the resource changed while it was read, and the job fails. Readers share
the source's request rate: with n of them, each waits n times the interval between requests. Spark may run a failed task again,
which asks for its pages again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyforge.sources.paging import Client, checked_page


class PageRange(InputPartition):
    def __init__(self, skips: list[int], readers: int, total: int, step: int):
        self.skips, self.readers, self.total, self.step = skips, readers, total, step


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.resource = options["url"], options["resource"]
        self.size = int(options.get("page_size", 100))
        self.max_pages = int(options.get("max_pages", 1000))
        self.readers = int(options.get("readers", 4))
        self.interval = float(options.get("interval_s", 0.25))

    def _client(self, readers: int) -> Client:
        return Client(self.url, min_interval_s=self.interval * readers)

    def partitions(self) -> list[PageRange]:
        first = checked_page(self._client(1).get(self.resource, self.size, 0), self.resource)
        total, step = first["total"], first["limit"]
        if first["skip"] != 0:
            raise RuntimeError(f"{self.resource}: asked for the start, got a page at {first['skip']}")
        skips = list(range(0, total, step))
        if len(skips) > self.max_pages:
            raise RuntimeError(f"{self.resource}: more than {self.max_pages} pages")
        n = max(1, min(self.readers, len(skips)))
        share = max(1, -(-len(skips) // n))
        return [PageRange(skips[k : k + share], n, total, step) for k in range(0, len(skips), share)] or [PageRange([], 1, total, step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        client = self._client(partition.readers)
        for skip in partition.skips:
            p = checked_page(client.get(self.resource, self.size, skip), self.resource)
            if p["total"] != partition.total:
                raise RuntimeError(f"{self.resource}: total changed from {partition.total} to {p['total']} while paging")
            if p["skip"] != skip or p["limit"] != partition.step:
                raise RuntimeError(f"{self.resource}: asked for {partition.step} from {skip} on, got {p['limit']} from {p['skip']} on")
            for k, record in enumerate(p[self.resource][: min(partition.step, partition.total - skip)], 1):
                yield skip + k, json.dumps(record, sort_keys=True)


class PagedResource(DataSource):
    """Rows: source_ref (position in the resource, from 1), raw_payload (the record as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged_resource"

    def schema(self) -> str:
        return "source_ref bigint, raw_payload string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
