"""Where pulled records land before they are staged: pages with their cursors, which a later run can go on from."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.files import Files
from tallyforge.sources.window import ExtractionWindow

#: A record's position is its page times this and its place in the page; no page has more records.
PAGE_ROWS = 1_000_000


class PageTaken(RuntimeError):
    """Another run has landed the page that this one pulled: two runs pull one window."""


class Landing:
    """Pages of one pull. A window's pages lie in a folder of its own, so that a run that ends early leaves them to the next.

    A page and the cursor behind it are one file, created whole and only once: there is no page without its cursor, no cursor
    without its rows. The end of a pull is marked by a file of its own.
    """

    def __init__(self, files: Files, source: str, window: ExtractionWindow | None, run_id: str, noted: Callable[[dict], None] = lambda state: None):
        self.files, self.window, self.noted = files, window, noted
        key = f"{window.watermark_column}/{window.low:%Y%m%dT%H%M%S%f}-{window.high:%Y%m%dT%H%M%S%f}" if window else f"full/{run_id}"
        self.folder = f"landing/{source}/{key}"

    def path(self, name: str = "") -> str:
        return self.files.path(f"{self.folder}/{name}".rstrip("/"))

    def _state(self) -> tuple[int, str | None]:
        """(pages that are here, cursor behind the last of them)."""
        names = [n for n in self.files.names(f"{self.folder}/pages") if n.endswith(".jsonl")]
        if not names:
            return 0, None
        return len(names), json.loads(self.files.read(f"{self.folder}/pages/{names[-1]}").split("\n", 1)[0])["next"]

    def pull(self, page: Callable[[str | None], tuple[list[dict], str | None]], max_pages: int) -> tuple[int, int]:
        """Land page(cursor) -> (records, next cursor) until there is no next one, from where an earlier pull ended:
        (pages, of which were here already). A cursor that comes twice is an error."""
        here, cursor = self._state()
        done = self.files.exists(f"{self.folder}/DONE.json")
        if here == 0 and self.window:
            self.files.write(f"{self.folder}/window.json", json.dumps({"column": self.window.watermark_column, "low": self.window.low.isoformat(), "high": self.window.high.isoformat(), "prior": self.window.prior_watermark and self.window.prior_watermark.isoformat(), "overlap_s": self.window.overlap.total_seconds()}))
        seen, n = {cursor} if cursor else set(), here
        while not done and (n == here or cursor) and not (n == here and here and not cursor):
            if n >= max_pages:
                raise RuntimeError(f"more than {max_pages} pages")
            records, following = page(cursor)
            if following and following in seen:
                raise RuntimeError(f"cursor {following!r} came twice")
            seen.add(following)
            lines = [json.dumps({"page": n, "next": following, "rows": len(records)})]
            lines += [json.dumps({"ref": n * PAGE_ROWS + k, "raw": json.dumps(x, sort_keys=True)}) for k, x in enumerate(records, 1)]
            if not self.files.create(f"{self.folder}/pages/{n:08d}.jsonl", "\n".join(lines) + "\n"):
                raise PageTaken(f"{self.folder}: page {n}")
            n, cursor = n + 1, following
            self.noted({"folder": self.folder, "pages": n, "next": cursor})
        if not done:
            self.files.write(f"{self.folder}/DONE.json", json.dumps({"pages": n}))
            self.noted({"folder": self.folder, "pages": n, "next": None, "done": True})
        return n, here

    def records(self, spark: SparkSession) -> DataFrame:
        """source_ref, raw_payload of all landed records."""
        lines = spark.read.schema("ref bigint, raw string").json(self.path("pages"))
        return lines.where("ref is not null").select(F.col("ref").alias("source_ref"), F.col("raw").alias("raw_payload"))


def open_window(files: Files, source: str, column: str) -> ExtractionWindow | None:
    """The window of a pull of a source that has begun and not ended: the earliest, if there are several."""
    for w, folder in _windows(files, source, column):
        if not files.exists(f"{folder}/DONE.json"):
            return w
    return None


def _windows(files: Files, source: str, column: str) -> Iterator[tuple[ExtractionWindow, str]]:
    top = f"landing/{source}/{column}"
    for name in files.names(top):
        if files.exists(f"{top}/{name}/window.json"):
            w = json.loads(files.read(f"{top}/{name}/window.json"))
            at = lambda t: datetime.fromisoformat(t) if t else None
            yield ExtractionWindow(w["column"], at(w["low"]), at(w["high"]), at(w["prior"]), timedelta(seconds=w["overlap_s"]), w["prior"] is None), f"{top}/{name}"
