"""GET of pages of records, with retries and a limit of the request rate, and the check of a page."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request

#: Statuses worth another attempt.
RETRY = {408, 429, 500, 502, 503, 504}


def checked_page(page: dict, name: str) -> dict:
    """A page whose list and numbers are what they must be."""
    whole = lambda k, low: isinstance(page.get(k), int) and not isinstance(page[k], bool) and page[k] >= low
    if not isinstance(page.get(name), list) or not (whole("total", 0) and whole("skip", 0) and whole("limit", 1)):
        raise ValueError(f"not a page of {name}: {sorted(page)}")
    return page


class Client:
    """GET of JSON objects. sleep, clock and opener (urllib's, or a fake transport) can be replaced in tests."""

    def __init__(self, base_url: str, timeout_s: float = 10, attempts: int = 4, backoff_s: float = 0.5, max_backoff_s: float = 8, min_interval_s: float = 0.25, sleep=time.sleep, clock=time.monotonic, opener=None):
        self.opener = opener or (lambda url, timeout: urllib.request.urlopen(url, timeout=timeout))
        self.base, self.timeout, self.attempts = base_url.rstrip("/"), timeout_s, attempts
        self.backoff, self.max_backoff, self.interval = backoff_s, max_backoff_s, min_interval_s
        self.sleep, self.clock, self.last = sleep, clock, None

    def get(self, resource: str, limit: int, skip: int) -> dict:
        url = f"{self.base}/{resource}?limit={limit}&skip={skip}"
        for attempt in range(1, self.attempts + 1):
            if self.last is not None and (wait := self.interval - (self.clock() - self.last)) > 0:
                self.sleep(wait)
            self.last = self.clock()
            after = None
            try:
                with self.opener(url, self.timeout) as r:
                    out = json.load(r)
                if not isinstance(out, dict):
                    raise ValueError(f"{url}: the answer is not an object")
                return out
            except urllib.error.HTTPError as e:
                if e.code not in RETRY or attempt == self.attempts:
                    raise
                after = e.headers.get("Retry-After")
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.attempts:
                    raise
            delay = min(self.backoff * 2 ** (attempt - 1), self.max_backoff)
            self.sleep(float(after) if after and after.replace(".", "", 1).isdigit() else delay * (1 + random.random() / 4))
        raise AssertionError("unreachable")
