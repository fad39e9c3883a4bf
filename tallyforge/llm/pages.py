"""Main text of web pages: what the pages of a host repeat is found by a suffix array over their token streams.

A page is a stream of tokens: for each block a token of its element (name, class, id) and its words. Within an article, prose (what
stands in paragraphs, headings, list items and the like) belongs to the text whoever repeats it, so a block of it is one token.
Streams are concatenated and their suffixes named by their first 8 tokens, by doubling (names of 1, 2, 4, 8 tokens, each of two
names of half the length), with 128 bits and the host mixed in. Suffixes of one name are neighbours in the host's suffix array
with 8 or more tokens in common: a name on two pages of different content is a repeated substring, and longer ones are the unions
of such windows. Names are spread over the cluster whatever their host, so no host, however large, is one task.

Which blocks are the text:
- the blocks of the article (where there is none, of the main part, or of what is called the content), without furniture in it: what the markup marks as such, and
  blocks of elements that carry a class or an id and are no prose, where the repeats cover them from end to end;
- where the markup names none of them, of all unmarked blocks the runs that no repeat covers; prose between the first and the last
  prose block with something of its own stays whole (a passage that another page quotes), and all prose of a page that has
  nothing of its own. Rows of three or more blocks made of links only are menus. If nothing is left, forms are plain elements.

Null html is an empty page; pages without a host are compared with none; equal pages of a host are one page, and each of their
rows is returned; null and repeated page_ids are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import html as H
from tallyforge.llm.common import arrow_map, discard, durable, split_join

#: Tokens that a repeated substring has at least; a power of two.
LENGTH = 8
#: Words whose hashes a task remembers.
REMEMBERED = 500_000
#: A row of so many blocks that are links is a menu; a block is a link from this share of its characters on.
MENU, LINKED = 3, 0.8
_KEPT, _SEPARATOR = "\x00prose", "\x00"
_hashes: dict[str, int] = {}


def _hash(token: str) -> int:
    h = _hashes.get(token)
    if h is None:
        if len(_hashes) >= REMEMBERED:
            _hashes.clear()
        h = _hashes[token] = xxhash.xxh64_intdigest(token)
    return h


def stream(found: list[H.Block]) -> tuple[list[str], list[int]]:
    """(tokens of a page, number of tokens before each block and at the end)."""
    zone, tokens, starts = H.region(found), [], [0]
    for b in found:
        if zone != H.OPEN and b.zone == zone and b.tag in H.PROSE:
            tokens.append(_KEPT)
        else:
            tokens.append(f"{_SEPARATOR}{b.tag}{_SEPARATOR}{b.signature}")
            tokens += b.text.split(" ")
        starts.append(len(tokens))
    return tokens, starts


def window_names(tokens: np.ndarray, host: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of the `length` tokens from each position on; host: a number mixed into each."""
    out = []
    with np.errstate(over="ignore"):
        for odd, turn in ((0x9E3779B97F4A7C15, 29), (0xC2B2AE3D27D4EB4F, 31)):
            name, n = tokens.copy(), 1
            while n < length:
                name = (name[:-n] * np.uint64(odd)) ^ (name[n:] + np.uint64(turn))
                name ^= name >> np.uint64(turn)
                name *= np.uint64(0xD6E8FEB86659FD93)
                name ^= name >> np.uint64(32)
                n *= 2
            name = (name ^ host[: len(name)]) * np.uint64(odd)
            out.append((name ^ (name >> np.uint64(turn))).view(np.int64))
    return out[0], out[1]


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """n1, n2 (name), p1, p2 (page), at (position) of all windows of a batch's pages (html, host, p1, p2)."""
    tokens, host, row, at = [], [], [], []
    for k, (page, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        got = [_hash(t) for t in stream(H.blocks(page))[0]]
        if len(got) < LENGTH:
            continue
        tokens += got
        host.append(np.full(len(got), xxhash.xxh64_intdigest(h, 1), dtype=np.uint64))
        row.append(np.full(len(got), k, dtype=np.int64))
        at.append(np.arange(len(got), dtype=np.int32))
    if not tokens:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())], names=["n1", "n2", "p1", "p2", "at"])
    rows = np.concatenate(row)
    n1, n2 = window_names(np.array(tokens, dtype=np.uint64), np.concatenate(host))
    whole = np.flatnonzero(rows[: len(n1)] == rows[LENGTH - 1 :])  # within one page
    keys = [batch.column(c).to_numpy(zero_copy_only=False)[rows[whole]] for c in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array(n1[whole]), pa.array(n2[whole]), pa.array(keys[0]), pa.array(keys[1]), pa.array(np.concatenate(at)[whole])], names=["n1", "n2", "p1", "p2", "at"])


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, and p1, p2: 128 bits of the host and the page's content."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    return rows.select("*", F.xxhash64("host", "html").alias("p1"), F.xxhash64(F.lit("page"), "html", "host").alias("p2"))


def repeats(rows: DataFrame) -> DataFrame:
    """p1, p2, starts: the windows of each page that another page of its host holds as well. rows: of keyed()."""
    read = rows.where("host <> ''").select("html", "host", "p1", "p2")
    windows = durable(arrow_map(read, _windows, "n1 bigint, n2 bigint, p1 bigint, p2 bigint, at int"), "windows")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("p1", "p2") for f in (F.min, F.max)]
    again = windows.groupBy("n1", "n2").agg(*ends, F.count(F.lit(1)).alias("n")).where("min_p1 <> max_p1 or min_p2 <> max_p2").select("n1", "n2", "n")
    again = durable(again, "repeats")
    out = durable(split_join(windows, again, ["n1", "n2"], "n", windows.count()).groupBy("p1", "p2").agg(F.collect_set("at").alias("starts")), "covered")
    discard(windows)
    discard(again)
    return out


def _runs(words: list[str], covered: np.ndarray) -> str:
    return " ".join(" ".join(words[i] for i in run) for own, run in groupby(range(len(words)), lambda i: not covered[i]) if own)


def main_text(page: str | None, starts: list[int] | None = None, form: bool = False) -> tuple[str, int]:
    """(text, repeated tokens outside of it) of a page, whose repeated windows begin at `starts`."""
    found = H.blocks(page if not form else (page or "").replace("<form", "<div").replace("</form", "</div"))
    tokens, edges = stream(found)
    covered = np.zeros(len(tokens) + LENGTH, dtype=bool)
    for s in starts or ():
        covered[s : s + LENGTH] = True
    zone = H.region(found)
    hidden = [covered[a:b] for a, b in zip(edges, edges[1:])]
    out: list[str] = []
    if zone != H.OPEN:
        for b, c in zip(found, hidden):
            if b.zone == zone and (b.tag in H.PROSE or not b.signature or b.tag in ("article", "main", "body") or not c.all()):
                out.append(b.text)
    else:
        menus: set[int] = set()
        for link, run in groupby(range(len(found)), lambda i: found[i].linked >= LINKED):
            if link and len(run := list(run)) >= MENU:
                menus.update(run)
        plain = [i for i, b in enumerate(found) if b.zone in (H.OPEN, H.CONTENT) and i not in menus]
        unique = [i for i in plain if not hidden[i][1:].all()]
        prose = [i for i in unique if found[i].tag in H.PROSE]
        first, last = (prose[0], prose[-1]) if prose else (len(found), -1) if unique else (0, len(found))
        for i in plain:
            whole = found[i].tag in H.PROSE and first <= i <= last
            text = found[i].text if whole else _runs(found[i].text.split(" "), hidden[i][1:])
            if text:
                out.append(text)
        if not out and not form and "<form" in (page or ""):
            return main_text(page, None, True)
    return "\n".join(out), int(covered[: len(tokens)].sum())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, and n_repeated: tokens (elements and words) that other pages of the host repeat."""
    rows = keyed(pages.select("page_id", "url", "html"))
    covered = repeats(rows)
    # copies of one page may be a third of all: such keys are split by AQE, as the other side has one row for each
    joined = rows.drop("host").join(covered, ["p1", "p2"], "left").select("page_id", "url", "html", "starts")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [main_text(p, s) for p, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        texts = [t for t, _ in got]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_repeated"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_map(joined, read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_repeated bigint")
