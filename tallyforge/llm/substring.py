"""Near-duplicate passages by compact windows.

Tokens are the hashes of 5-word shingles of the whole text (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). For each of HASHES
min-hash functions, all subsequences of at least `width` shingles that share their minimum form one compact window (l, c, r):
those that start in l..c and end in c..r. The windows are the nodes of the Cartesian tree over the hash values whose range
is at least `width` wide; they are found without building the tree: c must be the minimum of some `width` neighbours (sliding
minima, vectorised), and its nearest smaller values are either within `width` of c or such minima themselves (found by pointers
that jump over larger minima). A text of n words has about 2n / width windows a function.

Texts of the same words are one text, that of the smallest doc_id; the other rows are copies of it and get a row that says so.

Windows that share (function, minimum) are grouped. Minima that occur once are dropped first, counted with a partial
aggregation. A group of at most SMALL windows gives its pairs of texts; a larger group is dealt out again by the hash of the
half-width shingles that follow c and of those that precede it (two passages that share `width` shingles around c share one of
the two halves): of a subgroup of at most SMALL all pairs, of a larger one, and of the whole group, links to the first text.
When these are verified, all pairs of a large group whose texts are of different classes by then are compared too, so that no
link between two classes is left out; within a class, a large group need not have all of its links.
Exact repeats do not depend on that: every run of `width` shingles within a window of a large group is a key of its own, and
all texts that hold the run are linked to the first of them, with no second function.
A pair of texts with collisions of at least ENOUGH functions whose windows meet in both texts (an interval join on the sorted
positions) is verified: aligned seeds are extended word by word and followed over mismatches in both directions, and a
passage pair of at least MIN_WORDS words on each side and a Jaccard similarity of shingles of at least `similarity` is a link.

Output: one row per linked passage of a document pair, both spans in words (end exclusive), and the class of the documents:
the smallest doc_id reachable over links. A copy has one row, of its whole text and that of the text it equals (whose links are
its own). Documents without a repeated passage have no row.

Edge cases: null, empty and short texts have no windows; repeats inside one document are not links; repeated rows count once;
rows of one doc_id with different texts are texts of their own, and one document for the classes; a null doc_id takes no part;
an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import LUKEWARM, SALTS, append_columns, arrow_map, components, discard, durable, split_join

SHINGLE, MIN_WORDS, HASHES, ENOUGH, SIMILARITY, SMALL = 5, 50, 4, 2, 0.8, 12
WIDTH = MIN_WORDS - SHINGLE + 1
#: Shingles whose windows are found at a time.
CHUNK = 1 << 18
#: Shingles that a task keeps of the texts it compares.
KEPT = 1 << 20
#: Texts of one task, and bytes of pairs of texts.
TASK_ROWS, TASK_BYTES = 4096, 2 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_BASE = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of all runs of SHINGLE words."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * _BASE + w[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def mixed(tokens: np.ndarray, f: int) -> np.ndarray:
    x = tokens * _ODD[f] + np.uint64(f)
    x ^= x >> np.uint64(31)
    x *= _ODD[(f + 1) % len(_ODD)]
    return x ^ (x >> np.uint64(30))


def compact_windows(h: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), inclusive, of all compact windows with r - l + 1 >= width. Ties go to the leftmost."""
    n = len(h)
    if n < width:
        e = np.zeros(0, np.int64)
        return e, e, e
    # leftmost minimum of each run of width values, from block-wise prefix and suffix minima. Each value carries its position in
    # its low bits: equal hashes order by position (as do hashes that differ in those bits only, which is as rare as a collision)
    bits = np.uint64(int(n).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    rank = (h & ~mask) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    grid = np.concatenate([rank, np.full(pad, ~np.uint64(0), np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(after[: n - width + 1], before[width - 1 : n])
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    c = (low[change] & mask).astype(np.int64)
    first, last = change, np.concatenate([change[1:] - 1, [n - width]])
    left, right = first.copy(), last + width - 1
    # open to the left (right): the smaller neighbour lies beyond width and is a minimum itself
    values, m = rank[c], len(c)
    ask = np.flatnonzero(first == np.maximum(c - width + 1, 0))
    left[ask] = np.append(c + 1, 0)[_smaller_before(values, ask)]
    ask = np.flatnonzero(last == np.minimum(c, n - width))
    right[ask] = np.append(c - 1, n - 1)[m - 1 - _smaller_before(values[::-1], m - 1 - ask)]
    return left, c, right


def _smaller_before(values: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """For each position asked for, that of the nearest smaller value before it, or -1. Values are distinct.

    All positions jump together: one whose pointer stands at a larger value takes over that value's pointer, wherever that one
    is by now, since all that lies between is larger still. So the rounds grow with the logarithm of the longest way."""
    at = np.arange(-1, len(values) - 1)
    open_ = np.arange(1, len(values))
    while len(open_):
        p = at[open_]
        larger = (p >= 0) & (values[p] > values[open_])
        open_ = open_[larger]
        at[open_] = at[p[larger]]
    return at[ask]


def thinned(h: np.ndarray, left: np.ndarray, c: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without windows of the same minimum that lie inside the one before and less than width behind it: a text that repeats
    itself (one word over and over) would else have a window for every word. Extending a seed covers what they cover."""
    v = h[c]
    same = np.flatnonzero((v[1:] == v[:-1]) & (c[1:] - c[:-1] < width) & (right[1:] <= right[:-1])) + 1
    if not len(same):
        return left, c, right
    stay = np.ones(len(c), bool)
    pos, equal = c.tolist(), set(same.tolist())
    last = pos[0]
    for k in range(1, len(pos)):
        if k in equal and pos[k] - last < width:
            stay[k] = False
        else:
            last = pos[k]
    return left[stay], c[stay], right[stay]


def joined_shingles(texts: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The shingles of many texts one behind the other with one place between two texts, where each begins, and which text it
    is: as many texts at a time as have CHUNK shingles. Texts of fewer than `width` shingles are left out."""
    parts, starts, which, at = [], [], [], 0
    for k, t in enumerate(texts):
        x = shingles(words_of(t))
        if len(x) >= width:
            parts += [x, np.zeros(1, np.uint64)]
            starts.append(at)
            which.append(k)
            at += len(x) + 1
        if at >= CHUNK or at and k == len(texts) - 1:
            yield np.concatenate(parts), np.array(starts, np.int64), np.array(which, np.int64)
            parts, starts, which, at = [], [], [], 0
    if at:
        yield np.concatenate(parts), np.array(starts, np.int64), np.array(which, np.int64)


def windows(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, rid, l, c, r, nxt, prev: the compact windows of every text (rid, text). A key holds its function in its lowest bits."""
    half = width // 2
    names, kinds = ["key", "rid", "l", "c", "r", "nxt", "prev"], [np.int64, np.int64, *[np.int32] * 5]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy()
        for x, starts, which in joined_shingles(batch.column(1).to_pylist(), width):
            gaps = np.append(starts[1:], len(x)) - 1
            run = (run_hashes(x, half) & np.uint64(0x7FFFFFFF)).astype(np.int32)
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for f in range(HASHES):
                h = mixed(x, f) | np.uint64(1)
                h[gaps] = 0  # the smallest value: what would reach over the end of a text has its minimum there
                le, c, ri = compact_windows(h, width)
                inside = h[c] != 0
                le, c, ri = thinned(h, le[inside], c[inside], ri[inside], width)
                doc = np.searchsorted(starts, c, "right") - 1
                first, last = starts[doc], gaps[doc]
                nxt = np.where(c + half <= last, run[np.minimum(c, len(run) - 1)], -1)
                prev = np.where(c - half + 1 >= first, run[np.maximum(c - half + 1, 0)], -1)
                key = ((h[c] << np.uint64(3)) | np.uint64(f)).view(np.int64)
                for col, v in zip(cols, (key, ids[which[doc]], le - first, c - first, ri - first, nxt, prev)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds)], names=names)

    return arrow_map(texts.select("rid", "text"), rows, "key bigint, rid bigint, l int, c int, r int, nxt int, prev int")


def exact_repeats(texts: DataFrame, hot: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b (a < b), sa, sb: start positions of equal runs of `width` shingles. Every run that lies in a window of a large group
    is a key, and each text that holds it is linked to the first one that does."""
    starts = hot.select("rid", F.greatest("l", F.col("c") - (width - 1)).alias("low"), F.least("c", F.col("r") - (width - 1)).alias("high"))
    ranges = starts.groupBy("rid").agg(F.collect_set(F.struct("low", "high")).alias("g"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[], [], []]
        for rid, g, text in zip(batch.column(0).to_pylist(), struct_rows(batch.column(1)), batch.column(2).to_pylist()):
            x = shingles(words_of(text))
            if len(x) < width:
                continue
            steps = np.zeros(len(x) + 1, np.int64)
            for low, high in g:
                steps[low] += 1
                steps[high + 1] -= 1
            at = np.flatnonzero(np.cumsum(steps[: len(x) - width + 1]) > 0)
            run, first = np.unique(run_hashes(x, width)[at], return_index=True)
            for col, v in zip(cols, (run.view(np.int64), np.full(len(run), rid, np.int64), at[first].astype(np.int32))):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(cols, (np.int64, np.int64, np.int32))], names=["run", "rid", "p"])

    found = durable(arrow_map(ranges.join(texts, "rid").select("rid", "g", "text"), rows, "run bigint, rid bigint, p int"), "runs")
    first = found.groupBy("run").agg(F.min(F.struct("rid", "p")).alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1")
    star = split_join(found, first, "run", "m", found.count()).where("rid <> x.rid").select(F.col("x.rid").alias("a"), F.col("rid").alias("b"), F.col("x.p").alias("sa"), F.col("p").alias("sb"))
    out = durable(star.groupBy("a", "b", F.expr("sb - sa")).agg(F.min("sa").alias("sa"), F.min("sb").alias("sb")).select("a", "b", "sa", "sb"), "repeats")
    discard(found)
    return out


def run_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n values."""
    m = len(x) - n + 1
    powers = np.cumprod(np.full(len(x), _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers, dtype=np.uint64)])
    run = (sums[n:] - sums[:m]) * powers[::-1][:m]
    return run ^ (run >> np.uint64(32))


def distinct_texts(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, h1, h2, words of every row of at least min_words words; texts: rid, first, n, h1, h2, text, one for each
    sequence of words (told by a 128-bit hash). first is the smallest doc_id, n the number of rows. rid is first, or a number of
    its own where some doc_id stands on rows of several texts."""

    def columns(texts: list) -> list:
        words = [words_of(t) for t in texts]
        wide = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), ">i8").reshape(-1, 2)
        return [wide[:, 0].astype(np.int64), wide[:, 1].astype(np.int64), np.array([len(w) for w in words], np.int32)]

    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hashed = append_columns(known, columns, [("h1", pa.int64(), "bigint"), ("h2", pa.int64(), "bigint"), ("words", pa.int32(), "int")]).where(F.col("words") >= min_words)
    rows = durable(hashed.drop("text").distinct(), "rows")
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    firsts = hashed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text")).alias("x"), F.count(F.lit(1)).alias("n"))
    one = firsts.repartition(parts, "h1", "h2")
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).count()
    rid = F.monotonically_increasing_id() if several else F.col("x.doc_id")
    return rows, durable(one.select(rid.alias("rid"), F.col("x.doc_id").alias("first"), "n", "h1", "h2", F.col("x.text").alias("text")), "texts")


def collisions(texts: DataFrame, width: int = WIDTH, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """a, b (a < b), f and both windows: pairs of windows of one minimum, all of a small group and stars of a large one; the
    windows of large groups; and the pairs of small groups alone. What the stars leave out is found by across()."""
    found = durable(windows(texts, width), "windows")
    sizes = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = durable(split_join(found, sizes, "key", "n", found.count()), "live")
    discard(found)
    w = F.struct("rid", "c", "l", "r")

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for f, group in zip(batch.column(0).to_pylist(), struct_rows(batch.column(1))):
            group.sort()
            for i, x in enumerate(group):
                out += [(x[0], y[0], f, *x[1:], *y[1:]) for y in group[i + 1 :] if y[0] != x[0]]
        names = ["a", "b", "f", "ac", "al", "ar", "bc", "bl", "br"]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * 9, kinds)], names=names)

    schema = "a bigint, b bigint, f int, ac int, al int, ar int, bc int, bl int, br int"
    function = F.col("key").bitwiseAND(F.lit(7)).cast("int").alias("f")
    cold = live.where(F.col("n") <= small).groupBy("key").agg(F.collect_list(w).alias("g")).select(function, "g")
    large = live.where(F.col("n") > small)
    subs = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("sub")), F.struct(F.lit(1).alias("side"), F.col("nxt").alias("sub")), F.struct(F.lit(2).alias("side"), F.col("prev").alias("sub")))
    by = ["key", "side", "sub"]
    hot = large.withColumn("s", F.explode(subs)).where("s.side = 0 or s.sub >= 0").select("key", "s.side", "s.sub", w.alias("w"))
    stars = hot.groupBy(*by).agg(F.min("w").alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = durable(split_join(hot, stars, by, "m", 3 * large.count()), "hot")
    halves = dealt.where((F.col("m") <= small) & (F.col("side") > 0)).groupBy(*by).agg(F.collect_list("w").alias("g")).select(function, "g")
    star = dealt.where((F.col("m") > small) | (F.col("side") == 0)).where("w.rid <> x.rid").select(F.col("x.rid").alias("a"), F.col("w.rid").alias("b"), function, *(F.col(f"x.{k}").alias(f"a{k}") for k in "clr"), *(F.col(f"w.{k}").alias(f"b{k}") for k in "clr"))
    return arrow_map(cold.union(halves), pairs, schema).union(star), large, arrow_map(cold, pairs, schema)


def across(large: DataFrame, cold: DataFrame, classes: DataFrame, width: int = WIDTH) -> DataFrame | None:
    """a, b (a < b), sa, sb: all pairs of texts of one large group that are of different classes (rid, root) so far, and that
    collide with enough functions. None if every large group is of one class. A group's pairs are joined in parts."""
    w = large.select("key", "rid", "c", "l", "r").join(classes, "rid")
    several = w.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "n")
    w = durable(split_join(w, several, "key", "n", large.count()), "across")
    if not w.limit(1).count():
        return None
    hot, parts = F.col("n") > LUKEWARM, F.lit(SALTS)
    x = w.select("key", F.when(hot, F.pmod(F.xxhash64("rid"), parts)).otherwise(0).cast("int").alias("part"), F.col("rid").alias("a"), F.col("root").alias("ra"), *(F.col(k).alias(f"a{k}") for k in "clr"))
    y = w.select("key", F.explode(F.sequence(F.lit(0), F.when(hot, parts - 1).otherwise(0))).alias("part"), F.col("rid").alias("b"), F.col("root").alias("rb"), *(F.col(k).alias(f"b{k}") for k in "clr"))
    met = x.join(y, ["key", "part"]).where("a < b and ra <> rb").select("a", "b", F.col("key").bitwiseAND(F.lit(7)).cast("int").alias("f"), *(f"{side}{k}" for side in "ab" for k in "clr"))
    met = durable(met, "met")
    return seeded(met.union(cold.join(met.select("a", "b").distinct(), ["a", "b"], "left_semi").select(met.columns)), width)


def struct_rows(column: pa.ListArray) -> list[list[tuple]]:
    """The tuples of each list of structs."""
    at = column.offsets.to_pylist()
    flat = list(zip(*(x.to_pylist() for x in column.values.flatten())))
    return [flat[i:j] for i, j in zip(at, at[1:])]


def joined_intervals(hits: list[tuple], width: int, enough: int = ENOUGH) -> list[tuple[int, int]]:
    """Seeds (ac, bc) of the collisions whose windows meet those of at least `enough` functions in both texts.

    hits: (f, ac, al, ar, bc, bl, br). Two windows meet if some subsequence of `width` shingles belongs to both.
    """
    hits = sorted(hits, key=lambda h: h[1])
    at = [h[1] for h in hits]
    seeds = []
    first = 0
    for i, h in enumerate(hits):
        while at[first] < at[i] - width:
            first += 1
        seen = {h[0]}
        for j in range(first, len(hits)):
            g = hits[j]
            if g[1] > h[1] + width:
                break
            if g[0] in seen:
                continue
            if all(_meet(h[k : k + 3], g[k : k + 3], width) for k in (1, 4)):
                seen.add(g[0])
                if len(seen) >= enough:
                    seeds.append((h[1], h[4]))
                    break
    return sorted(set(seeds))


def _meet(x: tuple, y: tuple, width: int) -> bool:
    """(c, l, r) of two windows: a range that starts in both l..c and ends in both c..r, of at least width shingles."""
    low, high = max(x[1], y[1]), min(x[2], y[2])
    return low <= min(x[0], y[0]) and high >= max(x[0], y[0]) and high - low + 1 >= width


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    a, b = set(x.tolist()), set(y.tolist())
    return len(a & b) / max(1, len(a | b))


def verify(seeds: list[tuple[int, int]], x: np.ndarray, y: np.ndarray, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """Passages (a_start, a_end, b_start, b_end) in words, from seeds in shingle positions of x and y, that are long and alike enough.

    Each seed's equal run is followed in both directions over mismatches; of the chain of runs the longest part that is alike
    enough is a passage, then those of what is left on both sides of it.
    """
    least = min_words - SHINGLE + 1
    known: dict[int, list[tuple[int, int]]] = {}  # by diagonal: the equal runs of chains so far
    out = set()
    for a, b in seeds:
        if x[a] != y[b] or any(p <= a < q for p, q in known.get(b - a, ())):
            continue
        back, ahead = _equal(x[:a][::-1], y[:b][::-1]), _equal(x[a:], y[b:])
        chain = [(a - back, b - back, back + ahead)]
        right = _follow(x[a + ahead :], y[b + ahead :], back + ahead, least)
        chain += [(a + ahead + i, b + ahead + j, n) for i, j, n in right]
        i, j, _ = chain[0]
        left = _follow(x[:i][::-1], y[:j][::-1], sum(n for _, _, n in chain), least)
        chain = [(i - p - n, j - q - n, n) for p, q, n in reversed(left)] + chain
        for p, q, n in chain:
            known.setdefault(q - p, []).append((p, p + n))
        out |= set(_alike(chain, x, y, least, similarity))
    return sorted((p, q + SHINGLE - 1, r, s + SHINGLE - 1) for p, q, r, s in out)


def _follow(x: np.ndarray, y: np.ndarray, matched: int, least: int) -> list[tuple[int, int, int]]:
    """Equal runs (start in x, in y, length) behind a mismatch, each the nearest to the end of the one before. The gap may be as
    wide as a passage, or a quarter of what is matched so far (a wider one is beyond the similarity)."""
    out = []
    i = j = 0
    while i < len(x) and j < len(y):
        reach = max(least, matched // 4)
        di, dj = _nearest(x[i : i + reach], y[j : j + reach])
        if di < 0:
            break
        i, j = i + di, j + dj
        n = _equal(x[i:], y[j:])
        out.append((i, j, n))
        i, j, matched = i + n, j + n, matched + n
    return out


def _nearest(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """The places (i, j) of a value in both, with the smallest i + j (-1, -1: none)."""
    if len(x) + len(y) > 512:
        _, i, j = np.intersect1d(x, y, return_indices=True)
        if not len(i):
            return -1, -1
        k = int(np.argmin(i + j))
        return int(i[k]), int(j[k])
    first: dict[int, int] = {}
    for j, v in enumerate(y.tolist()):
        first.setdefault(v, j)
    best, at = len(x) + len(y), (-1, -1)
    for i, v in enumerate(x.tolist()):
        if i >= best:
            break
        if v in first and i + first[v] < best:
            best, at = i + first[v], (i, first[v])
    return at


def _alike(chain: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(start in x, end, start in y, end) in shingles: the longest part of a chain that is alike enough, and those beside it. A part
    that is shorter than a passage takes in what surrounds it."""
    whole = _passage(chain, 0, len(chain) - 1, x, y, least, similarity)
    if whole or len(chain) == 1:
        return [whole] if whole else []
    out, taken = [], []
    for _, f, e, sure in _promising(chain, x, y, least, similarity):
        if any(f <= q and e >= p for p, q in taken):
            continue
        if sure or (found := _passage(chain, f, e, x, y, least, similarity)):
            (p, r, _), (q, s, n) = chain[f], chain[e]
            out.append((p, q + n, r, s + n) if sure else found)
            taken.append((f, e))
    return out


def _promising(chain: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, bool]]:
    """(-length, first, last run, sure) of the parts of a chain that are alike enough, longest first; those shorter than a passage
    are not sure: what surrounds them counts too.

    For each first run the shared and the different shingles of all parts are counted at once: a shingle counts from the run
    on whose end is the first behind its first place, in one text or in both.
    """
    starts = np.array([r[:2] for r in chain])
    ends = starts + np.array([r[2] for r in chain])[:, None]
    (p0, r0), (q0, s0) = starts[0], ends[-1]
    _, ids = np.unique(np.concatenate([x[p0:q0], y[r0:s0]]), return_inverse=True)
    sides = ids[: q0 - p0], ids[q0 - p0 :]
    starts, ends = starts - (p0, r0), ends - (p0, r0)
    many, never = int(ids.max()) + 1, len(chain)
    enters = [np.full(many, never), np.full(many, never)]  # the run from which on a part holds the shingle
    kept = []
    for f in range(len(chain) - 1, -1, -1):
        for side in (0, 1):
            stop = starts[f + 1, side] if f + 1 < len(chain) else ends[f, side]
            new = sides[side][starts[f, side] : stop][::-1]
            # places between two runs only count from the end of the next run on
            enters[side][new] = np.searchsorted(ends[:, side], np.arange(stop - 1, starts[f, side] - 1, -1), "right")
        either, both = np.minimum(*enters), np.maximum(*enters)
        union = np.cumsum(np.bincount(either, minlength=never + 1)[f:never])
        shared = np.cumsum(np.bincount(both, minlength=never + 1)[f:never])
        low = (ends[f:] - starts[f]).min(axis=1)
        long = low >= least
        may = np.where(long, shared, shared + (least - low)) >= similarity * union
        kept += [(-int(low[i]), f, f + i, bool(long[i])) for i in np.flatnonzero(may).tolist()]
    return sorted(kept)


def _passage(part: list[tuple[int, int, int]], f: int, e: int, x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> tuple[int, int, int, int] | None:
    """The runs f to e as one passage, if they are alike enough."""
    (p, r, _), (q, s, n) = part[f], part[e]
    q, s = q + n, s + n
    if (short := least - min(q - p, s - r)) > 0:  # the surroundings: ahead as far as both texts go, then back
        more = min(short, len(x) - q, len(y) - s)
        back = min(short - more, p, r)
        if more + back < short:
            return None
        p, q, r, s = p - back, q + more, r - back, s + more
    return (p, q, r, s) if jaccard(x[p:q], y[r:s]) >= similarity else None


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common start."""
    n = min(len(x), len(y))
    step, at = 256, 0
    while at < n:
        d = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(d):
            return at + int(d[0])
        at, step = at + step, step * 4
    return n


def seeded(hits: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b, sa, sb: the pairs of texts whose collisions of enough functions meet, and where."""
    grouped = hits.groupBy("a", "b").agg(F.collect_set(F.struct("f", "ac", "al", "ar", "bc", "bl", "br")).alias("hits")).where(F.size(F.array_distinct("hits.f")) >= ENOUGH)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [(a, b, s) for a, b, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), struct_rows(batch.column(2))) if (s := joined_intervals(g, width))]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64()), pa.array([[i for i, _ in k[2]] for k in keep], pa.list_(pa.int32())), pa.array([[j for _, j in k[2]] for k in keep], pa.list_(pa.int32()))], names=["a", "b", "sa", "sb"])

    return arrow_map(grouped, rows, "a bigint, b bigint, sa array<int>, sb array<int>")


def candidates(texts: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """a, b (a < b), sa, sb: the pairs of texts to compare, and the places where their passages may be; and what across() needs."""
    hits, hot, cold = collisions(texts, width)
    near = durable(seeded(hits, width), "seeds", TASK_BYTES)
    exact = exact_repeats(texts, hot, width)
    seeds = near.select("a", "b", F.explode(F.arrays_zip("sa", "sb")).alias("s")).select("a", "b", "s.sa", "s.sb").union(exact)
    return seeds.groupBy("a", "b").agg(F.collect_set(F.struct("sa", "sb")).alias("s")).select("a", "b", F.col("s.sa").alias("sa"), F.col("s.sb").alias("sb")), hot, cold


def compared(pairs: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """The linked passages of pairs (a, b, sa, sb) of texts."""
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    one = split_join(pairs, texts.select(F.col("rid").alias("a"), F.col("first").alias("fa"), F.col("text").alias("ta")).join(stars, "a"), "a", "m", pairs.count())
    both = one.join(texts.select(F.col("rid").alias("b"), F.col("first").alias("fb"), F.col("text").alias("tb")), "b").select("a", "b", "sa", "sb", "fa", "fb", "ta", "tb")

    made: dict[int, np.ndarray] = {}  # of each task: neighbouring pairs have texts in common

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, (a, b, sa, sb, fa, fb) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(6)))):
            if fa == fb:
                continue
            if made and sum(map(len, made.values())) > KEPT:
                made.clear()
            for k, column in ((a, 6), (b, 7)):
                if k not in made:
                    made[k] = shingles(words_of(batch.column(column)[i].as_py()))
            for p, q, r, s in verify(list(zip(sa, sb)), made[a], made[b], min_words, similarity):
                out.append((fb, r, s, fa, p, q) if fa < fb else (fa, p, q, fb, r, s))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc_id", "start_word", "end_word", "match_doc_id", "match_start", "match_end"])

    return durable(arrow_map(both, check, "doc_id bigint, start_word int, end_word int, match_doc_id bigint, match_start int, match_end int"), "passages", TASK_BYTES)


def passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, start_word, end_word, match_doc_id, match_start, match_end, class_id: one row per linked passage, doc_id > match_doc_id."""
    width = min_words - SHINGLE + 1
    rows, texts = distinct_texts(docs, min_words)
    found, hot, cold = candidates(texts, width)
    links = compared(durable(found, "candidates"), texts, min_words, similarity)
    # rows of one doc_id with several texts join the classes of these; any other copy has the class of the text it equals
    known = texts.select("h1", "h2", "first", "n")
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id")
    own = rows.join(several, "doc_id", "left_semi").join(known, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    classed = lambda: durable(components(links.select(F.col("doc_id").alias("a"), F.col("match_doc_id").alias("b")).union(own)), "roots")
    roots = classed()
    so_far = texts.select("rid", "first").join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select("rid", F.coalesce("root", "first").alias("root"))
    rest = across(hot, cold, so_far, width)
    if rest is not None:
        more = compared(durable(rest, "candidates", TASK_BYTES), texts, min_words, similarity)
        if more.limit(1).count():
            links = links.union(more).distinct()
            roots = classed()
    classes = known.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").withColumn("class_id", F.coalesce("root", "first"))
    copies = split_join(rows, classes.where("n > 1").select("h1", "h2", "first", "class_id", "n"), ["h1", "h2"], "n", rows.count()).where("doc_id <> first")
    zero = F.lit(0)
    equal = copies.select("doc_id", zero.alias("start_word"), F.col("words").alias("end_word"), F.col("first").alias("match_doc_id"), zero.alias("match_start"), F.col("words").alias("match_end"), "class_id")
    return links.join(roots.select(F.col("node").alias("doc_id"), F.col("root").alias("class_id")), "doc_id").unionByName(equal)


def brute_windows(h: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """All compact windows by their definition, for tests."""
    out = []

    def split(low: int, high: int) -> None:
        if high - low + 1 < width:
            return
        c = low + int(np.argmin(h[low : high + 1]))
        out.append((low, c, high))
        split(low, c - 1)
        split(c + 1, high)

    split(0, len(h) - 1)
    return sorted(out, key=lambda w: w[1])


__all__ = ["brute_windows", "collisions", "compact_windows", "passages", "verify", "windows"]
