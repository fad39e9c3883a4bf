"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, word shingles with repeats, XXH64 of each (seed 42); a bit is set
where over half of the hashes have it. Fingerprints within `distance` bits are linked; classes are connected components.

Search. Exact copies collapse first: one row per distinct fingerprint, pre-aggregated before the shuffle. From the bits'
correlations over all distinct fingerprints, correlated bits are grouped into m partitions. Two fingerprints within tau bits
must lie within T_i bits in some partition i whenever sum(T_i) = tau - m + 1, T_i >= -1 (-1: the partition is not probed).
For m = 2, 3, 4 dynamic programming picks T from the estimated candidates of each (partition, threshold): exact counts of
equal partition values over all rows, carried to thresholds 1 and 2 by the bits' own agreement; the cheapest m wins.
A partition with threshold t is probed by its values with each choice of t of its bits masked out, which is an equi-join key.

Verification. A bucket of at most `small` fingerprints is verified by XOR and popcount, and only a spanning forest of its
links is emitted. A larger bucket is never expanded into pairs: its members are dealt out again by all their one-bit
neighbours. For distance 2, two fingerprints are linked exactly if they share such a neighbour (or one is the other's), no
more than 65 distinct fingerprints share one, and all of those are linked with each other, so a star per neighbour suffices.
Nothing is capped: both ways give every link's component.

Near copies by words (tau None; the pipeline's stage) are found by the same principle with a wider radius: 128 bits of the
distinct runs of two words, as two fingerprints of 64; all that are within RADIUS bits of either (and REACH of both) are joined, by
partitions of thresholds up to 2 and, for these, all values within one bit (two values within two bits have one in common).
An exact check follows: of each component of fingerprints all texts are compared on their five-word runs, and only texts that
share SIMILARITY of them are linked. Large probe keys and large components are compared in blocks, so no pair is left out; of what
is found, links of spanning forests go on, in few times the number of rows whatever the size of a class.

Edge cases: null or wordless text: fingerprint zero, linked like any other; fewer words than a shingle: the whole sequence
is one shingle; repeated rows all keep their rows; a null doc_id is never a class id while its class has another id (a class
of null ids only has a null id); an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import append_columns, arrow_map, components, discard, durable, fresh, split_join, workers_find_us
from tallyforge.llm.substring import TASK_BYTES, mixed, shingles, words_of

SHINGLE, SEED, DISTANCE, SMALL = 3, 42, 2, 96
ROW_COST, PAIR_COST = 1.0, 0.05
#: Near copies by words: Jaccard similarity of runs of five; bits of 64 and of 128 that may differ; rows that are compared at a
#: time by fingerprints, texts by words, and words of these.
SIMILARITY, RADIUS, REACH, BLOCK, TEXTS, WORDS = 0.8, 11, 32, 2048, 256, 1 << 18
#: Columns of the shared shingles of a block that are multiplied at a time; groups of texts in an Arrow batch.
COLUMNS, GROUPS = 1 << 14, 16
#: Partitions that are joined first.
FIRST = 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(raw), 8 << 15):
        total += np.unpackbits(np.frombuffer(raw[k : k + (8 << 15)], dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, column: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with a signed long column of fingerprints."""
    return append_columns(docs, lambda texts: [[f - (1 << 64) if (f := fingerprint(t, shingle)) >> 63 else f for t in texts]], [(column, pa.int64(), "bigint")])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and the 64 x 64 counts of bits set together (the diagonal: each bit), summed map-side over all rows."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        bits = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
        both = (bits.T @ bits).astype(np.int64).ravel()
        return pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([both.tolist()], pa.list_(pa.int64()))], names=["n", "both"])

    workers_find_us(fps.sparkSession)
    fps.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 65536)
    parts = fps.select("fp").mapInArrow(lambda it: (rows(b) for b in it), "n bigint, both array<bigint>")
    sums = parts.select("n", F.posexplode("both").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for r in sums:
        both[r["k"]] = r["c"]
    return (int(sums[0]["n"]) if sums else 0), both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64/m bits: each grown from the bit of the highest remaining correlation by its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for i in range(m):
        size = (64 - sum(map(len, groups))) // (m - i)
        ordered = sorted(left)
        own = [max(ordered, key=lambda b: (round(corr[b, ordered].sum(), 9), -b))]
        left.discard(own[0])
        while len(own) < size:
            b = max(sorted(left), key=lambda b: (round(corr[b, own].sum(), 9), -b))
            own.append(b)
            left.discard(b)
        groups.append(sorted(own))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choose_thresholds(costs: list[list[float]], tau: int, most: int | None = None) -> tuple[float, list[int]]:
    """costs[i][t + 1]: cost of partition i with threshold t (-1..most, or tau). The cheapest T with sum tau - m + 1."""
    m, stop = len(costs), (tau if most is None else most) + 1

    @lru_cache(None)
    def best(i: int, left: int) -> tuple[float, tuple[int, ...]]:
        if i == m:
            return (0.0, ()) if left == 0 else (float("inf"), ())
        return min((costs[i][t + 1] + (rest := best(i + 1, left - t))[0], (t, *rest[1])) for t in range(-1, stop))

    cost, t = best(0, tau - m + 1)
    return cost, list(t)


def partitions(fps: DataFrame, tau: int, numbers: range, most: int, keys_of: Callable[[int], list[int]]) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition of the cheapest layout. numbers: of partitions; most: the largest threshold; keys_of:
    probe keys of a partition of so many bits by threshold."""
    n, both = bit_statistics(fps)
    if n < 2:
        return []
    p = np.diag(both) / n
    agree = 2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-9)
    layouts = {m: group_bits(n, both, m) for m in numbers}
    parts = [(m, i, bits) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    values = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(mask_of(b)))).alias("v")) for k, (_, _, b) in enumerate(parts)))).alias("x")).select("x.*")
    counts = values.groupBy("k", "v").count().groupBy("k").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("pairs")).collect()
    equal = {r["k"]: r["pairs"] for r in counts}
    best = (float("inf"), 0, [])
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            a, w = agree[bits], len(bits)
            e = equal.get(next(k for k, x in enumerate(parts) if x[:2] == (m, i)), 0.0)
            wider = [1.0, 1 + a.sum(), 1 + a.sum() + (a.sum() ** 2 - (a * a).sum()) / 2]
            keys = keys_of(w)
            costs.append([0.0] + [ROW_COST * n * keys[t] + PAIR_COST * e * wider[t] * (1 if t < 1 else keys[t] ** 0.5) for t in range(most + 1)])
        cost, t = choose_thresholds(costs, tau, most)
        if cost < best[0]:
            best = (cost, m, t)
    _, m, thresholds = best
    return list(zip(layouts[m], thresholds))


def plan(fps: DataFrame, tau: int = DISTANCE) -> list[tuple[int, list[int]]]:
    """(mask, bits) of each probe key: a fingerprint's key k is fp & mask."""
    keys = []
    for bits, t in partitions(fps, tau, range(2, tau + 3), tau, lambda w: [1, w, w * (w - 1) // 2]):
        if t == 0:
            keys.append(bits)
        elif t == 1:
            keys += [[b for b in bits if b != x] for x in bits]
        elif t == 2:
            keys += [[b for b in bits if b not in (x, y)] for i, x in enumerate(bits) for y in bits[:i]]
    return [(mask_of(k), k) for k in keys]


def _forest(values: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of values within tau bits."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= tau
    return _spanning(len(values), lambda i: near[i])


def _spanning(n: int, near: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of n nodes; near(i): which nodes i is linked with."""
    left, out = np.ones(n, bool), []
    for k in range(n):
        if not left[k]:
            continue
        left[k] = False
        todo = [k]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near(i) & left).tolist():
                left[j] = False
                out.append((i, j))
                todo.append(j)
    return out


def _first_links(name: np.ndarray, rows: np.ndarray, columns: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """The links between rows and columns that connect what name (which is changed) does not yet tell to be connected."""
    out = []
    for i in rows.tolist():
        own = name[i]
        others = columns[name[columns] != own]
        if not len(others):
            if rows is columns or (name[rows] == own).all():
                break
            continue
        hit = others[near(i, others)]
        if len(hit):
            met, first = np.unique(name[hit], return_index=True)
            out += [(i, j) for j in hit[first].tolist()]
            name[np.isin(name, met)] = own
    return out


def forest(root: np.ndarray, lower: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (places) of a group whose classes, with those of all other groups, are those of all its links. near(i, js): which of
    js i is linked with. root: rows of one root are known to be connected. lower: which rows are of the lower of the two blocks
    that meet here. Where two meet, the links within a block are left to the group of that block alone, so that a large group of
    alike rows has as many links as rows, and not as many for each block."""
    order, name = np.argsort(root, kind="stable"), root.copy()
    low, high = order[lower[order]], order[~lower[order]]
    if not len(low) or not len(high):
        return _first_links(name, order, order, near)
    for side in (low, high):
        _first_links(name, side, side, near)
    return _first_links(name, low, high, near)


def links(fps: DataFrame, tau: int = DISTANCE, small: int = SMALL) -> DataFrame | None:
    """Columns a, b: links between distinct fingerprints whose components are those of all pairs within tau (tau 2 or less)."""
    if tau not in (0, 1, 2):
        raise ValueError("distance must be 0, 1 or 2")
    probes = plan(fps, tau)
    if not probes:
        return None
    masks = F.array(*(F.lit(signed(m)) for m, _ in probes))
    keyed = fps.select("fp", F.posexplode(masks).alias("k", "mask")).select("k", F.col("fp").bitwiseAND(F.col("mask")).alias("v"), "fp")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = durable(split_join(keyed, sizes, ["k", "v"], "n", len(probes) * fps.count()), "buckets")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            v = np.array(members, dtype=np.int64)
            for i, j in _forest(v.view(np.uint64), tau):
                a.append(members[i])
                b.append(members[j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cold = arrow_map(live.where(F.col("n") <= small).groupBy("k", "v").agg(F.collect_list("fp").alias("members")).select("members"), verify, "a bigint, b bigint")
    hot = live.where(F.col("n") > small).select("k", "fp")
    if tau == 0:
        return cold
    flips = F.array(*(F.array(*(F.lit(signed(1 << b)) for b in range(64) if not m >> b & 1)) for m, _ in probes))
    near = hot.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), F.element_at(flips, F.col("k") + 1))).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("c"), "fp")
    stars = near.groupBy("c").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    if tau == 1:
        pairs = stars.where(F.array_contains("s", F.col("c"))).select(F.explode("s").alias("a"), F.col("c").alias("b"))
    else:
        pairs = stars.select(F.explode("s").alias("a"), F.array_min("s").alias("b"))
    return cold.union(pairs.where("a <> b"))


def classes(fingerprints: DataFrame, tau: int = DISTANCE) -> DataFrame:
    """fp, component_id, n (rows of the fp), root for every distinct fp of a table (doc_id, fp)."""
    reps = durable(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    return _named(reps, links(reps, tau))


def _named(reps: DataFrame, found: DataFrame | None) -> DataFrame:
    """fp, component_id, n, root: the smallest doc_id of all fps that links (a, b) connect, and a fp that they have in common."""
    if found is None:
        return reps.select("fp", F.col("first").alias("component_id"), "n", F.col("fp").alias("root"))
    roots = durable(components(found), "roots")
    rooted = reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return split_join(rooted, best, "root", "members", reps.count()).select("fp", "component_id", "n", "root")


def near_duplicates(docs: DataFrame, tau: int | None = None, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id for every row of docs. With tau, fp is the SimHash and classes are those of
    fingerprints within tau bits; without, fp is a hash of the words and classes are those of alike()."""
    return _near(docs, tau, shingle)[0].drop("root")


def _near(docs: DataFrame, tau: int | None, shingle: int = SHINGLE) -> tuple[DataFrame, frozenset[int]]:
    """near_duplicates with each class's root, and the hashes that several texts have."""
    moved: frozenset[int] = frozenset()
    if tau is None:
        rows, found, moved = alike(docs)
    else:
        rows = durable(with_fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "simhash")
        found = classes(rows, tau)
    return split_join(rows, found, "fp", "n", rows.count()).select("doc_id", "fp", "component_id", "root"), moved


def words_hash(text: str | None) -> int:
    return signed(xxhash.xxh64_intdigest(b" ".join(words_of(text)), SEED))


def second_hash(text: str | None) -> int:
    """Another 64 bits of the words: texts are equal if both hashes are."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words_of(text)), SEED))


def moved_on(fp: int, other: int) -> int:
    """What xxhash64(fp, other) is in SQL: the fp of a text whose hash another text has as well."""
    as_bytes = lambda v: (v & ((1 << 64) - 1)).to_bytes(8, "little")
    return signed(xxhash.xxh64_intdigest(as_bytes(other), xxhash.xxh64_intdigest(as_bytes(fp), SEED)))


def identity(text: str | None, moved: frozenset[int]) -> int:
    """The fp of a text's words: their hash, but for those that several texts have."""
    fp = words_hash(text)
    while fp in moved:
        fp = moved_on(fp, second_hash(text))
    return fp


def wide(text: str | None) -> tuple[int, int, int, int, int]:
    """Two hashes of the words, two SimHashes of 64 bits of the distinct runs of two words (signed), and the number of words."""
    words = words_of(text)
    low = high = 0
    if words:
        w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        runs = np.unique(w[:-1] * np.uint64(0x100000001B3) + w[1:]) if len(w) > 1 else w
        votes = np.zeros(128, np.int64)
        for k in range(0, len(runs), 8192):
            both = np.stack([mixed(runs[k : k + 8192], f) for f in (0, 3)], axis=1).view(np.uint8)
            votes += np.unpackbits(both, axis=1).sum(axis=0, dtype=np.int64)
        low, high = np.packbits(2 * votes > len(runs)).view(np.int64).tolist()
    return words_hash(text), second_hash(text), low, high, len(words)


def in_blocks(rows: DataFrame, blocks: Column, by: str) -> DataFrame:
    """rows with i, j and lower (whether i is the row's block): a group of several blocks is met in all pairs of its blocks, each row
    (by the hash of `by`) in those of its own."""
    own, other = F.pmod(F.xxhash64(by), F.col("__blocks")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1))
    dealt = rows.withColumn("__blocks", blocks.cast("bigint")).withColumn("__own", own).withColumn("__other", other)
    return dealt.withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other")).withColumn("lower", F.col("__own") <= F.col("__other")).drop("__blocks", "__own", "__other")


def within(sims: DataFrame, tau: int = RADIUS, reach: int = REACH, block: int = BLOCK) -> DataFrame | None:
    """a, b: of each row (id, s1, s2) that is linked with a smaller one, the smallest that it is connected with. Linked are all pairs
    within tau bits of s1 or of s2, and reach of both.

    The first partition comes alone. With its classes known, the others look for links between rows of different classes only:
    rows of a large class have few links then, in however many keys they meet."""
    least = -(-(tau + 1) // 3)
    probes = []
    for own, other in (("s1", "s2"), ("s2", "s1")):
        probes += [(own, other, bits, t) for bits, t in partitions(sims.select(F.col(own).alias("fp")), tau, range(least, least + 3), 2, lambda w: [1, w + 1, w + 1]) if t >= 0]
    if not probes:
        return None
    known = sims.withColumn("root", F.col("id"))
    for some in (probes[:FIRST], probes[FIRST:]):
        if some:
            roots = durable(components(_between(known, some, tau, reach, block)), "roots")
            known = known.join(roots, known.root == roots.node, "left").select("id", "s1", "s2", F.coalesce(roots.root, known.root).alias("root"))
            known = durable(known, "rooted")
    return known.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def _between(rows: DataFrame, probes: list[tuple[str, str, list[int], int]], tau: int, reach: int, block: int) -> DataFrame:
    """a, b: roots of rows (id, s1, s2, root) that share a key of these probes and are linked."""
    parts = F.array(*(F.struct(F.col(own).alias("x"), F.col(other).alias("y"), F.col(own).bitwiseAND(F.lit(signed(mask_of(bits)))).alias("v")) for own, other, bits, _ in probes))
    flips = F.array(*(F.array(F.lit(0).cast("bigint"), *(F.lit(signed(1 << b)) for b in bits if t)) for _, _, bits, t in probes))
    valued = rows.select("id", "root", F.posexplode(parts).alias("k", "p")).select("id", "root", "k", "p.x", "p.y", "p.v")

    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("flip", F.explode(F.element_at(flips, F.col("k") + 1))).withColumn("c", F.col("v").bitwiseXOR(F.col("flip"))).drop("flip", "v")

    # at most as many as the partitions have values, whatever the input
    large = durable(around(valued.groupBy("k", "v").agg(F.count(F.lit(1)).alias("m"))).groupBy("k", "c").agg(F.sum("m").alias("n")).where(F.col("n") > block), "large")
    keyed = around(valued)
    by = ["k", "c"]
    if large.limit(1).count():
        keyed = in_blocks(keyed.join(F.broadcast(large), by, "left"), F.coalesce(F.ceil(F.col("n") / block), F.lit(1)), "id")
        by += ["i", "j"]
    else:
        keyed = keyed.withColumn("lower", F.lit(True))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(0)
        at, members = column.offsets.to_pylist(), column.values.flatten()
        root, x, y = members[0].to_numpy(), *(m.to_numpy().view(np.uint64) for m in members[1:3])
        lower = members[3].to_numpy(zero_copy_only=False)
        roots, xs, ys = root.tolist(), x.tolist(), y.tolist()
        out = []
        for lo, hi in zip(at, at[1:]):
            if hi - lo == 2:
                if roots[lo] != roots[lo + 1] and (d := (xs[lo] ^ xs[lo + 1]).bit_count()) <= tau and d + (ys[lo] ^ ys[lo + 1]).bit_count() <= reach:
                    out.append((roots[lo], roots[lo + 1]))
                continue
            p, q, r = x[lo:hi], y[lo:hi], root[lo:hi]
            if hi - lo <= SMALL:
                d = np.bitwise_count(p[:, None] ^ p)
                i, j = np.nonzero((d <= tau) & (r[:, None] < r))
                if not len(i):
                    continue
                keep = d[i, j] + np.bitwise_count(q[i] ^ q[j]) <= reach
                if len(i := i[keep]) == 0:
                    continue
                if len(i) == 1:
                    out.append((int(r[i[0]]), int(r[j[keep][0]])))
                    continue
            near = lambda i, js: ((d := np.bitwise_count(p[js] ^ p[i])) <= tau) & (d + np.bitwise_count(q[js] ^ q[i]) <= reach)
            out += [(roots[lo + i], roots[lo + j]) for i, j in forest(r, lower[lo:hi], near)]
        return pa.RecordBatch.from_arrays([pa.array([v[k] for v in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    groups = keyed.groupBy(*by).agg(F.collect_list(F.struct("root", "x", "y", "lower")).alias("g")).where(F.size("g") > 1).select("g")
    return arrow_map(groups, verify, "a bigint, b bigint")


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of these sets (sorted, without repeats) have at least this Jaccard similarity."""
    n = np.array([len(s) for s in sets], np.int64)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), n), np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column = place[which]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for k in range(0, len(shared), COLUMNS):
        lo, hi = np.searchsorted(column, (k, k + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, len(shared) - k)), np.float32)
        has[owner[lo:hi], column[lo:hi] - k] = 1
        common += np.rint(has @ has.T).astype(np.int64)
    np.fill_diagonal(common, n)
    either = n[:, None] + n - common
    return (common > 0) & (common >= similarity * either)


def checked(docs: DataFrame, members: DataFrame, moved: frozenset[int], similarity: float) -> DataFrame:
    """a, b: links between the fps of a component whose components are those of all pairs of its texts that are alike enough.
    members: fp, first, comp, n, w (texts and words of the component)."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("first"), "text").join(members, "first")
    dealt = in_blocks(texts.select("comp", "fp", "text", "n", "w"), F.ceil(F.greatest(F.col("n") / TEXTS, F.col("w") / WORDS)), "fp")
    groups = dealt.groupBy("comp", "i", "j").agg(F.collect_set(F.struct("fp", "text", "lower")).alias("g")).where(F.size("g") > 1).select("g")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k in range(len(batch)):
            sets: dict[int, np.ndarray] = {}
            lower: dict[int, bool] = {}
            for fp, text, low in zip(*(batch.column(0)[k].values.field(f).to_pylist() for f in range(3))):
                if fp not in sets and identity(text, moved) == fp:  # a repeated doc_id may bring other texts
                    sets[fp], lower[fp] = np.unique(shingles(words_of(text))), low
            if len(sets) > 1:
                near, names = similar(list(sets.values()), similarity), list(sets)
                found = forest(np.array(names, np.int64), np.array(list(lower.values())), lambda i, js: near[i, js])
                out += [(names[i], names[j]) for i, j in found]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links_ = arrow_map(groups, verify, "a bigint, b bigint")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", GROUPS)
    return durable(links_, "near", TASK_BYTES)


def alike(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(doc_id, fp) of every row, (fp, component_id), and the hashes that several texts have: classes linked by a Jaccard
    similarity of five-word shingles of at least `similarity`. Equal words (by 128 bits) are one fp. Texts are compared if links
    of fingerprints connect them (within()); what share of alike texts these connect is measured in the tests."""
    fields = [(c, pa.int64(), "bigint") for c in ("fp", "other", "s1", "s2", "words")]
    rows = durable(append_columns(docs.select("doc_id", "text"), lambda texts: list(zip(*map(wide, texts))) or [[]] * 5, fields).drop("text"), "wide")
    moved: frozenset[int] = frozenset()
    while True:
        one = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("s1", "s2", "words")), F.count(F.lit(1)).alias("n"), F.min("other").alias("low"), F.max("other").alias("high"))
        reps = durable(one, "words")
        again = {r["fp"] for r in reps.where("low <> high").select("fp").collect()}  # some hundreds for 10^11 texts
        if not again:
            break
        moved |= again
        discard(reps)
        before = rows
        rows = durable(rows.withColumn("fp", F.when(F.col("fp").isin(*again), F.xxhash64("fp", "other")).otherwise(F.col("fp"))), "bands")
        discard(before)
    # equal fingerprints collapse; fewer words than a shingle are alike only if equal
    long = reps.where("words >= 5")
    sims = durable(long.groupBy("s1", "s2").agg(F.min("fp").alias("id"), F.count(F.lit(1)).alias("m"), F.sum("words").alias("w")), "sims")
    found = within(sims)
    if found is None:
        comps = sims.select("id", "s1", "s2", "m", "w", F.col("id").alias("comp"))
    else:
        comps = sims.join(found, sims.id == found.a, "left").select("id", "s1", "s2", "m", "w", F.coalesce("b", "id").alias("comp"))
    sizes = comps.groupBy("comp").agg(F.sum("m").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("ids")).where("n > 1")
    total = sims.count()
    several = split_join(comps.select("s1", "s2", "m", "comp"), sizes, "comp", "ids", total)
    members = split_join(long.select("fp", "first", "s1", "s2"), several, ["s1", "s2"], "m", reps.count()).select("fp", "first", "comp", "n", "w")
    links_ = checked(docs, durable(members, "members"), moved, similarity)
    return rows.select("doc_id", "fp"), _named(reps, links_), moved


def keep_one(docs: DataFrame, tau: int | None = None) -> DataFrame:
    """One row of each class, the one of the smallest doc_id, with the columns of docs. Rows with a null doc_id stay as they are.

    Where rows of one doc_id hold several texts, each text is of its own class; of rows of the same doc_id and words one stays,
    the first in the order of a hash of all columns.
    """
    known = docs.where("doc_id is not null")
    near, moved = _near(known, tau)
    found = durable(near, "found")
    if not found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        out = known.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    else:
        doc, fp, order = fresh(docs, "doc", "fp", "order")
        hashes = lambda texts: [[identity(t, moved) if tau is None else signed(fingerprint(t)) for t in texts]]
        hashed = append_columns(known.withColumn(order, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))), hashes, [(fp, pa.int64(), "bigint")])
        first = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("x")).select(F.col("x.doc_id").alias(doc), F.col("x.fp").alias(fp))
        rows = hashed.withColumn(doc, F.col("doc_id").cast("bigint")).join(first, [doc, fp], "left_semi")
        out = rows.groupBy(doc, fp).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias("row")).select("row.*")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id is null"))


__all__ = ["alike", "classes", "discard", "fingerprint", "keep_one", "near_duplicates", "with_fingerprints"]
