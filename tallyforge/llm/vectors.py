"""Compression of vectors to codes of four parts, each coded by the nearest of up to 256 entries of its position's codebook.

Components become integers, floor(1024 * x), so everything that follows is exact. A codebook is refined in rounds: a pass over
all vectors assigns their parts and adds them up within each task; sums of tasks meet by (part, entry, position), and only the
entries themselves (256 of a part at most, whatever the input) come to the driver and go out with the next pass.

The nearest entry is searched in a ball tree of a part's entries, built anew each round: a ball's centre is one of its entries,
its radius is rounded up, a query's distance to the centre down, and a ball is passed over only if it surely is farther away
than the best entry so far (an equal bound is visited, as ties go to the lower entry). What a leaf holds is compared by integer
squared distances. All queries of a batch go down the tree together, each first to its nearer child.

Vectors that are null, or hold null, NaN or infinite components, are dropped. Vectors of another length than the first kept one
(by vec_id), or whose length is no positive multiple of four, stay with a null code and error. Null vec_ids count as the largest
and repeated ones are rows of their own; an error beyond a long is null (vectors are of floats: components of any size are exact,
those too large for doubles at the pace of Python integers); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import durable, split_join, workers_find_us

#: A vector is cut into PARTS; a codebook has at most ENTRIES; a ball of at most LEAF entries is not split.
PARTS, ENTRIES, ROUNDS, LEAF = 4, 256, 4, 16
#: Vectors that go down the trees together.
TOGETHER = 4096
#: Sums of components travel as high * LIMB + low.
LIMB = 1 << 60
#: Whole numbers below this are exact in doubles.
EXACT = 1 << 52


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): doubles while these hold it, else Python integers."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 1 << 42:
        return np.floor(x * 1024)
    return np.array([int(v) * 1024 if abs(v) >= 1 << 52 else math.floor(v * 1024) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def in_doubles(*values: np.ndarray) -> bool:
    """Whether squared distances of such vectors are exact in doubles."""
    most = max((int(max(abs(v.max()), abs(v.min()))) for v in values if v.size), default=0)
    return 4 * max(1, values[0].shape[-1]) * most * most < EXACT


def squares(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of rows of q to rows of e, exact: in doubles, or in Python integers where the arrays hold these."""
    if q.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(x, y)) for y in e.tolist()] for x in q.tolist()], dtype=object).reshape(len(q), len(e))
    return (q * q).sum(1)[:, None] - 2 * (q @ e.T) + (e * e).sum(1)


def root_down(d2: np.ndarray) -> np.ndarray:
    """A whole number that is not above the root."""
    if d2.dtype == object:
        return np.array([math.isqrt(v) for v in d2], dtype=object)
    return np.maximum(np.floor(np.sqrt(d2)) - 1, 0)


@dataclass
class Ball:
    centre: int
    radius: int
    members: np.ndarray
    halves: tuple[Ball, Ball] | None = None


def ball_tree(entries: np.ndarray, leaf: int = LEAF) -> Ball:
    """entries: doubles or objects with whole numbers, one entry a row."""
    apart = squares(entries, entries)

    def build(members: np.ndarray) -> Ball:
        inside = apart[np.ix_(members, members)]
        widest = inside.max(axis=1)
        at = int(widest.argmin())
        ball = Ball(int(members[at]), math.isqrt(int(widest[at])) + 1, members)
        if len(members) > leaf:
            one = int(inside[at].argmax())
            other = int(inside[one].argmax())
            order = np.argsort(inside[one] - inside[other], kind="stable")
            half = len(order) // 2
            ball.halves = build(np.sort(members[order[:half]])), build(np.sort(members[order[half:]]))
        return ball

    return build(np.arange(len(entries)))


def nearest(q: np.ndarray, entries: np.ndarray, tree: Ball) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of q; ties go to the lower entry. q and entries: both doubles or both objects."""
    exact = q.dtype == object
    best = np.full(len(q), None if exact else np.inf, dtype=object if exact else np.float64)
    if exact:
        best[:] = [float("inf")] * len(q)
    found = np.full(len(q), len(entries), dtype=np.int64)

    def visit(ball: Ball, rows: np.ndarray, to_centre: np.ndarray) -> None:
        least = np.maximum(root_down(to_centre) - ball.radius, 0)
        near = (least * least <= best[rows]).astype(bool)
        rows = rows[near]
        if not len(rows):
            return
        if ball.halves is None:
            d2 = squares(q[rows], entries[ball.members])
            k = d2.argmin(axis=1)
            d2, k = d2[np.arange(len(rows)), k], ball.members[k]
            better = ((d2 < best[rows]) | ((d2 == best[rows]) & (k < found[rows]))).astype(bool)
            best[rows[better]], found[rows[better]] = d2[better], k[better]
            return
        one, other = ball.halves
        d2 = squares(q[rows], entries[[one.centre, other.centre]])
        first = (d2[:, 0] <= d2[:, 1]).astype(bool)
        for a, b, i, j, own in ((one, other, 0, 1, first), (other, one, 1, 0, ~first)):
            if own.any():
                visit(a, rows[own], d2[own, i])
                visit(b, rows[own], d2[own, j])

    if len(q):
        visit(tree, np.arange(len(q)), squares(q, entries[[tree.centre]])[:, 0])
    return found, best


class Codebooks:
    """Entries of each part, as Python integers, and the searches over them."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        as_objects = [np.array(e, dtype=object).reshape(len(e), -1) for e in entries]
        self.small = in_doubles(*as_objects)
        self.doubles = [e.astype(np.float64) for e in as_objects] if self.small else None
        self.objects = as_objects
        self.trees = [ball_tree(e) for e in (self.doubles or self.objects)]

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of whole vectors, a column for each part."""
        small = self.small and v.dtype != object and in_doubles(v)
        parts = np.split(v if small else v.astype(object), PARTS, axis=1)
        if not small:
            parts = [np.array([[int(x) for x in r] for r in p.tolist()], dtype=object).reshape(p.shape) for p in parts]
        got = [nearest(p, e, t) for p, e, t in zip(parts, self.doubles if small else self.objects, self.trees)]
        return np.stack([k for k, _ in got], axis=1), np.stack([d for _, d in got], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of at least TOGETHER rows, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def numbers(t: pa.Table, length: int) -> np.ndarray:
    flat = t.column("embedding").combine_chunks()
    return whole(np.asarray(flat.flatten()).reshape(-1, length))


def adder(books: Codebooks, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums and counts of a task's parts by entry: one row for each (part, entry, position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m = max(map(len, books.entries)), length // PARTS
        plain, large, counts = np.zeros((PARTS, n, m), dtype=np.int64), np.zeros((PARTS, n, m), dtype=object), np.zeros((PARTS, n), dtype=np.int64)
        for t in gathered(batches):
            v = numbers(t, length)
            codes, _ = books.assign(v)
            fits = v.dtype != object and in_doubles(v)
            for p, part in enumerate(np.split(v, PARTS, axis=1)):
                np.add.at(counts[p], codes[:, p], 1)
                if fits:
                    np.add.at(plain[p], codes[:, p], part.astype(np.int64))
                else:
                    for k, row in zip(codes[:, p].tolist(), part.tolist()):
                        large[p, k] += np.array([int(x) for x in row], dtype=object)
        part, entry = np.nonzero(counts)
        sums = [divmod(int(a) + int(b), LIMB) for p, k in zip(part, entry) for a, b in zip(plain[p, k], large[p, k])]
        each = lambda x: np.repeat(x, m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(each(part), pa.int32()), pa.array(each(entry), pa.int32()), pa.array(np.tile(np.arange(m), len(part)), pa.int32()), pa.array(each(counts[part, entry]), pa.int64()), pa.array([Decimal(h) for h, _ in sums], pa.decimal128(38, 0)), pa.array([low for _, low in sums], pa.int64())],
            names=["part", "entry", "at", "n", "high", "low"],
        )

    return run


def coder(books: Codebooks, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            codes, d2 = books.assign(numbers(t, length))
            errors = [sum(map(int, r)) for r in d2.tolist()]
            yield pa.RecordBatch.from_arrays([t.column("vec_id").combine_chunks(), t.column("label").combine_chunks(), pa.array([bytes(r).hex() for r in codes.astype(np.uint8)], pa.string()), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def refined(rows: DataFrame, books: Codebooks, length: int) -> Codebooks:
    """The codebooks after one round: each entry the floored mean of its parts; unused entries stay."""
    sums = rows.select("embedding").mapInArrow(adder(books, length), "part int, entry int, at int, n bigint, high decimal(38,0), low bigint")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    entries = [[list(e) for e in part] for part in books.entries]
    for r in sums.groupBy("part", "entry", "at").agg(wide("n"), wide("high"), wide("low")).collect():  # PARTS x ENTRIES x positions at most
        entries[r["part"]][r["entry"]][r["at"]] = (int(r["high"]) * LIMB + int(r["low"])) // int(r["n"])
    return Codebooks(entries)


def kept(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    return vectors.where("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").select("vec_id", "embedding", "label")


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[Codebooks | None, int]:
    """(codebooks, length) of kept vectors; no codebooks where no vector can be cut."""
    workers_find_us(vectors.sparkSession)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(1).collect()
    length = len(first[0]["embedding"]) if first else 0
    if not length or length % PARTS:
        return None, length
    rows = vectors.where(F.size("embedding") == length)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    v = whole(np.array([r["embedding"] for r in start], dtype=np.float64))
    books = Codebooks([[[int(x) for x in e] for e in part.tolist()] for part in np.split(v, PARTS, axis=1)])
    for _ in range(rounds):
        books = refined(rows, books, length)
    return books, length


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept vector."""
    spark = vectors.sparkSession
    rows = kept(vectors)
    books, length = train(rows, rounds)
    kinds = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error bigint"
    rest = rows if books is None else rows.where(F.size("embedding") != length)
    coded = rest.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if books is not None:
        workers_find_us(spark)
        coded = rows.where(F.size("embedding") == length).mapInArrow(coder(books, length), kinds).unionByName(coded)
    coded = durable(coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    sums = coded.groupBy("__label").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    out = split_join(coded, sums, "__label", "__n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, by comparing every part with every entry. Vectors of one length that is a multiple of four."""
    parts = f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, k AS part, q[k * len(q) // {PARTS} + 1 : (k + 1) * len(q) // {PARTS}] AS q FROM v, range({PARTS}) r(k)),
e0 AS MATERIALIZED (SELECT part, rid AS entry, q AS e FROM p WHERE rid < {ENTRIES})"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, part, any_value(q) AS q, min({{'d': d, 'entry': entry}}) AS best FROM (SELECT p.rid, p.part, p.q, e.entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.q, e.e)]) AS d FROM p JOIN e{k} e USING (part)) GROUP BY rid, part)")
        if k < rounds:
            sums = f"SELECT part, best.entry AS entry, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best, q, unnest(range(1, len(q) + 1)) AS i FROM a{k}) GROUP BY ALL"
            means = f"SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM ({sums}) GROUP BY part, entry"
            steps.append(f"e{k + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.e, o.e) AS e FROM e{k} o LEFT JOIN ({means}) m USING (part, entry))")
    return f"""WITH {parts},
{''',
'''.join(steps)},
c AS (SELECT rid, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(coalesce(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry), '')) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), h"""
