"""Codes of vectors against a brute-force version in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from tallyforge.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, error string, n int"


def brute(rows, rounds=4):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    length = len(kept[0][1])
    same = [r for r in kept if len(r[1]) == length and length and length % 4 == 0]
    cut = lambda v: [v[k * length // 4 : (k + 1) * length // 4] for k in range(4)]
    parts = [cut([math.floor(1024 * np.float64(np.float32(x))) if abs(x) < 1e15 else 1024 * int(np.float32(x)) for x in r[1]]) for r in same]
    books = [[p[k] for p in parts[:256]] for k in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(p[k], e), j) for j, e in enumerate(books[k])) for k in range(4)] for p in parts]
    for _ in range(rounds):
        got = assign()
        for k in range(4):
            for j in range(len(books[k])):
                own = [p[k] for p, g in zip(parts, got) if g[k][1] == j]
                if own:
                    books[k][j] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in assign()]
    sums = {}
    for r, e in zip(same, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    fits = lambda x: x if x < 1 << 63 else None
    out = [(r[0], "".join(f"{j:02x}" for _, j in g), fits(e), r[2], digest) for r, g, e in zip(same, assign(), errors)]
    return out + [(r[0], None, None, r[2], digest) for r in kept if r not in same], sums


def rows_of(df, label):
    return sorted(((r.vec_id, r.code, r.error, label[r.vec_id], r.codebooks_sha256) for r in df.collect()), key=str)


def made(n, length, seed, values=None):
    rng = np.random.default_rng(seed)
    v = rng.choice(values, (n, length)) if values else rng.normal(0, 0.3, (n, length))
    return [(int(i), [float(np.float32(x)) for x in row], int(i) % 3 or None) for i, row in zip(rng.permutation(n), v)]


@pytest.mark.parametrize(("n", "length", "values"), [(600, 16, None), (700, 8, [0.0, 0.001, -0.001, 0.5]), (40, 12, None), (300, 4, [1e9, -3e38, 2.5, 0.0])])
def test_against_brute_force(spark, n, length, values):
    rows = made(n, length, n, values)
    want, sums = brute(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = vectors.encode(df)
    assert rows_of(got, {r[0]: r[2] for r in rows}) == sorted(want, key=str)
    if not values or max(values) < 1:
        assert {r.label_error for r in got.collect()} == set(sums.values())


def test_odd_rows(spark):
    rows = made(30, 8, 1)
    odd = [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] * 8, None), (104, [0.5] * 4, 1), (105, [], 2), (None, [0.25] * 8, None), (7, rows[3][1], 1)]
    df = spark.createDataFrame([(*r, None, None) for r in rows + odd], SCHEMA)
    want, _ = brute(rows + odd)
    got = vectors.encode(df).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in got), key=str) == sorted(((i, c, e, h) for i, c, e, _, h in want), key=str)
    assert {r.vec_id: r.code for r in got if r.vec_id in (104, 105)} == {104: None, 105: None}
    assert vectors.encode(df.limit(0)).count() == 0
    assert [(r.code, r.error) for r in vectors.encode(df.where("vec_id = 104")).collect()] == [("00000000", 0)]
    assert [r.code for r in vectors.encode(df.where("vec_id = 105")).collect()] == [None]


@pytest.mark.parametrize("leaf", [1, 4, 16, 300])
def test_tree_finds_what_a_scan_finds(leaf):
    rng = np.random.default_rng(leaf)
    for scale in (2, 50, 4000):
        entries, q = np.floor(rng.normal(0, scale, (200, 6))), np.floor(rng.normal(0, scale, (500, 6)))
        d2 = vectors.squares(q, entries)
        for kind in (np.float64, object):
            e, x = (a if kind is np.float64 else np.array([[int(v) for v in r] for r in a.tolist()], dtype=object) for a in (entries, q[:60]))
            found, best = vectors.nearest(x, e, vectors.ball_tree(e, leaf))
            assert (found == d2[:60].argmin(1)).all() and [int(b) for b in best] == d2[:60].min(1).astype(int).tolist()
        found, _ = vectors.nearest(q, entries, vectors.ball_tree(entries, leaf))
        assert (found == d2.argmin(1)).all()


def test_balls_are_passed_over():
    rng = np.random.default_rng(0)
    centres = rng.integers(-5000, 5000, (16, 8))
    entries = np.array([c + d for c in centres for d in rng.integers(-20, 20, (16, 8))], dtype=np.float64)
    compared, plain = [], vectors.squares
    try:
        vectors.squares = lambda q, e: compared.append(len(q) * len(e)) or plain(q, e)
        tree = vectors.ball_tree(entries)
        compared.clear()
        vectors.nearest(entries + 3, entries, tree)
    finally:
        vectors.squares = plain
    assert sum(compared) < len(entries) ** 2 / 3
