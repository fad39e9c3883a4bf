"""Importance resampling against a brute-force version, word by word and bucket by bucket."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tallyforge.llm import resampling
from tallyforge.llm.common import read
from tallyforge.llm.entries import op12_resampling

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, size=10_000):
    s, t, rows = [0] * size, [0] * size, []
    bucket = lambda f: zlib.crc32(f.encode()) % size
    for _, x in docs:
        for f in features(x)[1]:
            s[bucket(f)] += 1
    for x in target:
        for f in features(x)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + size) / ((s[k] + 1) * (sum(t) + size)))) for k in range(size)]
    for i, x in docs:
        words, found = features(x)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    want = brute(docs, [r.text for r in read(spark, DATA, "benchmark").collect()])
    assert rows_of(op12_resampling(spark, DATA)) == want


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    prose = [" ".join(f"Wörd{x}" for x in rng.zipf(1.4, 60) % 500) for _ in range(40)]
    rows = [(i, p) for i, p in enumerate(prose)] + [(0, prose[0]), (5, "x1\x00y-Z\x7fß" * 3000), (None, None), (None, prose[3]), (-(1 << 63), ""), (77, "AA aa Aa_a   ÀÉ é"), (78, "only " * 19), (79, "only " * 20)]
    return rows, spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, score string, rank int")


def test_odd_rows_small_chunks_and_many_ranges(spark, odd, monkeypatch):
    rows, df = odd
    target = spark.createDataFrame([(1, "Wörd1 wörd2 only only"), (2, None)], "item_id bigint, text string")
    want = brute(rows, ["Wörd1 wörd2 only only", None])
    assert rows_of(resampling.resample(df, target)) == want
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    assert rows_of(resampling.resample(df, target)) == want


def test_chunks_of_any_size_count_alike(odd):
    texts = [t and t.encode() for _, t in odd[0]]
    whole = resampling.Chunk(texts)
    assert (sum(resampling.Chunk([t]).counts() for t in texts) == whole.counts()).all()
    gains = np.arange(10_000) - 5000
    n, total = whole.sums(gains)
    for k, t in enumerate(texts):
        own = resampling.Chunk([t]).sums(gains)
        assert (own[0][0], own[1][0]) == (n[k], total[k])
    longer = resampling.Chunk(texts, ngram=3)
    assert longer.counts().sum() == sum(max(0, len(features(t)[0]) - k) for _, t in odd[0] for k in range(3))


def test_no_rows(spark, odd):
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert resampling.resample(odd[1].limit(0), target).count() == 0
    assert rows_of(resampling.resample(odd[1], target)) == brute(odd[0], [])
