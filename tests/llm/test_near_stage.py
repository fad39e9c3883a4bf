"""The near-duplicate stage goes by SimHash and the generalised pigeonhole: links of fingerprints against all pairs, the classes of
large components against all pairs of texts, and the share of alike texts that the radius reaches."""

import numpy as np
import pytest

from tallyforge.llm import simhash
from tallyforge.llm.substring import shingles, words_of

U = np.uint64


def reached(texts):
    """Which of all pairs of texts are within the radius."""
    s = np.array([simhash.wide(t)[2:4] for t in texts], np.int64).view(U)
    d = np.bitwise_count(s[:, None] ^ s).astype(int)
    return (d.min(axis=2) <= simhash.RADIUS) & (d.sum(axis=2) <= simhash.REACH)


def roots(near):
    root = list(range(len(near)))
    while (new := [min(root[j] for j in np.flatnonzero(n)) for n in near]) != root:
        root = new
    return root


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_links_of_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (30, 2)).astype(U)
    rows = []
    for b in base:
        for _ in range(6):
            flips = [sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 13)), replace=False)) for _ in range(2)]
            rows.append([int(b[0]) ^ flips[0], int(b[1]) ^ flips[1]])
    s = np.array(rows, U)
    d = np.bitwise_count(s[:, None] ^ s).astype(int)
    want = roots((d.min(axis=2) <= simhash.RADIUS) & (d.sum(axis=2) <= simhash.REACH))
    signed = s.view(np.int64).tolist()
    sims = spark.createDataFrame([(i, *v) for i, v in enumerate(signed)], "id bigint, s1 bigint, s2 bigint")
    got = {r.node: r.root for r in simhash.components(simhash.within(sims, block=block)).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == want and len(set(want)) > 30


def test_large_component_in_blocks(spark, monkeypatch):
    """70 texts of one component of fingerprints, compared in blocks of 16: the classes are those of all pairs."""
    rng = np.random.default_rng(16)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(70):
        w = list(base)
        for at in rng.choice(200, int(rng.integers(1, 6)), replace=False):
            w[at] = f"e{k}_{at}"
        texts.append(" ".join(w))
    sets = [np.unique(shingles(words_of(t))) for t in texts]
    near = simhash.similar(sets, 0.8)
    plain = [[len(set(x.tolist()) & set(y.tolist())) >= 0.8 * len(set(x.tolist()) | set(y.tolist())) for y in sets] for x in sets]
    assert near.tolist() == plain and len(set(roots(reached(texts)))) == 1 and len(set(roots(near))) > 1
    monkeypatch.setattr(simhash, "TEXTS", 16)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(70)] == roots(near)


def test_share_of_alike_texts_within_the_radius():
    """Pairs that share just over 0.8 of their five-word runs: words edited here and there, and a text that goes on."""
    rng = np.random.default_rng(8)
    found = {"edited": [], "longer": []}
    for k in range(300):
        n = int(rng.integers(100, 600))
        p = [f"w{i}" for i in rng.zipf(1.3, n) % 5000]
        for kind in found:
            q = list(p)
            if kind == "edited":
                for at in rng.choice(n, max(1, n // 46), replace=False):
                    q[at] = f"e{k}_{at}"
            else:
                q += [f"x{i}" for i in rng.integers(0, 10**6, n // 5)]
            x, y = (set(shingles(w).tolist()) for w in ([v.encode() for v in p], [v.encode() for v in q]))
            if 0.8 <= len(x & y) / len(x | y) < 0.86:
                found[kind].append(bool(reached([" ".join(p), " ".join(q)])[0, 1]))
    share = {k: np.mean(v) for k, v in found.items()}
    print(share, {k: len(v) for k, v in found.items()})
    assert min(map(len, found.values())) >= 100 and share["edited"] >= 0.98 and share["longer"] >= 0.9
