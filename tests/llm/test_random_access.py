"""Random access into Re-Pair shards: every cut of every document, and how many rules a cut looks at."""

import numpy as np
import pytest

from tallyforge.llm import tokens


def shard(seed, sizes, words=40):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(3, 60, rng.integers(2, 30)) for _ in range(words)]
    docs = []
    for n in sizes:
        x = np.concatenate([phrases[i] for i in rng.integers(0, words, n)]) if n else np.zeros(0, int)
        docs.append(np.append(x, tokens.END_ID).astype(np.uint32))
    return docs, tokens.Shard(tokens.pack_shard(list(range(len(docs))), docs, 0))


@pytest.fixture(autouse=True)
def many_rules(monkeypatch):
    monkeypatch.setattr(tokens, "MIN_PAIR", 3)


@pytest.mark.parametrize("seed", range(4))
def test_every_cut(seed):
    docs, s = shard(seed, [6, 0, 9, 1, 4, 200])
    assert len(s.rules) > 50 and s.lengths.max() > 8
    for k, x in enumerate(docs[:5]):
        assert (s.document(k) == x).all()
        for i in range(len(x) + 1):
            for j in range(i, len(x) + 1):
                assert s.ids(k, i, j).tolist() == x[i:j].tolist()
    big = docs[5]
    rng = np.random.default_rng(seed)
    for i, j in rng.integers(-5, len(big) + 5, (300, 2)).tolist():
        assert s.ids(5, i, j).tolist() == big[i:j].tolist()
    assert (s.document(5) == big).all() and (s.all() == np.concatenate(docs)).all()


def test_one_id_looks_at_one_path_of_rules():
    docs, s = shard(9, [3000] * 4, words=12)
    depth = np.zeros(len(s.rules), int)
    for k, pair in enumerate(s.rules.tolist()):
        depth[k] = 1 + max(depth[x - tokens.FIRST_RULE] if x >= tokens.FIRST_RULE else 0 for x in pair)
    assert len(s.rules) > 5 * depth.max() and s.lengths.max() > 20, (len(s.rules), depth.max(), s.lengths.max())
    for i in np.random.default_rng(1).integers(0, len(docs[2]), 500).tolist():
        s.visited = 0
        assert s.ids(2, i, i + 1)[0] == docs[2][i] and s.visited <= depth.max()
    s.visited = 0
    s.ids(2, 1000, 1100)
    assert s.visited <= 100 + 2 * depth.max()
