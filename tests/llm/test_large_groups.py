"""Links between texts of one large group of windows, neither of which is the group's first text."""

import numpy as np

from tallyforge.llm import substring


def rare(rng, f):
    """Five words whose shingle is smaller by function f than any of some hundreds of others."""
    runs = [[b"r%d" % i for i in rng.integers(0, 1 << 40, 5)] for _ in range(4000)]
    return min(runs, key=lambda r: int(substring.mixed(substring.shingles(r), f)[0]))


def test_no_link_is_left_out(spark):
    """All minima lie in a passage of 20 words that all texts share; both half-width runs around it hold an edit."""
    rng = np.random.default_rng(5)
    middle = [w for f in range(substring.HASHES) for w in rare(rng, f)]
    texts = []
    for _ in range(12):
        a, b = ([b"w%d" % i for i in rng.integers(0, 1 << 40, n)] for n in (37, 38))
        texts.append([*a, *middle, *b])
        texts.append([*a[:34], b"other", *a[35:], *middle, *b[:3], b"thing", *b[4:]])
    x = [substring.shingles(t) for t in texts]
    want = {(j, i) for i in range(24) for j in range(i + 1, 24) if substring.jaccard(x[i], x[j]) >= 0.8}
    assert want == {(2 * k + 1, 2 * k) for k in range(12)}
    got = substring.passages(spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.match_doc_id) for r in got} == want and all(r.class_id == r.doc_id // 2 * 2 for r in got)
