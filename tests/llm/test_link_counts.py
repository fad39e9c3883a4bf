"""The near-duplicate stage hands on links in proportion to its rows, not to the pairs of a group."""

import numpy as np

from tallyforge.llm import simhash


def test_links_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    """400 near copies of one text: far fewer links than pairs, and the classes of all pairs (which 30 other texts do not join)."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(400):
        w = list(base)
        for at in rng.choice(300, int(rng.integers(2, 5)), replace=False):
            w[at] = f"e{k}_{at}"
        texts.append(" ".join(w))
    texts += [" ".join(f"o{k}x{i}" for i in range(100)) for k in range(30)]
    counts, components = [], simhash.components

    def counted(links):
        counts.append(links.where("a <> b").selectExpr("least(a, b)", "greatest(a, b)").distinct().count())
        return components(links)

    monkeypatch.setattr(simhash, "components", counted)
    monkeypatch.setattr(simhash, "TEXTS", 16)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert max(counts) >= 399 and sum(counts) <= 6 * 400
    assert all(got[i] == (0 if i < 400 else i) for i in got)


def test_blocks_that_meet_leave_inner_links_to_their_own_group():
    near = lambda i, js: np.ones(len(js), bool)
    root, lower = np.arange(10), np.arange(10) < 5
    assert len(simhash.forest(root, np.ones(10, bool), near)) == 9 and len(simhash.forest(root, lower, near)) == 1
    apart = lambda i, js: js // 2 == i // 2
    assert simhash.forest(root, lower, apart) == [(4, 5)]
    assert simhash.forest(np.zeros(10, np.int64), lower, near) == []
    even = lambda i, js: (js - i) % 5 == 0  # noqa: E731  equal numbers of rows on both sides
    assert simhash.forest(root, lower, even) == [(i, i + 5) for i in range(5)]
