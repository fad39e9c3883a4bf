"""Texts whose 64-bit hashes are equal stay different texts in the pipeline's near-duplicate stage."""

import pytest

from tallyforge.llm import simhash


def prose(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


ROWS = [(1, prose(1)), (2, prose(2)), (3, prose(1)), (4, "short"), (5, None), (6, prose(1) + " and more"), (7, prose(3)), (7, prose(4)), (8, "short"), (None, prose(2))]


def kept(spark):
    return sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_one(spark.createDataFrame(ROWS, "doc_id bigint, text string")).collect())


@pytest.mark.parametrize("hashes", [lambda text: 7, lambda text: len(text or "") % 3, lambda text: simhash.signed(1 << 63)])
def test_forced_collisions_change_nothing(spark, monkeypatch, hashes):
    want = kept(spark)
    assert [i for i, _ in want] == [0, 1, 2, 4, 5, 7, 7]
    monkeypatch.setattr(simhash, "words_hash", hashes)
    assert kept(spark) == want


def test_moved_hash_is_that_of_sql(spark):
    for a, b in ((1, 2), (-5, 1 << 62), (-(1 << 63), -1)):
        assert spark.sql(f"SELECT xxhash64({a}L, CAST('{b}' AS BIGINT))" if a > -(1 << 63) else f"SELECT xxhash64(CAST('{a}' AS BIGINT), {b}L)").first()[0] == simhash.moved_on(a, b)
