"""Mixing over leaves with nulls in their path, and with leaves joined in parts instead of by broadcast."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing


def taken(df):
    return sorted((r.doc_id, r.source, r.lang, r.epoch, r.n_tokens) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    # source s0 holds two thirds of the rows; every fifth row has no language, every seventh no source
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "case when id % 7 = 0 then null else concat('s', case when id % 3 > 0 then 0 else id % 50 end) end as source", "case when id % 5 > 0 then concat('l', id % 2) end as lang", "'x' as size")
    return df.persist()


@pytest.mark.parametrize("rows", [20_000, 1])
def test_leaves_in_parts(docs, monkeypatch, rows):
    monkeypatch.setattr(mixing, "SORT_ROWS", rows)
    args = (["lang", "source"], {("l0",): 2.0}, 0.7, 2)
    want = taken(mixing.mix(docs, *args))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert taken(mixing.mix(docs, *args)) == want


def test_null_leaves_have_their_share(docs):
    got = mixing.mix(docs, ["lang", "source"], {}, 0.5).groupBy(F.to_json(F.array("lang", "source")).alias("leaf")).agg(F.sum("n_tokens").alias("t")).collect()
    have = {tuple(json.loads(r.leaf)): r.t for r in docs.groupBy(F.to_json(F.array("lang", "source")).alias("leaf")).agg(F.sum(mixing.tokens_of()).alias("t")).collect()}
    want = mixing.allocate(have, {}, int(sum(have.values()) * 0.5), 1)
    taken_ = {tuple(json.loads(r.leaf)): r.t for r in got}
    assert any(None in k for k in want) and all(0 <= want[k] - taken_.get(k, 0) < 7 for k in want)
