"""The toxicity and mixing stages of the pipeline against plain versions, on a whole small table."""

from pyspark.sql import functions as F

import corpus_pipeline
from test_toxicity_scores import again

from tallyforge.llm import mixing, toxicity
from tallyforge.llm.common import read

DATA = "/root/testdata/sf0.001"


def test_toxicity_stage(spark):
    docs = read(spark, DATA, "documents")
    model = toxicity.train(toxicity.labelled_sample(docs, read(spark, DATA, "labels")))
    got = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect() if again(r.text, model) < 0.5}


def test_mixing_stage(spark):
    docs = read(spark, DATA, "documents")
    domain = mixing.domain_of().alias("domain")
    rows = docs.select("doc_id", domain, "lang", "source", mixing.tokens_of().alias("t"), F.xxhash64(F.lit(7), F.lit(0), "doc_id", F.xxhash64("text")).alias("h")).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    have = {k: sum(r.t for r in v) for k, v in leaves.items()}
    want = set()
    for leaf, room in mixing.allocate(have, {}, int(sum(have.values()) * corpus_pipeline.KEPT_TOKENS), 1).items():
        for r in sorted(leaves[leaf], key=lambda r: r.h):
            if r.t > room:
                break
            room -= r.t
            want.add(r.doc_id)
    got = corpus_pipeline.mix_sources(spark, docs, DATA)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)
