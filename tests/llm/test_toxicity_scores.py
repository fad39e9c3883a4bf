"""Scores worked out again, one document at a time, from the two dictionaries and the curve."""

import math

import pytest
import zstandard

from tallyforge.llm import toxicity
from tallyforge.llm.common import read

DATA = "/root/testdata/sf0.001"


def again(text, model):
    """The score by its definition: bytes that the toxic dictionary saves in each window, against the curve."""
    plain, toxic = ((lambda d: zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False))(d) for d in (model.base, model.base + model.tail))
    saved = [len(plain.compress(w)) - len(toxic.compress(w)) for w in toxicity.windows(text)]
    large = [d for d in saved if d > model.cut]
    a, b, c = model.weights
    z = a + b * math.log1p(20 * sum(large) / (len(saved) + toxicity.SMOOTH)) + c * math.sqrt(max(large, default=0))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_of_a_whole_table(spark):
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    assert model.tail
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = again(r.text, model)
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_windows_hold_the_whole_text():
    text = " ".join(f"Wort{i}" for i in range(500))
    joined = b" ".join(toxicity.windows(text)).split()
    assert set(joined) == {w.encode() for w in text.lower().split()}


def test_several_labels_of_one_document(spark):
    """A document is toxic to the training if any of its label rows says so."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i in range(40) for x in ((0, 1) if i % 2 else (0,))], "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, labels)
    assert {i: t for i, _, t in sample} == {i: i % 2 for i, _, _ in sample} and len(sample) > 25
