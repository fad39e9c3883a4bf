"""The toxicity model is trained by a task, not on the driver."""

from tallyforge.llm import toxicity


def test_same_model_without_texts_on_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    want = toxicity.train(toxicity.labelled_sample(docs, labels))
    monkeypatch.setattr(toxicity, "labelled_sample", None)  # would bring the texts to the driver
    assert toxicity.learned(docs, labels) == want
    assert toxicity.learned(docs, labels.limit(0)) == toxicity.train([])
    assert toxicity.classify(docs, labels).count() == docs.count()
