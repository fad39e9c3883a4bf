"""Every operator and every stage on the same awkward table: nulls in all columns, empty and very long texts, ties, repeated rows,
one doc_id with several texts, wide ids, and extra columns whose names clash with helpers; and on no rows at all."""

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, fingerprint, licenses, mixing, packing, quality, resampling, secrets, simhash, substring, tokens, toxicity
from tallyforge.llm.entries import tokenizer_path

CLASH = ["score", "epoch", "n_tokens", "leaf", "hash", "left", "end", "order", "doc", "fp", "domain", "h1", "words", "__canon", "__part", "rid", "shard", "bin", "spans", "__redacted", "__score", "__leaf", "__tokens"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG = " ".join(f"word{i} of{i % 7}" for i in range(60_000))
PROSE = " ".join(f"w{i}" for i in range(80))
ROWS = [
    (1, PROSE, "en", "src1"), (2, PROSE, "en", "src1"), (2, PROSE, "en", "src1"), (3, "other words " + PROSE[40:], "de", "src2"), (3, PROSE, None, None), (4, None, "en", "src1"), (5, "", "en", "src0"), (6, " \n\t ", None, "src0"),
    (None, "a text without id", "en", None), (None, None, None, None), (9 * 10**18, LONG, "fr", "src3"), (-9 * 10**18, "tiny", "fr", "a\u0001b"), (-(1 << 63), "smallest", "fr", "\u0002null"), (7, "user=alice token='abcdef123' é́", "es", "src1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, source, None if i == 7 else len(t or ""), *["clash"] * len(CLASH)) for i, t, lang, source in ROWS], SCHEMA).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, None), (2, 0, None), (4, 1, None), (None, 1, None), (7, None, None), (5, 1, None), (3, 1, "x")], "doc_id bigint, toxic int, text string")


def ids(df):
    return sorted((r[0] is not None, r[0] or 0) for r in df.select("doc_id").collect())


def everyone():
    return sorted((r[0] is not None, r[0] or 0) for r in ROWS)


OPERATORS = {
    "quality": lambda d, labels: quality.judge(d),
    "packing": lambda d, labels: packing.pack(d).where("chunk = 0"),
    "simhash": lambda d, labels: simhash.near_duplicates(d, simhash.DISTANCE),
    "near": lambda d, labels: simhash.near_duplicates(d),
    "toxicity": lambda d, labels: toxicity.classify(d, labels),
    "fingerprint": lambda d, labels: fingerprint.edited_pairs(d),
    "group": lambda d, labels: fingerprint.group(d),
    "licenses": lambda d, labels: licenses.scan(d),
    "tokens": lambda d, labels: tokens.read_back(tokens.write(d, tokenizer_path())),
    "secrets": lambda d, labels: secrets.scan(d),
    "resampling": lambda d, labels: resampling.resample(d, labels),
    # leaves without a token give nothing, so the empty texts go to a leaf that has some
    "mixing": lambda d, labels: mixing.mix(d.withColumn("source", F.lit("one")).withColumn("lang", F.lit("x")), ["lang", "source"], {}, 1.0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(docs, labels, name):
    assert ids(OPERATORS[name](docs, labels)) == everyone()


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels).count() == 0


def test_passages_of_one_id_with_several_texts(spark, docs):
    got = {(r.doc_id, r.match_doc_id): r.class_id for r in substring.passages(docs).collect()}
    # 3 has PROSE too, so it is a copy of 1, and its other text shares a passage with it
    assert set(got) == {(2, 1), (3, 1)} and set(got.values()) == {1}
    assert substring.passages(docs.limit(0)).count() == 0


def test_collided_fingerprints_are_split(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda c: F.lit("same"))
    by = {}
    for r in fingerprint.group(docs).collect():
        by.setdefault(r.fingerprint, set()).add(r.doc_id)
    texts = {}
    for i, t, *_ in ROWS:
        texts.setdefault(" ".join((t or "").replace("é", "é").lower().split()), set()).add(i)
    assert sorted(map(str, by.values())) == sorted(map(str, texts.values()))
    pairs = {r.doc_id: r for r in fingerprint.edited_pairs(docs).collect()}
    assert pairs[1].n_copies == 4 and pairs[1].class_id == 1 and pairs[7].n_copies == 1 and pairs[1].fingerprint != pairs[7].fingerprint


def test_next_rows(spark):
    """The next row by descending id, of any ids, over many ranges."""
    import numpy as np

    rng = np.random.default_rng(4)
    numbers = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 150, dtype=np.int64)] + list(range(150)) + [5] * 40
    d = spark.createDataFrame([(n, f"t{k}") for k, n in enumerate(numbers)] + [(None, f"n{k}") for k in range(60)], "doc_id bigint, text string")
    old = fingerprint.BUCKET_ROWS
    try:
        fingerprint.BUCKET_ROWS = 16
        got = [(r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(d, ["text"]).collect()]
    finally:
        fingerprint.BUCKET_ROWS = old
    follow = {t: n for _, t, n in got}
    assert len(got) == len(follow) == d.count()
    number = {r.text: r.doc_id for r in d.collect()}
    at, seen = max((t for t in number if number[t] is not None), key=lambda t: number[t]), []
    for _ in range(len(follow)):
        seen.append(number[at])
        at = follow[at]
    assert seen == sorted((n for n in number.values() if n is not None), reverse=True) + [None] * 60


def test_split_join(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    size = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.split_join(rows, size, "k", "n", 3000).collect()
    assert sorted((r.id, r.n) for r in got) == [(i, 1000 if i % 3 == 0 else 1) for i in range(3000)]


def test_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline as P

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES:
        for d, n in ((docs, docs.count()), (docs.limit(0), 0)):
            out = stage(spark, d, str(tmp_path))
            if name == "packing":
                assert ids(out.where("chunk = 0")) == (everyone() if n else [])
                continue
            assert out.columns == docs.columns and out.count() <= n
            assert out.where("score <> 'clash' or __redacted <> 'clash' or fp <> 'clash'").count() == 0
    kept = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, "").collect()]
    # PROSE once (of 1), 3's other text, one text without words, those of the null ids, and four texts of their own
    assert sorted(str(i) for i, _ in kept) == sorted(map(str, [1, 3, 4, None, None, 9 * 10**18, -9 * 10**18, -(1 << 63), 7]))
    assert [t for i, t in kept if i == 3] == ["other words " + PROSE[40:]]
    redacted = {r.doc_id: r for r in P.redact_secrets(spark, docs, "").collect()}
    assert "[SECRET]" in redacted[7].text and redacted[7].n_chars is None and redacted[4].text is None
    mixed = P.mix_sources(spark, docs, "")
    assert mixed.count() <= docs.count()
