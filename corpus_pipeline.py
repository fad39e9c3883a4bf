"""A corpus pipeline of five stages: toxicity, near-duplicates, secrets, mixing, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; run() writes each stage's result as Parquet in the shared folder and reads
it back as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import mixing, packing, secrets, simhash, toxicity
from tallyforge.llm.common import durable, fresh, read

#: Share of the tokens that the mix keeps, in one epoch: no document twice.
KEPT_TOKENS = 0.95


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression-distance score is 0.5 or more go.

    Null and empty texts and null ids are scored like others (null and empty texts have no savings, so they stay where such texts
    are not the toxic ones); repeated rows are judged alike; an empty table, or labels without one class, drop nothing or go by
    the share of the other class. Column names that clash with the score's are left alone.
    """
    [column] = fresh(docs, "score")
    model = toxicity.learned(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, column).where(F.col(column) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts that share 0.8 of their five-word runs, the row of the smallest doc_id stays.

    Null, empty and blank texts are one text without words, so one of them stays; ties and repeated rows: one row stays; rows of
    one doc_id with different texts are of the classes of their texts; rows with a null doc_id all stay; an empty table stays
    empty; other columns pass through.
    """
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced; every document stays, with its new length.

    Null and empty texts, null ids and repeated rows stay as they are; a null n_chars stays null; other columns pass through.
    """
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weights at each level of the domain-language-source tree, within one epoch and KEPT_TOKENS of all tokens.

    Null languages and sources are leaves of their own; texts without words are taken when their turn comes; repeated rows are
    taken or left together; an empty table stays empty; other columns pass through, whatever their names.
    """
    [domain] = fresh(docs, "domain")
    return mixing.mix(docs.withColumn(domain, mixing.domain_of()), [domain, "lang", "source"], {}, KEPT_TOKENS, 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or of its chunks, in a bin.

    Texts without words take no room; repeated rows are items of their own, in different bins; null ids and sources are packed
    like others; an empty table gives no rows; other columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: SQL can express neither the compression scores nor the fingerprints; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
