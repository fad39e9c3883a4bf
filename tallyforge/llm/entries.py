"""Queries opN_<name> over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import fingerprint, licenses, mixing, packing, pages, quality, resampling, secrets, simhash, substring, tokens, toxicity, vectors
from tallyforge.llm.common import read

PATH = ["domain", "lang", "source"]
#: Production weights of the mix: domains, then languages within a domain; the rest weigh 1.
WEIGHTS = {("web",): 3.0, ("books",): 2.0} | {(d, "en"): 3.0 for d in ("web", "books", "code", "news", "other")}
BUDGET, EPOCHS = 0.6, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("domain", mixing.domain_of())
    return mixing.mix(docs, PATH, WEIGHTS, BUDGET, EPOCHS).select("doc_id", *PATH, "epoch", "n_tokens")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), simhash.DISTANCE)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_back(tokens.write(read(spark, sf_dir, "documents"), tokenizer_path()))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.encode(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_quality, op3_packing, op4_substring, op5_simhash, op6_toxicity, op7_fingerprint, op8_licenses, op9_tokens, op10_secrets, op11_html, op12_resampling, op13_vectors)}

ORACLE = {
    "op13_vectors": vectors.oracle(),
    "op2_quality": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) x, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY rid),
c AS (
  SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
         OR word_chars < 2 * n_words OR word_chars > 14 * n_words
         OR 10 * n_symbols > n_words
         OR (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines)
         OR 2 * length(translate(text, 'abcdefghijklmnopqrstuvwxyzäöüßàâçéèêëîïôûùñáíóú', '')) > length(text) + word_chars // 5
         OR 5 * length(regexp_replace(text, '[^!?]', '', 'g')) > n_words) AS kept
FROM b""",
}
