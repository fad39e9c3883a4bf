"""Importance resampling: documents are drawn by how much likelier their words and word pairs are in a target set.

Within each chunk of texts (some megabytes; a task sees one after the other) distinct words get integer ids; an n-gram is a tuple
of ids, numbered in turn as (number of its first n-1 words, id of the last), so that no n-gram is a string. The CRC-32 of each
distinct tuple's bytes is computed once a chunk, by going on from the CRC of its first n-1 words, and its count (or its gain) is
joined back through its number. Chunks add up their buckets' counts; only these, a row for each bucket, come to the driver.

Two passes read whole texts: one counts buckets, one weighs documents. Ranks come from a range partitioning of the scores, whose
parts are numbered apart, so that no task orders all documents.

Null texts have no words; texts without words have weight 0; words are told apart by their bytes; a null doc_id draws its lot from
an empty id and comes behind others of its score; repeated rows are drawn one by one, in neighbouring ranks; an empty table gives
no rows, an empty target counts as one that holds no feature; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import ARROW_ROWS, durable, workers_find_us

NGRAM, BUCKETS, SHARE, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Bytes of text that share a dictionary; rows that a range of ranks holds.
CHUNK_BYTES, RANGE_ROWS = 8 << 20, 200_000
#: A-Z become a-z; what stands in no word becomes a blank. Bytes from 0x80 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Chunk:
    """Word ids of a list of texts (UTF-8), and the features (tuples of ids) of each size."""

    def __init__(self, texts: list[bytes | None], ngram: int = NGRAM, buckets: int = BUCKETS):
        raw = [t or b"" for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        flat = np.frombuffer(b" ".join([*raw, b""]).translate(_FOLD), dtype=np.uint8)
        inside = flat != 32
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside].tobytes())]).dictionary_encode()
        ids, spaced = words.indices.to_numpy().astype(np.int64), [b" " + w for w in words.dictionary.to_pylist()]
        #: number of words before each text's first one, and before the end
        self.first = np.concatenate(([0], np.searchsorted(starts, ends)))
        self.n_words = np.diff(self.first)
        text_of = np.repeat(np.arange(len(texts)), self.n_words)
        crcs = np.array([zlib.crc32(memoryview(w)[1:]) for w in spaced], dtype=np.int64)
        numbers, at = ids, np.arange(len(ids))
        #: for each size: where its features start, their numbers, and the bucket of each number
        self.sizes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(at, numbers, crcs % buckets)]
        for n in range(2, ngram + 1):
            longer = at + n - 1 < len(ids)
            at, numbers = at[longer], numbers[longer]
            same = text_of[at] == text_of[at + n - 1]
            at, numbers = at[same], numbers[same]
            numbers, tuples = pd.factorize(numbers * max(1, len(spaced)) + ids[at + n - 1])
            crcs = np.array([zlib.crc32(spaced[j], c) for c, j in zip(crcs[tuples // max(1, len(spaced))].tolist(), (tuples % max(1, len(spaced))).tolist())], dtype=np.int64)
            self.sizes.append((at, numbers, crcs % buckets))
        self.buckets = buckets

    def counts(self) -> np.ndarray:
        """Features in each bucket: counts of distinct tuples, joined to their buckets."""
        out = np.zeros(self.buckets, dtype=np.int64)
        for _, numbers, bucket in self.sizes:
            np.add.at(out, bucket, np.bincount(numbers, minlength=len(bucket)))
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, sum of their gains) of each text."""
        n, total = np.zeros(len(self.n_words), dtype=np.int64), np.zeros(len(self.n_words), dtype=np.int64)
        for at, numbers, bucket in self.sizes:
            upto = np.concatenate(([0], np.cumsum(gains[bucket][numbers])))
            ends = np.searchsorted(at, self.first)
            n += np.diff(ends)
            total += np.diff(upto[ends])
        return n, total


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(0).cast(pa.large_binary()).to_pylist()


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_BYTES of text (column 0)."""
    sizes = np.array([len(t or b"") for t in texts_of(batch)], dtype=np.int64)
    part = np.cumsum(sizes) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to CHUNK_BYTES."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in _larger(batches):
            for c in _chunks(b):
                total += Chunk(texts_of(c), ngram, buckets).counts()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=object)
    for r in in_chunks(texts.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = int(r["n"])
    return out


def in_chunks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of `run`, which sees all batches of a task, each of few rows."""
    workers_find_us(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.mapInArrow(run, schema)


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: thousandths of the logarithm of its share in the target to its share in all, both smoothed by one."""
    s_all, t_all = float(sum(raw)), float(sum(target))
    size = float(len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(map(float, raw), map(float, target))], dtype=np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean of the features' gains) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _larger(batches):
            for c in _chunks(b):
                chunk = Chunk(texts_of(c), ngram, len(gains))
                n, total = chunk.sums(gains)
                yield pa.RecordBatch.from_arrays([c.column(1), pa.array(chunk.n_words, pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_chunks(docs.select("text", "doc_id"), run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def ranks(rows: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """rows (n of them) with rank: 1, 2, 3... by descending score, then ascending key, nulls last.

    Rows are dealt out into ranges of this order, written with their range's number, numbered within it, and moved up by the
    rows of the ranges before it, of which there is one in RANGE_ROWS rows.
    """
    parts = max(1, -(-n // RANGE_ROWS))
    by = [F.desc(score), F.asc_nulls_last(key)]
    placed = durable(rows.repartitionByRange(parts, *by).withColumn("__range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", before.alias("__before"))
    within = placed.withColumn("rank", F.row_number().over(W.partitionBy("__range").orderBy(*by)).cast("bigint"))
    return within.join(starts, "__range").withColumn("rank", F.col("rank") + F.col("__before")).drop("__range", "__before")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Of the documents of at least least_words words, share per cent are drawn, by the highest weight plus a lot of Gumbel's
    distribution that depends on seed and doc_id only: drawing by weight without replacement.
    """
    gains = gains_of(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
    lot = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    gumbel = F.floor(F.lit(-1000) * F.log(-F.log((lot.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = durable(weighed(docs, gains, ngram).withColumn("score", F.col("weight") + gumbel), "scored")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    ranked = ranks(scored.where(able), "score", "doc_id", n)
    last = share * n // 100
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= last, F.col("rank"))).unionByName(rest)
