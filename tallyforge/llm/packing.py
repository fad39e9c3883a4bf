"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents longer than a bin give whole bins of their own (chunks) and a remainder. Items are dealt out into shards of about
SHARD_ROWS by a hash of (doc_id, chunk), so a hot source or cluster is spread evenly, and each shard is packed on its own, in
order of falling length: bins are kept in order of their residual; the search starts at the first residual that holds the
item and goes on to the next until it meets a bin without a conflict: the tightest compatible one. A bin carries a bitmap
of its sources and one of its duplicate clusters (both numbered within the shard); an item conflicts if its cluster is in the
bin, or if its source already is. Items without a fitting bin open one. Ties: lower bin number first.

A shard's work is bounded by SHARD_ROWS squared and shards grow in number only, so the whole is linear. Every document
is placed exactly once, in order; none is cut off or dropped.

Edge cases: null or empty texts have no tokens and are packed as items of length 0; a null source or cluster conflicts with
nothing; repeated rows are separate items (of one cluster, so never in one bin); a null doc_id is an item like others; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import workers_find_us
from tallyforge.llm.mixing import tokens_of

CAPACITY, SHARD_ROWS = 2048, 2000


def pack_shard(items: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """items: (length, source, cluster), in packing order, lengths at most capacity. (bin, offset) of each."""
    open_: list[tuple[int, int]] = []  # (residual, bin), sorted
    has_source: list[int] = []
    has_cluster: list[int] = []
    source_bit: dict = {}
    cluster_bit: dict = {}
    out = []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(open_, (length, -1))
        while at < len(open_):
            b = open_[at][1]
            if not (has_source[b] & s or has_cluster[b] & c):
                break
            at += 1
        if at < len(open_):
            residual, b = open_.pop(at)
        else:
            residual, b = capacity, len(has_source)
            has_source.append(0)
            has_cluster.append(0)
        has_source[b] |= s
        has_cluster[b] |= c
        out.append((b, capacity - residual))
        insort(open_, (residual - length, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, shard_rows: int = SHARD_ROWS, tokens: str | None = None) -> DataFrame:
    """doc_id, chunk, n_tokens, source, shard, bin, offset: the place of each chunk of each row of docs.

    cluster: a column of duplicate clusters; by default a hash of the text. tokens: a column of lengths; by default words.
    """
    length = F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)) if tokens else tokens_of()
    same = F.col(cluster) if cluster else F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), same.cast("bigint").alias("cluster"), length.alias("n"))
    cut = F.lit(capacity).cast("bigint")
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / cut) - 1, F.lit(0)).cast("bigint"))))
    items = chunks.withColumn("n_tokens", F.least(cut, F.col("n") - F.col("chunk") * cut)).drop("n")
    shards = max(1, -(-docs.count() // shard_rows))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "doc_id", "chunk", "cluster"), F.lit(shards)).cast("int"))

    names = ["doc_id", "chunk", "n_tokens", "source", "cluster", "shard"]

    workers_find_us(docs.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(names).to_pylist()
        rows.sort(key=lambda r: (-r["n_tokens"], r["doc_id"] is None, r["doc_id"] or 0, r["chunk"], r["cluster"] or 0))
        placed = pack_shard([(r["n_tokens"], r["source"], r["cluster"]) for r in rows], capacity)
        out = pa.Table.from_pylist(rows, schema=table.select(names).schema)
        return out.append_column("bin", pa.array([b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return dealt.select(names).groupBy("shard").applyInArrow(run, "doc_id bigint, chunk bigint, n_tokens bigint, source string, cluster bigint, shard int, bin bigint, offset bigint")
