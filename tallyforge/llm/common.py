"""What the corpus operators share: durable intermediate tables, Arrow maps, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows of one Arrow batch sent to Python. Texts may be megabytes long, so batches hold few rows.
ARROW_ROWS = 256
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key that holds more than one row in HOT_SHARE, and more than LUKEWARM, is joined in SALTS parts; there are fewer than
#: HOT_SHARE such keys at any size.
HOT_SHARE, SALTS, LUKEWARM = 2000, 64, 64
#: Links of a node that one task may hold, in components(); with more, the node's links are dealt out.
GATHERED = 8192


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one where it is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="tallyforge-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def durable(df: DataFrame, name: str, task_bytes: int = 0) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors. The shuffle
    files behind it go when it is written. task_bytes: what a task is to read of shuffles, for work that takes long a byte."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    wanted = {SHUFFLE_CLEANUP: "true"}
    if task_bytes:
        wanted |= {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            if before[k] is not None:
                spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is not None:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by durable() that nothing reads any more."""
    path = getattr(df, "_durable_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def workers_find_us(spark: SparkSession) -> None:
    """Python workers on this machine import this package from where the driver did (a cluster gets it by --py-files)."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """mapInArrow over small batches."""
    workers_find_us(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, columns: Callable[[list], list[pa.Array]], fields: list[tuple[str, pa.DataType, str]], text: str = "text") -> DataFrame:
    """df with more columns, computed from the texts (a list of str or None) of each Arrow batch. Columns of df of the same names are replaced."""
    names = [n for n, _, _ in fields]
    keep = [c for c in df.columns if c not in names or c == text]
    src = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = StructType([*src.schema.fields, *(StructField(n, _parse_datatype_string(kind)) for n, _, kind in fields)])
    at = keep.index(text)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = columns(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, (_, t, _) in zip(new, fields))], names=[*keep, *names])

    return arrow_map(src, rows, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def map_text(df: DataFrame, change: Callable[[str | None], str | None], text: str = "text") -> DataFrame:
    """df with each text replaced by change(text); every row and other column stays as it is."""
    at = df.columns.index(text)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = pa.array([change(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return arrow_map(df, rows, df.schema)


def split_join(rows: DataFrame, keyed: DataFrame, on: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed (one row for each key; column `count`: rows of that key) on `on`, hot keys in SALTS parts.

    The hot keys, fewer than HOT_SHARE of them whatever the input, are broadcast; a row's part is a hash of the whole row.
    """
    on = [on] if isinstance(on, str) else on
    hot = keyed.where(F.col(count) > max(LUKEWARM, total // HOT_SHARE)).select(*on, F.lit(SALTS).alias("__salts"))
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.col("__salts").cast("bigint"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__part", F.coalesce(part, F.lit(0).cast("bigint"))).drop("__salts")
    parts = F.when(F.col(count) > max(LUKEWARM, total // HOT_SHARE), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return dealt.join(keyed.withColumn("__part", F.explode(parts)), [*on, "__part"], how).drop("__part")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star steps.

    edges: columns a, b (long). Returns (node, root): root is the smallest node of its component. Nodes without a link to
    another node do not appear. Every step is a window on the node while no node has more than GATHERED links; else it is a
    partial aggregation and a join on the node, which is split for nodes of very many links. The number of steps grows with the
    logarithm of the graph's diameter. Each step's links are written to the shared folder; nothing but three numbers comes to the
    driver.
    """
    cur = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # settled: every node but the roots has one link, to a root
        unsettled, most, n = low.agg(F.count_if(F.expr("m < u and n > 1")), F.max("n"), F.sum("n")).first()
        if not unsettled:
            break
        if most <= GATHERED:
            large = both.withColumn("m", F.min("v").over(Window.partitionBy("u"))).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        else:
            large = split_join(both, low.withColumn("m", F.least("u", "m")), "u", "n", n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            small = split_join(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "u", "n", n)
        nxt = durable(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct(), "links")
        discard(cur)
        cur = nxt
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
