"""Canonical exact fingerprints, in DataFrame and SQL functions only.

Canonical text: Unicode NFKC, full case folding, NFKC again, runs of Unicode white space folded to one space, ends trimmed.
The fingerprint is 128 bits wide: XXH64 (seed 42) of the canonical text and of U+0001 followed by it, 32 hex digits.
Equal fingerprints are only trusted after a byte comparison: inside each bucket of two or more rows the smallest and the
largest canonical text must be equal; the fingerprints of a bucket that fails go on with a SHA-256 of the canonical text.
Bucket sizes are pre-aggregated before the shuffle (a third of all rows in one bucket is one row per map task), and only
texts in buckets of two or more rows are compared. Hot buckets are joined in parts.

Edge cases: a null text counts as empty; empty and blank texts share the fingerprint of the empty string; repeated rows keep
their rows; a null doc_id is the last in descending order; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, durable, split_join

#: Rows aimed at for a range of neighbouring ids, and the most ranges (the small table of their ends is broadcast).
BUCKET_ROWS, MOST_BUCKETS, SLOTS = 4000, 1 << 16, 1 << 18


def _icu(kind: str, method: str, x: Column) -> Column:
    return F.call_function("reflect", F.lit(kind), F.lit(method), x, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case folded, white space folded. Pure ASCII takes the short way, to the same result."""
    x = F.coalesce(text, F.lit(""))
    nfkc = lambda c: _icu("com.ibm.icu.text.Normalizer", "compose", c)
    folded = F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(nfkc(_icu("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(x))))
    return F.trim(F.regexp_replace(folded, r"(?U)[\s\x1c-\x1f]+", " "))


def wide_hash(canon: Column) -> Column:
    """32 hex digits of two XXH64 of a canonical text."""
    half = lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))
    return F.concat(half(canon), half(F.concat(F.lit("\u0001"), canon)))


def with_fingerprint(docs: DataFrame, column: str = "fingerprint", text: str = "text") -> DataFrame:
    return docs.withColumn("__canon", canonical(F.col(text))).withColumn(column, wide_hash(F.col("__canon"))).drop("__canon")


def exact_classes(docs: DataFrame) -> DataFrame:
    """fingerprint, collided, class_id (smallest doc_id), n_copies: one row per bucket, written to the shared folder.

    Of buckets of two or more rows the smallest and the largest canonical text are compared, byte by byte; the aggregation
    combines before its shuffle, so a hot bucket moves two texts for each map task.
    """
    hashed = docs.select("doc_id", canonical(F.col("text")).alias("__canon")).withColumn("fingerprint", wide_hash(F.col("__canon")))
    sizes = durable(hashed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("class_id")), "sizes")
    # a bitmap of the shared fingerprints, of at most SLOTS rows of 64 bits at any scale, lets most other texts stay where they are
    slot = F.xxhash64("fingerprint").bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr(f"cast(shiftrightunsigned(xxhash64(fingerprint), {SLOTS.bit_length() - 1}) & 63 as int)")
    bits = sizes.where("n_copies > 1").groupBy(slot.alias("__slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("__bits"))
    maybe = hashed.withColumn("__slot", slot).withColumn("__bit", bit).join(F.broadcast(bits), "__slot").where("shiftrightunsigned(__bits, __bit) & 1 = 1")
    ends = maybe.groupBy("fingerprint").agg(F.min("__canon").alias("lo"), F.max("__canon").alias("hi")).where("lo <> hi").select("fingerprint", F.lit(True).alias("collided"))
    out = durable(sizes.join(ends, "fingerprint", "left").select("fingerprint", F.coalesce("collided", F.lit(False)).alias("collided"), "class_id", "n_copies"), "classes")
    discard(sizes)
    return out


def resolver(classes: DataFrame):
    """A function (df, fingerprint column, text column) -> df in which fingerprints of collided buckets go with a SHA-256 of the
    canonical text. Without a collision, which is what to expect of 128 bits, it changes nothing."""
    collided = classes.where("collided").select("fingerprint")
    if not collided.limit(1).count():
        return lambda df, column, text: df

    def resolve(df: DataFrame, column: str, text: str) -> DataFrame:
        marked = df.join(collided.select(F.col("fingerprint").alias(column), F.lit(True).alias("__collided")), column, "left")
        parted = F.concat_ws("-", column, F.sha2(canonical(F.col(text)), 256))
        return marked.withColumn(column, F.when(F.col("__collided"), parted).otherwise(F.col(column))).drop("__collided")

    return resolve


def final_classes(docs: DataFrame) -> tuple[DataFrame, Callable]:
    """(fingerprint, class_id, n_copies) after the byte comparison, and the resolver of collided fingerprints."""
    classes = exact_classes(docs)
    resolve = resolver(classes)
    whole = classes.where("not collided").select("fingerprint", "class_id", "n_copies")
    if not classes.where("collided").limit(1).count():
        return whole, resolve
    hashed = with_fingerprint(docs.select("doc_id", "text")).join(classes.where("collided").select("fingerprint"), "fingerprint", "left_semi")
    return whole.unionByName(resolve(hashed, "fingerprint", "text").groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))), resolve


def group(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, class_id, n_copies of every row. Rows of a collided bucket are grouped by their bytes."""
    classes, resolve = final_classes(docs)
    rows = resolve(with_fingerprint(docs.select("doc_id", "text")), "fingerprint", "text").select("doc_id", "fingerprint")
    return split_join(rows, classes, "fingerprint", "n_copies", docs.count()).select("doc_id", "fingerprint", "class_id", "n_copies")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with next_<column>: the value in the next row by descending doc_id, after the last the first. Ties go by a hash of the text.

    No window over all rows: rows are dealt out into ranges of the order, whose ends come from a range partitioning of the ids
    and hashes alone (so any ids, wide, clustered, repeated or null, give ranges of about BUCKET_ROWS rows), and the first row
    of each range is also sent, as a guest, to the range before it. At most MOST_BUCKETS range ends come to the driver; beyond
    BUCKET_ROWS x MOST_BUCKETS rows a range is sorted in more than that many rows, with spill.
    """
    spark, least = docs.sparkSession, -(1 << 63)
    tie = F.xxhash64("text")
    key = F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("id"), F.when(F.col("doc_id") == least, F.lit(least)).otherwise(tie).alias("tie"))
    n = docs.count()
    many = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    ids = docs.select(key.alias("k"))
    begins = sorted(tuple(r[0]) for r in ids.repartitionByRange(many, "k.id", "k.tie").groupBy(F.spark_partition_id()).agg(F.min("k")).select("min(k)").collect()) if many > 1 else []
    range_of = _edges_up_to(begins[1:])
    keyed = docs.select("*", F.transform(F.array(key), range_of)[0].alias("__range"))
    firsts = {r["__range"]: tuple(r["k"]) for r in keyed.select("__range", key.alias("k")).groupBy("__range").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    table = [(r, *firsts[r], order[k - 1]) for k, r in enumerate(order)]
    targets = spark.createDataFrame(table, "__range int, __id bigint, __first_tie bigint, __before int")
    placed = keyed.withColumn("__k", key).join(F.broadcast(targets), "__range")
    own = F.struct(F.col("__range").alias("at"), F.lit(False).alias("guest"))
    also = F.struct(F.col("__before").alias("at"), F.lit(True).alias("guest"))
    is_first = (F.col("__k.id") == F.col("__id")) & (F.col("__k.tie") == F.col("__first_tie"))
    dealt = placed.withColumn("__to", F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own))))
    # plain columns for the window, so that all of its values come from one shuffle
    w = W.partitionBy("__at").orderBy(F.asc("__guest"), F.desc_nulls_last("doc_id"), F.asc("__tie"))
    flat = dealt.select(*docs.columns, F.col("__to.at").alias("__at"), F.col("__to.guest").alias("__guest"), tie.alias("__tie"))
    return flat.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("not __guest").drop("__at", "__guest", "__tie")


def _edges_up_to(edges: list[tuple[int, int]]) -> Callable[[Column], Column]:
    """A function: key (a struct of id and tie) -> the number of edges that are not above it, by bisection of constant arrays."""
    ids, ties = (F.split(F.lit(",".join(str(e[i]) for e in edges)), ",").cast("array<bigint>") if edges else F.array(F.lit(None).cast("bigint")) for i in (0, 1))
    steps = F.array(*(F.lit(1 << i) for i in range(max(len(edges).bit_length() - 1, 0), -1, -1)))

    def search(k: Column) -> Column:
        def step(at: Column, by: Column) -> Column:
            e, t = F.get(ids, at + by - 1), F.get(ties, at + by - 1)  # null beyond the end
            return F.when((e < k["id"]) | ((e == k["id"]) & (t <= k["tie"])), at + by).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    return search


def edited_pairs(docs: DataFrame) -> DataFrame:
    """The contract's columns: fingerprints of each text, of its edited text, and their likeness to each other and to the next text's."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    classes, resolve = final_classes(base)
    near = with_next(with_fingerprint(base), ["text", "fingerprint"])
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    made = near.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint", n.cast("bigint").alias("n_chars"), F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 3) as int))")).alias("edited"), k.alias("k"))
    made = with_fingerprint(made, "edited_fingerprint", "edited")
    for column, text in (("fingerprint", "text"), ("edited_fingerprint", "edited"), ("next_fingerprint", "next_text")):
        made = resolve(made, column, text)
    alike = lambda a, b, x, y: F.when(F.col(a) != F.col(b), 0.0).otherwise(F.when(F.col(x) == F.col(y), 1.0).otherwise((canonical(F.col(x)) == canonical(F.col(y))).cast("double")))
    out = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", alike("fingerprint", "edited_fingerprint", "text", "edited").alias("near_edited"), alike("fingerprint", "next_fingerprint", "text", "next_text").alias("near_next"))
    return split_join(out, classes, "fingerprint", "n_copies", docs.count())
