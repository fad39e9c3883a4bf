"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree, prefixes of seeded epochs.

Budgets. The token budget flows from the root to the leaves in proportion to the weights of siblings. A leaf can give at
most its own tokens times `epochs`. What a node cannot take goes first to its siblings (by their weights, while they have
room), and only what a whole family cannot take goes back to the parent's siblings. The tree of budgets has as many leaves as
there are distinct paths; these, not documents, come to the driver (some 300 bytes each, of any number: path columns are meant
to be categories). Budgets are broadcast up to BROADCAST_LEAVES rows and joined with a shuffle beyond.

Selection. Each leaf's documents stand in a seeded random order that is drawn anew in each epoch (XXH64 of seed, epoch and
doc_id). A leaf takes the prefix of epoch 0, 1, ... whose tokens fit its budget: whole epochs, then in its last epoch the
documents whose running sum does not exceed what is left. The running sum is never a window over a leaf: orders are cut into
`RANGES` ranges of the hash by leaf; sums by range say which range holds the end, and only that range's documents are
sorted, by the next bits of the hash, again and again until a range has at most `SORT_ROWS` documents or the hash is used up.

Edge cases: null texts have no tokens and are taken if their turn comes within a budget above zero (a leaf without tokens has
none); null lang, source or
domain is a leaf value of its own; repeated rows are separate items in the order (ties of doc_id go by text hash and are
taken or left together); an empty table or a budget of zero gives an empty result. Extra columns pass through, whatever their
names: the columns that are added are n_tokens (if counts are not given) and epoch, with underscores behind if docs has such.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import durable, fresh, split_join

BROADCAST_LEAVES, RANGES, SORT_ROWS = 100_000, 1024, 20_000


def allocate(leaves: dict[tuple, int], weights: dict[tuple, float], budget: int, epochs: int) -> dict[tuple, int]:
    """Tokens of each leaf. leaves: path -> tokens at hand. weights: path or its prefix -> weight among its siblings (default 1)."""
    if not leaves:
        return {}
    children: dict[tuple, set] = defaultdict(set)
    room: dict[tuple, float] = defaultdict(float)
    for path, tokens in leaves.items():
        for k in range(len(path)):
            children[path[:k]].add(path[: k + 1])
        for k in range(len(path) + 1):
            room[path[:k]] += tokens * epochs
    out: dict[tuple, int] = {}

    def give(node: tuple, amount: float) -> None:
        amount = min(amount, room[node])
        if node not in children:
            out[node] = int(amount + 1e-6)
            return
        kids = sorted(children[node], key=str)
        share = dict.fromkeys(kids, 0.0)
        open_, left = [k for k in kids if weights.get(k, 1.0) > 0], amount
        while open_ and left > 1e-9:
            total = sum(weights.get(k, 1.0) for k in open_)
            full = [k for k in open_ if share[k] + left * weights.get(k, 1.0) / total >= room[k] - 1e-9]
            if not full:
                for k in open_:
                    share[k] += left * weights.get(k, 1.0) / total
                break
            for k in full:  # a family that is full keeps what it can; the rest is dealt out among its siblings
                left -= room[k] - share[k]
                share[k] = room[k]
            open_ = [k for k in open_ if k not in full]
        for k in kids:
            give(k, share[k])

    # a family whose weights are all above zero takes all that reaches it, up to its room, so what comes back is its shortage
    _close(room, children, weights, ())
    give((), float(budget))
    return out


def _close(room: dict, children: dict, weights: dict, node: tuple) -> float:
    """Room below children of weight zero is no room."""
    if node in children:
        room[node] = sum(_close(room, children, weights, k) if weights.get(k, 1.0) > 0 else 0.0 for k in sorted(children[node], key=str))
    return room[node]


def tokens_of(text: str = "text") -> F.Column:
    """White-space words of a text: the token counts where no tokenizer's counts are given."""
    return F.size(F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\u000b\f\r", "     "), " "), "")).cast("bigint")


def mix(docs: DataFrame, path: list[str], weights: dict[tuple, float], budget: int | float, epochs: int = 1, seed: int = 7, tokens: str | None = None) -> DataFrame:
    """docs with n_tokens and epoch (0-based), one row for each time a document is taken.

    path: columns from the root's children to the leaf; budget: tokens, or a share of the corpus tokens if a float of 1 or less;
    tokens: a column of token counts, by default words are counted.
    """
    spark = docs.sparkSession
    count, when, leaf, hashed, left, end = fresh(docs, "n_tokens", "epoch", "leaf", "hash", "left", "end")
    if tokens is None:
        docs = docs.withColumn(count, tokens_of())
    else:
        count = tokens
    rows = docs.withColumn(leaf, F.to_json(F.array(*(F.col(f"`{c}`").cast("string") for c in path))))
    sums = [(r[0], int(r[1] or 0), r[2]) for r in rows.groupBy(leaf).agg(F.sum(count), F.count(F.lit(1))).toLocalIterator()]
    names = {tuple(json.loads(k)): k for k, _, _ in sums}
    have = {tuple(json.loads(k)): t for k, t, _ in sums}
    total = sum(have.values())
    want = allocate(have, weights, int(total * budget) if isinstance(budget, float) and budget <= 1 else int(budget), epochs)
    table = []
    for p, t in want.items():
        whole, rest = divmod(t, have[p]) if have[p] else (0, 0)
        if have[p] and whole >= epochs:
            whole, rest = epochs, 0
        table += [(names[p], e, None if e < whole else rest) for e in range(int(whole) + (rest > 0))]
    plan = spark.createDataFrame(table, f"`{leaf}` string, `{when}` int, `{left}` bigint")
    order = F.xxhash64(F.lit(seed), F.col(when), F.col("doc_id"), F.xxhash64("text"))
    [size] = fresh(rows, "size")
    sizes = spark.createDataFrame([(k, n) for k, _, n in sums], f"`{leaf}` string, `{size}` bigint") if len(table) > BROADCAST_LEAVES else None
    docs_in_all = sum(n for _, _, n in sums)

    def with_leaf(df: DataFrame, per_leaf: DataFrame, columns: list[str], how: str) -> DataFrame:
        """df joined with what is known of its leaf (and epoch): by broadcast, or beyond BROADCAST_LEAVES with large leaves in parts."""
        if sizes is None:
            return df.join(F.broadcast(per_leaf), columns, how)
        lists = per_leaf.groupBy(leaf).agg(F.collect_list(F.struct(*(c for c in per_leaf.columns if c != leaf))).alias("__plan")).join(sizes, leaf)  # an entry for each epoch
        joined = split_join(df, lists, leaf, size, docs_in_all, "inner" if how == "inner" else "left")
        if how == "inner":
            return joined.withColumn("__p", F.explode("__plan")).select(*df.columns, *(F.col(f"__p.`{c}`").alias(c) for c in per_leaf.columns if c != leaf))
        match = F.filter(F.coalesce("__plan", F.array()), lambda x: x[when] == F.col(when))
        return joined.select(*df.columns, *(F.get(match, F.lit(0))[c].alias(c) for c in per_leaf.columns if c not in (leaf, when)))

    taken = with_leaf(rows, plan, [leaf], "inner").withColumn(hashed, order)
    items = taken.where(F.col(left).isNotNull()).select(F.col(leaf).alias("leaf"), F.col(when).alias("epoch"), F.col(hashed).alias("h"), F.col(count).alias("t"))
    ends = _ends(items, [r for r in table if r[2] is not None], {k: n for k, _, n in sums})
    if ends is None:
        out = taken
    else:
        ends = ends.select(F.col("leaf").alias(leaf), F.col("epoch").alias(when), F.col("end").alias(end))
        out = with_leaf(taken, ends, [leaf, when], "left").where(F.col(left).isNull() | F.col(end).isNull() | (F.col(hashed) < F.col(end)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), when)


def _ends(items: DataFrame, partial: list[tuple], docs: dict[str, int]) -> DataFrame | None:
    """leaf, epoch, end: a leaf's last epoch takes the documents whose hash is below end (null: all of them).

    items: leaf, epoch, h, t (tokens) of the documents of last epochs; partial: (leaf, epoch, tokens to take);
    docs: number of documents of each leaf."""
    if not partial:
        return None
    spark = items.sparkSession
    # u: the hash with its sign bit turned, so that its bits from the top are its order
    items = durable(items.withColumn("u", F.col("h").bitwiseXOR(F.lit(-(1 << 63)))), "order")
    of_last = sum(docs[leaf] for leaf, _, _ in partial)

    def placed(grid: list[tuple], columns: str) -> DataFrame:
        """items with what the grid (leaf, epoch, ...) says of their leaf: large leaves in parts where it is not broadcast."""
        frame = spark.createDataFrame([(*g, docs[g[0]]) for g in grid], f"leaf string, epoch int, {columns}, docs bigint")
        on = ["leaf", "epoch"]
        return (items.join(F.broadcast(frame), on) if len(partial) <= BROADCAST_LEAVES else split_join(items, frame, on, "docs", of_last)).drop("docs")

    state = {(leaf, e): (0, 64, left) for leaf, e, left in partial}  # (top bits so far, bits below them, tokens still to take)
    done: dict[tuple, int | None] = {}
    step = RANGES.bit_length() - 1
    while state:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        grid = [(leaf, e, signed(top << bits) if bits < 64 else 0, bits, max(bits - step, 0), left) for (leaf, e), (top, bits, left) in state.items()]
        here = placed(grid, "top bigint, bits int, fine int, room bigint").where("bits = 64 or shiftrightunsigned(u, bits) = shiftrightunsigned(top, bits)")
        ranges = here.withColumn("r", F.expr(f"shiftrightunsigned(u, fine) & {RANGES - 1} & (shiftleft(1L, least(bits, 62)) - 1)"))
        got = ranges.groupBy("leaf", "epoch", "r", "room").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
        w = W.partitionBy("leaf", "epoch").orderBy("r")
        over = got.withColumn("run", F.sum("t").over(w)).where("run > room")
        first = over.groupBy("leaf", "epoch").agg(F.min_by(F.struct("r", "t", "run", "n"), "r").alias("x")).select("leaf", "epoch", "x.*").collect()
        for k in state.keys() - {(r["leaf"], r["epoch"]) for r in first}:
            done[k] = None
        nxt, short = {}, []
        for r in first:
            k = (r["leaf"], r["epoch"])
            top, bits, left = state[k]
            fine = max(bits - step, 0)
            now = ((top << (bits - fine)) | r["r"], fine, left - (r["run"] - r["t"]))
            if fine == 0:
                done[k] = signed((now[0] ^ (1 << 63)))
            elif r["n"] <= SORT_ROWS:
                short.append((*k, signed(now[0] << fine), fine, now[2]))
            else:
                nxt[k] = now
        if short:  # few rows: a running sum over them
            here = placed(short, "top bigint, bits int, room bigint").where("shiftrightunsigned(u, bits) = shiftrightunsigned(top, bits)")
            w = W.partitionBy("leaf", "epoch").orderBy("h").rangeBetween(W.unboundedPreceding, 0)
            ends = here.withColumn("run", F.sum("t").over(w)).where("run > room").groupBy("leaf", "epoch").agg(F.min("h").alias("end")).collect()
            done |= {(r["leaf"], r["epoch"]): r["end"] for r in ends}
        state = nxt
    return spark.createDataFrame([(leaf, e, end) for (leaf, e), end in done.items()], "leaf string, epoch int, end bigint")


def domain_of(source: str = "source") -> F.Column:
    """The domain level for tables without one: web, books, code or news, by the source's number modulo 4 (null: other)."""
    n = F.expr(f"try_cast(regexp_extract({source}, '[0-9]+$', 0) as int) % 4")
    return F.coalesce(F.element_at(F.array(*map(F.lit, ("web", "books", "code", "news"))), n + 1), F.lit("other"))
