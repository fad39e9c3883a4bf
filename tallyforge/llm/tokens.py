"""Token ids in a binary format: byte-level BPE, then Re-Pair grammar compression per shard.

Encoding. Texts are encoded whole with a public tokenizer of the tokenizers library. A byte-level BPE never joins across a
single space (which starts a piece) or a lone line end, so texts made of such pieces are put together from the ids of
their pieces, each encoded once by the library and kept in a bounded table. Arrow splits such texts and gives each chunk's distinct pieces;
numpy gathers their ids. All other texts are encoded in one go.

Order. Documents are dealt out by ranges of doc_id and sorted within a range. A shard is a run of whole documents of about
SHARD_IDS ids within one range, stored as one binary record:
  magic `RPG1`, then little-endian uint32: documents, rules, symbols, symbol width (2 or 4), and a uint64: ids of the
  documents before this shard in its range; int64 doc ids; a bit for each that is null; uint32 ids of each document; uint32 symbols of each
  document; rules as pairs of uint32 symbols; uint32 expansion lengths of the rules; symbols.
Re-Pair: in each round the frequent pairs of neighbouring symbols (at least MIN_PAIR times; never across documents, never the
end id) become nonterminals, from FIRST_RULE on, up to RULES a round, until no pair is frequent; overlaps are replaced left to
right. Expansion lengths let a reader find an id inside a document without expanding what lies before it (Shard.ids).

Records are written as a Parquet table in the shared folder, with an index of the ids before each range beside them, and read
back; the results come from what was read.
Edge cases: null or empty texts have the end id only; a null doc_id comes first; repeated rows are documents of their own
(ties go by text hash); an empty table writes no record. Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import ARROW_ROWS, durable, workers_find_us

END_ID, FIRST_RULE = 2, 50_257
#: Pairs that stand at least MIN_PAIR times are frequent; up to RULES of them become rules at a time.
SHARD_IDS, RULES, MIN_PAIR, SLOT_BITS, BROADCAST_RANGES = 1 << 20, 5000, 16, 18, 1 << 20
CACHE_PIECES, CACHE_BYTES, LEARN_PIECES, RANGE_ROWS, CHUNK_BYTES = 300_000, 64 << 20, 4096, 8192, 8 << 20
#: Latin letters (of every Unicode version) before a last full stop or comma; white space other than single spaces and lone line ends inside a text.
LETTER_MARK = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}][.,]\z"
OTHER_SPACE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


class Encoder:
    """Texts -> arrays of uint32 ids, each with the end id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = self._whole(".")[0], self._whole(",")[0]
        names = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)  # ids that start with the byte of a space or a line end
        self.begins[[i for name, i in names.items() if name[0] in "\u0120\u010a"]] = True
        self._forget()

    def _forget(self) -> None:
        self.table = pa.array([], pa.string())  # pieces; their ids are sizes[row] entries of pool, from starts[row] on
        self.starts, self.sizes, self.pool = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint32))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, pieces: pa.Array, sizes: list[np.ndarray], ids: list[np.ndarray]) -> None:
        self.table = pa.concat_arrays([self.table, pieces])
        self.sizes, self.pool = np.concatenate([self.sizes, *sizes]), np.concatenate([self.pool, *ids])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _keep(self, old: int, rows: np.ndarray) -> None:
        """Of what came after the first old pieces, only these rows stay: most words that a chunk holds once do not come again."""
        ids, sizes, added = self._ids(rows)[0], self.sizes[rows], self.table.take(pa.array(rows))
        self.table, self.sizes, self.pool = self.table[:old], self.sizes[:old], self.pool[: self.sizes[:old].sum()]
        self._add(added, [sizes], [ids])

    def _rows(self, pieces: pa.Array) -> pa.Array:
        return pc.index_in(pieces, value_set=self.table)

    def _ids(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of pieces, and where each piece ends."""
        size = self.sizes[row]
        stop = np.cumsum(size)
        return self.pool[np.repeat(self.starts[row] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)], stop

    def _learn(self, pieces: pa.Array) -> None:
        """Add new pieces to the table. A full stop or comma after a letter is a piece of its own for the tokenizer: what stands before is learnt alone."""
        marked = pc.match_substring_regex(pieces, LETTER_MARK)
        ends = pieces.filter(marked)
        bare = pc.utf8_slice_codeunits(ends, 0, -1)
        plain = pc.unique(pa.concat_arrays([pieces.filter(pc.invert(marked)), bare]))
        self._encode(plain.filter(pc.is_null(self._rows(plain))))
        ids, stop = self._ids(self._rows(bare).to_numpy())
        marks = np.where(pc.ends_with(ends, ".").to_numpy(zero_copy_only=False), *self.marks)
        self._add(ends, [np.diff(stop, prepend=0) + 1], [np.insert(ids, stop, marks).astype(np.uint32)])

    def _encode(self, pieces: pa.Array) -> None:
        """Pieces are put one after the other in one text; each begins with a space or line end and has no other, so its ids can be told apart."""
        sizes, pool = [], []
        for k in range(0, len(pieces), LEARN_PIECES):
            part = [x if x[:1] == "\n" else " " + x for x in pieces[k : k + LEARN_PIECES].to_pylist()]
            ids = self._whole("".join(part))
            size = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
            if len(size) != len(part):
                each = [self._whole(x) for x in part]
                ids, size = np.concatenate(each), np.array([len(x) for x in each])
            sizes.append(size)
            pool.append(ids)
        self._add(pieces, sizes, pool)

    def _pieced(self, texts: pa.Array) -> list[np.ndarray]:
        """Every word is a piece; the first of a line takes the line end before it. A text's first piece has one too many: its place goes to the end id of the text before."""
        lines = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        split = pc.split_pattern(pc.utf8_slice_codeunits(lines, 1), " ")
        words = split.flatten().dictionary_encode()
        pieces = words.dictionary
        if len(self.table) > CACHE_PIECES or self.table.nbytes > CACHE_BYTES:
            self._forget()
        old = len(self.table)
        row = self._rows(pieces)
        if row.null_count:
            self._learn(pieces.filter(pc.is_null(row)))
            row = self._rows(pieces)
        row = row.to_numpy()[words.indices.to_numpy()]
        ids, stop = self._ids(row)
        first = (stop - self.sizes[row])[split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()]
        ids[first] = END_ID
        self._keep(old, old + np.flatnonzero(np.bincount(row, minlength=len(self.table))[old:] > 1))
        return np.split(np.append(ids[1:], np.uint32(END_ID)), first[1:])

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        whole = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, OTHER_SPACE))
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        rest = texts.filter(pc.invert(whole))
        pieced = iter(self._pieced(rest) if len(rest) else ())
        return [np.append(self._whole(texts[k].as_py()), np.uint32(END_ID)) if w else next(pieced) for k, w in enumerate(whole.to_pylist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def compress(ids: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k, of symbol FIRST_RULE + k, stands for its pair. Ids must be below FIRST_RULE. Ends when no pair is frequent."""
    x = ids.astype(np.uint32)
    rules = np.zeros((0, 2), np.uint32)
    while len(x) > 1:
        # places of pairs whose slot is full enough, then those of frequent pairs
        slot = _slots(x[:-1], x[1:])
        at = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= MIN_PAIR)[slot])
        at = at[(x[at] != end_id) & (x[at + 1] != end_id)]
        here = (x[at].astype(np.uint64) << np.uint64(32)) | x[at + 1]
        pairs, count = np.unique(here, return_counts=True)
        top = np.argsort(-count, kind="stable")[:RULES]
        top = pairs[top[count[top] >= MIN_PAIR]]
        if not len(top):
            break
        # of pairs of one slot the most frequent one goes first, the others in the next round
        left, right = (top >> np.uint64(32)).astype(np.uint32), top.astype(np.uint32)
        places = _slots(left, right)
        first = np.sort(np.unique(places, return_index=True)[1])
        top, left, right = top[first], left[first], right[first]
        table = np.full(1 << SLOT_BITS, -1, np.int32)
        table[places[first]] = np.arange(len(top), dtype=np.int32)
        r = table[slot[at]]
        same = (r >= 0) & (top[r] == here)
        at, r = at[same], r[same]
        # runs of overlapping places: every second one, from the left
        begin = np.ones(len(at), bool)
        begin[1:] = np.diff(at) != 1
        offset = at - at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
        at, r = at[offset % 2 == 0], r[offset % 2 == 0]
        x[at] = r.astype(np.uint32) + np.uint32(FIRST_RULE + len(rules))
        stay = np.ones(len(x), bool)
        stay[at + 1] = False
        x = x[stay]
        rules = np.vstack([rules, np.stack([left, right], axis=1)])
    return x, rules


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of SLOT_BITS bits for each pair of symbols."""
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - SLOT_BITS)).astype(np.int64)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    out = np.ones(len(rules), np.uint32)
    size = lambda s: out[s - FIRST_RULE] if s >= FIRST_RULE else 1
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = size(a) + size(b)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of a run of symbols."""
    flat: list[list[int]] = []
    for a, b in rules.tolist():
        flat.append((flat[a - FIRST_RULE] if a >= FIRST_RULE else [a]) + (flat[b - FIRST_RULE] if b >= FIRST_RULE else [b]))
    table = np.array([i for f in flat for i in f], np.uint32)
    begin = np.zeros(len(rules) + 1, np.int64)
    np.cumsum(lengths, out=begin[1:])
    is_rule = symbols >= FIRST_RULE
    size = np.ones(len(symbols), np.int64)
    size[is_rule] = lengths[symbols[is_rule] - FIRST_RULE]
    out = np.repeat(symbols, size)
    if is_rule.any():
        big = symbols[is_rule] - FIRST_RULE
        n = size[is_rule]
        start = np.cumsum(size) - size
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(start[is_rule], n) + within] = table[np.repeat(begin[big], n) + within]
    return out


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], before: int) -> bytes:
    counts = np.array([len(x) for x in ids], "<u4")
    symbols, rules = compress(np.concatenate(ids))
    ends = np.flatnonzero(symbols == END_ID) + 1
    if len(ends) != len(ids):  # the end id also stands inside a text: count its places in each document
        inside = np.cumsum([np.count_nonzero(x == END_ID) for x in ids])
        ends = ends[inside - 1]
    widths = np.diff(np.concatenate([[0], ends])).astype("<u4")
    wide = 4 if len(symbols) and symbols.max() >= 1 << 16 else 2
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.packbits([d is None for d in doc_ids])
    head = struct.pack("<4s4IQ", b"RPG1", len(ids), len(rules), len(symbols), wide, before)
    return b"".join([head, keys.tobytes(), null.tobytes(), counts.tobytes(), widths.tobytes(), rules.astype("<u4").tobytes(), rule_lengths(rules).astype("<u4").tobytes(), symbols.astype(f"<u{wide}").tobytes()])


class Shard:
    """A reader of one record. Any run of ids of a document is found by the lengths of what its symbols stand for: a bisection
    among its symbols, then a walk down the rules of the first and the last one; no other rule is looked at but those of the
    symbols in between. `visited` counts the rules that were."""

    def __init__(self, blob: bytes):
        magic, docs, rules, symbols, wide, self.before = struct.unpack_from("<4s4IQ", blob)
        if magic != b"RPG1":
            raise ValueError("not a shard record")
        at = struct.calcsize("<4s4IQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(blob, kind, n, at)
            at += x.nbytes
            return x

        keys, null = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs)
        self.keys = [None if n else k for k, n in zip(keys.tolist(), null.tolist())]
        self.counts, self.widths = take("<u4", docs), take("<u4", docs)
        self.rules, self.lengths = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take(f"<u{wide}", symbols).astype(np.uint32)
        self.starts = np.cumsum(self.widths, dtype=np.int64) - self.widths
        self.visited = 0

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rules = symbols >= FIRST_RULE
        out[rules] = self.lengths[symbols[rules] - FIRST_RULE]
        return out

    def ids(self, k: int, i: int = 0, j: int | None = None) -> np.ndarray:
        """Ids i..j (end exclusive, as slices have it) of document k."""
        i, j, _ = slice(i, j).indices(int(self.counts[k]))
        if i >= j:
            return np.zeros(0, np.uint32)
        own = self.symbols[self.starts[k] : self.starts[k] + self.widths[k]]
        size = self._sizes(own)
        ends = np.cumsum(size)
        first, last = int(np.searchsorted(ends, i, "right")), int(np.searchsorted(ends, j, "left"))
        out: list[int] = []
        for m in range(first, last + 1):
            at = int(ends[m] - size[m])
            self._walk(int(own[m]), i - at, j - at, out)
        return np.array(out, np.uint32)

    def _walk(self, symbol: int, i: int, j: int, out: list[int]) -> None:
        """Add ids i..j of what a symbol stands for."""
        todo = [(symbol, i, j)]
        while todo:
            symbol, i, j = todo.pop()
            if symbol < FIRST_RULE:
                out.append(symbol)
                continue
            self.visited += 1
            left, right = self.rules[symbol - FIRST_RULE].tolist()
            n = int(self.lengths[left - FIRST_RULE]) if left >= FIRST_RULE else 1
            if j > n and i < int(self.lengths[symbol - FIRST_RULE]):
                todo.append((right, i - n, j - n))
            if i < n:
                todo.append((left, i, j))

    def document(self, k: int) -> np.ndarray:
        return self.ids(k)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.lengths)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts of batches put together until they hold CHUNK_BYTES, so that a chunk's words repeat."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(x.nbytes for x in kept) >= CHUNK_BYTES:
            yield [k for x in kept for k in x.column(0).to_pylist()], pa.concat_arrays([x.column(1) for x in kept])
            kept = []
    if kept:
        yield [k for x in kept for k in x.column(0).to_pylist()], pa.concat_arrays([x.column(1) for x in kept])


def write(docs: DataFrame, path: str) -> DataFrame:
    """Encode docs and write the shard records; returns the table written: part, seq, n_ids, record."""
    spark = docs.sparkSession
    workers_find_us(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(path)
        keys, ids, size, before, seq = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([pack_shard(keys, ids, before)], pa.binary())], names=["part", "seq", "n_ids", "record"])

        for doc_ids, texts in chunks(batches):
            for k, x in zip(doc_ids, enc.batch(texts)):
                keys.append(k)
                ids.append(x)
                size += len(x)
                if size >= SHARD_IDS:
                    yield flush()
                    before, seq = before + size, seq + 1
                    keys, ids, size = [], [], 0
        if keys:
            yield flush()

    return durable(ordered.mapInArrow(run, "part int, seq int, n_ids bigint, record binary"), "ids")


def read_back(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the records."""
    workers_find_us(records.sparkSession)
    records.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(blob)
                ids = s.all().astype("<u4")
                stop = np.cumsum(s.counts, dtype=np.int64)
                start = stop - s.counts
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(start.tolist(), stop.tolist())]
                keys = s.keys
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(start + s.before), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = records.select("part", "record").mapInArrow(run, "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    starts = index(records)
    small = F.broadcast if starts.count() <= BROADCAST_RANGES else lambda df: df
    return rows.join(small(starts), "part").select("doc_id", (F.col("at") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def index(records: DataFrame, step: int = 4096) -> DataFrame:
    """part, start: the ids before each range, the index that is written beside the records. Running sums within groups of `step`
    ranges and over the groups, so no task sums all ranges one by one."""
    sums = records.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("far", F.floor(F.col("part") / F.lit(step)))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("far").agg(F.sum("n").alias("n")).select("far", before(W.orderBy("far")).alias("base"))
    return durable(sums.withColumn("near", before(W.partitionBy("far").orderBy("part"))).join(groups, "far").select("part", (F.col("near") + F.col("base")).cast("bigint").alias("start")), "index")
