"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

Method. The ordinary dictionary B is trained on all windows of ordinary labelled text. The toxic dictionary is B followed by a
segment trained on passages of toxic text. Toxic documents are ordinary text but for a few places, so a segment trained on all
their windows mostly holds ordinary text again (see the README for figures): it is trained on the passages of one to PHRASE
words, as they stand in toxic text, whose smoothed share of toxic rows is RATE times that of ordinary rows, that stand in enough
different contexts of toxic texts (copies of one text count once), and that hold no shorter such passage. A document is cut
into windows of `WINDOW` words; each is compressed with both dictionaries. Because both start with B, the difference of the
lengths is the bytes that toxic material saves. The document's features are the savings per window above a threshold and the
largest one; a logistic curve, fitted on labelled rows that trained no dictionary, turns them into the score. The threshold is
the one of CUTS whose curve fits those rows best.

Bounds (documented parameters): at most MAX_ORDINARY + MAX_TOXIC labelled rows of together at most MAX_CHARS characters for
each class reach the task that trains, in the order of a hash of doc_id; all their text is used. The model is a few tens of kB and
travels in the task closure. Scoring reads whole texts, row by row, without a shuffle.

Edge cases: a null or empty text, or one without words, is one empty window and gets the score of zero savings; a null
doc_id is scored like any other, is never learned from, and its held_out is false; repeated rows each get their row, rows of
one labelled doc_id with different texts teach by the smallest; with no labelled rows of one class the score is the share of
the other class; an empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ARROW_ROWS, append_columns, workers_find_us

WINDOW, LEVEL, SMOOTH = 6, 3, 20
#: Thresholds of a window's saving, in bytes, one of which is chosen on the rows that fit the curve.
CUTS = range(2, 8)
MAX_ORDINARY, MAX_TOXIC, MAX_CHARS = 5000, 2500, 16_000_000
BASE_BYTES, TAIL_BYTES = 32768, 2048
#: Words of a passage of the toxic dictionary at most, and how many times as often, by share of rows, it stands in toxic rows.
PHRASE, RATE = 3, 5.0
STRIP = b".,!?|;:&$%#*\"'()"


@dataclass(frozen=True)
class Model:
    base: bytes
    tail: bytes
    weights: tuple[float, float, float]
    cut: int = 0


def windows(text: str | None) -> list[bytes]:
    w = (text or "").lower().encode("utf-8", "replace").split()
    return [b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)] or [b""]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(base: bytes, tail: bytes):
    """text -> the bytes that the toxic dictionary saves in each window."""
    if not tail:
        return lambda text: [0]
    plain, toxic = _compressor(base).compress, _compressor(base + tail).compress
    return lambda text: [len(plain(x)) - len(toxic(x)) for x in windows(text)]


def features(saved: list[int], cut: int) -> tuple[float, float]:
    """(saved bytes a window, largest saving) of the windows that save more than cut bytes."""
    over = [d for d in saved if d > cut]
    return sum(over) / (len(saved) + SMOOTH), float(max(over, default=0))


def _train_dictionary(size: int, samples: list[bytes]) -> bytes:
    """Trained dictionary bytes; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def train(rows: list[tuple[int, str | None, int]]) -> Model:
    """rows: (doc_id, text, toxic). Rows of crc32 remainder 1 (mod 5) fit the curve, the others the dictionaries."""
    rows = sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: r[0])
    fold = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 for r in rows}
    fit = [r for r in rows if fold[r[0]] == 1]
    dic = [r for r in rows if fold[r[0]] != 1]
    ordinary, toxic = [r[1] or "" for r in dic if not r[2]], [r[1] or "" for r in dic if r[2]]
    share = sum(bool(r[2]) for r in rows) / len(rows) if rows else 0.0
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not ordinary or not toxic:
        return Model(b"", b"", (prior, 0.0, 0.0))
    rng = random.Random(1)
    plain = [x for t in ordinary for x in _wide(t)]
    rng.shuffle(plain)
    base = _train_dictionary(BASE_BYTES, plain)
    passages = toxic_passages(ordinary, list(dict.fromkeys(toxic)))
    samples = [b" " + b" ".join(g) + b" " for g, n in sorted(passages.items()) for _ in range(n)]
    rng.shuffle(samples)
    tail = _train_dictionary(TAIL_BYTES, [b"".join(samples[i : i + 3]) for i in range(0, len(samples), 3)])[-TAIL_BYTES:] if samples else b""
    saved = differences(base, tail)
    seen = [(saved(t), y) for _, t, y in fit]
    curves = [(*_logistic([(features(d, cut), y) for d, y in seen], prior), -cut) for cut in CUTS]
    _, weights, cut = max(curves)
    return Model(base, tail, weights, -cut)


def _bare(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of a text, and the same without marks around them."""
    w = text.lower().encode("utf-8", "replace").split()
    return w, [x.strip(STRIP) for x in w]


def _places(bare: list[bytes], n: int, alive: set) -> list[tuple[int, tuple[bytes, ...]]]:
    """(start, passage) of the passages of n words whose parts of n - 1 words are alive."""
    if n == 1:
        return [(i, (x,)) for i, x in enumerate(bare) if x]
    runs = [tuple(bare[i : i + n - 1]) in alive for i in range(len(bare) - n + 2)]
    return [(i, tuple(bare[i : i + n])) for i in range(len(bare) - n + 1) if runs[i] and runs[i + 1]]


def toxic_passages(ordinary: list[str], toxic: list[str]) -> dict[tuple[bytes, ...], int]:
    """Passages that tell toxic texts from ordinary ones, and how often each is to be learned: a word as often as it has contexts, a
    longer one with the words around it, once for each context. Of longer passages only those count whose parts are common
    enough and do not tell by themselves."""
    # words are split anew for each length: the driver does not hold them all
    least = max(2, min(6, len(toxic) // 50))
    found: Counter = Counter()
    alive: set = set()
    for n in range(1, PHRASE + 1):
        near: dict[tuple[bytes, ...], set] = defaultdict(set)
        rows: Counter = Counter()
        for w, bare in map(_bare, toxic):
            places = _places(bare, n, alive)
            for i, g in places:
                near[g].add((w[i - 1] if i else b"", w[i + n] if i + n < len(w) else b""))
            rows.update({g for _, g in places})
        # there are many more longer passages, so more of them differ by chance
        enough = max(least, len(toxic) // 20) if n > 1 else least
        common = {g for g, c in near.items() if len(c) >= least and rows[g] >= (enough if n == PHRASE else least)}
        plain: Counter = Counter()
        for _, bare in map(_bare, ordinary):
            plain.update({g for _, g in _places(bare, n, alive)} & common)
        # smoothed share of toxic rows over that of ordinary rows: a few quotes or wrong labels do not take a passage away
        tell = {g for g in common if rows[g] >= enough and (rows[g] + 0.5) / (len(toxic) + 1) * (len(ordinary) + 1) / (plain[g] + 0.5) >= RATE}
        for g in sorted(tell):
            found.update({g: len(near[g])} if n == 1 else {(before, *g, after): 1 for before, after in near[g]})
        alive = common - tell
    return found


def _wide(text: str) -> list[bytes]:
    w = text.lower().encode("utf-8", "replace").split()
    return [b" ".join(w[i : i + 12]) for i in range(0, len(w), 12)]


def _logistic(rows: list, prior: float) -> tuple[float, tuple[float, float, float]]:
    """(share of right rows of both classes, weights): Newton steps for a logistic regression with a little shrinkage, on (log of savings, root of the
    largest saving)."""
    if len({bool(y) for _, y in rows}) < 2:
        return 0.0, (prior, 0.0, 0.0) if not rows else (-3.0, 4.0, 0.5)
    x = np.array([_inputs(*f) for f, _ in rows])
    y = np.array([float(bool(y)) for _, y in rows])
    w = np.zeros(3)
    shrink = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    right = (x @ w >= 0) == (y > 0)
    return round(float(right[y > 0].mean() + right[y == 0].mean()), 3), tuple(map(float, w))


def _inputs(saved: float, largest: float) -> tuple[float, float, float]:
    return 1.0, float(np.log1p(20 * saved)), float(np.sqrt(largest))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """doc_id, text, toxic: labelled rows outside the held-out fold, in the order of a hash of doc_id: at most MAX_ORDINARY and MAX_TOXIC, of at most
    MAX_CHARS characters a class."""
    usable = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    ids = usable.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ORDINARY).union(usable.where("toxic <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TOXIC))
    size = docs.select("doc_id", F.char_length("text").alias("n")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n")).select("doc_id", "toxic", "n", F.xxhash64("doc_id").alias("h")).collect()
    chosen, room = [], {True: MAX_CHARS, False: MAX_CHARS}
    for r in sorted(size, key=lambda r: (r["h"], r["doc_id"])):
        if (r["n"] or 0) <= room[bool(r["toxic"])]:
            room[bool(r["toxic"])] -= r["n"] or 0
            chosen.append((r["doc_id"], r["toxic"]))
    if not chosen:
        return None
    kept = docs.sparkSession.createDataFrame(chosen, ids.schema)
    return docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str | None, int]]:
    """The labelled rows on the driver."""
    rows = labelled_rows(docs, labels)
    return [] if rows is None else [tuple(r) for r in rows.collect()]


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of train() on the labelled rows. One task trains it: their number and characters are bounded whatever the
    input, and only the model's few tens of kB come to the driver."""
    rows = labelled_rows(docs, labels)
    if rows is None:
        return train([])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = train([r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))])
        yield pa.RecordBatch.from_arrays([pa.array([m.base], pa.binary()), pa.array([m.tail], pa.binary()), pa.array([list(m.weights)], pa.list_(pa.float64())), pa.array([m.cut], pa.int32())], names=["base", "tail", "weights", "cut"])

    workers_find_us(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    [r] = rows.repartition(1).mapInArrow(fit, "base binary, tail binary, weights array<double>, cut int").collect()
    return Model(bytes(r["base"]), bytes(r["tail"]), tuple(r["weights"]), r["cut"])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column of scores between 0 and 1, from the texts alone."""

    def columns(texts: list) -> list:
        if "f" not in made:
            made["f"] = differences(model.base, model.tail)
        out = []
        for t in texts:
            z = float(np.dot(model.weights, _inputs(*features(made["f"](t), model.cut))))
            out.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
        return [out]

    made: dict = {}
    return append_columns(docs, columns, [(column, pa.float64(), "double")])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = learned(docs, labels)
    scored = score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return scored.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
