"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Base columns follow the contract: words `[^\\x20\\x09-\\x0D]+`, word_chars, n_symbols, n_dup_lines, n_repeat_words, and
base_failed (n_words < 50, or repeated 3-word windows cover over half of the words). Further rules then judge the rows that
pass the base. On a sample each rule's cost (time of repeated evaluation above an empty rule's) and its rejection of what the
rules before it let pass are estimated; rules run in the order of rejection per cost, as nested conditions, so a row that one rule
rejects is not looked at by the next. The order never changes which rows are kept: a row is kept if it passes the base and every rule.

All of it is a narrow projection: no shuffle, no Python, every text whole. Repeated windows are found by sorting, inside each
row, longs that hold a window's hash above its position (as many low bits as the text needs), so a text of n words costs
n log n and a long text is one row's work; neighbours of one hash are compared word by word.

Edge cases: a null or empty text has no words and fails the base; repeated rows and null doc_ids keep their rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, durable

SPACE = r"[ \x09-\x0D]+"
SAMPLE_ROWS, REPEATS = 400, 5
#: Bits taken from the windows' hashes beside the position's (only tests take any).
EXTRA_BITS = ""


@dataclass(frozen=True)
class Rule:
    """rejects: an SQL condition over text, words and the base columns that is true for a row to be dropped."""

    name: str
    rejects: str


#: In the spirit of published web-text filters: word length, symbols, repeated lines, shouting, fields, and endings.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "n_dup_lines > 1 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "2 * char_length(translate(text, 'abcdefghijklmnopqrstuvwxyzäöüßàâçéèêëîïôûùñáíóú', '')) > char_length(text) + word_chars div 5"),
    Rule("marks", "5 * (char_length(text) - char_length(translate(text, '!?', ''))) > n_words"),
)


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and the counts, for every row of docs."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split(F.translate("text", "\t\n\u000b\f\r", "     "), " "), ""))
    d = d.withColumn("n_words", F.size("words").cast("bigint"))
    d = d.withColumn("lines", F.expr(r"filter(split(text, '\n'), l -> translate(l, ' \t\n\u000b\f\r', '') <> '')"))
    d = d.withColumn("word_chars", F.char_length(F.translate("text", " \t\n\u000b\f\r", "")).cast("bigint"))
    d = d.withColumn("n_symbols", (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("bigint"))
    d = d.withColumn("n_lines", F.size("lines").cast("bigint")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")).drop("lines")
    return d.withColumn("n_repeat_words", repeat_words())


def repeat_words() -> Column:
    """Words covered by 3-word windows that stand twice or more in the text, from the columns words and n_words."""
    # w, s, b, d and p are lambda variables, each bound once: the optimizer may copy this expression (a filter on a result column is
    # pushed down), and a column reference inside a lambda would then be computed again for every element.
    # b: the bits a position needs; a window's long is its hash shifted left by them, with the position below. d: those that have
    # a neighbour of the same hash. If such neighbours differ in their words, the text is done again by the words themselves.
    keyed = "sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | i))"
    dup = "filter(s, (x, i) -> (i > 0 and shiftrightunsigned(s[i - 1] ^ x, b) = 0) or (i < size(s) - 1 and shiftrightunsigned(s[i + 1] ^ x, b) = 0))"
    at = "cast({} & (shiftleft(1L, b) - 1) as int)"
    words_differ = " or ".join(f"w[{at.format('d[i - 1]')} + {k}] <> w[{at.format('d[i]')} + {k}]" for k in range(3))
    false_twins = f"size(d) > 1 and exists(sequence(1, size(d) - 1), i -> shiftrightunsigned(d[i - 1] ^ d[i], b) = 0 and ({words_differ}))"
    positions = "sort_array(transform(d, x -> x & (shiftleft(1L, b) - 1)))"
    by_words = "sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('g', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', cast(i as bigint))))"
    exact = f"transform(array({by_words}), g -> sort_array(transform(filter(g, (x, i) -> (i > 0 and g[i - 1].g = x.g) or (i < size(g) - 1 and g[i + 1].g = x.g)), x -> x.i)))[0]"
    covered = "aggregate(p, named_struct('last', -3L, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(x - a.last, 3L)), a -> a.n)"
    inner = f"transform(array({keyed}), s -> transform(array({dup}), d -> transform(array(if({false_twins}, {exact}, {positions})), p -> {covered})[0])[0])[0]"
    bits = f"cast(ceil(log2(size(w) + 1)) as int){EXTRA_BITS}"
    return F.expr(f"transform(array(words), w -> if(size(w) < 3, 0L, transform(array({bits}), b -> {inner})[0]))[0]")


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejection per cost, as estimated on a Bernoulli sample of about SAMPLE_ROWS rows (the order is all it decides).

    Cost: seconds of REPEATS evaluations for each sampled row, less those of an empty rule; the better of two runs. The first rule is
    the one that rejects most for its cost, and each next one that which rejects most of what the ones before it let pass.
    """
    n = docs.count()
    sample = durable(with_base_failed(base_columns(docs.sample(min(1.0, SAMPLE_ROWS / max(n, 1)), 11))).where("not base_failed"), "sample")
    try:
        hits = sample.select(*(F.expr(r.rejects).alias(r.name) for r in rules)).collect()
        often = sample.coalesce(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def seconds(condition: str) -> float:
            began = time.perf_counter()
            often.agg(F.count_if(F.expr(condition))).first()
            return time.perf_counter() - began

        idle = min(seconds("n_words < again - 1000") for _ in range(2))
        cost = {r.name: max(min(seconds(r.rejects) for _ in range(2)) - idle, 1e-3) for r in rules} if hits else {}
    finally:
        discard(sample)
    out, left = [], list(rules)
    while left:
        best = max(left, key=lambda r: (sum(bool(h[r.name]) for h in hits) / cost.get(r.name, 1.0), r.name))
        left.remove(best)
        out.append(best)
        hits = [h for h in hits if not h[best.name]]
    return out


def with_base_failed(d: DataFrame) -> DataFrame:
    return d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def cascade(rules: list[Rule]) -> Column:
    """True if no rule rejects the row; each next rule is only evaluated where the ones before passed."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(F.expr(r.rejects), F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base columns, base_failed and kept."""
    d = with_base_failed(base_columns(docs))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order_rules(docs, rules)))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
