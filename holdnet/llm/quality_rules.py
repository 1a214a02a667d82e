"""Quality rules: a short-circuit cascade of native column rules ordered by rejection per cost.

Every rule is one boolean column over the whole text (no UDF).  ``order_rules``
estimates each rule's cost (measured seconds) and selectivity (rejected share)
on a bounded sample; ``verdict`` chains the rules in that order in one CASE
expression, so a text that an early rule rejects never evaluates the later ones.
The order changes only the work, never which documents stay.

Defined results: a null or empty text has no words and fails ``few_words``;
repeated rows and ties are judged row by row; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import WHITE, WHITE_CLASS, fresh

#: Fixed values of the rules (percentages are of words, lines or characters).
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 50
MAX_UPPER_PCT = 50
WORD_LENGTH = (2, 16)
WINDOW = 5
#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2_000


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space."""
    trimmed = F.btrim(_text(text), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+"))


def count_of(text: Column, char_class: str) -> Column:
    """Characters of ``char_class`` (a regular-expression class): the pieces of a split, less one."""
    return (F.size(F.split(_text(text), char_class)) - 1).cast("long")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(_text(text), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def window_hashes(ws: Column) -> Column:
    """64-bit hash of each run of WINDOW consecutive words (empty for shorter texts)."""
    n = F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0))
    shifted = [F.slice(ws, k + 1, n).alias(f"w{k}") for k in range(WINDOW)]
    return F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(WINDOW)]))


def covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice: sort (hash, position) once, keep equal
    neighbours, then add up the union of the windows from the gaps between their sorted positions."""
    def twice(s: Column) -> Column:
        edge = F.array(F.lit(None).cast("struct<h:bigint,p:int>"))
        n = F.size(s)
        beside = F.arrays_zip(s.alias("c"), F.concat(edge, F.slice(s, 1, n - 1)).alias("b"),
                              F.concat(F.slice(s, 2, n), edge).alias("d"))
        kept = F.filter(beside, lambda x: x["c"]["h"].eqNullSafe(x["b"]["h"]) | x["c"]["h"].eqNullSafe(x["d"]["h"]))
        return F.sort_array(F.transform(kept, lambda x: x["c"]["p"]))

    def total(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1),
                          lambda b, a: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g).cast("long")

    ordered = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(1), F.size(hashes)).alias("p")))
    return bind(ordered, lambda s: bind(twice(s), total))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once: a lambda over a one-element array."""
    return F.transform(F.array(value), fn)[0]


def repeat_words(ws: Column) -> Column:
    """Words inside WINDOW-word windows found at least twice in the text, the first included."""
    return bind(window_hashes(ws), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered_words(h)).otherwise(F.lit(0).cast("long")))


class TextFacts:
    """Facts about a text, each a lazy expression over the raw text column."""

    def __init__(self, text: Column):
        self.text = text

    def n_words(self) -> Column:
        return F.size(words(self.text)).cast("long")

    def word_chars(self) -> Column:
        return F.length(F.array_join(words(self.text), "")).cast("long")

    def n_symbols(self) -> Column:
        return count_of(self.text, SYMBOLS)

    def n_upper(self) -> Column:
        return count_of(self.text, "[A-Z]")

    def n_chars(self) -> Column:
        return F.length(_text(self.text)).cast("long")

    def n_lines(self) -> Column:
        return F.size(lines(self.text)).cast("long")

    def n_dup_lines(self) -> Column:
        return bind(lines(self.text), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")

    def n_repeat_words(self) -> Column:
        return repeat_words(words(self.text))


class KnownFacts(TextFacts):
    """The same facts, those in ``known`` read from columns already there."""

    def __init__(self, text: Column, known: list[str]):
        super().__init__(text)
        for name in known:
            setattr(self, name, lambda name=name: F.col(name))


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a TextFacts to a boolean column: true where the rule rejects."""
    name: str
    rejects: Callable[[TextFacts], Column]


BASE_RULES = [
    Rule("few_words", lambda f: f.n_words() < MIN_WORDS),
    Rule("repeats", lambda f: f.n_repeat_words() * 100 > f.n_words() * MAX_REPEAT_PCT),
]
METHOD_RULES = [
    Rule("symbols", lambda f: f.n_symbols() * 100 > f.n_words() * MAX_SYMBOL_PCT),
    Rule("upper_case", lambda f: f.n_upper() * 100 > f.n_chars() * MAX_UPPER_PCT),
    Rule("dup_lines", lambda f: f.n_dup_lines() * 100 > f.n_lines() * MAX_DUP_LINE_PCT),
    Rule("short_words", lambda f: f.word_chars() < f.n_words() * WORD_LENGTH[0]),
    Rule("long_words", lambda f: f.word_chars() > f.n_words() * WORD_LENGTH[1]),
]


def order_rules(docs: DataFrame, rules: list[Rule], facts: TextFacts, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected share per measured second on ``sample_rows`` rows, best first (ties: given order).

    The sample only decides the order.  An empty table keeps the given order.
    """
    sample = docs.limit(sample_rows).persist()
    try:
        n = sample.count()
        if n == 0:
            return list(rules)
        scored = []
        for k, rule in enumerate(rules):
            t0 = time.perf_counter()
            rejected = sample.agg(F.count_if(rule.rejects(facts))).first()[0]
            scored.append((-(rejected / n) / max(time.perf_counter() - t0, 1e-6), k, rule))
        return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def verdict(rules: list[Rule], facts: TextFacts) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does (lazy CASE)."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(facts), F.lit(rule.name)).otherwise(out)
    return out


class WordFacts(TextFacts):
    """Facts that need the words read them from an array column, split once per text."""

    def __init__(self, text: Column, split: Column):
        super().__init__(text)
        self.words = split

    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("long")

    def n_repeat_words(self) -> Column:
        return repeat_words(self.words)


def filter_quality(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns.

    The verdict is the output of a generator over a one-element array: a filter on it cannot be pushed below, where
    the optimizer would write the words' expression into every rule again.
    """
    own, found = fresh(docs.columns, "_w", "_verdict")
    facts = WordFacts(F.col(text), F.col(own))
    split = docs.withColumn(own, words(F.col(text)))
    ordered = order_rules(split.select(text, own), rules or BASE_RULES + METHOD_RULES, facts, sample_rows)
    judged = split.select(*docs.columns, F.explode(F.array(verdict(ordered, facts))).alias(found))
    return judged.filter(F.col(found).isNull()).select(*docs.columns)


def base_facts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` per row."""
    t = F.col("text")
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).withColumn("_w", words(t))
    facts = TextFacts(t)
    return split.select(
        "doc_id", "text", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        facts.n_symbols().alias("n_symbols"), facts.n_dup_lines().alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base counts, ``base_failed`` and ``kept``.

    The base rules come first by definition; the method's rules run as a cascade in their estimated order, only on
    texts that pass the base rules, and read the counts that are already there.
    """
    base = base_facts(docs, id_col, text)
    facts = KnownFacts(F.col("text"), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    ordered = order_rules(base, METHOD_RULES, facts, sample_rows)
    failed = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                             | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    kept = ~F.col("base_failed") & verdict(ordered, facts).isNull()
    return failed.withColumn("kept", kept).drop("text")
