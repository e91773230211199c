"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = "#*$%&|<>"
#: Very common words of the languages served: (language, words). Fixed values.
STOP_WORDS = (
    ("en", "the of and to in is that it for on with as be by this are from or an at was a"),
    ("fr", "le la les de des du et un une en que qui dans pour pas sur au par est il elle avec"),
    ("de", "der die das und in den von zu mit sich auf ist nicht ein eine dem im für als auch"),
    ("es", "el la los las de del y en que un una por con para es se no al lo su"),
)


@dataclass(frozen=True)
class Rule:
    """A ratio that must lie within [low, high] in texts of at least min_words words; None: no bound on that side."""

    ratio: str
    low: float | None
    high: float | None
    min_words: int = 50


#: The verdict's thresholds. Bounds are inclusive.
RULES = (
    Rule("chars_per_word", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.12),
    Rule("stop_words_per_word", 0.03, None),
    Rule("upper_per_char", None, 0.4),
    Rule("marks_per_word", None, 0.4),
    Rule("dup_lines_per_line", None, 0.4),
    Rule("repeat_per_word", None, 0.3),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body or a lambda inside it uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window found twice or more. words: an array of strings.

    Windows are hashed, equal hashes found by sorting, and the words of windows that share a hash compared through a
    second hash of other seed; texts whose windows all differ stop after one distinct.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(1), n - (window - 1))
        piece = lambda i: [F.element_at(w, i + j) for j in range(window)]

        def marked(h: Column) -> Column:
            def covered(s: Column) -> Column:
                # positions in s of entries that equal a neighbour, then their places in the text
                twice = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: _same(s, i, -1) | _same(s, i, 1))
                return bound(F.array_sort(F.transform(twice, lambda i: F.element_at(s, i)["i"])), lambda p: _union(p, window))

            def _same(s: Column, i: Column, d: int) -> Column:
                a, b = F.element_at(s, i), F.try_element_at(s, F.when((i + d < 1) | (i + d > F.size(s)), F.size(s) + 1).otherwise(i + d))
                return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

            entry = F.transform(at, lambda i: F.struct(F.element_at(h, i).alias("h"), F.xxhash64(F.lit("again"), *piece(i)).alias("g"), i.alias("i")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(F.array_sort(entry), covered))

        return F.when(n <= window, F.lit(0)).otherwise(bound(F.transform(at, lambda i: F.xxhash64(*piece(i))), marked))

    return bound(words, of).cast("long")


def _union(p: Column, window: int) -> Column:
    """Length of the union of [x, x + window) over sorted positions p."""
    steps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window)))
    return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(window), lambda s, x: s + x))


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text, each a long; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    stop = sorted({w for _, ws in STOP_WORDS for w in ws.split()})
    each = bound(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        ),
    )
    split = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "words": each,
        "lines": split,
        "n_symbols": _count(text, SYMBOLS),
        "n_marks": _count(text, "!?"),
        "n_upper": _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    }


def _ratio(name: str) -> Column:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_words_per_word": per("n_stop_words", "n_words"),
        "upper_per_char": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "repeat_per_word": per("n_repeat_words", "n_words"),
    }[name]


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: all rules hold."""
    ok = F.lit(True)
    for r in rules:
        x = _ratio(r.ratio)
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (x >= r.low)
        if r.high is not None:
            inside = inside & (x <= r.high)
        ok = ok & ((F.col("n_words") < r.min_words) | inside)
    return ok


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Per row doc_id, the text's counts, base_failed and kept. No shuffle, no user function.

    base_failed: fewer than min_words words, or over repeat_percent of the words lie in 3-word windows that recur. kept is
    false then; else it is true if all rules hold. Null, empty and blank texts have counts of 0 and fail. Rows are
    independent: repeated rows and null ids pass through, an empty table gives an empty one; only doc_id and text are read.
    """
    m = measures(F.col("text").cast("string"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in m.items()])
    out = out.select("doc_id", "words.*", "lines.*", "n_symbols", "n_marks", "n_upper")
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & compiled(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_upper", "n_marks")
