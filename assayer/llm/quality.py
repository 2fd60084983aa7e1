"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``compiled`` turns the table into columns of one ``select``: features are array expressions over the words and lines of a
text, a rule compares a feature with its bounds. Nothing is shuffled and no row meets another.

Repeated five-word windows are found per text with sorted arrays: each window gets a 64-bit hash, the hashes are
sorted as plain longs, and only texts in which two neighbours are equal go on. There the windows are sorted
again with their positions, and the words covered by a window that occurs twice are counted from the gaps
between the covered positions, so a text costs n log n however often it repeats itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SPACES = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of the languages covered; a text of running prose holds some of them.
STOP_WORDS = (
    "the be to of and that have with a in is it for on this by at or an as are was from "
    "der die das und ist von mit den zu ein eine nicht im auf für dem sich des "
    "le la les de des et un une que qui dans pour est pas sur avec du en au "
    "el los las y del que una por con para es se no como su al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text whose ``feature`` lies in [low, high]; either bound may be missing."""

    feature: str
    low: float | None = None
    high: float | None = None


#: Bounds are wide on purpose: a rule removes what no prose does.
RULES = (
    Rule("n_words", low=10),
    Rule("repeated_word_ratio", high=0.20),
    Rule("mean_word_chars", low=1.5, high=30.0),
    Rule("symbol_word_ratio", high=0.5),
    Rule("stop_word_ratio", low=0.02),
    Rule("duplicate_line_ratio", high=0.5),
    Rule("longest_word_chars", high=1000),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by a window that occurs twice or more in the text."""
    size = F.size(words)
    starts = F.sequence(F.lit(0), size - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))

    def with_sorted(ordered: Column) -> Column:
        return F.exists(
            F.sequence(F.lit(1), F.size(ordered) - 1), lambda i: F.get(ordered, i) == F.get(ordered, i - 1)
        )

    def repeated_starts(pairs: Column) -> Column:
        """From (hash, start) in order: starts of repeated windows in order."""
        same = F.filter(
            pairs, lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"])
        )
        return F.sort_array(F.transform(same, lambda p: p["i"]))

    def union(at: Column) -> Column:
        """Words covered by windows that start at the given words."""
        gaps = F.transform(
            at, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, i - 1)))
        )
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = _let(F.sort_array(hashes), with_sorted)
    return F.when(size <= WINDOW, F.lit(0).cast("bigint")).otherwise(
        F.when(repeated, _let(_let(pairs, repeated_starts), union)).otherwise(F.lit(0).cast("bigint"))
    )


def features(text: Column, words: Column) -> dict[str, Column]:
    """Counts of one text; ratios are built from them."""
    size = F.size(words)
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(SPACES)) != "")
    return {
        "n_words": size.cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": _let(words, _repeat_words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        "longest_word_chars": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("bigint"),
    }


RATIOS = {
    "repeated_word_ratio": ("n_repeat_words", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_word_ratio": ("n_symbols", "word_chars"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "duplicate_line_ratio": ("n_dup_lines", "n_lines"),
}


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules a text breaks, by the name of their feature; a ratio without a base breaks none."""
    broken = []
    for rule in rules:
        value = F.col(rule.feature)
        if rule.feature in RATIOS:
            part, base = RATIOS[rule.feature]
            value = F.try_divide(F.col(part), F.col(base))
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (value < rule.low)
        if rule.high is not None:
            outside = outside | (value > rule.high)
        broken.append(F.when(outside, F.lit(rule.feature)))
    return F.filter(F.array(*broken), lambda name: name.isNotNull())


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base verdict, broken rules and verdict per row of ``docs``.

    Null texts have no words and fail the base; a null id stays null; repeated rows are judged each; an empty table
    gives no row; other columns are dropped. ``base_failed`` is exact integer arithmetic: fewer than ten words,
    or over a fifth of the words in windows that occur twice or more.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("text"), _words(text).alias("words"))
    counted = split.select("doc_id", *(c.alias(n) for n, c in features(F.col("text"), F.col("words")).items()))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counted.withColumns({"base_failed": base, "broken": compiled(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
