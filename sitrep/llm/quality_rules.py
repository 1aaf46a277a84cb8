"""Quality rules: a threshold table compiled into one projection, built-in functions only.

Every rule is a ratio of two counts of the text with a lower and an upper bound. The counts are
computed once for each row, in one pass without a shuffle, and the table becomes one boolean
expression. A null or empty text has no words, so the base rule fails it; nothing is dropped.
Rows are judged one by one: ties, repeated rows and extra columns change nothing, and columns of
the input that carry a name of the result are replaced by the result's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import BLANK, NOT_BLANK, let, words_of

#: Symbols counted against words.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be this an by or at from "
    "der die das und zu ist nicht mit den von ein eine im für auf dem sich des "
    "le la les de des et un une que en est pas dans pour qui du "
    "el los las y que del se por una con no su"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; an empty denominator counts as one."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Counts are named after the columns of ``counts``.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.01, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.4),
    Rule("repeat_word_ratio", "n_repeat_words", "n_words", None, 0.5),
    Rule("upper_ratio", "n_upper", "word_chars", None, 0.4),
    Rule("digit_ratio", "n_digits", "word_chars", None, 0.3),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


#: Bits of a packed window that hold its position; the other bits hold a hash of its words.
POSITION_BITS = 24


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows become numbers, hash bits above position bits. Sorted, equal windows are neighbours;
    their words are compared. Should hash bits agree where words do not, or positions not fit,
    the windows themselves are sorted instead. The work is n log n for a text of n words.
    """
    n_windows = F.greatest(F.size(words) - 2, F.lit(0))
    near = lambda x, other: F.shiftright(x.bitwiseXOR(other), POSITION_BITS) == 0
    at = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")

    # beyond either end there is no neighbour: null, which a filter takes as false
    def possible(packed: Column) -> Column:
        return F.filter(
            packed, lambda x, i: near(x, F.get(packed, i + 1)) | near(x, F.get(packed, i - 1))
        )

    def differ(p: Column, q: Column) -> Column:
        parts = [F.get(words, p + k) != F.get(words, q + k) for k in range(3)]
        return parts[0] | parts[1] | parts[2]

    def confirmed(kept: Column) -> Column:
        clashes = F.filter(
            kept,
            lambda x, i: near(x, F.get(kept, i + 1)) & differ(at(x), at(F.get(kept, i + 1))),
        )
        return F.when(F.size(clashes) == 0, F.sort_array(F.transform(kept, at))).otherwise(
            by_text()
        )

    def by_text() -> Column:
        def marked(ordered: Column) -> Column:
            text_at = lambda i: F.get(ordered, i)["w"]
            repeated = F.filter(
                ordered, lambda x, i: (text_at(i + 1) == x["w"]) | (text_at(i - 1) == x["w"])
            )
            return F.sort_array(F.transform(repeated, lambda x: x["i"]))

        windows = F.transform(
            words,
            lambda w, i: F.struct(
                F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"),
                i.alias("i"),
            ),
        )
        return let(F.sort_array(F.slice(windows, F.lit(1), n_windows)), marked)

    def covered(starts: Column) -> Column:
        step = lambda x, i: F.least(F.get(starts, i + 1) - x, F.lit(3))
        return F.aggregate(F.transform(starts, step), F.lit(0), lambda total, x: total + x)

    hashed = F.transform(
        words,
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
        .bitwiseAND(F.lit(-1 << POSITION_BITS))
        .bitwiseOR(i.cast("long")),
    )
    fits = F.size(words) < (1 << POSITION_BITS)
    # the last two positions start no whole window; leaving them out here spares a copy
    near_whole = F.filter(let(F.sort_array(hashed), possible), lambda x: at(x) < n_windows)
    starts = F.when(fits, let(let(near_whole, possible), confirmed)).otherwise(by_text())
    return let(starts, covered)


def _counts(text: Column) -> Column:
    def of_words(words: Column) -> list[Column]:
        stop = F.filter(words, lambda w: w.isin(*STOP_WORDS, *[s.capitalize() for s in STOP_WORDS]))
        return [
            F.size(words).cast("long").alias("n_words"),
            F.size(stop).cast("long").alias("n_stop_words"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        ]

    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK))
    return let(
        lines,
        lambda kept_lines: let(
            words_of(text),
            lambda words: F.struct(
                *of_words(words),
                count("[" + SYMBOLS + "]").alias("n_symbols"),
                F.char_length(F.regexp_replace(text, BLANK + "+", ""))
                .cast("long")
                .alias("word_chars"),
                F.size(kept_lines).cast("long").alias("n_lines"),
                (F.size(kept_lines) - F.size(F.array_distinct(kept_lines)))
                .cast("long")
                .alias("n_dup_lines"),
                count("[A-Z]").alias("n_upper"),
                count("[0-9]").alias("n_digits"),
            ),
        ),
    )


def _verdict(rule: Rule, counts: Column) -> tuple[Column, Column]:
    ratio = counts[rule.numerator] / F.greatest(counts[rule.denominator], F.lit(1))
    fails = F.lit(False)
    if rule.low is not None:
        fails = fails | (ratio < rule.low)
    if rule.high is not None:
        fails = fails | (ratio > rule.high)
    return ratio, fails


def apply_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``failed_rules`` and a ratio for each rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", _counts(text).alias("c"))
    c = F.col("c")
    base_failed = (c["n_words"] < min_words) | (
        100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"]
    )
    verdicts = {r.name: _verdict(r, c) for r in rules}
    failed = F.array_compact(
        F.array(*[F.when(fails, F.lit(name)) for name, (_, fails) in verdicts.items()])
        if verdicts
        else F.array().cast("array<string>")
    )
    passes = F.lit(True)
    for _, fails in verdicts.values():
        passes = passes & ~fails
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return counted.select(
        "doc_id",
        *[c[name].alias(name) for name in base],
        base_failed.alias("base_failed"),
        (~base_failed & passes).alias("kept"),
        F.array_join(failed, ",").alias("failed_rules"),
        *[ratio.alias(name) for name, (ratio, _) in verdicts.items()],
    )
