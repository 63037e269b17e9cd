"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a pair of column expressions over the text: a failure test and
nothing else. On a bounded sample each rule is timed alone and its rejection
share is measured; the cascade is then one ``CASE WHEN`` whose branches follow
rejection per cost, so that cheap rules with many rejections spare the others.
The order only decides how much is computed: the verdict is the same in any
order, because a document is kept exactly when no rule rejects it.

Edge cases: null, empty and blank texts have no words and fail the length rule;
a text has no length limit; repeated rows are judged one by one; an empty table
gives an empty result; columns of the input with clashing names are replaced by
the operator's columns of that name, all others stay.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.functions.text import let
from papersieve.llm.common import NON_BLANK, words_of, written

# Fixed values of the contract's base rule.
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"

# Production thresholds of the verdict, as shares in hundredths.
MOST_SYMBOLS_PER_100_WORDS = 10
MOST_CAPITALS_PER_100_LETTERS = 50
MOST_DUPLICATE_LINES_PER_100 = 50
MOST_EXCLAMATIONS_PER_100_WORDS = 30
MEAN_WORD_CHARS = (2, 30)
# Rows of the sample that orders the cascade; a documented bound.
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """``fails(text, words)`` is true for a document that the rule rejects."""

    name: str
    fails: object


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def lines_with_words(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: line.rlike(NON_BLANK))


def window_hashes(words: Column) -> Column:
    """One 64-bit value per window of five words, in text order."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column) -> Column:
    """Words covered by windows found twice or more; sorting instead of a search per window."""

    def covered(order: Column) -> Column:
        twice = F.filter(
            order,
            lambda x, i: F.coalesce(F.get(order, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(order, i + 1)["h"] == x["h"], F.lit(False)),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda acc, s: F.struct(
                (s + WINDOW).alias("end"),
                (acc["n"] + s + WINDOW - F.greatest(acc["end"], s)).alias("n"),
            ),
        )["n"]

    ordered = F.array_sort(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    bound = F.get(F.transform(F.array(ordered), covered), F.lit(0))
    # Texts without any repeated window, nearly all, skip the sort.
    return (
        F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0))
        .otherwise(bound)
        .cast("long")
    )


def _repeats(text: Column, words: Column) -> Column:
    bound = F.get(
        F.transform(F.array(window_hashes(words)), lambda w: repeated_words(w)), F.lit(0)
    )
    return 100 * bound > MOST_REPEATED_PERCENT * F.size(words)


BASE_RULES = (
    Rule("few_words", lambda text, words: F.size(words) < LEAST_WORDS),
    Rule("repeated_words", _repeats),
)
VERDICT_RULES = (
    Rule(
        "symbols",
        lambda text, words: 100 * count_of(text, SYMBOLS)
        > MOST_SYMBOLS_PER_100_WORDS * F.size(words),
    ),
    Rule(
        "capitals",
        lambda text, words: 100 * count_of(text, "[A-Z]")
        > MOST_CAPITALS_PER_100_LETTERS * count_of(text, "[A-Za-z]"),
    ),
    Rule(
        "duplicate_lines",
        lambda text, words: F.get(
            F.transform(
                F.array(lines_with_words(text)),
                lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x)))
                > MOST_DUPLICATE_LINES_PER_100 * F.size(x),
            ),
            F.lit(0),
        ),
    ),
    Rule(
        "exclamations",
        lambda text, words: 100 * count_of(text, "!")
        > MOST_EXCLAMATIONS_PER_100_WORDS * F.size(words),
    ),
    Rule(
        "word_length",
        lambda text, words: ~word_chars(words).between(
            MEAN_WORD_CHARS[0] * F.size(words), MEAN_WORD_CHARS[1] * F.size(words)
        ),
    ),
)


def rule_statistics(
    df: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS
) -> list[tuple[str, float, float]]:
    """``(name, seconds, rejected share)`` of each rule on a sample of at most ``rows`` rows.

    The sample is taken by a hash of the text, written once, and read by one
    small job per rule; a job that tests nothing gives the cost to subtract.
    """
    n = df.count()
    if not n:
        return [(r.name, 0.0, 0.0) for r in rules]
    buckets = 1 << 40
    keep = min(buckets, buckets * rows // n)
    source = df.select(F.col(text).cast("string").alias("text"))
    drawn = source.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(buckets)) < keep)
    # Copies share a hash: the limit keeps a hot group from filling the sample's memory.
    sample = written(
        drawn.limit(2 * rows).select("text", words_of(F.col("text")).alias("words")), "rule-sample"
    )

    def timed(test: Column) -> tuple[float, float]:
        start = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(test, F.lit(False)).cast("double")).alias("s")).first()
        return time.perf_counter() - start, float(share["s"] or 0.0)

    text_col, words_col = F.col("text"), F.col("words")
    idle = min(
        timed((F.length("text") < 0) | (F.size("words") < 0))[0] for _ in range(2)
    )
    out = []
    for rule in rules:
        test = rule.fails(text_col, words_col)
        first, second = timed(test), timed(test)
        out.append((rule.name, max(min(first[0], second[0]) - idle, 1e-4), first[1]))
    return out


def cascade_order(
    rules: Sequence[Rule], statistics: Sequence[tuple[str, float, float]]
) -> list[Rule]:
    """Rules by rejected share per second, most first; ties keep the given order."""
    worth = {name: share / max(cost, 1e-4) for name, cost, share in statistics}
    return sorted(rules, key=lambda r: -worth[r.name])


def rejection(rules: Sequence[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does."""
    chain = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        fails = F.coalesce(rule.fails(text, words), F.lit(False))
        chain = F.when(fails, F.lit(rule.name)).otherwise(chain)
    return chain


def judged(order: Sequence[Rule], text: Column) -> Column:
    """``rejection`` with the words split once.

    The words are bound inside the expression: were they a column of their own,
    a filter on the verdict would be pushed below it and split the text again
    for every mention.
    """
    return let(words_of(text), lambda words: rejection(order, text, words))


def apply_cascade(
    df: DataFrame,
    rules: Sequence[Rule] = BASE_RULES + VERDICT_RULES,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``df`` with ``rejected_by``: the first rule of the measured order that fails, or null.

    Runs the sampling jobs. Which rule is named may differ between runs when a
    document fails several; whether one is named does not.
    """
    order = cascade_order(rules, rule_statistics(df, rules, text, sample_rows))
    return df.withColumn("rejected_by", judged(order, F.col(f"`{text}`")))


def assess(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts, the base rule and the cascade's verdict of every document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept``. The base counts are results, so they
    are computed for all documents; the cascade of the verdict runs only for
    those that pass the base rule.
    """
    source = df.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    order = cascade_order(
        VERDICT_RULES, rule_statistics(source, VERDICT_RULES, "text", sample_rows)
    )
    text, words = F.col("text"), F.col("words")
    lines = lines_with_words(text)
    counted = (
        source.withColumn("words", words_of(text))
        .withColumn("windows", window_hashes(words))
        .withColumn("lines", lines)
        .select(
            "doc_id",
            "text",
            "words",
            F.size("words").cast("long").alias("n_words"),
            word_chars(words).alias("word_chars"),
            count_of(text, SYMBOLS).alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("windows")).alias("n_repeat_words"),
        )
    )
    base_failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    judged = counted.withColumn("base_failed", base_failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(
        rejection(order, text, words).isNull()
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"),
    )


def keep_good(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``df`` that no rule rejects, with the columns of ``df``."""
    rules = BASE_RULES + VERDICT_RULES
    order = cascade_order(rules, rule_statistics(df, rules, "text", sample_rows))
    return df.filter(judged(order, F.col("text")).isNull())
