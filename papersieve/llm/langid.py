"""Language identification by words first, backing off to character n-grams.

A word that the training texts contain is scored by its log frequency in each
language. A word they do not contain is scored by the mean over its n-grams of
the longest size of which any n-gram is known, going down from five characters
to one. A document's score in a language is the mean over its words; the best
mean wins, ties go to the alphabetically first language.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_PER_LANG``
per language, drawn by a hash of the id) and keeps the ``VOCABULARY`` most
frequent entries of each size and language, so its size has a bound whatever the
corpus; it is the only thing broadcast. Of more than ``MOST_LANGUAGES`` languages
the rarest are not learned, and their texts go to the nearest one. Prediction reads every whole text and
uses nothing but the text.

Edge cases: a null text, or one without a letter, gets ``und`` with score 0; so
does every text when nothing labelled was there to learn from. A null id is
never learned from and counts as not held out. Repeated rows get equal
predictions. Extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve.llm.common import written

UNDETERMINED = "und"
NGRAM_SIZES = (5, 4, 3, 2, 1)
# Bounds of the fitted model.
SAMPLE_PER_LANG = 1_500
VOCABULARY = 20_000
MOST_LANGUAGES = 256
# What an entry costs, in decimal logarithms, in a language that lacks it.
PENALTY = -7.0
HOLD_OUT_PARTS, HELD_OUT_PART = 4, 2
MEMO_WORDS = 300_000
# A "word" longer than this is no word of any language: it is scored by n-grams without the memo.
MEMO_CHARS = 64
# Word characters that are numbers without being decimal digits, such as a half or a Roman eight.
_NUMBERS = "".join(
    c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()
)
# Sets within the first plane are looked up in a map, further planes range by range.
_ODD = re.compile(f"[{''.join(c for c in _NUMBERS if ord(c) <= 0xFFFF)}]")
_FAR_ODD = re.compile(f"[{''.join(c for c in _NUMBERS if ord(c) > 0xFFFF)}]")
_FAR = re.compile("[\U00010000-\U0010ffff]")
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 4, is 2."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT_PARTS
    return F.coalesce(part == HELD_OUT_PART, F.lit(False))


def words_in(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    if not text.isascii():
        if _ODD.search(text):
            text = _ODD.sub(" ", text)
        if _FAR.search(text):
            text = _FAR_ODD.sub(" ", text)
    return _LETTERS.findall(text.lower())


def grams(word: str, size: int) -> list[str]:
    """n-grams of a word between blanks that mark its ends."""
    padded = f" {word} "
    if size == 1:
        return list(word)
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


@dataclass(frozen=True)
class Model:
    """``rows[size][entry]`` is the entry's row in ``table[size]``; size 0 holds words."""

    languages: tuple[str, ...]
    rows: dict[int, dict[str, int]]
    tables: dict[int, np.ndarray]

    def score_word(self, word: str) -> np.ndarray | None:
        row = self.rows[0].get(word)
        if row is not None:
            return self.tables[0][row]
        for size in NGRAM_SIZES:
            known = self.rows[size]
            found = [known[g] for g in grams(word, size) if g in known]
            if found:
                return self.tables[size][found].mean(axis=0)
        return None


def training_rows(
    df: DataFrame, per_language: int = SAMPLE_PER_LANG, most_languages: int = MOST_LANGUAGES
) -> DataFrame:
    """``(lang, text)`` of about ``per_language`` labelled rows of each language.

    Only the ``most_languages`` languages with most rows are learned.

    Rows are kept by a hash of their id below a share that each language's own
    count sets, so no text is shuffled or sorted for the draw. Runs one action
    that counts rows per language.
    """
    labelled = df.select(
        F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text")
    ).filter(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & F.col("doc_id").isNotNull()
        & ~held_out(F.col("doc_id"))
    )
    counts = (
        labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    )
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in counts.collect()}
    if not share:
        return labelled.select("lang", "text").limit(0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv])
    return labelled.filter(draw < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))).select(
        "lang", "text"
    )


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.string()),
                pa.array([counts[k] for k in keys], pa.int64()),
            ],
            names=["lang", "size", "entry", "n"],
        )
        counts.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(words_in(text)).items():
                counts[lang, 0, word] += n
                for size in NGRAM_SIZES:
                    for g in grams(word, size):
                        counts[lang, size, g] += n
            if len(counts) > 400_000:
                yield flush()
    yield flush()


def fit(
    df: DataFrame,
    per_language: int = SAMPLE_PER_LANG,
    vocabulary: int = VOCABULARY,
    most_languages: int = MOST_LANGUAGES,
) -> Model:
    """Learn the model from ``lang`` and ``text``. Collects at most
    ``most_languages * 6 * vocabulary`` entries, in practice those of the sample."""
    counted = training_rows(df, per_language, most_languages).mapInArrow(
        _entry_counts, "lang string, size int, entry string, n long"
    )
    totals = written(counted.groupBy("lang", "size", "entry").agg(F.sum("n").alias("n")), "lang-entries")
    by_size = Window.partitionBy("lang", "size")
    top = totals.withColumn(
        "rank", F.row_number().over(by_size.orderBy(F.desc("n"), "entry"))
    ).filter(F.col("rank") <= vocabulary)
    sums = {
        (r["lang"], r["size"]): r["n"]
        for r in totals.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()
    }
    learned = top.select("lang", "size", "entry", "n").toArrow()
    languages = tuple(sorted({k[0] for k in sums}))
    number = {x: i for i, x in enumerate(languages)}
    rows: dict[int, dict[str, int]] = {s: {} for s in (0, *NGRAM_SIZES)}
    found: dict[int, list[tuple[int, int, float]]] = {s: [] for s in rows}
    for lang, size, entry, n in zip(*(learned.column(c).to_pylist() for c in range(4))):
        row = rows[size].setdefault(entry, len(rows[size]))
        found[size].append((row, number[lang], math.log10(n / sums[lang, size])))
    tables = {}
    for size, items in found.items():
        tables[size] = np.full((len(rows[size]), len(languages)), PENALTY)
        if items:
            r, c, v = zip(*items)
            tables[size][list(r), list(c)] = v
    return Model(languages, rows, tables)


class Scorer:
    """Scores texts with a bounded memo of words."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, int] = {}
        self.scores = np.empty((MEMO_WORDS, max(1, len(model.languages))))

    def _row(self, word: str) -> np.ndarray:
        score = self.model.score_word(word)
        # Letters of a script no training text has say nothing about any language.
        return np.full(len(self.model.languages), PENALTY) if score is None else score

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_in(text) if text else []
        languages = self.model.languages
        if not words or not languages:
            return UNDETERMINED, 0.0
        counts = Counter(words)
        memo, extra, extra_n = self.memo, np.zeros(len(languages)), 0
        if len(memo) + len(counts) > MEMO_WORDS:
            memo.clear()
        rows, weights = [], []
        for word, n in counts.items():
            at = memo.get(word)
            if at is None:
                score = self._row(word)
                if len(word) > MEMO_CHARS or len(memo) >= MEMO_WORDS:
                    extra += n * score
                    extra_n += n
                    continue
                at = memo[word] = len(memo)
                self.scores[at] = score
            rows.append(at)
            weights.append(n)
        total = extra
        if rows:
            total = extra + np.asarray(weights, dtype=float) @ self.scores[rows]
        mean = total / len(words)
        best = int(np.argmax(mean))
        share = 1.0 / float(np.sum(10.0 ** (mean - mean[best])))
        return languages[best], share


def _broadcast(df: DataFrame, model: Model):
    """Plain values only: executors need no copy of this package to load them."""
    return df.sparkSession.sparkContext.broadcast((model.languages, model.rows, model.tables))


def predict(df: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; ``score`` is the winner's
    share when each language's mean word score is read as a likelihood."""
    shared = _broadcast(df, model)

    def run(batches):
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model) -> DataFrame:
    """Rows whose text has a language, with ``lang`` set to the prediction.

    Rows without any letter go. All columns of ``df`` stay. When the model
    learned no language, rows with a letter stay as they are.
    """
    if not model.languages:
        return df.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    shared = _broadcast(df, model)
    typed = df.withColumn("lang", F.lit("").cast("string"))
    text_at, lang_at = (
        next(i for i, c in enumerate(typed.columns) if c.lower() == name) for name in ("text", "lang")
    )

    def run(batches):
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            found = [scorer.predict(t)[0] for t in batch.column(text_at).to_pylist()]
            kept = pa.array([x != UNDETERMINED for x in found], pa.bool_())
            columns = list(batch.columns)
            columns[lang_at] = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(kept)

    return typed.mapInArrow(run, typed.schema)
