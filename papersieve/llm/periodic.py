"""Periodic runs of words, caught online by dyadic squares.

A run is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends, at least ``max(LEAST_WORDS, 2 * q)`` words long. A
:class:`RunCatcher` reads a text word by word and holds, at every moment, the
runs of what it has read:

* Each completed block of ``2**k`` words, aligned at a multiple of its length,
  gets a name made of the names of its halves, and becomes a *catcher*: for
  shifts from ``2 * 2**k - 1`` to ``4 * 2**k - 2`` (the smallest blocks also for
  all smaller shifts) it waits for the last ``2**k`` words read to bear its
  name. Any stretch that equals its own shift over that many words contains an
  aligned block of the matching length whole, so no run escapes.
* A caught block starts a *suffix comparison* for its shift: how far the words
  before the block equal those one shift later is looked up at once; forwards
  the comparison is advanced by the words appended next. It is looked at again
  when it could first make a square, and dropped if the words did not hold.
* A comparison as long as its shift is a square. It becomes a live run, advanced
  with each word until one differs, and squares of the same shift that overlap
  are one run. Of runs with equal ends only the smallest period stays; the
  others are its multiples.

Two catchers of a level watch each word, whatever the text, and a name is looked
up only while shorter ones were found, so a text of ``n`` words costs
``O(n log n)`` name look-ups and most words cost one. A block inside a live run whose shift is a
multiple of the run's period is no news and starts nothing. A text's words are
numbered within the text; memory is proportional to the longest text alone.

Edge cases: a null text has no words, so no runs and an empty collapsed text.
Texts without a word likewise. A null id is kept and means a text without
planted repetition in :func:`planted`. Repeated rows give repeated results, an
empty table none. Columns besides the two named ones play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 12
# Words of the smallest blocks. A stretch of three words contains one, and runs of
# five words or more leave such a stretch for every shift.
_SMALLEST = 2
_BASE = 1 << 32
# Rows a result batch holds at most in bytes of text before it is handed on.
_BATCH_BYTES = 8 << 20


class RunCatcher:
    """Runs of a growing sequence of words, each given as its UTF-8 bytes."""

    def __init__(self, least_words: int = LEAST_WORDS):
        if least_words < 5:
            raise ValueError("runs of fewer than 5 words can hide between the smallest blocks")
        self.least = least_words
        self.numbers: dict[bytes, int] = {}
        self.words: list[int] = []
        self._raw = bytearray()
        # Per level: name by the names of the halves, and the aligned blocks' names in order.
        # Windows not aligned are remembered sparsely, by where they end.
        self._names: list[dict[int, int]] = [{}]
        self._blocks: list[list[int]] = [[]]
        self._windows: list[dict[int, int]] = [{}]
        self._waiting: dict[int, tuple[int, int]] = {}  # shift: start, words known to hold up to
        self._due: dict[int, list[int]] = {}  # word number: shifts to look at again
        self._live: dict[int, int] = {}  # period: start
        self._found: dict[tuple[int, int], int] = {}  # (start, end): smallest period

    # -- equality of stretches ------------------------------------------------------

    def _same(self, a: int, b: int, n: int) -> bool:
        raw = self._raw
        return raw[4 * a : 4 * (a + n)] == raw[4 * b : 4 * (b + n)]

    def _back(self, a: int, b: int) -> int:
        """Number of equal words before positions ``a < b``, going back."""
        words = self.words
        got, most = 0, a
        while got < most and got < 8:
            if words[a - got - 1] != words[b - got - 1]:
                return got
            got += 1
        step = 16
        while got < most:
            step = min(step, most - got)
            if self._same(a - got - step, b - got - step, step):
                got += step
                step *= 2
            elif step == 1:
                return got
            else:
                step //= 2
                most = min(most, got + 2 * step)
        return got

    # -- squares and runs -----------------------------------------------------------

    def _catch(self, start: int, shift: int, size: int, at: int) -> None:
        """The ``size`` words ending at ``at`` equal those from ``start``, ``shift`` before."""
        for period, since in self._live.items():
            if since <= start and shift % period == 0:
                return
        known = self._waiting.get(shift)
        if known is not None:
            since, upto = known
            if self._same(upto - shift, upto, at + 1 - upto):
                self._waiting[shift] = since, at + 1
                return
        since = start - self._back(start, start + shift)
        held = at + 1 - shift - since
        need = max(shift, self.least - shift)
        if held >= need:
            self._waiting.pop(shift, None)
            self._live[shift] = since
        else:
            self._waiting[shift] = since, at + 1
            self._due.setdefault(at + need - held, []).append(shift)

    def _look_again(self, at: int) -> None:
        """Comparisons that make a square with the word ``at`` if they hold until there."""
        for shift in self._due.pop(at):
            known = self._waiting.get(shift)
            if known is None:
                continue
            since, upto = known
            if at + 1 - shift - since < max(shift, self.least - shift):
                continue  # replaced by a later comparison, which has its own date
            del self._waiting[shift]
            if self._same(upto - shift, upto, at + 1 - upto):
                self._live[shift] = since

    def _close(self, at: int) -> None:
        """End the live runs that the word ``at`` does not continue."""
        words, over = self.words, []
        for period in self._live:
            if words[at] != words[at - period]:
                over.append(period)
        for period in over:
            self._report(self._live.pop(period), at, period)

    def _report(self, start: int, end: int, period: int) -> None:
        key = (start, end)
        if period < self._found.get(key, period + 1):
            self._found[key] = period

    # -- names of blocks and windows ------------------------------------------------

    def extend(self, words: list[bytes]) -> None:
        """Append words in order."""
        numbers, ids = self.numbers, self.words
        fresh = [numbers.setdefault(w, len(numbers)) for w in words]
        first = len(ids)
        ids.extend(fresh)
        self._raw += np.asarray(fresh, dtype=np.uint32).tobytes()
        pairs, due, live, climb = self._names[0], self._due, self._live, self._climb
        before = ids[first - 1] if first else -1
        for at, word in enumerate(fresh, first):
            if live:
                self._close(at)
            if at:
                key = before * _BASE + word
                # A pair that no aligned pair has equalled ends no named block at any level.
                if at & 1 or key in pairs:
                    climb(at, key)
            if due and at in due:
                self._look_again(at)
            before = word

    def _climb(self, at: int, key: int) -> None:
        """Name the windows that end at ``at``, level by level, as far as names go."""
        end, size, level = at + 1, _SMALLEST, 0
        while True:
            names, blocks = self._names[level], self._blocks[level]
            aligned = end & (size - 1) == 0
            name = names.get(key)
            if name is None:
                if not aligned:
                    return
                name = names[key] = len(names)
            else:
                least = 2 * size - 1 if level else 1
                start = end - size
                low = max(0, -((4 * size - 2 - start) // size))
                for j in range(low, (start - least) // size + 1):
                    if blocks[j] == name:
                        self._catch(j * size, start - j * size, size, at)
            if aligned:
                blocks.append(name)
            self._windows[level][end] = name
            level += 1
            if level == len(self._names):
                if not aligned or end < 2 * size:
                    return
                self._names.append({})
                self._blocks.append([])
                self._windows.append({})
            left = self._windows[level - 1].get(end - size)
            if left is None:
                return
            key = left * _BASE + name
            size *= 2

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of every run so far, by start, then period."""
        found = dict(self._found)
        end = len(self.words)
        for period, start in self._live.items():
            if period < found.get((start, end), period + 1):
                found[start, end] = period
        return sorted((s, e - s, p) for (s, e), p in found.items())


def runs_of(words: list[bytes], least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """Runs of a whole text."""
    catcher = RunCatcher(least_words)
    catcher.extend(words)
    return catcher.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text with each run cut to its first period, words joined by blanks."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def repeat_planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a planted repetition: in a tenth of the documents, chosen by crc32
    of the id, the words from some place on go round in one period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle, tail = words[a : a + p], n - a
    return words[:a] + (cycle * (tail // p + 1))[:tail]


_RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(df: DataFrame, planted: bool = False, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``(doc_id, text)``.

    Row work alone: nothing is shuffled, and a lost executor's rows are read again.
    Results leave a task in batches of bounded bytes. ``planted`` first puts the
    documents through :func:`repeat_planted`.
    """

    def batch(ids, counts, runs, texts):
        starts = [0]
        for r in runs:
            starts.append(starts[-1] + len(r))
        flat = np.array([x for r in runs for x in r], dtype=np.int64).reshape(-1, 3)
        listed = pa.ListArray.from_arrays(
            pa.array(starts, pa.int32()),
            pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN)),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, runs, texts, held = [], [], [], [], 0
        for rows in batches:
            for i in range(rows.num_rows):
                doc_id, text = rows.column(0)[i].as_py(), rows.column(1)[i].as_py()
                words = text.split() if text else []
                if planted:
                    words = repeat_planted(doc_id, words)
                found = runs_of(words, least_words)
                ids.append(doc_id)
                counts.append(len(words))
                runs.append(found)
                texts.append(collapsed(words, found))
                held += len(texts[-1]) + 24 * len(found)
                if held > _BATCH_BYTES:
                    yield batch(ids, counts, runs, texts)
                    ids, counts, runs, texts, held = [], [], [], [], 0
        yield batch(ids, counts, runs, texts)

    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    ).mapInArrow(run, _RESULT)


def _decimal(value: Column) -> Column:
    return value.cast("string")


def digest(df: DataFrame) -> DataFrame:
    """Per document the longest run and digests of all runs and of the collapsed text."""
    found = find_runs(df, planted=True)
    run = F.col("top")
    # Greatest length first, then smallest start, then smallest period.
    top = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
            ),
        )
    )
    lines = F.array_join(
        F.transform(
            "runs",
            lambda r: F.concat(
                _decimal(r["start"]), F.lit(","), _decimal(r["length"]), F.lit(","), _decimal(r["period"]), F.lit("\n")
            ),
        ),
        "",
    )
    return found.select("doc_id", "runs", "collapsed", top.alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-run["start"]).alias("start"),
        run["length"].alias("length"),
        (-run["period"]).alias("period"),
        F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
