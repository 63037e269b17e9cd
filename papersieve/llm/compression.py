"""Quality by compression: which class's dictionary makes a text smaller.

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is compressed with each, piece by piece, so that the
dictionary counts throughout a long text and not just at its start. Two numbers
come out: the difference of the sizes, bad less good, over the larger of the two
(the normalised compressed-size difference), and the mean of both sizes over the
plain size, which tells how to read the first: of text that repeats itself,
either dictionary leaves next to nothing. A logistic curve over both, fitted on
labelled rows that no dictionary saw, turns them into the probability of label 1.

The model is fitted on at most about ``SAMPLE_PER_CLASS`` labelled rows of each
class, drawn by a hash of the id, half for the dictionaries (``PIECES_PER_TEXT``
pieces of ``PIECE_BYTES`` evenly spread over the text) and half for the curve.
That bounds the rows that reach the driver and the two dictionaries that go to
the executors, whatever the corpus. Scoring reads every whole text, row by row,
without a shuffle.

Edge cases: a null or empty text has no size to compare and gets the share of
label 1 among the rows of the curve. Without labelled rows of both classes every
text gets the smoothed share of label 1 (0.5 without any label). Labels other
than 0 and 1, null ids and labels of absent documents teach nothing; repeated rows
of one id and label count once, with the smallest text. A null id counts as not held out.
Repeated rows are scored alike, empty tables give no rows, other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the fitted model.
SAMPLE_PER_CLASS = 4_000
PIECES_PER_TEXT = 4
PIECE_BYTES = 2_048
DICTIONARY_BYTES = 112_640
LEVEL = 3
# Contract values.
HOLD_OUT_PARTS, HELD_OUT_PART = 5, 0
ACCEPT_FROM = 0.3
GOOD, BAD = 1, 0


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 5, is 0."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT_PARTS
    return F.coalesce(part == HELD_OUT_PART, F.lit(False))


@dataclass(frozen=True)
class Model:
    """``dictionaries`` by class, empty when one class was not there to learn from;
    ``curve`` is intercept, weight of the difference, weight of the ratio."""

    dictionaries: dict[int, bytes]
    trained: dict[int, bool]
    curve: tuple[float, float, float]
    share: float


class Compressors:
    """Both compressors of a model; one object per task."""

    def __init__(self, dictionaries: dict[int, bytes], trained: dict[int, bool]):
        self.by_class = {}
        for label, content in dictionaries.items():
            kind = zstandard.DICT_TYPE_FULLDICT if trained[label] else zstandard.DICT_TYPE_RAWCONTENT
            shared = zstandard.ZstdCompressionDict(content, dict_type=kind)
            shared.precompute_compress(level=LEVEL)
            self.by_class[label] = zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=shared,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )

    def sizes(self, text: bytes) -> tuple[int, int]:
        """Compressed bytes of the whole text with the good and with the bad dictionary."""
        good, bad = self.by_class[GOOD].compress, self.by_class[BAD].compress
        total_good = total_bad = 0
        for i in range(0, len(text), PIECE_BYTES):
            piece = text[i : i + PIECE_BYTES]
            total_good += len(good(piece))
            total_bad += len(bad(piece))
        return total_good, total_bad

    def features(self, text: bytes) -> tuple[float, float]:
        """Normalised size difference and mean compression ratio of a text that is not empty."""
        good, bad = self.sizes(text)
        return (bad - good) / max(bad, good), min(2.0, (bad + good) / 2 / len(text))


def _labelled(labels: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, quality)`` that may be learned from."""
    return (
        labels.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
        )
        .filter(F.col("quality").isin(GOOD, BAD) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .distinct()
    )


def training_rows(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``(doc_id, quality, for_curve, text)`` of about ``per_class`` rows of each class.

    Runs one action that counts labels per class. The drawn ids are broadcast:
    there are about two times ``per_class`` of them at most.
    """
    labelled = _labelled(labels)
    counts = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for label, count in sorted(counts.items()):
        share = F.when(F.col("quality") == label, F.lit(min(1.0, per_class / count))).otherwise(share)
    drawn = labelled.filter(draw < share)
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter(F.octet_length("text") > 0)
    return (
        texts.join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
        .withColumn("for_curve", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1)
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns)):
            starts = np.linspace(0, max(0, len(text) - PIECE_BYTES), PIECES_PER_TEXT).astype(int)
            for start in sorted(set(starts.tolist())):
                for column, value in zip(out, (doc_id, label, start, text[start : start + PIECE_BYTES])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
            names=["doc_id", "quality", "start", "piece"],
        )


def build_dictionary(pieces: list[bytes]) -> tuple[bytes, bool]:
    """Dictionary of sample pieces and whether it is a trained one; with too few
    samples to train on, the samples themselves are the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:], False


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Intercept and weights of a logistic curve, by Newton's method with a small ridge."""
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - centre) / scale])
    penalty = np.diag([0.0] + [ridge] * features.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty + np.eye(len(w)) * 1e-9
        step = np.linalg.solve(hessian, x.T @ (labels - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    weights = w[1:] / scale
    return np.concatenate([[w[0] - weights @ centre], weights])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn dictionaries and curve. Collects at most about ``per_class *
    PIECES_PER_TEXT * PIECE_BYTES`` bytes of pieces and ``per_class`` pairs of numbers."""
    rows = training_rows(documents, labels, per_class)
    found = (
        rows.filter(~F.col("for_curve"))
        .select("doc_id", "quality", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_pieces, "doc_id long, quality int, start long, piece binary")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("start", "ascending"), ("quality", "ascending")])
    )
    dictionaries, trained = {}, {}
    for label in (GOOD, BAD):
        pieces = [
            piece
            for q, piece in zip(found.column("quality").to_pylist(), found.column("piece").to_pylist())
            if q == label
        ]
        if pieces:
            dictionaries[label], trained[label] = build_dictionary(pieces)
    curve_rows = rows.filter("for_curve")
    if len(dictionaries) == 2:

        def measure(batches):
            compressors = Compressors(dictionaries, trained)
            for batch in batches:
                pairs = [compressors.features(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])],
                    names=["quality", "difference", "ratio"],
                )

        measured = (
            curve_rows.select("quality", F.col("text").cast("binary").alias("text"))
            .mapInArrow(measure, "quality int, difference double, ratio double")
            .toArrow()
            # Sums of floats depend on their order: a stable order makes the fit repeatable.
            .sort_by([("quality", "ascending"), ("difference", "ascending"), ("ratio", "ascending")])
        )
        y = np.array(measured.column("quality").to_pylist(), dtype=float)
        share = float((y.sum() + 1) / (len(y) + 2))
        if 0 < y.sum() < len(y):
            x = np.column_stack([measured.column(c).to_numpy() for c in ("difference", "ratio")])
            return Model(dictionaries, trained, tuple(fit_curve(x, y)), share)
        return Model({}, {}, (0.0, 0.0, 0.0), share)
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    return Model({}, {}, (0.0, 0.0, 0.0), float((good + 1) / (n + 2)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, size_difference, ratio`` of every row.

    The last two are what the score is made of; they are null where the text is
    empty or the model has no dictionaries.
    """
    shared = documents.sparkSession.sparkContext.broadcast(
        (model.dictionaries, model.trained, model.curve, model.share)
    )

    def run(batches):
        dictionaries, trained, (intercept, by_difference, by_ratio), share = shared.value
        compressors = Compressors(dictionaries, trained) if dictionaries else None
        for batch in batches:
            scores, differences, ratios = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                if not text or compressors is None:
                    difference = ratio = None
                    scores.append(share)
                else:
                    difference, ratio = compressors.features(text)
                    z = intercept + by_difference * difference + by_ratio * ratio
                    scores.append(float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))))
                differences.append(difference)
                ratios.append(ratio)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= ACCEPT_FROM) for s in scores], pa.int32()),
                    pa.array(differences, pa.float64()),
                    pa.array(ratios, pa.float64()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "size_difference", "ratio"],
            )

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").cast("binary").alias("text"),
    ).mapInArrow(
        run,
        "doc_id long, held_out boolean, score double, predicted int, size_difference double, ratio double",
    )
