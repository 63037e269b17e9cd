"""Compression classifier: held-out accuracy, and its parts on small texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from papersieve.llm import compression

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def model(spark):
    return compression.fit(read(spark, "documents"), read(spark, "labels"))


def test_held_out_accuracy(spark, model):
    rows = compression.score(read(spark, "documents"), model).collect()
    assert len(rows) == read(spark, "documents").count()
    for r in rows:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    truth = {r.doc_id: r.quality for r in read(spark, "labels").collect()}
    pairs = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in pairs]) >= 0.95
    assert np.mean([p == t for p, t in pairs if t == 0]) >= 0.7
    assert np.mean([p == t for p, t in pairs if t == 1]) >= 0.97


def test_held_out_labels_change_nothing(spark, model):
    from pyspark.sql import functions as F

    labels = read(spark, "labels")
    flipped = labels.withColumn(
        "quality",
        F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    assert compression.fit(read(spark, "documents"), flipped) == model


def test_other_columns_change_nothing(spark, model):
    from pyspark.sql import functions as F

    docs = read(spark, "documents").withColumns(
        {"lang": F.lit("xx"), "source": F.lit(None), "score": F.lit(7), "quality": F.lit(0)}
    )
    assert compression.fit(docs, read(spark, "labels")) == model
    a = compression.score(docs, model).select("doc_id", "score").collect()
    b = compression.score(read(spark, "documents"), model).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)


def test_sizes_cover_the_whole_text(model):
    compressors = compression.Compressors(model.dictionaries, model.trained)
    head = b"plain words of a text " * 200
    assert compressors.sizes(head + b"\x00\x7f*&^%" * 900)[0] > compressors.sizes(head)[0] + 40


def test_curve_is_calibrated():
    r = np.random.default_rng(3)
    x = r.normal(size=(20_000, 2))
    y = (r.random(20_000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.allclose(compression.fit_curve(x, y), [0.5, 2.0, -1.0], atol=0.1)


def test_edge_rows(spark, model):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (None, "Und Und Und"), (3, "x"), (3, "x"), (4, "Eine lange Zeile. " * 60_000)],
        "doc_id long, text string",
    )
    got = {}
    for r in compression.score(docs, model).collect():
        assert got.setdefault(r.doc_id, r.score) == r.score and 0 <= r.score <= 1
    assert got[1] == got[2] == model.share and len(got) == 5
    assert not compression.score(docs, model).filter("doc_id is null").first().held_out
    assert compression.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize(
    "rows, share",
    [([], 0.5), ([(1, None), (None, 1), (2, 7)], 0.5), ([(1, 1), (1, 1), (2, 1), (99, 1)], 0.75)],
)
def test_labels_of_one_class_or_none(spark, rows, share):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(1, 5)], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    learned = compression.fit(docs, labels)
    assert learned.dictionaries == {} and learned.share == pytest.approx(share)
    assert {r.score for r in compression.score(docs, learned).collect()} == {learned.share}


def test_sample_is_bounded(spark):
    n = compression.training_rows(read(spark, "documents"), read(spark, "labels"), per_class=20).count()
    assert 10 <= n <= 80
