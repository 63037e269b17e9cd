"""Registered queries against their SQL, and the pipeline's stages in a row."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))

import corpus_pipeline  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402

from papersieve.llm.catalog import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r for r in docs.collect()}
        assert 0.5 * len(before) < len(after) <= len(before) and set(after) <= set(before)
        if name != "suffix-array dedup":
            assert all(after[i].text == before[i].text for i in after)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    words = {i: len(r.text.encode().split()) for i, r in before.items()}
    total = dict.fromkeys(words, 0)
    for r in packed:
        total[r.doc_id] += r.length
    assert total == words
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in packed}


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "the and of is in to a that it was for on are with as", "en", "s", 52),
    (3, "the and of is in to a that it was for on are with as", "en", "s", 52),
    (None, "the house of the man is on the hill and it was for a time", None, None, 57),
    (None, "the house of the man is on the hill and it was for a time", None, None, 57),
    (4, "10 11 12 13 14 15 16 17 18 19 20 21", "en", "s", 35),
    (5, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9_000)), "en", "s", 1),
]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    learned = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1_000)
    docs = spark.createDataFrame(ODD, schema).unionByName(learned).withColumns(
        {"Score": F.lit(1), "node": F.lit("x"), "_rank": F.lit(2), "bin_id": F.lit(3)}
    )
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-odd")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept = docs.filter("doc_id IS NULL OR doc_id < 1000").collect()
        left.append(sorted((r.doc_id is not None, r.doc_id or 0) for r in kept))
    both = [(False, 0), (False, 0)]
    assert left[0] == [*both, (True, 3), (True, 3), (True, 4), (True, 5)]
    assert left[1] == [*both, (True, 3), (True, 3), (True, 5)]
    assert left[2] == left[3] == [*both, (True, 3), (True, 5)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    words = packed.filter("doc_id = 5").agg(F.sum("length")).first()[0]
    assert words == 9_000


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
