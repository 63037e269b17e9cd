"""Held-out accuracy, the backoff by hand, and the quality rules in plain Python."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersieve.llm import langid, quality
from papersieve.llm.common import words_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, langid.fit(df)


def test_held_out_accuracy(spark, fitted):
    df, model = fitted
    out = {r.doc_id: r for r in langid.predict(df, model).collect()}
    truth = {r.doc_id: r for r in df.collect()}
    assert set(out) == set(truth)
    right = total = 0
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0.0 <= r.score <= 1.0
        if r.held_out and len(truth[i].text.split()) >= 5:
            total += 1
            right += r.lang_pred == truth[i].lang
    assert total > 150 and right >= 0.97 * total


def test_only_text_and_training_labels_matter(spark, fitted):
    df, model = fitted
    mine = df.limit(40)
    scrambled = mine.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    one = {r.doc_id: tuple(r) for r in langid.predict(mine, model).collect()}
    assert {r.doc_id: tuple(r) for r in langid.predict(scrambled, model).collect()} == one
    hidden = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in langid.fit(hidden).languages


def test_backoff():
    sizes = {0: {"le": 0}, 5: {" chat": 0}, 4: {}, 3: {"cha": 0, "hie": 1}, 2: {}, 1: {"q": 0}}
    tables = {k: np.array([[-1.0 - k, -2.0 - k]] * max(1, len(v))) for k, v in sizes.items()}
    tables[3][1] = [-9.0, -1.0]
    model = langid.Model(("a", "b"), sizes, tables)
    assert model.score_word("le").tolist() == [-1.0, -2.0]
    assert model.score_word("chat").tolist() == [-6.0, -7.0]
    assert model.score_word("chaîhie").tolist() == [(-4.0 - 9.0) / 2, (-5.0 - 1.0) / 2]
    assert model.score_word("qqq").tolist() == [-2.0, -3.0]
    assert model.score_word("zzz") is None


def plain_prediction(model, text):
    """The method without memo, arrays or batches."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return "und", 0.0
    total = [0.0] * len(model.languages)
    for w in words:
        if w in model.rows[0]:
            scores = [model.tables[0][model.rows[0][w]]]
        else:
            scores = []
            for size in (5, 4, 3, 2, 1):
                padded = w if size == 1 else f" {w} "
                parts = [padded[i : i + size] for i in range(max(0, len(padded) - size + 1))]
                scores = [model.tables[size][model.rows[size][p]] for p in parts if p in model.rows[size]]
                if scores:
                    break
            scores = scores or [[langid.PENALTY] * len(total)]
        for k in range(len(total)):
            total[k] += sum(s[k] for s in scores) / len(scores)
    mean = [t / len(words) for t in total]
    best = max(range(len(mean)), key=lambda k: (mean[k], -k))
    return model.languages[best], 1 / sum(10 ** (m - mean[best]) for m in mean)


def test_predictions_match_a_plain_version(spark, fitted):
    _, model = fitted
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in langid.predict(small, model).collect():
        lang, score = plain_prediction(model, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("text", ["\u00bd \u00b2", "\u2167", "\u2460 \u0967 7 _", "!?"])
def test_numbers_are_no_letters(spark, fitted, text):
    _, model = fitted
    df = spark.createDataFrame([(1, text), (2, text + " the")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en"
    assert [r.doc_id for r in langid.keep_identified(df, model).collect()] == [2]


def test_kept_rows_have_all_columns_and_the_prediction(spark, fitted):
    df, model = fitted
    rows = df.withColumns({"Score": F.lit(3), "lang_pred": F.array(F.lit("x"))}).limit(200)
    want = {r.doc_id: r.lang_pred for r in langid.predict(rows, model).collect()}
    kept = langid.keep_identified(rows, model)
    assert kept.columns == rows.columns and "ArrowEvalPython" not in kept._jdf.queryExecution().toString()
    assert {r.doc_id: r.lang for r in kept.collect()} == {i: x for i, x in want.items() if x != "und"}


def test_language_edges(spark, fitted):
    _, model = fitted
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "漢字"), (5, "the and of " * 40_000), (5, "the and of"), (None, "le la de")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = [tuple(r) for r in langid.predict(df, model).collect()]
    assert [r[2] for r in out[:3]] == ["und"] * 3 and all(r[3] == 0 for r in out[:3])
    assert out[3][2] in model.languages and out[4][2] == out[5][2] == "en"
    assert out[6][1] is False
    assert langid.predict(df.limit(0), model).collect() == []
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    nothing = langid.fit(unlabelled)
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    kept = langid.keep_identified(unlabelled.drop("score"), nothing)
    assert kept.count() == 4
    assert langid.keep_identified(unlabelled, model).count() == 4


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    base_failed = n < 10 or 100 * len(covered) > 20 * n
    chars = sum(map(len, words))
    bad = (
        100 * symbols > 10 * n
        or 100 * len(re.findall("[A-Z]", text)) > 50 * len(re.findall("[A-Za-z]", text))
        or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        or 100 * text.count("!") > 30 * n
        or not 2 * n <= chars <= 30 * n
    )
    return (n, chars, symbols, len(lines) - len(set(lines)), len(covered), base_failed, not (base_failed or bad))


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h i j", "a b c d e " * 9, "x\n\nx\n x\ny\r\nx",
    "# * $ % & | < > word " * 3, "LOUD WORDS EVERYWHERE IN THIS TEXT OF TEN OR MORE WORDS!!",
    "漢字 é ü 🎉 " * 5, " lead and trail ", "a a a a a a b a a a a a", "w " * 20_000,
    " ".join(f"w{i}" for i in range(5_000)), "a b c d e x a b c d e y b c d e x\x0bz",
    "same line of words here\n" * 30 + " ".join(f"q{i}" for i in range(40)),
]


def test_quality_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8]), (3, "one"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1))
    got = sorted((tuple(r) for r in quality.assess(df).collect()), key=repr)
    assert got == sorted(((i, *plain_quality(t)) for i, t in rows), key=repr)
    assert quality.assess(df.limit(0)).collect() == []
    kept = sorted(r.doc_id for r in quality.keep_good(df.filter("doc_id is not null")).collect())
    assert kept == [i for i, t in rows if i is not None and plain_quality(t)[-1]]


def test_order_follows_rejection_per_cost_and_not_the_verdict(spark):
    rules = quality.VERDICT_RULES
    stats = [(r.name, 0.1, 0.0) for r in rules]
    stats[2] = (rules[2].name, 0.1, 0.5)
    stats[4] = (rules[4].name, 0.01, 0.5)
    order = quality.cascade_order(rules, stats)
    assert [r.name for r in order[:2]] == [rules[4].name, rules[2].name]
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    text, words = F.col("text"), words_of(F.col("text"))
    marks = df.select(
        *[
            quality.rejection(o, text, words).isNull().alias(f"k{i}")
            for i, o in enumerate((rules, order, rules[::-1]))
        ]
    ).collect()
    assert all(r.k0 == r.k1 == r.k2 for r in marks)
    measured = quality.rule_statistics(df, rules)
    assert all(cost > 0 and 0 <= share <= 1 for _, cost, share in measured)
