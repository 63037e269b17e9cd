from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.operators import gate, history, ordered, scoring
from papersieve.operators.rules import Rule, register, registered_rules, unregister

SCHEMA = "doc_id string, rule_ord int, ord int, code string, title string, severity string, weight int"


def python_score(items):
    if not items:
        return 0
    surviving = 1.0
    for weight, _ in items:
        surviving *= 1.0 - min(weight, 99) / 100.0
    score = (1.0 - surviving) * 100.0
    levels = {s for _, s in items}
    if "critical" in levels:
        score = max(score, 75)
    elif "high" in levels:
        score = max(score, 45)
    if len(items) == 1:
        score = min(score, 79.0)
    return round(max(0.0, min(100.0, score)))


def test_scores_equal_the_definition(spark):
    pool = [(0, "info"), (15, "low"), (25, "medium"), (30, "medium"), (55, "high"), (60, "high"), (85, "critical")]
    cases = [c for n in (1, 2, 3) for c in itertools.product(pool, repeat=n)]
    rows = [
        (str(i), j, 0, f"C{j}", "t", sev, w) for i, case in enumerate(cases) for j, (w, sev) in enumerate(case)
    ]
    got = {
        int(r.doc_id): r.score
        for r in scoring.outcomes(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "score").collect()
    }
    assert all(got[i] == python_score(case) for i, case in enumerate(cases))


@pytest.mark.parametrize(
    ("score", "verdict"),
    [(0, "clean"), (19, "clean"), (20, "low_risk"), (49, "low_risk"), (50, "suspicious"),
     (79, "suspicious"), (80, "malicious"), (100, "malicious")],
)
def test_bands(spark, score, verdict):
    assert spark.range(1).select(scoring.verdict_of(F.lit(score))).first()[0] == verdict


def test_repeated_code_counts_once_first_wins(spark):
    rows = [("d", 2, 0, "A", "late", "low", 15), ("d", 1, 0, "A", "early", "high", 55), ("d", 1, 1, "A", "x", "low", 1)]
    kept = scoring.first_per_code(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.title, r.weight) for r in kept] == [("early", 55)]


def test_zero_weight_indicator_lifts_the_sole_ceiling(spark):
    alone = [("a", 1, 0, "L", "t", "critical", 85)]
    pair = [("b", 1, 0, "L", "t", "critical", 85), ("b", 2, 0, "X", "t", "info", 0)]
    got = {r.doc_id: r.score for r in scoring.outcomes(spark.createDataFrame(alone + pair, SCHEMA)).collect()}
    assert got == {"a": 79, "b": 85}


def test_documents_without_indicators_are_clean(spark):
    docs = spark.createDataFrame([("none",)], "doc_id string")
    row = scoring.outcomes(spark.createDataFrame([], SCHEMA), docs).first()
    assert (row.score, row.verdict, row.is_conclusive_clean, row.max_severity) == (0, "clean", True, "info")


def test_rationale_is_heaviest_first(spark):
    rows = [("d", 1, 0, "A", "a", "low", 15), ("d", 2, 0, "B", "b", "high", 60)]
    lines = scoring.outcomes(spark.createDataFrame(rows, SCHEMA)).first().rationale
    assert lines == ["[HIGH|w=60] B: b", "[LOW|w=15] A: a"]


def test_all_blends_match_half_even_rounding(spark):
    grid = spark.range(101).select(F.col("id").cast("int").alias("ai")).withColumn(
        "h", F.explode(F.sequence(F.lit(0), F.lit(100)))
    )
    rows = grid.select("ai", "h", gate.blend(F.col("ai"), F.col("h"), F.lit(False)).alias("b")).collect()
    assert all(r.b == round(0.6 * r.ai + (1 - 0.6) * r.h) for r in rows)


@pytest.mark.parametrize(
    ("label", "reported", "used"),
    [("malicious", 10, 80), ("clean", 95, 19), ("suspicious", 65, 65), ("unknown", 7, 7)],
)
def test_reconcile(spark, label, reported, used):
    got = spark.range(1).select(gate.reconcile_score(F.lit(label), F.lit(reported))).first()[0]
    assert got == used


def test_static_confidence_matches(spark):
    rows = spark.range(101).select("id", gate.static_confidence(F.col("id")).alias("c")).collect()
    assert all(r.c == round(0.5 + 0.4 * abs(r.id - 50) / 50, 3) for r in rows)


def test_rule_order_and_registration():
    codes = [r.code for r in registered_rules()]
    assert len(codes) == 22 and codes[0] == "PDF_JS_PRESENT" and codes[-1].startswith("PDF_MINIMAL")
    extra = Rule("X", "x", "structure", lambda: F.lit(True), "low", 1, "site")
    register(extra)
    assert registered_rules()[-1] is extra
    unregister("X")
    with pytest.raises(ValueError):
        register(Rule("Y", "y", "nowhere", lambda: F.lit(True), "low", 1, "site"))


def test_pinned_weights():
    fixed = {r.code: r.weight for r in registered_rules() if not callable(r.weight)}
    assert (fixed["PDF_JS_PRESENT"], fixed["PDF_JS_AUTO_EXEC"]) == (30, 55)
    assert fixed["PDF_MINIMAL_DOC_WITH_ACTIVE_CONTENT"] == 50
    assert fixed["PDF_XFA_FORM"] == fixed["PDF_NAME_OBFUSCATION"] == fixed["PDF_MANY_INCREMENTAL_UPDATES"] == 0
    assert K.SOLE_INDICATOR_CEILING == 79


@pytest.mark.parametrize("few", [3, 100_000])
@pytest.mark.parametrize("keep", [1, 7, 60, 119, 120, 121, 500])
def test_cutoff_by_histograms(spark, monkeypatch, few, keep):
    monkeypatch.setattr(history, "CUTOFF_ROWS", few)
    monkeypatch.setattr(history, "CUTOFF_BUCKETS", 5)
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(seconds=(i * i) % 97, microseconds=i % 3) for i in range(120)]
    rows = spark.createDataFrame(
        [(i, t, i % 9 == 0) for i, t in enumerate(times)], "scan_id int, created_at timestamp, quarantined boolean"
    )
    cutoff = sorted(times, reverse=True)[keep - 1] if keep <= 120 else None
    want = {i for i, t in enumerate(times) if cutoff is None or t >= cutoff or i % 9 == 0}
    assert {r.scan_id for r in history.pruned(rows, keep).collect()} == want


def test_next_row_across_slices(spark):
    rows = [(k, t, f"{k}-{t}" if t % 4 else None) for k, n in (("a", 200), ("b", 1), ("c", 30)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    got = ordered.following(df, F.col("v"), ["t"], ["k"], "after", slices=7).collect()
    value = {(k, t): v for k, t, v in rows}
    assert len(got) == len(rows)
    assert all(r.after == value.get((r.k, r.t + 1)) for r in got)
