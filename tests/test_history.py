"""Changes to the history that carry long texts."""

from __future__ import annotations

import pytest

from papersieve import session
from papersieve.operators import history

SCANS = "scan_id bigint, status string, verdict string, error_message string, retry_count int"
FAILURES = "scan_id bigint, code string, message string, at timestamp"


@pytest.mark.parametrize("fits", [1 << 26, 10_000])
def test_failures_are_not_broadcast(spark, monkeypatch, fits):
    """Messages of a few compressed MB unpack to more than a broadcast holds."""
    monkeypatch.setattr(session, "TASK_BYTES", fits)
    scans = spark.createDataFrame([(i, "pending", "clean", "", i % 3) for i in range(300)] + [(None, "pending", "clean", "", 0)], SCANS)
    rows = [(i, "c" * 70 if i % 2 else "timeout", "boom " * 900, None) for i in range(0, 400, 4)]
    failures = spark.createDataFrame([*rows, (8, "again", None, None), (12, None, "x", None), (None, "c", "x", None)], FAILURES)
    updated, events = history.mark_failed(scans, failures)
    got = updated.collect()
    assert len(got) == 303 and sum(r.status == "failed" for r in got) == 76
    assert {len(r.error_message) for r in got if r.status == "failed" and r.error_message} == {4000}
    assert all(r.retry_count == r.scan_id % 3 + 1 for r in got if r.status == "failed")
    assert events.count() == 77
    for table in (updated, events):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    if fits < 1 << 20:
        # Some 450 KB of messages: what adaptive execution would put into one partition.
        assert session.dealt(failures, "scan_id").rdd.getNumPartitions() >= 45


def test_few_rows_are_not_dealt(spark):
    rows = spark.createDataFrame([(1, "a", None, None)], FAILURES)
    assert session.dealt(rows, "scan_id") is rows
    assert session.dealt(rows.limit(0), "scan_id").count() == 0
