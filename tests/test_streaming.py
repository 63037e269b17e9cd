from __future__ import annotations

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from papersieve.catalog.streams import run_once, stream_of
from papersieve.operators.gate import GateSettings
from papersieve.sources.store import APPENDED, REPLACED, Batch, ResultStore
from papersieve.streaming import settle
from papersieve.streaming.counters import WindowCounters, keep_updates
from papersieve.streaming.ingest import Ingest

START = dt.datetime(2024, 1, 1)


def listing(spark, tmp_path, rows):
    """Each observation time becomes one micro-batch file."""
    schema = "path string, size bigint, observed_at timestamp"
    folder = str(tmp_path / "listing")
    for at in sorted({r[2] for r in rows}):
        batch = [(p, s, START + dt.timedelta(seconds=t)) for p, s, t in rows if t == at]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def seen(result):
    return sorted((r.path, (r.observed_at - START).seconds) for r in result.collect())


def test_settle_rules(spark, tmp_path):
    rows = [("a", 5, 0), ("a", 5, 15), ("a", 5, 30), ("a", 5, 45),
            ("b", 0, 0), ("b", 0, 15), ("b", 0, 130), ("c", 1, 0), ("c", 2, 15), ("c", 2, 30)]
    assert seen(run_once(settle.settled_files(listing(spark, tmp_path, rows)))) == [("a", 30), ("b", 130)]


def test_forget_arms_a_path_again(spark, tmp_path):
    rows = [("a", 5, 0), ("a", 5, 15), ("a", 5, 30), ("a", settle.FORGET, 45),
            ("a", 5, 60), ("a", 5, 75), ("a", 5, 90)]
    assert seen(run_once(settle.settled_files(listing(spark, tmp_path, rows)))) == [("a", 30), ("a", 90)]


def test_ingest_is_idempotent_and_deduplicates(spark, tmp_path):
    from documents import ALL

    rows = [
        ("/in/a.pdf", ALL["program_start"]), ("/in/copy.pdf", ALL["program_start"]),
        ("/in/b.pdf", ALL["report"]), ("/in/c.pdf", b"not a document"),
    ]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").withColumns(
        {"length": F.octet_length("content").cast("bigint"), "observed_at": F.lit("2024-01-01").cast("timestamp")}
    )
    root = str(tmp_path / "store")
    ingest = Ingest(root, GateSettings(enabled=False))
    ingest(files, 0)
    ingest(files, 0)
    ingest(files.where("path = '/in/copy.pdf'"), 1)
    store = ResultStore(spark, root)
    scans = {r.filename: r for r in store.latest("scans").collect()}
    assert set(scans) == {"a.pdf", "b.pdf"}
    assert scans["a.pdf"].status == "quarantined" and scans["b.pdf"].verdict == "clean"
    events = store.rows("events")
    kinds = {(r.batch, r.kind): r.n for r in events.groupBy("batch", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds[(0, "completed")] == 2 and kinds[(0, "rejected")] == 1 and kinds[(0, "duplicate")] == 1
    assert kinds == {**kinds, (1, "duplicate"): 1} and (1, "completed") not in kinds
    sections = {(r.scan_id, r.section) for r in store.latest("reports").collect()}
    assert {i for i, name in sections if name == "structure"} == {r.scan_id for r in scans.values()}
    assert {name for i, name in sections if i == scans["a.pdf"].scan_id} >= {"structure", "action"}
    assert store.latest("indicators").count() > 0 and store.rows("assessments").count() == 0
    # Both attempts at batch 0 are on disk; the first one is no longer named.
    assert len(store.forgotten()) == 5 and store.vacuum() == 5 and store.forgotten() == []
    assert {r.filename for r in store.latest("scans").collect()} == set(scans)


def test_ingest_that_ends_midway_shows_nothing(spark, tmp_path, monkeypatch):
    from documents import ALL

    files = spark.createDataFrame(
        [("/in/a.pdf", bytearray(ALL["program_start"]))], "path string, content binary"
    ).withColumns(
        {"length": F.octet_length("content").cast("bigint"), "observed_at": F.lit("2024-01-01").cast("timestamp")}
    )
    calls = (
        "SELECT doc_id, true AS succeeded, 'malicious' AS ai_verdict, 95 AS ai_score, "
        "0.9D AS ai_confidence, 'starts a program' AS ai_summary, CAST(NULL AS STRING) AS ai_error FROM {o}"
    )
    ingest = Ingest(str(tmp_path / "store"), GateSettings(), lambda o: spark.sql(calls, o=o))
    store = ResultStore(spark, ingest.root)
    written = Batch.write

    def ends_at(table):
        def write(batch, name, rows):
            if name == table:
                raise RuntimeError("lost")
            written(batch, name, rows)

        return write

    for table in ("reports", "events"):
        monkeypatch.setattr(Batch, "write", ends_at(table))
        with pytest.raises(RuntimeError, match="lost"):
            ingest(files, 0)
        assert all(store.rows(n) is None for n in (*REPLACED, *APPENDED))
    monkeypatch.setattr(Batch, "write", written)
    ingest(files, 0)
    assert store.latest("scans").count() == 1 and store.rows("events").where("kind = 'idle'").count() == 1
    told = store.rows("assessments").collect()
    assert all(r.verdict == "malicious" and r.scan_id == store.latest("scans").first().scan_id for r in told)
    assert len(told) == store.rows("events").where("kind = 'ai_review'").count()


def test_store_keeps_latest_and_all(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(list(r), "scan_id bigint, v string")
    assert store.rows("scans") is None and store.latest("indicators") is None
    with store.batch(3) as batch:
        batch.write("scans", rows((1, "a"), (2, "a")))
        batch.write("indicators", rows((1, "x"), (1, "y"), (2, "z")))
        with pytest.raises(ValueError):
            batch.write("scans", rows((1, "a")))
    with store.batch(4) as batch:
        batch.write("scans", rows((1, "b")))
        batch.write("indicators", rows())
    got = lambda df: sorted((r.scan_id, r.v) for r in df.collect())
    assert got(store.latest("scans")) == [(1, "b"), (2, "a")]
    # The second run found nothing: its findings replace the first run's.
    assert got(store.latest("indicators")) == [(2, "z")]
    assert got(store.latest("indicators", before=4)) == [(1, "x"), (1, "y"), (2, "z")]
    assert got(store.rows("scans")) == [(1, "a"), (1, "b"), (2, "a")]
    with store.batch(3) as batch:
        batch.write("scans", rows((5, "c")))
    assert got(store.rows("scans")) == [(1, "b"), (5, "c")]
    assert got(store.rows("indicators")) == []


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    batches = [
        [(at(1), 1), (at(30), 1)],
        # The mark is hour 29: hour 1 counts in no open window, hour 6 in some of its last ones.
        [(at(1), 1), (at(4, 59), 1), (at(6), 1), (at(31), 2)],
        [],
        [(at(100), 1)],
    ]
    counters = WindowCounters(str(tmp_path / "store"), ("n",))
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "ts timestamp, n int")
        for _ in range(2):  # a replay changes nothing
            counters(df, i)
    late = {r.batch: (r.n_rows, r.late) for r in counters.late_rows(spark).collect()}
    assert late == {0: (2, 0), 1: (4, 2), 3: (1, 0)}
    mark, want = None, {}
    for rows in batches:
        for t, n in rows:
            hour = t.replace(minute=0)
            for k in range(24):
                start = hour - dt.timedelta(hours=k)
                if mark is None or start + dt.timedelta(hours=24) > mark:
                    want[start] = want.get(start, 0) + n
        newest = max([t for t, _ in rows] + ([mark + dt.timedelta(hours=1)] if mark else []), default=None)
        mark = newest - dt.timedelta(hours=1) if newest else mark
    assert {r.window_start: r.n for r in counters.totals(spark).collect()} == want


def test_updates_write_changed_keys_and_compact(spark, tmp_path):
    schema, folder = "k string, n int", str(tmp_path / "in")
    for rows in ([("a", 1), ("b", 1)], [("b", 5)], [("c", 2), ("a", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    store = ResultStore(spark, str(tmp_path / "store"))
    (
        stream.groupBy("k").agg(F.sum("n").alias("n")).writeStream.foreachBatch(keep_updates(store.root, "sums"))
        .outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True)
        .start().awaitTermination()
    )
    written = {}
    for r in store.rows("sums").collect():
        written.setdefault(r.batch, set()).add((r.k, r.n))
    assert [written[b] for b in sorted(written)] == [{("a", 1), ("b", 1)}, {("b", 6)}, {("a", 2), ("c", 2)}]
    latest = lambda: {(r.k, r.n) for r in store.current("sums", ["k"]).collect()}
    assert latest() == {("a", 2), ("b", 6), ("c", 2)}
    store.compact("sums", ["k"])
    assert latest() == {("a", 2), ("b", 6), ("c", 2)} and store.rows("sums").count() == 3
    assert store.vacuum() == 3 and latest() == {("a", 2), ("b", 6), ("c", 2)}
    with store.batch(9) as batch:
        batch.write("sums", spark.createDataFrame([("a", 7)], "k string, n bigint"))
    assert latest() == {("a", 7), ("b", 6), ("c", 2)}
    store.compact("sums", ["k"])
    assert latest() == {("a", 7), ("b", 6), ("c", 2)} and store.rows("sums").count() == 3


def test_state_of_a_settling_query(spark, tmp_path):
    rows = [("a", 5, 0), ("a", 5, 15), ("a", 5, 30), ("b", 1, 30), ("c", 5, 15), ("c", settle.FORGET, 30)]
    root = str(tmp_path / "run")
    run_once(settle.settled_files(listing(spark, tmp_path, rows)), root)
    states = lambda n=None: {
        (r.path, r.size, r.done) for r in settle.watched(spark, f"{root}/log", n).collect()
    }
    assert states(0) == {("a", 5, False)}
    assert states(1) == {("a", 5, False), ("c", 5, False)}
    assert states() == {("a", 5, True), ("b", 1, False)}
    status = settle.watch_status(settle.watched(spark, f"{root}/log")).first()
    assert (status.known_files, status.settling) == (1, 1)


def test_vanished_and_old_files_leave_the_state(spark, tmp_path):
    week = settle.REMEMBER_SECONDS
    rows = [("gone", 1, 0), ("old", 5, 0), ("old", 5, 15), ("old", 5, 30), ("kept", 5, 0), ("kept", 5, 15),
            ("kept", 5, 30), ("kept", 5, 5_000), ("x", 1, 5_000), ("x", 1, week + 2_000), ("x", 1, week + 2_100)]
    root = str(tmp_path / "run")
    found = seen(run_once(settle.settled_files(listing(spark, tmp_path, rows)), root))
    assert [p for p, _ in found] == ["kept", "old", "x"]
    assert {r.path for r in settle.watched(spark, f"{root}/log").collect()} == {"kept", "x"}


def test_keys_of_a_bucket_share_calls_but_not_fates(spark, tmp_path, monkeypatch):
    """Every key in one bucket, or each in nearly its own: the same rows, states and timers."""
    week = settle.REMEMBER_SECONDS
    rows = [(f"p{i}", 5, t) for i in range(20) for t in (0, 15, 30) if i % 4 or t == 0]
    rows += [("p1", settle.FORGET, 45), ("p1", 7, 45), ("x", 1, 5_000), ("y", 1, week + 9_000), ("x", 1, week + 9_100)]
    got = []
    for buckets in (1, 4096):
        root = str(tmp_path / f"run{buckets}")
        stream = listing(spark, tmp_path / str(buckets), rows)
        found = seen(run_once(settle.settled_files(stream, buckets=buckets), root))
        states = lambda n=None: sorted(map(tuple, settle.watched(spark, f"{root}/log", n).collect()))
        got.append((found, states(2), states()))
    assert got[0] == got[1]
    assert len(got[0][0]) == 16 and len(got[0][1]) == 20 and {r[0] for r in got[0][2]} == {"x", "y"}


def test_stale_scans_by_bucket(spark, tmp_path):
    hour = 3_600
    rows = [(i, "analyzing", 0) for i in range(12)] + [(i, "completed", hour) for i in range(4)]
    rows += [(4, "pending", hour), (5, "completed", hour), (5, "pending", 2 * hour), (99, "pending", 3 * hour)]
    rows += [(98, "pending", 9 * hour), (97, "pending", 9 * hour + 60)]
    schema, folder = "scan_id bigint, status string, ts timestamp", str(tmp_path / "life")
    for at in sorted({r[2] for r in rows}):
        batch = [(i, s, START + dt.timedelta(seconds=t)) for i, s, t in rows if t == at]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    for buckets in (1, 4096):
        life = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        found = run_once(settle.stale_scans(life, buckets=buckets), str(tmp_path / f"run{buckets}")).collect()
        assert sorted(r.scan_id for r in found) == [*range(4, 12), 99]


def test_tables_of_a_batch_are_written_side_by_side_and_count_together(spark, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path / "side"))
    rows = spark.range(3).withColumnRenamed("id", "scan_id")
    broken = rows.where(F.raise_error(F.lit("broken")).isNull())
    with pytest.raises(Exception, match="broken"):
        with store.batch(0) as batch:
            batch.write_all({"scans": rows, "reports": broken})
    assert store.rows("scans") is None
    meet, plain = threading.Barrier(2), Batch.write

    def write(self, name, table):
        meet.wait(60)  # Passes only if both are under way.
        plain(self, name, table)

    monkeypatch.setattr(Batch, "write", write)
    with store.batch(0) as batch:
        batch.write_all({"scans": rows, "reports": rows})
    assert store.rows("scans").count() == store.rows("reports").count() == 3


@pytest.mark.parametrize("files", [0, 1, 3])
def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path, files):
    """Large tables are folders of part files, of which a filter on the table's name keeps none."""
    rows = spark.range(30).withColumn("text", F.lit("x"))
    if files:
        rows.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    rows.write.parquet(str(tmp_path / "labels.parquet"))
    got = run_once(stream_of(spark, str(tmp_path), "documents"))
    assert sorted(r.id for r in got.collect()) == list(range(30))
