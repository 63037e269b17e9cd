"""Queries and changes over the scan history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.text import rank_of
from papersieve.operators.ordered import following
from papersieve.session import dealt, unbroadcast


def recent(
    scans: DataFrame,
    limit: int = K.RECENT_LIMIT,
    offset: int = 0,
    verdict: str | None = None,
    status: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Newest scans; the search text is a pattern in which % and _ keep their meaning."""
    out = scans
    if verdict is not None:
        out = out.where(F.col("verdict") == verdict)
    if status is not None:
        out = out.where(F.col("status") == status)
    if search:
        out = out.where(F.col("filename").ilike(f"%{search}%"))
    return out.orderBy(F.desc("created_at"), "scan_id").offset(offset).limit(limit)


def latest_finished(scans: DataFrame) -> DataFrame:
    """Latest completed or quarantined scan per hash, by a combining aggregate."""
    done = scans.where(F.col("status").isin(*K.FINISHED_STATUSES))
    kept = F.struct("scan_id", "verdict", "risk_score", "created_at")
    return (
        done.groupBy("sha256")
        .agg(F.max_by(kept, F.struct("created_at", "scan_id")).alias("s"))
        .select("sha256", "s.*")
    )


def split_submissions(submitted: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(duplicates with their earlier verdict, new files)`` by content hash.

    A hash submitted many times is a hot join key on the left only; the right
    has one row per hash, which adaptive skew handling can replicate.
    """
    known = latest_finished(scans).select(
        "sha256",
        F.col("scan_id").alias("known_scan_id"),
        F.col("verdict").alias("known_verdict"),
        F.col("risk_score").alias("known_score"),
    )
    return submitted.join(known, "sha256"), submitted.join(known, "sha256", "left_anti")


def pending(scans: DataFrame) -> DataFrame:
    return scans.where(F.col("status").isin(*K.NON_TERMINAL_STATUSES))


def stats(scans: DataFrame, assessments: DataFrame, now: Column) -> DataFrame:
    """One row of dashboard numbers; every count is a combining aggregate."""
    since = now - F.expr("INTERVAL 24 HOURS")
    fresh = F.col("created_at") >= since
    done = F.col("status") == "completed"
    harmless = F.col("verdict").isin("clean", "low_risk")
    base = scans.agg(
        F.count("*").alias("total"),
        F.count_if(fresh).alias("scanned_last_24h"),
        F.count_if(fresh & (F.col("verdict") == "malicious")).alias("malicious_last_24h"),
        F.avg(F.when(done, F.col("duration_ms"))).alias("avg_duration_ms"),
        F.round(F.try_divide(F.count_if(harmless), F.count("*")), 4).alias("clean_rate"),
    )
    calls = assessments.agg(
        F.count_if(F.col("created_at") >= since).alias("ai_calls_last_24h")
    )
    return base.withColumn("ai_calls_last_24h", calls.scalar())


def counts_by(scans: DataFrame, column: str) -> DataFrame:
    return scans.groupBy(column).agg(F.count("*").alias("n"))


CUTOFF_BUCKETS = 4_096
# So few rows are sorted; more are split into finer buckets.
CUTOFF_ROWS = 1_000_000


def prune_cutoff(scans: DataFrame, keep: int) -> Column:
    """Creation time of the ``keep``-th newest scan; null if there are fewer.

    The place is narrowed down by histograms over the creation times, each of
    ``CUTOFF_BUCKETS`` buckets, until few rows are left to sort: two passes over
    one column for most histories, whatever ``keep`` is. Runs these as actions.
    """
    at = scans.select(F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")).where("at IS NOT NULL")
    low, high, n = at.agg(F.min("at"), F.max("at"), F.count("*")).first()
    newer = 0
    while n and newer + n >= keep and n > CUTOFF_ROWS and high > low:
        width = max(1, -(-(high - low + 1) // CUTOFF_BUCKETS))
        inside = at.where(F.col("at").between(low, high))
        bucket = F.expr(f"(at - {low}L) DIV {width}L")
        found = inside.groupBy(bucket.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
        for r in found:
            if newer + r["n"] >= keep:
                low, high, n = low + r["k"] * width, min(high, low + (r["k"] + 1) * width - 1), r["n"]
                break
            newer += r["n"]
    if newer + n < keep:
        return F.lit(None).cast("timestamp")
    if high > low:
        rest = at.where(F.col("at").between(low, high)).orderBy(F.desc("at")).limit(keep - newer)
        low = rest.agg(F.min("at")).first()[0]
    return F.timestamp_micros(F.lit(low).cast("bigint"))


def doomed(scans: DataFrame, keep: int = K.KEEP_SCANS) -> DataFrame:
    """Scans strictly older than the cutoff and not quarantined; ties survive."""
    if keep <= 0:
        return scans.limit(0)
    return scans.where((F.col("created_at") < prune_cutoff(scans, keep)) & ~F.col("quarantined"))


def pruned(scans: DataFrame, keep: int = K.KEEP_SCANS) -> DataFrame:
    """History after pruning."""
    return scans.join(doomed(scans, keep).select("scan_id"), "scan_id", "left_anti")


def orphan_keys(scans: DataFrame, keep: int = K.KEEP_SCANS) -> DataFrame:
    """Storage keys only doomed scans refer to.

    One aggregation per key instead of a set difference of two scans: a key is
    an orphan when it has a doomed scan and no surviving one.
    """
    if keep <= 0:
        return scans.select("storage_key").limit(0)
    old = F.coalesce(F.col("created_at") < prune_cutoff(scans, keep), F.lit(False))
    return (
        scans.withColumn("gone", old & ~F.col("quarantined"))
        .groupBy("storage_key")
        .agg(F.bool_and("gone").alias("all_gone"))
        .where("all_gone")
        .select("storage_key")
    )


def fail_stale(scans: DataFrame, now: Column, hours: int = K.STALE_HOURS) -> DataFrame:
    """Scans left unfinished for too long become failed with an unknown verdict."""
    stale = F.col("status").isin(*K.NON_TERMINAL_STATUSES) & (
        F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS")
    )
    return scans.withColumns(
        {
            "error_code": F.when(stale, "interrupted"),
            "error_message": F.when(
                stale, "Analysis was interrupted before it completed"
            ).otherwise(F.col("error_message")),
            "completed_at": F.when(stale, now),
            "verdict": F.when(stale, "unknown").otherwise(F.col("verdict")),
            "status": F.when(stale, "failed").otherwise(F.col("status")),
        }
    )


def mark_failed(scans: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``failures(scan_id, code, message, at)``; returns scans and events.

    Messages repeat themselves so much that a few compressed MB of them unpack to more
    than a broadcast or a task can hold, so failures meet their scans in a merge join of
    as many partitions as their unpacked size asks for. Runs that sum as an action.
    """
    failures = unbroadcast(dealt(failures, "scan_id"))
    joined = scans.join(failures, "scan_id", "left")
    bad = F.col("code").isNotNull()
    updated = joined.withColumns(
        {
            "status": F.when(bad, "failed").otherwise(F.col("status")),
            "verdict": F.when(bad, "unknown").otherwise(F.col("verdict")),
            "decided_by": F.when(bad, "error"),
            "error_code": F.when(bad, F.left("code", F.lit(64))),
            "error_message": F.when(bad, F.left("message", F.lit(4000))).otherwise(
                F.col("error_message")
            ),
            "completed_at": F.when(bad, F.col("at")),
            "retry_count": F.coalesce(F.col("retry_count"), F.lit(0)) + F.when(bad, 1).otherwise(0),
        }
    ).drop("code", "message", "at")
    events = failures.join(scans.select("scan_id"), "scan_id", "left_semi").select(
        "scan_id",
        F.lit("scan.failed").alias("event"),
        F.lit("desktop").alias("actor"),
        F.left("message", F.lit(1000)).alias("message"),
        F.to_json(F.struct("code")).alias("payload"),
        F.col("at").alias("created_at"),
    )
    return updated, events


def apply_reviews(scans: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest analyst override per scan: ``reviews(scan_id, verdict, note, at)``."""
    latest = (
        reviews.groupBy("scan_id")
        .agg(F.max_by(F.struct("verdict", "note", "at"), F.struct("at", "verdict", "note")).alias("r"))
    )
    joined = scans.join(latest, "scan_id", "left")
    has = F.col("r").isNotNull()
    updated = joined.withColumns(
        {
            "quarantined": F.when(has & (F.col("r.verdict") == "clean"), False).otherwise(
                F.col("quarantined")
            ),
            "reviewed": has,
            "review_note": F.nullif(F.col("r.note"), F.lit("")),
            "decided_by": F.when(has, "manual"),
            "verdict": F.coalesce(F.col("r.verdict"), F.col("verdict")),
        }
    ).drop("r")
    events = joined.where(has).select(
        "scan_id",
        F.lit("scan.reviewed").alias("event"),
        F.lit("user").alias("actor"),
        F.when(F.length("r.note") > 0, F.col("r.note"))
        .otherwise(F.concat(F.lit("Verdict changed to "), F.col("r.verdict")))
        .alias("message"),
        F.to_json(F.struct(F.col("verdict").alias("from"), F.col("r.verdict").alias("to"))).alias(
            "payload"
        ),
        F.col("r.at").alias("created_at"),
    )
    return updated, events


def reset_for_rescan(scans: DataFrame, ids: DataFrame) -> DataFrame:
    """Send scans back to pending with error and timing fields cleared."""
    marked = scans.join(ids.select("scan_id").distinct().withColumn("_r", F.lit(True)), "scan_id", "left")
    again = F.coalesce("_r", F.lit(False))
    cleared = {
        c: F.when(~again, F.col(c))
        for c in ("error_code", "error_message", "started_at", "completed_at")
        if c in scans.columns
    }
    return marked.withColumns(
        {"status": F.when(again, "pending").otherwise(F.col("status")), **cleared}
    ).drop("_r")


def delete_scans(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove scans and every row keyed to them from each table."""
    gone = ids.select("scan_id").distinct()
    return {name: t.join(gone, "scan_id", "left_anti") for name, t in tables.items()}


def audit_event(
    scan_id: Column, event: str, message: Column, at: Column, payload: Column, actor: str = "desktop"
) -> list[Column]:
    """Columns of one audit row."""
    return [
        scan_id.alias("scan_id"),
        F.lit(event).alias("event"),
        F.lit(actor).alias("actor"),
        F.left(message, F.lit(1000)).alias("message"),
        payload.alias("payload"),
        at.alias("created_at"),
    ]


def latest_assessment(assessments: DataFrame) -> DataFrame:
    rest = [c for c in assessments.columns if c != "scan_id"]
    return (
        assessments.groupBy("scan_id")
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "call_id")).alias("a"))
        .select("scan_id", *[F.col(f"a.{c}").alias(f"ai_{c}") for c in rest])
    )


def detail(
    scans: DataFrame,
    reports: DataFrame | None,
    indicators: DataFrame,
    assessments: DataFrame,
) -> DataFrame:
    """Scan with report, indicators (weight first) and the latest assessment.

    Indicator codes are unique per scan, so a collected list is bounded by the
    rule set.
    """
    listed = indicators.groupBy("scan_id").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("weight")).alias("w"), "code", "title", "severity"))
        ).alias("i")
    ).select(
        "scan_id",
        F.transform(
            "i",
            lambda s: F.struct(
                s["code"].alias("code"), s["severity"].alias("severity"),
                (-s["w"]).alias("weight"), s["title"].alias("title"),
            ),
        ).alias("indicators"),
    )
    out = scans.join(listed, "scan_id", "left").join(latest_assessment(assessments), "scan_id", "left")
    return out if reports is None else out.join(reports, "scan_id", "left")


def scan_json(detailed: DataFrame) -> DataFrame:
    """History rows as JSON text with their indicators."""
    fields = [
        c for c in ("filename", "sha256", "md5", "file_size", "status", "verdict", "risk_score",
                    "confidence", "decided_by", "duration_ms", "quarantined", "extra", "indicators")
        if c in detailed.columns
    ]
    return detailed.select("scan_id", F.to_json(F.struct(F.col("scan_id").alias("id"), *fields)).alias("json"))


STATUS_OF_EVENT = (
    ("queued", "pending"), ("parsing", "analyzing"), ("ai_review", "ai_review"),
    ("completed", "completed"), ("quarantined", "quarantined"), ("failed", "failed"),
)


def lifecycle_status(events: DataFrame) -> DataFrame:
    """Current status per scan: that of its latest event (``event_id`` breaks ties)."""
    return events.groupBy("scan_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("ts").alias("since"),
    )


def time_in_state(events: DataFrame) -> DataFrame:
    """``scan_id, status, entered, left_at, seconds`` of every stay of a scan in a status.

    A stay begins with an event and ends with the scan's next one; the current
    status has no end yet. The next event is found across slices of the ordered
    events, so a scan with very many of them is spread over tasks.
    """
    next_at = following(events, F.col("ts"), ["ts", "event_id"], ["scan_id"], "left_at")
    return next_at.select(
        "scan_id", "status", F.col("ts").alias("entered"), "left_at",
        ((F.unix_micros(F.col("left_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("seconds"),
    )


def seconds_in_state(events: DataFrame) -> DataFrame:
    """Stays that ended and their seconds, per scan and status."""
    return (
        time_in_state(events).where("left_at IS NOT NULL")
        .groupBy("scan_id", "status")
        .agg(F.count("*").alias("stays"), F.sum("seconds").alias("seconds"))
    )


def is_quarantine_candidate(verdict: Column, enabled: bool = True) -> Column:
    return F.lit(enabled) & (verdict == "malicious")


def quarantine_decisions(scans: DataFrame, enabled: bool = True) -> DataFrame:
    """What should be moved away; a review or release clears it. No file is moved."""
    released = F.coalesce("reviewed", F.lit(False)) if "reviewed" in scans.columns else F.lit(False)
    return scans.withColumn(
        "quarantine", is_quarantine_candidate(F.col("verdict"), enabled) & ~released
    )


def alerts(scans: DataFrame, minimum: str = "suspicious") -> DataFrame:
    """Finished scans worth a notification; unknown never is."""
    wanted = ("malicious",) if minimum == "malicious" else ("suspicious", "malicious")
    return scans.where(F.col("verdict").isin(*wanted))


def listing(
    scans: DataFrame, search: str = "", sort_by: str = "created_at", descending: bool = True
) -> DataFrame:
    """Table view: fixed-text search in the name, sort by raw value."""
    shown = scans
    if search:
        shown = shown.where(F.contains(F.lower("filename"), F.lit(search.lower())))
    key = F.col(sort_by)
    return shown.orderBy(key.desc() if descending else key.asc(), "scan_id")


def findings_note(status: Column, summary: Column, error: Column, n_indicators: Column) -> Column:
    """Text in place of an empty finding list; a failed scan is never "nothing found"."""
    reason = F.split(F.trim(F.coalesce(error, F.lit(""))), "\n")[0]
    failed = F.concat(
        F.lit(
            "The scan of this file failed, so nothing in it was checked. It may be unsafe."
        ),
        F.when(reason != "", F.concat(F.lit("\n\nReason: "), reason)).otherwise(""),
    )
    return (
        F.when(n_indicators > 0, "")
        .when(status == "failed", failed)
        .when(F.length(F.coalesce(summary, F.lit(""))) > 0, "")
        .otherwise("The scan found nothing suspicious.")
    )


def cap_columns(df: DataFrame) -> DataFrame:
    """Clip text columns to their stored widths."""
    caps = dict(K.COLUMN_CAPS)
    present = {c: F.left(c, F.lit(caps[c])) for c in df.columns if c in caps}
    return df.withColumns(present) if present else df


def content_key(sha256: Column) -> Column:
    """Content-addressed storage key ``aa/bb/<sha>.pdf``."""
    return F.concat_ws(
        "/", F.substring(sha256, 1, 2), F.substring(sha256, 3, 2), F.concat(sha256, F.lit(".pdf"))
    )


def constraint_violations(scans: DataFrame) -> DataFrame:
    """Rows breaking the stored constraints; empty on a sound history."""
    return scans.where(
        ~F.col("risk_score").between(0, 100)
        | (F.col("file_size") < 0)
        | rank_of(F.col("verdict"), K.VERDICT_ORDER).isNull()
    )
