"""Micro-batch ingestion with the same functions the batch scan uses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.operators.gate import GateSettings, decide
from papersieve.operators.history import cap_columns, content_key, is_quarantine_candidate, split_submissions
from papersieve.plans.scan import Scan, scan_files
from papersieve.session import staged
from papersieve.sources.files import admit
from papersieve.sources.store import ResultStore

# Characters of a document's text that a report keeps.
EXCERPT_CHARS = 8000
NO_CALLS = (
    "doc_id bigint, succeeded boolean, ai_verdict string, ai_score int, ai_confidence double, "
    "ai_summary string, ai_error string"
)
HISTORY = (
    "scan_id bigint, filename string, file_size bigint, sha256 string, md5 string, "
    "storage_key string, source string, status string, verdict string, decided_by string, "
    "risk_score int, confidence double, summary string, quarantined boolean, "
    "created_at timestamp"
)


def event_rows(rows: DataFrame, kind: str, at: Column, **columns: Column) -> DataFrame:
    """Lifecycle events of one kind in a common shape."""
    empty = F.lit(None)
    return rows.select(
        F.lit(kind).alias("kind"),
        columns.get("scan_id", empty).cast("bigint").alias("scan_id"),
        columns.get("filename", empty).cast("string").alias("filename"),
        columns.get("verdict", empty).cast("string").alias("verdict"),
        columns.get("risk_score", empty).cast("int").alias("risk_score"),
        columns.get("message", empty).cast("string").alias("message"),
        at.alias("ts"),
    )


def report_rows(scan: Scan) -> DataFrame:
    """The report of every scan as rows ``scan_id, section, ord, value``.

    One row per finding instead of lists in one row: a file with very many
    findings stays many small rows. ``value`` is the finding as JSON.
    """
    found = scan.evidence
    sections = {
        "structure": found.structure.withColumn("text_excerpt", F.left("text_excerpt", F.lit(EXCERPT_CHARS))),
        "script": found.scripts, "action": found.actions, "attachment": found.attachments,
        "url": found.urls, "signature": found.hits, "error": found.errors,
    }
    parts = []
    for name, rows in sections.items():
        kept = [c for c in rows.columns if c not in ("doc_id", "ord")]
        place = F.col("ord") if "ord" in rows.columns else F.lit(None)
        parts.append(
            rows.select(
                F.col("doc_id").alias("scan_id"),
                F.lit(name).alias("section"),
                place.cast("bigint").alias("ord"),
                F.to_json(F.struct(*kept)).alias("value"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assessment_rows(decisions: DataFrame, calls: DataFrame) -> DataFrame:
    """What a model said about scans the gate sent to it, used or not."""
    return decisions.where("escalated").select("doc_id", "used_ai").join(calls, "doc_id").select(
        F.col("doc_id").alias("scan_id"),
        F.coalesce("succeeded", F.lit(False)).alias("succeeded"),
        "used_ai",
        *[F.col(f"ai_{c}").alias(c) for c in ("verdict", "score", "confidence", "summary", "error")],
    )


@dataclass
class Ingest:
    """``foreachBatch`` body: admit, deduplicate, scan, decide, save.

    The five tables of a batch (scans, reports, indicators, assessments, events)
    become visible together, and a replay after a failure replaces them together.
    ``calls_for`` supplies the table of model responses for a batch of outcomes;
    without it every decision is static.
    """

    root: str
    gate: GateSettings = GateSettings()
    calls_for: Callable[[DataFrame], DataFrame] | None = None
    source: str = "watch_folder"

    def history(self, hashes: DataFrame, before: int) -> DataFrame:
        """Latest rows, from the batches before this one, of the contents in ``hashes``.

        Only rows of those contents are grouped, however long the history is.
        """
        spark = hashes.sparkSession
        known = ResultStore(spark, self.root).latest("scans", before=before, only=hashes)
        return spark.createDataFrame([], HISTORY) if known is None else known

    def __call__(self, files: DataFrame, batch_id: int) -> None:
        """``files(path, length, content, observed_at)`` of one micro-batch."""
        spark = files.sparkSession
        accepted, rejected = admit(files)
        # Decisions are taken on rows without content; only the join that picks the
        # files to scan touches the bytes again.
        named = staged(
            accepted.select(
                "path", "length", "observed_at",
                F.sha2("content", 256).alias("sha256"),
                F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
            ),
            broadcasts=True,
        )
        # One copy of each content per batch; the copies only differ in path.
        first = named.groupBy("sha256").agg(
            F.min_by("path", F.struct("observed_at", "path")).alias("path")
        )
        once = named.join(first, ["sha256", "path"], "left_semi")
        known, new = split_submissions(once, self.history(once.select("sha256").distinct(), batch_id))
        fresh = staged(new.withColumn("doc_id", F.xxhash64("sha256")), broadcasts=True)
        chosen = fresh.select("path", "doc_id")
        scan = scan_files(staged(accepted.select("path", "content").join(chosen, "path").drop("path")))
        calls = (
            self.calls_for(scan.outcomes)
            if self.calls_for
            else spark.createDataFrame([], NO_CALLS)
        )
        decisions = decide(scan.outcomes, calls, self.gate)
        seized = is_quarantine_candidate(F.col("verdict"))
        # Files whose bytes stopped the reader; what could be read of them was still scanned.
        unread = staged(
            scan.evidence.errors.where(F.col("message").rlike(r"^open failed: \w+: "))
            .groupBy("doc_id")
            .agg(F.min("message").alias("unread"))
        )
        rows = decisions.join(
            fresh.select("doc_id", "filename", "sha256", "length", "observed_at"), "doc_id"
        ).join(unread, "doc_id", "left").select(
            F.col("doc_id").alias("scan_id"),
            "filename",
            F.col("length").cast("bigint").alias("file_size"),
            "sha256",
            F.lit(None).cast("string").alias("md5"),
            content_key(F.col("sha256")).alias("storage_key"),
            F.lit(self.source).alias("source"),
            F.when(F.col("unread").isNotNull(), "failed")
            .when(seized, "quarantined")
            .otherwise("completed")
            .alias("status"),
            "verdict",
            "decided_by",
            "risk_score",
            "confidence",
            "summary",
            seized.alias("quarantined"),
            F.col("observed_at").alias("created_at"),
        )
        found = scan.indicators.withColumnRenamed("doc_id", "scan_id")
        with ResultStore(spark, self.root).batch(batch_id) as batch:
            batch.write("scans", cap_columns(rows))
            batch.write("reports", report_rows(scan))
            batch.write("indicators", cap_columns(found))
            batch.write("assessments", cap_columns(assessment_rows(decisions, calls)))
            saved = batch.read("scans")
            batch.write("events", self.events(saved, rejected, named, first, known, fresh, decisions, unread))

    def events(
        self,
        saved: DataFrame,
        rejected: DataFrame,
        named: DataFrame,
        first: DataFrame,
        known: DataFrame,
        fresh: DataFrame,
        decisions: DataFrame,
        unread: DataFrame,
    ) -> DataFrame:
        """What happened to every file of a batch."""
        at, name = F.col("observed_at"), F.col("filename")
        copies = named.join(first, ["sha256", "path"], "left_anti")
        return (
            event_rows(rejected, "rejected", at, filename=F.col("path"), message=F.col("reject_code"))
            .unionByName(
                event_rows(
                    known, "duplicate", at, scan_id=F.col("known_scan_id"), filename=name,
                    verdict=F.col("known_verdict"), risk_score=F.col("known_score"),
                )
            )
            .unionByName(
                event_rows(copies, "duplicate", at, scan_id=F.xxhash64("sha256"), filename=name)
            )
            .unionByName(event_rows(fresh, "queued", at, scan_id=F.col("doc_id"), filename=name))
            .unionByName(event_rows(fresh, "parsing", at, scan_id=F.col("doc_id"), filename=name))
            .unionByName(
                event_rows(
                    decisions.where("escalated").join(fresh.select("doc_id", "observed_at"), "doc_id"),
                    "ai_review", at, scan_id=F.col("doc_id"),
                )
            )
            .unionByName(
                event_rows(
                    saved.where("status <> 'failed'"), "completed", F.col("created_at"), scan_id=F.col("scan_id"),
                    filename=name, verdict=F.col("verdict"), risk_score=F.col("risk_score"),
                    message=F.col("summary"),
                )
            )
            .unionByName(
                event_rows(
                    fresh.join(unread, "doc_id"), "failed", at, scan_id=F.col("doc_id"),
                    filename=name, message=F.col("unread"),
                )
            )
            # With the batch's last file done the queue is empty.
            .unionByName(event_rows(named.agg(F.max("observed_at").alias("observed_at")), "idle", at))
        )
