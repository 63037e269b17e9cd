"""History and budget queries over scans derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from papersieve.catalog import fragments as X
from papersieve.catalog.registry import query
from papersieve.operators import budget as bg
from papersieve.operators import history as hs
from papersieve.plans import inputs as I

NOW = I.NOW_ORDERS
S = f"WITH {X.SCANS}"


def now(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


@query("H1_recent", f"{S} SELECT scan_id FROM scans WHERE verdict = 'malicious' AND status = 'completed' AND filename ILIKE '%report_1%' ORDER BY created_at DESC, scan_id LIMIT 50 OFFSET 5")
def _(spark, sf):
    return hs.recent(I.scans(spark, sf), 50, 5, "malicious", "completed", "report_1").select("scan_id")


@query("H2_count", f"{S} SELECT count(*) AS n FROM scans")
def _(spark, sf):
    return I.scans(spark, sf).agg(F.count("*").alias("n"))


_LATEST = "latest AS (SELECT sha256, scan_id, verdict, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY created_at DESC, scan_id DESC) rn FROM scans WHERE status IN ('completed', 'quarantined')) WHERE rn = 1)"


@query("H3_latest_finished", f"{S}, {_LATEST} SELECT * FROM latest")
def _(spark, sf):
    return hs.latest_finished(I.scans(spark, sf)).select("sha256", "scan_id", "verdict", "risk_score")


_SUBMIT = "SELECT c_custkey AS file_id, md5(CAST(c_custkey * 2 AS STRING)) AS sha256 FROM customer"


@query(
    "H4_submission_dedup",
    f"{S}, {_LATEST}, sub AS ({_SUBMIT}) SELECT file_id, coalesce(verdict, 'new') AS outcome, coalesce(scan_id, -1) AS known_scan_id FROM sub LEFT JOIN latest USING (sha256)",
)
def _(spark, sf):
    submitted = I.derived(spark, sf, _SUBMIT, "customer")
    known, new = hs.split_submissions(submitted, I.scans(spark, sf))
    return known.select("file_id", F.col("known_verdict").alias("outcome"), "known_scan_id").unionByName(
        new.select("file_id", F.lit("new").alias("outcome"), F.lit(-1).cast("bigint").alias("known_scan_id"))
    )


@query("H5_pending", f"{S} SELECT scan_id FROM scans WHERE status IN ('pending', 'analyzing', 'ai_review')")
def _(spark, sf):
    return hs.pending(I.scans(spark, sf)).select("scan_id")


_AT = f"TIMESTAMP '{NOW}'"


@query(
    "H6_stats",
    f"""{S}, a AS ({I.ASSESSMENTS_SELECT}) SELECT count(*) AS total, count(*) FILTER (WHERE created_at >= {_AT} - INTERVAL 24 HOUR) AS scanned_last_24h,
      count(*) FILTER (WHERE created_at >= {_AT} - INTERVAL 24 HOUR AND verdict = 'malicious') AS malicious_last_24h, round(avg(duration_ms) FILTER (WHERE status = 'completed'), 6) AS avg_duration_ms,
      (SELECT count(*) FROM a WHERE created_at >= {_AT} - INTERVAL 24 HOUR) AS ai_calls_last_24h FROM scans""",
)
def _(spark, sf):
    return hs.stats(I.scans(spark, sf), I.assessments(spark, sf), now()).drop("clean_rate").withColumn(
        "avg_duration_ms", F.round("avg_duration_ms", 6)
    )


@query("H6_by_status_and_verdict", f"{S} SELECT 'status' AS kind, status AS value, count(*) AS n FROM scans GROUP BY 2 UNION ALL SELECT 'verdict', verdict, count(*) FROM scans GROUP BY 2")
def _(spark, sf):
    rows = I.scans(spark, sf)
    parts = [
        hs.counts_by(rows, c).select(F.lit(c).alias("kind"), F.col(c).alias("value"), "n")
        for c in ("status", "verdict")
    ]
    return parts[0].unionByName(parts[1])


@query("H7_clean_rate", f"{S} SELECT round((count(*) FILTER (WHERE verdict IN ('clean', 'low_risk')))::DOUBLE / count(*), 4) AS clean_rate FROM scans")
def _(spark, sf):
    return hs.stats(I.scans(spark, sf), I.assessments(spark, sf), now()).select("clean_rate")


_KEEP = 700
_CUT = f"cut AS (SELECT created_at AS c FROM scans ORDER BY created_at DESC LIMIT 1 OFFSET {_KEEP - 1})"
_GONE = "(created_at < (SELECT c FROM cut) AND NOT quarantined)"


@query("H8_prune", f"{S}, {_CUT} SELECT scan_id FROM scans WHERE NOT {_GONE}")
def _(spark, sf):
    return hs.pruned(I.scans(spark, sf), _KEEP).select("scan_id")


@query("H9_orphan_keys", f"{S}, {_CUT} SELECT DISTINCT storage_key FROM scans WHERE {_GONE} AND storage_key NOT IN (SELECT storage_key FROM scans WHERE NOT {_GONE})")
def _(spark, sf):
    return hs.orphan_keys(I.scans(spark, sf), _KEEP)


@query(
    "H10_fail_stale",
    f"{S} SELECT scan_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN 'unknown' ELSE verdict END AS verdict, CASE WHEN stale THEN 'interrupted' ELSE '' END AS error_code FROM (SELECT *, status = 'pending' AND created_at < TIMESTAMP '1999-06-01 00:00:00' - INTERVAL 2 HOUR AS stale FROM scans)",
)
def _(spark, sf):
    return hs.fail_stale(I.scans(spark, sf), now("1999-06-01 00:00:00")).select(
        "scan_id", "status", "verdict", F.coalesce("error_code", F.lit("")).alias("error_code")
    )


_FAILURES = "SELECT o_orderkey AS scan_id, 'parse_timeout' AS code, repeat('boom ', 900) AS message, o_orderdate AS at FROM orders WHERE o_totalprice > 300000"


@query(
    "H11_mark_failed",
    f"{S}, f AS ({_FAILURES}) SELECT scan_id, CASE WHEN code IS NULL THEN status ELSE 'failed' END AS status, CASE WHEN code IS NULL THEN 0 ELSE 1 END AS retry_count, CASE WHEN code IS NULL THEN length(error_message) ELSE 4000 END AS error_length FROM scans LEFT JOIN f USING (scan_id)",
)
def _(spark, sf):
    base = I.scans(spark, sf).withColumn("retry_count", F.lit(0))
    updated, _ = hs.mark_failed(base, I.derived(spark, sf, _FAILURES, "orders"))
    return updated.select("scan_id", "status", "retry_count", F.length("error_message").alias("error_length"))


_REVIEWS = "SELECT l_orderkey AS scan_id, CASE l_linenumber % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'malicious' ELSE 'suspicious' END AS verdict, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE concat('note ', CAST(l_partkey AS STRING)) END AS note, l_shipdate AS noted_at FROM lineitem WHERE l_returnflag = 'R'"
_REVIEWED = "r AS (SELECT scan_id, verdict AS rv, note FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY noted_at DESC, verdict DESC, note DESC) rn FROM rev) WHERE rn = 1)"


def reviews(spark, sf):
    return I.derived(spark, sf, _REVIEWS, "lineitem").withColumnRenamed("noted_at", "at")


@query(
    "H12_reviews",
    f"{S}, rev AS ({_REVIEWS}), {_REVIEWED} SELECT scan_id, coalesce(rv, verdict) AS verdict, rv IS NOT NULL AS reviewed, coalesce(note, '') AS note, CASE WHEN rv = 'clean' THEN false ELSE quarantined END AS quarantined FROM scans LEFT JOIN r USING (scan_id)",
)
def _(spark, sf):
    updated, _ = hs.apply_reviews(I.scans(spark, sf), reviews(spark, sf))
    return updated.select(
        "scan_id", "verdict", "reviewed", F.coalesce("review_note", F.lit("")).alias("note"), "quarantined"
    )


@query("H13_rescan_reset", f"{S} SELECT scan_id, CASE WHEN scan_id % 4 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN scan_id % 4 = 0 THEN '' ELSE error_message END AS error_message FROM scans")
def _(spark, sf):
    rows = I.scans(spark, sf)
    return hs.reset_for_rescan(rows, rows.where("scan_id % 4 = 0")).select(
        "scan_id", "status", F.coalesce("error_message", F.lit("")).alias("error_message")
    )


@query("H14_delete", f"{S}, i AS ({I.SCAN_INDICATORS_SELECT}) SELECT 'scans' AS name, count(*) AS n FROM scans WHERE scan_id % 3 <> 0 UNION ALL SELECT 'indicators', count(*) FROM i WHERE scan_id NOT IN (SELECT scan_id FROM scans WHERE scan_id % 3 = 0)")
def _(spark, sf):
    rows = I.scans(spark, sf)
    left = hs.delete_scans(
        {"scans": rows, "indicators": I.scan_indicators(spark, sf)}, rows.where("scan_id % 3 = 0")
    )
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in left.items()]
    return parts[0].unionByName(parts[1])


@query("H15_audit_events", f"{S}, rev AS ({_REVIEWS}), {_REVIEWED} SELECT scan_id, 'scan.reviewed' AS event, CASE WHEN note <> '' THEN note ELSE 'Verdict changed to ' || rv END AS message, verdict AS was FROM scans JOIN r USING (scan_id)")
def _(spark, sf):
    _, events = hs.apply_reviews(I.scans(spark, sf), reviews(spark, sf))
    return events.select("scan_id", "event", "message", F.get_json_object("payload", "$.from").alias("was"))


@query(
    "H16_detail",
    f"""{S}, i AS ({I.SCAN_INDICATORS_SELECT}), a AS ({I.ASSESSMENTS_SELECT}), il AS (SELECT scan_id, string_agg(code || '=' || weight, ',' ORDER BY weight DESC, code) AS indicators FROM i GROUP BY 1),
    la AS (SELECT scan_id, call_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY created_at DESC, call_id DESC) rn FROM a) WHERE rn = 1)
    SELECT s.scan_id, coalesce(indicators, '') AS indicators, coalesce(call_id, -1) AS call_id FROM scans s LEFT JOIN il USING (scan_id) LEFT JOIN la USING (scan_id)""",
)
def _(spark, sf):
    rows = hs.detail(I.scans(spark, sf), None, I.scan_indicators(spark, sf), I.assessments(spark, sf))
    listed = F.transform("indicators", lambda i: F.concat(i["code"], F.lit("="), i["weight"].cast("string")))
    return rows.select(
        "scan_id", F.coalesce(F.array_join(listed, ","), F.lit("")).alias("indicators"),
        F.coalesce("ai_call_id", F.lit(-1)).alias("call_id"),
    )


_LIFE = "SELECT user_id AS scan_id, event_id, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'analyzing' WHEN 'signup' THEN 'ai_review' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events"


@query("H17_lifecycle", f"WITH l AS ({_LIFE}) SELECT scan_id, status FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, event_id DESC) rn FROM l) WHERE rn = 1")
def _(spark, sf):
    return hs.lifecycle_status(I.derived(spark, sf, _LIFE, "events")).select("scan_id", "status")


@query(
    "H17_time_in_state",
    f"""WITH l AS ({_LIFE}), n AS (SELECT *, lead(ts) OVER (PARTITION BY scan_id ORDER BY ts, event_id) AS left_at FROM l)
    SELECT scan_id, status, count(*) AS stays, sum(epoch_us(left_at) - epoch_us(ts))::BIGINT AS micros
    FROM n WHERE left_at IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    found = hs.seconds_in_state(I.derived(spark, sf, _LIFE, "events"))
    return found.select("scan_id", "status", "stays", F.round(F.col("seconds") * 1e6).cast("bigint").alias("micros"))


@query(
    "H8_prune_half",
    f"""{S}, c AS (SELECT created_at FROM scans ORDER BY created_at DESC LIMIT 1 OFFSET (SELECT count(*) // 2 - 1 FROM scans))
    SELECT scan_id FROM scans WHERE NOT (created_at < (SELECT created_at FROM c) AND NOT quarantined)""",
)
def _(spark, sf):
    rows = I.scans(spark, sf)
    return hs.pruned(rows, rows.count() // 2).select("scan_id")


@query("H18_quarantine", f"{S}, rev AS ({_REVIEWS}), {_REVIEWED} SELECT scan_id, coalesce(rv, verdict) = 'malicious' AND rv IS NULL AS quarantine FROM scans LEFT JOIN r USING (scan_id)")
def _(spark, sf):
    updated, _ = hs.apply_reviews(I.scans(spark, sf), reviews(spark, sf))
    return hs.quarantine_decisions(updated).select("scan_id", "quarantine")


@query("H19_alerts", f"{S} SELECT scan_id, 'any' AS minimum FROM scans WHERE verdict IN ('suspicious', 'malicious') UNION ALL SELECT scan_id, 'malicious' FROM scans WHERE verdict = 'malicious'")
def _(spark, sf):
    rows = I.scans(spark, sf)
    return hs.alerts(rows).select("scan_id", F.lit("any").alias("minimum")).unionByName(
        hs.alerts(rows, "malicious").select("scan_id", F.lit("malicious").alias("minimum"))
    )


@query("H20_listing", f"{S} SELECT scan_id, filename FROM scans WHERE contains(lower(filename), 'report_2') ORDER BY verdict DESC, scan_id")
def _(spark, sf):
    return hs.listing(I.scans(spark, sf), "Report_2", "verdict").select("scan_id", "filename")


@query(
    "H21_failed_not_clean",
    f"""{S} SELECT scan_id, CASE WHEN scan_id % 5 = 0 THEN '' WHEN scan_id % 5 = 1 THEN 'The scan of this file failed, so nothing in it was checked. It may be unsafe.' || CASE WHEN error_message <> '' THEN chr(10) || chr(10) || 'Reason: ' || string_split(error_message, chr(10))[1] ELSE '' END
      WHEN summary <> '' THEN '' ELSE 'The scan found nothing suspicious.' END AS note FROM scans""",
)
def _(spark, sf):
    status = F.when(F.expr("scan_id % 5 = 1"), "failed").otherwise(F.col("status"))
    count = F.when(F.expr("scan_id % 5 = 0"), 2).otherwise(0)
    return I.scans(spark, sf).select(
        "scan_id", hs.findings_note(status, F.col("summary"), F.col("error_message"), count).alias("note")
    )


@query("history_constraints", f"{S} SELECT count(*) AS violations FROM scans WHERE risk_score NOT BETWEEN 0 AND 100 OR file_size < 0")
def _(spark, sf):
    return hs.constraint_violations(I.scans(spark, sf)).agg(F.count("*").alias("violations"))


# -------------------------------------------------------------------- budget
A = f"WITH a AS ({I.ASSESSMENTS_SELECT})"
_USAGE = "u AS (SELECT CAST(created_at AS DATE) AS day, sum(tokens)::BIGINT AS tokens FROM a WHERE tokens > 0 GROUP BY 1)"
_DAY = "2024-01-10"


def usage(spark, sf):
    return bg.daily_usage(I.assessments(spark, sf))


@query("B1_daily_usage", f"{A}, {_USAGE} SELECT day::STRING AS day, tokens FROM u")
def _(spark, sf):
    return usage(spark, sf).select(F.col("day").cast("string").alias("day"), "tokens")


@query("B2_used_on_day", f"{A}, {_USAGE} SELECT coalesce(sum(tokens), 0)::BIGINT AS used FROM u WHERE day = DATE '{_DAY}'")
def _(spark, sf):
    return bg.used_on(usage(spark, sf), F.lit(_DAY).cast("date"))


@query("B3_has_budget", f"{A}, {_USAGE} SELECT day::STRING AS day, tokens < 150000 AS allowed, true AS unlimited FROM u")
def _(spark, sf):
    return usage(spark, sf).select(
        F.col("day").cast("string").alias("day"),
        bg.has_budget(F.col("tokens"), 150000).alias("allowed"),
        bg.has_budget(F.col("tokens"), 0).alias("unlimited"),
    )


@query("B4_remaining", f"{A}, {_USAGE} SELECT day::STRING AS day, greatest(0, 150000 - tokens) AS remaining FROM u")
def _(spark, sf):
    return usage(spark, sf).select(
        F.col("day").cast("string").alias("day"), bg.remaining(F.col("tokens"), 150000).alias("remaining")
    )


@query(
    "B5_call_admission",
    f"{A}, t AS (SELECT call_id, coalesce(sum(greatest(0, tokens)) OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before FROM a) SELECT call_id, tokens_before, tokens_before < 60000 AS admitted FROM t",
)
def _(spark, sf):
    return bg.admit_calls(I.assessments(spark, sf), 60000).select("call_id", "tokens_before", "admitted")


@query("B6_retention", f"{A}, {_USAGE} SELECT day::STRING AS day FROM u WHERE day >= DATE '2024-01-31' - 7")
def _(spark, sf):
    kept = bg.retained(usage(spark, sf), F.lit("2024-01-31").cast("date"))
    return kept.select(F.col("day").cast("string").alias("day"))
