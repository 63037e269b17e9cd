"""Labelled evaluation, gate planning, paired results and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.catalog import fragments as X
from papersieve.catalog.registry import query
from papersieve.operators import evaluate as ev
from papersieve.operators import metrics as mt
from papersieve.operators import planning as pl
from papersieve.operators.gate import replays_gate
from papersieve.plans import inputs as I

OK = "scored AS (SELECT *, length(list_filter(string_split(codes, ';'), lambda c: c <> '')) > 0 AND length(list_filter(string_split(codes, ';'), lambda c: c <> '' AND c <> 'PDF_PARSE_FAILURE')) = 0 AS parse_only FROM results WHERE is_pdf AND error = '')"
BASE = f"WITH {X.RESULTS}, {OK}"


def _values(name: str, values) -> str:
    return f"(VALUES {', '.join(f'({v})' for v in values)}) AS v({name})"


def _matrix(flag: str) -> str:
    return (
        f"count(*) FILTER (WHERE label = 'malware' AND {flag}) AS tp, count(*) FILTER (WHERE label <> 'malware' AND {flag}) AS fp, "
        f"count(*) FILTER (WHERE label <> 'malware' AND NOT {flag}) AS tn, count(*) FILTER (WHERE label = 'malware' AND NOT {flag}) AS fn"
    )


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("V1_confusion_at_80", f"{BASE} SELECT {_matrix('(score >= 80)')} FROM scored")
def _(spark, sf):
    return ev.confusion(I.results(spark, sf), (80,)).drop("threshold")


_SWEEP = f"SELECT threshold, {_matrix('(score >= threshold)')} FROM scored, {_values('threshold', K.THRESHOLDS)} GROUP BY threshold"


@query("V2_threshold_sweep", f"{BASE} {_SWEEP}")
def _(spark, sf):
    return ev.confusion(I.results(spark, sf))


@query(
    "V3_strict_confusion",
    f"{BASE} SELECT threshold, {_matrix('(score >= threshold AND NOT parse_only)')} FROM scored, {_values('threshold', K.THRESHOLDS)} GROUP BY threshold",
)
def _(spark, sf):
    return ev.confusion(I.results(spark, sf), strict=True)


@query(
    "V4_rates",
    f"""{BASE}, m AS ({_SWEEP}), r AS (SELECT threshold, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r, coalesce(tn / nullif(tn + fp, 0), 0.0) AS s, coalesce(fp / nullif(tn + fp, 0), 0.0) AS f, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0) AS a FROM m)
    SELECT threshold, round(p::DOUBLE, 6) AS "precision", round(r::DOUBLE, 6) AS recall, round(s::DOUBLE, 6) AS specificity, round(f::DOUBLE, 6) AS fpr, round(a::DOUBLE, 6) AS accuracy, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0)::DOUBLE, 6) AS f1 FROM r""",
)
def _(spark, sf):
    rates = ev.with_rates(ev.confusion(I.results(spark, sf))).drop("tp", "fp", "tn", "fn")
    return rounded(rates, "precision", "recall", "specificity", "fpr", "accuracy", "f1")


@query(
    "V5_product_bands",
    f"{BASE} SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS flagged, count(*) AS clean, round((count(*) FILTER (WHERE score >= threshold))::DOUBLE / count(*), 6) AS rate FROM scored, {_values('threshold', K.PRODUCT_BANDS)} WHERE label = 'clean' GROUP BY threshold",
)
def _(spark, sf):
    return rounded(ev.product_bands(I.results(spark, sf)), "rate")


@query(
    "V6_corpus_counts",
    f"{BASE} SELECT dataset, label, count(*) AS files FROM scored GROUP BY 1, 2 UNION ALL SELECT '(total)', '(all)', count(*) FROM scored",
)
def _(spark, sf):
    return ev.corpus_counts(I.results(spark, sf))


@query(
    "V7_exclusions",
    f"WITH {X.RESULTS} SELECT count(*) FILTER (WHERE NOT is_pdf) AS non_pdf, count(*) FILTER (WHERE error <> '') AS errors, count(*) FILTER (WHERE is_pdf AND error = '' AND text_source = 'ocr') AS text_ocr, count(*) FILTER (WHERE is_pdf AND error = '' AND text_source = 'extracted') AS text_extracted, count(*) FILTER (WHERE is_pdf AND error = '' AND text_source = 'none') AS text_none FROM results",
)
def _(spark, sf):
    return ev.exclusions(I.results(spark, sf))


@query(
    "V8_parse_only_share",
    f"{BASE} SELECT count(*) FILTER (WHERE parse_only) AS parse_only, count(*) AS malware, round((count(*) FILTER (WHERE parse_only))::DOUBLE / count(*), 6) AS share FROM scored WHERE label = 'malware'",
)
def _(spark, sf):
    return rounded(ev.parse_only_share(I.results(spark, sf)), "share")


_HITS = "hits AS (SELECT label, code, count(*) AS docs FROM (SELECT DISTINCT doc_id, label, unnest(string_split(codes, ';')) AS code FROM scored) WHERE code <> '' GROUP BY 1, 2), totals AS (SELECT label, count(*) AS total FROM scored GROUP BY 1)"


@query(
    "V9_top_indicators",
    f"{BASE}, {_HITS} SELECT label, code, docs, round(docs::DOUBLE / total, 6) AS rate, row_number() OVER (PARTITION BY label ORDER BY docs DESC, code)::INT AS place FROM hits JOIN totals USING (label) QUALIFY place <= 15",
)
def _(spark, sf):
    return rounded(ev.top_codes(I.results(spark, sf)), "rate").drop("label_total")


@query(
    "V10_discrimination",
    f"""{BASE}, {_HITS}, r AS (SELECT code, coalesce(max(docs::DOUBLE / total) FILTER (WHERE label = 'malware'), 0.0) AS m, coalesce(max(docs::DOUBLE / total) FILTER (WHERE label = 'clean'), 0.0) AS c FROM hits JOIN totals USING (label) GROUP BY 1)
    SELECT code, round(m::DOUBLE, 6) AS malware_rate, round(c::DOUBLE, 6) AS clean_rate, CASE WHEN c = 0 THEN -1.0::DOUBLE ELSE round(m::DOUBLE / c::DOUBLE, 6) END AS discrimination FROM r""",
)
def _(spark, sf):
    rates = ev.discrimination(I.results(spark, sf))
    shown = F.when(F.col("clean_rate") == 0, -1.0).otherwise(F.col("discrimination"))
    return rounded(rates.withColumn("discrimination", shown), "malware_rate", "clean_rate", "discrimination")


@query(
    "V11_worst_clean",
    f"{BASE}, w AS (SELECT path, score FROM scored WHERE label = 'clean' AND score >= 80) SELECT path, score, (SELECT greatest(0, count(*) - 40) FROM w)::BIGINT AS not_shown FROM w ORDER BY score DESC, path LIMIT 40",
)
def _(spark, sf):
    return ev.worst_clean(I.results(spark, sf)).select("path", "score", "not_shown")


@query(
    "V12_escape_cutoffs",
    f"""{BASE}, c AS (SELECT cutoff, count(*) FILTER (WHERE label = 'malware' AND obfuscated_names >= cutoff) AS malware, count(*) FILTER (WHERE label = 'clean' AND obfuscated_names >= cutoff) AS benign, count(*) FILTER (WHERE label = 'malware') AS mt, count(*) FILTER (WHERE label = 'clean') AS bt FROM scored, {_values('cutoff', K.ESCAPE_CUTOFFS)} GROUP BY 1)
    SELECT cutoff, malware, benign, round(malware::DOUBLE / mt, 6) AS malware_rate, round(benign::DOUBLE / bt, 6) AS benign_rate, round((malware::DOUBLE / mt) / (benign::DOUBLE / bt), 6) AS rate_ratio FROM c""",
)
def _(spark, sf):
    return rounded(ev.escape_cutoffs(I.results(spark, sf)), "malware_rate", "benign_rate", "rate_ratio")


@query("V13_throughput", f"WITH {X.RESULTS} SELECT count(*) AS files, round(count(*) / 4.0::DOUBLE, 6) AS files_per_second FROM results")
def _(spark, sf):
    return rounded(ev.throughput(I.results(spark, sf), 4.0), "files_per_second")


# ------------------------------------------------------------- gate planning
_COST = "0.0165::DOUBLE"


@query(
    "A1_gate_volume",
    f"WITH {X.RESULTS} SELECT count(*) FILTER (WHERE label = 'clean') AS clean_calls, count(*) FILTER (WHERE label = 'malware') AS malware_calls, count(*) AS calls, round(count(*) * {_COST}, 6) AS cost_usd FROM results WHERE score >= 25 AND score < 85",
)
def _(spark, sf):
    return rounded(pl.gate_volume(I.results(spark, sf)), "cost_usd")


@query(
    "A2_quarantined_false_positives",
    f"WITH {X.RESULTS} SELECT count(*) AS false_positives, count(*) FILTER (WHERE score < 85) AS visible, count(*) FILTER (WHERE score >= 85) AS invisible FROM results WHERE label = 'clean' AND score >= 80",
)
def _(spark, sf):
    return pl.quarantined_false_positives(I.results(spark, sf))


@query(
    "A3_thin_evidence",
    f"""WITH {X.RESULTS}, c AS (SELECT max_indicators, count(*) FILTER (WHERE label = 'clean' AND score >= 80 AND n_indicators <= max_indicators) AS fps_reached, count(*) FILTER (WHERE label = 'malware' AND score >= 85 AND n_indicators <= max_indicators) AS extra_malware_calls FROM results, {_values('max_indicators', K.THIN_LIMITS)} GROUP BY 1)
    SELECT *, round((fps_reached + extra_malware_calls) * {_COST}, 6) AS cost_usd FROM c""",
)
def _(spark, sf):
    return rounded(pl.thin_evidence(I.results(spark, sf)), "cost_usd")


@query(
    "A4_indicator_histogram",
    f"WITH {X.RESULTS} SELECT n_indicators, count(*) FILTER (WHERE label = 'clean') AS false_positives, count(*) FILTER (WHERE label = 'malware') AS true_positives FROM results WHERE score >= 80 GROUP BY 1",
)
def _(spark, sf):
    return pl.indicator_histogram(I.results(spark, sf))


# ------------------------------------------------------------------ sampling
_QUOTAS = [max(1, round(60 * s)) for _, s in K.SAMPLE_SHARES]
_SAMPLE = f"""{X.RESULTS}, tests AS (SELECT *, unnest([
  CASE WHEN label = 'clean' AND score >= 80 THEN 0 END, CASE WHEN label = 'malware' AND score >= 80 AND n_indicators <= 3 THEN 1 END,
  CASE WHEN label = 'malware' AND score >= 90 THEN 2 END, CASE WHEN label = 'malware' AND score >= 80 AND score < 90 THEN 3 END,
  CASE WHEN label = 'malware' AND score >= 50 AND score < 80 THEN 4 END, CASE WHEN label = 'clean' AND score >= 20 AND score < 80 THEN 5 END]) AS bucket FROM results),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(path || '|20260803'), path) AS rn FROM tests WHERE bucket IS NOT NULL),
placed AS (SELECT *, list_extract({_QUOTAS}, bucket + 1) AS quota FROM ranked),
spent AS (SELECT count(*) AS n FROM placed WHERE rn <= quota),
later AS (SELECT path, bucket, rn, row_number() OVER (ORDER BY bucket, rn) AS extra FROM placed WHERE rn > quota),
sample AS (SELECT path, bucket::INT AS bucket, rn::INT AS rn, false AS redistributed FROM placed WHERE rn <= quota
  UNION ALL SELECT path, bucket::INT, rn::INT, true FROM later, spent WHERE n + extra <= 60)"""


@query("P1_stratified_quota", f"WITH {_SAMPLE} SELECT path, bucket, rn FROM sample WHERE NOT redistributed")
def _(spark, sf):
    chosen = pl.stratified_sample(I.results(spark, sf), 60)
    return chosen.where(~F.col("redistributed")).select("path", "bucket", "rn")


@query("P2_redistributed", f"WITH {_SAMPLE} SELECT path, bucket, rn, redistributed FROM sample")
def _(spark, sf):
    return pl.stratified_sample(I.results(spark, sf), 60).select("path", "bucket", "rn", "redistributed")


@query("P3_interleaved", f"WITH {_SAMPLE} SELECT path, bucket, row_number() OVER (ORDER BY rn, bucket)::INT AS position FROM sample")
def _(spark, sf):
    return pl.interleaved(pl.stratified_sample(I.results(spark, sf), 60)).select("path", "bucket", "position")


@query(
    "P4_stop_after_failures",
    """WITH c AS (SELECT event_id, event_type IN ('error', 'view', 'click') AS failed FROM events),
    g AS (SELECT event_id, failed, event_id - row_number() OVER (PARTITION BY failed ORDER BY event_id) AS island FROM c),
    r AS (SELECT event_id, row_number() OVER (PARTITION BY island ORDER BY event_id) AS run FROM g WHERE failed)
    SELECT event_id FROM c WHERE event_id <= (SELECT coalesce(min(event_id), 1000000000) FROM r WHERE run >= 5)""",
)
def _(spark, sf):
    failed = F.when(F.col("event_type").isin("error", "view", "click"), "failed").otherwise("")
    calls = I.table(spark, sf, "events").withColumn("error", failed)
    return pl.stop_after_failures(calls, "event_id").select("event_id")


@query(
    "P5_failure_warning",
    f"WITH {X.CHANGES} SELECT count(*) FILTER (WHERE error <> '') AS failed, count(*) AS planned, count(*) FILTER (WHERE error <> '') > count(*) * 0.1 AS warn FROM changes",
)
def _(spark, sf):
    return pl.failure_warning(I.changes(spark, sf))


_CELLS = "(VALUES ('tp', 'malware', true), ('fp', 'clean', true), ('tn', 'clean', false), ('fn', 'malware', false)) AS v(cell, l, flag)"


@query(
    "P6_paired_confusion",
    f"""WITH {X.CHANGES}, k AS (SELECT * FROM changes WHERE error = ''), b AS (SELECT cell, count(*) FILTER (WHERE label = l AND (static_score >= 80) = flag) AS "before", count(*) FILTER (WHERE label = l AND (ai_score >= 80) = flag) AS "after" FROM k, {_CELLS} GROUP BY 1)
    SELECT *, "after" - "before" AS delta FROM b""",
)
def _(spark, sf):
    return pl.paired_confusion(I.changes(spark, sf))


@query(
    "P7_corrections",
    f"WITH {X.CHANGES} SELECT count(*) FILTER (WHERE label = 'clean') AS fps_corrected, count(*) FILTER (WHERE label = 'malware') AS tps_lost FROM changes WHERE static_score >= 80 AND ai_score < 80",
)
def _(spark, sf):
    return pl.corrections(I.changes(spark, sf))


@query(
    "P8_clean_drift",
    f"WITH {X.CHANGES} SELECT round(avg(ai_score - static_score), 6) AS drift, count(*) FILTER (WHERE ai_score > static_score) AS pushed_up, count(*) FILTER (WHERE ai_score > static_score AND ai_score >= 70) AS near_quarantine, count(*) AS clean_files FROM changes WHERE label = 'clean' AND error = ''",
)
def _(spark, sf):
    return rounded(pl.clean_drift(I.changes(spark, sf)), "drift")


@query(
    "P9_spread",
    f"""WITH {X.CHANGES}, a AS (SELECT * FROM changes WHERE error = '' AND model_said <> ''), s AS (SELECT ai_score, count(*) AS n FROM a GROUP BY 1)
    SELECT count(*) AS distinct_scores, sum(n)::BIGINT AS scored, (SELECT ai_score FROM s ORDER BY n DESC, ai_score LIMIT 1) AS modal_score, max(n) AS modal_count, (SELECT count(DISTINCT model_said) FROM a) AS labels,
      max(n) > sum(n) * 0.6 OR (SELECT count(DISTINCT model_said) FROM a) = 1 AS constant_answer FROM s HAVING sum(n) >= 5""",
)
def _(spark, sf):
    return pl.spread(I.changes(spark, sf))


@query("P9_label_counts", f"WITH {X.CHANGES} SELECT model_said, count(*) AS n FROM changes WHERE error = '' AND model_said <> '' GROUP BY 1")
def _(spark, sf):
    return pl.label_counts(I.changes(spark, sf))


_MOVED = f"{X.CHANGES}, named AS (SELECT *, {X.verdict('static_score')} AS sv, {X.verdict('ai_score')} AS av FROM changes)"


def with_verdicts(spark, sf):
    from papersieve.operators.scoring import verdict_of

    return I.changes(spark, sf).withColumns(
        {"static_verdict": verdict_of(F.col("static_score")), "ai_verdict": verdict_of(F.col("ai_score"))}
    )


@query("P10_verdict_moves", f"WITH {_MOVED} SELECT file, label, sv AS static_verdict, av AS ai_verdict, static_score FROM named WHERE error = '' AND sv <> av ORDER BY static_score DESC, file LIMIT 40")
def _(spark, sf):
    return pl.verdict_moves(with_verdicts(spark, sf)).select("file", "label", "static_verdict", "ai_verdict", "static_score")


@query("P10_run_totals", f"WITH {_MOVED} SELECT sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE error <> '') AS errors, count(*) FILTER (WHERE error = '' AND sv <> av) AS moved FROM named")
def _(spark, sf):
    return pl.run_totals(with_verdicts(spark, sf))


_GATE = "(static_score >= 25 AND (static_score < 85 OR indicators <= 3))"


@query("P11_gate_replay", f"WITH {X.CHANGES} SELECT doc_id, {_GATE} AS consulted FROM changes")
def _(spark, sf):
    return I.changes(spark, sf).select(
        "doc_id", replays_gate(F.col("static_score"), F.col("indicators")).alias("consulted")
    )


@query(
    "P12_gate_modes",
    f"""WITH {X.CHANGES}, k AS (SELECT *, CASE WHEN {_GATE} THEN ai_score ELSE static_score END AS shipped FROM changes WHERE error = '')
    SELECT cell, count(*) FILTER (WHERE label = l AND (static_score >= 80) = flag) AS static_n, count(*) FILTER (WHERE label = l AND (ai_score >= 80) = flag) AS forced_n, count(*) FILTER (WHERE label = l AND (shipped >= 80) = flag) AS shipped_n FROM k, {_CELLS} GROUP BY 1""",
)
def _(spark, sf):
    return pl.gate_modes(I.changes(spark, sf))


@query("P12_consulted_share", f"WITH {X.CHANGES} SELECT count(*) AS files, count(*) FILTER (WHERE {_GATE}) AS consulted, round((count(*) FILTER (WHERE {_GATE}))::DOUBLE / count(*), 6) AS share FROM changes WHERE error = ''")
def _(spark, sf):
    return rounded(pl.consulted_share(I.changes(spark, sf)), "share")


_CROSS = "static_score >= 80 AND ai_score < 80"


@query(
    "P13_gate_effect",
    f"WITH {X.CHANGES} SELECT count(*) FILTER (WHERE {_GATE} AND label = 'clean' AND {_CROSS}) AS corrected, count(*) FILTER (WHERE {_GATE} AND label = 'malware' AND {_CROSS}) AS lost, count(*) FILTER (WHERE {_GATE} AND label = 'malware' AND static_score < 80 AND ai_score >= 80) AS recovered, count(*) FILTER (WHERE NOT {_GATE} AND label = 'clean' AND {_CROSS}) AS missed FROM changes WHERE error = ''",
)
def _(spark, sf):
    return pl.gate_effect(I.changes(spark, sf))


@query("P13_missed", f"WITH {X.CHANGES} SELECT file, static_score, indicators FROM changes WHERE error = '' AND label = 'clean' AND {_CROSS} AND NOT {_GATE} ORDER BY static_score DESC, file LIMIT 15")
def _(spark, sf):
    return pl.missed_corrections(I.changes(spark, sf)).select("file", "static_score", "indicators")


# ------------------------------------------------------------------- metrics
@query("M1_indicator_counter", f"WITH {X.UNIQUE_INDICATORS} SELECT code, severity, count(*) AS total FROM raw_ind GROUP BY 1, 2")
def _(spark, sf):
    return mt.counter(I.event_indicators(spark, sf), "code", "severity")


@query("M1_token_counter", f"WITH a AS ({I.ASSESSMENTS_SELECT}) SELECT provider, succeeded, sum(tokens)::BIGINT AS total FROM a GROUP BY 1, 2")
def _(spark, sf):
    return mt.counter(I.assessments(spark, sf), "provider", "succeeded", value=F.col("tokens"))


def _histogram(name: str, value: str, edges, source: str, select: str, table: str) -> None:
    @query(
        name,
        f"WITH s AS ({select}) SELECT le::DOUBLE AS le, count(*) FILTER (WHERE {value} <= le::DOUBLE) AS n FROM s, {_values('le', edges)} GROUP BY 1",
    )
    def _(spark, sf):
        return mt.histogram(I.derived(spark, sf, select, table), F.expr(value), edges)


_histogram("M2_score_histogram", "risk_score", K.SCORE_EDGES, "scans", I.SCANS_SELECT, "orders")
_histogram("M2_duration_histogram", "duration_ms / 1000.0", K.DURATION_EDGES, "scans", I.SCANS_SELECT, "orders")
_histogram("M2_latency_histogram", "latency", K.LATENCY_EDGES, "assessments", I.ASSESSMENTS_SELECT, "events")


@query(
    "M3_snapshot",
    f"""WITH a AS ({I.ASSESSMENTS_SELECT}), {X.EVENT_INDICATORS}
    SELECT 'calls_total{{outcome=' || succeeded || ',provider=' || provider || '}}' AS metric, count(*)::DOUBLE AS value FROM a GROUP BY succeeded, provider
    UNION ALL SELECT 'indicators_total{{indicator=' || code || ',severity=' || severity || '}}', count(*)::DOUBLE FROM raw_ind GROUP BY code, severity
    UNION ALL SELECT 'latency_count', count(latency)::DOUBLE FROM a""".replace("{{", "{").replace("}}", "}"),
)
def _(spark, sf):
    calls = I.assessments(spark, sf).withColumnRenamed("succeeded", "outcome")
    found = I.event_indicators(spark, sf).withColumnRenamed("code", "indicator")
    count = mt.summary(calls, F.col("latency")).select(F.col("count").alias("total"))
    return (
        mt.snapshot("calls_total", mt.counter(calls, "provider", "outcome"), "provider", "outcome")
        .unionByName(mt.snapshot("indicators_total", mt.counter(found, "indicator", "severity"), "indicator", "severity"))
        .unionByName(mt.snapshot("latency_count", count))
    )
