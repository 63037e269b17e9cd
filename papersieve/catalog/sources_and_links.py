"""Sources, sinks, admission and URL analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.catalog import fragments as X
from papersieve.catalog.registry import query
from papersieve.functions import links as ln
from papersieve.operators import history as hs
from papersieve.operators.evaluate import label_of, report
from papersieve.plans import inputs as I
from papersieve.session import checkpoint_dir, staged
from papersieve.sources import files as fs
from papersieve.sources import tables as tb
from papersieve.sources.store import APPENDED, REPLACED, ResultStore

_DATASET = "CASE doc_id % 4 WHEN 0 THEN concat(source, '_Malware') WHEN 1 THEN concat('clean_', source) WHEN 2 THEN concat('CLEAN_malware_', source) ELSE source END"
_LABEL = "CASE doc_id % 4 WHEN 0 THEN 'malware' WHEN 1 THEN 'clean' WHEN 2 THEN 'malware' END"


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def corpus(spark, sf):
    return I.table(spark, sf, "documents").select(
        F.format_string("%s/%08d", "source", "doc_id").alias("path"),
        F.expr(_DATASET).alias("dataset"), "text", "doc_id",
    ).withColumn("label", label_of(F.col("dataset")))


@query("S1_read_folder")
def _(spark, sf):
    """The table files themselves, read as binary input."""
    return fs.with_ids(fs.read_folder(spark, sf, True, "*.parquet")).select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "length",
        F.md5("content").alias("md5"),
    )


@query("S2_corpus_labels", f"SELECT {_DATASET} AS dataset, {_LABEL} AS label, count(*) AS n FROM documents WHERE doc_id % 4 <> 3 GROUP BY 1, 2")
def _(spark, sf):
    return fs.labelled(corpus(spark, sf)).groupBy("dataset", "label").agg(F.count("*").alias("n"))


@query("S3_unlabelled", f"SELECT DISTINCT {_DATASET} AS dataset FROM documents WHERE doc_id % 4 = 3")
def _(spark, sf):
    return fs.unlabelled_datasets(corpus(spark, sf))


_SUBMITTED = "CASE WHEN doc_id % 20 = 0 THEN '' WHEN doc_id % 20 = 1 THEN text ELSE concat(repeat(' ', CAST(doc_id % 1100 AS INT)), '%PDF-1.4', text) END"


@query(
    "S4_admission",
    f"""WITH s AS (SELECT doc_id, {_SUBMITTED} AS t FROM documents)
    SELECT doc_id, CASE WHEN strlen(t) = 0 THEN 'validation_error' WHEN strlen(t) > 9000 THEN 'file_too_large' WHEN instr(left(t, 1024), '%PDF-') = 0 THEN 'unsupported_file_type' ELSE 'accepted' END AS outcome FROM s""",
)
def _(spark, sf):
    rows = I.table(spark, sf, "documents").select(
        "doc_id", F.encode(F.expr(_SUBMITTED), "UTF-8").alias("content")
    ).withColumn("length", F.octet_length("content"))
    accepted, rejected = fs.admit(rows, 9000)
    return accepted.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("doc_id", F.col("reject_code").alias("outcome"))
    )


@query("S5_pdf_flag", f"WITH s AS (SELECT {_SUBMITTED} AS t FROM documents) SELECT instr(left(t, 1024), '%PDF-') > 0 AS is_pdf, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf):
    rows = I.table(spark, sf, "documents").select(F.encode(F.expr(_SUBMITTED), "UTF-8").alias("content"))
    return fs.with_pdf_flag(rows).groupBy("is_pdf").agg(F.count("*").alias("n"))


@query("S6_strict_mode", "SELECT count(*) AS n, sum(strlen(text) + 8)::BIGINT AS total FROM documents")
def _(spark, sf):
    rows = I.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.encode(F.concat(F.lit("%PDF-1.4"), "text"), "UTF-8").alias("content"),
    )
    return fs.require_headers(rows).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("total")
    )


@query(
    "S7_limit_per_dataset",
    f"""WITH c AS (SELECT {_DATASET} AS dataset, printf('%s/%08d', source, doc_id) AS path FROM documents)
    SELECT dataset, path, true AS sampled FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY path) rn FROM c) WHERE rn <= 3""",
)
def _(spark, sf):
    return fs.limit_per_dataset(corpus(spark, sf), 3).select("dataset", "path", "sampled")


def _stored(spark, sf):
    rows = I.results(spark, sf)
    return rows.withColumn("verdict", F.lit("clean"))


_CODES = "rtrim(codes, ';')"


@query(
    "S8_results_csv",
    f"WITH {X.RESULTS} SELECT path, dataset, label, score::STRING AS score, {_CODES} AS indicators, error FROM results",
)
def _(spark, sf):
    path = scratch(spark, "results")
    tb.write_results(_stored(spark, sf), path, "csv")
    raw = spark.read.schema(tb.RESULT_CSV_SCHEMA).option("header", True).csv(path)
    return raw.fillna("", ["indicators", "error"]).select("path", "dataset", "label", "score", "indicators", "error")


@query(
    "S9_load_for_planning",
    f"WITH {X.RESULTS} SELECT path, score, length(list_filter(string_split(codes, ';'), lambda c: c <> '')) AS n_indicators FROM results WHERE doc_id % 10 <> 0",
)
def _(spark, sf):
    path = scratch(spark, "results")
    rows = _stored(spark, sf).withColumn("score", F.when(F.expr("doc_id % 10 <> 0"), F.col("score")))
    tb.write_results(rows, path, "csv")
    return tb.read_results(spark, path).select("path", "score", "n_indicators")


@query("S10_load_for_sampling", f"WITH {X.RESULTS} SELECT path, score FROM results WHERE error = ''")
def _(spark, sf):
    path = scratch(spark, "results")
    tb.write_results(_stored(spark, sf), path, "csv")
    return tb.read_results(spark, path, True).select("path", "score")


@query(
    "S11_changes_csv",
    f"WITH {X.CHANGES} SELECT file, label, static_score, ai_score, indicators, model_said, tokens FROM changes WHERE error = ''",
)
def _(spark, sf):
    path = scratch(spark, "changes")
    rows = I.changes(spark, sf).withColumn("static_verdict", F.lit("x")).withColumn("ai_verdict", F.lit("y"))
    tb.write_changes(rows, path)
    return tb.read_changes(spark, path).select(
        "file", "label", "static_score", "ai_score", "indicators", "model_said", "tokens"
    )


@query("S12_report")
def _(spark, sf):
    return report(I.results(spark, sf))


@query(
    "S13_verdict_json",
    f"WITH {X.UNIQUE_INDICATORS} SELECT doc_id AS file, count(*)::INT AS n, first(code ORDER BY weight DESC, code) AS heaviest FROM ind GROUP BY doc_id",
)
def _(spark, sf):
    """Written as JSON lines and read back."""
    from papersieve.operators.scoring import first_per_code, outcomes

    raw = I.event_indicators(spark, sf).withColumn("ord", F.struct("ts", "event_id"))
    scored = outcomes(raw).select(
        "doc_id", "verdict", F.col("score").alias("risk_score"), F.lit("heuristics").alias("decided_by"),
        F.lit(False).alias("used_ai"), F.lit("").alias("summary"),
    )
    features = scored.select("doc_id", F.col("doc_id").alias("file"), F.md5("doc_id").alias("sha256"), F.lit(0).alias("file_size"))
    path = scratch(spark, "verdicts")
    tb.verdict_records(scored, features, first_per_code(raw)).write.json(path)
    read = spark.read.schema("file string, indicators array<struct<code:string,severity:string,weight:int>>").json(path)
    return read.select("file", F.size("indicators").alias("n"), F.col("indicators")[0]["code"].alias("heaviest"))


@query(
    "S14_scan_json",
    f"WITH {X.SCANS}, i AS ({I.SCAN_INDICATORS_SELECT}) SELECT s.scan_id, s.filename, s.risk_score, count(i.code)::INT AS n FROM scans s LEFT JOIN i ON s.scan_id = i.scan_id GROUP BY ALL",
)
def _(spark, sf):
    assess = I.assessments(spark, sf)
    rows = hs.scan_json(hs.detail(I.scans(spark, sf), None, I.scan_indicators(spark, sf), assess))
    body = F.col("json")
    return rows.select(
        "scan_id",
        F.get_json_object(body, "$.filename").alias("filename"),
        F.get_json_object(body, "$.risk_score").cast("int").alias("risk_score"),
        F.coalesce(F.json_array_length(F.get_json_object(body, "$.indicators")), F.lit(0)).alias("n"),
    )


@query("S15_content_key", "SELECT doc_id, substr(s, 1, 2) || '/' || substr(s, 3, 2) || '/' || s || '.pdf' AS key FROM (SELECT doc_id, sha256(text) AS s FROM documents)")
def _(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", hs.content_key(F.sha2("text", 256)).alias("key"))


@query(
    "S16_save_idempotent",
    f"WITH {X.SCANS} SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN 'second' ELSE 'first' END AS run, verdict FROM scans",
)
def _(spark, sf):
    store = ResultStore(spark, scratch(spark, "store"))
    first = I.scans(spark, sf).select("scan_id", "verdict", F.lit("first").alias("run"))
    again = first.where("scan_id % 3 = 0").withColumn("run", F.lit("second"))
    for batch_id, rows in ((0, first), (1, again), (1, again)):
        with store.batch(batch_id) as batch:
            batch.write("scans", rows)
    return store.latest("scans").select("scan_id", "run", "verdict")


class Interrupted(Exception):
    """Stands for whatever ends a run between two tables."""


def one_run(spark: SparkSession, sf: str, run: str) -> dict[str, DataFrame]:
    """The five tables of a run: the second saves a third of the scans again, with fewer findings."""
    scans, found = I.scans(spark, sf), I.scan_indicators(spark, sf)
    told = I.assessments(spark, sf).select("call_id", "scan_id", "provider", "succeeded")
    if run == "second":
        scans, told = scans.where("scan_id % 3 = 0"), told.where("scan_id % 3 = 0")
        found = found.where("scan_id % 3 = 0 AND weight > 20")
    report = scans.select("scan_id", F.lit("structure").alias("section"), F.lit(0).cast("bigint").alias("ord"),
                          F.to_json(F.struct("file_size", "storage_key")).alias("value"))
    events = scans.select("scan_id", F.lit("completed").alias("kind"), "verdict", "created_at")
    tables = {"scans": scans, "reports": report, "indicators": found, "assessments": told, "events": events}
    return {name: rows.withColumn("run", F.lit(run)) for name, rows in tables.items()}


def seen_rows(store: ResultStore, moment: str) -> DataFrame:
    """What readers find per table and scan, written down before the store goes on."""
    parts = []
    for name in (*REPLACED, *APPENDED):
        rows = store.latest(name) if name in REPLACED else store.rows(name)
        parts.append(
            rows.groupBy("scan_id").agg(
                F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("run")), "+").alias("runs")
            ).select(F.lit(moment).alias("moment"), F.lit(name).alias("name"), "scan_id", "n", "runs")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return staged(out)


# What one run holds, table by table, and what of it counts once the second run is in.
_RUN_ROWS = f"""WITH {X.SCANS}, found AS ({I.SCAN_INDICATORS_SELECT}), told AS ({I.ASSESSMENTS_SELECT}),
r AS (
  SELECT 'scans' AS name, scan_id, 0 AS weight FROM scans UNION ALL SELECT 'reports', scan_id, 0 FROM scans
  UNION ALL SELECT 'indicators', scan_id, weight FROM found UNION ALL SELECT 'assessments', scan_id, 0 FROM told
  UNION ALL SELECT 'events', scan_id, 0 FROM scans),
runs AS (
  SELECT *, 'first' AS run FROM r
  UNION ALL SELECT *, 'second' FROM r WHERE scan_id % 3 = 0 AND (name <> 'indicators' OR weight > 20)),
counted AS (
  SELECT 'interrupted' AS moment, name, scan_id, run FROM runs WHERE run = 'first'
  UNION ALL
  SELECT 'replayed', name, scan_id, run FROM runs
  WHERE name IN ('assessments', 'events') OR run = CASE WHEN scan_id % 3 = 0 THEN 'second' ELSE 'first' END)
SELECT moment, name, scan_id, count(*) AS n, string_agg(DISTINCT run, '+' ORDER BY run) AS runs
FROM counted GROUP BY ALL"""


@query("S16_atomic_save", _RUN_ROWS)
def _(spark, sf):
    store = ResultStore(spark, scratch(spark, "atomic"))
    with store.batch(0) as batch:
        batch.write_all(one_run(spark, sf, "first"))
    second = one_run(spark, sf, "second")
    try:
        with store.batch(1) as batch:
            for name in ("scans", "reports"):
                batch.write(name, second[name])
            raise Interrupted
    except Interrupted:
        pass
    between = seen_rows(store, "interrupted")
    for _ in range(2):
        with store.batch(1) as batch:
            batch.write_all(second)
    return between.unionByName(seen_rows(store, "replayed"))


@query("S17_column_caps", "SELECT doc_id, length(left(text, 512)) AS filename, length(left(text, 4000)) AS summary, length(left(text, 64)) AS code FROM documents")
def _(spark, sf):
    t = F.col("text")
    wide = I.table(spark, sf, "documents").select("doc_id", t.alias("filename"), t.alias("summary"), t.alias("code"))
    return hs.cap_columns(wide).select(
        "doc_id", *[F.length(c).alias(c) for c in ("filename", "summary", "code")]
    )


# ---------------------------------------------------------------------- URLs
_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = f"^{_OCT}(\\.{_OCT}){{3}}$"
_SHORT = ", ".join(f"'{h}'" for h in K.URL_SHORTENER_HOSTS)
_TLDS = " OR ".join(f"ends_with(host, '{t}')" for t in K.SUSPICIOUS_TLDS)
CLASSIFIED = f"""{X.URLS}, a AS (SELECT doc_id, regexp_replace(trim(raw_url), '^[()<>\\[\\]{{}}"\\x27]+|[()<>\\[\\]{{}}"\\x27]+$', '', 'g') AS url FROM urls),
b AS (SELECT doc_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc FROM a WHERE length(url) >= 4),
c AS (SELECT *, string_split(netloc, '@')[-1] AS hostinfo FROM b WHERE contains(netloc, '[') = contains(netloc, ']')),
cl AS (SELECT doc_id, url, scheme,
  lower(CASE WHEN contains(hostinfo, '[') THEN regexp_extract(hostinfo, '\\[([^\\]]*)\\]', 1) ELSE string_split(hostinfo, ':')[1] END) AS host,
  contains(hostinfo, '[') AS v6,
  CASE WHEN contains(hostinfo, '[') THEN regexp_extract(hostinfo, '\\]:(.*)$', 1) ELSE regexp_extract(hostinfo, '^[^:]*:(.*)$', 1) END AS port_text FROM c),
classified AS (SELECT doc_id, url, scheme, host, v6 OR regexp_matches(host, '{_V4}') AS is_ip_literal, host IN ({_SHORT}) AS is_shortener,
  starts_with(host, 'xn--') OR contains(host, '.xn--') AS is_punycode, ({_TLDS}) AS suspicious_tld,
  coalesce(CASE WHEN regexp_full_match(port_text, '[0-9]{{1,5}}') AND port_text::INT <= 65535 THEN port_text::INT END, -1) AS port FROM cl)"""


def classified(spark, sf):
    rows = I.page_urls(spark, sf).withColumn("u", ln.classify(F.col("raw_url"))).where("u IS NOT NULL")
    return rows.select("doc_id", "u.*")


@query("U1_classify", f"WITH {CLASSIFIED} SELECT * FROM classified")
def _(spark, sf):
    return classified(spark, sf).withColumn("port", F.coalesce("port", F.lit(-1)))


_BODY = "concat('see ', url, ' and ', url, ' or <ftp://h', CAST(page_id AS STRING), '.top/a> HTTPS://X', CAST(page_id AS STRING), '.net) \"smb://s/', CAST(page_id % 7 AS STRING), '\" ', html)"


@query(
    "U2_sweep",
    f"""WITH p AS (SELECT page_id AS doc_id, {_BODY} AS t FROM pages),
    m AS (SELECT doc_id, regexp_extract_all(t, '(?i)(?:https?|ftp|file|smb|javascript|data|vbscript|ms-msdt|search-ms)://[^\\s<>"\\x27\\\\)\\]}}]{{3,1000}}') AS l FROM p),
    e AS (SELECT doc_id, unnest(l) AS url FROM m)
    SELECT DISTINCT doc_id, url FROM e""",
)
def _(spark, sf):
    body = I.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.expr(_BODY).alias("t"))
    return ln.swept_urls(body, F.col("t"), "raw", 500, False).select("doc_id", "url")


@query(
    "U3_unc_sweep",
    "SELECT page_id AS doc_id, 'unc' AS scheme, 'srv-' || page_id AS host, chr(92) || chr(92) || 'srv-' || page_id || chr(92) || 'share' AS url FROM pages",
)
def _(spark, sf):
    body = I.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.expr("concat(html, ' ', chr(92), chr(92), 'srv-', page_id, chr(92), 'share\"')").alias("t"),
    )
    return ln.swept_urls(body, F.col("t"), "raw", 500, False).where("scheme = 'unc'").select("doc_id", "scheme", "host", "url")


_GROUPS = "SELECT user_id AS doc_id, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1 ELSE 2 END AS group_rank, event_id AS ord, CASE WHEN event_type = 'click' THEN 'action:/URI' WHEN event_type = 'view' THEN 'javascript' ELSE 'raw' END AS source, concat('http://h', CAST(event_id % 97 AS STRING), '.org/') AS url FROM events"


@query(
    "U4_merge",
    f"""WITH g AS ({_GROUPS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY CASE source WHEN 'raw' THEN 1 ELSE 0 END, group_rank, ord) AS p, min((group_rank, ord)) OVER (PARTITION BY doc_id, url) AS seen FROM g),
    o AS (SELECT doc_id, url, source, row_number() OVER (PARTITION BY doc_id ORDER BY seen, url)::INT AS ord FROM r WHERE p = 1)
    SELECT * FROM o WHERE ord <= 20""",
)
def _(spark, sf):
    rows = I.derived(spark, sf, _GROUPS, "events").withColumn("u", ln.classify(F.col("url")))
    full = rows.select("doc_id", "group_rank", "ord", "source", "url", "u.scheme", "u.host", "u.is_ip_literal",
                       "u.is_shortener", "u.is_punycode", "u.suspicious_tld", "u.port")
    return ln.merge_urls(full, 20).select("doc_id", "url", "source", "ord")


_DANGER = ", ".join(f"'{s}'" for s in (*K.DANGEROUS_URI_SCHEMES, "unc"))


@query("U5_dangerous", f"WITH {CLASSIFIED} SELECT doc_id, url FROM classified WHERE scheme IN ({_DANGER})")
def _(spark, sf):
    return classified(spark, sf).where(ln.is_dangerous(F.col("scheme"))).select("doc_id", "url")


_RISKY = "(is_ip_literal OR is_shortener OR is_punycode OR suspicious_tld)"


@query("U6_risky_hosts", f"WITH {CLASSIFIED} SELECT doc_id, host FROM classified WHERE {_RISKY}")
def _(spark, sf):
    return classified(spark, sf).where(ln.is_risky()).select("doc_id", "host")


@query(
    "U7_risk_reasons",
    f"""WITH {CLASSIFIED}, g AS (SELECT doc_id % 20 AS grp, count(*) AS n, count(*) FILTER (WHERE is_ip_literal) AS a, count(*) FILTER (WHERE is_shortener) AS b, count(*) FILTER (WHERE is_punycode) AS c, count(*) FILTER (WHERE suspicious_tld) AS d FROM classified WHERE {_RISKY} GROUP BY 1)
    SELECT grp, n, array_to_string(list_filter([CASE WHEN a > 0 THEN 'ip_literal=' || a END, CASE WHEN b > 0 THEN 'shortener=' || b END, CASE WHEN c > 0 THEN 'punycode=' || c END, CASE WHEN d > 0 THEN 'suspicious_tld=' || d END], lambda s: s IS NOT NULL), ',') AS reasons FROM g""",
)
def _(spark, sf):
    grouped = classified(spark, sf).withColumn("doc_id", F.expr("doc_id % 20"))
    return ln.risk_reasons(grouped).select(
        F.col("doc_id").alias("grp"), F.col("risky_urls").alias("n"),
        F.array_join(
            F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
        ).alias("reasons"),
    )


_FLAGS = "array_to_string(list_filter([CASE WHEN is_ip_literal THEN 'ip_literal' END, CASE WHEN is_shortener THEN 'shortener' END, CASE WHEN is_punycode THEN 'punycode' END, CASE WHEN suspicious_tld THEN 'suspicious_tld' END, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme:' || scheme END], lambda s: s IS NOT NULL), ',')"


@query("U8_url_flags", f"WITH {CLASSIFIED} SELECT doc_id, {_FLAGS} AS flags FROM classified")
def _(spark, sf):
    return classified(spark, sf).select("doc_id", F.array_join(ln.url_flags(), ",").alias("flags"))


@query(
    "U9_prioritised",
    f"""WITH {CLASSIFIED}, g AS (SELECT doc_id % 5 AS grp, url, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY ({_RISKY} OR scheme NOT IN ('http', 'https')) DESC, url)::INT AS place FROM classified)
    SELECT * FROM g WHERE place <= 25""",
)
def _(spark, sf):
    grouped = classified(spark, sf).withColumn("doc_id", F.expr("doc_id % 5"))
    return ln.prioritised(grouped).select(F.col("doc_id").alias("grp"), "url", "place")
