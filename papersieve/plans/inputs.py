"""Inputs derived from the supplied tables.

The supplied tables hold no binary documents and no scan history, so each is
derived by a plain SQL expression over a whole table. Every expression is
written in the SQL both Spark and the checking engine understand, and both run
the same text: the work grows with the table and nothing is subset.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Script variants by page: plain, packed, spraying, shelling out, mangled.
SCRIPT_CODE = """
concat(
  regexp_extract(html, '<script>(.*?)</script>', 1),
  CASE page_id % 9
    WHEN 1 THEN concat('eval(unescape(', chr(39), repeat('%u9090', CAST(page_id % 40 AS INT) + 2), chr(39), '));')
    WHEN 2 THEN concat('util.printf(', chr(39), '%45000f', chr(39), ',', CAST(page_id AS STRING), ');')
    WHEN 3 THEN concat('var s=', chr(39), repeat(md5(CAST(page_id AS STRING)), CAST(page_id % 6 AS INT) + 1), chr(39), ';')
    WHEN 4 THEN concat('String.fromCharCode (97);', 'ActiveXObject', chr(10), 'WScript;', repeat('fromCharCode(1);', CAST(page_id % 7 AS INT)))
    WHEN 5 THEN concat('_0x1a=_0x2b;', repeat('a=b+c;', CAST(page_id % 30 AS INT)), repeat('%u9090', CAST(page_id % 50 AS INT)),
      repeat('fromCharCode(1);', CAST(page_id % 8 AS INT)), chr(39), repeat(md5(CAST(page_id AS STRING)), CAST(page_id % 10 AS INT)), chr(39))
    WHEN 6 THEN concat(repeat(concat(chr(34), 'ab', chr(34), ' + '), CAST(page_id % 50 AS INT)), chr(34), 'z', chr(34))
    WHEN 7 THEN repeat('longline=longline+morewords;', CAST(page_id % 300 AS INT))
    WHEN 8 THEN 'Collab.getIcon(this.getAnnots());media.newPlayer(null)'
    ELSE ''
  END)
"""

# URL variants by page around the page's own URL.
PAGE_URL = """
CASE page_id % 14
  WHEN 1 THEN concat('http://10.0.', CAST(page_id % 256 AS STRING), '.7:8080/a?b=c')
  WHEN 2 THEN concat('https://bit.ly/', CAST(page_id AS STRING))
  WHEN 3 THEN concat('http://www.xn--', CAST(page_id AS STRING), '.org/')
  WHEN 4 THEN concat('HTTP://My_Host', CAST(page_id AS STRING), '.TOP:99/x')
  WHEN 5 THEN concat('(file://srv/', CAST(page_id AS STRING), ')')
  WHEN 6 THEN concat('javascript:go(', CAST(page_id AS STRING), ');')
  WHEN 7 THEN concat('smb://user@share', CAST(page_id AS STRING), '.zip:70000/d')
  WHEN 8 THEN 'a:b'
  WHEN 9 THEN concat('  https://t.co/', CAST(page_id AS STRING), chr(34))
  WHEN 10 THEN concat('http://[2001:db8::', CAST(page_id % 10 AS STRING), ']:443/p')
  WHEN 11 THEN concat('http://[broken', CAST(page_id AS STRING), '/p')
  ELSE url
END
"""


def _object(number: int, body: str) -> str:
    return f"'{number} 0 obj', chr(10), {body}, chr(10), 'endobj', chr(10)"


_CODE = (
    "concat('app.alert(', CAST(doc_id AS STRING), ');', CASE WHEN doc_id % 10 = 3 THEN "
    "'eval(unescape(1));util.printf(2);' ELSE '' END)"
)
_ACTION = f"""CASE doc_id % 4
  WHEN 0 THEN concat('<< /S /J#61vaScript /JS (', {_CODE}, ') >>')
  WHEN 1 THEN '<< /S /Launch /F (cmd.exe) /Win << /F (cmd.exe) /P (/c echo) >> >>'
  WHEN 2 THEN concat('<< /S /GoToR /F (file://srv/', CAST(doc_id AS STRING), '.pdf) >>')
  ELSE concat('<< /S /URI /URI (https://bit.ly/', CAST(doc_id AS STRING), ') >>') END"""

# A whole document per row: catalog, pages, actions, names, attachment, the
# row's full text in a content stream, trailer. Variants follow doc_id.
PDF_TEXT = f"""
CASE WHEN doc_id % 41 = 9 THEN concat('%PDF-1.4', chr(10), repeat('junk ', 50), 'trailer << /Root 9 0 R >>', chr(10), '%%EOF', chr(10))
ELSE concat(
  CASE WHEN doc_id % 13 = 5 THEN repeat('A', 64) ELSE '' END,
  CASE WHEN doc_id % 29 = 3 THEN '' ELSE concat('%PDF-1.', CAST(doc_id % 8 AS STRING), chr(10)) END,
  {_object(1, '''concat('<< /Type /Catalog /Pages 2 0 R',
    CASE WHEN doc_id % 5 = 1 THEN ' /OpenAction 4 0 R' ELSE '' END,
    CASE WHEN doc_id % 7 = 2 THEN ' /Names << /JavaScript 5 0 R >>' WHEN doc_id % 11 = 4 THEN ' /Names << /EmbeddedFiles 8 0 R >>' ELSE '' END,
    CASE WHEN doc_id % 9 = 3 THEN ' /A#63roForm << /XFA 11 0 R /Fields [] >>' WHEN doc_id % 9 = 4 THEN ' /AcroForm << /Fields [] >>' ELSE '' END,
    CASE WHEN doc_id % 31 = 7 THEN ' /AA << /WC 4 0 R >>' ELSE '' END, ' >>')''')},
  {_object(2, "CASE WHEN doc_id % 3 = 0 THEN '<< /Type /Pages /Kids [3 0 R 12 0 R] /Count 2 >>' ELSE '<< /Type /Pages /Kids [3 0 R] /Count 1 >>' END")},
  {_object(3, '''concat('<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 6 0 R',
    CASE WHEN doc_id % 8 = 1 THEN ' /Annots [7 0 R]' ELSE '' END,
    CASE WHEN doc_id % 37 = 5 THEN ' /AA << /O 4 0 R >>' ELSE '' END, ' >>')''')},
  {_object(4, _ACTION)},
  {_object(5, "'<< /Kids [9 0 R] >>'")},
  {_object(6, "concat('<< /Length 0 >>', chr(10), 'stream', chr(10), 'BT (', replace(replace(replace(text, chr(92), ' '), '(', ' '), ')', ' '), ') Tj ET', chr(10), 'endstream')")},
  {_object(7, "'<< /Type /Annot /Subtype /Link /A << /S /URI /URI (http://185.220.101.7/verify) >> >>'")},
  {_object(8, "concat('<< /Names [(invoice', CASE doc_id % 3 WHEN 0 THEN '.exe' WHEN 1 THEN '.PDF' ELSE '.zip' END, ') 14 0 R] >>')")},
  {_object(9, "'<< /Names [(a) 10 0 R (b) 13 0 R] >>'")},
  {_object(10, "concat('<< /S /JavaScript /JS (', " + _CODE + ", ') >>')")},
  {_object(11, "concat('<< /Length 0 >>', chr(10), 'stream', chr(10), '<xdp:xdp></xdp:xdp>', chr(10), 'endstream')")},
  {_object(12, "'<< /Type /Page /Parent 2 0 R >>'")},
  {_object(13, "'<< /S /JavaScript /JS 16 0 R >>'")},
  {_object(14, "'<< /Type /Filespec /EF << /F 15 0 R >> >>'")},
  {_object(15, "concat('<< /Type /EmbeddedFile /Subtype /application#2Fx-test >>', chr(10), 'stream', chr(10), 'MZ', md5(text), chr(10), 'endstream')")},
  {_object(16, "concat('<< /Length 0 >>', chr(10), 'stream', chr(10), 'var n', CAST(doc_id AS STRING), '=1;', chr(10), 'endstream')")},
  {_object(17, "'<< /Filter /Standard /V 1 >>'")},
  {_object(18, "concat('<< /Title (Doc ', CAST(doc_id AS STRING), ') /Author (a) /Custom (c', CAST(doc_id % 3 AS STRING), ') >>')")},
  CASE WHEN doc_id % 6 = 2 THEN repeat('/N#61me#20x ', CAST(doc_id % 9 AS INT)) ELSE '' END,
  CASE WHEN doc_id % 15 = 8 THEN '/JBIG2Decode /FlateDecode' ELSE '' END,
  CASE WHEN doc_id % 17 = 2 THEN 'verify your account' ELSE '' END,
  chr(10), 'trailer', chr(10), '<< /Size 19 /Root 1 0 R',
  CASE WHEN doc_id % 19 = 4 THEN ' /Encrypt 17 0 R' ELSE '' END,
  CASE WHEN doc_id % 6 = 1 THEN ' /Info 18 0 R' ELSE '' END,
  ' >>', chr(10), 'startxref', chr(10), '0', chr(10), '%%EOF', chr(10),
  repeat(concat('%%EOF', chr(10)), CAST(doc_id % 5 AS INT)),
  CASE WHEN doc_id % 12 = 6 THEN repeat('TRAILING-BLOB ', 100) ELSE '' END)
END
"""

# Labelled results with fixed arithmetic scores.
RESULTS_SELECT = """
SELECT d.doc_id, concat(d.source, '/', CAST(d.doc_id AS STRING), '.pdf') AS path, d.source AS dataset,
  CASE WHEN l.toxic = 1 THEN 'malware' ELSE 'clean' END AS label,
  CAST((d.doc_id * 37) % 101 AS INT) AS score,
  CAST((d.doc_id * 53 + 11) % 101 AS INT) AS model_score,
  CAST(1 + d.doc_id % 6 AS INT) AS n_indicators,
  CAST((d.doc_id * 7) % 60 AS INT) AS obfuscated_names,
  CASE WHEN d.doc_id % 17 = 0 THEN false ELSE true END AS is_pdf,
  CASE WHEN d.doc_id % 23 = 5 THEN 'read: gone' ELSE '' END AS error,
  CASE d.doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'extracted' ELSE 'ocr' END AS text_source,
  concat(
    CASE WHEN d.doc_id % 2 = 0 THEN 'PDF_JS_PRESENT;' ELSE '' END,
    CASE WHEN d.doc_id % 3 = 0 THEN 'PDF_XFA_FORM;' ELSE '' END,
    CASE WHEN d.doc_id % 5 <> 1 THEN 'PDF_PARSE_FAILURE;' ELSE '' END,
    CASE WHEN d.doc_id % 7 = 0 OR l.toxic = 1 THEN 'PDF_LAUNCH_ACTION;' ELSE '' END,
    CASE WHEN d.doc_id % 6 = 2 THEN 'PDF_JS_PRESENT;' ELSE '' END) AS codes
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

# Paired before/after rows over the same documents.
CHANGES_SELECT = """
SELECT d.doc_id, concat(CAST(d.doc_id AS STRING), '.pdf') AS file,
  CASE WHEN l.toxic = 1 THEN 'malware' ELSE 'clean' END AS label,
  CAST((d.doc_id * 37) % 101 AS INT) AS static_score,
  CAST((d.doc_id * 53 + 11) % 101 AS INT) AS ai_score,
  CAST(1 + d.doc_id % 6 AS INT) AS indicators,
  CASE d.doc_id % 6 WHEN 0 THEN 'clean' WHEN 1 THEN 'malicious' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'low_risk' WHEN 4 THEN 'unknown' ELSE '' END AS model_said,
  CAST(length(d.text) AS BIGINT) AS tokens,
  CASE WHEN d.doc_id % 19 = 3 THEN 'timeout' ELSE '' END AS error
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

# One document per user and day, one indicator per event.
EVENT_INDICATORS_SELECT = """
SELECT concat(CAST(user_id AS STRING), '|', CAST(CAST(ts AS DATE) AS STRING)) AS doc_id,
  ts, event_id,
  CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS rule_ord,
  concat('EV_', upper(event_type)) AS code,
  concat('Event ', event_type) AS title,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
  CASE event_type WHEN 'error' THEN 85 WHEN 'purchase' THEN 55 WHEN 'signup' THEN 30 WHEN 'click' THEN 15 ELSE 0 END AS weight
FROM events
"""

# Scan history from orders.
SCANS_SELECT = """
SELECT o_orderkey AS scan_id,
  concat('Report_', CAST(o_custkey AS STRING), '_', CAST(o_orderkey AS STRING), '.pdf') AS filename,
  CAST(floor(o_totalprice) AS BIGINT) AS file_size,
  md5(CAST(o_custkey AS STRING)) AS sha256,
  concat(substr(md5(CAST(o_custkey AS STRING)), 1, 2), '/', substr(md5(CAST(o_custkey AS STRING)), 3, 2), '/', md5(CAST(o_custkey AS STRING)), '.pdf') AS storage_key,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'quarantined' END AS status,
  CAST(o_orderkey % 101 AS INT) AS risk_score,
  CASE WHEN o_orderkey % 101 >= 80 THEN 'malicious' WHEN o_orderkey % 101 >= 50 THEN 'suspicious' WHEN o_orderkey % 101 >= 20 THEN 'low_risk' ELSE 'clean' END AS verdict,
  CAST(floor(o_totalprice / 100) AS INT) AS duration_ms,
  CASE WHEN o_orderstatus = 'P' THEN true ELSE false END AS quarantined,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('summary ', CAST(o_orderkey AS STRING)) END AS summary,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('bad file', chr(10), 'trace') ELSE '' END AS error_message,
  o_orderdate AS created_at
FROM orders
"""

# Indicators and model assessments attached to those scans.
SCAN_INDICATORS_SELECT = """
SELECT l_orderkey AS scan_id, concat('C', CAST(min(l_linenumber) AS STRING), '_', l_returnflag) AS code,
  concat('Finding ', l_returnflag) AS title,
  CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'critical' ELSE 'low' END AS severity,
  CAST(max(l_linenumber) * 7 AS INT) AS weight
FROM lineitem GROUP BY l_orderkey, l_returnflag
"""
ASSESSMENTS_SELECT = """
SELECT event_id AS call_id, CAST(user_id AS BIGINT) AS scan_id, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'p1' WHEN 'click' THEN 'p2' ELSE 'p3' END AS provider,
  CASE WHEN event_type = 'error' THEN false ELSE true END AS succeeded,
  CAST(floor(value * 100) AS BIGINT) AS tokens, value AS latency
FROM events
"""

NOW_EVENTS = "2024-01-31 00:00:00"
NOW_ORDERS = "2001-08-01 00:00:00"


def derived(spark: SparkSession, sf_dir: str, select: str, *tables: str) -> DataFrame:
    """Run one of the shared selects with its tables bound to the given folder."""
    return spark.sql(
        _named(select, tables), **{t: table(spark, sf_dir, t) for t in tables}
    )


def _named(select: str, tables: tuple[str, ...]) -> str:
    """Mark the table names as query parameters, leaving everything else alone."""
    text = select.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return text


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, RESULTS_SELECT, "documents", "labels")
    return rows.withColumn(
        "indicators", F.filter(F.split("codes", ";"), lambda c: c != "")
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CHANGES_SELECT, "documents", "labels")


def event_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, EVENT_INDICATORS_SELECT, "events")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SCANS_SELECT, "orders")


def scan_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SCAN_INDICATORS_SELECT, "lineitem")


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ASSESSMENTS_SELECT, "events")


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script per page: ``doc_id, ord, location, code, length``."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.lit(0).alias("ord"),
        F.lit("/OpenAction").alias("location"),
        F.expr(SCRIPT_CODE).alias("code"),
    ).withColumn("length", F.length("code"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.expr(PAGE_URL).alias("raw_url")
    )


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document file per row of ``documents``: ``doc_id, path, content``."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id",
        F.format_string("%s/%d.pdf", "source", "doc_id").alias("path"),
        F.encode(F.expr(PDF_TEXT), "UTF-8").alias("content"),
    )
