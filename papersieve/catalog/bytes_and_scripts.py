"""Byte features, text helpers and script analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.catalog import fragments as X
from papersieve.catalog.registry import query
from papersieve.functions import bytescan as bs
from papersieve.functions import scripts as js
from papersieve.functions import text as tx
from papersieve.functions.arrow import byte_profile, entropy
from papersieve.plans import inputs as I

def documents(spark, sf):
    return I.table(spark, sf, "documents")


def file_text(spark, sf):
    return I.pdf_files(spark, sf).select("doc_id", "content", tx.latin1(F.col("content")).alias("t"))


@query("F1_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(spark, sf):
    raw = F.encode("text", "UTF-8")
    return documents(spark, sf).select(
        "doc_id", bs.sha256_hex(raw).alias("sha256"), bs.md5_hex(raw).alias("md5")
    )


@query("F2_entropy", f"WITH e AS ({X.entropy('documents', 'doc_id', 'text')}) SELECT doc_id, round(bits, 6) AS bits FROM e")
def _(spark, sf):
    return I.spread(documents(spark, sf).select("doc_id", "text")).select(
        "doc_id", F.round(entropy(F.encode("text", "UTF-8")), 6).alias("bits")
    )


@query(
    "F2_entropy_relational",
    f"WITH e AS ({X.entropy('documents', 'doc_id', 'text')}) SELECT doc_id, round(bits, 6) AS bits FROM e",
)
def _(spark, sf):
    """The same entropy from grouped byte counts, without a UDF."""
    hexed = documents(spark, sf).select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("h"))
    single = hexed.select(
        "doc_id", F.explode(F.regexp_extract_all("h", F.lit("(..)"), F.lit(1))).alias("b")
    )
    counts = single.groupBy("doc_id", "b").agg(F.count("*").alias("n"))
    total = counts.groupBy("doc_id").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s")
    )
    return total.select(
        "doc_id", F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("bits")
    )


_MAGIC_HEX = "CASE doc_id % 17 " + " ".join(
    f"WHEN {i} THEN '{h}'" for i, (h, _) in enumerate(K.MAGIC_SIGNATURES)
) + " ELSE '00' END"
_MAGIC_NAME = "CASE doc_id % 17 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, (_, n) in enumerate(K.MAGIC_SIGNATURES)
) + " ELSE 'unknown' END"


@query("F3_magic", f"SELECT doc_id, {_MAGIC_NAME} AS magic FROM documents")
def _(spark, sf):
    content = F.concat(F.unhex(F.expr(_MAGIC_HEX)), F.encode("text", "UTF-8"))
    return documents(spark, sf).select(
        "doc_id", F.coalesce(bs.magic_type(content), F.lit("unknown")).alias("magic")
    )


@query("F4_name_escapes", f"WITH {X.FILES} SELECT doc_id, md5({X.decoded('t')}) AS decoded FROM files")
def _(spark, sf):
    plain = bs.decode_name_escapes(F.col("t"))
    return file_text(spark, sf).select("doc_id", F.md5(F.encode(plain, "ISO-8859-1")).alias("decoded"))


@query(
    "F5_safe_text",
    """SELECT doc_id, left(regexp_replace('a' || chr(7) || 'b' || chr(9) || chr(127) || text, '[\\x01-\\x08\\x0b-\\x1f\\x7f]', '.', 'g'), 512) AS safe FROM documents""",
)
def _(spark, sf):
    dirty = F.concat(F.lit("a\x07\x00b\t\x7f"), "text")
    return documents(spark, sf).select("doc_id", tx.safe_text(dirty).alias("safe"))


@query("F6_truncate", "SELECT doc_id, left(text, 500) AS clipped, length(text) > 500 AS was_truncated FROM documents")
def _(spark, sf):
    c = tx.clip(F.col("text"), 500)
    return documents(spark, sf).select("doc_id", c["text"].alias("clipped"), c["truncated"].alias("was_truncated"))


@query("F7_clamp", "SELECT o_orderkey, greatest(0, least(100, o_orderkey % 300 - 100)) AS v FROM orders")
def _(spark, sf):
    return I.table(spark, sf, "orders").select(
        "o_orderkey", tx.clamp(F.expr("o_orderkey % 300 - 100"), F.lit(0), F.lit(100)).alias("v")
    )


@query(
    "F8_ratio",
    "SELECT source, CASE WHEN sum(doc_id % 2) FILTER (WHERE lang = 'de') > 0 THEN round(count(*)::DOUBLE / sum(doc_id % 2) FILTER (WHERE lang = 'de'), 6) ELSE 0.0::DOUBLE END AS r FROM documents GROUP BY source",
)
def _(spark, sf):
    odd = F.coalesce(F.sum(F.when(F.col("lang") == "de", F.col("doc_id") % 2)), F.lit(0))
    return documents(spark, sf).groupBy("source").agg(
        F.round(tx.ratio(F.count("*"), odd), 6).alias("r")
    )


@query("F9_substring_counts", f"SELECT doc_id, {X.count_of('text', 'on')} AS n, 0 AS none FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", tx.count_of(F.col("text"), "on").alias("n"), tx.count_of(F.col("text"), "").alias("none"))


_COUNTED = ", ".join(
    f"CASE WHEN {X.count_of('d', k)} > 0 THEN '{k}=' || {X.count_of('d', k)} END" for k in K.PDF_KEYWORDS
)


@query(
    "F10_keyword_counts",
    f"WITH {X.FILES}, x AS (SELECT doc_id, {X.decoded('t')} AS d FROM files) SELECT doc_id, array_to_string(list_filter([{_COUNTED}], lambda s: s IS NOT NULL), ';') AS counts FROM x",
)
def _(spark, sf):
    hits = byte_profile(F.col("content"))["keyword_hits"]
    named = bs.nonzero_map(K.PDF_KEYWORDS, hits)
    return I.pdf_files(spark, sf).select(
        "doc_id",
        F.array_join(
            F.transform(F.map_entries(named), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"
        ).alias("counts"),
    )


@query(
    "F11_header",
    f"WITH {X.FILES} SELECT doc_id, instr(left(t, 1024), '%PDF-') > 0 AS has_header, greatest(0, instr(left(t, 1024), '%PDF-') - 1)::INT AS header_offset, CASE WHEN instr(left(t, 1024), '%PDF-') > 0 THEN substr(t, instr(t, '%PDF-') + 5, 3) ELSE 'none' END AS version FROM files",
)
def _(spark, sf):
    c = F.col("content")
    return file_text(spark, sf).select(
        "doc_id",
        bs.has_header(c).alias("has_header"),
        F.greatest(F.lit(0), bs.header_position(c)).alias("header_offset"),
        F.coalesce(bs.pdf_version(c), F.lit("none")).alias("version"),
    )


@query(
    "F12_eof",
    f"WITH {X.FILES} SELECT doc_id, {X.count_of('t', '%%EOF')} AS eofs, greatest(0, {X.count_of('t', '%%EOF')} - 1) AS updates, strlen(trim(string_split(t, '%%EOF')[-1], chr(13) || chr(10) || ' ' || chr(9))) AS trailing FROM files",
)
def _(spark, sf):
    t = F.col("t")
    return file_text(spark, sf).select(
        "doc_id", bs.eof_count(t).alias("eofs"), bs.incremental_updates(t).alias("updates"),
        bs.trailing_bytes(t).alias("trailing"),
    )


@query(
    "F13_escaped_names",
    f"WITH {X.FILES} SELECT doc_id, length(regexp_extract_all(t, '/[A-Za-z0-9]*#[0-9A-Fa-f]{{2}}')) AS escapes FROM files",
)
def _(spark, sf):
    return file_text(spark, sf).select("doc_id", bs.escaped_name_count(F.col("t")).alias("escapes"))


@query(
    "F14_object_and_stream_counts",
    f"WITH {X.FILES}, x AS (SELECT doc_id, {X.decoded('t')} AS d FROM files) SELECT doc_id, length(regexp_extract_all(d, '\\d+\\s+\\d+\\s+obj\\b')) AS n_objects, length(regexp_extract_all(d, '\\bstream\\b')) AS n_streams FROM x",
)
def _(spark, sf):
    d = bs.decode_name_escapes(F.col("t"))
    return file_text(spark, sf).select(
        "doc_id", bs.object_count(d).alias("n_objects"), bs.stream_count(d).alias("n_streams")
    )


_FILTERED = ", ".join(
    f"CASE WHEN {X.count_of('t', '/' + k)} > 0 THEN '{k}=' || {X.count_of('t', '/' + k)} END" for k in K.STREAM_FILTERS
)


@query(
    "F15_filter_histogram",
    f"WITH {X.FILES} SELECT doc_id, array_to_string(list_filter([{_FILTERED}], lambda s: s IS NOT NULL), ';') AS filters FROM files",
)
def _(spark, sf):
    named = bs.nonzero_map(K.STREAM_FILTERS, byte_profile(F.col("content"))["filter_hits"])
    return I.pdf_files(spark, sf).select(
        "doc_id",
        F.array_join(
            F.transform(F.map_entries(named), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"
        ).alias("filters"),
    )


@query(
    "F16_derived_counters",
    f"WITH {X.FILES} SELECT doc_id, length(regexp_extract_all(t, '/[A-Za-z0-9]*#[0-9A-Fa-f]{{2}}'))::INT AS escapes, {X.count_of('t', '%%EOF')}::INT AS eofs FROM files",
)
def _(spark, sf):
    counts = F.col("keyword_counts")
    return bs.byte_features(I.pdf_files(spark, sf)).select(
        "doc_id", counts["__obfuscated_names__"].alias("escapes"), counts["__eof_markers__"].alias("eofs")
    )


_PAGE_TEXT = "concat(chr(10), '  ', repeat(concat(text, '  '), CAST(1 + conv_id % 12 AS INT)))"


@query(
    "F17_text_excerpt",
    f"""WITH p AS (SELECT conv_id, turn, {_PAGE_TEXT} AS text FROM conversations WHERE turn < 5),
    q AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
    j AS (SELECT conv_id, regexp_replace(string_agg(text, chr(10) ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS joined FROM q WHERE before < 4000 GROUP BY conv_id)
    SELECT conv_id AS doc_id, left(regexp_replace(joined, '\\s+', ' ', 'g'), 4000) AS text_excerpt FROM j""",
)
def _(spark, sf):
    pages = I.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.expr(_PAGE_TEXT).alias("text")
    )
    return bs.text_excerpts(pages)


@query(
    "F18_text_source",
    "SELECT CASE WHEN doc_id % 5 = 0 THEN 'ocr' WHEN doc_id % 3 = 0 THEN 'none' ELSE 'extracted' END AS text_source, count(*) AS n FROM documents GROUP BY 1",
)
def _(spark, sf):
    rows = documents(spark, sf).select(
        F.when(F.expr("doc_id % 3 = 0"), F.lit("  ")).otherwise(F.col("text")).alias("excerpt"),
        F.when(F.expr("doc_id % 5 = 0"), F.col("text")).alias("ocr"),
    )
    return rows.groupBy(bs.text_source(F.col("excerpt"), F.col("ocr")).alias("text_source")).agg(F.count("*").alias("n"))


@query(
    "F19_redact",
    """SELECT event_id, '***' AS api_key, CASE WHEN user_id % 2 = 0 THEN '***' ELSE 'none' END AS token, event_type AS kind FROM events""",
)
def _(spark, sf):
    secret = F.when(F.expr("user_id % 2 = 0"), F.lit("s3cret"))
    m = F.map_filter(
        F.create_map(F.lit("api_key"), F.col("props"), F.lit("token"), secret, F.lit("kind"), F.col("event_type")),
        lambda _, v: v.isNotNull(),
    )
    safe = tx.redact(m)
    return I.table(spark, sf, "events").select(
        "event_id", safe["api_key"].alias("api_key"),
        F.coalesce(F.try_element_at(safe, F.lit("token")), F.lit("none")).alias("token"),
        safe["kind"].alias("kind"),
    )


# ------------------------------------------------------------------- scripts
_TOKENS = ", ".join(
    "CASE WHEN contains(lower(code), '{0}') THEN '{1}' END".format(t.lower(), t) for t in K.JS_SUSPICIOUS_TOKENS
)
_TOKEN_LIST = f"list_filter([{_TOKENS}], lambda s: s IS NOT NULL)"
_CRITICAL = "[" + ", ".join(f"'{t}'" for t in K.JS_CRITICAL_TOKENS) + "]"


@query("J1_suspicious_tokens", f"WITH {X.SCRIPTS} SELECT doc_id, array_to_string({_TOKEN_LIST}, ',') AS tokens FROM scripts")
def _(spark, sf):
    return I.page_scripts(spark, sf).select(
        "doc_id", F.array_join(js.suspicious_tokens(F.col("code")), ",").alias("tokens")
    )


@query("J2_script_entropy", f"WITH {X.SCRIPTS}, e AS ({X.entropy('scripts', 'doc_id', 'code')}) SELECT doc_id, round(bits, 6) AS bits FROM e")
def _(spark, sf):
    return I.page_scripts(spark, sf).select(
        "doc_id", F.round(entropy(F.encode("code", "UTF-8")), 6).alias("bits")
    )


@query("J3_obfuscation_score", f"WITH {X.OBFUSCATION} SELECT doc_id, round(score, 6) AS score FROM obf")
def _(spark, sf):
    bits = entropy(F.encode("code", "UTF-8"))
    return I.page_scripts(spark, sf).withColumn("b", bits).select(
        "doc_id", F.round(js.obfuscation_raw(F.col("code"), F.col("b")), 6).alias("score")
    )


@query(
    "J4_critical_tokens",
    f"WITH {X.SCRIPTS}, x AS (SELECT doc_id, list_filter({_TOKEN_LIST}, lambda s: list_contains({_CRITICAL}, s)) AS c FROM scripts) SELECT doc_id, array_to_string(list_sort(c), ',') AS critical FROM x WHERE length(c) > 0",
)
def _(spark, sf):
    enriched = js.enrich_scripts(I.page_scripts(spark, sf))
    return js.critical_tokens(enriched).select("doc_id", F.array_join("critical_tokens", ",").alias("critical"))


_HINTS = ", ".join(f"CASE WHEN list_contains(tk, '{t}') THEN '{t}={c}' END" for t, c in K.JS_CVE_HINTS)


@query(
    "J5_cve_hints",
    f"WITH {X.SCRIPTS}, x AS (SELECT doc_id, {_TOKEN_LIST} AS tk FROM scripts) SELECT doc_id, array_to_string(list_filter([{_HINTS}], lambda s: s IS NOT NULL), ',') AS hints FROM x",
)
def _(spark, sf):
    summary = js.script_summary(js.enrich_scripts(I.page_scripts(spark, sf)))
    return summary.select(
        "doc_id",
        F.array_join(
            F.transform(F.map_entries("cve_hints"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias("hints"),
    )


@query(
    "J6_script_totals",
    f"WITH {X.OBFUSCATION} SELECT doc_id, length(s.code)::BIGINT AS total_length, round(o.score, 3) AS worst FROM scripts s JOIN obf o USING (doc_id)",
)
def _(spark, sf):
    summary = js.script_summary(js.enrich_scripts(I.page_scripts(spark, sf)))
    return summary.select(
        "doc_id", F.col("total_js_length").alias("total_length"), F.col("max_obfuscation").alias("worst")
    )


_PARTS = "SELECT user_id AS doc_id, event_id AS ord, event_type || CAST(user_id % 3 AS STRING) || CAST(event_id % 4 AS STRING) AS code, CASE WHEN event_id % 5 = 0 THEN 'targeted' ELSE 'sweep' END AS stage FROM events"


@query(
    "J7_sweep_dedup",
    f"""WITH s AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY CASE stage WHEN 'targeted' THEN 0 ELSE 1 END, ord) AS rn FROM s)
    SELECT doc_id, ord, stage FROM r WHERE stage = 'targeted' OR rn = 1""",
)
def _(spark, sf):
    parts = I.derived(spark, sf, _PARTS, "events").withColumn("sha256", F.sha2("code", 256))
    return js.drop_repeated_sweeps(parts).select("doc_id", "ord", "stage")


@query(
    "J8_script_budget",
    """WITH s AS (SELECT source AS doc_id, doc_id AS ord, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
    SELECT doc_id, ord, least(length(text), 20000) AS kept, length(text) > 20000 AS truncated FROM s WHERE before <= 20000""",
)
def _(spark, sf):
    rows = documents(spark, sf).select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.col("text").alias("code")
    )
    return js.apply_script_budget(rows, 20000).select("doc_id", "ord", F.length("code").alias("kept"), "truncated")
