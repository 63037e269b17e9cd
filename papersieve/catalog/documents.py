"""Object graph, signatures, rules and scores over derived document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.catalog import fragments as X
from papersieve.catalog.registry import query
from papersieve.catalog.fragments import R3_SQL
from papersieve.functions import links as ln
from papersieve.functions.text import latin1
from papersieve.operators import objects as og
from papersieve.operators import patterns as pt
from papersieve.operators import rules as rl
from papersieve.operators import scoring as sc
from papersieve.operators import signatures as sg
from papersieve.plans import hard_inputs as hi
from papersieve.plans import inputs as I
from papersieve.plans.scan import Scan, scan_files

_SCANS: dict[tuple[str, str], Scan] = {}


def scan(spark: SparkSession, sf: str) -> Scan:
    """The full scan of a folder's derived files, staged once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SCANS:
        _SCANS[key] = scan_files(I.pdf_files(spark, sf))
    return _SCANS[key]


def walked(spark: SparkSession, sf: str) -> og.Walk:
    return scan(spark, sf).walk


# ------------------------------------------------------------- object graph
@query(
    "G1_objects",
    f"SELECT doc_id, 18 AS n_objects FROM documents WHERE {X.VALID}",
)
def _(spark, sf):
    return og.objects(walked(spark, sf).entries).groupBy("doc_id").agg(
        F.count("*").cast("int").alias("n_objects")
    )


@query(
    "G2_open_actions",
    f"SELECT doc_id, {X.TARGET} AS target, {X.SUBTYPE} AS subtype FROM documents WHERE {X.VALID} AND doc_id % 5 = 1",
)
def _(spark, sf):
    return og.actions(walked(spark, sf)).where("kind = '/OpenAction'").select(
        "doc_id", "target", F.col("details")["subtype"].alias("subtype")
    )


@query(
    "G3_additional_actions",
    f"""SELECT doc_id, 'WillClose' AS "trigger", '/Root/AA' AS location, {X.TARGET} AS target, true AS auto FROM documents WHERE {X.VALID} AND doc_id % 31 = 7
    UNION ALL SELECT doc_id, 'PageOpen', '/Page[0]/AA', {X.TARGET}, true FROM documents WHERE {X.VALID} AND doc_id % 37 = 5""",
)
def _(spark, sf):
    return og.actions(walked(spark, sf)).where("kind = '/AA'").select(
        "doc_id", "trigger", F.col("details")["location"].alias("location"), "target",
        F.col("auto_executes").alias("auto"),
    )


@query(
    "G4_name_tree_scripts",
    f"""SELECT doc_id, {X.CODE} AS code FROM documents WHERE {X.VALID} AND doc_id % 7 = 2
    UNION ALL SELECT doc_id, 'var n' || doc_id || '=1;' FROM documents WHERE {X.VALID} AND doc_id % 7 = 2""",
)
def _(spark, sf):
    return og.script_findings(walked(spark, sf)).where(
        "location = '/Names/JavaScript'"
    ).select("doc_id", "code")


@query(
    "G5_recorded_kinds",
    f"""SELECT doc_id, {X.SUBTYPE} AS kind, '/Root/AA' AS "trigger", {X.TARGET} AS target, doc_id % 4 = 1 AS auto FROM documents WHERE {X.VALID} AND doc_id % 31 = 7 AND doc_id % 4 <> 0
    UNION ALL SELECT doc_id, {X.SUBTYPE}, '/Page[0]/AA', {X.TARGET}, doc_id % 4 = 1 FROM documents WHERE {X.VALID} AND doc_id % 37 = 5 AND doc_id % 4 <> 0
    UNION ALL SELECT doc_id, '/URI', '/Page[0]/Annot/Link', 'http://185.220.101.7/verify', false FROM documents WHERE {X.VALID} AND doc_id % 8 = 1""",
)
def _(spark, sf):
    return og.recorded_kinds(walked(spark, sf)).select(
        "doc_id", "kind", "trigger", "target", F.col("auto_executes").alias("auto")
    )


@query(
    "G6_action_targets",
    f"SELECT doc_id, {X.TARGET} AS target FROM documents WHERE {X.VALID}",
)
def _(spark, sf):
    return walked(spark, sf).attributes.where("node = '4'").select("doc_id", "target")


@query(
    "G7_annotations",
    f"SELECT doc_id, 0 AS page, 0 AS slot, '/Link' AS subtype FROM documents WHERE {X.VALID} AND doc_id % 8 = 1",
)
def _(spark, sf):
    return og.annotations(walked(spark, sf)).select(
        "doc_id", "page", F.col("pos").alias("slot"), "subtype"
    )


@query(
    "G8_object_sweep",
    f"""SELECT doc_id, 'launch' AS what, 'cmd.exe' AS value FROM documents WHERE {X.VALID} AND doc_id % 4 = 1
    UNION ALL SELECT doc_id, 'uri', 'https://bit.ly/' || doc_id FROM documents WHERE {X.VALID} AND doc_id % 4 = 3
    UNION ALL SELECT doc_id, 'script', {X.CODE} FROM documents WHERE {X.VALID} AND doc_id % 4 = 0
    UNION ALL SELECT doc_id, 'script', {X.CODE} FROM documents WHERE {X.VALID}
    UNION ALL SELECT doc_id, 'script', 'var n' || doc_id || '=1;' FROM documents WHERE {X.VALID}""",
)
def _(spark, sf):
    w = walked(spark, sf)
    launches = og.actions(w).where("object_id IS NOT NULL").select(
        "doc_id", F.lit("launch").alias("what"), F.col("target").alias("value")
    )
    uris = og.uri_targets(w).where("source = 'object'").select(
        "doc_id", F.lit("uri").alias("what"), F.col("target").alias("value")
    )
    scripts = og.script_findings(w).where("stage = 'sweep'").select(
        "doc_id", F.lit("script").alias("what"), F.col("code").alias("value")
    )
    return launches.unionByName(uris).unionByName(scripts)


@query(
    "G9_script_payloads",
    f"""SELECT doc_id, '4' AS node, {X.CODE} AS code FROM documents WHERE {X.VALID} AND doc_id % 4 = 0
    UNION ALL SELECT doc_id, '10', {X.CODE} FROM documents WHERE {X.VALID}
    UNION ALL SELECT doc_id, '13', 'var n' || doc_id || '=1;' FROM documents WHERE {X.VALID}""",
)
def _(spark, sf):
    return walked(spark, sf).scripts.select("doc_id", "node", "code")


@query(
    "G10_attachments",
    f"""SELECT doc_id, 'invoice' || CASE doc_id % 3 WHEN 0 THEN '.exe' WHEN 1 THEN '.PDF' ELSE '.zip' END AS name,
      'application/x-test' AS mime_type, 34::BIGINT AS size, sha256('MZ' || md5(text)) AS sha256,
      CASE doc_id % 3 WHEN 0 THEN '.exe' WHEN 1 THEN '.pdf' ELSE '.zip' END AS extension, 'dos/pe-executable' AS magic_bytes
    FROM documents WHERE {X.VALID} AND doc_id % 7 <> 2 AND doc_id % 11 = 4""",
)
def _(spark, sf):
    return og.attachments(walked(spark, sf)).select(
        "doc_id", "name", "mime_type", "size", "sha256", "extension", "magic_bytes"
    )


@query(
    "G11_metadata",
    f"""SELECT doc_id, 'Doc ' || doc_id AS title, 'a' AS author, 'c' || (doc_id % 3) AS custom
    FROM documents WHERE {X.VALID} AND doc_id % 6 = 1""",
)
def _(spark, sf):
    return og.metadata(walked(spark, sf)).select(
        "doc_id", "title", "author", F.col("extra")["/Custom"].alias("custom")
    )


@query(
    "G12_structure_flags",
    f"""SELECT doc_id, doc_id % 19 = 4 AS is_encrypted, doc_id % 9 = 3 AS has_xfa, doc_id % 9 IN (3, 4) AS has_acroform,
      CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS page_count,
      CASE WHEN doc_id % 19 = 4 THEN '/Encrypt,' ELSE '' END || CASE WHEN doc_id % 6 = 1 THEN '/Info,' ELSE '' END || '/Root,/Size' AS trailer_keys,
      doc_id % 5 = 1 AS has_openaction, doc_id % 7 = 2 AS has_names_javascript
    FROM documents WHERE {X.VALID}""",
)
def _(spark, sf):
    w = walked(spark, sf)
    flags = og.structure_flags(w).join(w.roots.select("doc_id"), "doc_id", "left_semi")
    return flags.select(
        "doc_id", "is_encrypted", "has_xfa", "has_acroform", "page_count",
        F.array_join("trailer_keys", ",").alias("trailer_keys"),
        "has_openaction", "has_names_javascript",
    )


@query(
    "G13_parse_errors",
    f"""SELECT doc_id, 'open' AS stage, 'open failed: no resolvable catalog' AS message FROM documents WHERE doc_id % 41 = 9
    UNION ALL SELECT doc_id, 'header', 'missing %PDF- header' FROM documents WHERE {X.VALID} AND doc_id % 29 = 3
    UNION ALL SELECT doc_id, 'open', 'encrypted: contents are not decrypted' FROM documents WHERE {X.VALID} AND doc_id % 19 = 4""",
)
def _(spark, sf):
    return scan(spark, sf).evidence.errors.select("doc_id", "stage", "message")


# --------------------------------------------------------------- hard files
_DEPTH = "CASE WHEN doc_id % 50 = 7 THEN 5000 WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 4 = 2 THEN 12 ELSE 3 END"
_HARD_WALKS: dict[tuple[str, str], og.Walk] = {}


def hard_walk(spark: SparkSession, sf: str) -> og.Walk:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _HARD_WALKS:
        _HARD_WALKS[key] = og.walk(og.stage_entries(hi.hard_files(spark, sf)))
    return _HARD_WALKS[key]


@query(
    "G4_deep_trees",
    f"""WITH d AS (SELECT doc_id, {_DEPTH} AS depth FROM documents),
    n AS (SELECT doc_id, depth, unnest(range(0, depth)) AS i FROM d)
    SELECT doc_id, 'pages' AS tree, CASE WHEN i = 0 THEN '2' ELSE (1000 + i)::VARCHAR END AS node, i::INT AS place FROM n
    UNION ALL SELECT doc_id, 'pages', '10', depth::INT FROM d UNION ALL SELECT doc_id, 'pages', '11', (depth + 1)::INT FROM d
    UNION ALL SELECT doc_id, 'scripts', '50', 0 FROM d UNION ALL SELECT doc_id, 'scripts', '51', 1 FROM d""",
)
def _(spark, sf):
    return hard_walk(spark, sf).trees


@query("G1_hard_objects", f"SELECT doc_id, (11 + {_DEPTH})::INT AS n_objects FROM documents")
def _(spark, sf):
    return og.objects(hard_walk(spark, sf).entries).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_objects"))


@query(
    "G3_hard_actions",
    """SELECT doc_id, 'PageOpen' AS "trigger", '/Page[0]/AA' AS location, '<javascript>' AS target FROM documents
    UNION ALL SELECT doc_id, 'MouseEnter', '/Page[1]/Annot/AA', 'tool' || doc_id || '.exe' FROM documents""",
)
def _(spark, sf):
    return og.actions(hard_walk(spark, sf)).where("kind = '/AA'").select(
        "doc_id", "trigger", F.col("details")["location"].alias("location"), "target"
    )


@query(
    "G5_hard_kinds",
    "SELECT doc_id, '/Launch' AS kind, '/Page[1]/Annot/AA' AS \"trigger\", 'tool' || doc_id || '.exe' AS target, true AS auto FROM documents",
)
def _(spark, sf):
    return og.recorded_kinds(hard_walk(spark, sf)).select(
        "doc_id", "kind", "trigger", "target", F.col("auto_executes").alias("auto")
    )


@query(
    "G9_hard_scripts",
    """SELECT doc_id, '/Page[0]/AA/O' AS location, 'page(' || doc_id || ');' || md5(text) AS code FROM documents
    UNION ALL SELECT doc_id, '/Names/JavaScript', 'names(' || doc_id || ')' FROM documents""",
)
def _(spark, sf):
    return og.script_findings(hard_walk(spark, sf)).where("stage = 'targeted'").select("doc_id", "location", "code")


_WIDE_SCANS: dict[tuple[str, str, og.Limits], Scan] = {}
SOME = og.Limits(pages=4, annotations=2, urls=9, script_urls=1)
_WIDE = "SELECT doc_id, 2 + doc_id % 6 AS pages, 1 + doc_id // 6 % 4 AS notes, doc_id % 3 AS links FROM documents"


def wide_scan(spark: SparkSession, sf: str, limits: og.Limits = og.Limits()) -> Scan:
    key = (spark.sparkContext.applicationId, sf, limits)
    if key not in _WIDE_SCANS:
        _WIDE_SCANS[key] = scan_files(hi.wide_files(spark, sf), limits=limits)
    return _WIDE_SCANS[key]


@query(
    "G13_limits_met",
    f"""WITH w AS ({_WIDE}) SELECT doc_id, 'objects' AS stage, 'page walk budget exhausted' AS message FROM w WHERE pages > 4
    UNION ALL SELECT doc_id, 'objects', 'annotation budget exhausted' FROM w WHERE notes > 2
    UNION ALL SELECT doc_id, 'urls', 'script link budget exhausted' FROM w WHERE links > 1
    UNION ALL SELECT doc_id, 'urls', 'link budget exhausted' FROM w WHERE pages * notes + links > 9""",
)
def _(spark, sf):
    return wide_scan(spark, sf, SOME).evidence.errors.select("doc_id", "stage", "message")


@query(
    "U4_all_links",
    f"""WITH w AS ({_WIDE}) SELECT doc_id, pages * notes + links AS links, pages * notes AS dangerous,
      pages * notes AS actions, 0 AS errors FROM w""",
)
def _(spark, sf):
    """Without limits every link of every page and script is found, and nothing is reported."""
    found = wide_scan(spark, sf)
    from_actions = og.uri_targets(found.walk).where("source = 'action:/URI'").groupBy("doc_id").agg(
        F.count_distinct("target").alias("actions")
    )
    errors = found.evidence.errors.groupBy("doc_id").agg(F.count("*").alias("errors"))
    return (
        found.evidence.urls.groupBy("doc_id")
        .agg(F.count("*").alias("links"), F.count_if(ln.is_dangerous(F.col("scheme"))).alias("dangerous"))
        .join(from_actions, "doc_id").join(errors, "doc_id", "left")
        .withColumn("errors", F.coalesce("errors", F.lit(0)))
    )


# --------------------------------------------------------------- signatures
# Per bundled rule: when it fires on a text ``t``, and the names it then lists.
_RULE_SQL: dict[str, tuple[str, str]] = {}


def _signature(name: str, rule: str, condition: str, strings: str) -> None:
    _RULE_SQL[rule] = condition, strings

    @query(
        name,
        f"WITH {X.FILES} SELECT doc_id, {strings} AS strings FROM files WHERE {condition}",
    )
    def _(spark: SparkSession, sf: str) -> DataFrame:
        chosen = [r for r in sg.BUNDLED if r.rule == rule]
        hits = sg.signature_hits(I.pdf_files(spark, sf), chosen)
        return hits.select("doc_id", F.array_join("strings", ",").alias("strings"))


def _listed(*pairs: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '${name}' END" for name, test in pairs)
    return f"array_to_string(list_filter([{cases}], lambda s: s IS NOT NULL), ',')"


def _has(needle: str) -> str:
    return f"contains(t, '{needle}')"


def _hasi(needle: str) -> str:
    return f"contains(lower(t), '{needle.lower()}')"


_signature(
    "Y1_header_anomaly", "Header_Anomaly",
    "left(t, 4) <> '%PDF' AND instr(left(t, 1028), '%PDF') > 0", "'$shifted'",
)
_signature(
    "Y2_openaction_javascript", "OpenAction_JavaScript",
    f"{_hasi('/OpenAction')} AND ({_hasi('/JavaScript')} OR {_hasi('/JS')})",
    _listed(("open", _hasi("/OpenAction")), ("js1", _hasi("/JavaScript")), ("js2", _hasi("/JS"))),
)
_signature(
    "Y3_launch_action", "Launch_Action",
    f"{_hasi('/Launch')} AND ({_hasi('cmd.exe')} OR {_hasi('powershell')} OR {_has('/bin/sh')} OR {_hasi('rundll32')} OR {_hasi('mshta')} OR {_hasi('wscript')})",
    _listed(("launch", _hasi("/Launch")), ("cmd1", _hasi("cmd.exe")), ("cmd2", _hasi("powershell")),
            ("cmd3", _has("/bin/sh")), ("cmd4", _hasi("rundll32")), ("cmd5", _hasi("mshta")), ("cmd6", _hasi("wscript"))),
)
_signature(
    "Y9_jbig2_decoder", "JBIG2_Decoder", _has("/JBIG2Decode"), "'$jbig2'",
)
_E = "length(regexp_extract_all(t, '/[A-Za-z]{0,6}#[0-9A-Fa-f]{2}[A-Za-z]{0,6}#[0-9A-Fa-f]{2}')) > 4"
_signature(
    "Y10_name_obfuscation", "Name_Obfuscation",
    f"{_hasi('/J#61vaScript')} OR {_hasi('/#4Aava#53cript')} OR {_hasi('/Op#65nAction')} OR {_hasi('/#4C#61unch')} OR {_E}",
    _listed(("a", _hasi("/J#61vaScript")), ("b", _hasi("/#4Aava#53cript")), ("c", _hasi("/Op#65nAction")),
            ("d", _hasi("/#4C#61unch")), ("e", _E)),
)
_signature(
    "Y11_xfa_form", "XFA_Form", f"{_has('/XFA')} AND ({_has('xdp:xdp')} OR {_has('<script')})",
    _listed(("xfa", _has("/XFA")), ("xdp", _has("xdp:xdp")), ("script", _has("<script"))),
)
_signature(
    "Y12_phish_lure", "Credential_Phish_Lure",
    f"{_has('/URI')} AND ({_hasi('sign in to view')} OR {_hasi('verify your account')} OR {_hasi('your account will be suspended')} OR {_hasi('click here to unlock')} OR {_hasi('enable editing to view')})",
    _listed(("l1", _hasi("sign in to view")), ("l2", _hasi("verify your account")), ("l3", _hasi("your account will be suspended")),
            ("l4", _hasi("click here to unlock")), ("l5", _hasi("enable editing to view")), ("uri", _has("/URI"))),
)
_UNC = "regexp_matches(t, '\\\\\\\\[A-Za-z0-9._-]{2,}\\\\')"
_signature(
    "Y13_remote_template", "Remote_Template_Reference",
    f"({_has('/GoToR')} OR {_has('/GoToE')}) AND ({_UNC} OR {_hasi('smb://')} OR {_hasi('file://')})",
    _listed(("gotor", _has("/GoToR")), ("gotoe", _has("/GoToE")), ("unc", _UNC), ("smb", _hasi("smb://")), ("file", _hasi("file://"))),
)


def _script_signature(name: str, rule: str, condition: str, strings: str) -> None:
    """Script rules run over page scripts behind the action key they look for."""
    _RULE_SQL[rule] = condition, strings

    @query(
        name,
        f"WITH {X.SCRIPTS}, s AS (SELECT doc_id, '/JS (' || code || ')' AS t FROM scripts) "
        f"SELECT doc_id, {strings} AS strings FROM s WHERE {condition}",
    )
    def _(spark: SparkSession, sf: str) -> DataFrame:
        chosen = [r for r in sg.BUNDLED if r.rule == rule]
        text = F.concat(F.lit("/JS ("), F.col("code"), F.lit(")"))
        hits = sg.signature_hits(I.page_scripts(spark, sf), chosen, text)
        return hits.select("doc_id", F.array_join("strings", ",").alias("strings"))


_X90 = "contains(t, '\\x90\\x90\\x90\\x90')"
_script_signature(
    "Y5_heap_spray", "JavaScript_Heap_Spray",
    f"{_has('%u9090%u9090')} OR {_X90} OR {_hasi('sprayHeap')} OR {_hasi('heapLib')} OR {_hasi('shellcode')}",
    _listed(("nop1", _has("%u9090%u9090")), ("nop2", _X90), ("spray", _hasi("sprayHeap")), ("heap", _hasi("heapLib")), ("shell", _hasi("shellcode"))),
)
_OBF = [("eval", _hasi("eval(")), ("unescape", _hasi("unescape(")), ("charcode", _hasi("fromCharCode")), ("atob", _hasi("atob("))]
_script_signature(
    "Y6_script_obfuscation", "JavaScript_Obfuscation",
    f"{_hasi('/JS')} AND ({' + '.join(f'({t})::INT' for _, t in _OBF)}) >= 2",
    _listed(("js", _hasi("/JS")), *_OBF),
)
_API = [("collab_email", _has("Collab.collectEmailInfo")), ("collab_icon", _has("Collab.getIcon")),
        ("media", _has("media.newPlayer")), ("spell", _has("spell.customDictionaryOpen"))]
_script_signature(
    "Y7_exploit_api", "Exploit_API", " OR ".join(t for _, t in _API), _listed(*_API),
)
_script_signature(
    "Y8_printf_overflow", "Printf_Format_Overflow",
    "regexp_matches(t, '(?i)util\\.printf\\s*\\(\\s*[\"''][^\"'']{0,16}%[0-9]{3,}')", "'$overflow'",
)


@query(
    "Y4_embedded_executable",
    "SELECT doc_id, '$embed,' || CASE doc_id % 4 WHEN 1 THEN '$mz' WHEN 2 THEN '$elf' ELSE '$ole' END AS strings FROM documents WHERE doc_id % 4 <> 0",
)
def _(spark, sf):
    docs = I.table(spark, sf, "documents")
    magic = F.when(F.expr("doc_id % 4 = 1"), F.unhex(F.lit("4D5A9000"))).when(
        F.expr("doc_id % 4 = 2"), F.unhex(F.lit("7F454C46"))
    ).when(F.expr("doc_id % 4 = 3"), F.unhex(F.lit("D0CF11E0A1B11AE1"))).otherwise(F.unhex(F.lit("00")))
    text = latin1(F.concat(F.encode(F.lit("/embeddedfile "), "UTF-8"), magic, F.encode("text", "UTF-8")))
    chosen = [r for r in sg.BUNDLED if r.rule == "Embedded_Executable"]
    return sg.signature_hits(docs, chosen, text).select("doc_id", F.array_join("strings", ",").alias("strings"))


@query(
    "Y14_severity_weights",
    """SELECT o_orderpriority AS level, CASE o_orderpriority WHEN '1-URGENT' THEN 85 WHEN '2-HIGH' THEN 60 WHEN '3-MEDIUM' THEN 35 WHEN '5-LOW' THEN 20 ELSE 35 END AS weight,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS severity, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    level = F.replace(F.lower(F.regexp_extract("o_orderpriority", r"-(.*)$", 1)), F.lit("urgent"), F.lit("CRITICAL"))
    return (
        I.table(spark, sf, "orders")
        .select(
            F.col("o_orderpriority").alias("level"),
            sg.severity_weight(level).alias("weight"),
            sg.known_severity(level).alias("severity"),
        )
        .groupBy("level", "weight", "severity").agg(F.count("*").alias("n"))
    )


@query(
    "Y15_matched_strings",
    f"""WITH {X.FILE_INDICATORS} SELECT doc_id, count(*) AS rules, true AS within FROM ind WHERE rule_ord = 23 GROUP BY doc_id""",
)
def _(spark, sf):
    hits = sg.signature_hits(I.pdf_files(spark, sf))
    return hits.groupBy("doc_id").agg(
        F.count("*").alias("rules"), F.bool_and(F.size("strings").between(1, 20)).alias("within")
    )


def _all_rules_sql() -> str:
    """Every firing rule with its place and names, in one select per rule. The rule on
    embedded programs has no text form; no derived file holds such bytes."""
    parts = [
        f"SELECT doc_id, {k} AS sig_ord, '{r.rule}' AS rule, {_RULE_SQL[r.rule][1]} AS strings "
        f"FROM files WHERE {_RULE_SQL[r.rule][0]}"
        for k, r in enumerate(sg.BUNDLED) if r.rule in _RULE_SQL
    ]
    return f"WITH {X.FILES} {' UNION ALL '.join(parts)}"


@query("Y15_strings_in_order", _all_rules_sql())
def _(spark, sf):
    hits = pt.all_hits(I.pdf_files(spark, sf), sg.rule_set())
    return hits.select("doc_id", "sig_ord", "rule", F.array_join("strings", ",").alias("strings"))


_USER_RULE = sg.Signature(
    "User_Marker", "low", "custom", (sg.Pattern("m", "trailing-blob", nocase=True),), ((1, ("m",)),),
    namespace="user",
)


@query(
    "Y16_user_rules",
    f"SELECT doc_id, 'User_Marker' AS rule, 14 AS rules_loaded FROM documents WHERE {X.VALID} AND doc_id % 12 = 6",
)
def _(spark, sf):
    hits = pt.all_hits(I.pdf_files(spark, sf), sg.rule_set([_USER_RULE]))
    return hits.where("namespace = 'user'").select("doc_id", "rule", "rules_loaded")


def many_rules(count: int = 10_000) -> tuple[sg.Signature, ...]:
    """One rule per title, its pattern plain, in another case or a regular expression."""
    kinds = (
        lambda i: sg.Pattern("title", f"/Title (Doc {i})"),
        lambda i: sg.Pattern("title", f"/TITLE (doc {i})", nocase=True),
        lambda i: sg.Pattern("title", rf"/Title\s\(Doc {i}\)", "regex"),
    )
    kind = sg.Pattern("launch", "/Launch")
    return tuple(
        sg.Signature(
            f"Title_{i}", "low", "custom", (kinds[i % 3](i), kind, sg.Pattern("mz", "4D5A", "hex")),
            ((1, ("title",)), (1, ("launch", "mz"))), namespace="user",
        )
        for i in range(count)
    )


@query(
    "Y16_many_user_rules",
    f"""SELECT doc_id, 13 + doc_id AS sig_ord, 'Title_' || doc_id AS rule,
      CASE WHEN doc_id % 4 = 1 THEN '$title,$launch,$mz' ELSE '$title,$mz' END AS strings, 10013 AS rules_loaded
    FROM documents WHERE {X.VALID} AND doc_id < 10000""",
)
def _(spark, sf):
    hits = pt.all_hits(I.pdf_files(spark, sf), sg.rule_set(many_rules()))
    return hits.where("namespace = 'user'").select(
        "doc_id", "sig_ord", "rule", F.array_join("strings", ",").alias("strings"), "rules_loaded"
    )


@query("Y17_rules_loaded", f"WITH {X.FILE_INDICATORS} SELECT 13 AS rules_loaded, count(*) AS hits FROM ind WHERE rule_ord = 23")
def _(spark, sf):
    hits = sg.signature_hits(I.pdf_files(spark, sf), sg.rule_set())
    return hits.groupBy("rules_loaded").agg(F.count("*").alias("hits"))


# -------------------------------------------------------------------- rules
_RULE_IDS = {
    "R1": "PDF_JS_PRESENT", "R2": "PDF_JS_AUTO_EXEC", "R4": "PDF_JS_EXPLOIT_API",
    "R5": "PDF_LAUNCH_ACTION", "R6": "PDF_AUTO_ACTION", "R7": "PDF_REMOTE_REFERENCE",
    "R8": "PDF_XFA_FORM", "R9": "PDF_EMBEDDED_EXECUTABLE", "R10": "PDF_EMBEDDED_TYPE_MISMATCH",
    "R11": "PDF_EMBEDDED_RISKY_FILE", "R13": "PDF_DANGEROUS_URI", "R14": "PDF_RISKY_URL",
    "R15": "PDF_NAME_OBFUSCATION", "R16": "PDF_MANY_INCREMENTAL_UPDATES",
    "R17": "PDF_DATA_AFTER_EOF", "R18": "PDF_HEADER_OFFSET", "R19": "PDF_ENCRYPTED",
    "R20": "PDF_PARSE_FAILURE", "R21": "PDF_JBIG2_FILTER",
    "R22": "PDF_MINIMAL_DOC_WITH_ACTIVE_CONTENT",
}


def _rule(rule_id: str, code: str) -> None:
    @query(
        f"{rule_id}_{code.lower()}",
        f"WITH {X.FILE_INDICATORS} SELECT doc_id, code, severity, weight FROM ind WHERE code = '{code}'",
    )
    def _(spark: SparkSession, sf: str) -> DataFrame:
        one = [r for r in rl.BUNDLED if r.code == code]
        found = rl.apply_rules(scan(spark, sf).judged.summary(one[0].source), list(enumerate(one, 1)))
        return found.select("doc_id", "code", "severity", "weight")


for _id, _code in _RULE_IDS.items():
    _rule(_id, _code)


@query("R3_pdf_js_obfuscated", R3_SQL)
def _(spark, sf):
    from papersieve.functions.scripts import enrich_scripts, script_summary

    summary = script_summary(enrich_scripts(I.page_scripts(spark, sf)))
    one = [r for r in rl.BUNDLED if r.code == "PDF_JS_OBFUSCATED"]
    return rl.apply_rules(summary, [(3, one[0])]).select("doc_id", "severity", "weight")


@query(
    "R12_pdf_embedded_high_entropy",
    """WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, 7.0::DOUBLE + (l_partkey % 100) / 100.0::DOUBLE AS entropy, l_suppkey * 1000 + l_partkey AS size FROM lineitem)
    SELECT doc_id, 'medium' AS severity, 30 AS weight FROM a GROUP BY doc_id HAVING count(*) FILTER (WHERE entropy >= 7.5 AND size > 2048) > 0""",
)
def _(spark, sf):
    made = I.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "l_linenumber AS ord", "concat('f', l_linenumber) AS name",
        "CAST(NULL AS STRING) AS extension", "CAST(NULL AS STRING) AS magic_bytes",
        "7.0D + (l_partkey % 100) / 100.0D AS entropy", "l_suppkey * 1000 + l_partkey AS size",
    )
    one = [r for r in rl.BUNDLED if r.code == "PDF_EMBEDDED_HIGH_ENTROPY"]
    return rl.apply_rules(rl.attachment_summary(made), [(12, one[0])]).select("doc_id", "severity", "weight")


@query(
    "R23_signature_indicators",
    f"WITH {X.FILE_INDICATORS} SELECT doc_id, code, severity, weight FROM ind WHERE rule_ord = 23",
)
def _(spark, sf):
    hits = sg.signature_hits(I.pdf_files(spark, sf))
    return sg.hit_indicators(hits, rl.SIGNATURE_RULE_ORD).select("doc_id", "code", "severity", "weight")


# ------------------------------------------------------------ whole-file scan
_SCAN_SQL = f"""WITH {X.FILE_INDICATORS}, agg AS ({X.SCORED})
  SELECT d.doc_id, coalesce({X.final_score('raw', 'sev', 'n_indicators')}, 0) AS score,
    {X.verdict("coalesce(" + X.final_score('raw', 'sev', 'n_indicators') + ", 0)")} AS verdict, coalesce(n_indicators, 0) AS n_indicators
  FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id"""


@query("file_scan_outcomes", _SCAN_SQL)
def file_scan_outcomes(spark, sf):
    """Bytes to verdict, nothing shared with other queries."""
    return scan_files(I.pdf_files(spark, sf)).outcomes.select(
        "doc_id", "score", "verdict", "n_indicators"
    )


@query(
    "E1_all_rules",
    f"WITH {X.FILE_INDICATORS} SELECT code, severity, weight, count(*) AS documents FROM ind GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return scan(spark, sf).indicators.groupBy("code", "severity", "weight").agg(
        F.count("*").alias("documents")
    )


@query(
    "E1_failing_rule",
    f"""WITH {X.FILE_INDICATORS} SELECT doc_id, code, 'found' AS said FROM ind
    UNION ALL SELECT doc_id, 'SITE_RATIO', CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'found' END FROM documents
      WHERE doc_id % 5 = 0 OR 12 // (doc_id % 5) >= 6""",
)
def _(spark, sf):
    """A rule that divides by zero on some documents, next to all others."""
    held = scan(spark, sf).evidence
    ratio = rl.Rule(
        "SITE_RATIO", "Ratio", "structure", lambda: F.expr("12 div (doc_id % 5) >= 6"), "low", 5, "site"
    )
    said = rl.evaluated(held, [*rl.registered_rules(), ratio])
    return said.select(
        "doc_id", F.coalesce("failed_rule", "code").alias("code"),
        F.when(F.col("failed_rule").isNull(), "found").otherwise("failed").alias("said"),
    )


# ------------------------------------------------------------------- scoring
def unique_indicators(spark: SparkSession, sf: str) -> DataFrame:
    raw = I.event_indicators(spark, sf)
    return raw.withColumn("ord", F.struct("ts", "event_id"))


@query(
    "E2_first_per_code",
    f"WITH {X.UNIQUE_INDICATORS} SELECT doc_id, code, rule_ord, weight FROM ind",
)
def _(spark, sf):
    return sc.first_per_code(unique_indicators(spark, sf)).select("doc_id", "code", "rule_ord", "weight")


_EVENT_SCORED = f"WITH {X.UNIQUE_INDICATORS}, agg AS ({X.SCORED.replace('ORDER BY rule_ord, ord', 'ORDER BY rule_ord')})"


@query("E3_noisy_or", f"{_EVENT_SCORED} SELECT doc_id, round(raw, 6) AS raw FROM agg")
def _(spark, sf):
    unique = sc.first_per_code(unique_indicators(spark, sf))
    ordered = F.array_sort(F.collect_list(F.struct("rule_ord", "weight")))
    return unique.groupBy("doc_id").agg(ordered.alias("w")).select(
        "doc_id", F.round(sc.noisy_or(F.transform("w", lambda s: s["weight"])), 6).alias("raw")
    )


@query(
    "E4_floors",
    f"{_EVENT_SCORED} SELECT doc_id, round(CASE WHEN sev = 4 THEN greatest(raw, 75.0::DOUBLE) WHEN sev = 3 THEN greatest(raw, 45.0::DOUBLE) ELSE raw END, 6) AS floored FROM agg",
)
def _(spark, sf):
    from papersieve import constants as K
    from papersieve.functions.text import rank_of

    unique = sc.first_per_code(unique_indicators(spark, sf))
    ordered = F.array_sort(F.collect_list(F.struct("rule_ord", "weight")))
    return unique.groupBy("doc_id").agg(
        ordered.alias("w"), F.max(rank_of(F.col("severity"), K.SEVERITY_ORDER)).alias("sev")
    ).select(
        "doc_id",
        F.round(sc.apply_floors(sc.noisy_or(F.transform("w", lambda s: s["weight"])), F.col("sev")), 6).alias("floored"),
    )


@query(
    "E5_sole_indicator_ceiling",
    f"{_EVENT_SCORED} SELECT doc_id, n_indicators = 1 AS sole, {X.final_score('raw', 'sev', 'n_indicators')} AS score FROM agg",
)
def _(spark, sf):
    scored = sc.outcomes(unique_indicators(spark, sf))
    return scored.select("doc_id", (F.col("n_indicators") == 1).alias("sole"), "score")


@query(
    "E6_rounded_score",
    f"{_EVENT_SCORED} SELECT doc_id, {X.final_score('raw', 'sev', 'n_indicators')} AS score, n_indicators FROM agg",
)
def _(spark, sf):
    return sc.outcomes(unique_indicators(spark, sf)).select("doc_id", "score", "n_indicators")


@query(
    "E7_verdict_bands",
    f"{_EVENT_SCORED}, f AS (SELECT {X.final_score('raw', 'sev', 'n_indicators')} AS score FROM agg) SELECT {X.verdict('score')} AS verdict, count(*) AS documents FROM f GROUP BY 1",
)
def _(spark, sf):
    return sc.outcomes(unique_indicators(spark, sf)).groupBy("verdict").agg(F.count("*").alias("documents"))


@query(
    "E8_top_indicators",
    f"WITH {X.UNIQUE_INDICATORS} SELECT doc_id, place, code FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, rule_ord)::INT AS place FROM ind) WHERE place <= 2",
)
def _(spark, sf):
    return sc.top_indicators(unique_indicators(spark, sf), 2).select("doc_id", "place", "code")


@query(
    "E9_rationale",
    f"""WITH {X.UNIQUE_INDICATORS} SELECT doc_id, string_agg('[' || upper(severity) || '|w=' || weight || '] ' || code || ': ' || title, '; ' ORDER BY weight DESC, rule_ord) AS rationale FROM ind GROUP BY doc_id""",
)
def _(spark, sf):
    return sc.outcomes(unique_indicators(spark, sf)).select(
        "doc_id", F.array_join("rationale", "; ").alias("rationale")
    )


@query(
    "E10_active_content",
    "SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'click' OR (event_type = 'purchase' AND value > 50)",
)
def _(spark, sf):
    events = I.table(spark, sf, "events").withColumnRenamed("user_id", "doc_id")
    acts = events.where("event_type = 'purchase'").withColumn("auto_executes", F.col("value") > 50)
    return sc.active_documents(events.where("event_type = 'click'"), acts)


@query(
    "E11_conclusive_clean",
    f"WITH {X.UNIQUE_INDICATORS}, docs AS (SELECT DISTINCT doc_id FROM raw_ind) SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ind WHERE severity <> 'info')",
)
def _(spark, sf):
    raw = unique_indicators(spark, sf)
    docs = raw.select("doc_id").distinct()
    return sc.outcomes(raw.where("severity <> 'info'"), docs).where("is_conclusive_clean").select("doc_id")


@query(
    "E12_max_severity",
    f"WITH {X.UNIQUE_INDICATORS} SELECT doc_id, CASE max(sev) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS max_severity FROM ind GROUP BY 1",
)
def _(spark, sf):
    return I.event_indicators(spark, sf).groupBy("doc_id").agg(
        sc.max_severity(F.col("severity")).alias("max_severity")
    )


_VERDICT_OF_ORDER = "CASE o_orderkey % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'low_risk' WHEN 2 THEN 'unknown' WHEN 3 THEN CASE WHEN o_custkey % 3 = 0 THEN 'suspicious' ELSE 'clean' END ELSE CASE WHEN o_custkey % 7 = 0 THEN 'malicious' ELSE 'low_risk' END END"


@query(
    "E13_worst_verdict",
    f"""WITH v AS (SELECT o_custkey, max(CASE {_VERDICT_OF_ORDER} WHEN 'clean' THEN 0 WHEN 'low_risk' THEN 1 WHEN 'unknown' THEN 2 WHEN 'suspicious' THEN 3 ELSE 4 END) AS r FROM orders GROUP BY 1)
    SELECT o_custkey, CASE r WHEN 0 THEN 'clean' WHEN 1 THEN 'low_risk' WHEN 2 THEN 'unknown' WHEN 3 THEN 'suspicious' ELSE 'malicious' END AS worst, CASE r WHEN 4 THEN 2 WHEN 3 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS exit_class FROM v""",
)
def _(spark, sf):
    rows = I.table(spark, sf, "orders").withColumn("verdict", F.expr(_VERDICT_OF_ORDER))
    worst = rows.groupBy("o_custkey").agg(sc.worst_verdict(F.col("verdict")).alias("worst"))
    return worst.withColumn("exit_class", sc.exit_class(F.col("worst")))


@query(
    "E14_blocking",
    f"SELECT count(*) AS blocked FROM orders WHERE {_VERDICT_OF_ORDER} IN ('suspicious', 'malicious')",
)
def _(spark, sf):
    rows = I.table(spark, sf, "orders").withColumn("verdict", F.expr(_VERDICT_OF_ORDER))
    return rows.where(sc.is_blocking(F.col("verdict"))).agg(F.count("*").alias("blocked"))


@query(
    "E15_ocr_candidates",
    f"SELECT doc_id FROM documents WHERE {X.VALID} AND {X.TEXT_CHARS} < 200",
)
def _(spark, sf):
    e = scan(spark, sf).evidence
    return sc.ocr_candidates(
        e.structure.select("doc_id", "text_excerpt"), e.scripts, e.actions, e.attachments, e.urls, e.hits
    )


# --------------------------------------------------------- extension surface
@query(
    "X1_custom_rule",
    f"SELECT doc_id, 'SITE_MANY_PAGES' AS code, 10 AS weight FROM documents WHERE {X.VALID} AND doc_id % 3 = 0",
)
def _(spark, sf):
    extra = rl.Rule(
        "SITE_MANY_PAGES", "More than one page", "structure", lambda: F.col("page_count") > 1,
        "low", 10, "site",
    )
    broken = rl.Rule("SITE_BROKEN", "Names a missing column", "structure", lambda: F.col("no_such") > 1, "low", 1, "site")
    found = rl.apply_rules(scan(spark, sf).evidence.structure, [(1, extra), (2, broken)])
    return found.select("doc_id", "code", "weight")


@query(
    "X4_sql_functions",
    f"{_EVENT_SCORED} SELECT doc_id, round_even(raw, 0)::INT AS score, CASE WHEN doc_id LIKE '%1' THEN 'malicious' ELSE 'low_risk' END AS worst FROM agg",
)
def _(spark, sf):
    sc.register_sql_functions(spark)
    unique = sc.first_per_code(unique_indicators(spark, sf))
    listed = unique.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("rule_ord", "weight"))).alias("ws")
    )
    return listed.select(
        "doc_id",
        F.expr("noisy_or(transform(ws, s -> s.weight))").alias("score"),
        F.expr(
            "worst_of(array('clean', IF(doc_id LIKE '%1', 'malicious', 'clean'), 'low_risk'))"
        ).alias("worst"),
    )


@query(
    "X5_table_functions",
    f"""SELECT doc_id, 'http://185.220.101.7/verify' AS url FROM documents WHERE {X.VALID}
    UNION ALL SELECT doc_id, 'file://srv/' || doc_id || '.pdf' FROM documents WHERE {X.VALID} AND doc_id % 4 = 2
    UNION ALL SELECT doc_id, 'https://bit.ly/' || doc_id FROM documents WHERE {X.VALID} AND doc_id % 4 = 3
    UNION ALL SELECT doc_id, 'object ' || n FROM documents, range(1, 19) AS r(n) WHERE {X.VALID}""",
)
def _(spark, sf):
    sc.register_sql_functions(spark)
    texts = I.pdf_files(spark, sf).select("doc_id", latin1(F.col("content")).alias("body"))
    return spark.sql(
        "SELECT doc_id, u.url FROM {texts}, LATERAL swept_urls(body) AS u UNION ALL "
        "SELECT doc_id, concat('object ', o.obj) FROM {texts}, LATERAL object_bodies(body) AS o",
        texts=texts,
    )
