"""Checking-SQL fragments shared by several queries."""

from __future__ import annotations

from papersieve.plans import inputs as I

FILES = f"files AS (SELECT doc_id, source, text, {I.PDF_TEXT} AS t FROM documents)"
SCRIPTS = f"scripts AS (SELECT page_id AS doc_id, {I.SCRIPT_CODE} AS code FROM pages)"
URLS = f"urls AS (SELECT page_id AS doc_id, {I.PAGE_URL} AS raw_url FROM pages)"
RESULTS = f"results AS ({I.RESULTS_SELECT})"
CHANGES = f"changes AS ({I.CHANGES_SELECT})"
SCANS = f"scans AS ({I.SCANS_SELECT})"
EVENT_INDICATORS = f"raw_ind AS ({I.EVENT_INDICATORS_SELECT})"
UNIQUE_INDICATORS = (
    EVENT_INDICATORS
    + """, ind AS (
  SELECT doc_id, code, rule_ord, title, severity, weight,
    CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sev
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY rule_ord, ts, event_id) rn FROM raw_ind) WHERE rn = 1)"""
)


def decoded(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '#[0-9A-Fa-f]{{2}}|[^#]+|#'), "
        "lambda p: CASE WHEN regexp_full_match(p, '#[0-9A-Fa-f]{2}') "
        "THEN chr(('0x' || substr(p, 2, 2))::INT) ELSE p END), '')"
    )


def count_of(text: str, needle: str) -> str:
    safe = needle.replace("'", "''")
    return f"((length({text}) - length(replace({text}, '{safe}', ''))) // {len(needle)})"


def entropy(rows: str, key: str, text: str) -> str:
    """CTE body: ``key, bits`` from the UTF-8 bytes of a text column."""
    return f"""
  SELECT {key}, -sum(p * log2(p)) AS bits FROM (
    SELECT {key}, n / sum(n) OVER (PARTITION BY {key})::DOUBLE AS p FROM (
      SELECT {key}, substr(h, 2 * i + 1, 2) AS b, count(*)::DOUBLE AS n
      FROM (SELECT {key}, hex(encode({text})) AS h, unnest(range(0, strlen({text}))) AS i FROM {rows})
      GROUP BY 1, 2))
  GROUP BY 1"""


SCORED = """
  SELECT doc_id, count(*)::INT AS n_indicators, max(sev) AS sev,
    (1.0::DOUBLE - list_reduce(list_concat([1.0::DOUBLE], list((1.0::DOUBLE - least(weight, 99)::DOUBLE / 100.0::DOUBLE) ORDER BY rule_ord, ord)), lambda a, x: a * x)) * 100.0::DOUBLE AS raw
  FROM ind GROUP BY doc_id"""


def final_score(raw: str, sev: str, n: str) -> str:
    floored = f"CASE WHEN {sev} = 4 THEN greatest({raw}, 75.0::DOUBLE) WHEN {sev} = 3 THEN greatest({raw}, 45.0::DOUBLE) ELSE {raw} END"
    capped = f"CASE WHEN {n} = 1 THEN least({floored}, 79.0::DOUBLE) ELSE {floored} END"
    return f"round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, {capped})), 0)::INT"


def verdict(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 80 THEN 'malicious' WHEN {score} >= 50 THEN 'suspicious' "
        f"WHEN {score} >= 20 THEN 'low_risk' ELSE 'clean' END"
    )


# What the derived files must yield, from their arithmetic alone.
VALID = "doc_id % 41 <> 9"
CODE = (
    "'app.alert(' || doc_id || ');' || CASE WHEN doc_id % 10 = 3 THEN "
    "'eval(unescape(1));util.printf(2);' ELSE '' END"
)
TARGET = (
    "CASE doc_id % 4 WHEN 0 THEN '<javascript>' WHEN 1 THEN 'cmd.exe' "
    "WHEN 2 THEN 'file://srv/' || doc_id || '.pdf' ELSE 'https://bit.ly/' || doc_id END"
)
SUBTYPE = (
    "CASE doc_id % 4 WHEN 0 THEN '/JavaScript' WHEN 1 THEN '/Launch' WHEN 2 THEN '/GoToR' ELSE '/URI' END"
)
TEXT_CHARS = (
    "length(regexp_replace(trim(left(replace(replace(replace(text, chr(92), ' '), '(', ' '), ')', ' '), 4000), "
    "' ' || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g'))"
)
FILE_INDICATORS = f"""
facts AS (SELECT doc_id, {VALID} AS ok, doc_id % 41 = 9 AS broken,
  doc_id % 5 = 1 AS opens, doc_id % 31 = 7 AS root_aa, doc_id % 37 = 5 AS page_aa,
  doc_id % 7 = 2 AS named, (doc_id % 7 <> 2 AND doc_id % 11 = 4) AS attached,
  (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 9 = 3 THEN 1 ELSE 0 END
   + CASE WHEN doc_id % 6 = 2 THEN doc_id % 9 ELSE 0 END + 1) AS escapes, {TEXT_CHARS} AS chars
  FROM documents),
ind AS (
  SELECT doc_id, r.*, CASE r.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sev
  FROM (SELECT doc_id, unnest([
    {{'rule_ord': 1, 'ord': 0, 'code': 'PDF_JS_PRESENT', 'severity': 'medium', 'weight': 30, 'fires': ok}},
    {{'rule_ord': 2, 'ord': 0, 'code': 'PDF_JS_AUTO_EXEC', 'severity': 'high', 'weight': 55, 'fires': ok AND (((opens OR root_aa) AND doc_id % 4 = 0) OR named)}},
    {{'rule_ord': 4, 'ord': 0, 'code': 'PDF_JS_EXPLOIT_API', 'severity': 'critical', 'weight': 85, 'fires': ok AND doc_id % 10 = 3}},
    {{'rule_ord': 5, 'ord': 0, 'code': 'PDF_LAUNCH_ACTION', 'severity': 'critical', 'weight': 85, 'fires': ok AND doc_id % 4 = 1}},
    {{'rule_ord': 6, 'ord': 0, 'code': 'PDF_AUTO_ACTION', 'severity': 'low', 'weight': 15, 'fires': ok AND (opens OR root_aa OR page_aa)}},
    {{'rule_ord': 7, 'ord': 0, 'code': 'PDF_REMOTE_REFERENCE', 'severity': 'medium', 'weight': 35, 'fires': ok AND (root_aa OR page_aa) AND doc_id % 4 = 2}},
    {{'rule_ord': 8, 'ord': 0, 'code': 'PDF_XFA_FORM', 'severity': 'info', 'weight': 0, 'fires': ok AND doc_id % 9 = 3}},
    {{'rule_ord': 9, 'ord': 0, 'code': 'PDF_EMBEDDED_EXECUTABLE', 'severity': 'critical', 'weight': 90, 'fires': ok AND attached}},
    {{'rule_ord': 10, 'ord': 0, 'code': 'PDF_EMBEDDED_TYPE_MISMATCH', 'severity': 'high', 'weight': 60, 'fires': ok AND attached AND doc_id % 3 <> 0}},
    {{'rule_ord': 11, 'ord': 0, 'code': 'PDF_EMBEDDED_RISKY_FILE', 'severity': 'medium', 'weight': 40, 'fires': ok AND attached AND doc_id % 3 = 2}},
    {{'rule_ord': 13, 'ord': 0, 'code': 'PDF_DANGEROUS_URI', 'severity': 'high', 'weight': 60, 'fires': ok AND doc_id % 4 = 2}},
    {{'rule_ord': 14, 'ord': 0, 'code': 'PDF_RISKY_URL', 'severity': 'medium', 'weight': 25, 'fires': ok}},
    {{'rule_ord': 15, 'ord': 0, 'code': 'PDF_NAME_OBFUSCATION', 'severity': 'info', 'weight': 0, 'fires': ok AND escapes >= 5}},
    {{'rule_ord': 16, 'ord': 0, 'code': 'PDF_MANY_INCREMENTAL_UPDATES', 'severity': 'info', 'weight': 0, 'fires': ok AND doc_id % 5 >= 3}},
    {{'rule_ord': 17, 'ord': 0, 'code': 'PDF_DATA_AFTER_EOF', 'severity': 'medium', 'weight': 35, 'fires': ok AND doc_id % 12 = 6}},
    {{'rule_ord': 18, 'ord': 0, 'code': 'PDF_HEADER_OFFSET', 'severity': 'medium', 'weight': 40, 'fires': ok AND doc_id % 13 = 5 AND doc_id % 29 <> 3}},
    {{'rule_ord': 19, 'ord': 0, 'code': 'PDF_ENCRYPTED', 'severity': 'medium', 'weight': 30, 'fires': ok AND doc_id % 19 = 4}},
    {{'rule_ord': 20, 'ord': 0, 'code': 'PDF_PARSE_FAILURE', 'severity': 'medium', 'weight': 40, 'fires': broken}},
    {{'rule_ord': 21, 'ord': 0, 'code': 'PDF_JBIG2_FILTER', 'severity': 'medium', 'weight': 30, 'fires': ok AND doc_id % 15 = 8}},
    {{'rule_ord': 22, 'ord': 0, 'code': 'PDF_MINIMAL_DOC_WITH_ACTIVE_CONTENT', 'severity': 'high', 'weight': 50, 'fires': ok AND doc_id % 3 <> 0 AND chars < 200}},
    {{'rule_ord': 23, 'ord': 0, 'code': 'YARA_HEADER_ANOMALY', 'severity': 'medium', 'weight': 35, 'fires': ok AND doc_id % 13 = 5 AND doc_id % 29 <> 3}},
    {{'rule_ord': 23, 'ord': 1, 'code': 'YARA_OPENACTION_JAVASCRIPT', 'severity': 'high', 'weight': 60, 'fires': ok AND opens}},
    {{'rule_ord': 23, 'ord': 2, 'code': 'YARA_LAUNCH_ACTION', 'severity': 'critical', 'weight': 85, 'fires': ok AND doc_id % 4 = 1}},
    {{'rule_ord': 23, 'ord': 5, 'code': 'YARA_JAVASCRIPT_OBFUSCATION', 'severity': 'high', 'weight': 60, 'fires': ok AND doc_id % 10 = 3}},
    {{'rule_ord': 23, 'ord': 8, 'code': 'YARA_JBIG2_DECODER', 'severity': 'medium', 'weight': 35, 'fires': ok AND doc_id % 15 = 8}},
    {{'rule_ord': 23, 'ord': 9, 'code': 'YARA_NAME_OBFUSCATION', 'severity': 'medium', 'weight': 35, 'fires': ok AND (doc_id % 4 = 0 OR (doc_id % 6 = 2 AND doc_id % 9 >= 5))}},
    {{'rule_ord': 23, 'ord': 10, 'code': 'YARA_XFA_FORM', 'severity': 'medium', 'weight': 35, 'fires': ok AND doc_id % 9 = 3}},
    {{'rule_ord': 23, 'ord': 11, 'code': 'YARA_CREDENTIAL_PHISH_LURE', 'severity': 'low', 'weight': 20, 'fires': ok AND doc_id % 17 = 2}},
    {{'rule_ord': 23, 'ord': 12, 'code': 'YARA_REMOTE_TEMPLATE_REFERENCE', 'severity': 'high', 'weight': 60, 'fires': ok AND doc_id % 4 = 2}}
  ]) AS r FROM facts) WHERE r.fires)"""


# Obfuscation score of page scripts.
_Q = "[\"\'\']"
OBFUSCATION = f"""{SCRIPTS}, e AS ({entropy('scripts', 'doc_id', 'code')}), sig AS (
  SELECT doc_id, code, bits, length(code)::DOUBLE AS len,
    length(regexp_extract_all(code, '\\\\x[0-9A-Fa-f]{{2}}|%u[0-9A-Fa-f]{{4}}|\\\\u[0-9A-Fa-f]{{4}}'))::DOUBLE AS esc,
    length(regexp_extract_all(code, '(?i)fromCharCode\\s*\\('))::DOUBLE AS calls,
    length(regexp_extract_all(code, '{_Q}[^\"\'\']{{0,4}}{_Q}\\s*\\+\\s*{_Q}'))::DOUBLE AS concats,
    regexp_matches(code, '{_Q}[A-Za-z0-9+/=%\\\\]{{200,}}{_Q}') OR regexp_matches(code, '[A-Za-z0-9+/]{{80,}}={{0,2}}') AS packed,
    list_max(list_transform(string_split(code, chr(10)), lambda l: length(l)))::DOUBLE AS longest,
    regexp_extract_all(code, '\\b[_$a-zA-Z][_$a-zA-Z0-9]{{0,40}}\\b') AS names
  FROM scripts JOIN e USING (doc_id)),
signals AS (SELECT doc_id, list_filter([
    least(1.0::DOUBLE, esc * 4 / len * 10),
    CASE WHEN calls > 0 THEN least(1.0::DOUBLE, 0.4::DOUBLE + calls * 0.1::DOUBLE) END,
    CASE WHEN concats > 5 THEN least(1.0::DOUBLE, concats / 40.0::DOUBLE) END,
    CASE WHEN packed THEN 0.6::DOUBLE END,
    CASE WHEN bits > 5.2::DOUBLE THEN least(1.0::DOUBLE, (bits - 5.2::DOUBLE) / 2) END,
    CASE WHEN longest > 1000 THEN least(1.0::DOUBLE, longest / 5000.0::DOUBLE) END,
    CASE WHEN length(names) > 0 THEN least(1.0::DOUBLE, length(list_filter(names, lambda n: length(n) <= 2 OR starts_with(n, '_0x')))::DOUBLE / length(names)::DOUBLE) END
  ], lambda s: s IS NOT NULL) AS s FROM sig),
obf AS (SELECT doc_id, least(1.0::DOUBLE, list_sum(list_slice(list_reverse_sort(s), 1, 4))::DOUBLE / 4) AS score FROM signals)"""
R3_SQL = f"""WITH {OBFUSCATION} SELECT doc_id, CASE WHEN score >= 0.6995 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN score >= 0.6995 THEN 55 ELSE 35 END AS weight FROM obf WHERE score >= 0.4495"""
