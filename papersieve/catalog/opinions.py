"""Gate, fusion, model responses and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from papersieve.catalog import fragments as X
from papersieve.catalog.documents import scan
from papersieve.catalog.registry import query
from papersieve.functions.text import let
from papersieve.operators import calls as cl
from papersieve.operators import evidence as evd
from papersieve.operators import gate as gt
from papersieve.plans import inputs as I

# A score and indicator count per order, covering 0..100 and 0..6.
_OUT = "SELECT o_orderkey AS doc_id, CAST(o_orderkey % 101 AS INT) AS score, CAST(o_custkey % 7 AS INT) AS n FROM orders"
_REASON = "CASE WHEN score < 25 THEN 'below_escalation_threshold' WHEN score >= 85 AND n <= 3 THEN 'high_score_thin_evidence' WHEN score >= 85 THEN 'above_escalation_threshold' ELSE 'ambiguous_band' END"


def outs(spark, sf):
    return I.derived(spark, sf, _OUT, "orders")


@query(
    "T1_gate_reason",
    f"""WITH o AS ({_OUT}) SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'forced' WHEN doc_id % 9 = 0 THEN 'budget_exhausted' ELSE {_REASON} END AS reason, 'ai_disabled' AS off, 'no_provider_configured' AS bare,
      CASE WHEN doc_id % 9 = 0 THEN 'budget_exhausted' ELSE 'always_escalate' END AS always FROM o""",
)
def _(spark, sf):
    score, n = F.col("score"), F.col("n")
    budget = F.expr("doc_id % 9 <> 0")
    model = gt.GateSettings(provider="table")
    return outs(spark, sf).select(
        "doc_id",
        gt.gate_reason(score, n, model, budget, F.expr("doc_id % 50 = 0")).alias("reason"),
        gt.gate_reason(score, n, gt.GateSettings(enabled=False)).alias("off"),
        gt.gate_reason(score, n, gt.GateSettings()).alias("bare"),
        gt.gate_reason(score, n, gt.GateSettings(provider="table", always=True), budget).alias("always"),
    )


_SAID = "CASE doc_id % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'low_risk' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'malicious' ELSE 'unknown' END"
_AI = "CAST((doc_id * 53 + 11) % 101 AS INT)"
_RECONCILED = f"CASE doc_id % 5 WHEN 0 THEN least(19, {_AI}) WHEN 1 THEN greatest(20, least(49, {_AI})) WHEN 2 THEN greatest(50, least(79, {_AI})) WHEN 3 THEN greatest(80, {_AI}) ELSE {_AI} END"
_BLEND = f"CASE WHEN n >= 5 THEN greatest(60, round_even(0.6::DOUBLE * ({_RECONCILED}) + (1.0::DOUBLE - 0.6::DOUBLE) * score, 0)::INT) ELSE round_even(0.6::DOUBLE * ({_RECONCILED}) + (1.0::DOUBLE - 0.6::DOUBLE) * score, 0)::INT END"


@query("T2_reconcile", f"WITH o AS ({_OUT}) SELECT doc_id, ({_RECONCILED})::INT AS used FROM o")
def _(spark, sf):
    return outs(spark, sf).select("doc_id", gt.reconcile_score(F.expr(_SAID), F.expr(_AI)).alias("used"))


@query("T3_blend", f"WITH o AS ({_OUT}), b AS (SELECT doc_id, {_BLEND} AS blended FROM o) SELECT doc_id, blended, {X.verdict('blended')} AS verdict FROM b")
def _(spark, sf):
    used = gt.reconcile_score(F.expr(_SAID), F.expr(_AI))
    return outs(spark, sf).select(
        "doc_id", gt.blend(used, F.col("score"), F.col("n") >= 5).alias("blended")
    ).withColumn("verdict", gt.verdict_of(F.col("blended")))


def _decisions(spark, sf):
    """Outcomes from the scores above, a call for two thirds of them."""
    o = outs(spark, sf).select(
        "doc_id", "score", F.col("n").alias("n_indicators"),
        F.when(F.col("n") >= 5, "critical").otherwise("medium").alias("max_severity"),
        F.expr("slice(transform(sequence(1, 6), i -> concat('Finding ', i)), 1, least(n, 3))").alias("top_titles"),
        gt.verdict_of(F.col("score")).alias("verdict"),
    )
    calls = outs(spark, sf).where("doc_id % 3 <> 0").select(
        "doc_id", F.expr("doc_id % 11 <> 0").alias("succeeded"), F.expr(_SAID).alias("ai_verdict"),
        F.expr(_AI).alias("ai_score"), F.lit(0.75).alias("ai_confidence"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE concat('model text ', doc_id) END").alias("ai_summary"),
        F.lit("http 500").alias("ai_error"),
    )
    return gt.decide(o, calls, gt.GateSettings(provider="table"))


_DECIDED = f"""o AS ({_OUT}), g AS (SELECT *, {_REASON} AS reason, doc_id % 3 <> 0 AS called FROM o),
u AS (SELECT *, reason IN ('high_score_thin_evidence', 'ambiguous_band') AS escalated, reason IN ('high_score_thin_evidence', 'ambiguous_band') AND called AND doc_id % 11 <> 0 AS used, {_SAID} AS said FROM g),
f AS (SELECT *, CASE WHEN used THEN {_BLEND} ELSE score END AS risk_score FROM u),
v AS (SELECT *, {X.verdict('risk_score')} AS verdict,
  CASE WHEN n = 0 THEN 'Nothing of note: the file holds no scripts, automatic actions, attached files or risky links.' ELSE
   CASE reason WHEN 'above_escalation_threshold' THEN 'The rules alone decide' WHEN 'below_escalation_threshold' THEN 'The rules found minor traits only' ELSE 'The rules found' END
   || ': ' || array_to_string(list_transform(range(1, least(n, 3)::BIGINT + 1), lambda i: 'finding ' || i), '; ')
   || CASE WHEN n = 4 THEN ' (+1 more finding)' WHEN n > 4 THEN ' (+' || (n - 3) || ' more findings)' ELSE '' END || '.' END AS own FROM f)"""


@query(
    "T4_fused_summaries",
    f"""WITH {_DECIDED} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN own ELSE 'model text ' || doc_id END
      || CASE WHEN n >= 5 AND said IN ('clean', 'low_risk') THEN ' A critical indicator keeps this file at ''suspicious'' or above.'
         WHEN verdict <> said THEN ' Second opinion: ''' || replace(said, '_', ' ') || '''. Both together score ' || risk_score || ' of 100, which is ''' || replace(verdict, '_', ' ') || '''.' ELSE '' END AS summary FROM v WHERE used""",
)
def _(spark, sf):
    return _decisions(spark, sf).where("used_ai").select("doc_id", "summary")


@query(
    "T5_fallback",
    f"""WITH {_DECIDED} SELECT doc_id, escalated, risk_score, verdict, 'heuristics' AS decided_by, CASE WHEN escalated THEN own || ' AI review was unavailable (' || CASE WHEN called THEN 'http 500' ELSE 'None' END || ').' ELSE own END AS summary FROM v WHERE NOT used""",
)
def _(spark, sf):
    return _decisions(spark, sf).where("NOT used_ai").select(
        "doc_id", "escalated", "risk_score", "verdict", "decided_by", "summary"
    )


@query("T6_static_confidence", f"WITH o AS ({_OUT}) SELECT doc_id, round(0.5::DOUBLE + 0.4::DOUBLE * (abs(score - 50) / 50.0::DOUBLE), 3) AS confidence FROM o")
def _(spark, sf):
    return outs(spark, sf).select("doc_id", gt.static_confidence(F.col("score")).alias("confidence"))


@query("T7_static_summary", f"WITH {_DECIDED} SELECT doc_id, own AS summary FROM v WHERE NOT escalated")
def _(spark, sf):
    return _decisions(spark, sf).where("NOT escalated").select("doc_id", "summary")


# ------------------------------------------------------------ model responses
_LABEL = "CASE turn % 7 WHEN 0 THEN ' Benign ' WHEN 1 THEN 'LOW RISK' WHEN 2 THEN 'potentially-malicious' WHEN 3 THEN 'Malware' WHEN 4 THEN 'no threat' WHEN 5 THEN 'inconclusive' ELSE 'dunno' END"
_NORMAL = "CASE turn % 7 WHEN 0 THEN 'clean' WHEN 1 THEN 'low_risk' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'malicious' WHEN 4 THEN 'clean' WHEN 5 THEN 'unknown' ELSE 'invalid' END"


@query("L1_verdict_labels", f"SELECT conv_id, turn, {_NORMAL} AS verdict FROM conversations")
def _(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce(cl.normalise_verdict(F.expr(_LABEL)), F.lit("invalid")).alias("verdict")
    )


# Verdict objects with every kind of defect, by message length.
_PAYLOAD = f"""concat('{{"verdict": "', {_LABEL}, '", "risk_score": ',
  CASE length(text) % 5 WHEN 0 THEN '500' WHEN 1 THEN '-20' WHEN 2 THEN '41.9' WHEN 3 THEN '"64"' ELSE '"640"' END,
  ', "confidence": ', CASE WHEN length(text) % 6 = 0 THEN '1.5' ELSE '0.5' END,
  ', "summary": "', CASE WHEN length(text) % 13 = 0 THEN repeat('s', 1001) ELSE concat('s', CAST(turn AS STRING)) END, '"',
  CASE WHEN length(text) % 7 = 0 THEN ', "recommended_action": "shrug"' WHEN length(text) % 7 = 1 THEN ', "recommended_action": "block"' ELSE '' END, '}}')"""
_VALID = f"({_NORMAL} <> 'invalid' AND length(text) % 5 <> 4 AND length(text) % 6 <> 0 AND length(text) % 13 <> 0 AND length(text) % 7 <> 0)"
_SCORE = "CASE length(text) % 5 WHEN 0 THEN 100 WHEN 1 THEN 0 WHEN 2 THEN 41 WHEN 3 THEN 64 ELSE -1 END"


def messages(spark, sf, expression: str, name: str):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.expr(expression).alias(name)
    )


@query(
    "L2_validated_fields",
    f"SELECT conv_id, turn, {_VALID} AS valid, {_SCORE} AS risk_score, CASE WHEN length(text) % 7 = 0 THEN 'shrug' WHEN length(text) % 7 = 1 THEN 'block' ELSE 'review' END AS action FROM conversations",
)
def _(spark, sf):
    v = cl.validated(F.col("p"))
    return messages(spark, sf, _PAYLOAD, "p").withColumn("v", v).select(
        "conv_id", "turn", "v.valid", F.coalesce("v.risk_score", F.lit(-1)).alias("risk_score"),
        F.col("v.recommended_action").alias("action"),
    )


_ARG = 'concat(\'{"verdict": "clean", "n": \', CAST(turn AS STRING), \'}\')'
_QUOTED = f"replace({_ARG}, '\"', concat(chr(92), '\"'))"
_RESPONSE = f"""CASE turn % 6
  WHEN 0 THEN concat('{{"choices": [{{"message": {{"tool_calls": [{{"function": {{"name": "other", "arguments": "x"}}}}, {{"function": {{"name": "submit_pdf_verdict", "arguments": "', {_QUOTED}, '"}}}}]}}}}]}}')
  WHEN 1 THEN concat('{{"choices": [{{"message": {{"tool_calls": [{{"function": {{"name": "submit_pdf_verdict", "arguments": ', {_ARG}, '}}}}]}}}}]}}')
  WHEN 2 THEN concat('{{"choices": [{{"message": {{"function_call": {{"arguments": "', {_QUOTED}, '"}}}}}}]}}')
  WHEN 3 THEN concat('{{"choices": [{{"message": {{"content": "Here: ', {_QUOTED}, ' done"}}}}]}}')
  WHEN 4 THEN concat('{{"choices": [{{"message": {{"content": [{{"text": "', {_QUOTED}, '"}}]}}}}]}}')
  ELSE '{{"choices": [{{"message": {{"content": "no idea"}}}}]}}' END"""


@query("L3_payload_extraction", "SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN -1 ELSE turn END::INT AS n FROM conversations")
def _(spark, sf):
    payload = let(cl.parsed_response(F.col("r")), cl.verdict_payload)
    return messages(spark, sf, _RESPONSE, "r").select(
        "conv_id", "turn", F.coalesce(F.get_json_object(payload, "$.n").cast("int"), F.lit(-1)).alias("n")
    )


_LOOSE = f"""CASE turn % 5 WHEN 0 THEN concat('```json', chr(10), {_ARG}, chr(10), '```') WHEN 1 THEN concat('Sure! ', {_ARG}, ' Bye') WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'nothing {{ here' ELSE {_ARG} END"""


@query("L4_tolerant_json", "SELECT conv_id, turn, CASE WHEN turn % 5 IN (2, 3) THEN -1 ELSE turn END::INT AS n FROM conversations")
def _(spark, sf):
    found = F.get_json_object(cl.tolerant_json(F.col("r")), "$.n").cast("int")
    return messages(spark, sf, _LOOSE, "r").select("conv_id", "turn", F.coalesce(found, F.lit(-1)).alias("n"))


_PROBLEM = """CASE turn % 5 WHEN 0 THEN '{"choices": [{"finish_reason": "length", "message": {"content": " "}}], "usage": {"completion_tokens_details": {"reasoning_tokens": 900}}}'
  WHEN 1 THEN '{"choices": [{"finish_reason": "max_tokens", "message": {}}]}' WHEN 2 THEN '{"choices": [{"finish_reason": "content_filter", "message": {"content": "x"}}]}'
  WHEN 3 THEN '{"choices": []}' ELSE '{"choices": [{"finish_reason": "length", "message": {"content": "partial"}}]}' END"""


@query("L5_diagnosis", "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'truncated_by_reasoning' WHEN 1 THEN 'truncated' WHEN 2 THEN 'content_filter' WHEN 3 THEN 'no_message' ELSE 'none' END AS problem FROM conversations")
def _(spark, sf):
    problem = let(cl.parsed_response(F.col("r")), cl.response_problem)
    return messages(spark, sf, _PROBLEM, "r").select(
        "conv_id", "turn", F.coalesce(problem, F.lit("none")).alias("problem")
    )


_STATUS = "CAST(list_extract([200, 429, 500, 401, 404, 529, 403, 408, 200, 429], CAST(event_id % 10 AS INT) + 1) AS INT)"
_BODY = "CASE WHEN event_id % 3 = 0 THEN 'You exceeded your current QUOTA' WHEN event_id % 3 = 1 THEN 'quota exceeded: 30 requests per minute' ELSE 'slow down' END"


@query(
    "L6_call_class",
    f"SELECT event_id, CASE WHEN s = 429 AND event_id % 3 = 0 THEN 'quota' WHEN s IN (408, 429, 500, 529) THEN 'retryable' WHEN s IN (401, 403) THEN 'auth' WHEN s >= 400 THEN 'invalid' ELSE 'ok' END AS class FROM (SELECT event_id, {_STATUS} AS s FROM events)",
)
def _(spark, sf):
    status = F.element_at(
        F.array(*[F.lit(s) for s in (200, 429, 500, 401, 404, 529, 403, 408, 200, 429)]),
        F.expr("CAST(event_id % 10 AS INT) + 1"),
    )
    return I.table(spark, sf, "events").select("event_id", cl.call_class(status, F.expr(_BODY)).alias("class"))


@query("L7_total_tokens", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END + CASE WHEN turn % 2 = 0 THEN 0 ELSE 7 END AS tokens FROM conversations")
def _(spark, sf):
    prompt = F.when(F.expr("turn % 3 <> 0"), F.length("text"))
    answer = F.when(F.expr("turn % 2 <> 0"), 7)
    return I.table(spark, sf, "conversations").select("conv_id", "turn", cl.total_tokens(prompt, answer).alias("tokens"))


_CALLS = "SELECT event_id, concat('model', CAST(user_id % 20 AS STRING)) AS model, CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, CAST(event_id % 500 AS BIGINT) AS completion_tokens FROM events"
_PRICES = "SELECT concat('model', CAST(n_nationkey AS STRING)) AS model, n_nationkey * 1 AS usd_in, n_nationkey * 5 AS usd_out FROM nation WHERE n_nationkey < 15"


@query("L8_cost", f"WITH c AS ({_CALLS}), p AS ({_PRICES}) SELECT event_id, coalesce(round(prompt_tokens / 1e6::DOUBLE * usd_in::DOUBLE + completion_tokens / 1e6::DOUBLE * usd_out::DOUBLE, 6), -1.0::DOUBLE) AS cost FROM c LEFT JOIN p USING (model)")
def _(spark, sf):
    prices = I.derived(spark, sf, _PRICES, "nation").withColumns(
        {"usd_in": F.col("usd_in").cast("double"), "usd_out": F.col("usd_out").cast("double")}
    )
    priced = cl.with_cost(I.derived(spark, sf, _CALLS, "events"), prices)
    return priced.select("event_id", F.coalesce("cost_usd", F.lit(-1.0)).alias("cost"))


@query("responses_end_to_end", "SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN 'no_json' ELSE 'invalid_fields' END AS problem FROM conversations")
def _(spark, sf):
    rows = messages(spark, sf, _RESPONSE, "response").withColumn("doc_id", F.struct("conv_id", "turn"))
    return cl.parse_responses(rows.select("doc_id", "response")).select("doc_id.*", "problem")


# Complete verdicts in every form a response may have.
_GIVEN_VERDICT = """CASE turn % 4 WHEN 0 THEN 'malicious' WHEN 1 THEN 'clean' WHEN 2 THEN 'suspicious' ELSE 'low_risk' END"""
_WHOLE_VERDICT = f"""concat('{{"verdict": "', {_GIVEN_VERDICT}, '", "risk_score": ', CAST(conv_id % 101 AS STRING), ', "confidence": 0.5, "summary": " seen ', CAST(conv_id AS STRING), ' ", "recommended_action": "block", "false_positive_risk": "low"}}')"""
_VERDICT_RESPONSES = f"""concat(regexp_replace({_RESPONSE.replace(_ARG, _WHOLE_VERDICT)}, '.$', ', "usage": {{"prompt_tokens": 100'),
  CASE WHEN turn % 6 = 5 THEN '' ELSE concat(', "completion_tokens": ', CAST(turn AS STRING)) END, '}}}}')"""


@query(
    "responses_with_verdicts",
    f"""SELECT conv_id, turn, CASE WHEN turn % 6 <> 5 THEN {_GIVEN_VERDICT} END AS verdict, CASE WHEN turn % 6 <> 5 THEN conv_id % 101 END::INT AS risk_score,
      CASE WHEN turn % 6 <> 5 THEN 0.5 END::DOUBLE AS confidence, CASE WHEN turn % 6 <> 5 THEN 'seen ' || conv_id END AS summary,
      CASE WHEN turn % 6 <> 5 THEN 'block' ELSE 'review' END AS action, CASE WHEN turn % 6 = 5 THEN 'no_json' END AS problem,
      CASE WHEN turn % 6 = 5 THEN 100 ELSE 100 + turn END AS total_tokens FROM conversations""".replace("STRING", "VARCHAR"),
)
def _(spark, sf):
    rows = messages(spark, sf, _VERDICT_RESPONSES, "response").withColumn("doc_id", F.struct("conv_id", "turn"))
    return cl.parse_responses(rows.select("doc_id", "response")).select(
        "doc_id.*", "verdict", "risk_score", "confidence", "summary", F.col("recommended_action").alias("action"),
        "problem", F.col("total_tokens").cast("bigint").alias("total_tokens"),
    )


# ------------------------------------------------------------------ evidence
@query(
    "L9_evidence_bundle",
    f"""WITH {X.FILE_INDICATORS}, n AS (SELECT doc_id, count(*)::INT AS n FROM ind GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS indicators, (CASE WHEN d.{X.VALID} AND d.doc_id % 29 = 3 THEN 1 ELSE 0 END + CASE WHEN d.doc_id % 41 = 9 THEN 1 ELSE 0 END + CASE WHEN d.{X.VALID} AND d.doc_id % 19 = 4 THEN 1 ELSE 0 END)::INT AS parse_errors,
      CASE WHEN d.doc_id % 41 = 9 THEN 0 WHEN d.doc_id % 4 IN (2, 3) THEN 2 ELSE 1 END AS urls, CASE WHEN d.doc_id % 41 = 9 THEN 0 ELSE 2 END AS min_scripts FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""",
)
def _(spark, sf):
    b = evd.evidence_bundles(scan(spark, sf))
    length = lambda key: F.coalesce(F.json_array_length(F.get_json_object("bundle", f"$.{key}")), F.lit(0))
    return b.select(
        "doc_id", length("indicators").alias("indicators"), length("parse_errors").alias("parse_errors"),
        length("urls").alias("urls"), F.least(length("scripts"), F.lit(2)).alias("min_scripts"),
    )


@query(
    "L9_bundle_values",
    f"""WITH {X.FILE_INDICATORS}, n AS (SELECT doc_id, string_agg(code || ' ' || severity || ' ' || weight, ',' ORDER BY weight DESC, rule_ord, ord) AS indicators FROM ind GROUP BY 1)
    SELECT d.doc_id, coalesce(n.indicators, '') AS indicators,
      CASE WHEN d.doc_id % 41 = 9 THEN 'open failed: no resolvable catalog' ELSE array_to_string(list_filter([
        CASE WHEN d.doc_id % 19 = 4 THEN 'encrypted: contents are not decrypted' END,
        CASE WHEN d.doc_id % 29 = 3 THEN 'missing %PDF- header' END], lambda s: s IS NOT NULL), ',') END AS errors,
      CASE WHEN d.doc_id % 41 = 9 THEN '' ELSE (CASE WHEN d.doc_id % 4 = 2 THEN 'file://srv/' || d.doc_id || '.pdf,' ELSE '' END)
        || 'http://185.220.101.7/verify' || (CASE WHEN d.doc_id % 4 = 3 THEN ',https://bit.ly/' || d.doc_id ELSE '' END) END AS urls
    FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""",
)
def _(spark, sf):
    b = evd.evidence_bundles(scan(spark, sf))
    said = F.from_json(
        "bundle",
        "indicators array<struct<code:string,severity:string,weight:int>>, parse_errors array<string>, urls array<struct<url:string>>",
    )
    listed = lambda items: F.coalesce(F.array_join(items, ","), F.lit(""))
    return b.select("doc_id", said.alias("b")).select(
        "doc_id",
        listed(F.transform("b.indicators", lambda i: F.concat_ws(" ", i["code"], i["severity"], i["weight"].cast("string")))).alias("indicators"),
        listed(F.col("b.parse_errors")).alias("errors"),
        listed(F.transform("b.urls", lambda u: u["url"])).alias("urls"),
    )


_SCRIPT_ROWS = "SELECT user_id AS doc_id, event_id AS ord, event_type AS location, repeat('x', CAST(floor(value * 40) AS INT)) AS code, CAST(event_id % 7 AS DOUBLE) / 10.0 AS obfuscation_score FROM events"


@query(
    "L10_script_budget",
    f"""WITH s AS ({_SCRIPT_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY obfuscation_score DESC, length(code) DESC, ord)::INT AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
    b AS (SELECT *, greatest(0, 9000 - (doc_id * 1000 % 9000)) AS remaining FROM r WHERE place <= 6)
    SELECT doc_id, place, least(length(code), greatest(400, remaining // least(n, 6)))::INT AS chars, length(code) > greatest(400, remaining // least(n, 6)) AS cut FROM b WHERE remaining >= 400""",
)
def _(spark, sf):
    rows = I.derived(spark, sf, _SCRIPT_ROWS, "events").withColumns(
        {"length": F.length("code"), "truncated": F.lit(False), "suspicious_tokens": F.array().cast("array<string>"),
         "obfuscation_score": F.col("obfuscation_score").cast("double")}
    )
    sizes = rows.select("doc_id").distinct().withColumn("bundle_chars", F.expr("CAST(doc_id * 1000 % 9000 AS INT)"))
    return evd.fit_scripts(rows, sizes, 9000).select("doc_id", "place", F.length("code").alias("chars"), "cut")


@query(
    "L11_shrink",
    "SELECT conv_id, turn, array_to_string(CASE WHEN length(w) > 5 THEN list_concat(w[1:5], ['...+' || (length(w) - 5) || ' more']) ELSE w END, '|') AS items, CASE WHEN length(text) > 600 THEN left(text, 600) || '...' ELSE text END AS clipped FROM (SELECT conv_id, turn, text, string_split(text, ' ') AS w FROM conversations)",
)
def _(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(evd.shrink_list(F.split("text", " ")), "|").alias("items"),
        evd.shrink_text(F.col("text")).alias("clipped"),
    )


@query("L12_token_estimate", "SELECT conv_id, turn, floor(length(text) / 3.6::DOUBLE)::INT AS tokens FROM conversations")
def _(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", cl.token_estimate(F.length("text")).alias("tokens")
    )


@query(
    "L13_prompts",
    f"""WITH {X.FILE_INDICATORS} SELECT d.doc_id, true AS has_file, true AS closes, coalesce(n > 0, false) AS has_indicators, d.{X.VALID} AS has_scripts, d.{X.VALID} AND d.doc_id % 6 = 1 AS has_metadata, false AS has_score
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ind GROUP BY 1) i ON d.doc_id = i.doc_id""",
)
def _(spark, sf):
    p = F.col("prompt")
    has = lambda title: F.contains(p, F.lit(f"## {title}\n"))
    return evd.prompts(evd.evidence_bundles(scan(spark, sf))).select(
        "doc_id", F.startswith(p, F.lit("## File\n")).alias("has_file"),
        F.endswith(p, F.lit("with your verdict.")).alias("closes"),
        has("Findings of the rules").alias("has_indicators"), has("Scripts in the file").alias("has_scripts"),
        has("Metadata of the file").alias("has_metadata"), has("Assessment by rules").alias("has_score"),
    )


@query("L14_pick_one", f"WITH {X.RESULTS} SELECT path FROM results WHERE label = 'malware' AND error = '' ORDER BY score BETWEEN 25 AND 85 DESC, sha256(path || '|20260804') LIMIT 1")
def _(spark, sf):
    return evd.pick_one(I.results(spark, sf), "malware").select("path")
