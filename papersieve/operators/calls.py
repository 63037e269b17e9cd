"""Model responses as tables: parsing, validation, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.text import case_map, clamp

TOOL_NAME = "submit_pdf_verdict"
RESPONSE_SCHEMA = (
    "choices array<struct<finish_reason:string,message:struct<"
    "tool_calls:array<struct<function:struct<name:string,arguments:string>>>,"
    "function_call:struct<arguments:string>,content:string>>>,"
    "usage struct<prompt_tokens:int,completion_tokens:int,"
    "completion_tokens_details:struct<reasoning_tokens:int>>"
)


def normalise_verdict(label: Column) -> Column:
    """Known verdict for a free label through the alias list, else null."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")), "[ -]", "_")
    named = case_map(plain, K.VERDICT_ALIASES, plain)
    return F.when(named.isin(*K.VERDICT_ORDER), named)


def _unfenced(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.regexp_replace(trimmed, "^`+|`+$", "")
    body = F.when(F.contains(inner, F.lit("\n")), F.regexp_replace(inner, r"^[^\n]*\n", "")).otherwise(inner)
    return F.when(F.startswith(trimmed, F.lit("```")), body).otherwise(trimmed)


def _valid_json(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def tolerant_json(text: Column) -> Column:
    """JSON object text inside fences or prose; null when there is none."""
    cleaned = _unfenced(text)
    braced = F.nullif(F.regexp_extract(cleaned, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(_valid_json(cleaned), _valid_json(braced))
    return F.when(found.rlike(r"^\s*\{"), found)


def parsed_response(response: Column) -> Column:
    return F.from_json(response, RESPONSE_SCHEMA)


def _message(parsed: Column) -> Column:
    return F.try_element_at(parsed["choices"], F.lit(1))["message"]


def _content(message: Column) -> Column:
    """Plain content, or the joined text of content parts."""
    raw = message["content"]
    parts = F.from_json(raw, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.when(raw.rlike(r"^\s*\["), joined).otherwise(raw)


def verdict_payload(parsed: Column, tool: str = TOOL_NAME) -> Column:
    """The verdict object: from the tool call, the older call form, or the content."""
    message = _message(parsed)
    tools = F.filter(
        message["tool_calls"],
        lambda c: (c["function"]["name"] == tool) & c["function"]["arguments"].isNotNull(),
    )
    called = F.try_element_at(tools, F.lit(1))["function"]["arguments"]
    older = F.nullif(message["function_call"]["arguments"], F.lit(""))
    content = _content(message)
    spoken = F.when(F.length(F.trim(content)) > 0, content)
    return tolerant_json(F.coalesce(called, older, spoken))


def response_problem(parsed: Column) -> Column:
    """Why a response holds no verdict, null when it may hold one."""
    choice = F.try_element_at(parsed["choices"], F.lit(1))
    message = choice["message"]
    finish = F.coalesce(choice["finish_reason"], F.lit(""))
    empty = (F.coalesce(F.size(message["tool_calls"]), F.lit(0)) <= 0) & (
        F.length(F.trim(F.coalesce(_content(message), F.lit("")))) == 0
    )
    reasoning = F.coalesce(
        parsed["usage"]["completion_tokens_details"]["reasoning_tokens"], F.lit(0)
    )
    return (
        F.when(message.isNull(), "no_message")
        .when(finish.isin("length", "max_tokens") & empty & (reasoning > 0), "truncated_by_reasoning")
        .when(finish.isin("length", "max_tokens") & empty, "truncated")
        .when(finish == "content_filter", "content_filter")
    )


def validated(payload: Column) -> Column:
    """Struct of verdict fields plus ``valid``; one bad field makes a row invalid.

    A numeric score is truncated and clamped; a score given as text is accepted
    only when it already is a whole number in range.
    """
    tree = F.try_parse_json(payload)
    text = lambda key: F.get_json_object(payload, f"$.{key}")
    number = F.try_variant_get(tree, "$.risk_score", "double")
    quoted = F.schema_of_variant(F.try_variant_get(tree, "$.risk_score", "variant")) == "STRING"
    whole = text("risk_score").rlike(r"^\s*[+-]?\d+\s*$") & number.between(0, 100)
    score = F.when(
        ~quoted | whole,
        clamp(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)), F.lit(0), F.lit(100)),
    ).cast("int")
    confidence = F.try_variant_get(tree, "$.confidence", "double")
    summary = F.regexp_replace(text("summary"), r"^\s+|\s+$", "")
    action = F.coalesce(text("recommended_action"), F.lit("review"))
    risk = F.coalesce(text("false_positive_risk"), F.lit("medium"))
    verdict = normalise_verdict(text("verdict"))
    valid = (
        verdict.isNotNull()
        & score.isNotNull()
        & F.coalesce(confidence.between(0, 1), F.lit(False))
        & F.coalesce(F.length(summary) <= 1000, F.lit(False))
        & action.isin(*K.RECOMMENDED_ACTIONS)
        & risk.isin(*K.FALSE_POSITIVE_RISKS)
    )
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"),
        verdict.alias("verdict"),
        score.alias("risk_score"),
        confidence.alias("confidence"),
        summary.alias("summary"),
        action.alias("recommended_action"),
        risk.alias("false_positive_risk"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """``responses(doc_id, response)`` to one validated verdict row each."""
    parsed = responses.withColumn("_p", parsed_response(F.col("response")))
    held = parsed.withColumn("problem", response_problem(F.col("_p"))).withColumn(
        "payload", F.when(F.col("problem").isNull(), verdict_payload(F.col("_p")))
    )
    usage = F.col("_p.usage")
    return held.select(
        "doc_id",
        "problem",
        "payload",
        validated(F.col("payload")).alias("v"),
        usage["prompt_tokens"].alias("prompt_tokens"),
        usage["completion_tokens"].alias("completion_tokens"),
    ).select(
        "doc_id",
        "v.*",
        F.coalesce(
            "problem",
            F.when(F.col("payload").isNull(), "no_json").when(~F.col("v.valid"), "invalid_fields"),
        ).alias("problem"),
        total_tokens(F.col("prompt_tokens"), F.col("completion_tokens")).alias("total_tokens"),
    )


def quota_exhausted(body: Column) -> Column:
    """Whether a 429 body means a spent quota rather than too fast a pace."""
    lowered = F.lower(body)
    any_of = lambda words: F.exists(
        F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lowered, w)
    )
    return ~any_of(K.RATE_PHRASES) & any_of(K.QUOTA_PHRASES)


def call_class(status: Column, body: Column) -> Column:
    """Class of a call-log row: ok, quota, retryable, auth or invalid."""
    return (
        F.when((status == 429) & quota_exhausted(body), "quota")
        .when(status.isin(*K.RETRYABLE_STATUS), "retryable")
        .when(status.isin(401, 403), "auth")
        .when(status >= 400, "invalid")
        .otherwise("ok")
    )


def total_tokens(prompt: Column, completion: Column) -> Column:
    return F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost_usd`` from ``prices(model, usd_in, usd_out)`` per million tokens.

    A plain left join: adaptive execution broadcasts the price table when its
    measured size allows, and an unknown model costs null.
    """
    cost = (
        F.col("prompt_tokens") / F.lit(1e6) * F.col("usd_in")
        + F.col("completion_tokens") / F.lit(1e6) * F.col("usd_out")
    )
    return (
        calls.join(prices, "model", "left")
        .withColumn("cost_usd", F.round(cost, 6))
        .drop("usd_in", "usd_out")
    )


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / F.lit(K.CHARS_PER_TOKEN)).cast("int")
