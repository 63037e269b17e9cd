"""Second-opinion gate and the fusion of both opinions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.text import case_map, clamp
from papersieve.operators.scoring import verdict_of

OPEN_REASONS = ("always_escalate", "high_score_thin_evidence", "ambiguous_band", "forced")
CLEAN_SUMMARY = (
    "Nothing of note: the file holds no scripts, automatic actions, attached files "
    "or risky links."
)
RAISED_NOTE = (
    " A critical indicator keeps this file at 'suspicious' or above."
)
SUMMARY_PREFIXES = (
    ("above_escalation_threshold", "The rules alone decide"),
    ("below_escalation_threshold", "The rules found minor traits only"),
    ("ai_disabled", "Second opinions are off; the rules found"),
    ("no_provider_configured", "Nobody is set up to give a second opinion; the rules found"),
    ("budget_exhausted", "The budget for second opinions is spent; the rules found"),
)


@dataclass(frozen=True)
class GateSettings:
    enabled: bool = True
    provider: str = "null"
    always: bool = False
    low: int = K.GATE_MIN
    high: int = K.GATE_MAX
    thin: int = K.THIN_EVIDENCE_MAX


def gate_reason(
    score: Column,
    n_indicators: Column,
    settings: GateSettings = GateSettings(),
    has_budget: Column | None = None,
    forced: Column | None = None,
) -> Column:
    """Why a document is or is not sent on; the tests run in this fixed order."""
    budget = F.lit(True) if has_budget is None else has_budget
    never = F.lit(False) if forced is None else forced
    return (
        F.when(never, "forced")
        .when(F.lit(not settings.enabled), "ai_disabled")
        .when(F.lit(settings.provider == "null"), "no_provider_configured")
        .when(~budget, "budget_exhausted")
        .when(F.lit(settings.always), "always_escalate")
        .when(score < settings.low, "below_escalation_threshold")
        .when(
            (score >= settings.high) & (n_indicators <= settings.thin), "high_score_thin_evidence"
        )
        .when(score >= settings.high, "above_escalation_threshold")
        .otherwise("ambiguous_band")
    )


def escalates(reason: Column) -> Column:
    return reason.isin(*OPEN_REASONS)


def replays_gate(
    score: Column,
    n_indicators: Column,
    low: int = K.GATE_MIN,
    high: int = K.GATE_MAX,
    thin: int = K.THIN_EVIDENCE_MAX,
) -> Column:
    """The gate on a recorded row, from its score and indicator count alone."""
    return F.when(score < low, False).when(score >= high, n_indicators <= thin).otherwise(True)


def reconcile_score(verdict: Column, score: Column) -> Column:
    """Move a reported score into the band its own label implies."""
    low = F.coalesce(case_map(verdict, [(v, a) for v, a, _ in K.VERDICT_BANDS]), F.lit(0))
    high = F.coalesce(case_map(verdict, [(v, b) for v, _, b in K.VERDICT_BANDS]), F.lit(100))
    return clamp(score, low, high)


def blend(ai_score: Column, static_score: Column, has_critical: Column) -> Column:
    """60/40 blend, half-even; a critical finding keeps it at 60 or above."""
    weight = K.AI_SCORE_WEIGHT
    raw = F.lit(weight) * ai_score + F.lit(1 - weight) * static_score
    rounded = F.bround(raw, 0).cast("int")
    return F.when(has_critical, F.greatest(rounded, F.lit(K.SUSPICIOUS_AT + 10))).otherwise(rounded)


def static_confidence(score: Column) -> Column:
    return F.round(0.5 + 0.4 * (F.abs(score - 50) / F.lit(50.0)), 3)


def static_summary(titles: Column, n_indicators: Column, reason: Column) -> Column:
    """One sentence from the top three titles (already in weight order)."""
    prefix = case_map(reason, SUMMARY_PREFIXES, F.lit("The rules found"))
    top = F.slice(titles, 1, 3)
    extra = n_indicators - F.size(top)
    tail = F.when(
        extra > 0,
        F.concat(
            F.lit(" (+"),
            extra.cast("string"),
            F.when(extra == 1, " more finding)").otherwise(" more findings)"),
        ),
    ).otherwise("")
    joined = F.array_join(F.transform(top, F.lower), "; ")
    return F.when(n_indicators == 0, CLEAN_SUMMARY).otherwise(
        F.concat(prefix, F.lit(": "), joined, tail, F.lit("."))
    )


def fused_note(
    has_critical: Column, ai_verdict: Column, verdict: Column, blended: Column
) -> Column:
    """Suffix telling the reader that the two opinions differ."""
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    differs = F.concat(
        F.lit(" Second opinion: '"),
        spaced(ai_verdict),
        F.lit("'. Both together score "),
        blended.cast("string"),
        F.lit(" of 100, which is '"),
        spaced(verdict),
        F.lit("'."),
    )
    return (
        F.when(has_critical & ai_verdict.isin("clean", "low_risk"), RAISED_NOTE)
        .when(verdict != ai_verdict, differs)
        .otherwise("")
    )


def decide(
    outcomes: DataFrame,
    calls: DataFrame,
    settings: GateSettings = GateSettings(),
    has_budget: Column | None = None,
    forced: Column | None = None,
) -> DataFrame:
    """Final decision per document.

    ``outcomes`` as produced by scoring; ``calls(doc_id, succeeded, ai_verdict,
    ai_score, ai_confidence, ai_summary, ai_error)`` has at most one row per
    document. One join on ``doc_id``; calls of documents the gate keeps local
    are ignored, and a failed or missing call falls back to the static outcome.
    """
    gated = outcomes.withColumn(
        "reason", gate_reason(F.col("score"), F.col("n_indicators"), settings, has_budget, forced)
    ).withColumn("escalated", escalates(F.col("reason")))
    joined = gated.join(calls, "doc_id", "left")
    used = F.col("escalated") & F.coalesce("succeeded", F.lit(False)) & F.col("ai_verdict").isNotNull()
    failed = F.col("escalated") & ~used
    critical = F.col("max_severity") == "critical"
    ai_used = reconcile_score(F.col("ai_verdict"), F.col("ai_score"))
    score = F.when(used, blend(ai_used, F.col("score"), critical)).otherwise(F.col("score"))
    titles, count = F.col("top_titles"), F.col("n_indicators")
    own = static_summary(titles, count, F.col("reason"))
    fallback = F.concat(
        static_summary(titles, count, F.lit("ai_unavailable")),
        F.lit(" AI review was unavailable ("),
        F.coalesce("ai_error", F.lit("None")),
        F.lit(")."),
    )
    staged = joined.withColumn("risk_score", score).withColumn("used_ai", used).withColumn(
        "final_verdict",
        F.when(used, verdict_of(F.col("risk_score"))).otherwise(F.col("verdict")),
    )
    given = F.trim(F.coalesce("ai_summary", F.lit("")))
    fused = F.concat(
        F.when(given != "", given).otherwise(own),
        fused_note(critical, F.col("ai_verdict"), F.col("final_verdict"), F.col("risk_score")),
    )
    return staged.select(
        "doc_id",
        F.col("score").alias("static_score"),
        F.col("verdict").alias("static_verdict"),
        "n_indicators",
        "reason",
        "escalated",
        "used_ai",
        "risk_score",
        F.col("final_verdict").alias("verdict"),
        F.when(F.col("used_ai"), "hybrid").otherwise("heuristics").alias("decided_by"),
        F.when(F.col("used_ai"), F.col("ai_confidence"))
        .otherwise(static_confidence(F.col("score")))
        .alias("confidence"),
        F.when(F.col("used_ai"), fused).when(failed, fallback).otherwise(own).alias("summary"),
    )
