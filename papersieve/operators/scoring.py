"""From indicators to a 0-100 score and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.links import URL_PATTERN
from papersieve.functions.links import is_dangerous, is_risky
from papersieve.functions.text import case_map, rank_of


def first_per_code(indicators: DataFrame) -> DataFrame:
    """One indicator per document and code: the first emitted.

    A combining aggregate rather than a ranking window, so repeats of one code
    shrink before the shuffle. Order: ``rule_ord`` then ``ord``.
    """
    rest = [c for c in indicators.columns if c not in ("doc_id", "code")]
    return (
        indicators.groupBy("doc_id", "code")
        .agg(F.min_by(F.struct(*rest), F.struct("rule_ord", "ord")).alias("i"))
        .select("doc_id", "code", "i.*")
    )


def noisy_or(weights: Column) -> Column:
    """``100 * (1 - prod(1 - min(w, 99)/100))`` over an ordered array, unrounded."""
    surviving = F.aggregate(
        weights, F.lit(1.0), lambda acc, w: acc * (F.lit(1.0) - F.least(w, F.lit(99)) / F.lit(100.0))
    )
    return (F.lit(1.0) - surviving) * F.lit(100.0)


def apply_floors(score: Column, worst_rank: Column) -> Column:
    """Critical findings lift the score to 75, else high ones to 45."""
    critical = K.SEVERITY_ORDER.index("critical")
    high = K.SEVERITY_ORDER.index("high")
    return (
        F.when(worst_rank == critical, F.greatest(score, F.lit(float(K.CRITICAL_FLOOR))))
        .when(worst_rank == high, F.greatest(score, F.lit(float(K.HIGH_FLOOR))))
        .otherwise(score)
    )


def sole_ceiling(score: Column, count: Column) -> Column:
    """A single indicator, whatever its weight, cannot reach quarantine."""
    return F.when(count == 1, F.least(score, F.lit(float(K.SOLE_INDICATOR_CEILING)))).otherwise(score)


def to_score(value: Column) -> Column:
    """Half-even rounding into 0..100."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 0).cast("int")


def verdict_of(score: Column) -> Column:
    return (
        F.when(score >= K.MALICIOUS_AT, "malicious")
        .when(score >= K.SUSPICIOUS_AT, "suspicious")
        .when(score >= K.LOW_RISK_AT, "low_risk")
        .otherwise("clean")
    )


def combined_score(weights: Column, worst_rank: Column, count: Column) -> Column:
    raw = sole_ceiling(apply_floors(noisy_or(weights), worst_rank), count)
    return F.when(count == 0, 0).otherwise(to_score(raw))


def rationale_line() -> Column:
    return F.format_string(
        "[%s|w=%d] %s: %s", F.upper("severity"), F.col("weight"), F.col("code"), F.col("title")
    )


def outcomes(indicators: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Score, verdict and rationale per document.

    One shuffle: codes are unique after :func:`first_per_code`, so the collected
    group is bounded by the number of rules. With ``documents`` the ones without
    any indicator appear as clean.
    """
    unique = first_per_code(indicators).withColumn(
        "severity_rank", rank_of(F.col("severity"), K.SEVERITY_ORDER)
    )
    ordered = F.array_sort(F.collect_list(F.struct("rule_ord", "ord", "weight")))
    by_weight = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("weight")).alias("w"), "rule_ord", "ord", rationale_line().alias("line"),
                "title",
            )
        )
    )
    grouped = unique.groupBy("doc_id").agg(
        ordered.alias("_w"),
        F.max("severity_rank").alias("severity_rank"),
        F.count("*").cast("int").alias("n_indicators"),
        by_weight.alias("_r"),
    )
    if documents is not None:
        grouped = documents.select("doc_id").join(grouped, "doc_id", "left")
    count = F.coalesce("n_indicators", F.lit(0))
    weights = F.transform("_w", lambda s: s["weight"])
    score = combined_score(weights, F.coalesce("severity_rank", F.lit(0)), count)
    scored = grouped.select(
        "doc_id",
        F.coalesce(score, F.lit(0)).alias("score"),
        count.alias("n_indicators"),
        case_map(
            F.coalesce("severity_rank", F.lit(0)), list(enumerate(K.SEVERITY_ORDER))
        ).alias("max_severity"),
        F.coalesce(F.transform("_r", lambda s: s["line"]), F.array().cast("array<string>")).alias(
            "rationale"
        ),
        F.coalesce(
            F.transform(F.slice("_r", 1, 3), lambda s: s["title"]),
            F.array().cast("array<string>"),
        ).alias("top_titles"),
    )
    return scored.withColumn("verdict", verdict_of(F.col("score"))).withColumn(
        "is_conclusive_clean", (F.col("verdict") == "clean") & (F.col("n_indicators") == 0)
    )


def top_indicators(indicators: DataFrame, limit: int = 10) -> DataFrame:
    """The heaviest ``limit`` indicators per document; ties keep rule order."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "rule_ord", "ord")
    return (
        first_per_code(indicators)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
    )


def max_severity(severity: Column) -> Column:
    """Aggregate: highest severity of a group, info when there is none."""
    rank = F.max(rank_of(severity, K.SEVERITY_ORDER))
    return case_map(F.coalesce(rank, F.lit(0)), list(enumerate(K.SEVERITY_ORDER)))


def worst_verdict(verdict: Column) -> Column:
    """Aggregate: most severe verdict of a group, whatever the row order."""
    return case_map(F.max(rank_of(verdict, K.VERDICT_ORDER)), list(enumerate(K.VERDICT_ORDER)))


def exit_class(verdict: Column) -> Column:
    return F.when(verdict == "malicious", 2).when(verdict.isin("suspicious", "unknown"), 1).otherwise(0)


def is_blocking(verdict: Column) -> Column:
    return verdict.isin("suspicious", "malicious")


def active_documents(scripts: DataFrame, actions: DataFrame) -> DataFrame:
    """Documents with any script or any automatic action."""
    return (
        scripts.select("doc_id")
        .unionByName(actions.where("auto_executes").select("doc_id"))
        .distinct()
    )


def ocr_candidates(
    texts: DataFrame,
    scripts: DataFrame,
    actions: DataFrame,
    attachments: DataFrame,
    urls: DataFrame,
    hits: DataFrame,
    enabled: bool = True,
    min_text_chars: int = K.MINIMAL_TEXT_CHARS,
    only_when_relevant: bool = True,
) -> DataFrame:
    """Documents whose text is too short and whose findings make text worth having.

    Expects ``texts(doc_id, text_excerpt)``. The findings are reduced to one
    distinct id list and applied as a single semi join.
    """
    short = texts.where(F.lit(enabled) & (F.length(F.trim("text_excerpt")) < min_text_chars))
    if not only_when_relevant:
        return short.select("doc_id")
    relevant = scripts.select("doc_id")
    for part in (
        actions.where("auto_executes"),
        attachments,
        hits,
        urls.where(is_dangerous(F.col("scheme")) | is_risky()),
    ):
        relevant = relevant.unionByName(part.select("doc_id"))
    return short.join(relevant.distinct(), "doc_id", "left_semi").select("doc_id")


def register_sql_functions(spark: SparkSession) -> None:
    """SQL forms of the score, the worst verdict, and the text explodes."""
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION noisy_or(ws ARRAY<INT>) RETURNS INT
        RETURN CAST(bround(100D * (1D - aggregate(
            ws, 1D, (a, w) -> a * (1D - least(w, 99) / 100D))), 0) AS INT)
        """
    )
    ranks = ", ".join(f"'{v}'" for v in K.VERDICT_ORDER)
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION worst_of(vs ARRAY<STRING>) RETURNS STRING
        RETURN element_at(array({ranks}),
            CAST(array_max(transform(vs, v -> array_position(array({ranks}), v))) AS INT))
        """
    )
    pattern = URL_PATTERN.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION swept_urls(body STRING)
        RETURNS TABLE(ord INT, url STRING)
        RETURN SELECT p.pos, p.col
        FROM posexplode(array_distinct(regexp_extract_all(body, '{pattern}', 0))) AS p
        """
    )
    spark.sql(
        r"""
        CREATE OR REPLACE TEMPORARY FUNCTION object_bodies(body STRING)
        RETURNS TABLE(ord INT, obj INT, content STRING)
        RETURN SELECT p.pos, CAST(regexp_extract(p.col, '^(\\d+)', 1) AS INT), p.col
        FROM posexplode(regexp_extract_all(body,
          '(?s)\\d+\\s+\\d+\\s+obj\\b.*?endobj', 0)) AS p
        """
    )
