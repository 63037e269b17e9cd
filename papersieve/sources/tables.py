"""Result tables in and out: Parquet, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = (
    "path", "dataset", "label", "score", "verdict", "indicators", "obfuscated_names", "error",
)
RESULT_CSV_SCHEMA = (
    "path string, dataset string, label string, score string, verdict string, "
    "indicators string, obfuscated_names string, error string"
)
CHANGE_COLUMNS = (
    "file", "label", "static_score", "static_verdict", "ai_score", "ai_verdict", "indicators",
    "model_said", "tokens", "error",
)
CHANGE_CSV_SCHEMA = (
    "file string, label string, static_score int, static_verdict string, ai_score int, "
    "ai_verdict string, indicators int, model_said string, tokens bigint, error string"
)


def joined_codes(codes: Column) -> Column:
    return F.array_join(codes, ";")


def split_codes(text: Column) -> Column:
    """Non-empty parts of a ``;``-joined list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda c: c != "")


def write_results(results: DataFrame, path: str, form: str = "parquet") -> None:
    """Store corpus results; CSV joins the codes, Parquet keeps the array."""
    rows = results.select(*RESULT_COLUMNS)
    if form == "csv":
        rows = rows.withColumn("indicators", joined_codes(F.col("indicators")))
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str, skip_errors: bool = False) -> DataFrame:
    """Load CSV results with a score (and, for sampling, without an error)."""
    raw = (
        spark.read.schema(RESULT_CSV_SCHEMA).option("header", True).option("escape", '"').csv(path)
    )
    return loadable(raw, skip_errors)


def loadable(raw: DataFrame, skip_errors: bool = False) -> DataFrame:
    """Typed results from text columns, rows without a score dropped."""
    rows = raw.where(F.length(F.coalesce("score", F.lit(""))) > 0)
    if skip_errors:
        rows = rows.where(F.length(F.coalesce("error", F.lit(""))) == 0)
    codes = split_codes(F.col("indicators"))
    return rows.withColumns(
        {
            "score": F.col("score").cast("int"),
            "n_indicators": F.size(codes),
            "indicators": codes,
            "obfuscated_names": F.col("obfuscated_names").cast("int"),
            "error": F.coalesce("error", F.lit("")),
        }
    )


def write_changes(changes: DataFrame, path: str) -> None:
    changes.select(*CHANGE_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Paired rows without an error."""
    rows = spark.read.schema(CHANGE_CSV_SCHEMA).option("header", True).csv(path)
    filled = rows.fillna("", ["error", "model_said"])
    return filled.where(F.col("error") == "")


def verdict_records(decisions: DataFrame, features: DataFrame, indicators: DataFrame) -> DataFrame:
    """Export records ``file, sha256, size, verdict, ..., indicators[]``.

    Expects ``file`` on ``features``. A document's codes are bounded by the
    rule set.
    """
    codes = indicators.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("weight")).alias("w"), "code", "severity"))
        ).alias("i")
    ).select(
        "doc_id",
        F.transform(
            "i",
            lambda s: F.struct(
                s["code"].alias("code"), s["severity"].alias("severity"), (-s["w"]).alias("weight")
            ),
        ).alias("indicators"),
    )
    return (
        decisions.join(features.select("doc_id", "file", "sha256", "file_size"), "doc_id")
        .join(codes, "doc_id", "left")
        .select(
            "file", "sha256", F.col("file_size").alias("size"), "verdict", "risk_score",
            "decided_by", "used_ai", "summary",
            "indicators",
        )
    )

