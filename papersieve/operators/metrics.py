"""Counters and histograms over findings and calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.operators.evaluate import per_value


def counter(rows: DataFrame, *labels: str, value: Column | None = None) -> DataFrame:
    """Labelled counter: row count, or the sum of ``value``."""
    measure = F.count("*") if value is None else F.sum(value)
    return rows.groupBy(*labels).agg(measure.alias("total"))


def histogram(rows: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts ``value <= le`` in one aggregation."""
    measured = rows.select(value.cast("double").alias("v"))
    return per_value(
        measured, [float(e) for e in edges], "le", lambda le: {"n": F.count_if(F.col("v") <= le)}
    )


def summary(rows: DataFrame, value: Column) -> DataFrame:
    """Observation count and sum, the totals a snapshot shows."""
    return rows.agg(F.count(value).alias("count"), F.sum(value).alias("sum"))


def snapshot(name: str, counted: DataFrame, *labels: str) -> DataFrame:
    """``name{a=x,b=y}`` -> value, labels in alphabetical order."""
    pairs = [F.concat(F.lit(f"{label}="), F.col(label).cast("string")) for label in sorted(labels)]
    key = (
        F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("}"))
        if labels
        else F.lit(name)
    )
    return counted.select(key.alias("metric"), F.col("total").cast("double").alias("value"))
