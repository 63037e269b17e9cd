"""Daily token budget over a table of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.operators.ordered import running_before


def daily_usage(calls: DataFrame, at: str = "created_at") -> DataFrame:
    """Tokens per UTC day; calls without positive tokens are ignored."""
    return (
        calls.where(F.col("tokens") > 0)
        .groupBy(F.to_date(at).alias("day"))
        .agg(F.sum("tokens").alias("tokens"))
    )


def used_on(usage: DataFrame, day: Column) -> DataFrame:
    """One row with the tokens of a day, 0 when none were recorded."""
    return usage.where(F.col("day") == day).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("used")
    )


def has_budget(used: Column, limit: int) -> Column:
    """Unlimited when the limit is not positive; unknown usage allows."""
    return F.lit(limit <= 0) | F.coalesce(used < limit, F.lit(True))


def remaining(used: Column, limit: int) -> Column:
    if limit <= 0:
        return F.lit(None).cast("long")
    return F.greatest(F.lit(0), F.lit(limit) - F.coalesce(used, F.lit(0)))


def admit_calls(calls: DataFrame, limit: int, at: str = "created_at") -> DataFrame:
    """Mark each call admitted while the day's total before it is below ``limit``.

    Expects a unique ``call_id``. The running total is computed in slices, so a
    day holding most calls does not become one task.
    """
    dated = calls.withColumn("day", F.to_date(at)).withColumn(
        "_spent", F.greatest(F.lit(0), F.col("tokens"))
    )
    total = running_before(dated, F.col("_spent"), [at, "call_id"], ["day"], "tokens_before")
    return total.withColumn(
        "admitted", F.lit(limit <= 0) | (F.col("tokens_before") < limit)
    ).drop("_spent")


def retained(usage: DataFrame, today: Column, keep_days: int = K.USAGE_RETENTION_DAYS) -> DataFrame:
    return usage.where(F.col("day") >= F.date_sub(today, keep_days))
