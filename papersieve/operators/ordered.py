"""Running totals and positions that never put one group into one task.

A window partitioned by a hot key sends the whole key to one task. Here rows are
range-partitioned on (keys, order), each slice is summed where it lies, the tiny
table of slice totals is scanned to find every slice's starting value, and the
within-slice running total is added on top. A key with a third of all rows is
then spread over a third of the slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve.session import durable

_SLICE = "_slice"
_START = "_start"


def running_before(
    df: DataFrame,
    value: Column,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "running_before",
    slices: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows strictly before each row, per key.

    ``order_by`` must be unique within a key. The sliced rows are checkpointed
    because slice numbers come from sampled range bounds: both readers below
    have to see the same ones, also after a lost executor.
    """
    spark = df.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in (*keys, *order_by)]
    sliced = durable(
        df.withColumn("_value", value)
        .repartitionByRange(count, *by)
        .withColumn(_SLICE, F.spark_partition_id())
    )
    totals = sliced.groupBy(*keys, _SLICE).agg(F.sum("_value").alias("_total"))
    # At most one row per (slice, key): every slice boundary adds one, every key
    # adds one, so this is far smaller than the rows whatever the skew.
    scan = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    starts = totals.select(
        *keys,
        _SLICE,
        F.coalesce(
            F.sum("_total").over(
                scan.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias(_START),
    )
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order_by)
    return (
        sliced.join(starts, [*keys, _SLICE])
        .withColumn(
            name,
            F.col(_START)
            + F.coalesce(
                F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("_value", _START, _SLICE)
    )


def following(
    df: DataFrame,
    value: Column,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "following",
    slices: int | None = None,
) -> DataFrame:
    """``value`` of the row after each row of its key; null on a key's last row.

    Inside a slice that is a window. The last row of a key in a slice takes the
    first value the key has in any later slice, which comes from one row per
    slice and key. Sliced and checkpointed as in :func:`running_before`.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = durable(
        df.withColumn("_value", value)
        .repartitionByRange(count, *[F.col(c) for c in (*keys, *order_by)])
        .withColumn(_SLICE, F.spark_partition_id())
    )
    firsts = sliced.groupBy(*keys, _SLICE).agg(
        F.min_by(F.struct("_value"), F.struct(*order_by)).alias("_first")
    )
    scan = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    carried = firsts.select(
        *keys, _SLICE, F.lead("_first").over(scan.orderBy(_SLICE)).alias("_carried")
    )
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order_by)
    after = F.lead(F.struct("_value")).over(inside)
    return (
        sliced.join(carried, [*keys, _SLICE])
        .withColumn(name, F.coalesce(after, F.col("_carried"))["_value"])
        .drop("_value", "_carried", _SLICE)
    )


def first_failing_run(df: DataFrame, failed: Column, length: int, index: str) -> DataFrame:
    """One row with the index at which ``length`` consecutive failures first end.

    ``index`` must be consecutive integers. Each failed row votes for the
    ``length`` window ends it can belong to; an end with ``length`` votes closes
    a full run. The vote count combines map-side, so no ordered scan is needed.
    """
    votes = df.where(failed).select(
        F.explode(F.sequence(F.col(index), F.col(index) + (length - 1))).alias("_end")
    )
    return (
        votes.groupBy("_end")
        .agg(F.count("*").alias("_votes"))
        .where(F.col("_votes") == length)
        .agg(F.min("_end").alias("abort_at"))
    )
