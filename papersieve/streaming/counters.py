"""Counters over event streams that are kept batch by batch, with late rows counted.

Spark's own windows drop rows behind the watermark without a trace. Here each
micro-batch is measured against the newest event of the batches before it: what
belongs to windows that had ended by then, the allowed delay included, is left out
and counted. The rest goes to a store as changes per window; windows without a new
row are not written. Marks, late counts and changes of a batch are committed
together, so a replay counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.sources.store import ResultStore


@dataclass
class WindowCounters:
    """``foreachBatch`` body for windows over ``ts``.

    ``sums`` names the columns added up per window; they are numbers that are there
    for every row. ``length`` and ``slide`` are intervals as Spark writes them.
    """

    root: str
    sums: tuple[str, ...]
    length: str = "24 hours"
    slide: str = "1 hour"
    delay: str = "1 hour"

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        store = ResultStore(rows.sparkSession, self.root)
        mark = self.mark(store, batch_id)
        windows = rows.select("ts", *self.sums, F.window("ts", self.length, self.slide).alias("w"))
        is_open = F.col("w.end") > mark if mark is not None else F.lit(True)
        # A row is late if the last of its windows has ended: it then counts nowhere.
        ends = self.last_end(F.col("ts"))
        late = F.count_if(ends <= mark) if mark is not None else F.lit(0)
        with store.batch(batch_id) as batch:
            batch.write(
                "marks",
                rows.agg(
                    F.max("ts").alias("newest"), F.count("*").alias("n_rows"), late.cast("bigint").alias("late")
                ),
            )
            batch.write(
                "changes",
                windows.where(is_open)
                .groupBy(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))
                .agg(*[F.sum(c).cast("bigint").alias(c) for c in self.sums]),
            )

    def last_end(self, ts: Column) -> Column:
        """End of the last window that holds ``ts``."""
        slides = F.window(ts, self.slide)["start"]
        return slides + F.expr(f"INTERVAL {self.length}")

    def mark(self, store: ResultStore, batch_id: int) -> Column | None:
        """Newest event of the batches before this one, less the allowed delay."""
        known = store.rows("marks", batch_id)
        newest = None if known is None else known.agg(F.max("newest")).first()[0]
        return None if newest is None else F.lit(newest) - F.expr(f"INTERVAL {self.delay}")

    def totals(self, spark: SparkSession) -> DataFrame:
        """All windows with their sums over every committed batch."""
        return (
            ResultStore(spark, self.root).rows("changes")
            .groupBy("window_start", "window_end")
            .agg(*[F.sum(c).alias(c) for c in self.sums])
        )

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """``batch, n_rows, late`` of every committed batch that had rows."""
        return ResultStore(spark, self.root).rows("marks").where("n_rows > 0").select("batch", "n_rows", "late")


def keep_updates(root: str, name: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for an aggregate in update mode: the changed keys of each
    batch go to a store, where :meth:`ResultStore.current` finds the latest of each."""

    def keep(rows: DataFrame, batch_id: int) -> None:
        with ResultStore(rows.sparkSession, root).batch(batch_id) as batch:
            batch.write(name, rows)

    return keep
