"""Best-fit packing of documents into sequences of several permitted lengths.

Best-fit decreasing only looks at lengths, and there are at most
``max(capacities)`` of those. The plan is therefore made from the histogram of
lengths, in groups of bins with the same contents: its size depends on the
largest capacity and never on the number of documents. The documents are then
given to the planned places by their rank among equal lengths, in Spark.

The capacities are planned jointly: an item goes to the open bin, of whatever
capacity, that it leaves fullest; only when none has room is a bin opened, of
the capacity with the least cost per unit among those that hold the item (ties:
the larger). At the end every bin is cut down to the cheapest capacity that
holds its contents.

A document longer than the largest capacity is cut into pieces of that capacity
and a rest. Edge cases: a null or negative length counts as 0; an item of
length 0 takes no place (null bin, one row); repeated rows are packed one by
one; an empty table gives an empty plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve.llm.common import NON_BLANK, unused, written

CAPACITIES = (512, 1024, 2048, 4096)
MOST_CAPACITY = 1 << 17
# Attention is paid for by the square of a sequence, everything else by its length.
ATTENTION_SCALE = 16_384
PER_SEQUENCE = 64
RANK_SALTS = 256
COLUMNS = [
    "doc_id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_used", "bin_offset"
]


def sequence_cost(capacity: int) -> float:
    """Default cost of a sequence: fixed part, linear part, attention part."""
    return PER_SEQUENCE + capacity + capacity * capacity / ATTENTION_SCALE


@dataclass
class Bins:
    """``count`` bins with the same contents: ``runs`` of (length, items per bin)."""

    count: int
    capacity: int
    room: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def plan_bins(
    histogram: dict[int, int],
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
) -> list[Bins]:
    """Bins of best-fit decreasing over ``{length: items}``, grouped by contents.

    Same bins, up to order, as placing the items one by one. With n items of one
    length and m bins of the best room, each bin takes as many as fit before the
    next bin is looked at, since it stays the best fit; so whole groups move at
    once and at most one group is split per length.
    """
    sizes = sorted({int(c) for c in capacities})
    if not sizes or sizes[0] < 1 or sizes[-1] > MOST_CAPACITY:
        raise ValueError(f"capacities must be from 1 to {MOST_CAPACITY}")
    groups: list[Bins] = []
    rooms: list[tuple[int, int]] = []  # (room, group), ascending
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = int(histogram[length])
        at = bisect_left(rooms, (length, -1))
        moved: list[int] = []
        taken: list[tuple[int, int]] = []
        while left and at < len(rooms):
            room, g = rooms[at]
            group, each = groups[g], room // length
            whole = min(group.count, left // each)
            rest = left - whole * each if whole < group.count else 0
            if whole < group.count:
                # Split: bins that are filled, one that takes the rest, bins left as they are.
                keep = group.count - whole - (1 if rest else 0)
                if keep:
                    groups.append(Bins(keep, group.capacity, room, list(group.runs)))
                    moved.append(len(groups) - 1)
                if rest:
                    groups.append(
                        Bins(1, group.capacity, room - rest * length, [*group.runs, (length, rest)])
                    )
                    moved.append(len(groups) - 1)
                left = 0
            else:
                left -= whole * each
            taken.append(rooms[at])
            if whole:
                group.count = whole
                group.room = room - each * length
                group.runs.append((length, each))
                moved.append(g)
            else:
                group.count = 0
            at += 1
        if taken:
            first = bisect_left(rooms, taken[0])
            del rooms[first : first + len(taken)]
        for g in moved:
            insort(rooms, (groups[g].room, g))
        if left:
            fitting = [c for c in sizes if c >= length]
            if not fitting:
                raise ValueError(f"length {length} exceeds the largest capacity")
            opened = min(fitting, key=lambda c: (cost(c) / c, -c))
            each = opened // length
            for count, items in ((left // each, each), (1 if left % each else 0, left % each)):
                if count:
                    groups.append(Bins(count, opened, opened - items * length, [(length, items)]))
                    insort(rooms, (groups[-1].room, len(groups) - 1))
    out = [g for g in groups if g.count]
    for g in out:
        used = g.capacity - g.room
        g.capacity = min((c for c in sizes if c >= used), key=lambda c: (cost(c), c))
        g.room = g.capacity - used
    return out


def slot_runs(bins: Sequence[Bins]) -> pd.DataFrame:
    """For each length, which ranks go to which bins: one row per (group, length)."""
    rows, first_bin, next_rank = [], 0, {}
    for b in bins:
        offset = 0
        for length, each in b.runs:
            rank = next_rank.get(length, 0)
            next_rank[length] = rank + b.count * each
            rows.append((length, rank, first_bin, each, offset, b.capacity, b.capacity - b.room))
            offset += length * each
        first_bin += b.count
    frame = pd.DataFrame(
        rows, columns=["length", "rank", "bin", "each", "offset", "capacity", "used"]
    )
    return frame.astype("int64").sort_values(["length", "rank"], ignore_index=True)


def pieces(df: DataFrame, length: Column, largest: int, carry: Sequence[str]) -> DataFrame:
    """One row per piece of at most ``largest``: ``piece, start, length`` beside ``carry``."""
    whole = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(F.col("_whole") / largest).cast("long") - 1, F.lit(0).cast("long"))
    return (
        df.select(*[F.col(f"`{c}`") for c in carry], whole.alias("_whole"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .withColumn("start", F.col("piece") * largest)
        .withColumn("length", F.least(F.col("_whole") - F.col("start"), F.lit(largest)))
        .drop("_whole")
    )


def words_long(text: Column) -> Column:
    """Number of words: the default measure of a document's length."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_BLANK}+")), F.lit(0)).cast("long")


def pack(
    df: DataFrame,
    length: Column,
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
    key: str = "doc_id",
) -> DataFrame:
    """Place of every piece of every row of ``df``.

    Returns ``doc_id, piece, start, length, bin_id, bin_capacity, bin_used,
    bin_offset``: units ``start`` to ``start + length`` of the document lie at
    ``bin_offset`` of sequence ``bin_id``. Runs two actions: the pieces are
    written once, and their histogram (at most ``max(capacities)`` lengths) is
    planned on the driver.

    Ranks among equal lengths come from counts per (length, salt), so a length
    that a third of all documents share is ranked by many tasks.
    """
    spark = df.sparkSession
    largest = max(capacities)
    (carried,) = unused(df, "_key")
    keyed = df.withColumn(carried, F.col(f"`{key}`").cast("long"))
    items = written(
        pieces(keyed, length, largest, [carried])
        .withColumnRenamed(carried, "doc_id")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_SALTS)).cast("int")),
        "pieces",
    )
    counts = items.filter("length > 0").groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = written(counts, "piece-counts")
    histogram = {
        r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    runs = slot_runs(plan_bins(histogram, capacities, cost))
    plan = spark.sparkContext.broadcast({c: runs[c].to_numpy() for c in runs.columns})
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most RANK_SALTS rows per length and max(capacities) lengths: bounded, broadcast at will.
    starts = counts.select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        items.filter("length > 0")
        .withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .select("doc_id", "piece", "start", "length", "rank")
    )

    def assign(batches):
        p = plan.value
        # Ranks are below 2**45 and lengths below 2**18: one sorted search finds the run.
        keys = (p["length"] << 45) | p["rank"]
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(keys, (lengths << 45) | ranks, side="right") - 1
            inside_run = ranks - p["rank"][run]
            each = p["each"][run]
            planned = (
                p["bin"][run] + inside_run // each,
                p["capacity"][run],
                p["used"][run],
                p["offset"][run] + inside_run % each * lengths,
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length")),
                 *map(pa.array, planned)],
                names=COLUMNS,
            )

    placed = ranked.mapInArrow(assign, ", ".join(f"{c} long" for c in COLUMNS))
    empty = items.filter("length = 0").select(
        "doc_id", "piece", "start", "length",
        *[F.lit(None).cast("long").alias(c) for c in COLUMNS[4:]],
    )
    return placed.unionByName(empty)


def pack_documents(df: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """Pack ``documents`` by their number of words."""
    return pack(df, words_long(F.col("text")), capacities)
