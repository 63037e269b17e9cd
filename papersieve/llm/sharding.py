"""Consistent shard placement through a permutation-filled lookup table.

Every shard walks the table's slots in an order of its own (offset and stride
from its name, a permutation because the table size is prime) and the shards
take turns claiming the next free slot. Placement is then one hash, one
remainder and one lookup. When a shard leaves, nearly all keys of the others
stay where they are.

Edge cases: a null key is placed like the empty key; repeated rows go to the
same shard; an empty table gives an empty result; input columns named like an
output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import unused

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
TABLE_SIZE = 65_537
# The lookup table is broadcast; this bounds it to some 10 MB.
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    if n < 2:
        return False
    return all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(name: str, purpose: str, modulus: int) -> int:
    digest = hashlib.sha256(f"{purpose}\x00{name}".encode()).digest()
    return int.from_bytes(digest[:8], "big") % modulus


def lookup_table(
    shards: Sequence[str], size: int = TABLE_SIZE, weights: Mapping[str, int] | None = None
) -> list[int]:
    """Shard number of every slot. A shard of weight w claims w slots per round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"table size must be a prime from {len(shards)} to {MOST_SLOTS}")
    turns = [i for i, s in enumerate(shards) for _ in range((weights or {}).get(s, 1))]
    if not turns:
        raise ValueError("all weights are zero")
    at = [_draw(s, "offset", size) for s in shards]
    stride = [1 + _draw(s, "skip", size - 1) for s in shards]
    owner = [-1] * size
    free = size
    while free:
        for shard in turns:
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + stride[shard]) % size
            owner[slot] = shard
            at[shard] = (slot + stride[shard]) % size
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of its MD5 digest modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(head, F.lit(size)).cast("int")


def place(
    df: DataFrame,
    key: str = "doc_id",
    shards: Sequence[str] = SHARDS,
    size: int = TABLE_SIZE,
    weights: Mapping[str, int] | None = None,
    spread_by: str | None = None,
    spread: int = 1,
) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; rows never move, the table is broadcast.

    The broadcast holds ``size`` rows whatever the data, at most
    ``MOST_SLOTS``. ``spread_by`` and ``spread`` cut every key into that many
    parts by a hash of another column, for keys (a source, a host) of which one
    may hold a large share of all rows.
    """
    owner = lookup_table(shards, size, weights)
    slot, name = unused(df, "_slot", "_shard")
    rows = [(i, shards[o]) for i, o in enumerate(owner)]
    lookup = df.sparkSession.createDataFrame(rows, f"`{slot}` int, `{name}` string")
    placed_by = F.col(f"`{key}`").cast("string")
    if spread_by and spread > 1:
        part = F.pmod(F.xxhash64(F.col(f"`{spread_by}`").cast("string")), F.lit(spread))
        placed_by = F.concat_ws("\x00", F.coalesce(placed_by, F.lit("")), part.cast("string"))
    found = df.withColumn(slot, slot_of(placed_by, size)).join(F.broadcast(lookup), slot)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return found.select(*kept, F.col(slot).alias("slot"), F.col(name).alias("shard"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard. Rows are written where they lie: no shuffle, no hot task."""
    placed.write.partitionBy("shard").parquet(path)
