"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.session import checkpoint_dir

# White space of the word definition: blank and the controls 0x09 to 0x0D.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
NON_BLANK = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Runs an action.

    Cuts the lineage in a way that survives lost executors; the table keeps
    column pruning, so each reader fetches only what it needs.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and total bytes of a text column, read without shuffling any text."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b"),
    ).first()
    return int(row["n"]), int(row["b"])


def parts_for(total: int, each: int, least: int = 1) -> int:
    """Number of parts so that each holds about ``each`` units."""
    return max(least, math.ceil(total / each))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank give none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(
        F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, BLANK_RUN)
    ).otherwise(F.array().cast("array<string>"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with none of ``df``'s (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def worker_memo(name: str) -> dict:
    """A dictionary that outlives one task in a reused Python worker.

    Holds pure function results only (same key, same value), so a worker that
    starts without it returns the same rows.
    """
    module = sys.modules.setdefault("_papersieve_memo", types.ModuleType("_papersieve_memo"))
    return module.__dict__.setdefault(f"memo_{name}", {})
