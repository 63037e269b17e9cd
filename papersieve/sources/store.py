"""Result tables that change together: readers see a batch whole or not at all.

Each table of a batch is written to a folder of its own attempt,
``<root>/<table>/batch=<id>/attempt=<uuid>``. When all tables are down, one small
commit file names the attempt. Readers start from the commit records and read the
attempts that these name, so a run that ends between two tables leaves nothing to
be seen, and a batch that is written again replaces its earlier attempt in all
tables at one moment: when the new commit file appears.

Tables are of two kinds. *Replaced* tables describe the current state of a scan:
of several batches that saved it, only the latest counts, as a whole
(:meth:`ResultStore.latest`). *Appended* tables keep every committed row
(:meth:`ResultStore.rows`). Results of running aggregates are kept per key: a batch
writes the keys it changed, and the latest row of each key counts
(:meth:`ResultStore.current`).

A long history becomes one batch again by :meth:`ResultStore.compact`: its commit
record says that it stands for all before it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import partial
from types import TracebackType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from papersieve.session import together

COMMITS = (
    "batch bigint, attempt string, committed_at timestamp, name string, schema string, base boolean"
)
# State of a scan, replaced as a whole by its latest run.
REPLACED = ("scans", "reports", "indicators")
# History of a scan, which only grows.
APPENDED = ("assessments", "events")


class Batch:
    """One attempt at a batch. Leaving the ``with`` block without an error commits it."""

    def __init__(self, store: ResultStore, batch_id: int, base: bool = False):
        self.store, self.batch_id, self.attempt = store, batch_id, uuid.uuid4().hex
        self.base = base
        self._schemas: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.store.root}/{name}/batch={self.batch_id}/attempt={self.attempt}"

    def write(self, name: str, rows: DataFrame) -> None:
        """Write one table of the batch; nobody sees it before the batch is committed."""
        if name in self._schemas:
            raise ValueError(f"table {name} is in this batch already")
        rows.write.parquet(self.path(name))
        self._schemas[name] = rows.schema.json()

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """Write tables that do not wait for each other side by side."""
        together(*[partial(self.write, name, rows) for name, rows in tables.items()])

    def read(self, name: str) -> DataFrame:
        """Rows of this attempt, for the writer itself."""
        schema = StructType.fromJson(json.loads(self._schemas[name]))
        return self.store.spark.read.schema(schema).parquet(self.path(name))

    def commit(self) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        record = [
            (self.batch_id, self.attempt, now, n, s, self.base) for n, s in sorted(self._schemas.items())
        ]
        (
            self.store.spark.createDataFrame(record, COMMITS)
            .coalesce(1)
            .write.mode("append")
            .parquet(f"{self.store.root}/commits")
        )

    def __enter__(self) -> Batch:
        return self

    def __exit__(
        self, kind: type[BaseException] | None, problem: BaseException | None, where: TracebackType | None
    ) -> None:
        if kind is None:
            self.commit()




class ResultStore:
    """Tables under one folder, written by batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batch(self, batch_id: int) -> Batch:
        return Batch(self, batch_id)

    def commits(self, before: int | None = None) -> DataFrame:
        """Records that count: the last attempt committed for each batch and table, from
        the latest batch on that stands for all before it."""
        try:
            known = self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException as problem:
            # Nothing has been committed; any other problem must not look like that.
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            known = self.spark.createDataFrame([], COMMITS)
        if before is not None:
            known = known.where(F.col("batch") < before)
        # A compacted table has an attempt of its own: the others of its batch stay as they are.
        latest = F.struct("committed_at", "attempt")
        whole = known.where("NOT base").groupBy("batch").agg(F.max_by("attempt", latest).alias("attempt"))
        bases = known.where("base").groupBy("batch", "name").agg(F.max_by("attempt", latest).alias("attempt"))
        from_batch = bases.groupBy("name").agg(F.max("batch").alias("_from"))
        attempts = known.where("NOT base").join(whole, ["batch", "attempt"], "left_semi").join(
            from_batch, "name", "left"
        ).where("_from IS NULL OR batch > _from").drop("_from")
        based = known.join(bases, ["batch", "name", "attempt"], "left_semi").join(from_batch, "name").where(
            "batch = _from"
        )
        return attempts.unionByName(based.select(*attempts.columns))

    def rows(self, name: str, before: int | None = None) -> DataFrame | None:
        """All committed rows of a table with their ``batch``; None if no batch has it.

        ``before`` leaves out that batch and later ones, for a batch being written.
        There is one commit record per batch, so the join that keeps the attempts
        that count prunes the folders of all others.
        """
        counting = self.commits(before).where(F.col("name") == name)
        newest = counting.agg(F.max_by("schema", F.struct("batch", "committed_at"))).first()[0]
        if newest is None:
            return None
        schema = StructType.fromJson(json.loads(newest)).add("batch", LongType()).add("attempt", StringType())
        stored = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return stored.join(counting.select("batch", "attempt"), ["batch", "attempt"], "left_semi").drop("attempt")

    def latest(
        self, name: str, key: str = "scan_id", before: int | None = None, only: DataFrame | None = None
    ) -> DataFrame | None:
        """Rows of a replaced table from the latest batch of each key.

        The batch in which a scan was saved last comes from the ``scans`` table, so
        a run that found nothing replaces the findings of earlier runs too. ``only``
        keeps the scans that share a value with its single column.
        """
        scans = self.rows("scans", before)
        wanted = scans if name == "scans" else self.rows(name, before)
        if scans is None or wanted is None:
            return wanted
        if only is not None:
            # A scan id belongs to one content, so its runs are kept or left together.
            scans = scans.join(only, only.columns, "left_semi")
            wanted = scans if name == "scans" else wanted
        last = scans.groupBy(key).agg(F.max("batch").alias("batch"))
        return wanted.join(last, [key, "batch"], "left_semi")

    def current(self, name: str, keys: list[str], before: int | None = None) -> DataFrame | None:
        """The row of each key from the latest batch that wrote it."""
        rows = self.rows(name, before)
        if rows is None:
            return None
        rest = [c for c in rows.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
        return newest.select(*keys, "_r.*")

    def compact(self, name: str, keys: list[str]) -> None:
        """Write the current row of every key as one batch that stands for all so far.

        Readers go from the old files to the new one at one moment, when the commit
        record appears; :meth:`vacuum` then deletes the old ones.
        """
        rows = self.current(name, keys)
        if rows is None:
            return
        last = rows.agg(F.max("batch")).first()[0]
        if last is not None:
            with Batch(self, int(last), base=True) as batch:
                batch.write(name, rows.drop("batch"))

    def forgotten(self) -> list[str]:
        """Folders of attempts that were not committed or were replaced.

        Call it only while no batch is being written: an attempt under way looks the same.
        """
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        top = jvm.org.apache.hadoop.fs.Path(self.root)
        files = top.getFileSystem(conf)
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/*/batch=*/attempt=*")) or []
        counting = {r["attempt"] for r in self.commits().select("attempt").distinct().collect()}
        paths = [str(s.getPath().toString()) for s in found]
        return sorted(p for p in paths if p.rsplit("attempt=", 1)[1] not in counting)

    def vacuum(self) -> int:
        """Delete the folders in :meth:`forgotten`; returns how many there were."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        paths = self.forgotten()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        return len(paths)
