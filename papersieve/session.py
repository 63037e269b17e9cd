"""Session factory and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "papersieve", **conf: str) -> SparkSession:
    """Session with the settings the operators assume.

    Partition counts are left to adaptive execution, which coalesces the
    initial shuffle partitions by size; pass ``conf`` to raise the initial
    number on a large cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Plans here are built from many small expressions; recording a call site
        # for each costs more than running a short job.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the session's.

    A single machine without the setting gets a scratch folder; a cluster must
    name one that all executors share.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(scratch)
    return scratch


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage.

    Runs an action. Used where several branches read one expensive result, or
    where a result depends on physical placement and must not be recomputed
    differently after an executor is lost.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, *sort_by: str, broadcasts: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table under the checkpoint folder and read it back.

    Runs an action. Unlike a checkpoint the result keeps column pruning and
    filter pushdown, so it suits wide intermediates many branches read a
    little of. ``sort_by`` orders rows inside partitions so that pushed filters
    skip row groups.

    Joins of the result are merge joins. Spark weighs a table by its files and a
    shuffle by its blocks, both compressed; findings repeat themselves so much that
    some 4 MB unpack to 600 MB, which a broadcast would collect in the driver.
    ``broadcasts`` leaves the choice to Spark, for rows that hardly compress.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    return rows if broadcasts else unbroadcast(rows)


def unbroadcast(df: DataFrame) -> DataFrame:
    """Keep ``df`` out of broadcasts, whatever size its files or blocks have.

    The hint reaches the next join through projections, filters and aggregates, but
    neither through a join nor a union; what those return needs it anew.
    """
    return df.hint("merge")


# Unpacked bytes that one task should have to sort.
TASK_BYTES = 64 << 20


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deal ``df`` out by ``key`` in partitions of some ``TASK_BYTES`` of unpacked text.

    Runs an action. Adaptive execution joins partitions by their compressed size, so
    that of rows which repeat themselves one task gets gigabytes; a number of
    partitions that is asked for stays. Rows that fit one task are returned as they are.
    """
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.lit(32).cast("long")
    for c in texts:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    parts = -(-(df.agg(F.sum(size)).first()[0] or 0) // TASK_BYTES)
    # Whatever the rows are joined with is dealt out to as many, so not to fewer than usual.
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if parts <= 1 else df.repartition(max(parts, usual), key)


class once:
    """Attribute that is made when it is first asked for, and kept.

    Of threads that ask side by side one makes it and the others wait.
    """

    _guard = threading.Lock()

    def __init__(self, make: Callable):
        self.make, self.__doc__ = make, make.__doc__

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, held, owner: type | None = None):
        if held is None:
            return self
        kept = vars(held)
        with self._guard:
            lock = kept.setdefault(f"_{self.name}_lock", threading.RLock())
        with lock:
            if self.name not in kept:
                kept[self.name] = self.make(held)
            return kept[self.name]


def together(*makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of independent makers that each run jobs, run side by side.

    A small job leaves most of a cluster idle while it is planned and committed;
    jobs that do not wait for each other fill that time.
    """
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(inherit(m)) for m in makers]]


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work one partition per core when the scan has fewer.

    A large table already splits into more partitions than there are cores and
    is returned unchanged; only a few small files cause a repartition.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
