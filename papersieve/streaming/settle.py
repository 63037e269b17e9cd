"""Folder watching as a stream of listing rows ``path, size, observed_at``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from papersieve import constants as K

FORGET = -1  # A listing row with this size re-arms its path.
# A path that no listing has named for this long is forgotten, so state follows what is in
# the folder and not what ever was. A file that comes back later counts as new.
REMEMBER_SECONDS = 7 * 24 * 3600
# Keys that share a state: a call between the Python worker and the state store costs far more
# than the rows it carries, so calls are made per bucket, not per key. A batch reads and writes
# the states of the buckets it touches; raise the number where a bucket holds many thousand
# keys. It cannot change during a checkpoint's life.
BUCKETS = 1024
FILE_STATE = "files"
_STATE = "held array<struct<path:string,size:bigint,stable:int,first_seen:double,done:boolean,last_seen:double,due:bigint>>, next bigint"
_OUTPUT = "path string, size bigint, observed_at timestamp"


def is_candidate(path: Column, recursive: bool = False, root: str = "") -> Column:
    """PDF names that are neither partial downloads nor hidden."""
    lowered = F.lower(path)
    partial = F.exists(
        F.array(*[F.lit(s) for s in K.PARTIAL_SUFFIXES]), lambda s: F.endswith(lowered, s)
    )
    parts = F.split(path, "/")
    last_two = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2))
    hidden = F.exists(last_two, lambda p: F.startswith(p, F.lit(".")))
    flat = F.lit(True)
    if not recursive:
        below = F.substring_index(path, root.rstrip("/") + "/", -1) if root else path
        flat = ~F.contains(below, F.lit("/"))
    return F.endswith(path, F.lit(".pdf")) & ~partial & ~hidden & flat


def unprimed(listing: DataFrame, baseline: DataFrame) -> DataFrame:
    """Leave out what was present at start."""
    return listing.join(baseline.select("path").distinct(), "path", "left_anti")


class _Bucket(StatefulProcessor):
    """Keys of one bucket in one state: tuples that begin with the key and end with its due time.

    One timer a bucket stands at the earliest due time of its keys.
    """

    name: str
    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(self.name, self.schema)

    def _load(self) -> tuple[dict, int | None]:
        """What is held by key, and when the bucket's timer fires."""
        found = self.state.get()
        if found is None:
            return {}, None
        return {h[0]: tuple(h) for h in found[0]}, found[1]

    def _save(self, held: dict, timer: int | None, now: int) -> None:
        """Keep ``held`` and see to it that the timer stands at its earliest due time.

        A timer that has passed is left to fire; what it finds then decides the next.
        """
        due = max(min(h[-1] for h in held.values()), now + 1) if held else None
        if timer is not None and timer > now and timer != due:
            self.handle.deleteTimer(timer)
            timer = None
        if timer is None and due is not None:
            self.handle.registerTimer(due)
            timer = due
        if held:
            self.state.update((list(held.values()), timer))
        elif self.state.exists():
            self.state.clear()

    def _expire(self, timers, info) -> Iterator[tuple]:
        """Take out and give the keys that are due; ``_later`` says which of them stay."""
        held, _ = self._load()
        now, fired = timers.getCurrentWatermarkInMs(), info.getExpiryTimeInMs()
        for key, h in list(held.items()):
            if h[-1] < now or h[-1] <= fired:
                later = self._later(h, now)
                if later is None:
                    del held[key]
                    yield h
                else:
                    held[key] = later
        self._save(held, None, now)

    def _later(self, h: tuple, now: int) -> tuple | None:
        return None


def _by_key(rows: Iterator[Row], key: str, *columns: str) -> dict:
    """Sorted tuples of ``columns`` by key."""
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(tuple(r[c] for c in columns))
    for looks in out.values():
        looks.sort()
    return out


class _Settling(_Bucket):
    """What is known of the paths, changed by each look at them."""

    name, schema = FILE_STATE, _STATE

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        files, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        for path, looks in _by_key(rows, "path", "observed_at", "size").items():
            held = files.get(path)
            due = None
            if held is not None:
                _, size, stable, first, done, last, due = held
            known = held is not None
            for at, seen in looks:
                moment = at.timestamp()
                last = moment
                if seen == FORGET:
                    known = False
                elif not known:
                    known, size, stable, first, done = True, seen, 0, moment, False
                elif not done:
                    if moment - first > K.SETTLE_TIMEOUT_SECONDS:
                        done = True
                    elif seen != size or seen == 0:
                        stable = 0
                    else:
                        stable += 1
                        done = stable >= K.STABLE_CHECKS
                    size = seen
                    if done:
                        yield Row(path=path, size=seen, observed_at=at)
            if not known:
                files.pop(path, None)
                continue
            if due is None:
                # Later looks are taken into account when this time has come.
                due = max(_due(last, done), now + 1)
            files[path] = (path, size, stable, first, done, last, due)
        self._save(files, timer, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # No listing has named these paths for long: forget them, emit nothing.
        for _ in self._expire(timerValues, expiredTimerInfo):
            pass
        return iter(())

    def _later(self, h: tuple, now: int) -> tuple | None:
        due = _due(h[5], h[4])
        return (*h[:6], due) if due > now else None


def _due(last: float, done: bool) -> int:
    """When a path that is not seen again is forgotten, in milliseconds."""
    return int((last + (REMEMBER_SECONDS if done else 10 * K.SETTLE_TIMEOUT_SECONDS)) * 1000)


def _with_state(
    rows: DataFrame, key: str, processor: StatefulProcessor, output: str, buckets: int
) -> DataFrame:
    """Run a processor per bucket of keys on event time; its states live in the embedded store that it needs."""
    spark = rows.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithState(
        processor, output, "append", "eventtime"
    )


def settled_files(listing: DataFrame, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Files whose size held still for two checks, or that took too long.

    A path is emitted once, on an observation; a control row with size
    ``FORGET`` arms it again. State is one small tuple per path, kept
    together in ``buckets``; timers clear files that vanished, settled or not.
    """
    return _with_state(
        listing.withWatermark("observed_at", delay).select("path", "size", "observed_at"),
        "path", _Settling(), _OUTPUT, buckets,
    )


def watched(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """``path, size, done, first_seen, last_seen`` as a settling query knew them.

    Read from the state in the query's checkpoint, after its last batch or after
    ``batch``; the query may be running or stopped.
    """
    reader = spark.read.format("statestore").option("stateVarName", FILE_STATE)
    if batch is not None:
        reader = reader.option("batchId", batch)
    held = reader.load(checkpoint).select(F.explode("value.held").alias("f"))
    return held.select(
        "f.path",
        "f.size",
        "f.done",
        F.timestamp_seconds("f.first_seen").alias("first_seen"),
        F.timestamp_seconds("f.last_seen").alias("last_seen"),
    )


def watch_status(states: DataFrame) -> DataFrame:
    """Known and settling file counts from ``states(path, done)``."""
    return states.agg(
        F.count_if("done").alias("known_files"), F.count_if(~F.col("done")).alias("settling")
    )


_STALE_STATE = "held array<struct<scan_id:bigint,since:double,due:bigint>>, next bigint"
_STALE_OUTPUT = "scan_id bigint, status string, verdict string, error_code string"


class _Stale(_Bucket):
    """Since when scans have been unfinished."""

    name, schema = "open", _STALE_STATE

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        opened, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        for scan_id, seen in _by_key(rows, "scan_id", "ts", "status").items():
            if seen[-1][1] not in K.NON_TERMINAL_STATUSES:
                opened.pop(scan_id, None)
            elif scan_id not in opened:
                since = seen[0][0].timestamp()
                opened[scan_id] = (scan_id, since, max(int((since + K.STALE_HOURS * 3600) * 1000), now + 1))
        self._save(opened, timer, now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for scan_id, *_ in self._expire(timerValues, expiredTimerInfo):
            yield Row(scan_id=scan_id, status="failed", verdict="unknown", error_code="interrupted")


def stale_scans(lifecycle: DataFrame, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Scans still unfinished two hours of event time after they appeared.

    Expects ``scan_id, status, ts``. Scans that finish within a batch leave no state.
    """
    return _with_state(
        lifecycle.withWatermark("ts", delay).select("scan_id", "status", "ts"),
        "scan_id", _Stale(), _STALE_OUTPUT, buckets,
    )
