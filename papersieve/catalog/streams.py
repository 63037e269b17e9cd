"""Streaming queries run to completion over the table files, and batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.catalog import fragments as X
from papersieve.catalog.registry import query
from papersieve.operators.scoring import verdict_of, worst_verdict
from papersieve.plans import inputs as I
from papersieve.session import checkpoint_dir
from papersieve.sources.store import ResultStore
from papersieve.streaming.counters import keep_updates
from papersieve.streaming import counters as wc
from papersieve.streaming import ingest as ig
from papersieve.streaming import settle as st
from papersieve.streaming import windows as wn


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of them."""
    schema = I.table(spark, sf, name).schema
    # A stream takes a plain path for a folder, but lists whatever a pattern matches.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def stream_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_once(streaming: DataFrame, root: str | None = None) -> DataFrame:
    """Drain an append-mode stream into a table and read the table; its log is ``root``/log."""
    spark = streaming.sparkSession
    root = root or stream_root(spark)
    writer = (
        streaming.writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/log").trigger(availableNow=True).outputMode("append")
    )
    writer.start().awaitTermination()
    return spark.read.schema(streaming.schema).parquet(f"{root}/out")


def run_updates(streaming: DataFrame, keys: list[str]) -> DataFrame:
    """Drain an aggregating stream in update mode; the latest row of each key is the answer."""
    spark = streaming.sparkSession
    root = stream_root(spark)
    (
        streaming.writeStream.foreachBatch(keep_updates(f"{root}/store", "updates"))
        .option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
        .outputMode("update").start().awaitTermination()
    )
    return ResultStore(spark, f"{root}/store").current("updates", keys).drop("batch")


# Events arrive in five slices by day, one file and micro-batch each; a few come two slices late.
_SLICE = "least(4, greatest(0, (day(ts) - 1) DIV 6) + CASE WHEN event_id % 50 = 7 THEN 2 ELSE 0 END)"
SLICES = 5


def sliced_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of ``SLICES`` micro-batches."""
    rows = I.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{stream_root(spark)}/slices"
    for k in range(SLICES):
        # One file after the other: the stream takes them in the order they were written.
        rows.where(f"{_SLICE} = {k}").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def counted(spark: SparkSession, sf: str, rows: DataFrame, **window: str) -> wc.WindowCounters:
    """Drain a stream through window counters."""
    root = stream_root(spark)
    sums = tuple(c for c in rows.columns if c != "ts")
    counters = wc.WindowCounters(f"{root}/store", sums, **window)
    (
        rows.writeStream.foreachBatch(counters).option("checkpointLocation", f"{root}/log")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return counters


# Listing rows: names from event types, sizes that settle or keep growing.
_NAMES = """CASE event_id % 8 WHEN 0 THEN concat('/in/a', CAST(user_id AS STRING), '.pdf') WHEN 1 THEN concat('/in/.hidden/b', CAST(user_id AS STRING), '.pdf')
  WHEN 2 THEN concat('/in/sub/c', CAST(user_id AS STRING), '.pdf') WHEN 3 THEN concat('/in/d', CAST(user_id AS STRING), '.pdf.part') WHEN 4 THEN concat('/in/.e', CAST(user_id AS STRING), '.pdf')
  WHEN 5 THEN concat('/in/f', CAST(user_id AS STRING), '.PDF') WHEN 6 THEN concat('/in/g', CAST(user_id AS STRING), '.txt') ELSE concat('/in/h', CAST(user_id AS STRING), '.pdf') END"""


@query(
    "W1_candidates",
    f"""WITH l AS (SELECT DISTINCT {_NAMES} AS path FROM events) SELECT path, event_flat AS flat FROM (SELECT path, NOT contains(substr(path, 5), '/') AS event_flat FROM l WHERE regexp_matches(path, '\\.pdf$') AND NOT regexp_matches(path, '/\\.[^/]*$') AND NOT regexp_matches(path, '/\\.[^/]*/[^/]*$'))""",
)
def _(spark, sf):
    paths = I.table(spark, sf, "events").select(F.expr(_NAMES).alias("path")).distinct()
    return paths.where(st.is_candidate(F.col("path"), True)).select(
        "path", st.is_candidate(F.col("path"), False, "/in").alias("flat")
    )


def listing(rows: DataFrame) -> DataFrame:
    """Nine observations, 15 s apart, of one file per nine events."""
    look = F.expr("event_id % 9")
    group = F.expr("event_id DIV 9")
    grows = F.expr("(event_id DIV 9) % 4")
    return rows.select(
        F.concat(F.lit("/in/"), group.cast("string"), F.lit(".pdf")).alias("path"),
        (F.least(look, grows) * 10 + F.expr("(event_id DIV 9) % 3")).cast("bigint").alias("size"),
        (
            F.lit("2024-01-01 00:00:00").cast("timestamp")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (group * 1000 + look * 15).cast("decimal(18,6)"))
        ).alias("observed_at"),
    )


# Sizes: min(look, g) * 10 + r. Stable from look g on; a size of 0 (g = r = 0)
# never counts, so those files leave at the 120 s limit only, which nine looks
# do not reach (8 * 15 = 120 is not more than 120).
_SETTLED = """WITH f AS (SELECT event_id // 9 AS grp, count(*) AS looks FROM events GROUP BY 1),
t AS (SELECT grp, looks, grp % 4 AS g, grp % 3 AS r FROM f)
SELECT '/in/' || grp || '.pdf' AS path, (g * 10 + r)::BIGINT AS size, (grp * 1000 + (g + 2) * 15)::BIGINT AS at
FROM t WHERE looks > g + 2 AND NOT (g = 0 AND r = 0)"""


@query("W2_settled_files", _SETTLED)
def _(spark, sf):
    settled = st.settled_files(listing(stream_of(spark, sf, "events")))
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return run_once(settled).select("path", "size", (F.unix_timestamp("observed_at") - start).alias("at"))


@query("W3_primed", f"WITH l AS (SELECT DISTINCT {_NAMES} AS path FROM events), b AS (SELECT DISTINCT {_NAMES} AS path FROM events WHERE user_id % 2 = 0) SELECT path FROM l WHERE path NOT IN (SELECT path FROM b)")
def _(spark, sf):
    rows = I.table(spark, sf, "events").withColumn("path", F.expr(_NAMES))
    base = rows.where("user_id % 2 = 0")
    live = stream_of(spark, sf, "events").select(F.expr(_NAMES).alias("path"))
    return run_once(st.unprimed(live, base)).distinct()


def forgotten(rows: DataFrame) -> DataFrame:
    """After all looks each file is forgotten once and then holds still for three looks."""
    later = [(st.FORGET, 200), (7, 215), (7, 230), (7, 245)]
    looks = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(t).alias("t")) for s, t in later])
    first = listing(rows.where("event_id % 9 = 0")).select("path", "observed_at", F.explode(looks).alias("x"))
    return first.select(
        "path",
        F.col("x.size").cast("bigint").alias("size"),
        F.timestamp_add("SECOND", F.col("x.t"), F.col("observed_at")).alias("observed_at"),
    )


@query(
    "W4_submitted_once",
    _SETTLED.replace("SELECT '/in/'", "SELECT count(path) + any_value(groups) AS n, any_value(groups) AS paths FROM (SELECT count(*) AS groups FROM t) LEFT JOIN (SELECT '/in/'") + ") ON true",
)
def _(spark, sf):
    rows = stream_of(spark, sf, "events")
    settled = run_once(st.settled_files(listing(rows).unionByName(forgotten(rows))))
    return settled.agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


class _Bytes(ig.Ingest):
    """Ingest for the derived files, which arrive as table rows."""

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        files = rows.select(
            F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
            F.when(F.expr("doc_id % 50 = 7"), F.lit("plain text").cast("binary"))
            .otherwise(F.encode(F.expr(I.PDF_TEXT), "UTF-8")).alias("content"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("observed_at"),
        )
        super().__call__(
            I.spread(files).withColumn("length", F.octet_length("content").cast("long")), batch_id
        )


def ingested(spark: SparkSession, sf: str) -> str:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INGESTED:
        root = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
        (
            stream_of(spark, sf, "documents").writeStream.foreachBatch(_Bytes(f"{root}/store"))
            .option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
            .start().awaitTermination()
        )
        _INGESTED[key] = f"{root}/store"
    return _INGESTED[key]


_INGESTED: dict[tuple[str, str], str] = {}
# Content depends on doc_id except in the broken files, which are all alike: only
# the first of those by path is scanned.
_MARKED = f"SELECT *, doc_id % 50 = 7 OR (doc_id % 29 = 3 AND {X.VALID}) AS refused FROM documents"
_SENT = f"""SELECT *, NOT refused AND row_number() OVER (PARTITION BY refused, CASE WHEN doc_id % 41 = 9 THEN -1 ELSE doc_id END ORDER BY doc_id::STRING || '.pdf') = 1 AS kept FROM ({_MARKED})"""


@query("W5_content_dedup", f"WITH s AS ({_SENT}) SELECT count(*) AS scans, count(*) AS hashes FROM s WHERE kept")
def _(spark, sf):
    saved = ResultStore(spark, ingested(spark, sf)).rows("scans")
    return saved.agg(F.count("*").alias("scans"), F.count_distinct("sha256").alias("hashes"))


_INGEST_SQL = f"""WITH {X.FILE_INDICATORS}, agg AS ({X.SCORED}), s AS ({_SENT}),
k AS (SELECT s.doc_id, coalesce({X.final_score('raw', 'sev', 'n_indicators')}, 0) AS score FROM s LEFT JOIN agg ON s.doc_id = agg.doc_id WHERE kept)"""


@query("W6_ingest_verdicts", f"{_INGEST_SQL} SELECT doc_id || '.pdf' AS filename, score AS risk_score, {X.verdict('score')} AS verdict, CASE WHEN score >= 80 THEN 'quarantined' ELSE 'completed' END AS status FROM k")
def _(spark, sf):
    return ResultStore(spark, ingested(spark, sf)).latest("scans").select("filename", "risk_score", "verdict", "status")


@query(
    "W7_lifecycle_events",
    f"WITH s AS ({_SENT}) SELECT kind, count(*) AS n FROM s, (VALUES ('queued'), ('parsing'), ('completed')) AS v(kind) WHERE kept GROUP BY 1 UNION ALL SELECT CASE WHEN refused THEN 'rejected' ELSE 'duplicate' END, count(*) FROM s WHERE NOT kept GROUP BY 1 UNION ALL SELECT 'idle', 1",
)
def _(spark, sf):
    return ResultStore(spark, ingested(spark, sf)).rows("events").groupBy("kind").agg(F.count("*").alias("n"))


_KIND = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'parsing' WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
_DELTA = f"CASE {_KIND} WHEN 'queued' THEN 1 WHEN 'completed' THEN -1 WHEN 'failed' THEN -1 ELSE 0 END"


@query(
    "W8_queue_depth",
    f"SELECT event_id, sum({_DELTA}) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS depth, sum({_DELTA}) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 0 AS idle FROM events",
)
def _(spark, sf):
    events = I.table(spark, sf, "events").withColumn("kind", F.expr(_KIND))
    return wn.depth_over_time(events).select("event_id", "depth", "idle")


@query("W8_queue_depth_stream", f"SELECT sum({_DELTA})::BIGINT AS depth, sum({_DELTA}) <= 0 AS idle FROM events")
def _(spark, sf):
    events = stream_of(spark, sf, "events").withColumn("kind", F.expr(_KIND))
    return run_updates(wn.queue_depth(events).withColumn("run", F.lit(1)), ["run"]).drop("run")


# One scan per event; two thirds of them finish at once, the others never do.
@query(
    "W9_stale_scans",
    "SELECT event_id AS scan_id, 'failed' AS status, 'unknown' AS verdict, 'interrupted' AS error_code FROM events WHERE event_id % 3 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 130 MINUTE",
)
def _(spark, sf):
    life = stream_of(spark, sf, "events").select(
        F.col("event_id").alias("scan_id"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'analyzing' ELSE 'completed' END").alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return run_once(st.stale_scans(life))


def scan_events(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"),
        verdict_of(F.expr("CAST(event_id % 101 AS INT)")).alias("verdict"),
    )


_WINDOWED = """WITH w AS (SELECT event_id, unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM events)
SELECT epoch(s)::BIGINT AS window_start, count(*) AS scanned, count(*) FILTER (WHERE event_id % 101 >= 80) AS malicious FROM w {closed} GROUP BY 1"""
_CLOSED = "WHERE s + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def shown(counters: DataFrame) -> DataFrame:
    return counters.select(F.unix_timestamp("window_start").alias("window_start"), "scanned", "malicious")


@query("W10_day_counters", _WINDOWED.format(closed=""))
def _(spark, sf):
    return shown(wn.day_counters(scan_events(I.table(spark, sf, "events"))))


@query("W10_day_counters_stream", _WINDOWED.format(closed=_CLOSED))
def _(spark, sf):
    return shown(run_once(wn.day_counters(scan_events(stream_of(spark, sf, "events")))))


def token_events(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.expr("CAST(floor(value * 100) AS BIGINT)").alias("tokens"))


_TOKENS = "SELECT CAST(ts AS DATE)::STRING AS day, sum(floor(value * 100))::BIGINT AS tokens FROM events WHERE floor(value * 100) > 0 {closed} GROUP BY 1"


@query("W11_daily_tokens", _TOKENS.format(closed=""))
def _(spark, sf):
    return wn.daily_tokens(token_events(I.table(spark, sf, "events"))).withColumn("day", F.col("day").cast("string"))


@query("W11_daily_tokens_stream", _TOKENS.format(closed="AND CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"))
def _(spark, sf):
    rows = run_once(wn.daily_tokens(token_events(stream_of(spark, sf, "events"))))
    return rows.withColumn("day", F.col("day").cast("string"))


@query(
    "W12_watch_status",
    _SETTLED.replace("SELECT '/in/'", ", s AS (SELECT '/in/'") + ") SELECT (SELECT count(*) FROM s) AS known_files, (SELECT count(*) FROM f) - (SELECT count(*) FROM s) AS settling",
)
def _(spark, sf):
    root = stream_root(spark)
    run_once(st.settled_files(listing(stream_of(spark, sf, "events"))), root)
    return st.watch_status(st.watched(spark, f"{root}/log", 0))


@query(
    "W12_watched_files",
    _SETTLED.replace("SELECT '/in/'", ", s AS (SELECT grp, '/in/'") + """)
SELECT '/in/' || f.grp || '.pdf' AS path, s.grp IS NOT NULL AS done, (f.grp * 1000)::BIGINT AS first_at,
  (f.grp * 1000 + (f.looks - 1) * 15)::BIGINT AS last_at FROM f LEFT JOIN s ON s.grp = f.grp""",
)
def _(spark, sf):
    root = stream_root(spark)
    run_once(st.settled_files(listing(stream_of(spark, sf, "events"))), root)
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return st.watched(spark, f"{root}/log", 0).select(
        "path", "done", (F.unix_timestamp("first_seen") - start).alias("first_at"),
        (F.unix_timestamp("last_seen") - start).alias("last_at"),
    )


@query("W13_run_verdict", "SELECT CASE max(CASE WHEN event_id % 101 >= 80 THEN 4 WHEN event_id % 101 >= 50 THEN 3 WHEN event_id % 101 >= 20 THEN 1 ELSE 0 END) WHEN 4 THEN 'malicious' WHEN 3 THEN 'suspicious' WHEN 1 THEN 'low_risk' ELSE 'clean' END AS worst FROM events")
def _(spark, sf):
    found = wn.run_verdict(scan_events(sliced_stream(spark, sf)))
    return run_updates(found.withColumn("run", F.lit(1)), ["run"]).drop("run")


_VERDICT_RANK = "CASE WHEN event_id % 101 >= 80 THEN 4 WHEN event_id % 101 >= 50 THEN 3 WHEN event_id % 101 >= 20 THEN 1 ELSE 0 END"


@query(
    "W13_verdict_by_user",
    f"SELECT user_id, count(*) AS scanned, CASE max({_VERDICT_RANK}) WHEN 4 THEN 'malicious' WHEN 3 THEN 'suspicious' WHEN 1 THEN 'low_risk' ELSE 'clean' END AS worst FROM events GROUP BY user_id",
)
def _(spark, sf):
    rows = sliced_stream(spark, sf)
    verdict = verdict_of(F.expr("CAST(event_id % 101 AS INT)"))
    return run_updates(
        rows.groupBy("user_id").agg(F.count("*").alias("scanned"), worst_verdict(verdict).alias("worst")), ["user_id"]
    )


# Each row's micro-batch, and what the batches before it had seen.
_ARRIVED = f"""WITH e AS (SELECT *, {_SLICE.replace(' DIV ', ' // ')} AS slice FROM events),
m AS (SELECT slice, max(ts) AS newest FROM e GROUP BY 1),
k AS (SELECT a.slice, max(b.newest) - INTERVAL 1 HOUR AS mark FROM m a LEFT JOIN m b ON b.slice < a.slice GROUP BY 1),
r AS (SELECT e.*, k.mark FROM e JOIN k USING (slice))"""


@query(
    "W10_late_rows",
    f"""{_ARRIVED} SELECT slice AS batch, count(*) AS n_rows,
      count(*) FILTER (WHERE date_trunc('hour', ts) + INTERVAL 24 HOUR <= mark) AS late FROM r GROUP BY slice""",
)
def _(spark, sf):
    rows = sliced_stream(spark, sf).select("ts", F.lit(1).alias("scanned"))
    return counted(spark, sf, rows).late_rows(spark)


@query(
    "W10_on_time_counters",
    f"""{_ARRIVED}, w AS (SELECT event_id, mark, unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM r)
    SELECT epoch(s)::BIGINT AS window_start, count(*) AS scanned, count(*) FILTER (WHERE event_id % 101 >= 80) AS malicious
    FROM w WHERE mark IS NULL OR s + INTERVAL 24 HOUR > mark GROUP BY 1""",
)
def _(spark, sf):
    rows = sliced_stream(spark, sf).select(
        "ts", F.lit(1).alias("scanned"), F.expr("CASE WHEN event_id % 101 >= 80 THEN 1 ELSE 0 END").alias("malicious")
    )
    return shown(counted(spark, sf, rows).totals(spark))


@query(
    "W11_on_time_tokens",
    f"""{_ARRIVED} SELECT CAST(ts AS DATE)::STRING AS day, sum(floor(value * 100))::BIGINT AS tokens FROM r
    WHERE floor(value * 100) > 0 AND (mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark) GROUP BY 1""",
)
def _(spark, sf):
    rows = token_events(sliced_stream(spark, sf)).where("tokens > 0")
    totals = counted(spark, sf, rows, length="1 day", slide="1 day").totals(spark)
    return totals.select(F.to_date("window_start").cast("string").alias("day"), "tokens")
