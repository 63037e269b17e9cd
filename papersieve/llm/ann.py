"""Maximum-inner-product search: inverted lists with an adaptive scan of dimensions.

Vectors get one more coordinate so that all have the same length; the largest
inner product then is the smallest distance. A random rotation, the same for
all, spreads every distance evenly over the coordinates. Within each probed list
the coordinates are read in blocks of columns; after each block the distance so
far, scaled up, is tested against the distance of the query's k-th best
candidate, and those that are very unlikely to get below it are abandoned.
What survives is scored exactly, in double precision, on the original vectors.

The lists come from k-means over a sample of at most ``SAMPLE_ROWS`` vectors;
every vector is indexed. Equal vectors are one entry with their smallest ids, as
many as any query can return, so a vector that a third of all rows share costs
one comparison. A query probes its nearest list first; the bound found there is
carried into the nearest ``PROBE_SHARE`` of the lists, ``LEAST_PROBES`` at least. A query that finds fewer
than k candidates this way is answered over all lists.

Large lists are cut into blocks of ``BLOCK_ROWS`` vectors and their queries into
groups of ``QUERY_ROWS``: no task holds more than one block and one group.

Edge cases: vectors that are null, zero, of another dimension than most, or that
hold null or non-finite components take no part, as queries or candidates; ties
go to the smaller id; repeated rows count once, and an id with several vectors is one
candidate per vector and leaves out all of them as a query; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve.llm.common import written

K = 20
SAMPLE_ROWS = 16_384
ROWS_PER_LIST = 1_024
MOST_LISTS = 4_096
ROUNDS = 8
PROBE_SHARE = 0.7
# Lists probed at least: with few lists a share of them is too coarse.
LEAST_PROBES = 24
COLUMN_BLOCK = 8
# Width of the hypothesis test: larger abandons less.
EPSILON = 2.1
# So few candidates are scored at once rather than tested further.
FEW = 16
BLOCK_ROWS = 8_192
QUERY_ROWS = 4_096
SEED = 20


def valid(vector: Column) -> Column:
    """Not null, not zero, all components present and finite."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    zero = F.forall(vector, lambda x: x == 0)
    return F.coalesce(vector.isNotNull() & ~bad & ~zero, F.lit(False))


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors that take part. Runs one action for the dimension."""
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    ).filter(F.col("vec_id").isNotNull() & valid(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0))


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def kmeans(rows: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of ``rows`` by Lloyd's method from a seeded draw; empty lists keep theirs."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(rows))
    centroids = rows[np.sort(rng.choice(len(rows), lists, replace=False))].copy()
    for _ in range(rounds):
        nearest = nearest_lists(rows, centroids)
        counts = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def nearest_lists(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=np.int64)
    half = (centroids**2).sum(axis=1) / 2
    for lo in range(0, len(rows), 4_096):
        out[lo : lo + 4_096] = np.argmin(half - rows[lo : lo + 4_096] @ centroids.T, axis=1)
    return out


def lift(rows: np.ndarray, square: float) -> np.ndarray:
    """Candidates with the coordinate that makes all squared norms equal to ``square``."""
    rest = np.sqrt(np.maximum(square - (rows**2).sum(axis=1), 0.0))
    return np.concatenate([rows, rest[:, None]], axis=1)


def adaptive_scan(
    rows: np.ndarray, query: np.ndarray, bound: float, block: int = COLUMN_BLOCK
) -> np.ndarray:
    """Positions of the candidates whose distance may be below ``bound``.

    ``rows`` holds rotated candidates by column: ``rows[d]`` is coordinate d of all.
    """
    dims = len(rows)
    alive = None
    partial = np.zeros(rows.shape[1])
    for lo in range(0, dims, block):
        hi = min(dims, lo + block)
        delta = rows[lo:hi] if alive is None else rows[lo:hi].take(alive, axis=1)
        delta = delta - query[lo:hi, None]
        partial = partial + np.einsum("ij,ij->j", delta, delta)
        slack = 1.0 if hi == dims else (1 + EPSILON / np.sqrt(hi)) ** 2 * hi / dims
        keep = np.flatnonzero(partial <= bound * slack)
        if len(keep) < len(partial):
            alive = keep if alive is None else alive[keep]
            partial = partial[keep]
            if len(alive) <= FEW:
                break
    return np.arange(rows.shape[1]) if alive is None else alive


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Double-precision inner products, added up in the order of the components."""
    return np.cumsum(rows * query, axis=1)[:, -1]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


ENTRY = "list int, block int, v array<double>, ids array<bigint>"
FOUND = "qid long, vec_id long, score double"


class Index:
    """Lists of distinct vectors, with what a query needs to choose among them."""

    def __init__(self, entries, centroids, turn, square, sizes, members):
        self.entries = entries
        self.centroids = centroids
        self.turn = turn
        self.square = square
        self.sizes = sizes
        self.members = members


def build(vectors: DataFrame, k: int = K, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """Index every vector of ``vec_id, v``. Runs a few actions; None without vectors.

    The driver holds the sample (at most ``sample_rows`` vectors) and one row
    per list (at most ``MOST_LISTS``).
    """
    spark = vectors.sparkSession
    first = Window.partitionBy("v").orderBy("vec_id")
    # A row that is there twice is one candidate: repeats must not fill the places of others.
    ranked = vectors.select("vec_id", "v").distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1)
    distinct = written(
        ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors"
    )
    stats = distinct.agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
    ).first()
    n = int(stats["n"])
    if not n:
        return None
    square = float(stats["square"]) * (1 + 1e-12)
    draw = F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    sample = _matrix(
        distinct.filter(draw < min(1.0, 0.95 * sample_rows / n) if n > sample_rows else F.lit(True))
        .select("v")
        .toArrow()
        .column(0)
        .combine_chunks()
    )
    sample = sample[np.lexsort(sample.T[::-1])]
    lists = max(1, min(MOST_LISTS, n // ROWS_PER_LIST, len(sample) // 4))
    turn = rotation(sample.shape[1] + 1)
    centroids = kmeans(lift(sample, square) @ turn, lists)
    shared = spark.sparkContext.broadcast((centroids, turn, square))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, turn, square = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = lift(_matrix(batch.column(0)), square) @ turn
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest_lists(rows, centroids), pa.int32()), *batch.columns],
                names=["list", "v", "ids"],
            )

    placed = written(
        distinct.select("v", "ids").mapInArrow(
            assign, "list int, v array<double>, ids array<bigint>"
        ),
        "lists",
    )
    sizes, members = np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
    counted = placed.groupBy("list").agg(
        F.count("*").alias("n"), F.sum(F.size("ids")).alias("m")
    )
    for r in counted.collect():
        sizes[r["list"]], members[r["list"]] = r["n"], r["m"]
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))
    by_list = F.array(*[F.lit(int(b)) for b in blocks]) if blocks.max() > 1 else None
    block = (
        F.pmod(F.xxhash64("v"), F.get(by_list, F.col("list"))).cast("int")
        if by_list is not None
        else F.lit(0)
    )
    entries = placed.select("list", block.alias("block"), "v", "ids")
    return Index(entries, centroids, turn, square, sizes, members)


def _probes(index: Index, queries: DataFrame, share: float, least: int, first: bool) -> DataFrame:
    """``qid, q, bound, list, block, part``: one row per query and block to scan.

    ``first`` takes the nearest lists until they hold ``least`` ids; otherwise
    the nearest ``share`` of the lists, more if they hold fewer, without those.
    """
    blocks = np.maximum(1, -(-index.sizes // BLOCK_ROWS))
    shared = queries.sparkSession.sparkContext.broadcast(
        (index.centroids, index.turn, index.members, blocks)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, turn, members, blocks = shared.value
        count = min(len(centroids), max(LEAST_PROBES, int(np.ceil(share * len(centroids)))))
        half = (centroids**2).sum(axis=1) / 2
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                q = _matrix(batch.column(1))
                turned = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ turn
                order = np.argsort(half - turned @ centroids.T, axis=1, kind="stable")
                held = np.cumsum(members[order], axis=1)
                near = np.minimum((held < least).sum(axis=1) + 1, len(centroids))
                end = near if first else np.maximum(near, count)
                row, lists, block = [], [], []
                for i in range(len(q)):
                    for x in order[i, 0 if first else near[i] : end[i]].tolist():
                        for b in range(blocks[x]):
                            row.append(i)
                            lists.append(x)
                            block.append(b)
                if row:
                    picked = batch.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*picked.columns, pa.array(lists, pa.int32()), pa.array(block, pa.int32())],
                        names=["qid", "q", "bound", "list", "block"],
                    )

    return queries.select("qid", "q", "bound").mapInArrow(
        run, "qid long, q array<double>, bound double, list int, block int"
    )


def _scan(index: Index, probes: DataFrame, k: int) -> DataFrame:
    """Best ``k + 1`` ids of every query in every block it probes."""
    spark = probes.sparkSession
    probes = written(probes, "probes")
    loads = {
        r["list"]: -(-r["n"] // QUERY_ROWS)
        for r in probes.filter("block = 0").groupBy("list").agg(F.count("*").alias("n")).collect()
    }
    groups = np.ones(len(index.sizes), dtype=np.int64)
    for x, n in loads.items():
        groups[x] = n
    parts = F.lit(1)
    if groups.max() > 1:
        parts = F.get(F.array(*[F.lit(int(g)) for g in groups]), F.col("list"))
    probes = probes.withColumn("part", F.pmod(F.xxhash64("qid"), parts).cast("int"))
    entries = index.entries.withColumn(
        "part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))
    )
    shared = spark.sparkContext.broadcast((index.turn, index.square))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        turn, square = shared.value
        schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        rows = _matrix(left.column("v").combine_chunks())
        ids_column = left.column("ids").combine_chunks()
        offsets, ids = ids_column.offsets.to_numpy(), ids_column.flatten().to_numpy()
        offsets = offsets - offsets[0]
        columns = np.ascontiguousarray((lift(rows, square) @ turn).T)
        q = _matrix(right.column("q").combine_chunks())
        bounds = right.column("bound").to_numpy()
        qids = right.column("qid").to_numpy()
        turned = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ turn
        out_q, out_id, out_score = [], [], []
        # The first candidates of the list, scored whole, tighten each query's bound.
        head = rows[: 4 * k] @ q.T
        if len(head) == 4 * k:
            bounds = np.maximum(bounds, np.partition(head, len(head) - k - 1, axis=0)[len(head) - k - 1])
        for i in range(len(q)):
            norm = float(q[i] @ q[i])
            # A bound on the inner product is one on the distance; the slack covers rounding.
            bound = norm + square - 2 * bounds[i]
            bound += 1e-9 * (norm + square)
            alive = adaptive_scan(columns, turned[i], bound)
            if not len(alive):
                continue
            score = inner_products(rows[alive], q[i])
            # The slack keeps what rounding alone puts below the bound.
            good = score >= bounds[i] - 1e-9 * (norm + square)
            alive, score = alive[good], score[good]
            if not len(alive):
                continue
            if len(score) > k + 1:
                cut = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                alive, score = alive[score >= cut], score[score >= cut]
            reps = offsets[alive + 1] - offsets[alive]
            at = np.repeat(offsets[alive] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
            found, value = ids[at], np.repeat(score, reps)
            best = np.lexsort((found, -value))[: k + 1]
            out_q.append(np.full(len(best), qids[i]))
            out_id.append(found[best])
            out_score.append(value[best])
        if not out_q:
            return schema.empty_table()
        return pa.table([np.concatenate(x) for x in (out_q, out_id, out_score)], schema=schema)

    keys = ["list", "block", "part"]
    return entries.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(run, FOUND)


def search(
    index: Index, queries: DataFrame, k: int = K, probe_share: float = PROBE_SHARE
) -> DataFrame:
    """``qid, vec_id, score``: the best ``k + 1`` found for every row of ``qid, q``."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    total = int(index.members.sum())
    enough = min(k + 1, total)

    def top(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)

    open_bound = queries.select("qid", "q", F.lit(float("-inf")).alias("bound"))
    nearest = _scan(index, _probes(index, open_bound, 0.0, k + 1, True), k)
    nearest = written(top(nearest).drop("rank"), "nearest")
    bounds = nearest.groupBy("qid").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    bounded = queries.join(bounds, "qid", "left").select(
        "qid", "q",
        F.when(F.col("n") > k, F.col("worst")).otherwise(F.lit(float("-inf"))).alias("bound"),
    )
    others = _scan(index, _probes(index, bounded, probe_share, k + 1, False), k)
    found = written(top(nearest.unionByName(others)).drop("rank"), "found")
    # Whoever still lacks candidates that exist is answered over every list.
    short = queries.join(
        found.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= enough),
        "qid", "left_anti",
    )
    short = written(short, "short")
    if short.isEmpty():
        return found
    again = _scan(
        index,
        _probes(index, short.withColumn("bound", F.lit(float("-inf"))), 1.0, 0, False)
        .unionByName(_probes(index, short.withColumn("bound", F.lit(float("-inf"))), 0.0, 0, True)),
        k,
    )
    kept = found.join(short.select("qid"), "qid", "left_anti")
    return kept.unionByName(top(again).drop("rank"))


def nearest_neighbours(
    df: DataFrame, every: int = 20, k: int = K, probe_share: float = PROBE_SHARE
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows whose id is divisible by ``every``.

    Equal query vectors are searched once; each query then leaves out its own id.
    """
    vectors = written(usable(df), "usable")
    index = build(vectors, k)
    if index is None:
        return df.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double"
        )
    asking = vectors.filter(F.col("vec_id") % every == 0)
    distinct = asking.groupBy("v").agg(F.min("vec_id").alias("qid"))
    found = search(index, distinct.select("qid", F.col("v").alias("q")), k, probe_share)
    asked = asking.join(distinct, "v").select("qid", F.col("vec_id").alias("query_id")).distinct()
    own_out = asked.join(found, "qid").filter(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        own_out.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
