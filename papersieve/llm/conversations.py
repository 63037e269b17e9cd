"""Prefix trie of conversations, by digests of fixed-length blocks of turns.

A node of the trie is a distinct sequence of first ``d`` turns. Comparing all
prefixes of all conversations turn by turn would cost a row per conversation and
turn in every step, so conversations are grouped by whole blocks first:

* :func:`blocks` cuts each conversation into blocks of ``BLOCK`` turns and digests
  each. Blocks of blocks are digested in the same way until one is left per
  conversation, and from there down every block learns the digest of all that lies
  before it and of all up to its end. The number of steps grows with the logarithm
  of the longest conversation, and no group holds more than ``BLOCK`` rows, also
  where one conversation has a third of all turns.
* Conversations with equal past and equal block are one *edge*, with its count and
  smallest id. All that happens inside an edge happens to its members alike.
* Turn boundaries inside a block are refined only where a past has more than one
  edge, that is where siblings diverge: there the edges' (not the conversations')
  prefixes are compared turn by turn. Elsewhere each turn takes the edge's figures.

Sums over subtrees need no walk. A node's figures are booked on its smallest
member, and a member books at its own nodes only, which are the last ones of its
path. So a subtree's sum is the sum over a node's members of what each booked in
all, less what its smallest member booked above the node. Members are summed by
edges again; what is booked above is a running total along one conversation.

The digest of a node's members is one SHA-256 over all their ids in order. Ids are
sorted over all tasks and joined into pieces of bounded size where they lie; only
pieces come together, and are hashed in a stream.

Edge cases: rows without a conv_id are left out. Turns are ordered with null
first, equal turns by the digest of role and text; null role or text is empty.
Repeated rows are turns of their own. A conversation without turns is a member of
the root. An empty table has no nodes. Columns besides the four play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import NON_BLANK, written
from papersieve.operators.ordered import running_before

BLOCK = 8
PIECE_CHARS = 1 << 16
# Conversations whose ids start with the same multiple share first turns.
GROUP, MOST_SHARED = 20, 4


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256 in hexadecimal, over parts with a separator."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)


def _root() -> Column:
    return F.lit("root")


# -- turns ----------------------------------------------------------------------------


def turns(df: DataFrame) -> DataFrame:
    """``conv_id, at, turn_digest, n_words`` of every turn, ``at`` counted from 0.

    Texts leave the scan as digests and counts. Positions come from slices, so a
    conversation with a third of all rows is numbered by a third of the tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digests = df.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        # The role's length keeps (role, text) apart from any other cut of the same characters.
        F.substring(
            F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32
        ).alias("turn_digest"),
        F.regexp_count(text, F.lit(f"{NON_BLANK}+")).cast("long").alias("n_words"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    # Written first: the bounds of the slices are sampled from the rows, which would digest each text twice.
    rows = written(digests, "turn-digests")
    order = ["turn", "turn_digest", "row_no"]
    return running_before(rows, F.lit(1).cast("long"), order, ["conv_id"], "at").select(
        "conv_id", "at", "turn_digest", "n_words"
    )


def rebuild(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that share first turns in groups.

    ``df`` is the result of :func:`turns`. Conversation ``c`` takes its first
    ``crc32(c) % 4`` turns from conversation ``c - c % 20`` and goes on with its
    own turns after as many. Returns ``(conv_id, at, turn_digest, n_words)`` and
    ``(conv_id, n_turns)``, the latter also for conversations left without turns.
    """
    lengths = df.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    given = lengths.select(F.col("conv_id").alias("donor"), F.col("own").alias("given"))
    c = F.col("conv_id")
    plan = (
        lengths.select(
            "conv_id",
            "own",
            (c - c % GROUP).alias("donor"),
            (F.crc32(c.cast("string").cast("binary")) % MOST_SHARED).alias("shared"),
        )
        .join(given, "donor", "left")
        .withColumn("taken", F.least("shared", F.coalesce("given", F.lit(0))))
    )
    first = df.filter(F.col("at") < MOST_SHARED).select(
        F.col("conv_id").alias("donor"), "at", "turn_digest", "n_words"
    )
    taken = plan.join(first, "donor").filter(F.col("at") < F.col("shared"))
    kept = (
        df.join(plan.select("conv_id", "shared", "taken"), "conv_id")
        .filter(F.col("at") >= F.col("shared"))
        .withColumn("at", F.col("at") - F.col("shared") + F.col("taken"))
    )
    columns = ("conv_id", "at", "turn_digest", "n_words")
    n_turns = F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))
    return taken.select(*columns).unionByName(kept.select(*columns)), plan.select(
        "conv_id", n_turns.alias("n_turns")
    )


# -- blocks ---------------------------------------------------------------------------


def _grouped(df: DataFrame, position: str, *carried: str) -> DataFrame:
    """Rows of one conversation in groups of ``BLOCK`` by position: ``conv_id, group, items``."""
    return df.groupBy("conv_id", F.floor(F.col(position) / BLOCK).alias("group")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), *carried))).alias("items")
    )


def blocks(df: DataFrame, longest: int) -> DataFrame:
    """``conv_id, block, past, upto, block_digest, items`` of every block of turns.

    ``past`` is the digest of all turns before the block and ``upto`` that of all
    turns to its end (meant only for full blocks); ``items`` are its turns in order.
    """
    levels = [
        written(
            _grouped(df, "at", "turn_digest", "n_words").select(
                "conv_id",
                F.col("group").alias("block"),
                _digest(F.lit("turns"), F.array_join("items.turn_digest", "")).alias("block_digest"),
                "items",
            ),
            "conversation-blocks",
        )
    ]
    size = -(-longest // BLOCK)
    while size > 1:
        below = levels[-1]
        levels.append(
            written(
                _grouped(below, "block", "block_digest").select(
                    "conv_id",
                    F.col("group").alias("block"),
                    _digest(F.lit(f"blocks{len(levels)}"), F.array_join("items.block_digest", "")).alias("block_digest"),
                    "items",
                ),
                "conversation-blocks",
            )
        )
        size = -(-size // BLOCK)
    # One block per conversation is left: nothing lies before it.
    known = levels[-1].withColumns(
        {"past": _root(), "upto": _digest(F.lit(f"end{len(levels)}"), F.col("block_digest"))}
    )
    for level in range(len(levels) - 2, -1, -1):
        before = lambda i: F.array_join(F.slice("items.block_digest", 1, i), "")
        prefix = lambda i: _digest(F.lit(f"past{level}"), F.col("past"), before(i))
        inner = known.select(
            "conv_id", "past", "upto", "items", F.posexplode("items").alias("i", "item")
        ).select(
            "conv_id",
            F.col("item.position").alias("block"),
            F.when(F.col("i") == 0, F.col("past")).otherwise(prefix(F.col("i"))).alias("past"),
            F.when(F.col("i") == BLOCK - 1, F.col("upto")).otherwise(prefix(F.col("i") + 1)).alias("upto"),
        )
        known = levels[level].join(inner, ["conv_id", "block"])
    return known


# -- trie -----------------------------------------------------------------------------


def _along(past: Column, items: Column, upto: Column) -> Column:
    """Node digests after each turn of a block; a full block ends at ``upto``."""
    chained = F.aggregate(
        F.transform(items, lambda x: x["turn_digest"]),
        F.array(past),
        lambda got, turn: F.concat(got, F.array(_digest(F.lit("turn"), F.element_at(got, -1), turn))),
    )
    return F.when(
        F.size(items) == BLOCK, F.concat(F.slice(chained, 1, BLOCK), F.array(upto))
    ).otherwise(chained)


_EDGE = ("past", "block_digest")


def _edges(cut: DataFrame, **sums: Column) -> DataFrame:
    """One row per distinct block after a distinct past."""
    return cut.groupBy(*_EDGE).agg(
        F.first("block").alias("block"),
        F.first("upto").alias("upto"),
        F.first("items").alias("items"),
        *[value.alias(name) for name, value in sums.items()],
    )


def _refined(edges: DataFrame, diverging: DataFrame, **merge) -> DataFrame:
    """Nodes of edges. Where one past has several edges, equal turns are merged with
    the aggregates in ``merge``; elsewhere each turn takes its edge's values."""
    path = _along(F.col("past"), F.col("items"), F.col("upto"))
    opened = (
        edges.join(diverging, "past", "left")
        .select("*", path.alias("path"))
        .select("*", F.posexplode("items").alias("i", "turn"))
        .select(
            F.element_at("path", F.col("i") + 2).alias("node"),
            F.element_at("path", F.col("i") + 1).alias("parent"),
            (F.col("block") * BLOCK + F.col("i") + 1).alias("depth"),
            F.col("turn.n_words").alias("n_words"),
            *merge,
            F.col("branches").isNotNull().alias("diverges"),
        )
    )
    alone = opened.filter(~F.col("diverges")).drop("diverges")
    merged = (
        opened.filter("diverges")
        .groupBy("node")
        .agg(
            *[F.first(c).alias(c) for c in ("parent", "depth", "n_words")],
            *[how(name).alias(name) for name, how in merge.items()],
        )
    )
    return alone.unionByName(merged)


def trie(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given by turns and lengths.

    Columns: ``node`` and ``parent`` (digests; the root's parent is null),
    ``depth``, ``conv_id`` (smallest member), ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    df = written(df, "conversation-turns")
    lengths = written(lengths, "conversation-lengths")
    longest, n_convs, smallest = lengths.agg(
        F.coalesce(F.max("n_turns"), F.lit(0)), F.count(F.lit(1)), F.min("conv_id")
    ).first()
    spark = df.sparkSession
    cut = written(blocks(df, longest), "conversation-paths")
    edges = written(
        _edges(cut, n_convs=F.count(F.lit(1)), conv_id=F.min("conv_id")), "conversation-edges"
    )
    diverging = (
        edges.groupBy("past").agg(F.count(F.lit(1)).alias("branches")).filter(F.col("branches") > 1)
    )
    inner = _refined(edges, diverging, n_convs=F.sum, conv_id=F.min)
    root = spark.range(1 if n_convs else 0).select(
        _root().alias("node"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(n_convs).cast("long").alias("n_convs"),
        F.lit(smallest).cast("long").alias("conv_id"),
    )
    nodes = written(inner.unionByName(root), "conversation-nodes")

    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    booked = (F.col("n_convs") - 1) * F.col("n_words")
    nodes = written(
        nodes.join(children, "node", "left")
        .join(parents, "parent", "left")
        .withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "booked": booked}),
        "conversation-nodes",
    )

    # What each conversation books on the nodes whose smallest member it is.
    books = nodes.groupBy("conv_id").agg(
        F.sum("booked").alias("tokens"),
        F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
    )
    weighed = cut.join(books, "conv_id", "left")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    sums = _refined(
        _edges(weighed, tokens=zero("tokens"), leaves=zero("leaves")), diverging, tokens=F.sum, leaves=F.sum
    ).select("node", "tokens", "leaves")
    whole = books.agg(zero("tokens").alias("tokens"), zero("leaves").alias("leaves")).select(
        _root().alias("node"), "tokens", "leaves"
    )
    above = running_before(nodes, F.col("booked"), ["depth"], ["conv_id"], "above")
    out = above.join(sums.unionByName(whole), "node").join(_ends(cut, lengths), "node", "left")
    return out.select(
        "node",
        "parent",
        "depth",
        "conv_id",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("tokens") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


# -- members that end at a node -------------------------------------------------------


def _join_ids(batches):
    """Sorted ``(node, conv_id)`` rows to ``(node, first, piece)`` with bounded pieces."""
    node, first, ids, chars = None, None, [], 0
    done: list[tuple] = []

    def batch():
        out = pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))],
            names=["node", "first", "piece"],
        )
        done.clear()
        return out

    held = 0
    for rows in batches:
        for key, conv in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if key != node or chars > PIECE_CHARS:
                if ids:
                    done.append((node, first, ",".join(ids)))
                    held += chars
                node, first, ids, chars = key, conv, [], 0
            ids.append(str(conv))
            chars += len(ids[-1]) + 1
            if held > 1 << 22:
                held = 0
                yield batch()
    if ids:
        done.append((node, first, ",".join(ids)))
    yield batch()


def _hash_pieces(batches):
    """Sorted ``(node, first, piece)`` rows to one digest per node, hashed in a stream."""
    import hashlib

    node, state = None, None
    for rows in batches:
        out: list[tuple[str, str]] = []
        for key, piece in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist()):
            if key == node:
                state.update(b"," + piece.encode())
                continue
            if state is not None:
                out.append((node, state.hexdigest()))
            node, state = key, hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["node", "ends_sha256"]
        )
    if state is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([node], pa.string()), pa.array([state.hexdigest()], pa.string())],
            names=["node", "ends_sha256"],
        )


def _ends(cut: DataFrame, lengths: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of nodes at which a conversation ends."""
    path = _along(F.col("past"), F.col("items"), F.col("upto"))
    last = (
        cut.join(lengths.filter(F.col("n_turns") > 0), "conv_id")
        .filter(F.col("block") == F.floor((F.col("n_turns") - 1) / BLOCK))
        .select(F.element_at(path, -1).alias("node"), "conv_id")
    )
    turnless = lengths.filter(F.col("n_turns") == 0).select(_root().alias("node"), "conv_id")
    count = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (
        last.unionByName(turnless)
        .repartitionByRange(count, "node", "conv_id")
        .sortWithinPartitions("node", "conv_id")
        .mapInArrow(_join_ids, "node string, first long, piece string")
    )
    return (
        pieces.repartition("node")
        .sortWithinPartitions("node", "first")
        .mapInArrow(_hash_pieces, "node string, ends_sha256 string")
    )


def digest(df: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, without the digests that name them."""
    return trie(*rebuild(written(turns(df), "conversation-order"))).drop("node", "parent")
