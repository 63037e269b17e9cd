"""Order of trees given as edges, by pointer doubling.

A tree of pages or names is a chain of references of any depth, and following it
level by level would take as many steps as it is deep. Here every node holds a
pointer to an ancestor, and each round replaces it by the ancestor's own pointer,
so that the distance doubles: the rounds grow with the logarithm of the depth.

The rounds carry two sums along. Going up, a node gathers how many nodes are below
it; going down, it gathers how many come before it: its earlier siblings' subtrees
and whatever comes before its parent. That is its place in depth-first order.

Files may list a node twice or in a cycle. Each node keeps one parent, the one
with the smallest name from which it can be reached, so a cycle ends where it began.

Edges are shuffled once, by document, and the rounds run over arrays of whole documents,
``BLOCK_ROWS`` edges or so at a time. What a task holds follows its largest document;
documents of more than ``MOST_EDGES`` edges take the same rounds as joins on ``(doc_id,
tree, node)`` over one row per node, which spread a single tree over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papersieve.session import staged, unbroadcast

GROUP = ("doc_id", "tree")
# Stands above the roots of every tree.
TOP = ""
# Rounds before the first look at what is left; they settle trees of up to 2 ** rounds - 1 levels.
FIRST_ROUNDS = 2
# How often nodes may be hung below another parent before a document is given up.
MOST_REPAIRS = 64
# Edges of a document that one task still holds, and edges that are ordered at a time.
MOST_EDGES = 1_000_000
BLOCK_ROWS = 1 << 17
PLACED = "doc_id bigint, tree string, node string, place int"
_PLACED = pa.schema([("doc_id", pa.int64()), ("tree", pa.string()), ("node", pa.string()), ("place", pa.int32())])


def _chosen(edges: DataFrame) -> DataFrame:
    """``node, parent, slot`` of each child by the edge from the smallest parent."""
    return (
        edges.groupBy(*GROUP, "child")
        .agg(F.min(F.struct(F.length("node").alias("n"), F.col("node").alias("parent"), "slot")).alias("e"))
        .select(*GROUP, F.col("child").alias("node"), "e.parent", "e.slot")
    )


def _one_parent(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, parent, slot`` with one parent per node and a row for the top."""
    first = roots.groupBy(*GROUP, "node").agg(F.min("slot").alias("slot"))
    below = _chosen(edges.where(F.col("node") != F.col("child"))).join(
        unbroadcast(first), [*GROUP, "node"], "left_anti"
    )
    tops = roots.select(*GROUP).distinct()
    return (
        first.withColumn("parent", F.lit(TOP))
        .unionByName(below)
        .unionByName(
            tops.select(
                *GROUP, F.lit(TOP).alias("node"), F.lit(None).cast("string").alias("parent"),
                F.lit(0).alias("slot"),
            ),
        )
    )


def _up(state: DataFrame) -> DataFrame:
    """One doubling of ``jump``; ``far`` is the farthest ancestor known, ``size`` the
    nodes found below so far, the node itself included."""
    above = state.select(
        *GROUP, F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("far").alias("_far")
    )
    below = (
        state.where("jump IS NOT NULL")
        .groupBy(*GROUP, F.col("jump").alias("node"))
        .agg(F.sum("size").alias("_below"))
    )
    return (
        state.join(unbroadcast(above), [*GROUP, "jump"], "left")
        .join(unbroadcast(below), [*GROUP, "node"], "left")
        .select(
            *GROUP, "node", "parent", "slot",
            F.col("_jump").alias("jump"),
            F.coalesce("_far", "far").alias("far"),
            (F.col("size") + F.coalesce("_below", F.lit(0))).alias("size"),
        )
    )


def _down(state: DataFrame) -> DataFrame:
    """One doubling of ``jump`` with the sum of ``total`` along the way."""
    above = state.select(
        *GROUP, F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("total").alias("_total")
    )
    return state.join(unbroadcast(above), [*GROUP, "jump"], "left").select(
        *GROUP, "node", F.col("_jump").alias("jump"),
        (F.col("total") + F.coalesce("_total", F.lit(0))).alias("total"),
    )


def _resolved(parents: DataFrame) -> tuple[DataFrame, int]:
    """Every node with ``far`` and ``size`` settled, and the rounds that took."""
    state = parents.withColumns(
        {"jump": F.col("parent"), "far": F.col("node"), "size": F.lit(1).cast("long")}
    )
    # Each round names its input three times, so rounds in one plan would multiply it.
    for _ in range(FIRST_ROUNDS):
        state = staged(_up(state))
    rounds = FIRST_ROUNDS
    left = state.where("jump IS NOT NULL").count()
    while left:
        state = staged(_up(state))
        rounds += 1
        still = state.where("jump IS NOT NULL").count()
        if still == left:
            break  # What is left runs in circles: no node was settled in this round.
        left = still
    return state, rounds


def _chosen_rows(child: np.ndarray, rank: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Of rows with the same child the one from the smallest parent, as row numbers."""
    order = np.lexsort((slot, rank, child))
    first = np.ones(len(order), bool)
    first[1:] = child[order[1:]] != child[order[:-1]]
    return order[first]


def _ends(parent: np.ndarray) -> np.ndarray:
    """The farthest ancestor of each node; those on a circle end anywhere on it."""
    far = parent
    for _ in range(len(parent).bit_length()):
        further = far[far]
        if np.array_equal(further, far):
            break
        far = further
    return far


def _sums_below(parent: np.ndarray) -> np.ndarray:
    """Nodes below each, itself included; parent ``len(parent)`` ends a chain."""
    n = len(parent)
    jump, size = np.append(parent, n), np.append(np.ones(n), 0)
    while (jump != n).any():
        below = np.bincount(jump, size, n + 1)
        below[n] = 0
        size += below
        jump = jump[jump]
    return size[:n].astype(np.int64)


def _sums_above(parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum of ``own`` from each node to the end of its chain."""
    n = len(parent)
    jump, total = np.append(parent, n), np.append(own, 0)
    while (jump != n).any():
        total = total + total[jump]
        jump = jump[jump]
    return total[:n]


def _ordered(block: pa.Table, repairs: int) -> pa.RecordBatch:
    """Places of the nodes of whole documents; a row without a place names a document
    that was given up."""
    n = block.num_rows
    tree = block["tree"].combine_chunks().dictionary_encode()
    doc = block["doc_id"].to_numpy()
    docs, doc_at = np.unique(doc, return_inverse=True)
    group = doc_at * len(tree.dictionary) + tree.indices.to_numpy()
    names = pa.chunked_array([*block["node"].chunks, *block["child"].chunks], pa.string())
    names = names.combine_chunks().dictionary_encode()
    values = names.dictionary
    codes = names.indices.to_numpy().astype(np.int64)
    # Spark compares names by their bytes.
    raw = pa.table({"n": pc.utf8_length(values), "raw": values.cast(pa.binary())})
    by_bytes, by_size = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    by_bytes[pc.sort_indices(raw, [("raw", "ascending")]).to_numpy()] = np.arange(len(values))
    by_size[pc.sort_indices(raw, [("n", "ascending"), ("raw", "ascending")]).to_numpy()] = np.arange(len(values))
    keys, ids = np.unique(np.concatenate([group, group]) * len(values) + codes, return_inverse=True)
    code = keys % len(values)
    above, below = ids[:n], ids[n:]
    top = by_bytes[code] == 0 if pc.min(raw["n"]).as_py() == 0 else np.zeros(len(keys), bool)
    slot = pc.fill_null(block["slot"], -(2**31)).to_numpy().astype(np.int64)

    from_top = top[above]
    roots = np.flatnonzero(from_top)
    known = np.flatnonzero(~from_top & (above != below))
    rank = by_size[code[above]]
    parent, place = np.arange(len(keys)), np.zeros(len(keys), np.int64)

    def hang(rows: np.ndarray) -> None:
        taken = rows[_chosen_rows(below[rows], rank[rows], slot[rows])]
        parent[below[taken]], place[below[taken]] = above[taken], slot[taken]

    hang(known)
    hang(roots)
    for attempt in range(repairs + 1):
        reached = top[_ends(parent)]
        lost = known[reached[above[known]] & ~reached[below[known]]]
        if attempt == repairs or not len(lost):
            break
        # Some node chose a parent that is not part of the tree: take one that is.
        hang(lost)

    kept = np.flatnonzero(reached)
    new = np.full(len(keys), len(kept))
    new[kept] = np.arange(len(kept))
    is_top = top[kept]
    up = np.where(is_top, len(kept), new[parent[kept]])
    size = _sums_below(up)
    order = np.lexsort((by_bytes[code[kept]], place[kept], up))
    before = np.cumsum(size[order]) - size[order]
    starts = np.ones(len(order), bool)
    starts[1:] = up[order[1:]] != up[order[:-1]]
    # Places go up within siblings, so that the latest start is the largest so far.
    earlier = np.empty_like(before)
    earlier[order] = before - np.maximum.accumulate(np.where(starts, before, 0))
    # The top comes before the first place.
    total = _sums_above(up, np.where(is_top, -1, earlier + 1))

    shown = np.flatnonzero(~is_top)
    trees = keys[kept[shown]] // len(values)
    gone = np.unique(doc[lost])
    empty = pa.nulls(len(gone))
    columns = [
        pa.array(np.concatenate([docs[trees // len(tree.dictionary)], gone])),
        pa.concat_arrays([tree.dictionary.take(pa.array(trees % len(tree.dictionary))), empty.cast(pa.string())]),
        pa.concat_arrays([values.take(pa.array(code[kept[shown]])), empty.cast(pa.string())]),
        pa.concat_arrays([pa.array(total[shown].astype(np.int32)), empty.cast(pa.int32())]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_PLACED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole documents, from batches in the order of ``doc_id``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        doc = batch.column("doc_id").to_numpy()
        # What the last document has so far waits for the rest of it.
        cut = int(np.searchsorted(doc, doc[-1]))
        if not cut and held[0].column("doc_id")[0].as_py() == doc[-1]:
            continue
        whole = pa.Table.from_batches(held)
        if cut:
            split = rows - batch.num_rows + cut
        else:
            split = int(np.searchsorted(whole["doc_id"].to_numpy(), doc[-1]))
        yield whole.slice(0, split)
        held = whole.slice(split).to_batches()
        rows -= split
    if held:
        yield pa.Table.from_batches(held)


def _preorder_held(rows: DataFrame, repairs: int) -> DataFrame:
    """``PLACED`` rows of edges and roots, by whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _ordered(block, repairs)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, PLACED)


def preorder(edges: DataFrame, roots: DataFrame, repairs: int = MOST_REPAIRS) -> tuple[DataFrame, DataFrame]:
    """Nodes reachable from the roots with their place in depth-first order.

    ``edges(doc_id, tree, node, slot, child)`` and ``roots(doc_id, tree, node,
    slot)``. Returns ``(doc_id, tree, node, place)`` and ``doc_id`` of documents in
    which some reachable node was left out because its parents had to be chosen
    anew more than ``repairs`` times; sound files need none.
    """
    # One table: a root is a child of the top.
    tops = roots.select(*GROUP, F.lit(TOP).alias("node"), F.col("slot"), F.col("node").alias("child"))
    grown = unbroadcast(roots.select(*GROUP).distinct())
    given = staged(edges.join(grown, list(GROUP), "left_semi").unionByName(tops.select(*edges.columns)))
    given = given.where("doc_id IS NOT NULL AND tree IS NOT NULL AND node IS NOT NULL AND child IS NOT NULL")
    large = given.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES).select("doc_id")
    large = staged(large, broadcasts=True)
    if large.isEmpty():
        return _told(_preorder_held(given, repairs))
    held = _told(_preorder_held(given.join(large, "doc_id", "left_anti"), repairs))
    spread = _preorder_spread(staged(given.join(large, "doc_id", "left_semi")), repairs)
    placed, lost = (a.unionByName(b) for a, b in zip(held, spread))
    return unbroadcast(placed), lost


def _told(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placed nodes, and the documents that were given up."""
    done = staged(done)
    return done.where("place IS NOT NULL"), done.where("place IS NULL").select("doc_id").distinct()


def _preorder_spread(given: DataFrame, repairs: int) -> tuple[DataFrame, DataFrame]:
    """The same by joins, for documents of any number of edges."""
    known = given.where(F.col("node") != TOP)
    roots = given.where(F.col("node") == TOP).select(*GROUP, F.col("child").alias("node"), "slot")
    parents = staged(_one_parent(known, roots))
    for attempt in range(repairs + 1):
        state, rounds = _resolved(parents)
        reached = state.where(F.col("far") == TOP)
        lost = (
            known.join(reached.select(*GROUP, "node"), [*GROUP, "node"], "left_semi")
            .join(reached.select(*GROUP, F.col("node").alias("child")), [*GROUP, "child"], "left_anti")
        )
        if attempt == repairs or lost.isEmpty():
            break
        # Some node chose a parent that is not part of the tree: take one that is.
        better = _chosen(lost)
        parents = staged(
            state.select(*GROUP, "node", "parent", "slot")
            .join(better.select(*GROUP, "node"), [*GROUP, "node"], "left_anti")
            .unionByName(better)
        )
    siblings = Window.partitionBy(*GROUP, "parent").orderBy("slot", "node")
    earlier = F.coalesce(
        F.sum("size").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    down = reached.select(
        *GROUP, "node", F.col("parent").alias("jump"),
        # The top comes before the first place.
        F.when(F.col("node") == TOP, F.lit(-1)).otherwise(earlier + 1).cast("long").alias("total"),
    )
    down = staged(down)
    for _ in range(rounds):
        down = staged(_down(down))
    placed = down.where(F.col("node") != TOP).select(*GROUP, "node", F.col("total").cast("int").alias("place"))
    return placed, lost.select("doc_id").distinct()


def labelled(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of several trees with the tree's name."""
    out = None
    for name, rows in frames:
        part = rows.withColumn("tree", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
