"""Depth-first places by pointer doubling, against a walk with a stack."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from documents import deep_pages

from papersieve.operators import objects as og
from papersieve.operators import trees
from papersieve.operators.trees import preorder

EDGES = "doc_id bigint, tree string, node string, slot int, child string"
ROOTS = "doc_id bigint, tree string, node string, slot int"


def places(spark, edges, roots, **given):
    placed, lost = preorder(spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, ROOTS), **given)
    return {(r.doc_id, r.tree, r.node): r.place for r in placed.collect()}, {r.doc_id for r in lost.collect()}


def walked(edges, roots):
    """Places in forests in which every node has one parent."""
    kids = {}
    for doc, tree, node, slot, child in edges:
        kids.setdefault((doc, tree, node), []).append((slot, child))
    out, groups = {}, {}
    for doc, tree, node, slot in roots:
        groups.setdefault((doc, tree), []).append((slot, node))
    for (doc, tree), first in groups.items():
        stack, n = [node for _, node in sorted(first)][::-1], 0
        while stack:
            node = stack.pop()
            out[doc, tree, node] = n
            n += 1
            stack += [c for _, c in sorted(kids.get((doc, tree, node), []))][::-1]
    return out


def test_random_forests(spark):
    r = random.Random(4)
    edges, roots = [], []
    for doc in range(40):
        names = [str(x) for x in r.sample(range(1, 900), r.randint(1, 60))]
        tops = names[: r.randint(1, 3)]
        roots += [(doc, "t", n, i) for i, n in enumerate(tops)]
        for i, n in enumerate(names[len(tops) :], len(tops)):
            # Long chains in some, bushes in others.
            parent = names[i - 1] if doc % 3 == 0 else names[r.randrange(i)]
            edges.append((doc, "t", parent, i, n))
        # A part that no root reaches, and one that runs in a circle.
        edges += [(doc, "t", "x1", 0, "x2"), (doc, "t", "y1", 0, "y2"), (doc, "t", "y2", 0, "y1")]
    assert places(spark, edges, roots) == (walked(edges, roots), set())


def test_a_tree_is_kept_apart_from_others(spark):
    edges = [(1, t, "1", i, c) for t in ("a", "b") for i, c in enumerate(["2", "3"])]
    roots = [(1, "a", "1", 0), (1, "b", "3", 0)]
    assert places(spark, edges, roots)[0] == {(1, "a", "1"): 0, (1, "a", "2"): 1, (1, "a", "3"): 2, (1, "b", "3"): 0}


def test_false_parents_hide_nothing(spark):
    """Every node of a chain is also named by a smaller node outside of the tree."""
    chain = [str(100 + i) for i in range(12)]
    edges = [(1, "t", a, 0, b) for a, b in zip(chain, chain[1:])]
    edges += [(1, "t", str(1 + i), 0, n) for i, n in enumerate(chain)]
    roots = [(1, "t", "100", 0), (2, "t", "7", 0)]
    got, lost = places(spark, edges, roots)
    assert got == {(1, "t", n): i for i, n in enumerate(chain)} | {(2, "t", "7"): 0} and lost == set()
    got, lost = places(spark, edges, roots, repairs=3)
    assert lost == {1} and len(got) == 5


def test_no_rows(spark):
    assert places(spark, [], []) == ({}, set())
    assert places(spark, [(1, "t", "a", 0, "b")], []) == ({}, set())


@pytest.mark.parametrize(("depth", "cycle"), [(1, False), (3, False), (3, True), (5_000, False)])
def test_page_trees_of_any_depth(spark, depth, cycle):
    files = spark.createDataFrame([(1, bytearray(deep_pages(depth, cycle)))], "doc_id bigint, content binary")
    w = og.walk(og.stage_entries(files))
    rows = w.trees.where("tree = 'pages'").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(depth + 1))
    assert rows[0].node == "2" and rows[-1].node == "10"
    assert [(r.node, r.page) for r in w.pages.collect()] == [("10", 0)] and w.cut_trees.isEmpty()


def test_every_way_gives_the_same(spark, monkeypatch):
    """Whole documents in blocks of any size, and joins for those of many edges, against each other."""
    r = random.Random(5)
    edges, roots = [], []
    for doc in range(30):
        names = [str(x) for x in r.sample(range(1, 2000), r.randint(2, 40))] + ["4/é", "4/zz"]
        for tree in ("a", "b"):
            roots += [(doc, tree, n, r.randrange(2)) for n in names[: r.randint(0, 2)]]
            # Nodes with several parents, in circles, below themselves and below nodes that no root reaches.
            edges += [(doc, tree, r.choice(names), r.randrange(3), r.choice(names)) for _ in range(r.randint(0, 45))]
    given = sorted(edges + [(d, t, trees.TOP, s, n) for d, t, n, s in roots], key=lambda e: e[0])
    placed, lost = trees._preorder_spread(spark.createDataFrame(given, EDGES), 2)
    want = {(x.doc_id, x.tree, x.node): x.place for x in placed.collect()}, {x.doc_id for x in lost.collect()}
    assert len(want[0]) > 100 and want[1]

    schema = pa.schema([("doc_id", pa.int64()), ("tree", pa.string()), ("node", pa.string()), ("slot", pa.int32()), ("child", pa.string())])
    whole = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*given), schema.types)], schema=schema)
    for block, batch in ((1, 1), (1, 7), (30, 7), (70, 200), (10**6, 50)):
        monkeypatch.setattr(trees, "BLOCK_ROWS", block)
        rows = [x for t in trees._blocks(iter(whole.to_batches(batch))) for x in trees._ordered(t, 2).to_pylist()]
        got = {(x["doc_id"], x["tree"], x["node"]): x["place"] for x in rows if x["place"] is not None}
        assert (got, {x["doc_id"] for x in rows if x["place"] is None}) == want and len(got) + len(want[1]) == len(rows)
    monkeypatch.setattr(trees, "MOST_EDGES", 40)
    assert places(spark, edges, roots, repairs=2) == want


def test_rounds_cost_no_jobs(spark):
    """A chain of any depth takes the same few jobs."""
    def jobs(depth):
        chain = [(1, "t", str(i), 0, str(i + 1)) for i in range(1, depth)]
        spark.sparkContext.setJobGroup(group := f"depth {depth}", group)
        got, _ = places(spark, chain, [(1, "t", "1", 0)])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sorted(got.values()) == list(range(depth))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2_000) == jobs(4) <= 20
