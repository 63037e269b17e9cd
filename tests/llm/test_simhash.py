"""Fingerprints and components against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papersieve.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    values = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(rows):
    """``{(id, fingerprint): component}`` by flooding over all pairs."""
    prints = sorted({f for _, f in rows})
    group = {}
    for f in prints:
        if f in group:
            continue
        group[f], queue = f, [f]
        while queue:
            x = queue.pop()
            for y in prints:
                if y not in group and bin(x ^ y).count("1") <= simhash.BUDGET:
                    group[y] = f
                    queue.append(y)
    least = {}
    for i, f in rows:
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    return {(i, f): least.get(group[f]) for i, f in rows}


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in plain_components(rows).items())
    assert sorted(tuple(r) for r in simhash.digest(df).collect()) == want


def test_edge_rows(spark):
    rows = [
        (4, None), (3, ""), (9, " \t\n\x0b\f\r "), (5, "one"), (6, "ONE"), (7, "One two"),
        (7, "One two"), (None, "one"), (8, "É x y"), (10, "é x y"), (11, "a b c " * 60_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    component = plain_components(prints)
    want = sorted(((i, f"{f:016x}", component[i, f]) for i, f in prints), key=repr)
    assert sorted((tuple(r) for r in simhash.digest(df).collect()), key=repr) == want
    assert simhash.digest(df.limit(0)).collect() == []


def test_filter_loses_no_link_and_cut_buckets_agree(spark):
    draw = random.Random(3)
    seeds = [draw.getrandbits(64) for _ in range(6)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(60):
            prints.add(s ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(1, 4))}))
    # A crowded bucket: one key, differences in a few low bits.
    prints |= {seeds[0] ^ draw.getrandbits(10) for _ in range(300)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    want = plain_components([(p, p) for p in prints])
    for limit in (simhash.BUCKET_ROWS, 16):
        links = simhash.candidate_links(df, limit)
        for r in links.collect():
            assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= simhash.BUDGET
        root = {r.node % (1 << 64): r.root for r in simhash.components(links).collect()}
        found = {}
        for p in prints:
            found.setdefault(root.get(p, simhash._signed(p)), set()).add(p)
        wanted = {}
        for (p, _), c in want.items():
            wanted.setdefault(c, set()).add(p)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_every_pair_in_budget_has_a_chain():
    rng = np.random.default_rng(5)
    for _ in range(500):
        bits = rng.choice(64, rng.integers(0, 3), replace=False)
        diff = np.array([sum(1 << int(b) for b in bits)], dtype=np.uint64)
        starts = [s for s in range(simhash.SEGMENTS) if simhash.chain_ok(diff, s)[0]]
        assert any(int(diff[0]) & simhash.chain_keys()[s] == 0 for s in starts)


def test_long_chain_is_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = simhash.components(links).collect()
    assert len(roots) == 301 and {r.root for r in roots} == {0}


def test_keep_first(spark):
    rows = [
        (1, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (3, "e f g h", "z"),
        (3, "e f g h", "z"), (None, "q r s", "n"), (None, "q r s", "n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _rank string")
    kept = sorted((tuple(r) for r in simhash.keep_first(df).collect()), key=repr)
    assert kept == sorted([rows[0], rows[3], rows[5], rows[6]], key=repr)


@pytest.mark.parametrize("exact", [True, False])
def test_keep_first_drops_planted_near_copies(spark, exact):
    """Jaccard 0.8 or more over five-word shingles goes, anything below stays."""
    draw = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    texts = []
    for n, changes in ((100, (1,)), (200, (3,)), (500, (10, 12)), (60, (2, 3)), (40, (1,))):
        base = [f"w{draw.randrange(10**6)}" for _ in range(n)] + common
        texts.append(base)
        for count in changes:
            for _ in range(6):
                copy = list(base)
                for at in draw.sample(range(n), count):
                    copy[at] = f"x{draw.randrange(10**6)}"
                texts.append(copy)
    chain = [f"k{i}" for i in range(100)]
    texts += [chain, chain[8:] + [f"l{i}" for i in range(8)], chain[16:] + [f"l{i}" for i in range(16)]]
    texts += [["a", "B"], ["A", "b"], ["a", "c"], common]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in ([x.lower() for x in t] for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    want = sorted(set(group))
    assert len(want) < len(texts) - 12
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_first(df, exact=exact).collect()) == want


def test_recall_against_all_pairs(spark):
    """At least nine in ten similar pairs end in one component, with nothing else in it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    found = {r.doc_id: r.component_id for r in simhash.near_texts(docs).collect()}
    joined = [i for i, c in exact.items() if c != i]
    assert set(found) == set(exact) and len(joined) > 50
    assert sum(found[i] == exact[i] for i in joined) >= 0.97 * len(joined)
    # No component of the fingerprints reaches beyond one of the exact pairs.
    assert all(exact[found[i]] == exact[i] for i in found)


def test_ring_in_columns_and_in_numpy_agree(spark):
    draw = np.random.default_rng(6)
    a = draw.integers(0, 1 << 64, (400, simhash.WIDE), dtype=np.uint64)
    flips = np.packbits(draw.random((400, 256)) < draw.random((400, 1)) * 0.45, axis=1).view(np.uint64)
    b = a ^ flips
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()))]
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").withColumn(
        "s", F.array(*simhash.ring_differences(F.col("a"), F.col("b")))
    )
    got = {r.i: (list(r.s), r.ok) for r in df.select("i", "s", simhash.ring_passes(F.col("s")).alias("ok")).collect()}
    passed = 0
    for i in range(400):
        segments = np.bitwise_count((a[i] ^ b[i]).view("u4")).astype(int)
        want = bool(segments.sum() <= simhash.WIDE_BUDGET and simhash.wide_chain(segments))
        assert got[i] == (segments.tolist(), want)
        # The principle: whoever is within budget in all has such a chain.
        assert want == (segments.sum() <= simhash.WIDE_BUDGET)
        passed += want
    assert 50 < passed < 350


def test_near_texts_edges(spark):
    rows = [(5, "one two"), (4, "one two"), (None, "one two"), (7, None), (6, ""), (5, "x " * 50_000), (3, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r.doc_id: r.component_id for r in simhash.near_texts(df).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 6: 6, 7: 6}
    assert simhash.near_texts(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        simhash.near_texts(df, similarity=0.3)
