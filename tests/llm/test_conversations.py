"""Prefix trie of conversations against a trie built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from papersieve.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def words(text):
    return len(text.encode().split())


def plain_trie(rebuilt):
    """``rebuilt``: conv_id to its turns."""
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * words(p[-1][1]) if p else 0)
        if p:
            up = p[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append(
            (
                min(m),
                len(p),
                min(members[p[:-1]]) if p else None,
                len(m),
                kids.get(p, 0),
                leaves[p],
                saved[p],
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out)


def plain_rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(donor, [])[:h] + ts[h:]
    return out


def got_rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_rows(conversations.digest(df)) == plain_trie(plain_rebuild(rows))


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got_rows(conversations.digest(df)) == plain_trie(plain_rebuild(rows))


def test_long_conversations_that_diverge_anywhere(spark):
    r = random.Random(2)
    base = [("u" if i % 2 else "a", f"word {r.randrange(3)} " * r.randint(0, 3)) for i in range(700)]
    rows = []
    for c in range(60):
        cut = r.choice([0, 1, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 127, 128, 511, 512, 600, 700])
        seq = base[:cut] + [("u", f"own {r.randrange(2)}")] * r.choice([0, 0, 1, 8, 70])
        if c % 7 == 0:
            seq = base[: r.choice([8, 16, 64, 512])]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(seq)]
    r.shuffle(rows)
    check(spark, rows)


def test_edge_rows(spark):
    rows = [
        (None, 0, "u", "no conversation"),
        (20, None, None, "null first"),
        (20, 1, "u", None),
        (20, 1, "u", None),
        (20, 1, None, None),
        (21, 0, "u", "a"),
        (22, 0, "", ""),
        (-3, 5, "u", "negative id"),
        (-3, 5, "a", "tie"),
        (47, 0, "u", "donor is absent"),
        (2**60 + 1, 0, "u", "large id"),
        (63, -4, "a b", "c"),
        (64, -4, "a", " bc"),
        (65, -4, "x", "long " * 50_000),
    ]
    check(spark, rows)
    check(spark, [(7, 0, "u", "x")])


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.digest(df).collect() == []
    rows = [(c, t, "u", f"{t}") for c in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit(1) for c in ("at", "n_words", "past", "items", "node", "block", "depth")}
    )
    assert got_rows(conversations.digest(df)) == plain_trie(plain_rebuild(rows))


@pytest.mark.parametrize("piece", [10, 1 << 16])
def test_members_are_joined_over_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE_CHARS", piece)
    rows = [(c * 20, t, "u", f"same {t}") for c in range(300) for t in range(3)]
    check(spark, rows)


def test_operator_takes_conversations_as_they_are(spark):
    df = spark.createDataFrame(
        [(1, 0, "u", "hi"), (1, 1, "a", "yes"), (2, 0, "u", "hi"), (2, 1, "a", "no")], SCHEMA
    )
    turns = conversations.turns(df)
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    nodes = conversations.trie(turns, lengths)
    assert got_rows(nodes) == plain_trie({1: [("u", "hi"), ("a", "yes")], 2: [("u", "hi"), ("a", "no")]})
    ids = {r.node for r in nodes.collect()}
    assert all(r.parent in ids for r in nodes.collect() if r.parent is not None)
