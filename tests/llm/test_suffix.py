"""Repeated passages against a dictionary of all 50-byte strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from papersieve.llm import suffix

SF = "/root/testdata/sf0.001"


def expected(rows):
    first: dict[bytes, int] = {}
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for key, raw in data:
        for k in range(len(raw) - suffix.MATCH + 1):
            s = raw[k : k + suffix.MATCH]
            first[s] = min(first.get(s, float("inf")), key)
    out = []
    for (i, _), (key, raw) in zip(rows, data):
        gone = bytearray(len(raw))
        for k in range(len(raw) - suffix.MATCH + 1):
            if first[raw[k : k + suffix.MATCH]] < key:
                gone[k : k + suffix.MATCH] = b"\1" * suffix.MATCH
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in suffix.digest(df, **options).collect()), key=repr)


def fixture_rows():
    draw = random.Random(7)
    words = ["alpha", "béta", "gamma", "delta", "épsilon", "zeta", "eta", "漢字", "\n", "x"]

    def prose(n):
        return " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(n))

    shared = [prose(25) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [prose(draw.randrange(0, 60))]
        for s in shared:
            if draw.random() < 0.4:
                at = draw.randrange(0, max(1, len(s) - 40))
                parts += [s[at:], prose(draw.randrange(1, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1][:40] + "!" + rows[3][1][41:]), (202, "ab" * 400)]
    rows += [(203, "ab" * 300), (204, None), (205, ""), (206, "short"), (None, rows[5][1])]
    # The same row twice, and one id with two texts.
    rows += [rows[8], rows[8], (5, rows[9][1]), (210, "\0" * 120), (211, "\0" * 80)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("unit_bytes,hot_units", [(4 << 20, 256), (3_000, 256), (3_000, 2)])
def test_against_all_strings(spark, monkeypatch, unit_bytes, hot_units):
    monkeypatch.setattr(suffix, "UNIT_BYTES", unit_bytes)
    monkeypatch.setattr(suffix, "PART_BYTES", 20_000)
    rows = fixture_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, hot_units=hot_units) == expected(rows)


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert found(df) == expected([tuple(r) for r in df.collect()])


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.digest(empty).collect() == []
    rows = [(1, "x" * 90, 7, 8), (2, "y" + "x" * 90, 9, None), (3, None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, unit int, `Data` int")
    out = sorted(tuple(r) for r in suffix.without_repeats(df).collect())
    assert out == [(1, "x" * 90, 7, 8), (2, "y", 9, None), (3, None, 1, 1)]


def test_cut_characters_go_whole(spark):
    passage = "漢" * 30
    df = spark.createDataFrame([(1, "é" + passage), (2, "è" + passage + "é")], "doc_id long, text string")
    out = dict(tuple(r) for r in suffix.without_repeats(df).collect())
    assert out == {1: "é" + passage, 2: "èé"}


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_interleave_gives_common_prefixes(shards):
    rng = np.random.default_rng(shards)
    strings = [rng.integers(1, 3, rng.integers(1, 30)) for _ in range(40)]
    transforms, suffixes = [], []
    for s in range(shards):
        mine = strings[s::shards]
        text = np.concatenate([np.r_[x, 0] for x in mine])
        ends = np.cumsum([len(x) + 1 for x in mine]) - 1
        order, transform = suffix.shard_transform(text, ends)
        transforms.append(transform)
        end_of = ends[np.searchsorted(ends, order)]
        suffixes += [tuple(text[a:b].tolist()) for a, b in zip(order, end_of)]
    place, heads, prefix = suffix.merge_transforms(transforms, 6)
    merged = [suffixes[i][:6] for i in place]
    assert merged == sorted(merged)
    starts = set(heads.tolist())
    for i in range(1, len(merged)):
        a, b = suffixes[place[i - 1]], suffixes[place[i]]
        common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix[i] == min(common, 6)
        assert (i in starts) == (common < 6)
