"""Runs of words against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from papersieve.llm import periodic

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_digest(doc_id, text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id,
        len(runs),
        *top,
        1000 * top[1] // top[2] if runs else None,
        hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def some_words(r: random.Random) -> list[bytes]:
    n, letters, words = r.choice([0, 1, 5, 12, 13, 25, 60, 150, 300]), r.choice([1, 2, 3, 6]), []
    while len(words) < n:
        if words and r.random() < 0.3:
            p = r.randint(1, min(len(words), r.choice([3, 10, 60])))
            for _ in range(r.randint(1, 3 * p)):
                words.append(words[-p])
        else:
            words.append(b"%d" % r.randrange(letters))
    return words[:n]


@pytest.mark.parametrize("least", [5, 7, 12, 30])
def test_runs_match_brute_force(least):
    r = random.Random(least)
    for _ in range(400):
        words = some_words(r)
        assert periodic.runs_of(words, least) == plain_runs(words, least)


def test_runs_are_right_after_every_word():
    r = random.Random(5)
    for _ in range(20):
        words, catcher = some_words(r)[:70], periodic.RunCatcher()
        for i, word in enumerate(words):
            catcher.extend([word])
            assert catcher.runs() == plain_runs(words[: i + 1])


def test_words_made_to_have_many_squares():
    a, b = [b"a"], [b"b"]
    while len(a) < 600:
        a, b = a + b, a
    assert periodic.runs_of(a) == plain_runs(a)
    two = [b"a"] * 300 + [b"b"] + [b"a"] * 300
    assert periodic.runs_of(two) == plain_runs(two)


def test_long_repetition_is_one_run():
    words = [b"%d" % (i % 5_000) for i in range(40_000)]
    assert periodic.runs_of(words) == [(0, 40_000, 5_000)]
    assert periodic.runs_of([b"x"] * 50_000) == [(0, 50_000, 1)]
    assert periodic.collapsed(words, [(0, 40_000, 5_000)]).split() == words[:5_000]


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        periodic.RunCatcher(4)


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(plain_digest(r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r) for r in periodic.digest(docs).collect()) == want
    assert sum(1 for w in want if w[1]) > 3


def test_edge_rows(spark):
    rows = [
        (None, "a b " * 40, "x", 1.0),
        (1, None, None, None),
        (2, "", "x", 2.0),
        (3, " \n\t\x0b\x0c\r ", "x", 2.0),
        (4, "a b\x1cb " * 15, "x", 2.0),
        (5, "ä ß " * 3 + "ä", "x", 2.0),
        (5, "ä ß " * 3 + "ä", "x", 2.0),
        (6, "w " * 12, "x", 2.0),
        (7, "w " * 11, "x", 2.0),
        (8, "one two three " * 30_000, "x", 2.0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed double")
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted((tuple(r) for r in periodic.digest(docs).collect()), key=key)
    cut = [(i, t if i != 8 else "one two three " * 40) for i, t, *_ in rows]
    want = sorted((plain_digest(i, t) for i, t in cut), key=key)
    assert got[:-1] == want[:-1]
    assert got[-1][1:6] == (1, 0, 90_000, 3, 30_000_000)
    assert periodic.digest(docs.limit(0)).collect() == []


def test_own_interface_gives_runs_and_text(spark):
    docs = spark.createDataFrame([(9, "go " * 12 + "on")], "doc_id long, text string")
    row = periodic.find_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 12, 1)] and row.collapsed == "go on" and row.n_words == 13
    assert [tuple(r) for r in periodic.find_runs(docs, least_words=13).first().runs] == []
