"""Token files, SentencePiece, WARC archives and neighbour search against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papersieve.llm import ann, huffman, warc, wfst
from papersieve.llm.catalog import PIECE_MODEL

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [
    "", None, " ", "  two  spaces ", "a\n \nb \n\n c", "tab\t x", " lead", "x" * 5_000, "<|endoftext|> and <| this",
    "naïve café 漢字 🎉🎉", "it's we'll  don't", "a b  c", "nul\0 byte", "end ", "▁ a▁b", "1234 567",
    "café's don't. ab1 a1b x_y ªº² a² µ .\nThe ,\n\nThe (x)[y] a\tb a\r\nb Ωmega aΩ é,Ω \x1cq -\nß",
]


@pytest.fixture(scope="module")
def model_json():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def pieces():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def with_odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(100_000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(100_003, ODD_TEXTS[3]), (None, "no id")]
    return docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))


def test_token_files(spark, model_json, tmp_path):
    df = with_odd(spark).withColumn("ids", F.lit("clash"))
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    tokenizer = Tokenizer.from_str(model_json)
    want, at = [], 0
    for i, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    huffman_path = str(tmp_path / "ids")
    huffman.write_ids(df, model_json, huffman_path)
    got = sorted((tuple(r) for r in huffman.read_digest(spark, huffman_path).collect()), key=lambda r: r[1])
    assert got == want
    back = {r.doc_id: r.ids for r in huffman.read_ids(spark, huffman_path).collect()}
    assert back[100_007] == tokenizer.encode("x" * 5_000, add_special_tokens=False).ids + [0]
    empty = str(tmp_path / "none")
    huffman.write_ids(df.limit(0), model_json, empty)
    assert huffman.read_digest(spark, empty).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.3, rng.integers(1, 5_000)) % 3_000
    counts = np.bincount(ids, minlength=3_000)
    lengths = huffman.code_lengths(counts, 12)
    assert lengths.max() <= 12 and (lengths[counts > 0] > 0).all()
    assert sum(2.0 ** -lengths[counts > 0]) <= 1
    checkpoints, payload = huffman.encode_ids(ids, huffman.coding_table(lengths), every=16)
    table = huffman.decoding_table(lengths)
    assert (huffman.decode_ids(payload, checkpoints, len(ids), table, every=16) == ids).all()


def test_code_lengths_are_optimal():
    draw = random.Random(2)
    for _ in range(20):
        counts = [draw.randrange(1, 60) for _ in range(draw.randrange(2, 30))]
        heap = [(c, 0) for c in counts]
        heapq.heapify(heap)
        best = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            best += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], 0))
        lengths = huffman.code_lengths(np.array(counts), 40)
        assert int((lengths * counts).sum()) == best
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, dtype=int), 2)


def test_sentencepiece(spark, pieces):
    df = with_odd(spark).withColumn("n_tokens", F.lit(None).cast("string"))
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    out = wfst.encode(df, pieces)
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    want = sorted(((i, library.encode(t)) for i, t in texts), key=repr)
    got = out.collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    plain = {i: t.replace("▁", " ") for i, t in texts}
    for r in wfst.decode(out, pieces).collect():
        assert r.text == plain[r.doc_id] or r.doc_id == 100_003
    for r in got:
        if r.doc_id is not None:
            assert r.decoded_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest()
    assert wfst.encode(df.limit(0), pieces).collect() == []


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_unigram_path_is_the_cheapest():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "c": -2.5, "ab": -3.5, "bc": -3.0, "abc": -7.0, "▁a": -4.0}
    model = _message((1, _message((1, b"<unk>"), (2, 0.0), (3, 2))))
    for text, score in scores.items():
        model += _message((1, _message((1, text.encode()), (2, score))))
    model += _message((2, _message((3, 1))), (3, _message((3, 1), (4, 0))))
    t = wfst.Transducer(model)

    def cheapest(s):
        if not s:
            return 0.0, ()
        options = [
            (scores[s[:k]] + cheapest(s[k:])[0], (s[:k], *cheapest(s[k:])[1]))
            for k in range(1, len(s) + 1) if s[:k] in scores
        ]
        return max(options)

    for text in ("abc", "aab", "cab", "bcbc", "abcabc"):
        arcs = t.best_path("▁" + text)
        assert abs(sum(scores[a] for a in arcs) - cheapest("▁" + text)[0]) < 1e-6
    assert t.encode("z") == [t.ids["▁"], 0]


def test_archives(spark, tmp_path):
    big, tricky = "é" * 60, "x" * 120 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(i, f"http://h/{i}", big if i % 3 else f"<p>{i}</p>" * 20) for i in range(10, 60)]
    rows += [
        (1, None, tricky), (2, "u\r\nX: y", tricky), (3, "e", None), (4, "e", ""), (5, "s", "short"),
        (6, "s", "short"), (7, "d", "d" * 200), (7, "d", "d" * 200), (8, "end", "tail\r\n\r\n" * 30),
        (None, "n", "n" * 150), (None, "m", big),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("original", F.lit(1))
    path = str(tmp_path / "warc")
    warc.write_archives(df, path)
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100:
            key = (i is None, i or 0)
            first[raw] = min(first.get(raw, key), key)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = raw in first and first[raw] != (i is None, i or 0)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw][1] if revisit else None))
    # Of two equal rows one is the response and the other refers to it.
    want.remove((7, 200, hashlib.sha256(b"d" * 200).hexdigest(), "response", None))
    want.append((7, 200, hashlib.sha256(b"d" * 200).hexdigest(), "revisit", 7))
    got = sorted((tuple(r) for r in warc.digest(spark, path).collect()), key=repr)
    assert got == sorted(want, key=repr)
    nested = {r.metadata.payload.decode().split("\r\n")[0]: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    row = nested["page-id: 1"]
    assert row.response.payload.decode() == tricky and row.request.record_type == "request"
    assert nested["page-id: 2"].response.target_uri == "u%0D%0AX: y"
    empty = str(tmp_path / "none")
    warc.write_archives(df.limit(0), empty)
    assert warc.digest(spark, empty).collect() == []


def test_broken_archives_lose_only_their_own_records():
    good = [b"WARC/1.1\r\nContent-Length: 6", b"ab", b""]
    assert list(warc.assembled_blocks(iter(good))) == [(good[0], b"ab\r\n\r\n")]
    bad = [b"junk", b"WARC/1.1\r\nContent-Length: x", b"zz", b"WARC/1.1\r\nContent-Length: 99", b"cut", None, *good]
    assert [b for _, b in warc.assembled_blocks(iter(bad))] == [b"ab\r\n\r\n"]


def test_archives_with_payloads_that_end_in_line_breaks(spark, tmp_path):
    ends = ["", "\r\n", "\r\n" * 2, "\r\n" * 3, "\r\n" * 4, "\r", "\n", "\r\n\r", "\n\r\n", "\r\n\r\n\n"]
    rows = [(i, f"http://h/{i}", "<html>" + "x" * 100 + "</html>" + end) for i, end in enumerate(ends)]
    rows += [(100 + i, url, html) for i, url, html in rows]
    rows += [(200, "u", "\r\n"), (201, "u", "\r\n" * 3), (202, "u", "\r\n" + "y" * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "warc")
    warc.write_archives(df, path)
    want = [
        (i, len(html), hashlib.sha256(html.encode()).hexdigest(), *(("revisit", i - 100) if 100 <= i < 200 else ("response", None)))
        for i, _, html in rows
    ]
    assert sorted(tuple(r) for r in warc.digest(spark, path).collect()) == sorted(want)
    read = warc.read_records(spark, path)
    assert read.count() == 3 * len(rows)


def test_a_last_payload_may_end_in_a_line_break():
    head = b"WARC/1.1\r\nContent-Length: 4"
    assert list(warc.assembled_blocks(iter([head, b"ab", b"\r\n", None, head, b"ab", b"\r\n" + head, b"cdef"]))) == [
        (head, b"ab\r\n"), (head, b"ab\r\n"), (head, b"cdef"),
    ]


def brute(rows, k):
    """Usable vectors' k best by inner product, added up in order, ties to the smaller id."""
    keep = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in keep:
        if q % 20 == 0:
            scored = []
            for i, b in keep:
                if i != q:
                    s = 0.0
                    for x, y in zip(a, b):
                        s += x * y
                    scored.append((-s, i))
            out[q] = sorted(scored)[:k]
    return out


def test_neighbours_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    want = brute(rows, ann.K)
    got = {}
    for r in ann.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert sorted(mine, key=lambda r: (-r.score, r.vec_id)) == mine
        hits += len({r.vec_id for r in mine} & {i for _, i in best})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbour_edges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(150)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(200, 300)]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6)]
    rows += [(420, [float("inf")] + [1.0] * 5), (440, [1.0, 2.0]), (441, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    monkeypatch.setattr(ann, "ROWS_PER_LIST", 8)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ann, "QUERY_ROWS", 2)
    want = brute([(i, v) for i, v in rows if v and len(v) == 6], 20)
    got = {}
    for r in ann.nearest_neighbours(df, probe_share=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        mine = [x[1:] for x in sorted(got[q])]
        assert len(mine) == len(best)
        hits += len(set(mine) & set(best))
    assert hits >= 0.95 * sum(map(len, want.values()))
    few = df.filter("vec_id < 3 or vec_id = 220")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest_neighbours(few).collect()) == [
        (0, 1), (0, 2), (0, 220), (220, 0), (220, 1), (220, 2)
    ]
    assert ann.nearest_neighbours(df.limit(0)).collect() == []


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(8)
    same = [0.25, -0.5, 1.0, 2.0]
    rows = [(20, same)] * 25 + [(i, same) for i in (3, 41, 60)]
    rows += [(i, rng.normal(size=4).tolist()) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(list({i: v for i, v in rows}.items()), 20)
    assert {q: len(x) for q, x in got.items()} == {q: 20 for q in want}
    assert got[20][:3] == [3, 41, 60] and got[60][:3] == [3, 20, 41]
    assert all(len(set(x)) == 20 for x in got.values())


def test_arcs_are_looked_up_only_where_a_piece_can_end():
    """The pieces that end in the last three characters bound an arc, whatever the model's longest piece."""
    with open(public_tokenizers.path(PIECE_MODEL), "rb") as f:
        model = wfst.Transducer(f.read())
    text = model.normalise("unbelievable zzqqxx 0xdeadbeef Straßenbahn 日本語 a")
    longest = [end - model.first_begin(text, end) for end in range(1, len(text) + 1)]
    ends = lambda end: [n for n in range(1, end + 1) if text[end - n : end] in model.ids]
    assert all(max(ends(end), default=1) <= n for end, n in enumerate(longest, start=1))
    assert sum(longest) < sum(min(end, model.longest) for end in range(1, len(text) + 1)) / 2
