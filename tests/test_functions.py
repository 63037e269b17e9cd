from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions import bytescan, links, scripts, text
from papersieve.functions.arrow import byte_profile, entropy_4dp
from papersieve.operators import calls, ordered, signatures
from papersieve.sources import files as fs


def binary(spark, *values: bytes):
    return spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "doc_id int, content binary")


def samples() -> list[bytes]:
    rng = random.Random(5)
    noise = bytes(rng.randrange(256) for _ in range(4096))
    return [b"", b"#4", b"/J#61vaScript #2361 ##41", b"1 0 obj endobj stream endstream /Page /Pages%%EOF", noise]


def test_name_escapes_resolve_once(spark):
    want = [re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m.group(1).decode()), s) for s in samples()]
    view = bytescan.decode_name_escapes(text.latin1(F.col("content")))
    rows = binary(spark, *samples()).select("doc_id", F.encode(view, "ISO-8859-1").alias("d")).collect()
    assert {r.doc_id: bytes(r.d) for r in rows} == dict(enumerate(want))


def test_profile_counts_substrings_and_words(spark):
    row = binary(spark, samples()[3]).select(byte_profile(F.col("content")).alias("p")).first().p
    counts = dict(zip(K.PDF_KEYWORDS, row.keyword_hits))
    assert (counts["obj"], counts["stream"], counts["/Page"]) == (2, 2, 2)
    assert (row.object_count, row.stream_count) == (1, 1)


def test_arrow_and_column_forms_agree(spark):
    df = binary(spark, *samples())
    plain = bytescan.decode_name_escapes(text.latin1(F.col("content")))
    rows = df.select(
        byte_profile(F.col("content")).alias("p"),
        bytescan.object_count(plain).alias("o"),
        bytescan.stream_count(plain).alias("s"),
        bytescan.escaped_name_count(text.latin1(F.col("content"))).alias("e"),
        F.array(*[text.count_of(plain, k) for k in K.PDF_KEYWORDS]).alias("k"),
    ).collect()
    for r in rows:
        assert (r.p.object_count, r.p.stream_count, r.p.escaped_names) == (r.o, r.s, r.e)
        assert r.p.keyword_hits == r.k


def test_entropy(spark):
    def bits(data):
        n = len(data)
        return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0

    rows = binary(spark, *samples()).select("doc_id", entropy_4dp(F.col("content")).alias("e")).collect()
    assert all(abs(r.e - round(bits(samples()[r.doc_id]), 4)) < 1e-9 for r in rows)


@pytest.mark.parametrize(("prefix", "name"), K.MAGIC_SIGNATURES)
def test_magic(spark, prefix, name):
    df = binary(spark, bytes.fromhex(prefix) + b" rest")
    assert df.select(bytescan.magic_type(F.col("content"))).first()[0] == name


def test_missing_header_has_offset_zero(spark):
    row = bytescan.byte_features(binary(spark, b"no header")).first()
    assert (row.has_header, row.header_offset, row.pdf_version) == (False, 0, None)
    edge = binary(spark, b" " * 1019 + b"%PDF-1.4", b" " * 1020 + b"%PDF-1.4")
    assert [r.h for r in edge.select(bytescan.has_header(F.col("content")).alias("h")).collect()] == [True, False]


URLS = {
    "http://[::1]/x": ("http", "::1", True, None),
    "HTTP://User@My_Host.TOP:8080/a": ("http", "my_host.top", False, 8080),
    "http://h:99999/": ("http", "h", False, None),
    "javascript:alert(1)": ("javascript", "", False, None),
    "http://01.2.3.4/": ("http", "01.2.3.4", False, None),
    "http://1.2.3.4": ("http", "1.2.3.4", True, None),
    "http://[bad/": None,
    "a:b": None,
}


def test_classify(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", links.classify(F.col("u")).alias("c"))
    for r in df.collect():
        want = URLS[r.u]
        assert (r.c is None) == (want is None), r.u
        if want:
            assert (r.c.scheme, r.c.host, r.c.is_ip_literal, r.c.port) == want, r.u


def test_sweep_keeps_order_and_cap(spark):
    body = "x http://b.org/1 ftp://a.top/2 http://b.org/1 \\\\srv\\share data: javascript:x"
    df = spark.createDataFrame([(body,)], "t string")
    got = df.select(links.sweep(F.col("t"), 500, False).alias("u")).first().u
    assert [(u.scheme, u.host) for u in got] == [("http", "b.org"), ("ftp", "a.top"), ("unc", "srv")]
    assert len(df.select(links.sweep(F.col("t"), 1, False).alias("u")).first().u) == 1


def test_obfuscation_of_packed_script(spark):
    code = "var _0x1=unescape('" + "%u9090" * 100 + "');" + "fromCharCode(1);" * 7 + "'" + "A" * 250 + "'"
    df = spark.createDataFrame([(0, 0, "/OpenAction", code)], "doc_id int, ord int, location string, code string")
    row = scripts.enrich_scripts(df).first()
    names = re.findall(r"\b[_$a-zA-Z][_$a-zA-Z0-9]{0,40}\b", code)
    short = sum(len(n) <= 2 or n.startswith("_0x") for n in names) / len(names)
    # Escapes and builders are saturated, the long string adds 0.6.
    assert row.obfuscation_score == round((1.0 + 1.0 + 0.6 + short) / 4, 3)
    assert "unescape" in row.suspicious_tokens and "%u9090" in row.suspicious_tokens


def test_running_before_survives_a_hot_key(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        F.col("id"), (F.col("id") % 5).alias("v"),
    )
    got = {r.id: r.running_before for r in ordered.running_before(df, F.col("v"), ["id"], ["k"]).collect()}
    totals: dict[str, int] = {}
    for r in df.orderBy("id").collect():
        assert got[r.id] == totals.get(r.k, 0)
        totals[r.k] = totals.get(r.k, 0) + r.v
    assert len(got) == 2000


def test_first_failing_run(spark):
    failed = [1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1]
    df = spark.createDataFrame(list(enumerate(failed, 1)), "i int, f int")
    assert ordered.first_failing_run(df, F.col("f") == 1, 5, "i").first()[0] == 10
    assert ordered.first_failing_run(df, F.col("f") == 1, 7, "i").first()[0] is None


def test_quota_is_told_from_rate_limit(spark):
    rows = [(429, "insufficient_quota"), (429, "quota exceeded: 3 per minute"), (503, ""), (403, ""), (404, ""), (200, "")]
    df = spark.createDataFrame(rows, "s int, b string").select(calls.call_class(F.col("s"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == ["quota", "retryable", "retryable", "auth", "invalid", "ok"]


def test_empty_rule_set_is_an_error(spark):
    with pytest.raises(ValueError):
        signatures.signature_hits(binary(spark, b"x"), ())


def test_admission_order(spark):
    rows = [(None, None), (b"", 0), (b"%PDF-1", 10**9), (b"text", 4), (b"%PDF-1.4", 8)]
    df = spark.createDataFrame([(c and bytearray(c), n) for c, n in rows], "content binary, length bigint")
    got = [r.c for r in df.select(fs.reject_code(F.col("content"), F.col("length")).alias("c")).collect()]
    assert got == ["validation_error", "validation_error", "file_too_large", "unsupported_file_type", None]


def test_folder_and_corpus_reading(spark, tmp_path):
    for name in ("MALWARE_a/x.pdf", "clean_b/sub/y.bin", "other/z.pdf"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"%PDF-1.4")
    assert fs.read_folder(spark, str(tmp_path), True).count() == 2
    corpus = fs.read_corpus(spark, str(tmp_path))
    assert {(r.dataset, r.label) for r in fs.labelled(corpus).collect()} == {("MALWARE_a", "malware"), ("clean_b", "clean")}
    assert [r.dataset for r in fs.unlabelled_datasets(corpus).collect()] == ["other"]
    assert fs.require_headers(corpus).where("content IS NOT NULL").count() == 3


def test_strict_mode_fails(spark):
    df = spark.createDataFrame([("p", bytearray(b"text"))], "path string, content binary")
    with pytest.raises(Exception, match="no %PDF- header in p"):
        fs.require_headers(df).collect()


def test_user_rules_come_from_a_table(spark):
    rows = [("Marker", "high", "custom", None, "user",
             [("a", "needle", "text", True, 1), ("b", "x[0-9]+", "regex", False, 2)], [(2, ["a", "b"])])]
    table = spark.createDataFrame(rows, signatures.RULE_TABLE_SCHEMA)
    rules = signatures.rule_set(signatures.rules_from_table(table))
    assert len(rules) == len(signatures.BUNDLED) + 1
    hits = signatures.signature_hits(binary(spark, b"NEEDLE x1 x2", b"NEEDLE x1"), rules).collect()
    assert [(h.doc_id, h.rule, h.strings, h.rules_loaded) for h in hits] == [(0, "Marker", ["$a", "$b"], 14)]
