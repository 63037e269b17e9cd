"""Signature sets of any size over one pass of the text."""

from __future__ import annotations

import random
import re

import pytest

from papersieve.operators import patterns as pt
from papersieve.operators.signatures import BUNDLED, Pattern, Signature, rule_set, signature_hits
from papersieve.plans.scan import scan_files


def user_rules(count: int) -> tuple[Signature, ...]:
    return tuple(
        Signature(
            f"user_{i}", "low", "test",
            (Pattern("word", f"marker-{i};"), Pattern("other", "never there")),
            ((1, ("word", "other")),),
            namespace="user",
        )
        for i in range(count)
    )


def marked(spark):
    rows = [(i, bytearray(f"%PDF-1.4 marker-{i}; and marker-499;".encode())) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id bigint, content binary")


def test_many_user_rules(spark):
    hits = pt.all_hits(marked(spark), rule_set(user_rules(500)))
    found = {(r.doc_id, r.rule, r.sig_ord, tuple(r.strings)) for r in hits.where("namespace = 'user'").collect()}
    first = len(BUNDLED)
    assert found == {(i, f"user_{k}", first + k, ("$word",)) for i in range(20) for k in (i, 499)}
    assert hits.first().rules_loaded == first + 500


def test_plan_does_not_grow_with_the_rules(spark):
    def size(count):
        plan = pt.indexed_hits(marked(spark), user_rules(count))._jdf.queryExecution().analyzed().toString()
        return len(re.sub(r"\d+", "", plan))

    assert size(10) == size(3_000)


def test_text_is_decoded_once(spark):
    files = spark.createDataFrame([(1, bytearray(b"x"))], "doc_id bigint, content binary")
    plan = signature_hits(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("decode(content") == 1


def test_index_and_expressions_agree(spark):
    """All bundled rules and random ones, over texts made of their pieces."""
    draw = random.Random(12)
    words = ["/JS", "/js", "eval(", "%u9090%u9090", "cmd.exe", "/URI", "ab", "b", "\u00c0x", "\u00e0X", "a.c", "abc", "#41", "\\x90"]
    rules = list(BUNDLED)
    for k in range(120):
        made = []
        for j in range(draw.randint(1, 4)):
            value = "".join(draw.choice(words) for _ in range(draw.randint(1, 2)))
            kind = draw.choice(["text", "text", "hex", "regex"])
            if kind == "hex":
                value = value.encode("latin-1").hex()
            if kind == "regex":
                value = draw.choice([r"ab{1,2}c", r"a[^\]x]c", r"e?val\(", r"cmd\.exe|/URI", r"(?:ab)+b", r"\x41", "."])
            made.append(Pattern(f"p{j}", value, kind, draw.random() < 0.5, draw.choice([1, 1, 1, 2])))
        ids = [p.id for p in made]
        groups = tuple((draw.randint(1, 2), tuple(draw.sample(ids, draw.randint(1, len(ids))))) for _ in range(2))
        rules.append(Signature(f"r{k}", "low", "x", tuple(made), groups, namespace="user"))
    texts = [
        "".join(draw.choice([*words, " ", "\n", "4", "/OpenAction", "/EmbeddedFile", "MZ\x90\x00", "smb://"]) for _ in range(n))
        for n in [0, 1, 2, 3, 5, 8, 13, 21, 34] * 8
    ]
    files = spark.createDataFrame(
        [(i, bytearray(t.encode("latin-1"))) for i, t in enumerate(texts)] + [(1_000, None)],
        "doc_id bigint, content binary",
    )
    columns = ("doc_id", "sig_ord", "rule", "namespace", "severity", "category", "mitre", "strings", "rules_loaded")
    got = sorted(map(str, pt.indexed_hits(files, rules).select(*columns).collect()))
    want = sorted(map(str, signature_hits(files, rules).select(*columns).collect()))
    assert got == want and len(want) > 300


@pytest.mark.parametrize(
    ("regex", "literal"),
    [
        (r"util\.printf\s*\(", b"util.printf"), (r"abcd?ef", b"abc"), (r"x{2,3}yz1", b"yz1"), (r"(abc)de", b"de"),
        (r"ab|cd", b""), (r"[abc]defg", b"defg"), (r"[]a]bc", b"bc"), (r"\x41bc", b""), (r"\Qa.b\E", b""),
        (r"(?i)Name", b"Name"), (r"a+bc", b"bc"), (r"\d\dkb", b"kb"), (r"(?x) a b", b""), ("", b""), (r"(?!no)yes", b"yes"),
    ],
)
def test_literals_every_match_contains(regex, literal):
    assert pt.required_literal(regex) == literal


def test_scan_with_user_rules(spark):
    from documents import ALL

    files = spark.createDataFrame(
        [(1, bytearray(ALL["program_start"] + b"\n% marker-7; here")), (2, bytearray(ALL["report"]))],
        "doc_id bigint, content binary",
    )
    scan = scan_files(files, rule_set(user_rules(40)))
    codes = {(r.doc_id, r.code) for r in scan.indicators.collect()}
    assert (1, "YARA_USER_7") in codes and (1, "YARA_LAUNCH_ACTION") in codes
    assert not any(i == 2 and c.startswith("YARA_") for i, c in codes)
    assert {r.rules_loaded for r in scan.evidence.hits.collect()} == {len(BUNDLED) + 40}


def test_oversized_sets_are_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        pt.rule_tables(spark, user_rules(10_001))
