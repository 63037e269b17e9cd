"""Signature rules in any number: an index of patterns by one rare substring each.

A plan that tests every pattern grows with the rule set. Here the plan is the same
for ten rules and ten thousand:

1. Each pattern is filed under an *anchor*, the substring of up to four bytes of it
   that is likely to be rarest. Patterns without one (some regular expressions) are
   always worth a test.
2. One pass over the bytes of a file looks its substrings up in the anchors and
   keeps the patterns that may occur: a few of them, whatever the size of the set.
3. Those are tested with the column functions, on the file's own row; which pattern
   a row tests is data that comes from a join with the pattern table.
4. Each rule is looked at only where a pattern of its most telling group was
   found, and holds if each of its groups has as many found patterns as it needs.

The pattern and rule tables are broadcast. Their size has a bound, which
:func:`rule_tables` checks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.functions.text import latin1
from papersieve.operators.signatures import MAX_USER_RULES, Pattern, Signature, require_rules, signature_hits

ANCHOR_BYTES = 4
MAX_PATTERNS = 20 * MAX_USER_RULES
MAX_PATTERN_BYTES = 64 << 20
PATTERN_TABLE = "pattern_id int, value string, kind string, nocase boolean, min_count int"
RULE_TABLE = (
    "sig_ord int, rule string, namespace string, severity string, category string, mitre string, "
    "named array<struct<pattern_id:int,id:string>>, groups array<struct<need:int,ids:array<int>>>, "
    "keys array<int>"
)


def lowered(data: bytes) -> bytes:
    """Lower case in the byte-per-character view, where every letter stays one byte."""
    return data.decode("latin-1").lower().encode("latin-1")


def required_literal(regex: str) -> bytes:
    """The longest run of plain characters that every match contains, or nothing.

    Only what stands outside of groups, choices and repetitions counts.
    """
    runs, run, depth, at = [], "", 0, 0
    while at < len(regex):
        c = regex[at]
        after = regex[at + 1 : at + 2]
        if c == "\\" and after:
            # An escaped sign is itself, an escaped letter one of the known classes and places.
            if after.isalnum() and after not in "dDwWsSbBAZzGnrtfvhHR":
                return b""
            literal, at = ("" if after.isalnum() else after), at + 2
        elif c == "{":
            literal, at = "", regex.find("}", at) + 1 or len(regex)
        elif c == "[":
            at += 1
            at += regex[at : at + 1] == "^"
            at += regex[at : at + 1] == "]"
            while at < len(regex) and regex[at] != "]":
                if regex[at] == "[":
                    return b""  # A class within a class.
                at += 2 if regex[at] == "\\" else 1
            literal, at = "", at + 1
        elif c in "()":
            depth += 1 if c == "(" else -1
            literal, at = "", at + 1
        elif c == "|":
            return b""  # Any of the choices may match.
        elif c in ".^$*+?":
            literal, at = "", at + 1
        else:
            literal, at = c, at + 1
        if regex[at : at + 1] in ("*", "?", "{"):
            literal = ""
        if depth or not literal or ord(literal) > 255:
            runs.append(run)
            run = ""
        else:
            run += literal
    runs.append(run)
    found = max(runs, key=len)
    # Flags and quotations change what characters mean.
    if re.search(r"\\[QE]|\(\?[a-z]*x", regex):
        return b""
    return found.encode("latin-1")


def literal_of(pattern: Pattern) -> bytes:
    """Bytes that occur, in lower case, wherever the pattern matches."""
    if pattern.kind == "hex":
        return lowered(bytes.fromhex(pattern.value))
    if pattern.kind == "regex":
        return lowered(required_literal(pattern.value))
    try:
        return lowered(pattern.value.encode("latin-1"))
    except UnicodeEncodeError:
        return b""  # Not in the byte-per-character view: the test itself says no.


def anchors(literals: Sequence[bytes]) -> list[bytes]:
    """One substring of up to ``ANCHOR_BYTES`` of each literal, the least likely one.

    Letters and blanks are likely in any text, other bytes less so; among equals
    the substring that fewest literals share.
    """
    plain = set(b"abcdefghijklmnopqrstuvwxyz ")
    pieces = [
        {x[i : i + ANCHOR_BYTES] for i in range(max(1, len(x) - ANCHOR_BYTES + 1))} for x in literals
    ]
    shared = Counter(p for held in pieces for p in held)
    return [min(held, key=lambda p: (sum(b in plain for b in p), shared[p], p)) for held in pieces]


@dataclass(frozen=True)
class Anchors:
    """Anchors by their length: sorted numbers, and the patterns under each."""

    by_length: dict[int, tuple[np.ndarray, list[list[int]]]]
    always: list[int]

    def worth_testing(self, data: bytes) -> list[int]:
        low = lowered(data)
        found = set(self.always)
        raw = np.frombuffer(low, dtype=np.uint8)
        for length, (known, patterns) in self.by_length.items():
            if len(raw) < length:
                continue
            grams = raw[: len(raw) - length + 1].astype(np.uint32)
            for k in range(1, length):
                grams = (grams << np.uint32(8)) | raw[k : len(raw) - length + 1 + k]
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            for i in np.unique(at[known[at] == grams]).tolist():
                found.update(patterns[i])
        return sorted(found)


def index(patterns: Sequence[Pattern]) -> Anchors:
    literals = [literal_of(p) for p in patterns]
    chosen = anchors(literals)
    under: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    always = []
    for i, anchor in enumerate(chosen):
        if anchor:
            under[len(anchor)][int.from_bytes(anchor, "big")].append(i)
        else:
            always.append(i)
    by_length = {}
    for length, held in under.items():
        numbers = sorted(held)
        by_length[length] = np.array(numbers, dtype=np.uint32), [held[n] for n in numbers]
    return Anchors(by_length, always)


def rule_tables(
    spark: SparkSession, rules: Sequence[Signature], first_ord: int = 0
) -> tuple[list[Pattern], DataFrame, DataFrame]:
    """Distinct patterns, their table, and the table of rules over their numbers."""
    numbers: dict[tuple, int] = {}
    patterns: list[Pattern] = []
    for rule in rules:
        for p in rule.patterns:
            same = (p.value, p.kind, p.nocase, p.min_count)
            if same not in numbers:
                numbers[same] = len(patterns)
                patterns.append(p)
    size = sum(len(p.value) for p in patterns)
    if len(rules) > MAX_USER_RULES or len(patterns) > MAX_PATTERNS or size > MAX_PATTERN_BYTES:
        raise ValueError(f"rule set too large: {len(rules)} rules, {len(patterns)} patterns, {size} characters")
    rows = []
    for k, rule in enumerate(rules):
        number = {p.id: numbers[p.value, p.kind, p.nocase, p.min_count] for p in rule.patterns}
        groups = [(need, [number[i] for i in ids]) for need, ids in rule.groups]
        # A rule cannot fire unless this group has a match; longer patterns are rarer.
        telling = max(groups, key=lambda g: min(len(patterns[i].value) for i in g[1]))
        rows.append(
            (
                first_ord + k, rule.rule, rule.namespace, rule.severity, rule.category, rule.mitre,
                [(number[p.id], p.id) for p in rule.patterns], groups, sorted(set(telling[1])),
            )
        )
    values = [
        (i, bytes.fromhex(p.value).decode("latin-1") if p.kind == "hex" else p.value, p.kind, p.nocase, p.min_count)
        for i, p in enumerate(patterns)
    ]
    return patterns, spark.createDataFrame(values, PATTERN_TABLE), spark.createDataFrame(rows, RULE_TABLE)


def found_patterns(files: DataFrame, patterns: Sequence[Pattern], table: DataFrame) -> DataFrame:
    """``doc_id, found``: numbers of the patterns that occur in each file, where any does."""
    shared = files.sparkSession.sparkContext.broadcast(index(patterns))

    @F.pandas_udf("array<int>")
    def worth_testing(content: pd.Series) -> pd.Series:
        anchors = shared.value
        return content.map(lambda b: anchors.worth_testing(b or b""))

    text, value = F.col("text"), F.col("value")
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = F.concat(
        F.when(F.col("nocase"), "(?i)").otherwise(""), F.when(F.col("kind") == "regex", value).otherwise(quoted)
    )
    occurs = (
        F.when((F.col("kind") == "hex"), F.contains(text, value))
        .when(
            (F.col("kind") == "text") & (F.col("min_count") == 1),
            F.when(F.col("nocase"), F.contains(F.lower(text), F.lower(value))).otherwise(F.contains(text, value)),
        )
        .when(F.col("min_count") == 1, F.rlike(text, plain))
        .otherwise(F.regexp_count(text, plain) >= F.col("min_count"))
    )
    tried = (
        files.select("doc_id", "content", worth_testing("content").alias("may"))
        .where(F.size("may") > 0)
        .select("doc_id", latin1(F.col("content")).alias("text"), F.explode("may").alias("pattern_id"))
    )
    return (
        tried.join(F.broadcast(table), "pattern_id")
        .where(occurs)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("pattern_id")).alias("found"))
    )


def indexed_hits(
    files: DataFrame, rules: Sequence[Signature], first_ord: int = 0, loaded: int | None = None
) -> DataFrame:
    """Firing rules of ``files(doc_id, content)``, in the form of ``signature_hits``.

    ``doc_id`` is unique. Only pattern numbers are shuffled, never content, and a
    document's list of them is bounded by the rule set.
    """
    rules = require_rules(rules)
    patterns, table, rule_rows = rule_tables(files.sparkSession, rules, first_ord)
    found = found_patterns(files, patterns, table)
    keys = rule_rows.select("sig_ord", F.explode("keys").alias("pattern_id"))
    may_fire = (
        found.select("doc_id", "found", F.explode("found").alias("pattern_id"))
        .join(F.broadcast(keys), "pattern_id")
        .select("doc_id", "found", "sig_ord")
        .distinct()
    )
    holds = F.forall("groups", lambda g: F.size(F.array_intersect(g["ids"], F.col("found"))) >= g["need"])
    names = F.transform(
        F.filter("named", lambda p: F.array_contains(F.col("found"), p["pattern_id"])),
        lambda p: F.concat(F.lit("$"), p["id"]),
    )
    return (
        may_fire.join(F.broadcast(rule_rows), "sig_ord")
        .where(holds)
        .select(
            "doc_id", "sig_ord", "rule", "namespace", "severity", "category", "mitre",
            F.slice(F.array_distinct(names), 1, 20).alias("strings"),
            F.lit(loaded or len(rules)).alias("rules_loaded"),
        )
    )


def all_hits(files: DataFrame, rules: Sequence[Signature]) -> DataFrame:
    """Firing rules of a set: its leading bundled rules as expressions, the rest by the index."""
    inline, more = split_rules(require_rules(rules))
    parts = []
    if inline:
        parts.append(signature_hits(files, inline).withColumn("rules_loaded", F.lit(len(rules))))
    if more:
        parts.append(indexed_hits(files, more, len(inline), len(rules)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def split_rules(rules: Sequence[Signature]) -> tuple[tuple[Signature, ...], tuple[Signature, ...]]:
    """The leading bundled rules, and all that come after them."""
    inline = tuple(takewhile(lambda r: r.namespace == "bundled", rules))
    return inline, tuple(rules[len(inline) :])
