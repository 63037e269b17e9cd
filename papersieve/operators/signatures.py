"""Signature matching: patterns are data, a match is a boolean column.

All patterns of all rules become one projection over the raw byte-per-character
text, so matching is narrow and runs where the file was read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.text import case_map, latin1, let


@dataclass(frozen=True)
class Pattern:
    """One string of a rule. ``kind`` is text, regex or hex."""

    id: str
    value: str
    kind: str = "text"
    nocase: bool = False
    min_count: int = 1


@dataclass(frozen=True)
class Signature:
    """A rule fires when every group ``(need, ids)`` has ``need`` matching ids."""

    rule: str
    severity: str
    category: str
    patterns: tuple[Pattern, ...]
    groups: tuple[tuple[int, tuple[str, ...]], ...]
    mitre: str | None = None
    namespace: str = "bundled"


def _p(id: str, value: str, kind: str = "text", nocase: bool = False, n: int = 1) -> Pattern:
    return Pattern(id, value, kind, nocase, n)


# The bundled rule set.
BUNDLED = (
    Signature(
        "Header_Anomaly", "medium", "structure",
        (_p("shifted", r"(?s)\A(?!%PDF).{1,1024}?%PDF", "regex"),),
        ((1, ("shifted",)),),
    ),
    Signature(
        "OpenAction_JavaScript", "high", "active_content",
        (
            _p("open", "/OpenAction", nocase=True),
            _p("js1", "/JavaScript", nocase=True),
            _p("js2", "/JS", nocase=True),
        ),
        ((1, ("open",)), (1, ("js1", "js2"))),
        "T1204.002",
    ),
    Signature(
        "Launch_Action", "critical", "active_content",
        (
            _p("launch", "/Launch", nocase=True),
            _p("cmd1", "cmd.exe", nocase=True),
            _p("cmd2", "powershell", nocase=True),
            _p("cmd3", "/bin/sh"),
            _p("cmd4", "rundll32", nocase=True),
            _p("cmd5", "mshta", nocase=True),
            _p("cmd6", "wscript", nocase=True),
        ),
        ((1, ("launch",)), (1, ("cmd1", "cmd2", "cmd3", "cmd4", "cmd5", "cmd6"))),
        "T1204.002",
    ),
    Signature(
        "Embedded_Executable", "critical", "embedded_file",
        (
            _p("embed", "/EmbeddedFile", nocase=True),
            _p("mz", "4D5A9000", "hex"),
            _p("elf", "7F454C46", "hex"),
            _p("ole", "D0CF11E0A1B11AE1", "hex"),
        ),
        ((1, ("embed",)), (1, ("mz", "elf", "ole"))),
        "T1027.013",
    ),
    Signature(
        "JavaScript_Heap_Spray", "critical", "exploit",
        (
            _p("nop1", "%u9090%u9090"),
            _p("nop2", "\\x90\\x90\\x90\\x90"),
            _p("spray", "sprayHeap", nocase=True),
            _p("heap", "heapLib", nocase=True),
            _p("shell", "shellcode", nocase=True),
        ),
        ((1, ("nop1", "nop2", "spray", "heap", "shell")),),
        "T1203",
    ),
    Signature(
        "JavaScript_Obfuscation", "high", "obfuscation",
        (
            _p("js", "/JS", nocase=True),
            _p("eval", "eval(", nocase=True),
            _p("unescape", "unescape(", nocase=True),
            _p("charcode", "fromCharCode", nocase=True),
            _p("atob", "atob(", nocase=True),
        ),
        ((1, ("js",)), (2, ("eval", "unescape", "charcode", "atob"))),
        "T1027",
    ),
    Signature(
        "Exploit_API", "high", "exploit",
        (
            _p("collab_email", "Collab.collectEmailInfo"),
            _p("collab_icon", "Collab.getIcon"),
            _p("media", "media.newPlayer"),
            _p("spell", "spell.customDictionaryOpen"),
        ),
        ((1, ("collab_email", "collab_icon", "media", "spell")),),
    ),
    Signature(
        "Printf_Format_Overflow", "high", "exploit",
        (
            _p(
                "overflow",
                "util\\.printf\\s*\\(\\s*[\"'][^\"']{0,16}%[0-9]{3,}",
                "regex",
                nocase=True,
            ),
        ),
        ((1, ("overflow",)),),
        "T1203",
    ),
    Signature(
        "JBIG2_Decoder", "medium", "exploit",
        (_p("jbig2", "/JBIG2Decode"),),
        ((1, ("jbig2",)),),
    ),
    Signature(
        "Name_Obfuscation", "medium", "obfuscation",
        (
            _p("a", "/J#61vaScript", nocase=True),
            _p("b", "/#4Aava#53cript", nocase=True),
            _p("c", "/Op#65nAction", nocase=True),
            _p("d", "/#4C#61unch", nocase=True),
            _p(
                "e",
                r"/[A-Za-z]{0,6}#[0-9A-Fa-f]{2}[A-Za-z]{0,6}#[0-9A-Fa-f]{2}",
                "regex",
                n=5,
            ),
        ),
        ((1, ("a", "b", "c", "d", "e")),),
        "T1027",
    ),
    Signature(
        "XFA_Form", "medium", "active_content",
        (_p("xfa", "/XFA"), _p("xdp", "xdp:xdp"), _p("script", "<script")),
        ((1, ("xfa",)), (1, ("xdp", "script"))),
    ),
    Signature(
        "Credential_Phish_Lure", "low", "phishing",
        (
            _p("l1", "sign in to view", nocase=True),
            _p("l2", "verify your account", nocase=True),
            _p("l3", "your account will be suspended", nocase=True),
            _p("l4", "click here to unlock", nocase=True),
            _p("l5", "enable editing to view", nocase=True),
            _p("uri", "/URI"),
        ),
        ((1, ("uri",)), (1, ("l1", "l2", "l3", "l4", "l5"))),
        "T1566.001",
    ),
    Signature(
        "Remote_Template_Reference", "high", "network",
        (
            _p("gotor", "/GoToR"),
            _p("gotoe", "/GoToE"),
            _p("unc", r"\\\\[A-Za-z0-9._-]{2,}\\", "regex"),
            _p("smb", "smb://", nocase=True),
            _p("file", "file://", nocase=True),
        ),
        ((1, ("gotor", "gotoe")), (1, ("unc", "smb", "file"))),
        "T1221",
    ),
)

RULE_TABLE_SCHEMA = (
    "rule string, severity string, category string, mitre string, namespace string, "
    "patterns array<struct<id:string,value:string,kind:string,nocase:boolean,min_count:int>>, "
    "groups array<struct<need:int,ids:array<string>>>"
)
MAX_USER_RULES = 10_000


def rules_from_table(table: DataFrame) -> tuple[Signature, ...]:
    """User rules from a table in ``RULE_TABLE_SCHEMA``. Reads it to the driver:
    a rule set becomes expressions of the plan, and its size is checked."""
    rows = table.orderBy("rule").limit(MAX_USER_RULES + 1).collect()
    if len(rows) > MAX_USER_RULES:
        raise ValueError(f"more than {MAX_USER_RULES} user rules")
    return tuple(
        Signature(
            r.rule, r.severity or "medium", r.category or "signature",
            tuple(Pattern(p.id, p.value, p.kind, bool(p.nocase), p.min_count or 1) for p in r.patterns),
            tuple((g.need, tuple(g.ids)) for g in r.groups),
            r.mitre, r.namespace or "user",
        )
        for r in rows
    )


def rule_set(*extra: Sequence[Signature]) -> tuple[Signature, ...]:
    """Bundled rules followed by the user's; an empty set is an error, because a
    scan without signatures cannot be told from one that found nothing."""
    rules = tuple(r for group in (BUNDLED, *extra) for r in group)
    return require_rules(rules)


def require_rules(rules: Sequence[Signature]) -> tuple[Signature, ...]:
    if not rules:
        raise ValueError("signature rule set is empty: detection would be silently off")
    return tuple(rules)


def matches(pattern: Pattern, text: Column, lowered: Column) -> Column:
    """Whether one pattern occurs often enough in the text."""
    if pattern.kind == "text" and pattern.min_count == 1:
        if pattern.nocase:
            return F.contains(lowered, F.lit(pattern.value.lower()))
        return F.contains(text, F.lit(pattern.value))
    if pattern.kind == "hex":
        return F.contains(text, F.lit(bytes.fromhex(pattern.value).decode("latin-1")))
    value = pattern.value if pattern.kind == "regex" else rf"\Q{pattern.value}\E"
    regex = f"(?i){value}" if pattern.nocase else value
    if pattern.min_count == 1:
        return text.rlike(regex)
    return F.regexp_count(text, F.lit(regex)) >= pattern.min_count


def _same(pattern: Pattern) -> tuple:
    """What a pattern tests, whatever it is called in its rule."""
    return pattern.value, pattern.kind, pattern.nocase, pattern.min_count


def _hit(rule: Signature, place: dict[tuple, int], tests: Column) -> Column:
    """The rule's entry, from the outcomes of the tests."""
    found = {p.id: F.get(tests, F.lit(place[_same(p)])) for p in rule.patterns}
    fires = None
    for need, ids in rule.groups:
        if need == 1:
            group = found[ids[0]]
            for i in ids[1:]:
                group = group | found[i]
        else:
            total = sum((found[i].cast("int") for i in ids[1:]), found[ids[0]].cast("int"))
            group = total >= need
        fires = group if fires is None else fires & group
    names = F.filter(
        F.array(*[F.when(found[p.id], F.lit(f"${p.id}")) for p in rule.patterns]),
        lambda s: s.isNotNull(),
    )
    return F.when(
        fires,
        F.struct(
            F.lit(rule.rule).alias("rule"),
            F.lit(rule.namespace).alias("namespace"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.category).alias("category"),
            F.lit(rule.mitre).cast("string").alias("mitre"),
            F.slice(names, 1, 20).alias("strings"),
        ),
    )


def signature_hits(
    files: DataFrame, rules: Sequence[Signature] = BUNDLED, text: Column | None = None
) -> DataFrame:
    """Rows ``doc_id, sig_ord, rule, ..., strings, rules_loaded`` per firing rule.

    ``text`` defaults to the byte view of ``content``; it is decoded once.
    """
    view = latin1(F.col("content")) if text is None else text
    hits = let(view, lambda t: let(F.lower(t), lambda low: hit_array(t, low, rules)))
    return explode_hits(files.select("doc_id", hits.alias("hits")), rules)


def hit_array(text: Column, low: Column, rules: Sequence[Signature] = BUNDLED) -> Column:
    """One entry per rule in rule-set order, null where the rule is silent.

    Every distinct pattern is tested once per document, into one array of
    outcomes; rules only combine those, so further rules cost no further pass
    over the text unless they bring patterns of their own.
    """
    rules = require_rules(rules)
    patterns = {_same(p): p for r in rules for p in r.patterns}
    place = {key: k for k, key in enumerate(patterns)}
    tests = F.array(*[matches(p, text, low) for p in patterns.values()])
    return let(tests, lambda t: F.array(*[_hit(r, place, t) for r in rules]))


def explode_hits(rows: DataFrame, rules: Sequence[Signature] = BUNDLED) -> DataFrame:
    """Firing rules of ``rows(doc_id, hits)`` as rows.

    The outer form keeps the optimizer from filtering on the array first, which
    would compute it three times.
    """
    return (
        rows.select("doc_id", F.posexplode_outer("hits").alias("sig_ord", "h"))
        .where(F.col("h").isNotNull())
        .select("doc_id", "sig_ord", "h.*", F.lit(len(rules)).alias("rules_loaded"))
    )


def severity_weight(severity: Column) -> Column:
    """Weight of a signature severity; an unknown one counts as medium."""
    return case_map(F.lower(severity), K.SEVERITY_WEIGHTS, F.lit(35))


def known_severity(severity: Column) -> Column:
    level = F.lower(severity)
    return F.when(level.isin(*[s for s, _ in K.SEVERITY_WEIGHTS]), level).otherwise("medium")


def hit_indicators(hits: DataFrame, rule_ord: int) -> DataFrame:
    """Indicators for signature hits, in rule-set order."""
    evidence = F.struct(
        "namespace", F.slice("strings", 1, 10).alias("matched_strings")
    )
    return hits.select(
        "doc_id",
        F.lit(rule_ord).alias("rule_ord"),
        F.col("sig_ord").alias("ord"),
        F.concat(F.lit("YARA_"), F.upper("rule")).alias("code"),
        F.concat(F.lit("Signature matched: "), "rule").alias("title"),
        known_severity(F.col("severity")).alias("severity"),
        severity_weight(F.col("severity")).alias("weight"),
        F.coalesce("category", F.lit("signature")).alias("category"),
        "mitre",
        F.to_json(evidence).alias("evidence"),
    )


