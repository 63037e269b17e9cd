"""Heuristic rules as data over per-document summaries.

A rule names the summary it reads, a condition and its evidence. All rules of
one summary are evaluated in a single projection that emits the firing ones, so
adding a rule adds an expression and no job.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.links import is_dangerous, is_risky
from papersieve.functions.scripts import script_summary
from papersieve.functions.text import attempt, case_map, let, literals
from papersieve.operators.signatures import hit_indicators

INDICATOR_COLUMNS = (
    "doc_id", "rule_ord", "ord", "code", "title", "severity", "weight", "category", "mitre",
    "evidence",
)
SOURCES = ("scripts", "actions", "attachments", "urls", "features", "structure", "errors")


@dataclass(frozen=True)
class Rule:
    """``fires``, ``severity``, ``weight`` and ``evidence`` build columns of the
    summary named by ``source``; constants are accepted for the middle two."""

    code: str
    title: str
    source: str
    fires: Callable[[], Column]
    severity: str | Callable[[], Column]
    weight: int | Callable[[], Column]
    category: str
    mitre: str | None = None
    evidence: Callable[[], Column] | None = None


_c = F.col

# Titles, severities, weights and categories are fixed values; order is rank.
BUNDLED: tuple[Rule, ...] = (
    Rule(
        "PDF_JS_PRESENT", "Document contains embedded JavaScript", "scripts",
        lambda: _c("script_count") > 0, "medium", 30, "active_content", "T1059.007",
        lambda: F.struct("script_count", _c("total_js_length").alias("total_length"), "locations"),
    ),
    Rule(
        "PDF_JS_AUTO_EXEC", "JavaScript executes automatically when the document is opened",
        "scripts", lambda: _c("auto_exec"), "high", 55, "active_content", "T1204.002",
        lambda: F.struct(_c("auto_locations").alias("locations")),
    ),
    Rule(
        "PDF_JS_OBFUSCATED", "Embedded JavaScript is heavily obfuscated", "scripts",
        lambda: _c("max_obfuscation") >= K.OBFUSCATED_AT,
        lambda: F.when(_c("max_obfuscation") >= K.HEAVILY_OBFUSCATED_AT, "high").otherwise("medium"),
        lambda: F.when(_c("max_obfuscation") >= K.HEAVILY_OBFUSCATED_AT, 55).otherwise(35),
        "obfuscation", "T1027",
        lambda: F.struct(_c("max_obfuscation").alias("obfuscation_score")),
    ),
    Rule(
        "PDF_JS_EXPLOIT_API", "JavaScript calls APIs associated with known exploits", "scripts",
        lambda: F.size("critical_tokens") > 0, "critical", 85, "exploit", "T1203",
        lambda: F.struct(_c("critical_tokens").alias("tokens"), "cve_hints"),
    ),
    Rule(
        "PDF_LAUNCH_ACTION", "Document declares a /Launch action", "actions",
        lambda: _c("launches") > 0, "critical", 85, "active_content", "T1204.002",
        lambda: F.struct(_c("launch_targets").alias("targets"), _c("launches").alias("count")),
    ),
    Rule(
        "PDF_AUTO_ACTION", "Document performs actions without user interaction", "actions",
        lambda: _c("autos") > 0, "low", 15, "active_content", "T1204.002",
        lambda: F.struct(_c("auto_actions").alias("actions")),
    ),
    Rule(
        "PDF_REMOTE_REFERENCE", "Document references an external or embedded document target",
        "actions", lambda: _c("remotes") > 0, "medium", 35, "network", "T1221",
        lambda: F.struct(_c("remote_targets").alias("targets")),
    ),
    Rule(
        "PDF_XFA_FORM", "Document uses an XFA (dynamic XML) form", "structure",
        lambda: _c("has_xfa"), "info", 0, "active_content",
    ),
    Rule(
        "PDF_EMBEDDED_EXECUTABLE", "An executable file is embedded in the document", "attachments",
        lambda: F.size("executables") > 0, "critical", 90, "embedded_file", "T1027.013",
        lambda: F.struct(_c("executables").alias("files")),
    ),
    Rule(
        "PDF_EMBEDDED_TYPE_MISMATCH", "Embedded file extension does not match its content",
        "attachments", lambda: F.size("mismatched") > 0, "high", 60, "embedded_file", "T1036.008",
        lambda: F.struct(_c("mismatched").alias("files")),
    ),
    Rule(
        "PDF_EMBEDDED_RISKY_FILE", "Document embeds an archive or macro-capable Office file",
        "attachments", lambda: F.size("risky_files") > 0, "medium", 40, "embedded_file",
        "T1027.013", lambda: F.struct(_c("risky_files").alias("files")),
    ),
    Rule(
        "PDF_EMBEDDED_HIGH_ENTROPY", "Embedded file appears encrypted or packed", "attachments",
        lambda: F.size("packed") > 0, "medium", 30, "embedded_file", "T1027.002",
        lambda: F.struct(_c("packed").alias("files")),
    ),
    Rule(
        "PDF_DANGEROUS_URI",
        "Document references a URI scheme that can execute code or leak credentials", "urls",
        lambda: F.size("dangerous_urls") > 0, "high", 60, "network", "T1187",
        lambda: F.struct(_c("dangerous_urls").alias("urls")),
    ),
    Rule(
        "PDF_RISKY_URL", "Document links to hosts with high-risk characteristics", "urls",
        lambda: _c("risky_count") > 0, "medium",
        lambda: F.when(_c("risky_count") < 3, 25).otherwise(40), "network", "T1566.002",
        lambda: F.struct("reasons", _c("risky_urls").alias("urls")),
    ),
    Rule(
        "PDF_NAME_OBFUSCATION", "PDF name objects use hex escapes to hide keywords", "features",
        lambda: _c("escaped_names") >= K.NAME_ESCAPES_MIN, "info", 0, "obfuscation", "T1027",
        lambda: F.struct(_c("escaped_names").alias("occurrences")),
    ),
    Rule(
        "PDF_MANY_INCREMENTAL_UPDATES", "Document has an unusual number of incremental updates",
        "features", lambda: _c("incremental_updates") >= K.MANY_UPDATES, "info", 0, "structure",
        None, lambda: F.struct(_c("incremental_updates").alias("updates")),
    ),
    Rule(
        "PDF_DATA_AFTER_EOF", "Significant data appended after the final %%EOF marker",
        "features", lambda: _c("eof_trailing_bytes") >= K.LARGE_TRAILING_BYTES, "medium", 35,
        "structure", "T1027.009", lambda: F.struct(_c("eof_trailing_bytes").alias("trailing_bytes")),
    ),
    Rule(
        "PDF_HEADER_OFFSET", "PDF header is not at the start of the file", "features",
        lambda: _c("header_offset") != 0, "medium", 40, "structure", "T1027",
        lambda: F.struct("header_offset"),
    ),
    Rule(
        "PDF_ENCRYPTED", "Document is encrypted", "structure", lambda: _c("is_encrypted"),
        "medium", 30, "structure", "T1027.013",
    ),
    Rule(
        "PDF_PARSE_FAILURE", "Document could not be fully parsed", "errors",
        lambda: F.size("fatal") > 0, "medium", 40, "structure", None,
        lambda: F.struct(_c("fatal").alias("errors")),
    ),
    Rule(
        "PDF_JBIG2_FILTER", "Document uses the JBIG2Decode filter", "features",
        lambda: F.coalesce(F.try_element_at("filters", F.lit("JBIG2Decode")), F.lit(0)) > 0,
        "medium", 30, "exploit", "T1203",
        lambda: F.struct(F.try_element_at("filters", F.lit("JBIG2Decode")).alias("count")),
    ),
    Rule(
        "PDF_MINIMAL_DOC_WITH_ACTIVE_CONTENT",
        "Nearly empty document that still carries active content", "structure",
        lambda: (_c("page_count") <= 1)
        & _c("has_active_content")
        & ~((_c("text_source") == "extracted") & (_c("text_chars") >= K.MINIMAL_TEXT_CHARS)),
        "high", 50, "structure", None,
        lambda: F.struct("page_count", _c("text_chars").alias("text_length")),
    ),
)
SIGNATURE_RULE_ORD = len(BUNDLED) + 1

_registered: list[Rule] = []


def register(rule: Rule) -> Rule:
    """Add a custom rule; it is applied after the bundled ones."""
    if rule.source not in SOURCES:
        raise ValueError(f"unknown summary {rule.source!r}; expected one of {SOURCES}")
    _registered.append(rule)
    return rule


def unregister(code: str) -> None:
    _registered[:] = [r for r in _registered if r.code != code]


def registered_rules() -> list[Rule]:
    return [*BUNDLED, *_registered]


def _limited(order: Column, value: Column, keep: Column, limit: int) -> Column:
    """Aggregate: the first ``limit`` kept values of a document, in order."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(F.slice(rows, 1, limit), lambda s: s["v"])


def action_summary(actions: DataFrame) -> DataFrame:
    kind, order = F.col("kind"), F.col("ord")
    launch = kind == "/Launch"
    auto = F.col("auto_executes") & ~kind.isin("/Launch", "/JavaScript")
    remote = kind.isin("/GoToR", "/GoToE", "/SubmitForm")
    has_target = F.coalesce(F.col("target"), F.lit("")) != ""
    return actions.groupBy("doc_id").agg(
        F.count_if(launch).alias("launches"),
        _limited(order, F.col("target"), launch & has_target, 5).alias("launch_targets"),
        F.count_if(auto).alias("autos"),
        _limited(order, F.struct("kind", "trigger"), auto, 10).alias("auto_actions"),
        F.count_if(remote).alias("remotes"),
        _limited(order, F.struct("kind", "target"), remote, 10).alias("remote_targets"),
        F.coalesce(F.bool_or("auto_executes"), F.lit(False)).alias("any_auto"),
    )


def attachment_summary(attachments: DataFrame) -> DataFrame:
    ext = F.coalesce("extension", F.lit(""))
    magic = F.col("magic_bytes")
    want = case_map(ext, K.EXPECTED_MAGIC)
    runs = ext.isin(*K.EXECUTABLE_EXTENSIONS) | F.coalesce(magic, F.lit("")).isin(*K.EXECUTABLE_MAGIC)
    odd = want.isNotNull() & magic.isNotNull() & (magic != want)
    risky = ext.isin(*K.ARCHIVE_EXTENSIONS, *K.OFFICE_MACRO_EXTENSIONS)
    packed = (F.col("entropy") >= K.HIGH_ENTROPY) & (F.col("size") > 2048)
    named = F.struct("name", "extension", F.col("magic_bytes").alias("magic"), "size")
    order = F.col("ord")
    return attachments.groupBy("doc_id").agg(
        _limited(order, named, runs, 10).alias("executables"),
        _limited(order, F.struct("name", "extension", F.col("magic_bytes").alias("magic")), odd, 10).alias("mismatched"),
        _limited(order, F.struct("name", "extension", "size"), risky, 10).alias("risky_files"),
        _limited(order, F.struct("name", "entropy"), packed, 10).alias("packed"),
    )


def url_summary(urls: DataFrame) -> DataFrame:
    reasons = ("ip_literal", "shortener", "punycode", "suspicious_tld")
    flags = ("is_ip_literal", "is_shortener", "is_punycode", "suspicious_tld")
    counted = urls.groupBy("doc_id").agg(
        _limited(F.col("ord"), F.col("url"), is_dangerous(F.col("scheme")), 10).alias(
            "dangerous_urls"
        ),
        F.count_if(is_risky()).alias("risky_count"),
        _limited(F.col("ord"), F.col("url"), is_risky(), 10).alias("risky_urls"),
        *[F.count_if(f).alias(f"_{r}") for r, f in zip(reasons, flags)],
    )
    counts = F.map_from_arrays(literals(reasons), F.array(*[f"_{r}" for r in reasons]))
    return counted.withColumn("reasons", F.map_filter(counts, lambda _, n: n > 0)).drop(
        *[f"_{r}" for r in reasons]
    )


def error_summary(errors: DataFrame) -> DataFrame:
    fatal = F.startswith("message", F.lit("open failed")) | F.startswith(
        "message", F.lit("walk failed")
    )
    return errors.groupBy("doc_id").agg(
        _limited(F.col("message"), F.col("message"), fatal, 5).alias("fatal"),
        F.count("*").alias("n_errors"),
    )


SUMMARIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "scripts": script_summary,
    "actions": action_summary,
    "attachments": attachment_summary,
    "urls": url_summary,
    "features": lambda features: features,
    "structure": lambda structure: structure,
    "errors": error_summary,
}


class Evidence:
    """Findings tables of a scan: those of ``SOURCES`` and ``hits``, as attributes.

    ``features`` and ``structure`` have one row per document: what comes from its bytes
    alone, and that with the object graph's facts. A table may be given as a call that
    makes it; that runs when the table is asked for.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if odd := set(tables) ^ {*SOURCES, "hits"}:
            raise TypeError(f"tables missing or unknown: {sorted(odd)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in (*SOURCES, "hits"):
            raise AttributeError(name)
        table = self._tables[name]
        return table if isinstance(table, DataFrame) else table()

    def summary(self, source: str) -> DataFrame:
        """The table that the rules of ``source`` read."""
        return SUMMARIES[source](getattr(self, source))


def _as_column(value) -> Column:
    return value() if callable(value) else F.lit(value)


def _emission(rule: Rule, rank: int) -> Column:
    evidence = F.to_json(rule.evidence()) if rule.evidence else F.lit("{}")
    return F.when(
        rule.fires(),
        F.struct(
            F.lit(rank).alias("rule_ord"),
            F.lit(rule.code).alias("code"),
            F.lit(rule.title).alias("title"),
            _as_column(rule.severity).alias("severity"),
            _as_column(rule.weight).cast("int").alias("weight"),
            F.lit(rule.category).alias("category"),
            F.lit(rule.mitre).cast("string").alias("mitre"),
            evidence.alias("evidence"),
        ),
    )


def _usable(summary: DataFrame, rules: Sequence[tuple[int, Rule]]) -> list[tuple[Rule, Column]]:
    """Emissions of the rules that resolve; a broken rule is reported and skipped."""
    out = []
    for rank, rule in rules:
        try:
            column = _emission(rule, rank)
            summary.select(column).schema  # noqa: B018 - forces analysis
        except AnalysisException as problem:
            warnings.warn(f"rule {rule.code} skipped: {str(problem).splitlines()[0]}", stacklevel=2)
            continue
        out.append((rule, column))
    return out


_NOTHING = (
    "struct<rule_ord:int,code:string,title:string,severity:string,weight:int,category:string,"
    "mitre:string,evidence:string>"
)


def apply_rules(summary: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """What every rule said about each row of one summary table.

    Indicator rows of the rules that fire, and a row with ``failed_rule`` for each
    rule whose evaluation failed on a row; its other rows and the other rules are
    not touched by that.
    """
    usable = _usable(summary, rules)
    if not usable:
        said = F.array(F.struct(F.lit(None).cast("string").alias("failed_rule"), F.lit(None).cast(_NOTHING).alias("i")))
    else:
        tried = [
            # A rule that is silent gives a struct around null; one that fails gives null.
            let(
                attempt(F.struct(column.alias("i"))),
                lambda got, code=rule.code: F.struct(
                    F.when(got.isNull(), code).alias("failed_rule"), got["i"].alias("i")
                ),
            )
            for rule, column in usable
        ]
        said = F.array(*tried)
    return (
        summary.select("doc_id", F.explode(said).alias("s"))
        .where(F.col("s.i").isNotNull() | F.col("s.failed_rule").isNotNull())
        .select("doc_id", "s.i.*", "s.failed_rule")
        .withColumn("ord", F.lit(0))
        .select(*INDICATOR_COLUMNS, "failed_rule")
    )


def evaluated(evidence: Evidence, rules: Sequence[Rule] | None = None) -> DataFrame:
    """All indicators of all documents, signatures last, and the rules that failed
    on a document as rows with ``failed_rule``."""
    chosen = list(enumerate(registered_rules() if rules is None else rules, start=1))
    # Custom rules rank after the signature bridge.
    ranked = [(n if n < SIGNATURE_RULE_ORD else n + 1, r) for n, r in chosen]
    out = hit_indicators(evidence.hits, SIGNATURE_RULE_ORD).select(
        *INDICATOR_COLUMNS, F.lit(None).cast("string").alias("failed_rule")
    )
    for name in SOURCES:
        mine = [(n, r) for n, r in ranked if r.source == name]
        if mine:
            out = out.unionByName(apply_rules(evidence.summary(name), mine))
    return out


def fired(said: DataFrame) -> DataFrame:
    """Indicators among the rows of :func:`evaluated`."""
    return said.where("failed_rule IS NULL").select(*INDICATOR_COLUMNS)


def failures(said: DataFrame) -> DataFrame:
    """Error rows of the rules that failed: ``doc_id, stage, message``."""
    return said.where("failed_rule IS NOT NULL").select(
        "doc_id", F.lit("rules").alias("stage"), F.concat(F.lit("rule failed: "), "failed_rule").alias("message")
    )


def indicators(evidence: Evidence, rules: Sequence[Rule] | None = None) -> DataFrame:
    """All indicators of all documents."""
    return fired(evaluated(evidence, rules))
