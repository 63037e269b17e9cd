"""Script inspection: tokens, obfuscation score, per-document summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.arrow import entropy, entropy_4dp
from papersieve.functions.text import literals
from papersieve.operators.ordered import running_before

_ESCAPES = r"\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|\\u[0-9A-Fa-f]{4}"
_CHARCODE = r"(?iU)fromCharCode\s*\("
_TINY_CONCAT = "(?U)[\"'][^\"']{0,4}[\"']\\s*\\+\\s*[\"']"
_LONG_STRING = "[\"'][A-Za-z0-9+/=%\\\\]{200,}[\"']"
_BASE64 = r"[A-Za-z0-9+/]{80,}={0,2}"
_IDENTIFIER = r"(?U)\b[_$a-zA-Z][_$a-zA-Z0-9]{0,40}\b"
_LINE_END = r"\R|[\x1c-\x1e]"


def suspicious_tokens(code: Column) -> Column:
    """Listed tokens that occur in the script, any case, in list order."""
    lowered = F.lower(code)
    return F.filter(
        literals(K.JS_SUSPICIOUS_TOKENS), lambda t: F.contains(lowered, F.lower(t))
    )


def obfuscation_signals(code: Column, bits: Column) -> Column:
    """The up to seven signal strengths of one script, unsorted."""
    length = F.greatest(F.length(code), F.lit(1)).cast("double")
    one = F.lit(1.0)
    escapes = F.regexp_count(code, F.lit(_ESCAPES))
    builders = F.regexp_count(code, F.lit(_CHARCODE))
    concats = F.regexp_count(code, F.lit(_TINY_CONCAT))
    packed = code.rlike(_LONG_STRING) | code.rlike(_BASE64)
    longest = F.array_max(F.transform(F.split(code, _LINE_END), F.length))
    names = F.regexp_extract_all(code, F.lit(_IDENTIFIER), F.lit(0))
    mangled = F.size(
        F.filter(names, lambda n: (F.length(n) <= 2) | F.startswith(n, F.lit("_0x")))
    )
    signals = F.array(
        F.least(one, escapes * 4 / length * 10),
        F.when(builders > 0, F.least(one, 0.4 + builders * 0.1)),
        F.when(concats > 5, F.least(one, concats / F.lit(40.0))),
        F.when(packed, F.lit(0.6)),
        F.when(bits > K.JS_HIGH_ENTROPY, F.least(one, (bits - K.JS_HIGH_ENTROPY) / 2)),
        F.when(longest > K.LONG_JS_LINE, F.least(one, longest / (K.LONG_JS_LINE * 5.0))),
        F.when(F.size(names) > 0, F.least(one, mangled / F.size(names).cast("double"))),
    )
    return F.filter(signals, lambda s: s.isNotNull())


def obfuscation_raw(code: Column, bits: Column) -> Column:
    """Mean of the four strongest signals, always over four; unrounded."""
    strongest = F.slice(F.reverse(F.array_sort(obfuscation_signals(code, bits))), 1, 4)
    total = F.aggregate(strongest, F.lit(0.0), lambda a, s: a + s)
    return F.when(F.length(code) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), total / 4)
    )


def obfuscation_score(code: Column, bits: Column) -> Column:
    return F.bround(obfuscation_raw(code, bits), 3)


def enrich_scripts(scripts: DataFrame) -> DataFrame:
    """Add tokens, entropy and obfuscation score to ``scripts`` (needs ``code``)."""
    raw = F.encode("code", "UTF-8")
    filled = F.length("code") > 0
    return (
        scripts.withColumn("_bits", entropy(raw))
        .withColumn("entropy", F.when(filled, entropy_4dp(raw)))
        .withColumn("suspicious_tokens", suspicious_tokens(F.col("code")))
        .withColumn("obfuscation_score", obfuscation_score(F.col("code"), F.col("_bits")))
        .drop("_bits")
    )


def critical_tokens(scripts: DataFrame) -> DataFrame:
    """Sorted exploit-primitive tokens per document, documents without any omitted.

    Each script contributes at most the 13 listed tokens and the set combines
    map-side, so the group is bounded by the list.
    """
    found = scripts.select(
        "doc_id",
        F.explode(
            F.array_intersect("suspicious_tokens", literals(K.JS_CRITICAL_TOKENS))
        ).alias("token"),
    )
    return found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("token")).alias("critical_tokens")
    )


def cve_hint_map(tokens: Column) -> Column:
    """Map token -> CVE for the tokens that have one."""
    hints = F.map_from_entries(
        F.array(*[F.struct(F.lit(t).alias("k"), F.lit(c).alias("v")) for t, c in K.JS_CVE_HINTS])
    )
    return F.map_filter(hints, lambda k, _: F.array_contains(tokens, k))


def script_summary(scripts: DataFrame) -> DataFrame:
    """Per document: script count, total length, worst score, tokens, locations.

    Expects enriched scripts with ``doc_id, ord, location, length``. One file's
    scripts are bounded by the extraction budget, so the ordered lists are too.
    """
    auto = (
        F.startswith("location", F.lit("/OpenAction"))
        | F.startswith("location", F.lit("/Names/JavaScript"))
        | F.startswith("location", F.lit("/Root/AA"))
    )
    place = F.struct(F.col("ord").alias("o"), F.col("location").alias("v"))
    names = lambda col: F.transform(
        F.slice(F.array_sort(col), 1, 10), lambda s: s["v"]
    )
    return (
        scripts.groupBy("doc_id")
        .agg(
            F.count("*").alias("script_count"),
            F.sum("length").alias("total_js_length"),
            F.coalesce(F.max("obfuscation_score"), F.lit(0.0)).alias("max_obfuscation"),
            F.array_sort(
                F.array_distinct(F.flatten(F.collect_list("suspicious_tokens")))
            ).alias("tokens"),
            F.collect_list(place).alias("_all"),
            F.collect_list(F.when(auto, place)).alias("_auto"),
        )
        .select(
            "doc_id",
            "script_count",
            "total_js_length",
            "max_obfuscation",
            F.array_sort(
                F.array_intersect("tokens", literals(K.JS_CRITICAL_TOKENS))
            ).alias("critical_tokens"),
            cve_hint_map(F.col("tokens")).alias("cve_hints"),
            names(F.col("_all")).alias("locations"),
            names(F.col("_auto")).alias("auto_locations"),
            (F.size("_auto") > 0).alias("auto_exec"),
        )
    )


def drop_repeated_sweeps(scripts: DataFrame) -> DataFrame:
    """Keep every targeted script; keep a sweep one only if its hash is new.

    Expects ``doc_id, sha256, stage ('targeted'|'sweep'), ord``. The first
    holder of each hash is found with a combining aggregate instead of a window,
    so a hash repeated across most rows is reduced before the shuffle.
    """
    order = F.struct(F.when(F.col("stage") == "targeted", 0).otherwise(1), F.col("ord"))
    first = scripts.groupBy("doc_id", "sha256").agg(F.min(order).alias("_first"))
    kept = scripts.where(F.col("stage") == "targeted")
    swept = scripts.where(F.col("stage") == "sweep").join(first, ["doc_id", "sha256"])
    return kept.unionByName(swept.where(F.col("_first") == order).drop("_first"))


def apply_script_budget(
    scripts: DataFrame, budget: int = K.MAX_SCRIPT_CHARS, order_by: Sequence[str] = ("ord",)
) -> DataFrame:
    """Stop adding scripts once the total before them exceeds ``budget``.

    Expects ``doc_id``, ``code`` and the columns of ``order_by``, unique within a
    document; adds ``length, truncated`` and clips ``code``.
    """
    sized = scripts.withColumn("length", F.length("code"))
    kept = running_before(sized, F.col("length").cast("long"), list(order_by), ["doc_id"], "_before")
    return (
        kept.where(F.col("_before") <= budget)
        .withColumn("truncated", F.col("length") > budget)
        .withColumn("code", F.left("code", F.lit(budget)))
        .drop("_before")
    )
