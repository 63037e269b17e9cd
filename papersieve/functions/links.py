"""URL sweep and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.text import let, literals, utf8_of

_STOP = "[^\\s<>\"'\\\\)\\]}]{3,2048}"
URL_PATTERN = (
    "(?i)(?:https?|ftp|file|smb|javascript|data|vbscript|ms-msdt|search-ms)://" + _STOP
)
UNC_PATTERN = "\\\\\\\\[A-Za-z0-9._-]{2,}\\\\[^\\s<>\"']{1,255}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9a-fA-F]{1,4}"
IPV6 = (
    f"(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}"
    f"|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}"
    f"|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}"
    f"|{_H}:(?::{_H}){{1,6}}|:(?:(?::{_H}){{1,7}}|:)"
    f"|(?:{_H}:){{6}}{IPV4}|::(?:ffff(?::0{{1,4}})?:)?{IPV4}"
    f"|(?:{_H}:){{1,4}}:{IPV4})"
)
URL_TYPE = (
    "struct<url:string,scheme:string,host:string,is_ip_literal:boolean,"
    "is_shortener:boolean,is_punycode:boolean,suspicious_tld:boolean,port:int>"
)


def trim_url(url: Column) -> Column:
    """Outer whitespace, then outer brackets and quotes, removed."""
    bare = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(bare, "^[()<>\\[\\]{}\"']+|[()<>\\[\\]{}\"']+$", "")


def classify(url: Column) -> Column:
    """Struct of URL traits, null for text that is not usable as a URL.

    Splits by pattern rather than with the built-in URL parser, which rejects
    hosts with underscores and leaves case and IPv6 brackets alone. Each step is
    bound once, so later steps do not repeat the work of earlier ones.
    """
    return let(trim_url(url), lambda u: let(_authority(u), _traits))


def _authority(url: Column) -> Column:
    clean = F.regexp_replace(url, r"[\t\r\n]", "")
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    return let(
        clean,
        lambda c: F.struct(
            url.alias("url"),
            F.lower(F.regexp_extract(c, pattern, 1)).alias("scheme"),
            F.regexp_extract(c, pattern, 2).alias("netloc"),
            F.substring_index(F.regexp_extract(c, pattern, 2), "@", -1).alias("hostinfo"),
        ),
    )


def _traits(part: Column) -> Column:
    netloc, hostinfo = part["netloc"], part["hostinfo"]
    bracketed = F.contains(hostinfo, F.lit("["))
    host = F.lower(
        F.when(bracketed, F.regexp_extract(hostinfo, r"\[([^\]]*)\]?", 1)).otherwise(
            F.substring_index(hostinfo, ":", 1)
        )
    )
    port_text = F.when(
        bracketed, F.regexp_extract(hostinfo, r"\][^:]*:(.*)$", 1)
    ).otherwise(F.regexp_extract(hostinfo, r"^[^:]*:(.*)$", 1))
    balanced = F.contains(netloc, F.lit("[")) == F.contains(netloc, F.lit("]"))
    tlds = literals(K.SUSPICIOUS_TLDS)
    described = let(
        F.struct(
            host.alias("host"),
            host.rlike(f"^{IPV6}(?:%.+)?$").alias("v6"),
            F.when(port_text.rlike("^[0-9]{1,5}$"), port_text.cast("int")).alias("port"),
        ),
        lambda h: F.when(
            ~bracketed | h["v6"],
            F.struct(
                F.left(part["url"], F.lit(2048)).alias("url"),
                part["scheme"].alias("scheme"),
                h["host"].alias("host"),
                (h["host"].rlike(f"^{IPV4}$") | h["v6"]).alias("is_ip_literal"),
                h["host"].isin(*K.URL_SHORTENER_HOSTS).alias("is_shortener"),
                (
                    F.startswith(h["host"], F.lit("xn--"))
                    | F.contains(h["host"], F.lit(".xn--"))
                ).alias("is_punycode"),
                F.exists(tlds, lambda t: F.endswith(h["host"], t)).alias("suspicious_tld"),
                F.when(h["port"] <= 65535, h["port"]).alias("port"),
            ),
        ),
    )
    return F.when((F.length(part["url"]) >= 4) & balanced, described)


def _unc(url: Column) -> Column:
    no = F.lit(False)
    return F.struct(
        F.left(url, F.lit(2048)).alias("url"),
        F.lit("unc").alias("scheme"),
        F.split(url, r"\\")[2].alias("host"),
        no.alias("is_ip_literal"),
        no.alias("is_shortener"),
        no.alias("is_punycode"),
        no.alias("suspicious_tld"),
        F.lit(None).cast("int").alias("port"),
    )


def sweep(text: Column, limit: int | None = None, bytes_view: bool = True) -> Column:
    """Distinct URL then UNC findings of a text in order, at most ``limit`` if one is given.

    Stays inside the row: no explode, no shuffle.
    """
    read = utf8_of if bytes_view else (lambda c: c)
    urls = F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0)), read)
    )
    shares = F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(UNC_PATTERN), F.lit(0)), read)
    )
    found = F.concat(
        F.filter(F.transform(urls, classify), lambda u: u.isNotNull()).cast(f"array<{URL_TYPE}>"),
        F.transform(shares, _unc).cast(f"array<{URL_TYPE}>"),
    )
    return found if limit is None else F.slice(found, 1, limit)


def swept_urls(
    rows: DataFrame, text: Column, source: str, limit: int | None = None, bytes_view: bool = True
) -> DataFrame:
    """Long table ``doc_id, ord, url.., source`` from a text column."""
    return rows.select(
        "doc_id", F.posexplode(sweep(text, limit, bytes_view)).alias("ord", "u")
    ).select("doc_id", "ord", "u.*", F.lit(source).alias("source"))


def merge_urls(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per (document, URL); a specific source beats the raw sweep.

    Expects ``group_rank`` (0 actions, 1 scripts, 2 raw) and ``ord``. Repeats
    are reduced map-side; a ``limit`` per document is a rank filter Spark prunes
    before the shuffle.
    """
    first_seen = F.struct("group_rank", "ord")
    preferred = F.struct(
        F.when(F.col("source") == "raw", 1).otherwise(0), F.col("group_rank"), F.col("ord")
    )
    traits = F.struct(
        "scheme", "host", "source", "is_ip_literal", "is_shortener", "is_punycode",
        "suspicious_tld", "port",
    )
    one = groups.groupBy("doc_id", "url").agg(
        F.min(first_seen).alias("_seen"), F.min_by(traits, preferred).alias("t")
    )
    place = Window.partitionBy("doc_id").orderBy("_seen", "url")
    ranked = one.withColumn("ord", F.row_number().over(place))
    if limit is not None:
        ranked = ranked.where(F.col("ord") <= limit)
    return ranked.select("doc_id", "ord", "url", "t.*")


def is_dangerous(scheme: Column) -> Column:
    return scheme.isin(*K.DANGEROUS_URI_SCHEMES, "unc")


def is_risky() -> Column:
    return (
        F.col("is_ip_literal")
        | F.col("is_shortener")
        | F.col("is_punycode")
        | F.col("suspicious_tld")
    )


def risk_reasons(urls: DataFrame) -> DataFrame:
    """Per document: risky URL count and the non-zero count of each reason."""
    risky = urls.where(is_risky())
    counted = risky.groupBy("doc_id").agg(
        F.count("*").alias("risky_urls"),
        F.count_if("is_ip_literal").alias("ip_literal"),
        F.count_if("is_shortener").alias("shortener"),
        F.count_if("is_punycode").alias("punycode"),
        F.count_if("suspicious_tld").alias("suspicious_tld"),
    )
    names = ("ip_literal", "shortener", "punycode", "suspicious_tld")
    reasons = F.map_from_arrays(literals(names), F.array(*names))
    return counted.select(
        "doc_id", "risky_urls", F.map_filter(reasons, lambda _, n: n > 0).alias("reasons")
    )


def url_flags() -> Column:
    """Ordered flag names of one URL row, with the scheme when it is not http(s)."""
    web = F.col("scheme").isin("http", "https")
    flags = F.array(
        F.when(F.col("is_ip_literal"), "ip_literal"),
        F.when(F.col("is_shortener"), "shortener"),
        F.when(F.col("is_punycode"), "punycode"),
        F.when(F.col("suspicious_tld"), "suspicious_tld"),
        F.when(~web, F.concat(F.lit("scheme:"), F.col("scheme"))),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def prioritised(urls: DataFrame, limit: int | None = 25) -> DataFrame:
    """The ``limit`` most interesting URLs per document, risky ones first; None ranks all."""
    interesting = is_risky() | ~F.col("scheme").isin("http", "https")
    order = Window.partitionBy("doc_id").orderBy(interesting.desc(), "url")
    ranked = urls.withColumn("place", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("place") <= limit)
