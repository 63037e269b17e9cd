"""Byte-level features of files: hashes, header, end markers, keyword counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.arrow import byte_profile
from papersieve.functions.text import count_of, latin1, literals


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def md5_hex(content: Column) -> Column:
    return F.md5(content)


def magic_type(content: Column) -> Column:
    """Coarse type from the first 16 bytes; first matching prefix wins."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for prefix, label in K.MAGIC_SIGNATURES:
        test = F.startswith(head, F.lit(prefix))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def decode_name_escapes(text: Column) -> Column:
    """Resolve ``#hh`` in the byte-per-character view, each exactly once."""
    pieces = F.regexp_extract_all(text, F.lit(r"#[0-9A-Fa-f]{2}|[^#]+|#"), F.lit(0))
    resolved = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"^#[0-9A-Fa-f]{2}$"),
            F.decode(F.unhex(F.substring(p, 2, 2)), "ISO-8859-1"),
        ).otherwise(p),
    )
    return F.array_join(resolved, "")


def header_position(content: Column) -> Column:
    """0-based offset of the header in the first 1024 bytes, -1 when absent."""
    head = latin1(F.substring(content, 1, K.HEADER_SEARCH_BYTES))
    return (F.instr(head, K.PDF_HEADER) - 1).cast("int")


def has_header(content: Column) -> Column:
    return header_position(content) >= 0


def pdf_version(content: Column) -> Column:
    at = header_position(content)
    raw = latin1(F.substring(content, at + 1 + len(K.PDF_HEADER), F.lit(3)))
    ascii_only = F.regexp_replace(raw, r"[^\x00-\x7F]", "")
    return F.when(at >= 0, F.regexp_replace(ascii_only, r"^\s+|\s+$", ""))


def eof_count(text: Column) -> Column:
    return count_of(text, K.PDF_EOF)


def incremental_updates(text: Column) -> Column:
    return F.greatest(F.lit(0), eof_count(text) - 1)


def trailing_bytes(text: Column) -> Column:
    """Bytes after the last end marker, surrounding whitespace not counted."""
    tail = F.substring_index(text, K.PDF_EOF, -1)
    stripped = F.regexp_replace(tail, r"^[\r\n \t]+|[\r\n \t]+$", "")
    return F.when(F.contains(text, F.lit(K.PDF_EOF)), F.length(stripped)).otherwise(0)


def escaped_name_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"/[A-Za-z0-9]*#[0-9A-Fa-f]{2}"))


def object_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?<!\d)\d+\s+\d+\s+obj(?![A-Za-z0-9_])"))


def stream_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])stream(?![A-Za-z0-9_])"))


def nonzero_map(names, hits: Column) -> Column:
    counts = F.map_from_arrays(literals(names), hits)
    return F.map_filter(counts, lambda _, v: v > 0)


def with_derived_counts(keyword_counts: Column, escaped: Column, eofs: Column) -> Column:
    """Keyword map plus the two derived counters, which are kept even at zero."""
    return F.map_concat(
        keyword_counts,
        F.create_map(
            F.lit("__obfuscated_names__"), escaped, F.lit("__eof_markers__"), eofs
        ),
    )


def byte_features(
    files: DataFrame, extras: Callable[[Column, Column], dict[str, Column]] | None = None
) -> DataFrame:
    """One feature row per file; drops ``content`` so nothing later carries it.

    Expects ``doc_id`` and ``content``. Narrow: no shuffle, one Arrow pass.
    ``extras`` adds columns computed from the byte-per-character text and its
    lower-cased form in the same pass, so that the bytes are read once for all.
    """
    text = F.col("t")
    more = extras(text, F.col("low")) if extras else {}
    position = header_position(F.col("content"))
    shown = files.select("doc_id", "content", latin1(F.col("content")).alias("t"))
    wide = shown.select("doc_id", "content", "t", F.lower("t").alias("low")).select(
        "doc_id",
        sha256_hex(F.col("content")).alias("sha256"),
        md5_hex(F.col("content")).alias("md5"),
        F.octet_length("content").cast("long").alias("file_size"),
        magic_type(F.col("content")).alias("detected_type"),
        (position >= 0).alias("has_header"),
        F.greatest(F.lit(0), position).alias("header_offset"),
        pdf_version(F.col("content")).alias("pdf_version"),
        eof_count(text).alias("eof_count"),
        trailing_bytes(text).alias("eof_trailing_bytes"),
        byte_profile(F.col("content")).alias("p"),
        *[c.alias(n) for n, c in more.items()],
    )
    eofs = F.col("eof_count")
    keywords = nonzero_map(K.PDF_KEYWORDS, F.col("p.keyword_hits"))
    return wide.select(
        "doc_id",
        "sha256",
        "md5",
        "file_size",
        "detected_type",
        "has_header",
        "header_offset",
        "pdf_version",
        "eof_count",
        F.greatest(F.lit(0), eofs - 1).alias("incremental_updates"),
        "eof_trailing_bytes",
        F.col("p.entropy").alias("entropy"),
        F.col("p.object_count").alias("object_count"),
        F.col("p.stream_count").alias("stream_count"),
        F.col("p.escaped_names").alias("escaped_names"),
        nonzero_map(K.STREAM_FILTERS, F.col("p.filter_hits")).alias("filters"),
        with_derived_counts(keywords, F.col("p.escaped_names"), eofs).alias(
            "keyword_counts"
        ),
        *more,
    )


def text_source(excerpt: Column, ocr_text: Column | None = None) -> Column:
    """Where a document's text came from: none, extracted or ocr."""
    base = F.when(F.length(F.trim(excerpt)) > 0, "extracted").otherwise("none")
    if ocr_text is None:
        return base
    return F.when(F.length(F.coalesce(ocr_text, F.lit(""))) > 0, "ocr").otherwise(base)


def text_excerpts(
    pages: DataFrame,
    page_limit: int = K.MAX_TEXT_PAGES,
    char_limit: int = K.MAX_TEXT_EXCERPT_CHARS,
) -> DataFrame:
    """First pages' text until ``char_limit`` is reached, whitespace collapsed.

    Expects ``doc_id, page (0-based), text``. The page filter comes before the
    grouping, so a group never holds more than ``page_limit`` pages.
    """
    first = pages.where(F.col("page") < page_limit)
    packed = first.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps")
    )
    # A page is read only while the pages before it hold fewer than char_limit.
    kept = F.aggregate(
        F.col("ps"),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept")),
        lambda acc, p: F.when(
            acc["n"] >= char_limit, acc
        ).otherwise(
            F.struct(
                (acc["n"] + F.length(p["text"])).alias("n"),
                F.array_append(acc["kept"], p["text"]).alias("kept"),
            )
        ),
    )["kept"]
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")
    return packed.select(
        "doc_id",
        F.left(F.regexp_replace(joined, r"\s+", " "), F.lit(char_limit)).alias("text_excerpt"),
    )
