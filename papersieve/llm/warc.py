"""WARC archives: captures written as transactions, read back and assembled again.

A capture is three records: the request, the response (or a revisit that points
to an earlier response with the same payload) and a metadata record. Request and
metadata name the response in ``WARC-Concurrent-To``; assembly joins on that.

Archives are written by Spark's text writer with the record separator as line
separator, gzipped, so tasks write wherever the session's file system points,
and committed like any Spark output. They are read by the text reader with the
same separator: a record is put together from the pieces that its
``Content-Length`` asks for, so payloads may hold the separator, and a reader
never holds more than one record. Archives to be read are gzipped (any number of
members) or no larger than ``spark.sql.files.maxPartitionBytes``.

Edge cases: null html is an empty payload; a null url or page id leaves its
header out; line breaks in urls are percent-encoded; repeated rows are captures
of their own, of which one can be the response of the others; an empty table
gives an empty archive; records of other types, foreign ones too, are read and
kept by ``read_records`` and ignored by ``assemble``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm.common import scratch, written

SEPARATOR = "\r\n\r\n"
BREAK = "\r\n"
# A payload shorter than this is always stored.
LEAST_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_id``, written once.

    Record ids are drawn at random, so the rows are stored before anything
    refers to them.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"),
        F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"),
    )
    return written(rows, "captures")


def with_originals(rows: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``rows`` with ``original``: the record id that a revisit refers to, else null.

    The smallest page id of each payload comes from a combining aggregate over
    digests alone. Only payloads that occur more than once are joined back.
    """
    first = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(
            F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("f"),
            F.count("*").alias("n"),
        )
        .filter("n > 1")
        .select("payload_digest", F.col("f.record_id").alias("first_id"))
    )
    return rows.join(first, "payload_digest", "left").withColumn(
        "original",
        F.when(
            (F.col("payload_bytes") >= least) & (F.col("first_id") != F.col("record_id")),
            F.col("first_id"),
        ),
    ).drop("first_id")


def _header(*fields: tuple[str, Column]) -> Column:
    """``Name: value`` lines; a null value leaves its line out."""
    return F.concat_ws(
        BREAK,
        F.lit("WARC/1.1"),
        *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields],
    )


def records(rows: DataFrame) -> DataFrame:
    """One ``record`` string for each record of each capture, without its closing separator."""
    url = F.replace(
        F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")
    )
    revisit = F.col("original").isNotNull()
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(SEPARATOR),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    request = F.concat(
        F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{SEPARATOR}")
    )
    about = F.concat_ws(
        BREAK,
        F.concat(F.lit("page-id: "), F.col("page_id").cast("string")),
        F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string")),
    )

    def record(kind: Column, identity: Column, block: Column, media: str, *more) -> Column:
        head = _header(
            ("WARC-Type", kind),
            ("WARC-Record-ID", identity),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", url),
            *more,
            ("Content-Type", F.lit(media)),
            ("Content-Length", F.octet_length(block)),
        )
        return F.concat(head, F.lit(SEPARATOR), block)

    def related(suffix: str) -> Column:
        return F.replace(F.col("record_id"), F.lit(">"), F.lit(f"-{suffix}>"))

    concurrent = ("WARC-Concurrent-To", F.col("record_id"))
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    return rows.select(
        F.explode(
            F.array(
                record(F.lit("request"), related("q"), request, "application/http;msgtype=request", concurrent),
                record(
                    kind, F.col("record_id"), body, "application/http;msgtype=response",
                    ("WARC-Payload-Digest", digest),
                    ("WARC-Refers-To", F.col("original")),
                    ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
                ),
                record(F.lit("metadata"), related("m"), about, "application/warc-fields", concurrent),
            )
        ).alias("record")
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write every page as a transaction into gzipped archives under ``path``.

    Each task writes what the join for originals dealt to it: adaptive execution
    sizes those parts by bytes and splits that of a payload that very many pages
    share, so the html is shuffled once and archives are of even size.
    """
    rows = with_originals(captures(pages))
    records(rows).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


RECORD_SCHEMA = pa.schema(
    [
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("concurrent_to", pa.string()),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("declared_digest", pa.string()),
        ("http_header", pa.binary()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
    ]
)
RECORD_DDL = (
    "record_type string, record_id string, concurrent_to string, refers_to string, "
    "target_uri string, declared_digest string, http_header binary, payload binary, "
    "payload_bytes long, payload_sha256 string"
)


def parse_header(block: bytes) -> dict[str, str]:
    """Named fields of a header block, names in lower case; the first of a name counts."""
    fields: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(
                name.strip().lower().decode("utf-8", "replace"),
                value.strip().decode("utf-8", "replace"),
            )
    return fields


def assembled_blocks(pieces: Iterator[bytes | None]) -> Iterator[tuple[bytes, bytes]]:
    """``(header, block)`` of each record in the pieces between separators; None ends a file.

    A block is cut from the byte stream: pieces are joined with the separator until
    the declared length is reached. The reader splits at the leftmost separator, so
    behind a block that ends with a line break the next header comes with what is left
    of the closing separator; it is handed back as the start of the next record. A
    header without a usable length, or a block that does not end with a separator,
    gives up its record; reading goes on at the next piece that begins like a header.
    """
    gap = SEPARATOR.encode()
    ahead: bytes | None = None
    while True:
        if ahead is not None:
            header, ahead = ahead, None
        else:
            try:
                header = next(pieces)
            except StopIteration:
                return
        if header is None or not header.startswith(b"WARC/"):
            continue
        declared = parse_header(header).get("content-length", "")
        if not (declared.isascii() and declared.isdigit()):
            continue
        want, parts, have = int(declared), [], -len(gap)
        for piece in pieces:
            if piece is None:
                break
            parts.append(piece)
            have += len(gap) + len(piece)
            if have >= want:
                break
        if have < want:
            continue
        block = gap.join(parts)
        if have > want:
            rest = block[want:]
            if not rest.startswith(gap):
                continue
            block, ahead = block[:want], rest[len(gap) :]
        yield header, block


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; ``payloads=False`` leaves out
    the payload bytes but not their length and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush():
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, RECORD_SCHEMA)], schema=RECORD_SCHEMA
            )

        def flat():
            last = None
            for batch in batches:
                for piece, file in zip(batch.column(0), batch.column(1).to_pylist()):
                    if last is not None and file != last:
                        yield None
                    last = file
                    yield piece.as_py()

        for header, block in assembled_blocks(flat()):
            fields = parse_header(header)
            kind = fields.get("warc-type", "")
            http, payload = b"", block
            if fields.get("content-type", "").startswith("application/http"):
                http, _, payload = block.partition(b"\r\n\r\n")
            rows.append(
                (
                    kind,
                    fields.get("warc-record-id"),
                    fields.get("warc-concurrent-to"),
                    fields.get("warc-refers-to"),
                    fields.get("warc-target-uri"),
                    fields.get("warc-payload-digest"),
                    http,
                    payload if payloads or kind == "metadata" else None,
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                )
            )
            held += len(payload)
            if held > 8 << 20 or len(rows) >= 2_000:
                yield flush()
                rows.clear()
                held = 0
        if rows:
            yield flush()

    pieces = spark.read.option("lineSep", SEPARATOR).text(path)
    return pieces.select(
        F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file")
    ).mapInArrow(run, RECORD_DDL)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, response, request, metadata``.

    Responses and revisits are joined with the request and the metadata record
    that name them in ``WARC-Concurrent-To``. Should several of a kind name the
    same one, the smallest record id counts.
    """
    fields = [c for c in rows.columns if c != "concurrent_to"]

    def named(kind: str) -> DataFrame:
        nested = F.struct("record_id", *[c for c in fields if c != "record_id"])
        return (
            rows.filter((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
            .groupBy("concurrent_to")
            .agg(F.min_by(nested, F.col("record_id")).alias(kind))
            .withColumnRenamed("concurrent_to", "record_id")
        )

    main = rows.filter(F.col("record_type").isin("response", "revisit")).select(
        "record_id", F.struct(*fields).alias("response")
    )
    return main.join(named("request"), "record_id", "left").join(
        named("metadata"), "record_id", "left"
    )


def _number(name: str) -> Column:
    """A whole number among the fields of the metadata record."""
    text = F.col("metadata.payload").cast("string")
    found = F.regexp_extract(text, rf"(?:^|\r\n){name}: (-?\d+)", 1)
    return F.when(found != "", found.cast("long"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the archives."""
    nested = assemble(read_records(spark, path, payloads=False))
    rows = written(
        nested.select(
            _number("page-id").alias("page_id"),
            F.col("record_id"),
            F.col("response.record_type").alias("record_type"),
            F.col("response.refers_to").alias("original"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_sha256").alias("payload_digest"),
        ),
        "assembled",
    )
    responses = rows.filter("record_type = 'response'").select(
        F.col("record_id").alias("original"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("stored_bytes"),
        F.col("payload_digest").alias("stored_digest"),
    )
    # Only responses that a revisit refers to are joined; a popular one is a hot key of
    # narrow rows, which adaptive execution splits.
    used = responses.join(
        rows.filter("original IS NOT NULL").select("original").distinct(), "original", "left_semi"
    )
    return rows.join(used, "original", "left").select(
        "page_id",
        F.coalesce("stored_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("stored_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return their digest."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return digest(pages.sparkSession, path)
