"""Document files with the shapes that are hard to read, one per row of ``documents``.

:func:`hard_files` has deep and circular page trees, name trees and objects inside
compressed object streams, chained stream filters, a redefined object and an action
of an annotation. :func:`wide_files` has pages, annotations and links in numbers
that follow the id. What must be found in them is arithmetic on the id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papersieve.plans.inputs import table
from papersieve.session import spread

DEEP = 5_000
DEPTHS = (1, 3, 12, 3)


def depth_of(doc_id: int) -> int:
    return DEEP if doc_id % 50 == 7 else DEPTHS[doc_id % 4]


def _file(bodies: list[tuple[int, bytes]]) -> bytes:
    objects = b"".join(b"%d 0 obj\n%s\nendobj\n" % pair for pair in bodies)
    return b"%PDF-1.7\n" + objects + b"trailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF\n"


def _stream(data: bytes, keys: bytes, hexed: bool = False) -> bytes:
    data, names = zlib.compress(data), b"/FlateDecode"
    if hexed:
        data, names = data.hex().encode() + b">", b"/ASCIIHexDecode /FlateDecode"
    return b"<< /Length %d /Filter [%s] %s >>\nstream\n%s\nendstream" % (len(data), names, keys, data)


def hard_file(doc_id: int, text: str) -> bytes:
    depth, circular = depth_of(doc_id), doc_id % 4 == 3
    nodes = [2] + [1_000 + i for i in range(1, depth)]
    bodies = [(1, b"<< /Type /Catalog /Pages 2 0 R /Names << /JavaScript 50 0 R >> >>")]
    for node, below in zip(nodes, nodes[1:]):
        bodies.append((node, b"<< /Type /Pages /Kids [%d 0 R] >>" % below))
    bodies.append((nodes[-1], b"<< /Type /Pages /Kids [10 0 R 11 0 R%s] >>" % (b" 2 0 R" if circular else b"")))
    code = b"page(%d);" % doc_id + hashlib.md5(text.encode()).hexdigest().encode()
    first = b"<< /Kids [51 0 R] >>"
    head = b"50 0 51 %d " % (len(first) + 1)
    packed = head + first + b" << /Names [(a) 52 0 R] >>"
    bodies += [
        (10, b"<< /Type /Page /Parent 2 0 R /AA << /O 20 0 R >> >>"),
        (11, b"<< /Type /Page /Parent 2 0 R /Annots [30 0 R] >>"),
        (20, b"<< /S /JavaScript /JS 40 0 R >>"),
        (21, b"<< /S /URI /URI (http://replaced.example/) >>"),
        (30, b"<< /Type /Annot /Subtype /Widget /AA << /E 21 0 R >> >>"),
        (40, _stream(code, b"", hexed=doc_id % 2 == 1)),
        (52, b"<< /S /JavaScript /JS (names\\(%d\\)) >>" % doc_id),
        (60, _stream(packed, b"/Type /ObjStm /N 2 /First %d" % len(head))),
        (21, b"<< /S /Launch /F (tool%d.exe) >>" % doc_id),
    ]
    return _file(bodies)


def wide_file(doc_id: int, text: str) -> bytes:
    pages, notes, links = 2 + doc_id % 6, 1 + doc_id // 6 % 4, doc_id % 3
    bodies = [
        (1, b"<< /Type /Catalog /Pages 2 0 R /OpenAction 3 0 R >>"),
        (2, b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % (100 * p) for p in range(1, pages + 1))),
        (3, b"<< /S /JavaScript /JS (go; %s) >>" % b" ".join(b"http://s%dk%d.example/x" % (doc_id, k) for k in range(links))),
    ]
    for p in range(1, pages + 1):
        held = b" ".join(b"%d 0 R" % (100 * p + n) for n in range(1, notes + 1))
        bodies.append((100 * p, b"<< /Type /Page /Annots [%s] >>" % held))
        for n in range(1, notes + 1):
            # The telling part of the last page's targets lies beyond what is shown of one.
            far = b"y" * 600 if p == pages else b"y"
            target = b"file://h%dp%dn%d.example/%s" % (doc_id, p, n, far)
            bodies.append((100 * p + n, b"<< /Type /Annot /Subtype /Link /A << /S /URI /URI (%s) >> >>" % target))
    return _file(bodies)


def _files(spark: SparkSession, sf_dir: str, build: Callable[[int, str], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [build(i, t or "") for i, t in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"]
                )

    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.mapInArrow(run, "doc_id bigint, content binary")


def hard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, hard_file)


def wide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, wide_file)
