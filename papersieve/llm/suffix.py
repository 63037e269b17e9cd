"""Removal of repeated passages by merged Burrows-Wheeler transforms.

A byte goes when a string of ``MATCH`` bytes that covers it also starts in a
document with a smaller id. All such strings are found exactly:

1. Documents are packed into units of some megabytes, written once.
2. Every ``MATCH``-byte string is assigned to its anchor, the smallest hash among
   its ``GRAM``-byte substrings (leftmost of equals). Equal strings have equal
   anchors. Consecutive starts with one anchor form a snippet of at most
   ``2 * MATCH`` bytes, so a text is cut into snippets and no string is lost.
3. Anchors of each unit meet by hash; only snippets whose anchor occurs in two
   documents go on, each once per unit with the smallest document id.
4. Snippets meet by anchor. Those of one anchor that differ are dealt to shards;
   each shard's suffixes give a Burrows-Wheeler transform, and the transforms
   are merged by iterative interleave refinement: after k rounds the interleave
   is ordered by the first k bytes, and the round in which two neighbours part
   is their common prefix. Intervals that hold together for ``MATCH`` rounds are
   the repeats, and the smallest document id in each is its first home. Merging
   never compares or sorts suffixes of two shards.
5. The smallest ids return to the units, which mark and cut.

Work and memory: a task holds one unit, or what meets in one of the parts,
whose number grows with the input. A string that a third of all documents share
is one snippet per unit, and an anchor of very many units, which would gather
all that stands around such a string, is split by whole strings. Intermediate tables are files in the shared folder.

Edge cases: null and empty texts, and those shorter than ``MATCH``, lose
nothing; copies lose everything but the one with the smallest id; rows with the
same id never cut each other; a null id is larger than all others; texts may be
of any length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import input_bytes, parts_for, written

MATCH, GRAM = 50, 20
WINDOW = MATCH - GRAM + 1
UNIT_BYTES = 4 << 20
PART_BYTES = 12 << 20
SHARDS = 8
# An anchor in more units than this is met by whole strings: bounds what one anchor gathers.
HOT_UNITS = 256
# Suffixes merged at once: whole anchors are added until a batch is this large. All that a
# round reads then stays in a core's cache.
MERGE_SUFFIXES = 1 << 15
CHUNK = 1 << 16
NO_ID = np.iinfo(np.int64).max
# Multipliers of the rolling hash and of its mixing: odd 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM-byte string at each start of ``data``."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    return h16[:-4] * _power(4) + h4[16:]


def _hash_at(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes at each of ``starts``."""
    out = np.empty(len(starts), dtype=np.uint64)
    for lo in range(0, len(starts), 1 << 13):
        at = starts[lo : lo + (1 << 13)]
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            h = h * np.uint64(BASE) + data[at + k] + np.uint64(1)
        out[lo : lo + (1 << 13)] = _mix(h)
    return out


def anchors_of(data: np.ndarray) -> np.ndarray:
    """Place of the anchor of the MATCH-byte string at each start of ``data``."""
    starts = max(0, len(data) - MATCH + 1)
    out = np.empty(starts, dtype=np.int64)
    low = np.uint64((1 << 20) - 1)
    for begin in range(0, starts, CHUNK):
        stop = min(starts, begin + CHUNK)
        gram = _mix(_rolling(data[begin : stop + MATCH - 1]))
        # The place in the low bits makes the leftmost of equals the smallest.
        best, width = (gram & ~low) | np.arange(len(gram), dtype=np.uint64), 1
        while 2 * width <= WINDOW:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        rest = WINDOW - width
        best = np.minimum(best[: len(best) - rest], best[rest:])
        out[begin:stop] = begin + (best & low).astype(np.int64)
    return out


def snippets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(first, last, anchor, document)`` of each snippet: its first and last start, its
    anchor's hash, and the number of its document. ``ends`` are the documents' ends."""
    place = anchors_of(data)
    sizes = np.diff(np.r_[0, ends])
    document = np.repeat(np.arange(len(ends)), sizes)[: len(place)]
    inside = np.arange(len(place)) + MATCH <= ends[document]
    same = np.r_[False, (place[1:] == place[:-1]) & inside[:-1]]
    first = np.flatnonzero(inside & ~same)
    last = np.flatnonzero(inside & np.r_[~(same[1:] & inside[1:]), True][: len(place)])
    return first, last, _hash_at(data, place[first], GRAM), document[first]


def content_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each snippet: its first and its last MATCH bytes cover it whole."""
    heads, tails = _hash_at(data, first, MATCH), _hash_at(data, last, MATCH)
    return _mix(heads * np.uint64(MIX) + tails + (last - first).astype(np.uint64))


def part_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed block."""
    raw = [np.array([len(arrays)], dtype="<i8").tobytes()]
    for a in arrays:
        raw.append(np.array([a.nbytes], dtype="<i8").tobytes())
        raw.append(a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(block: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 8, []
    for kind in types:
        size = int(np.frombuffer(raw, "<i8", 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# --- units --------------------------------------------------------------------------------------

UNITS = "unit long, ids binary, ends binary, data binary, rest binary"


def units_of(df: DataFrame) -> DataFrame:
    """Pack ``df`` (``doc_id``, ``text``, and whatever else) into units; written once.

    ``rest`` holds the other columns in Arrow's stream format, in row order.
    Units come from scan order, so no text is shuffled; their ids are drawn in
    the task and stay as written.
    """
    names = df.columns
    id_at, text_at = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        unit = context.partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def close():
            table = pa.Table.from_batches(held)
            ids = pc.fill_null(table.column(id_at), int(NO_ID)).to_numpy()
            missing = pc.is_null(table.column(text_at)).to_numpy()
            texts = [
                b"" if x is None else x.encode("utf-8", "surrogatepass")
                for x in table.column(text_at).to_pylist()
            ]
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            rest = table.remove_column(text_at)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_table(rest)
            squeeze = zstandard.ZstdCompressor(level=3)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([unit], pa.int64()),
                    pa.array([_pack(ids, missing.astype(np.uint8))], pa.binary()),
                    pa.array([_pack(ends)], pa.binary()),
                    pa.array([squeeze.compress(b"".join(texts))], pa.binary()),
                    pa.array([squeeze.compress(sink.getvalue().to_pybytes())], pa.binary()),
                ],
                names=["unit", "ids", "ends", "data", "rest"],
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                held.append(part)
                size += part.column(text_at).nbytes
                if size >= UNIT_BYTES:
                    yield close()
                    unit, size, held = unit + 1, 0, []
        if held:
            yield close()

    return written(df.mapInArrow(run, UNITS), "units", codec="uncompressed")


class Candidates:
    """Snippets of a unit that may repeat, and the distinct ones among them.

    ``which`` gives the distinct snippet of each; ``head`` and ``low`` a
    representative and the smallest document id of each distinct one, and
    ``by_part`` the distinct ones of each part, ascending.
    """

    def __init__(self, data, first, last, anchor, doc, parts):
        self.first, self.last, self.anchor, self.doc = first, last, anchor, doc
        content = content_hashes(data, first, last)
        order = np.lexsort((content, anchor))
        a, c = anchor[order], content[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])][: len(order)]
        edges = np.flatnonzero(new)
        self.which = np.empty(len(order), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.head = order[edges]
        self.low = np.minimum.reduceat(doc[order], edges) if len(edges) else doc[:0]
        part = part_of(anchor[self.head], parts)
        by = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.r_[True, part[by][1:] != part[by][:-1]][: len(by)])
        self.by_part = [
            (int(part[by[lo]]), by[lo:hi]) for lo, hi in zip(cut, [*cut[1:], len(by)])
        ]


class Unit:
    """One unit's documents and snippets."""

    def __init__(self, row: dict, parts: int):
        self.ids, self.missing = _unpack(row["ids"], "<i8", "u1")
        (self.ends,) = _unpack(row["ends"], "<i8")
        raw = zstandard.ZstdDecompressor().decompress(row["data"])
        self.data = np.frombuffer(raw, dtype=np.uint8)
        self.parts = parts
        self.first, self.last, self.anchor, document = snippets(self.data, self.ends)
        self.doc = self.ids[document]
        order = np.argsort(self.anchor, kind="stable")
        ordered = self.anchor[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.distinct = ordered[heads]
        self.distinct_part = part_of(self.distinct, parts)
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        docs = self.doc[order]
        low = np.minimum.reduceat(docs, heads) if len(heads) else docs
        high = np.maximum.reduceat(docs, heads) if len(heads) else docs
        self.shared_here = low != high

    def anchors_by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        """``(part, places in distinct)``, ascending."""
        order = np.argsort(self.distinct_part, kind="stable")
        parts = self.distinct_part[order]
        edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
        for lo, hi in zip(edges, [*edges[1:], len(parts)]):
            yield int(parts[lo]), order[lo:hi]

    def candidates(self, shared_bits: dict[int, bytes], hot_bits: dict[int, bytes]) -> Candidates:
        """Snippets whose anchor occurs in two documents, here or elsewhere.

        Those of an anchor that very many units hold are cut into their single
        MATCH-byte strings, which meet by their own hash instead.
        """
        shared, hot = self.shared_here.copy(), np.zeros(len(self.distinct), dtype=bool)
        for part, places in self.anchors_by_part():
            for bits, flags in ((shared_bits, shared), (hot_bits, hot)):
                if part in bits:
                    found = np.unpackbits(np.frombuffer(bits[part], np.uint8), count=len(places))
                    flags[places] |= found.astype(bool)
        runs = np.flatnonzero(shared[self.group] & ~hot[self.group])
        first, last, anchor, doc = (x[runs] for x in (self.first, self.last, self.anchor, self.doc))
        split = np.flatnonzero(hot[self.group])
        if len(split):
            sizes = self.last[split] - self.first[split] + 1
            single = np.repeat(self.first[split], sizes) + _counting(sizes)
            first, last = np.r_[first, single], np.r_[last, single]
            anchor = np.r_[anchor, _hash_at(self.data, single, MATCH)]
            doc = np.r_[doc, np.repeat(self.doc[split], sizes)]
        return Candidates(self.data, first, last, anchor, doc, self.parts)


def _anchor_rows(units: DataFrame, parts: int) -> DataFrame:
    """``part, unit, anchors``: low halves of a unit's anchors in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, parts)
                found = [
                    (p, (unit.distinct[places] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                    for p, places in unit.anchors_by_part()
                ]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p for p, _ in found], pa.int32()),
                            pa.array([row["unit"]] * len(found), pa.int64()),
                            pa.array([b for _, b in found], pa.binary()),
                        ],
                        names=["part", "unit", "anchors"],
                    )

    return units.select("unit", "ids", "ends", "data").mapInArrow(
        run, "part int, unit long, anchors binary"
    )


REPLY = pa.schema([("unit", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("reply", pa.binary())])
# Kinds of replies: an anchor occurs elsewhere, in very many units; where strings first occur.
SHARED, HOT, HOME = 0, 1, 2
REPLY_DDL = "unit long, part int, kind int, reply binary"


def _meet(hot_units: int):
    """For each unit, a bit per anchor it sent: whether another unit sent it too, and
    whether more than ``hot_units`` did."""

    def run(rows: pa.Table) -> pa.Table:
        units = rows.column("unit").to_pylist()
        sent = [np.frombuffer(b, dtype="<u4") for b in rows.column("anchors").to_pylist()]
        part = rows.column("part")[0].as_py()
        found, counts = np.unique(np.concatenate(sent), return_counts=True)
        out = []
        for unit, anchors in zip(units, sent):
            times = counts[np.searchsorted(found, anchors)]
            for kind, least in ((SHARED, 2), (HOT, hot_units + 1)):
                if (times >= least).any():
                    out.append((unit, part, kind, np.packbits(times >= least).tobytes()))
        return pa.table([list(c) for c in zip(*out)] or [[]] * 4, schema=REPLY)

    return run


# --- merging ------------------------------------------------------------------------------------


def shard_transform(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, transform)`` of one shard's suffixes.

    ``symbols`` holds strings with a closing 0 each, at ``ends``; equal suffixes
    keep the order of their strings. Sorted by doubling from seven symbols.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(8, np.int64)])
    end_of = np.repeat(ends, np.diff(np.r_[-1, ends]))
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        at = np.minimum(np.arange(n) + k, end_of)
        key = (key << 9) | padded[at]
    width = 7
    longest = int((end_of - np.arange(n)).max(initial=0)) + 1
    order = np.argsort(key, kind="stable")
    while True:
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        rank[order] = np.cumsum(new)
        if width >= longest or new.all():
            break
        at = np.arange(n) + width
        behind = np.where(at <= end_of, rank[np.minimum(at, n - 1)], 0)
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        width *= 2
    before = np.concatenate([[0], symbols[:-1]])
    return order, before[order]


def merge_transforms(
    transforms: list[np.ndarray], rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``rounds`` symbols.

    Returns ``(place, heads, prefix)``: for each merged position its place in
    the concatenated shards, the starts of the intervals that hold together for
    all rounds, and the common prefix (at most ``rounds``) with the position before.

    Round k reads the transforms in the order of round k - 1 and deals the
    suffixes, one symbol longer, by that symbol; which suffix that is, each
    transform says itself. Two neighbours are in one interval of k symbols when
    they were dealt by the same symbol out of one interval of k - 1 symbols.
    """
    sizes = [len(t) for t in transforms]
    n = sum(sizes)
    # Symbols by rank: at most 257 kinds, in nearly all batches few enough for one byte.
    kinds, symbols = np.unique(np.concatenate(transforms), return_inverse=True)
    symbols = symbols.astype(np.uint8 if len(kinds) <= 256 else np.uint16)
    longer = np.empty(n, dtype=np.intp)
    closing = []
    at = 0
    for t, size in zip(transforms, sizes):
        # The i-th occurrence of a symbol in the transform begins its i-th suffix.
        longer[at + np.argsort(symbols[at : at + size], kind="stable")] = np.arange(at, at + size)
        closing.append(np.arange(at, at + np.count_nonzero(t == 0)))
        at += size
    # The suffixes that are a closing alone come first in every round, by shard.
    closing = np.concatenate(closing)
    place = np.arange(n)
    block = np.zeros(n, dtype=np.int32)
    prefix = np.full(n, rounds, dtype=np.int16)
    prefix[:1] = 0
    new = np.zeros(n, dtype=bool)
    for k in range(1, rounds + 1):
        read = symbols.take(place)
        dealt = np.argsort(read, kind="stable")
        place, came, read = place.take(dealt), block.take(dealt), read.take(dealt)
        fresh = (read[1:] != read[:-1]) | (came[1:] != came[:-1])
        place = longer.take(place)
        place[: len(closing)] = closing
        fresh[: len(closing)] = True
        # Boundaries stay where they are, so only those of this round are new.
        prefix[1:][fresh > new[1:]] = k - 1
        new[0], new[1:] = True, fresh
        np.cumsum(new, out=block)
    return place, np.flatnonzero(new), prefix


def first_homes(strings: list[np.ndarray], homes: np.ndarray, shards: int = SHARDS) -> list[np.ndarray]:
    """For each start of a MATCH-byte string in each of ``strings``, the smallest home of
    all strings that hold the same MATCH bytes."""
    shards = max(1, min(shards, len(strings)))
    dealt = [list(range(s, len(strings), shards)) for s in range(shards)]
    transforms, owner, offset = [], [], []
    for members in dealt:
        pieces, ends, at = [], [], 0
        for i in members:
            pieces.append(strings[i].astype(np.int64) + 1)
            pieces.append(np.zeros(1, np.int64))
            at += len(strings[i]) + 1
            ends.append(at - 1)
        sizes = np.array([len(strings[i]) + 1 for i in members])
        order, transform = shard_transform(np.concatenate(pieces), np.array(ends))
        transforms.append(transform)
        who = np.repeat(np.array(members), sizes)
        where = np.arange(sizes.sum()) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        owner.append(who[order])
        offset.append(where[order])
    place, heads, _ = merge_transforms(transforms, MATCH)
    who, where = np.concatenate(owner)[place], np.concatenate(offset)[place]
    least = np.minimum.reduceat(homes[who], heads)
    size = np.diff(np.r_[heads, len(place)])
    value = np.repeat(least, size)
    lengths = np.array([len(s) for s in strings])
    keep = where <= lengths[who] - MATCH
    who, where, value = who[keep], where[keep], value[keep]
    starts = np.r_[0, np.cumsum(lengths - MATCH + 1)]
    flat = np.empty(starts[-1], dtype=np.int64)
    flat[starts[who] + where] = value
    return [flat[a:b] for a, b in zip(starts, starts[1:])]


def _replies(row: dict, kind: int) -> dict[int, bytes]:
    return {r["part"]: r["reply"] for r in row["replies"] or [] if r["kind"] == kind}


def _snippet_rows(joined: DataFrame, parts: int) -> DataFrame:
    """``part, unit, block``: a unit's distinct snippets with a shared anchor, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, parts)
                c = unit.candidates(_replies(row, SHARED), _replies(row, HOT))
                found = []
                for part, places in c.by_part:
                    head = c.head[places]
                    sizes = c.last[head] - c.first[head] + MATCH
                    at = np.repeat(c.first[head], sizes) + _counting(sizes)
                    block = _pack(
                        c.anchor[head].astype("<u8"),
                        c.low[places].astype("<i8"),
                        sizes.astype("<i2"),
                        unit.data[at],
                    )
                    found.append((part, row["unit"], block))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x[0] for x in found], pa.int32()),
                            pa.array([x[1] for x in found], pa.int64()),
                            pa.array([x[2] for x in found], pa.binary()),
                        ],
                        names=["part", "unit", "block"],
                    )

    return joined.select("unit", "ids", "ends", "data", "replies").mapInArrow(
        run, "part int, unit long, block binary"
    )


def _homes(rows: pa.Table) -> pa.Table:
    """For each unit, the first home of every MATCH-byte string of the snippets it sent."""
    part = rows.column("part")[0].as_py()
    units = rows.column("unit").to_pylist()
    sent = [_unpack(b, "<u8", "<i8", "<i2", "u1") for b in rows.column("block").to_pylist()]
    counts = np.array([len(s[0]) for s in sent])
    anchor, home, sizes, data = (np.concatenate([s[k] for s in sent]) for k in range(4))
    sizes = sizes.astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    content = content_hashes(data, begin, begin + sizes - MATCH)
    # Equal snippets of several units become one with the smallest home.
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    heads = np.flatnonzero(new)
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(home[order], heads)
    rep = order[heads]
    # An anchor with one snippet left has one interval; the others are merged.
    a = anchor[rep]
    group = np.cumsum(np.r_[True, a[1:] != a[:-1]]) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    starts = sizes[rep] - MATCH + 1
    varied: dict[int, np.ndarray] = {}
    at = 0
    while at < len(several):
        stop, total = at, 0
        while stop < len(several) and (
            total < MERGE_SUFFIXES or group[several[stop]] == group[several[stop - 1]]
        ):
            total += int(sizes[rep[several[stop]]]) + 1
            stop += 1
        batch = several[at:stop]
        strings = [data[begin[rep[i]] : begin[rep[i]] + sizes[rep[i]]] for i in batch.tolist()]
        for i, values in zip(batch.tolist(), first_homes(strings, low[batch])):
            if (values == values[0]).all():
                low[i] = values[0]
            else:
                varied[i] = values
        at = stop
    is_varied = np.zeros(len(rep), dtype=bool)
    is_varied[list(varied)] = True
    out = []
    for unit, lo, hi in zip(units, np.cumsum(counts) - counts, np.cumsum(counts)):
        mine = which[lo:hi]
        changing = np.flatnonzero(is_varied[mine])
        values = [varied[i] for i in mine[changing].tolist()]
        block = _pack(
            low[mine].astype("<i8"),
            changing.astype("<i8"),
            starts[mine[changing]].astype("<i8"),
            (np.concatenate(values) if values else np.zeros(0)).astype("<i8"),
        )
        out.append((unit, part, HOME, block))
    return pa.table([list(c) for c in zip(*out)], schema=REPLY)


# --- cutting ------------------------------------------------------------------------------------


def _covered(unit: Unit, row: dict) -> np.ndarray:
    """Which bytes of a unit go."""
    homes = _replies(row, HOME)
    c = unit.candidates(_replies(row, SHARED), _replies(row, HOT))
    home = c.low.copy()
    spread: dict[int, np.ndarray] = {}
    for part, places in c.by_part:
        fixed, changing, sizes, values = _unpack(homes[part], "<i8", "<i8", "<i8", "<i8")
        home[places] = fixed
        edges = np.cumsum(sizes)
        for i, end, size in zip(changing.tolist(), edges.tolist(), sizes.tolist()):
            spread[int(places[i])] = values[end - size : end]
    change = np.zeros(len(unit.data) + 1, dtype=np.int32)
    varied = np.zeros(len(home), dtype=bool)
    varied[list(spread)] = True
    gone = (home[c.which] < c.doc) & ~varied[c.which]
    np.add.at(change, c.first[gone], 1)
    np.add.at(change, c.last[gone] + MATCH, -1)
    for r in np.flatnonzero(varied[c.which]).tolist():
        starts = c.first[r] + np.flatnonzero(spread[int(c.which[r])] < c.doc[r])
        change[starts] += 1
        change[starts + MATCH] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_replies(df: DataFrame, hot_units: int = HOT_UNITS) -> tuple[DataFrame, int]:
    """Units with all they need to cut, and the number of parts. Runs the actions."""
    _, size = input_bytes(df, "text")
    parts = parts_for(size, PART_BYTES)
    units = units_of(df)
    anchors = _anchor_rows(units, parts).groupBy("part").applyInArrow(_meet(hot_units), REPLY_DDL)
    shared = written(anchors, "shared-anchors")

    def joined(replies: DataFrame) -> DataFrame:
        # At most three rows per unit and part, a few bytes for each snippet of the unit.
        per_unit = replies.groupBy("unit").agg(
            F.collect_list(F.struct("part", "kind", "reply")).alias("replies")
        )
        return units.join(per_unit, "unit", "left")

    homes = _snippet_rows(joined(shared), parts).groupBy("part").applyInArrow(_homes, REPLY_DDL)
    homes = written(homes, "first-homes")
    return joined(shared.unionByName(homes)), parts


def digest(df: DataFrame, hot_units: int = HOT_UNITS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    source = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    rows, parts = _with_replies(source, hot_units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, parts)
                gone = _covered(unit, row)
                starts = np.r_[0, unit.ends[:-1]]
                total = np.r_[0, np.cumsum(gone)]
                rise = gone.copy()
                rise[1:] &= ~gone[:-1]
                heads = starts[starts < len(gone)]
                rise[heads] = gone[heads]
                rises = np.r_[0, np.cumsum(rise)]
                kept = unit.data[~gone].tobytes()
                removed = total[unit.ends] - total[starts]
                at = np.r_[0, np.cumsum(unit.ends - starts - removed)].tolist()
                sums = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(unit.ids, pa.int64(), mask=unit.ids == NO_ID),
                        pa.array(unit.ends - starts),
                        pa.array(removed.astype(np.int64)),
                        pa.array((rises[unit.ends] - rises[starts]).astype(np.int64)),
                        pa.array(sums, pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return rows.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_repeats(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` cut to what is left. Characters of which a byte went go whole.

    Null texts stay null; every row stays, also when nothing of its text is left.
    """
    rows, parts = _with_replies(df)
    names = df.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, parts)
                gone = _covered(unit, row)
                raw = zstandard.ZstdDecompressor().decompress(row["rest"])
                rest = pa.ipc.open_stream(raw).read_all()
                starts = np.r_[0, unit.ends[:-1]]
                data = unit.data
                texts = []
                for a, b in zip(starts.tolist(), unit.ends.tolist()):
                    mask = gone[a:b]
                    left = data[a:b][~mask] if mask.any() else data[a:b]
                    texts.append(left.tobytes().decode("utf-8", "ignore"))
                whole = rest.add_column(text_at, "text", pa.array(np.array(texts, dtype=object), pa.string(), mask=unit.missing > 0))
                yield from whole.to_batches()

    return rows.mapInArrow(run, df.schema)
