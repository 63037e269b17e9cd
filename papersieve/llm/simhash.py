"""SimHash near-duplicates with pigeonring filtering and connected components.

A document's fingerprint takes a majority vote, per bit, over the XXH64 values
of its three-word shingles. Two fingerprints are linked when at most
``BUDGET`` bits differ.

Candidates come from the pigeonring principle. The 64 bits are cut into
``SEGMENTS`` segments in a ring. If two fingerprints differ in at most t bits
in all, there is a segment from which every chain of l consecutive segments
differs in at most ``l * t / SEGMENTS`` bits. With t = 2 and five segments the
first two segments of that chain have to be equal, the first four may differ in
one bit: five keys of some 26 bits find every link, and the longer chains throw
out nearly all candidates before the full comparison.

Only distinct fingerprints are compared, so copies cost nothing. A bucket of
more than ``BUCKET_ROWS`` fingerprints is cut again: the bits outside its key
are divided in three, of which at least one is equal, and again, until what
differs has so few bits that the bucket's size is bounded by their number.

The pipeline's stage (``keep_first``) has another rule: five-word shingles with a
Jaccard similarity of 0.8 or more. The fingerprints of such texts differ in some
15 % of their bits, so ``near_texts`` takes longer ones (``WIDE`` words of 64 bits)
with a wider budget. No segment of theirs has to be equal, so texts first meet by
bands of minimal shingles; a chain of segments within budget prunes what met, and
what is left is verified by the shingles themselves. ``exact=True`` leaves the
fingerprints out: ``similar_texts`` finds all pairs by prefixes of their shingle
sets, at the price of shuffling every shingle.

Edge cases: null and blank texts have fingerprint zero and are linked like any
other; one or two words form one shingle; ties of a vote give a zero bit;
repeated rows share fingerprint and component; a null ``doc_id`` is never the
smallest unless the whole component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve.llm.common import unused, written

SHINGLE, SEED = 3, 42
BITS, BUDGET, SEGMENTS = 64, 2, 5
BUCKET_ROWS = 4_096
# The pipeline's stage: words to a shingle and Jaccard similarity of near duplicates.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
# Its fingerprints: 64-bit words, segments of the ring, bits that may differ in all. Texts at
# the similarity differ in 39 bits of 256 on average (standard deviation 6), unlike ones in 128.
WIDE, WIDE_SEGMENTS, WIDE_BUDGET = 4, 8, 64
# So few bits say that a text needs no other partner in a bucket.
WIDE_CLOSE = 28
# Two texts with a similarity of 0.8 share a band with a probability of 0.997.
BANDS, BAND_ROWS = 32, 8
# Rounds in which every text of a bucket is held against one of them.
CENTRE_ROUNDS = 2
# Shingles voted on at once: bounds the memory for a very long text.
VOTES = 1 << 15


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    count = len(words) - SHINGLE + 1
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, VOTES):
        part = words[at : at + VOTES + SHINGLE - 1]
        values = np.fromiter(
            (digest(b"%b %b %b" % three, SEED) for three in zip(part, part[1:], part[2:])),
            dtype=">u8",
            count=len(part) - SHINGLE + 1,
        )
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(
            axis=0, dtype=np.int64
        )
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"]
            )

    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, fp long")


def segments(count: int = SEGMENTS) -> list[tuple[int, int]]:
    """``(lowest bit, width)`` of each segment of the ring."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(parts: list[tuple[int, int]]) -> int:
    return sum(((1 << width) - 1) << low for low, width in parts)


def chain_keys(count: int = SEGMENTS, budget: int = BUDGET) -> list[int]:
    """Bit mask of each start's equal chain: the segments whose budget rounds down to zero."""
    ring = segments(count)
    length = max(k for k in range(1, count + 1) if k * budget // count == 0)
    return [_mask([ring[(s + k) % count] for k in range(length)]) for s in range(count)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chain_ok(diff: np.ndarray, start: int, count: int = SEGMENTS, budget: int = BUDGET) -> np.ndarray:
    """Whether the chain from ``start`` keeps its proportional budget at every length."""
    ring = segments(count)
    ok, total = np.ones(diff.shape, dtype=bool), np.zeros(diff.shape, dtype=np.int64)
    for k in range(count):
        total += _popcount(diff & np.uint64(_mask([ring[(start + k) % count]])))
        ok &= total * count <= (k + 1) * budget
    return ok


def bucket_links(values: np.ndarray, start: int | None) -> list[tuple[int, int]]:
    """Links that connect what is linked in one bucket of distinct fingerprints.

    A spanning forest rather than all pairs: at most one link fewer than
    fingerprints. ``start`` names the chain to test first; without one (a
    bucket that was cut again) only the full comparison is made.
    """
    values = np.sort(values.astype(np.uint64))
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(values) - 1):
        diff = values[i + 1 :] ^ values[i]
        if start is not None:
            at = np.flatnonzero(chain_ok(diff, start))
            at = at[_popcount(diff[at]) <= BUDGET]
        else:
            at = np.flatnonzero(_popcount(diff) <= BUDGET)
        for j in at.tolist():
            a, b = root(i), root(i + 1 + j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(values[i]), int(values[i + 1 + j])))
    return out


def _thirds(mask: int) -> list[int]:
    """The bits of ``mask`` in three parts of nearly equal size."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    cut = [len(bits) * i // 3 for i in range(4)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cut, cut[1:])]


def _keyed(distinct: DataFrame, masks: dict[int, int]) -> DataFrame:
    """A row ``(mask_id, key, fp)`` for each mask."""
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("mask_id"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for i, m in masks.items()
        ]
    )
    return distinct.select("fp", F.explode(keys).alias("k")).select("k.mask_id", "k.key", "fp")


def candidate_links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b)``: links among distinct fingerprints that connect all linked ones.

    Buckets within ``bucket_rows`` are compared; larger ones are cut again by
    longer keys. Runs one count action per level, at most four.
    """
    masks = dict(enumerate(chain_keys()))
    start: dict[int, int | None] = {i: i for i in masks}
    rows = _keyed(distinct, masks)
    links: list[DataFrame] = []
    level = 0
    while True:
        sized = rows.groupBy("mask_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
        sized = written(sized, f"buckets-{level}")
        free = BITS - max(bin(m).count("1") for m in masks.values())
        last = (1 << free) <= 16 * bucket_rows
        small = sized if last else sized.filter(F.col("n") <= bucket_rows)
        links.append(_compare(rows.join(small, ["mask_id", "key"]), dict(start)))
        if last or sized.filter(F.col("n") > bucket_rows).isEmpty():
            break
        large = rows.join(sized.filter(F.col("n") > bucket_rows), ["mask_id", "key"])
        nested: dict[int, int] = {}
        cut = None
        for i, mask in masks.items():
            parts = []
            for third in _thirds(~mask & ((1 << BITS) - 1)):
                nested[len(nested)] = mask | third
                parts.append((len(nested) - 1, mask | third))
            keys = F.array(
                *[
                    F.struct(
                        F.lit(n).alias("mask_id"),
                        F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"),
                    )
                    for n, m in parts
                ]
            )
            cut = keys if cut is None else F.when(F.col("mask_id") == i, keys).otherwise(cut)
        rows = written(
            large.select("fp", F.explode(cut).alias("k")).select("k.mask_id", "k.key", "fp"),
            f"cut-{level}",
        )
        masks, start, level = nested, dict.fromkeys(nested), level + 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _compare(rows: DataFrame, start: dict[int, int | None]) -> DataFrame:
    """Links inside each bucket; a bucket is one group of bounded size.

    Groups are packed many to a batch: ``bucket`` values are sorted within
    partitions and cut in one pass, so tiny buckets cost no Python call each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        held: list[np.ndarray] = []
        held_key = None

        def close():
            if held_key is not None:
                for a, b in bucket_links(np.concatenate(held), start[held_key[0]]):
                    left.append(_signed(a))
                    right.append(_signed(b))

        for batch in batches:
            ids, keys, fps = (batch.column(c).to_numpy() for c in range(3))
            edges = np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
                key = (int(ids[lo]), int(keys[lo]))
                if key != held_key:
                    close()
                    held, held_key = [], key
                held.append(fps[lo:hi].view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )
            left, right = [], []
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
        )

    return (
        rows.select("mask_id", "key", "fp")
        .repartition("mask_id", "key")
        .sortWithinPartitions("mask_id", "key")
        .mapInArrow(run, "a long, b long")
    )


def components(links: DataFrame, node: str = "long") -> DataFrame:
    """``(node, root)`` of every node that has a link; root is the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller ones. Each round is one
    aggregation and one write; no component is gathered anywhere, and the number
    of rounds grows with the logarithm of the nodes.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct(),
        "links",
    )
    while True:
        # Large step: for each node, connect larger neighbours to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = written(large.filter("u <> v").distinct(), "large-star")
        # Small step: for each node, connect smaller neighbours and itself to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        after = written(small, "small-star")
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``df``.

    Fingerprints are computed once and written; only distinct ones are compared.
    """
    prints = written(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = written(distinct, "distinct-fingerprints")
    roots = components(candidate_links(distinct.select("fp")))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A component can hold many fingerprints and a fingerprint many rows: both joins are
    # plain equi-joins of narrow rows, which adaptive execution splits when a key is hot.
    member = named.join(component, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def digest(df: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    return near_duplicates(df).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def text_shingles(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """XXH64 values of the distinct shingles of one text; fewer words form one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    tuples = zip(*[words[i:] for i in range(shingle)])
    values = (digest(b" ".join(t), SEED) for t in tuples)
    return np.unique(np.fromiter(values, dtype=np.uint64, count=len(words) - shingle + 1))


def _shingle_rows(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, size, h``: a row for each distinct shingle of each row of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [text_shingles(t.as_py(), shingle) for t in part.column(1)]
                sizes = np.array([len(x) for x in sets], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), sizes), pa.int64()),
                        pa.array(np.repeat(sizes, sizes), pa.int32()),
                        pa.array(np.concatenate(sets).view(np.int64), pa.int64()),
                    ],
                    names=["node", "size", "h"],
                )

    return texts.mapInArrow(run, "node long, size int, h long")


def _least_common(size: str, similarity: float) -> Column:
    """Shingles that a set of this size shares with any set as similar as that, at least."""
    return F.ceil(F.col(size) * similarity - 1e-9).cast("int")


def similar_sets(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``node, size, shared, prefix`` of the sets that can be similar to another one.

    ``shared`` are the shingles that other rows have too, rarest first by one
    order for all sets; nothing else can be in an intersection. Two similar sets
    have a shingle in common among the first ``size - least common + 1`` of
    each: ``prefix`` is the shared part of those. Sets with fewer shared shingles
    than a similar pair has in common are left out.
    """
    counted = (
        _shingle_rows(texts, shingle)
        .withColumn("n", F.count("*").over(Window.partitionBy("h")))
        .filter("n > 1")
        # Copies of one text count in n, which only orders; here they become one.
        .dropDuplicates(["h", "node", "size", "n"])
    )
    shared = F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x["h"])
    common = _least_common("size", similarity)
    return (
        counted.groupBy("node", "size")
        .agg(shared.alias("shared"))
        .filter(F.size("shared") >= common)
        .withColumn("prefix", F.slice("shared", F.lit(1), F.size("shared") - common + 1))
    )


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose shingle sets are similar enough, by exact count."""

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("node").alias(name), F.col("size").alias(f"size_{name}"),
            F.col("shared").alias(f"shared_{name}"),
        )

    both = F.size(F.array_intersect("shared_a", "shared_b"))
    either = F.col("size_a") + F.col("size_b") - both
    return (
        pairs.join(side("b"), "b").join(side("a"), "a")
        .filter(both >= either * similarity - 1e-9)
        .select("a", "b")
    )


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: verified links that connect all nodes that similar pairs connect.

    First every node is held against one other of each of its buckets (nodes with
    a prefix shingle in common), so that a large group of near copies needs few
    comparisons; then all pairs of a bucket that are not connected yet.
    """
    rows = written(
        sets.select("node", "size", F.explode("prefix").alias("h")), "prefixes"
    )
    many = rows.groupBy("h").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("node", "size"), F.xxhash64("node")).alias("centre"),
    ).filter("n > 1")
    fit = F.least("size", "other") >= F.greatest("size", "other") * similarity - 1e-9
    stars = (
        rows.join(many, "h")
        .withColumn("other", F.col("centre.size"))
        .filter((F.col("node") != F.col("centre.node")) & fit)
        .select(F.col("centre.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    links = written(_verified(stars, sets, similarity), "star-links")
    roots = components(links)
    labelled = written(
        rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")),
        "labelled-prefixes",
    )
    mixed = (
        labelled.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"))
        .filter("x <> y").select("h")
    )
    left = labelled.join(mixed, "h", "left_semi")
    right = left.select(
        "h", F.col("node").alias("b"), F.col("size").alias("other"), F.col("root").alias("root_b")
    )
    pairs = (
        left.join(right, "h")
        .filter((F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")) & fit)
        .select(F.col("node").alias("a"), "b")
        .distinct()
    )
    return links.unionByName(_verified(pairs, sets, similarity))


def similar_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY,
) -> DataFrame:
    """``doc_id, node, component_id`` of every row: components of the pairs of texts whose
    sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or more.

    Exact, without a fingerprint that could miss a pair: see ``similar_sets``.
    ``node`` is a hash of the text, so copies are one node.
    """
    if not 0 < similarity <= 1 or shingle < 1:
        raise ValueError("similarity must lie in (0, 1], shingle must be positive")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    node = F.xxhash64(text).alias("node")
    ids = written(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), node), "texts")
    sets = written(similar_sets(df.select(node, text.alias("text")), shingle, similarity), "sets")
    roots = components(similar_links(sets, similarity))
    named = (
        ids.groupBy("node").agg(F.min("doc_id").alias("least"))
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = named.join(component, "root").select("node", "component_id")
    return ids.join(member, "node").select("doc_id", "node", "component_id")


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors: one per fingerprint word and one per minimum."""
    draws = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE + BANDS * BAND_ROWS, dtype=np.uint64)
    odd = draws * np.uint64(2) + np.uint64(1)
    return odd[:WIDE], odd[WIDE:]


def _mixed(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A table of hashes, one row per factor, of 64-bit values."""
    out = values[None, :] * factors[:, None]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(fingerprint words, band keys)`` of a set of shingle hashes.

    Works through ``VOTES`` hashes or fewer at a time, however long the text is.
    """
    wide, least = _mixers()
    votes = np.zeros(WIDE * BITS, dtype=np.int64)
    minima = np.full(len(least), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = VOTES // 16
    for at in range(0, len(values), step):
        part = values[at : at + step]
        bits = np.unpackbits(_mixed(part, wide).astype(">u8").view(np.uint8).reshape(WIDE, len(part), 8), axis=2)
        votes += bits.sum(axis=1, dtype=np.int64).ravel()
        np.minimum(minima, _mixed(part, least).min(axis=1), out=minima)
    words = np.packbits(2 * votes > len(values)).view(">u8").astype(np.uint64)
    keys = np.zeros(BANDS, dtype=np.uint64)
    for column in minima.reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys ^ column, wide[:1])[0]
    # The band's number goes in, so that equal minima of different bands do not meet.
    return words, _mixed(keys + np.arange(BANDS, dtype=np.uint64), wide[1:2])[0]


_SKETCH = "doc_id long, copy binary, size int, shingles array<int>, bands array<long>, fp array<long>"


def sketches(df: DataFrame, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """Per row of ``doc_id, text`` the digest of the text, its shingles in 32 bits and its sketch."""
    import hashlib

    def lists(rows: list[np.ndarray], kind) -> pa.ListArray:
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
        flat = np.concatenate(rows) if rows else np.empty(0, kind)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                copies, sets, words, bands = [], [], [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    copies.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                    values = text_shingles(text, shingle)
                    fp, keys = sketch(values)
                    sets.append(np.unique(values.astype(np.uint32)))
                    words.append(fp)
                    bands.append(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(copies, pa.binary()),
                        pa.array([len(x) for x in sets], pa.int32()),
                        lists(sets, np.int32), lists(bands, np.int64), lists(words, np.int64),
                    ],
                    names=["doc_id", "copy", "size", "shingles", "bands", "fp"],
                )

    return df.mapInArrow(run, _SKETCH)


def ring_differences(a: Column, b: Column) -> list[Column]:
    """Differing bits of two fingerprints, segment by segment around the ring."""
    width = WIDE * BITS // WIDE_SEGMENTS
    out = []
    for k in range(WIDE_SEGMENTS):
        word, low = divmod(k * width, BITS)
        mask = _signed(((1 << width) - 1) << low)
        diff = F.get(a, F.lit(word)).bitwiseXOR(F.get(b, F.lit(word)))
        out.append(F.bit_count(diff.bitwiseAND(F.lit(mask))))
    return out


def ring_passes(segment: Column, budget: int = WIDE_BUDGET) -> Column:
    """Whether some chain around the ring keeps its proportional budget at every length.

    ``segment`` is the array of the segments' differences. The chain of all
    segments is the full Hamming check.
    """
    count = WIDE_SEGMENTS

    def step(state: Column, k: Column) -> Column:
        total = state["total"] + F.get(segment, F.pmod(state["start"] + k, F.lit(count)))
        kept = state["ok"] & (total * count <= (k + 1) * budget)
        return F.struct(state["start"].alias("start"), total.alias("total"), kept.alias("ok"))

    def chain(start: Column) -> Column:
        begin = F.struct(start.alias("start"), F.lit(0).alias("total"), F.lit(True).alias("ok"))
        return F.aggregate(F.array(*[F.lit(k) for k in range(count)]), begin, step)["ok"]

    whole = F.aggregate(segment, F.lit(0), lambda x, y: x + y)
    return (whole <= budget) & F.exists(F.array(*[F.lit(k) for k in range(count)]), chain)


def _ring_filtered(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """``a, b, close`` of the pairs within budget."""

    def side(name: str) -> DataFrame:
        return prints.select(F.col("node").alias(name), F.col("fp").alias(f"fp_{name}"))

    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .withColumn("segment", F.array(*ring_differences(F.col("fp_a"), F.col("fp_b"))))
        .filter(ring_passes(F.col("segment")))
        .select("a", "b", (F.aggregate("segment", F.lit(0), lambda x, y: x + y) <= WIDE_CLOSE).alias("close"))
    )


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one text."""
    many = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return rows.join(many, "key", "left_semi")


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: pairs of texts that met in a band and passed the ring.

    In each round every text of a bucket is held against one text of it, the same
    for all; it stays for the next round unless that one was close. What then is
    left of a bucket is compared in one pass over its fingerprints, in which every
    text is held against the earlier ones that are in no one's budget.
    """
    prints = nodes.select("node", "fp")
    rows = written(
        _crowded(nodes.select("node", F.explode("bands").alias("key")).distinct()), "bands"
    )
    passed = []
    for turn in range(CENTRE_ROUNDS):
        centre = rows.groupBy("key").agg(
            F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("centre")
        )
        held = rows.join(centre, "key").filter(F.col("node") != F.col("centre"))
        pairs = held.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
        within = written(_ring_filtered(pairs, prints), "within-budget")
        passed.append(within)
        close = within.filter("close").select(F.col("a").alias("node"), F.col("b").alias("centre"))
        rows = written(
            _crowded(held.join(close, ["node", "centre"], "left_anti").select("node", "key")), "bands"
        )
    passed.append(_leaders(rows.join(prints, "node")))
    out = passed[0].select("a", "b")
    for more in passed[1:]:
        out = out.unionByName(more.select("a", "b"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _leaders(rows: DataFrame) -> DataFrame:
    """``a, b``: texts of a bucket and the earlier ones in budget that lead it.

    A text within no leader's budget becomes one, so a bucket of like texts has few.
    """
    width = WIDE * BITS // WIDE_SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, leaders, ids = None, np.empty((0, WIDE), np.uint64), []
        used = 0
        for batch in batches:
            left, right = [], []
            fps = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
            for key, node, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), fps):
                if key != held_key:
                    held_key, leaders, ids, used = key, np.empty((4, WIDE), np.uint64), [], 0
                segments = np.bitwise_count((leaders[:used] ^ fp).view(f"u{width // 8}"))
                near = np.flatnonzero(segments.sum(axis=1, dtype=np.int64) <= WIDE_BUDGET)
                near = [i for i in near.tolist() if wide_chain(segments[i])]
                for i in near:
                    left.append(node)
                    right.append(ids[i])
                if not near:
                    if used == len(leaders):
                        leaders = np.concatenate([leaders, np.empty_like(leaders)])
                    leaders[used] = fp
                    used += 1
                    ids.append(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

    return (
        rows.select("key", "node", "fp")
        .repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(run, "a long, b long")
    )


def wide_chain(segments: np.ndarray, budget: int = WIDE_BUDGET) -> bool:
    """Whether some chain of segments keeps its proportional budget at every length."""
    count = len(segments)
    limits = np.arange(1, count + 1) * budget / count
    ring = np.concatenate([segments, segments]).astype(np.int64)
    return any((np.cumsum(ring[s : s + count]) <= limits).all() for s in range(count))


def near_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY,
) -> DataFrame:
    """``doc_id, component_id`` of the rows with an id: components of texts that met, whose
    fingerprints pass the ring and whose shingles have a Jaccard similarity of ``similarity`` or more.

    Rows of one id count as one. Texts are read once and never shuffled; copies of a text
    are one node, named by its smallest id.
    """
    if not 0.5 <= similarity <= 1 or shingle < 1:
        raise ValueError("bands and budget are made for similarities from 0.5 on, shingle must be positive")
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    ).filter("doc_id IS NOT NULL")
    made = written(sketches(rows, shingle), "sketches")
    first = written(made.groupBy("copy").agg(F.min("doc_id").alias("node")), "distinct-texts")
    named = written(made.select("doc_id", "copy").join(first, "copy").select("doc_id", "node").distinct(), "copies")
    nodes = made.join(first, (made["copy"] == first["copy"]) & (made["doc_id"] == first["node"]))
    pairs = written(candidate_pairs(nodes.select("node", "bands", "fp")), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = nodes.select("node", "size", F.col("shingles").alias("shared")).join(wanted, "node", "left_semi")
    # An id with several texts is one node; its largest set stands for it.
    sets = written(sets.groupBy("node").agg(F.max_by(F.struct("size", "shared"), "size").alias("s")).select("node", "s.*"), "sets")
    # An id with several texts links their nodes.
    least = written(named.groupBy("doc_id").agg(F.min("node").alias("node")), "least-nodes")
    split = named.join(least.withColumnRenamed("node", "a"), "doc_id").filter("node <> a")
    links = _verified(pairs, sets, similarity).unionByName(split.select("a", F.col("node").alias("b")))
    roots = components(links)
    return least.join(roots, "node", "left").select(
        "doc_id", F.coalesce("root", "node").alias("component_id")
    )


def keep_first(
    df: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, exact: bool = False
) -> DataFrame:
    """One row of each component of ``near_texts``: that of its smallest ``doc_id``, with
    the columns of ``df``. ``exact`` takes the components of ``similar_texts`` instead.

    Rows that repeat an id with the same text count as one. Rows without an id
    have no smallest one and all stay.
    """
    find = similar_texts if exact else near_texts
    found = find(df, shingle=shingle, similarity=similarity)
    first = (
        found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    )
    rank, order = unused(df, "_rank", "_order")
    numbered = df.filter(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi")
    once = Window.partitionBy("doc_id", order).orderBy(order)
    kept = (
        numbered.withColumn(order, F.xxhash64(F.col("text")))
        .withColumn(rank, F.row_number().over(once))
        .filter(F.col(rank) == 1)
        .drop(rank, order)
    )
    columns = [F.col(f"`{c}`") for c in df.columns]
    return kept.select(*columns).unionByName(
        df.filter(F.col("doc_id").isNull()).select(*columns)
    )
