"""Token ids in Huffman-coded blocks.

Documents are tokenized once; the ids' global counts give length-limited
Huffman code lengths (package-merge), which alone define the canonical code.
Documents are then written in ascending ``doc_id`` order as independent blocks.

File format, under one folder:

* ``code``: Parquet rows ``id, length``. Codes are canonical: by (length, id),
  counting up, most significant bit first.
* ``blocks``: Parquet rows, one per block of whole documents: ``part, block``
  (ascending order of documents), ``start`` (ids of the part before the block),
  ``n_ids``, ``doc_ids``, ``doc_lengths`` (ids of each document, its end id
  included), ``checkpoints`` (little-endian unsigned 64-bit bit offsets of every
  ``CHECKPOINT``-th id) and ``payload`` (the bits, padded with zeros).

A block is decoded from its own row and the code table: all its checkpoints are
decoded side by side, one table lookup per id.

Edge cases: null and empty texts have the end id only; repeated rows are written
one by one; a null ``doc_id`` sorts first; an empty table gives an empty code and
no block; the text of one row may be of any length.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersieve.llm.common import input_bytes, parts_for, scratch, worker_memo, written

END_ID = 0
# Longest code, where the ids in use allow it; the decoding table then stays in a core's cache.
MAX_CODE_BITS = 16
CHECKPOINT = 64
BLOCK_IDS = 1 << 18
ENCODED_AT_ONCE = 1 << 14
# Bytes of text whose ids make one part of the output.
PART_TEXT_BYTES = 32 << 20
MEMO_PIECES = 500_000
MEMO_CHARS = 48
WORDS_AT_ONCE = 256
TEXTS_AT_ONCE = 1_024
PIECES_AT_ONCE = 1 << 18


# --- tokenizing ---------------------------------------------------------------------------------

def needs_whole_text(pieces: pa.Array) -> np.ndarray:
    """Whether a piece between blanks begins with white space or holds a special token's
    opening: texts with such a piece go to the tokenizer whole."""
    first = pc.utf8_slice_codeunits(pieces, 0, 1)
    # White space as Python's text methods have it, which is more than any engine's class of it.
    starts = pc.is_in(first, value_set=_WHITE)
    odd = pc.or_(pc.or_(starts, pc.equal(first, "")), pc.match_substring(pieces, "<|"))
    return odd.to_numpy(zero_copy_only=False)


_WHITE = pa.array([c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()])


# Pieces of letters of the first Latin blocks and of ASCII without the apostrophe, and without
# two white spaces in a row: the tokenizer cuts them wherever letters begin or end.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"(?!.*\s\s)[\x00-&(-\x7f{_LATIN}]+", re.DOTALL)
_RUNS = re.compile(f"[{_LATIN}]+|[^{_LATIN}]+")


def id_type(vocabulary: int) -> str:
    """Narrowest array type code for ids below ``vocabulary``."""
    return "H" if vocabulary <= 1 << 16 else "I"


class PieceEncoder:
    """Ids of texts through the tokenizer, remembering those of blank-separated pieces.

    A byte-level tokenizer cuts before a blank that a non-blank follows, so a
    text without runs of white space that hold an inner blank has the ids of
    its pieces (each with its leading blank) in a row. Pieces seen for the first
    time are encoded many to a call: of a plain word only the first id has the
    blank, which shows where the next word begins. The memo keeps two
    generations of bounded size.
    """

    def __init__(self, model_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = worker_memo("pieces")
        if memo.get("model") != hash(model_json):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model_json)
            size = tokenizer.get_vocab_size()
            opens = np.array([(tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
            memo.clear()
            memo.update(
                model=hash(model_json), tokenizer=tokenizer, type=id_type(size), opens=opens,
                **{"break": tokenizer.encode("\n", add_special_tokens=False).ids[0]},
                young={}, old={}, rests={},
            )
        self.memo = memo
        self.tokenizer = memo["tokenizer"]
        self.type = memo["type"]

    def raw(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.type, e.ids).tobytes() for e in found]

    def words(self, words: list[str], before: str = " ") -> list[bytes]:
        """Packed ids of words of letters: each with a leading blank, or each by itself if
        ``before`` is a line break, which never joins a word."""
        out: list[bytes] = []
        lines = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        encoded = self.tokenizer.encode_batch_fast(
            [before + before.join(line) for line in lines], add_special_tokens=False
        )
        with_blank = before == " "
        opens, line_break = self.memo["opens"], self.memo["break"]
        for line, e in zip(lines, encoded):
            ids = np.array(e.ids, dtype=self.type)
            starts = np.flatnonzero(opens[ids] if with_blank else ids == line_break)
            if len(starts) != len(line):
                out += self.raw([" " + w if with_blank else w for w in line])
                continue
            ends = [*(starts[1:] * ids.itemsize).tolist(), ids.nbytes]
            starts = ((starts if with_blank else starts + 1) * ids.itemsize).tolist()
            packed = ids.tobytes()
            out += [packed[x:y] for x, y in zip(starts, ends)]
        return out

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        flat, ends = self.packed(pa.array(texts, pa.string()))
        starts = np.concatenate([[0], ends[:-1]])
        return [flat[x:y].tobytes() for x, y in zip(starts, ends)]

    def packed(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts in a row, and where each text ends.

        Pieces are numbered by Arrow, so Python meets each distinct one once; the
        texts are put together from the numbers. ``end_id`` is put after each text.
        """
        count = len(texts)
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        offsets -= offsets[0]
        sequence = coded.indices.to_numpy().astype(np.int64)
        # Through an object array: a list straight from Arrow takes four times as long.
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # A text's first piece has no blank before it: it is encoded by itself.
        first = offsets[:-1]
        inner = np.ones(len(sequence), dtype=bool)
        inner[first] = False
        odd = needs_whole_text(coded.dictionary)
        odd_places = np.flatnonzero(odd[sequence] & inner)
        whole = np.zeros(count, dtype=bool)
        whole[np.searchsorted(offsets, odd_places, side="right") - 1] = True
        inner &= ~np.repeat(whole, np.diff(offsets))
        wanted = np.zeros(len(pieces), dtype=bool)
        wanted[sequence[inner]] = True
        used = np.flatnonzero(wanted).tolist()
        names = [pieces[i] for i in used]
        letters = pc.utf8_is_alpha(coded.dictionary).to_numpy(zero_copy_only=False)[wanted].tolist()
        entries = self._entries(names, letters)
        heads = [texts[i].as_py() if whole[i] else pieces[sequence[at]] for i, at in enumerate(first.tolist())]
        entries += self.raw([h or "" for h in heads])
        entries.append(b"" if end_id is None else array(self.type, [end_id]).tobytes())
        # Places of the entries: distinct pieces, then one head per text, then the end.
        place = np.cumsum(wanted) - 1
        sequence = place[sequence]
        sequence[first] = len(names) + np.arange(count)
        inner[first] = True
        kept = np.add.reduceat(inner, first, dtype=np.int64) if count else np.zeros(0, np.int64)
        ends = np.cumsum(kept)
        sequence = np.insert(sequence[inner], ends, len(entries) - 1)
        ends += np.arange(1, count + 1)
        return self._joined(entries, sequence, ends)

    def _joined(
        self, entries: list[bytes], sequence: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries in ``sequence``, gathered in slices of bounded size."""
        flat = np.frombuffer(b"".join(entries), dtype=self.type)
        size = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // flat.itemsize
        starts = np.cumsum(size) - size
        lengths = size[sequence]
        out = []
        for lo in range(0, len(sequence), PIECES_AT_ONCE):
            n = lengths[lo : lo + PIECES_AT_ONCE]
            before = np.cumsum(n) - n
            at = np.repeat(starts[sequence[lo : lo + PIECES_AT_ONCE]] - before, n)
            at += np.arange(len(at))
            out.append(flat.take(at))
        joined = np.concatenate(out) if out else flat[:0]
        return joined, np.concatenate([[0], np.cumsum(lengths)])[ends]

    def _entries(self, pieces: list[str], letters: list[bool]) -> list[bytes]:
        """Packed ids of distinct pieces with a leading blank; ``letters`` tells the words."""
        memo = self.memo
        if len(memo["young"]) > MEMO_PIECES:
            memo["old"], memo["young"] = memo["young"], {}
        if len(memo["rests"]) > MEMO_PIECES:
            memo["rests"] = {}
        young, old = memo["young"], memo["old"]
        found = list(map(young.get, pieces))
        words, others = [], []
        for i in [i for i, x in enumerate(found) if x is None]:
            piece = pieces[i]
            known = old.get(piece)
            if known is not None:
                found[i] = young[piece] = known
            else:
                (words if letters[i] else others).append(i)
        # Letters alone are one word for the tokenizer, in any script.
        for i, ids in zip(words, self.words([pieces[i] for i in words])):
            found[i] = ids
        for i, ids in zip(others, self._cut([pieces[i] for i in others])):
            found[i] = ids
        for i in words + others:
            if len(pieces[i]) <= MEMO_CHARS:
                young[pieces[i]] = found[i]
        return found

    def _cut(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces that are not words: by their runs of letters and of other
        characters where those are known to be cut there, else as they are."""
        young, rests = self.memo["young"], self.memo["rests"]
        fresh: dict[str, dict[str, bytes]] = {"blank": {}, "bare": {}, "signs": {}}
        blank, bare, signs = fresh.values()
        runs, whole = [], []
        for piece in pieces:
            if _PLAIN.fullmatch(piece) is None:
                runs.append(None)
                whole.append(" " + piece)
                continue
            parts = _RUNS.findall(piece)
            runs.append(parts)
            first = parts[0]
            if first[0].isalpha():
                if first not in young:
                    blank[first] = b""
            elif " " + first not in rests:
                signs[" " + first] = b""
            for run in parts[1:]:
                if run not in rests:
                    (bare if run[0].isalpha() else signs)[run] = b""
        blank.update(zip(blank, self.words(list(blank))))
        bare.update(zip(bare, self.words(list(bare), "\n")))
        signs.update(zip(signs, self.raw(list(signs))))
        for held, made in ((young, blank), (rests, bare), (rests, signs)):
            held.update(kv for kv in made.items() if len(kv[0]) <= MEMO_CHARS)
        late = iter(self.raw(whole))
        out = []
        for parts in runs:
            if parts is None:
                out.append(next(late))
                continue
            first, *rest = parts
            if first[0].isalpha():
                head = blank.get(first) or young[first]
            else:
                head = signs.get(" " + first) or rests[" " + first]
            out.append(head + b"".join([bare.get(r) or signs.get(r) or rests[r] for r in rest]))
        return out


def tokenized(df: DataFrame, model_json: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` with ids as packed unsigned integers, the end id appended."""
    shared = df.sparkSession.sparkContext.broadcast(model_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(lo, TEXTS_AT_ONCE)
                flat, ends = encoder.packed(part.column(1), end_id)
                offsets = np.concatenate([[0], ends * flat.itemsize]).astype(np.int32)
                ids = pa.Array.from_buffers(
                    pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
                )
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, ids binary")


# --- the code -----------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most_bits: int = MAX_CODE_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most_bits``; 0 for ids that never occur."""
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most_bits:
        raise ValueError(f"{len(used)} ids do not fit codes of {most_bits} bits")
    by_weight = used[np.argsort(counts[used], kind="stable")]
    weights = counts[by_weight]
    level, is_package = weights, [np.zeros(len(weights), dtype=bool)]
    for _ in range(most_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        order = np.argsort(merged, kind="stable")
        level = merged[order]
        is_package.append(order >= len(weights))
    take = 2 * len(used) - 2
    for flags in reversed(is_package):
        packages = int(flags[:take].sum())
        lengths[by_weight[: take - packages]] += 1
        take = 2 * packages
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of every id that has a length: ascending by (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for i in order[np.count_nonzero(lengths == 0) :].tolist():
        bits = int(lengths[i])
        code <<= bits - last
        codes[i], last = code, bits
        code += 1
    return codes


# A code's or a table entry's length takes the low bits of one number.
LENGTH_BITS = 5


def coding_table(lengths: np.ndarray) -> np.ndarray:
    """``code << LENGTH_BITS | length`` of every id."""
    return (canonical_codes(lengths) << np.uint64(LENGTH_BITS) | lengths.astype(np.uint64)).astype(np.int64)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """``id << LENGTH_BITS | length`` for every pattern of as many bits as the longest code."""
    most = int(lengths.max(initial=0))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.count_nonzero(lengths == 0) :]
    table = np.ones(1 << most, dtype=np.uint32)
    found = np.repeat(order << LENGTH_BITS | lengths[order], 1 << (most - lengths[order]))
    table[: len(found)] = found
    return table, most


def encode_ids(
    ids: np.ndarray, table: np.ndarray, every: int = CHECKPOINT
) -> tuple[bytes, bytes]:
    """``(checkpoints, payload)`` of one block, worked on in slices that fit a core's cache."""
    low = (1 << LENGTH_BITS) - 1
    out = np.zeros(len(ids) * int((table & low).max(initial=0)) // 8 + 8, dtype=np.uint8)
    checkpoints, base = [], 0
    for lo in range(0, len(ids), ENCODED_AT_ONCE):
        found = table.take(ids[lo : lo + ENCODED_AT_ONCE])
        bits = found & low
        ends = np.cumsum(bits)
        starts = ends - bits
        starts += base
        checkpoints.append(starts[-lo % every :: every].astype("<u8"))
        # A code and the bits before it in its first byte fit 32 bits; those that start in
        # the same byte never overlap, so they are added up.
        word = (found >> LENGTH_BITS) << (32 - bits - (starts & 7))
        byte = starts >> 3
        first = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        first = np.concatenate([[0], first])
        sums, at = np.add.reduceat(word, first).astype(">u4"), byte.take(first)
        quarters = sums.view(np.uint8).reshape(-1, 4)
        for k in range(4):
            out[at + k] |= quarters[:, k]
        base += int(ends[-1])
    offsets = np.concatenate(checkpoints) if checkpoints else np.zeros(0, "<u8")
    return offsets.tobytes(), out[: (base + 7) // 8].tobytes()


def decode_ids(
    payload: bytes,
    checkpoints: bytes,
    count: int,
    table: tuple[np.ndarray, int],
    every: int = CHECKPOINT,
) -> np.ndarray:
    """Ids of one block; step k decodes the k-th id after every checkpoint at once."""
    entries, most = table
    at = np.frombuffer(checkpoints, dtype="<u8").astype(np.int64)
    out = np.zeros((min(every, count), len(at)), dtype=np.uint32)
    # The last lane runs on past the payload for as long as the others have ids.
    raw = np.frombuffer(payload + bytes(every * 4 + 8), dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    mask, low, spare = (1 << most) - 1, (1 << LENGTH_BITS) - 1, 32 - most
    for row in out:
        look = window.take(at >> 3) >> (spare - (at & 7)) & mask
        entries.take(look, out=row)
        at += row & low
    return (out.T.reshape(-1) >> LENGTH_BITS)[:count] if count else out.reshape(-1)


# --- writing and reading ------------------------------------------------------------------------

BLOCK_SCHEMA = (
    "part int, block int, start long, n_ids long, doc_ids array<bigint>, "
    "doc_lengths array<bigint>, checkpoints binary, payload binary"
)


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs: partial counts per task, summed by id, one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            packed = b"".join(batch.column(0).to_pylist())
            found = np.bincount(np.frombuffer(packed, dtype=kind))
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"]
        )

    rows = (
        tokens.select("ids")
        .mapInArrow(run, "id long, n long")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    ids, counts = (rows.column(c).to_numpy().astype(np.int64) for c in ("id", "n"))
    total = np.zeros(int(ids.max(initial=-1)) + 1, dtype=np.int64)
    total[ids] = counts
    return total


def write_ids(df: DataFrame, model_json: str, path: str, end_id: int = END_ID) -> None:
    """Tokenize ``doc_id, text`` and write the format described above to ``path``."""
    spark = df.sparkSession
    _, size = input_bytes(df, "text")
    tokens = written(tokenized(df, model_json, end_id), "token-ids")
    from tokenizers import Tokenizer

    kind = id_type(Tokenizer.from_str(model_json).get_vocab_size())
    counts = id_counts(tokens, kind)
    # Ids in use may need longer codes than the usual limit.
    least = int(np.count_nonzero(counts)).bit_length()
    lengths = code_lengths(counts, max(MAX_CODE_BITS, least))
    used = np.flatnonzero(lengths)
    spark.createDataFrame(
        [(int(i), int(lengths[i])) for i in used], "id int, length int"
    ).coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(coding_table(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        part = TaskContext.get().partitionId()
        block, start = 0, 0
        docs: list = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            ids = np.concatenate(held)
            checkpoints, payload = encode_ids(ids, table)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                    pa.array([checkpoints], pa.binary()),
                    pa.array([payload], pa.binary()),
                ],
                names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")],
            )

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(value.as_buffer(), dtype=kind)
                docs.append(doc)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield close()
                    block, start, size, docs, held = block + 1, start + size, 0, [], []
        if held:
            yield close()

    parts = parts_for(size, PART_TEXT_BYTES)
    (
        tokens.withColumn("tie", F.xxhash64("ids"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "ids")
        .mapInArrow(run, BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )


def _decoded(spark: SparkSession, path: str, fold, schema: str) -> DataFrame:
    """Apply ``fold(doc_id, ids)`` to every document read back; ``schema`` names its values."""
    code = spark.read.parquet(f"{path}/code").toArrow()
    ids, bits = (code.column(c).to_numpy() for c in ("id", "length"))
    lengths = np.zeros(int(ids.max(initial=-1)) + 1, dtype=np.int64)
    lengths[ids] = bits
    shared = spark.sparkContext.broadcast(lengths)
    target = pa.schema([("part", pa.int32()), ("start_in_part", pa.int64()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                found = decode_ids(row["payload"], row["checkpoints"], row["n_ids"], table)
                ends = np.cumsum(np.asarray(row["doc_lengths"], dtype=np.int64))
                rows = []
                at = 0
                for doc, end in zip(row["doc_ids"], ends.tolist()):
                    rows.append((row["part"], row["start"] + at, *fold(doc, found[at:end])))
                    at = end
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target
                )

    ddl = ", ".join(f"{f.name} {DDL[str(f.type)]}" for f in target)
    return spark.read.parquet(f"{path}/blocks").select(
        "part", "start", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "payload"
    ).mapInArrow(run, ddl)


DDL = {"int32": "int", "int64": "long", "list<item: int32>": "array<int>"}


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` of every document, end id included."""
    return _decoded(
        spark,
        path,
        lambda doc, ids: (doc, ids.astype(np.int32)),
        [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))],
    ).select("doc_id", "ids")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    per_doc = _decoded(
        spark,
        path,
        lambda doc, ids: (doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())],
    )
    # One row per part of the files, some 32 MB of text each.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        spark.read.parquet(f"{path}/blocks")
        .groupBy("part")
        .agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return per_doc.join(bases, "part").select(
        "doc_id",
        (F.col("base") + F.col("start_in_part")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def round_trip(df: DataFrame, model_json: str) -> DataFrame:
    """Write ``df``'s ids under the shared folder and return the digest read back."""
    path = scratch(df.sparkSession, "huffman")
    write_ids(df, model_json, path)
    return read_digest(df.sparkSession, path)
