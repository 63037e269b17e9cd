"""SentencePiece encoding and decoding as shortest paths in a transducer.

The model is compiled into three parts: a normaliser (prefix blank, blanks
written as U+2581), arcs that read the characters of a piece and write its id,
and arcs that read one character without a piece and write its UTF-8 bytes'
ids. Composed with a text this is a lattice over the text's positions; its
shortest path in the tropical semiring gives the ids.

Weights depend on the model's kind. A unigram piece weighs minus its score. In a
merging (BPE) model a sequence is the encoding exactly when each pair of
neighbours is what the merges make of the two put together; so an arc's weight
depends on the arc before it, 0 if the pair stands and infinite if not. Every
position then has one arc of finite weight that ends there, and the path is
found without search. The pair weights are compiled when first needed.

No path crosses two characters that no piece holds next to each other, so the
lattice falls apart there; parts are remembered in bounded memos, since words
repeat.

Edge cases: null and empty texts have no ids and decode to the empty text; a
text may have any length; repeated rows get equal results; U+2581 in a text is
read back as a blank, as the model's own decoder does; extra columns do not
matter. A model with a compiled character map is refused.
"""

from __future__ import annotations

import hashlib
import math
import struct
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import worker_memo

BLANK = "▁"
# Kinds of pieces and models in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 300_000
MEMO_PAIRS = 1_000_000
MEMO_CHARS = 48


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """``(number, value)`` of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, message[at : at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, message[at : at + 4]
            at += 4
        elif kind == 1:
            yield tag >> 3, message[at : at + 8]
            at += 8
        else:
            raise ValueError("not a model file")


class Transducer:
    """A compiled model: normaliser, piece arcs and byte arcs."""

    def __init__(self, model: bytes):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_kind, self.dummy_prefix, squeeze, charmap = UNIGRAM, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.model_kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                charmap = rules.get(2, b"")
                self.dummy_prefix = bool(rules.get(3, 1))
                squeeze = bool(rules.get(4, 1))
        if charmap:
            raise ValueError("models with a compiled character map are not supported")
        if self.model_kind not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds:
            raise ValueError("unigram and BPE models without user-defined pieces are supported")
        self.squeeze = squeeze
        pairs = zip(self.texts, self.kinds)
        self.ids = {t: i for i, (t, k) in enumerate(pairs) if k in (NORMAL, UNUSED)}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes_of = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        # Length of the longest piece that ends in these three characters.
        self.reach: dict[str, int] = {}
        for t in sorted((t for t in self.ids if len(t) > 2), key=len):
            self.reach[t[-3:]] = len(t)
        self.adjacent = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.pairs: dict[tuple[str, str], bool] = {}
        self.output = np.array([self._bytes(i) for i in range(len(self.texts))], dtype=object)

    def _bytes(self, piece: int) -> bytes:
        if self.kinds[piece] == BYTE:
            return bytes([int(self.texts[piece][3:5], 16)])
        if self.kinds[piece] == CONTROL:
            return b""
        if self.kinds[piece] == UNKNOWN:
            return " ⁇ ".encode()
        return self.texts[piece].replace(BLANK, " ").encode()

    # --- normaliser ---

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        text = text.replace(" ", BLANK)
        return BLANK + text if self.dummy_prefix else text

    # --- arcs ---

    def merge(self, chars: str) -> list[str]:
        """What the merges make of ``chars``: best score first, leftmost of equals."""
        parts = list(chars)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair_stands(self, left: str, right: str) -> bool:
        """Whether an arc that reads ``right`` has finite weight after one that reads ``left``."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.merge(left + right) == ([left, right] if left else [right])
            self.pairs[left, right] = found
        return found

    def first_begin(self, chars: str, end: int) -> int:
        """Where the longest arc that can end at ``end`` begins."""
        return max(0, end - self.reach.get(chars[end - 3 : end], 2)) if end > 2 else 0

    def best_path(self, chars: str) -> list[str]:
        """Input labels of the arcs on the shortest path over one part of the lattice."""
        n, ids = len(chars), self.ids
        came = [0] * (n + 1)
        if self.model_kind == BPE:
            stands, pairs, first = self.pair_stands, self.pairs, self.first_begin
            label = [""] * (n + 1)
            for end in range(1, n + 1):
                for begin in range(first(chars, end), end):
                    arc = chars[begin:end]
                    if arc in ids or end - begin == 1:
                        before = label[begin]
                        ok = pairs.get((before, arc))
                        if ok is None:
                            ok = stands(before, arc)
                        if ok:
                            label[end], came[end] = arc, begin
                            break
        else:
            cost = [0.0] + [math.inf] * n
            for end in range(1, n + 1):
                for begin in range(self.first_begin(chars, end), end):
                    piece = ids.get(chars[begin:end])
                    if piece is not None:
                        weight = cost[begin] - self.scores[piece]
                    elif end - begin == 1:
                        weight = cost[begin] - self.worst
                    else:
                        continue
                    if weight < cost[end]:
                        cost[end], came[end] = weight, begin
        out, at = [], n
        while at:
            out.append(chars[came[at] : at])
            at = came[at]
        return out[::-1]

    def write(self, arc: str) -> list[int]:
        """Output of an arc: its piece's id, else its bytes' ids, else the unknown id."""
        piece = self.ids.get(arc)
        if piece is not None:
            return [piece]
        if self.bytes_of:
            return [self.bytes_of[b] for b in arc.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def parts(self, normalised: str) -> list[str]:
        """Cut where no piece holds both neighbours."""
        adjacent, out, begin = self.adjacent, [], 0
        for i in range(1, len(normalised)):
            if normalised[i - 1 : i + 1] not in adjacent:
                out.append(normalised[begin:i])
                begin = i
        out.append(normalised[begin:])
        return out

    def encode_normalised(self, normalised: str, memo: dict | None = None) -> list[int]:
        out: list[int] = []
        if not normalised:
            return out
        for part in self.parts(normalised):
            ids = memo.get(part) if memo is not None else None
            if ids is None:
                ids = [i for arc in self.best_path(part) for i in self.write(arc)]
                if memo is not None and len(part) <= MEMO_CHARS:
                    memo[part] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_normalised(self.normalise(text or ""))

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """Text of ``ids``; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(self.output[np.asarray(ids, dtype=np.int64)].tolist())
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class Encoder:
    """Encodes texts word by word through bounded memos."""

    def __init__(self, model: bytes):
        memo = worker_memo("wfst")
        key = hashlib.sha256(model).digest()
        if memo.get("model") != key:
            memo.clear()
            memo.update(model=key, transducer=Transducer(model), words={}, parts={})
        self.transducer: Transducer = memo["transducer"]
        self.words: dict[str, bytes] = memo["words"]
        self.parts: dict[str, list[int]] = memo["parts"]
        t = self.transducer
        # A blank after another character starts a part of its own.
        self.by_word = t.dummy_prefix and not t.squeeze and not any(
            pair[1] == BLANK and pair[0] != BLANK for pair in t.adjacent
        )

    def encode(self, text: str | None) -> bytes:
        """Ids as packed unsigned 32-bit integers."""
        if not text:
            return b""
        text = text.replace(BLANK, " ")
        if not self.by_word or text[0] == " " or "  " in text:
            return self._packed(self.transducer.normalise(text))
        words = text.split(" ")
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        known = self.words
        out = list(map(known.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    word = words[i]
                    ids = known.get(word)
                    if ids is None:
                        ids = self._packed(BLANK + word)
                        if len(word) <= MEMO_CHARS:
                            known[word] = ids
                    out[i] = ids
        return b"".join(out)

    def _packed(self, normalised: str) -> bytes:
        if len(self.parts) > MEMO_WORDS:
            self.parts.clear()
        return array("I", self.transducer.encode_normalised(normalised, self.parts)).tobytes()


def encode(df: DataFrame, model: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: ids of every text, and the SHA-256 of the
    text that they decode to."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        decode = encoder.transducer.decode
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                packed = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                ids = [np.frombuffer(p, dtype="<u4") for p in packed]
                counts = np.array([len(x) for x in ids], dtype=np.int64)
                flat = np.concatenate(ids).astype(np.int32)
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                sums = [
                    hashlib.sha256(decode(x).encode("utf-8", "replace")).hexdigest()
                    for x in ids
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(sums, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256"],
                )

    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of every row's ids; null ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Encoder(shared.value).transducer
        for batch in batches:
            texts = [transducer.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{ids_col}`").cast("array<int>").alias("ids"),
    ).mapInArrow(run, "doc_id long, text string")
