"""SentencePiece encoding and decoding by composed weighted transducers.

The model file compiles to three machines (``wfst``):

* the normaliser, a deterministic transducer that rewrites text, the longest rule first, to the
  piece alphabet: the model's precompiled character map or rules given as a table, then white
  space escaped as U+2581 and a leading one added where the model says so;
* the piece transducer, a trie whose arcs read characters and whose last arcs write a piece
  with weight ``-score``; characters without a piece take byte-fallback arcs;
* the acceptor of piece sequences.  For unigram models it accepts all of them.  The scores of a
  BPE model only order merges, and their sum over a path has no meaning; there, piece arcs weigh
  nothing, and the acceptor's states are the last pieces, with an arc of weight 0 where
  merging leaves the pair as it is and none (weight infinity) where it would not.

Encoding composes a text with the machines and takes the shortest path in the tropical
semiring.  No piece but a run of U+2581 has that character past its start, so the
composition has a single state at each word boundary and is solved word by word;
solved words are kept in a bounded table, as arcs of their own.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_paths import Vocabulary
from .wfst import AllowedPairs, AnySequence, Pieces, Rewriter, character_map_rules, shortest_path, trie_rules

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KEPT_WORDS = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = raw[at : at + 8], at + 8
        elif kind == 5:
            value, at = struct.unpack("<f", raw[at : at + 4])[0], at + 4
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


class Model:
    """Pieces and settings of a SentencePiece model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.space_as_suffix = bool(trainer.get(24, 0))
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.trim = bool(normaliser.get(4, 1))
        self.character_map = normaliser.get(2) or b""
        if self.space_as_suffix or not normaliser.get(5, 1):
            raise ValueError("white space as suffix, or not escaped, is not supported")


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, raw: bytes, rewrites: dict[str, str] | None = None):
        m = self.model = Model(raw)
        if rewrites and m.character_map:
            raise ValueError("the model has a character map of its own")
        rules = character_map_rules(m.character_map) if m.character_map else trie_rules(rewrites) if rewrites else None
        self.rewriter = Rewriter(rules) if rules else None
        self.ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
        self.bytes = {}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
        for i, (p, _, kind) in enumerate(m.pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        cost = {p: -m.pieces[i][1] for p, i in self.ids.items()}
        self.single = all(SPACE not in p[1:] or set(p) == {SPACE} for p in self.ids)
        inside = {c for p in self.ids if len(p) > 1 for c in p} | {SPACE}
        if self.single:
            # words with the spaces before them, and characters that no longer piece holds
            letters = "".join(re.escape(c) for c in sorted(inside - {SPACE}))
            self.words = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|(?s:.)")
        if m.kind == BPE:
            merged = Vocabulary(self.ids, lambda a, b: cost.get(a + b)).merge
            self.pieces = Pieces(dict.fromkeys(self.ids, 0.0), 0.0)
            self.sequences = AllowedPairs(lambda a, b: merged(a + b) == ([a, b] if a else [b]))
        else:
            self.pieces = Pieces(cost, max(cost.values(), default=0.0) + 10.0)
            self.sequences = AnySequence()
        self.kept: dict[str, bytes] = {}
        self.outputs = self._outputs()

    # normaliser

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if self.rewriter is not None:
            text = self.rewriter.apply(text)
        if self.model.trim:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return ""
        escaped = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        return escaped.rstrip(SPACE) if self.model.trim else escaped

    # composition and shortest path

    def _fallback(self, c: str) -> list[int]:
        if not self.model.byte_fallback:
            return [self.unknown]
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]

    def _solve(self, text: str) -> list[int]:
        out: list[int] = []
        for p in shortest_path(text, self.pieces, self.sequences):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.model.byte_fallback or not out or out[-1] != self.unknown:  # runs of unknowns are one
                out.extend(self._fallback(p))
        return out

    def encode(self, text: str) -> array:
        """Piece ids of a whole text, as 32-bit integers."""
        out = array("i")
        out.frombytes(self.encode_bytes(text))
        return out

    def encode_bytes(self, text: str) -> bytes:
        text = self.normalise(text)
        if not self.single or not self.model.byte_fallback:
            return array("i", self._solve(text)).tobytes()
        kept, words = self.kept, self.words.findall(text)
        out = list(map(kept.get, words))
        k = -1
        for _ in range(out.count(None)):
            k = out.index(None, k + 1)
            w = words[k]
            found = out[k] = kept.get(w) or array("i", self._solve(w)).tobytes()
            if len(kept) < KEPT_WORDS and len(w) < 64:
                kept[w] = found
        return b"".join(out)

    # the inverse transducer

    def _outputs(self) -> list[bytes]:
        out = []
        for i, (p, _, kind) in enumerate(self.model.pieces):
            if kind == BYTE:
                out.append(bytes([int(p[3:5], 16)]))
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            elif kind == CONTROL:
                out.append(b"")
            else:
                out.append(p.replace(SPACE, " ").encode())
        return out

    def decode(self, ids) -> str:
        """Text of piece ids; invalid byte sequences become U+FFFD."""
        outputs = self.outputs
        raw = b"".join([outputs[i] for i in ids])
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The machines of a model file, compiled once per worker."""
    if path not in _compiled:
        with open(path, "rb") as f:
            _compiled[path] = Transducer(f.read())
    return _compiled[path]


ENCODED_SQL = "doc_id long, n_chars long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean"


def _encoded(path: str):
    def run(batches):
        machine = transducer(path)
        low, high = min(machine.bytes.values(), default=0), max(machine.bytes.values(), default=-1)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[] for _ in range(6)]
            for t in texts:
                text = t.as_py() or ""
                raw = machine.encode_bytes(text)
                pieces = np.frombuffer(raw, dtype=np.int32)
                decoded = machine.decode(pieces.tolist())
                n_bytes = int(np.count_nonzero((pieces >= low) & (pieces <= high)))
                row = (len(text), len(pieces), n_bytes, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array(out[0], pa.int64()), "n_pieces": pa.array(out[1], pa.int64()),
                    "n_byte_pieces": pa.array(out[2], pa.int64()), "ids_sha256": pa.array(out[3], pa.string()), "decoded_sha256": pa.array(out[4], pa.string()),
                    "exact": pa.array(out[5], pa.bool_()),
                }
            )

    return run


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: sizes and hashes of the encoding, and whether it decodes to the text.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers.  Null and empty texts
    have no pieces.  Other columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoded(path), ENCODED_SQL)


def _ids(path: str, column: int, rows: int = 512):
    def run(batches):
        machine = transducer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):  # ids are sent back a few rows at a time
                batch = whole.slice(at, rows)
                parts = [machine.encode_bytes(t.as_py() or "") for t in batch.column(column).cast(pa.string())]
                ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "piece_ids"])

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The input's columns and ``piece_ids array<int>``; an input column of that name gives way."""
    keep = [c for c in docs.columns if c.lower() != "piece_ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    return kept.mapInArrow(_ids(path, keep.index("text")), f"{schema}, piece_ids array<int>")


def _texts(path: str):
    def run(batches):
        machine = transducer(path)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The input's columns but ``piece_ids``, and ``decoded``, their text (null for null)."""
    keep = [c for c in encoded.columns if c.lower() not in ("piece_ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in keep)
    return encoded.select(*[F.col(f"`{c}`") for c in keep], F.col("piece_ids")).mapInArrow(_texts(path), f"{schema + ', ' if schema else ''}decoded string")
