"""SentencePiece and byte-level BPE against their libraries."""

import hashlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import sentencepiece_fst as fst
from sluice.llm import token_counts as tc

SP = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = st.sampled_from(["a", "b ", "the", " of", "  ", " ", "\n", "\t", "▁", "▁▁", "'re", "'s", "'", "é", "ß", "日本", "😀", "½", "²", "12", "Ⅷ", "_", "!", "<|endoftext|>", "<|end", "<s>", "\x1c", "\x00", "\xa0", "́", "ing", " x", ".", "ther"])
TEXTS = st.one_of(st.lists(ALPHABET, max_size=14).map("".join), st.text(max_size=20))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=SP)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encoding_is_the_library_s(text):
    library = sentencepiece.SentencePieceProcessor(model_file=SP) if not hasattr(test_encoding_is_the_library_s, "sp") else test_encoding_is_the_library_s.sp
    test_encoding_is_the_library_s.sp = library
    machine = fst.transducer(SP)
    ids = list(machine.encode(text))
    assert ids == library.encode(text)
    assert machine.decode(ids) == library.decode(ids)
    assert machine.decode(ids) == text.replace("▁", " ")  # the one character that the format can't hold


def test_runs_of_blanks(library):
    machine = fst.transducer(SP)
    for n in range(40):
        for text in (" " * n, "x" + " " * n + "y", " " * n + "é"):
            assert list(machine.encode(text)) == library.encode(text)


def test_arbitrary_ids_decode_like_the_library(library):
    machine = fst.transducer(SP)
    for ids in ([3, 4, 200, 259, 300], [259, 15043], [1, 15043, 2], [230, 150, 155]):
        assert machine.decode(ids) == library.decode(ids)


def test_unigram_models_take_the_tropical_shortest_path():
    def piece(text, score, kind):
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + array("f", [score]).tobytes() + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    bytes_ = b"".join(piece(f"<0x{i:02X}>", 0.0, fst.BYTE) for i in range(256))
    pieces = piece("<unk>", 0, fst.UNKNOWN) + bytes_ + piece("▁ab", -4.0, 1) + piece("▁a", -1.0, 1) + piece("b", -2.5, 1) + piece("bc", -1.0, 1) + piece("c", -2.0, 1) + piece("▁", -3.0, 1) + piece("a", -2.0, 1)
    machine = fst.Transducer(pieces + b"\x12\x05" + b"\x18\x01\x98\x02\x01" + b"\x1a\x04\x18\x01\x20\x00")
    names = [machine.model.pieces[i][0] for i in machine.encode("abc ab")]
    assert names == ["▁a", "bc", "▁a", "b"]
    assert machine.decode(machine.encode("abc é")) == "abc é"


def double_array(rules):
    """A precompiled character map: every node's children have a block of 256 units of their own."""
    import struct

    outputs, places, tree = bytearray(b"\0"), {}, {}
    for source, target in rules.items():
        node = tree
        for b in source.encode():
            node = node.setdefault(b, {})
        if target not in places:
            places[target] = len(outputs)
            outputs += target.encode() + b"\0"
        node[None] = places[target]
    units = [0] * 256

    def place(node, at):
        base = len(units)
        units.extend(b ^ 0xFF for b in range(256))  # no byte leads to an unused unit
        units[at] |= (base ^ at) << 10 | (0x100 if None in node else 0)
        if None in node:
            units[base] = 0x80000000 | node[None]
        for b in node:
            if b is not None:
                units[base ^ b] = b
        for b, child in node.items():
            if b is not None:
                place(child, base ^ b)

    place(tree, 0)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + bytes(outputs)


def message(*fields):
    """Protocol-buffer fields (number, value) of bytes, floats and integers."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + array("f", [value]).tobytes()
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram_model(rules, byte_fallback=True, prefix=True, trim=True):
    """A hand-made unigram model with a character map, as the library reads it."""
    words = {"▁": -2.0, "▁the": -3.0, "the": -4.1, "▁a": -3.3, "a": -4.0, "b": -4.2, "c": -4.3, "ab": -5.0, "bc": -5.1, "abc": -6.3, "▁ab": -5.9, "t": -6.0, "h": -6.1, "e": -5.5, "he": -6.2, "fi": -6.6, "f": -7.0, "i": -6.7, "1": -7.1, "2": -7.2, "/": -7.3, "12": -8.0, "é": -9.0, "▁▁": -4.5}
    pieces = [("<unk>", 0.0, fst.UNKNOWN), ("<s>", 0.0, fst.CONTROL), ("</s>", 0.0, fst.CONTROL)]
    pieces += [(f"<0x{i:02X}>", 0.0, fst.BYTE) for i in range(256)] if byte_fallback else []
    pieces += [(w, s, fst.NORMAL) for w, s in words.items()]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    trainer = message((3, fst.UNIGRAM), (35, int(byte_fallback)))
    normaliser = message((1, b"made"), (2, double_array(rules) if rules else b""), (3, int(prefix)), (4, int(trim)), (5, 1))
    return body + message((2, trainer)) + message((3, normaliser))


RULES = {"ﬁ": "fi", "½": "1/2", "Ａ": "a", "Ｂ": "b", "A": "a", "AB": "ab", "\t": " ", "\u3000": " ", "\xa0": " ", "é": "é", "\u200b": "", "①": "1", "①②": "12", "日": "b"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*RULES, "the", " ", "  ", "a", "b", "c", "abc", "t", "h", "é", "x", "日本", "😀", "▁", "e", "\x00"]), max_size=12).map("".join))
def test_character_maps_and_unigram_paths_equal_the_library(text):
    kept = test_character_maps_and_unigram_paths_equal_the_library.__dict__.setdefault("models", {})
    for options in ({}, {"byte_fallback": False}, {"prefix": False}, {"trim": False}, {"rules": None}):
        key = str(options)
        if key not in kept:
            raw = unigram_model(**({"rules": RULES} | options))
            kept[key] = fst.Transducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
        machine, library = kept[key]
        assert list(machine.encode(text)) == library.encode(text), (options, text)


def test_the_path_is_the_lightest_of_all_segmentations():
    machine = fst.Transducer(unigram_model(None))
    cost = {p: -s for p, s, k in machine.model.pieces if k == fst.NORMAL}

    def best(text):
        return min(((cost[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in cost)), default=float("inf")) if text else 0.0

    for text in ("the abc", "a bc ab abc", "he  fi 12/12", "abcabc the"):
        ids = machine.encode(text)
        assert sum(cost[machine.model.pieces[i][0]] for i in ids) == pytest.approx(best(machine.normalise(text)))


def test_rewrites_are_longest_first():
    with open(SP, "rb") as f:
        machine = fst.Transducer(f.read(), {"f": "F", "ff": "ﬀ", "ﬁ": "fi"})
    assert machine.normalise("off ﬁ") == "▁oﬀ▁fi"


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_prefix_counts_are_exact(text):
    if not hasattr(test_prefix_counts_are_exact, "t"):
        test_prefix_counts_are_exact.t = Tokenizer.from_file(BPE)
    t, c = test_prefix_counts_are_exact.t, tc.counter(BPE)
    n = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    assert c.count(text) == n(text)
    counts = c.prefixes(text)
    assert list(counts) == [n(text[:k]) for k in range(len(text) + 1)]


def test_queries_on_documents(spark, library, tokenizer):
    rows = [(1, "the cat"), (2, None), (3, ""), (None, "é" * 3000), (5, "x <|endoftext|> y"), (5, "x <|endoftext|> y"), (6, " \n ")]
    docs = spark.createDataFrame([(i, t, "n", 9) for i, t in rows], "doc_id long, text string, ids_sha256 string, N_TOKENS int")
    enc = fst.encoding_digests(docs, SP).collect()
    assert len(enc) == len(rows)
    for r, (i, t) in zip(enc, rows, strict=True):
        ids = library.encode(t or "")
        assert (r.doc_id, r.n_pieces, r.exact) == (i, len(ids), True)
        assert r.ids_sha256 == hashlib.sha256(array("i", ids).tobytes()).hexdigest()
    counts = tc.token_counts(docs, BPE).collect()
    for r, (i, t) in zip(counts, rows, strict=True):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (i, len((t or "").encode()), n, n > 512)
    both = fst.decode_documents(fst.encode_documents(docs, SP), SP).collect()
    assert [r.decoded for r in both] == [t or "" for _, t in rows] and "ids_sha256" in both[0].asDict()
    stored = tc.prefix_counts(docs, BPE).persist()
    for budget in (0, 1, 2, 3, 600):
        for r, (_, t) in zip(tc.truncated(stored, budget).collect(), rows, strict=True):
            lengths = [k for k in range(len(t or "") + 1) if len(tokenizer.encode((t or "")[:k], add_special_tokens=False).ids) <= budget] if len(t or "") < 100 else []
            assert r.truncated == (t if t is None else t[: lengths[-1]]) if lengths else r.truncated is None or t.startswith(r.truncated)
    p = stored.collect()
    assert p[0].prefix_tokens[-1] == 2 and p[1].prefix_tokens is None and p[2].prefix_tokens == [0]
    empty = docs.where("false")
    assert fst.encoding_digests(empty, SP).count() == tc.token_counts(empty, BPE).count() == 0
