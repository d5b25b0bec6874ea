"""Exact token counts at every prefix, for byte-level BPE tokenizers.

Text is cut into pretokens as the tokenizer does; inside each, one dynamic programme over
its bytes yields the token count of *every* prefix (``bpe_paths.Vocabulary.lattice``).
``prefix_counts`` stores the counts of all prefixes of a text as a column.  The token count,
budget tests and truncation (``token_counts``, ``truncated``) are look-ups in that column,
in the JVM: nothing is encoded again.

A prefix that ends inside a pretoken can be cut differently from the whole text in three
places, each handled where it occurs: at trailing white space (always one pretoken), inside
a contraction such as ``'re``, and inside the text of a special token.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_paths import Vocabulary
from .shared import character_class

KEPT_WORDS = 500_000
_RUNS = re.compile(r"\s\s")


def _pretokens() -> re.Pattern:
    """Contractions, letters, numbers, other runs (each with a space before), white space.

    ``\\w`` without ``\\d``, ``_`` and the other numbers is exactly the letters; ``\\s`` is
    taken without the separators U+001C to U+001F, which tokenizers count as other characters.
    """
    numbers = character_class(("Nl", "No"))
    letter, number, other = rf"[^\W\d_{numbers}]", rf"[\d{numbers}]", r"(?:[^\w\s]|[_\x1c-\x1f])"
    space = r"[^\S\x1c-\x1f]"
    solid = r"(?![\S\x1c-\x1f])"
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?{letter}+| ?{number}+| ?{other}+|{space}+{solid}|{space}+")


def _byte_letters() -> dict[str, str]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and the rest, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of prefixes under the tokenizer of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE with the standard pretokens and without a normaliser is supported")
        if model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("ignore_merges and dropout are not supported")
        letters = _byte_letters()
        raw = lambda token: "".join(map(letters.__getitem__, token))
        special = {t["content"] for t in spec.get("added_tokens", [])}
        tokens = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.vocabulary = Vocabulary(tokens, lambda a, b: ranks.get((a, b)), "".join(map(chr, range(256))))
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.pretokens = _pretokens()
        self.kept: dict[str | tuple, tuple[bytes, bytes, int, bool]] = {}

    def _counts(self, word: str) -> list[int]:
        """Counts of the prefixes of one pretoken, by character, without the empty one."""
        if word.isascii():
            return self.vocabulary.lattice(word)[1][1:]
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.vocabulary.lattice(raw.decode("latin-1"))[1]
        return [counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]

    def _solved(self, word: str, run: str, run_count: int) -> tuple[bytes, bytes, int, bool]:
        """Of a pretoken: the counts of the prefixes that end in it less that before it, its count and length (both as 32-bit integers), its count, and whether it is white space.

        ``run`` is the white space right before it, which counts ``run_count`` tokens there.
        """
        if word[0].isspace() and word[0] not in "\x1c\x1d\x1e\x1f":
            every = counts = self._counts(word)
            n = len(word) if not word.strip() else 1  # its white space
            if run:
                counts = [c - run_count for c in self._counts(run + word[:n])[len(run) :]] + every[n:]
            return array("i", counts).tobytes(), array("i", (every[-1], len(word))).tobytes(), every[-1], n == len(word)
        counts = self._counts(word)
        if word in ("'re", "'ve", "'ll"):
            tick, letter = self._counts("'")[-1], self._counts(word[1])[-1]
            counts = [tick, tick + letter, counts[-1]]
        return array("i", counts).tobytes(), array("i", (counts[-1], len(word))).tobytes(), counts[-1], False

    def _kept(self, key: str | tuple, word: str, run: str, run_count: int) -> tuple[bytes, bytes, int, bool]:
        found = self.kept.get(key)
        if found is None:
            found = self._solved(word, run, run_count)
            if len(self.kept) < KEPT_WORDS and len(word) + len(run) < 64:
                self.kept[key] = found
        return found

    def _ordinary(self, text: str, base: int) -> np.ndarray:
        """Counts after each character of text without special strings."""
        kept, words = self.kept, self.pretokens.findall(text)
        if not words:
            return np.empty(0, np.int32)
        solved = list(map(kept.get, words))
        if _RUNS.search(text):
            run, run_count = "", 0
            for k, word in enumerate(words):
                # white space before matters to pretokens that begin with white space
                inside = bool(run) and word[0].isspace()
                found = solved[k] = self._kept((run, run_count, word), word, run, run_count) if inside else solved[k] or self._kept(word, word, "", 0)
                if found[3]:
                    run, run_count = run + word, run_count + found[2]
                elif run:
                    run, run_count = "", 0
        else:
            k = -1
            for _ in range(solved.count(None)):
                k = solved.index(None, k + 1)
                solved[k] = self._kept(words[k], words[k], "", 0)
        parts, sizes, _, _ = zip(*solved)  # noqa: B905
        own, lengths = np.frombuffer(b"".join(sizes), dtype=np.int32).reshape(-1, 2).T
        before = np.cumsum(own, dtype=np.int32)
        before += base - own
        return np.frombuffer(b"".join(parts), dtype=np.int32) + np.repeat(before, lengths)

    def prefixes(self, text: str) -> np.ndarray:
        """``prefixes(text)[k]`` is the token count of ``text[:k]``, for k from 0 to the length."""
        out, at, base = [np.zeros(1, dtype=np.int32)], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            part = self._ordinary(text[at : m.end() - 1], base)  # the special string but its last character is ordinary text
            out.append(part)
            # text before the special string is cut at it, so its own last prefix is exact
            base = (int(part[m.start() - at - 1]) if m.start() > at else base) + 1
            out.append(np.array([base], dtype=np.int32))
            at = m.end()
        out.append(self._ordinary(text[at:], base))
        return np.concatenate(out)

    def count(self, text: str) -> int:
        """Tokens of the whole text; special strings count one each."""
        return int(self.prefixes(text)[-1])


_loaded: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a tokenizer file, built once per worker."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def prefix_counts(docs: DataFrame, path: str, rows: int = 256) -> DataFrame:
    """The input's columns and ``prefix_tokens array<int>``: the count after 0, 1, ... characters (null for null).

    An input column of that name gives way.  ``rows`` texts at a time are sent back.
    """
    keep = [c for c in docs.columns if c.lower() != "prefix_tokens"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches):
        c = counter(path)
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                texts = batch.column(at).cast(pa.string())
                counts = [np.empty(0, np.int32) if t is None else c.prefixes(t) for t in texts.to_pylist()]
                ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts)), mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "prefix_tokens"])

    at = keep.index("text")
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{schema}, prefix_tokens array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, read off the stored prefix counts.

    Null text is empty and has no tokens.  Other columns are ignored; an empty table gives
    an empty result.
    """
    counted = prefix_counts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), path)
    n = F.coalesce(F.element_at("prefix_tokens", -1), F.lit(0)).cast("long")
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))


def truncated(counted: DataFrame, budget: int) -> DataFrame:
    """The columns of a table with ``prefix_tokens`` and ``truncated``: the longest prefix of at most ``budget`` tokens (null for null)."""
    length = F.array_max(F.transform("prefix_tokens", lambda n, k: F.when(n <= budget, k)))
    kept = [F.col(f"`{c}`") for c in counted.columns if c.lower() != "truncated"]
    return counted.select(*kept, F.substring("text", F.lit(1), length).alias("truncated"))
