"""Weighted transducers over text, and shortest paths in the tropical semiring.

A machine has states and arcs that read a character, write an output (or nothing) and add a
weight.  ``shortest_path`` composes a text, taken as a linear acceptor, with a machine that
writes pieces and with an acceptor of piece sequences, and takes the path of the least total
weight.  The composition is never built: its states are (text position, machine state,
acceptor state), visited by position, which is a topological order.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable

import ahocorasick

INFINITY = float("inf")


class Pieces:
    """The transducer of a piece inventory, with its states determinised over all places where a piece may begin.

    Reading a character, it goes on by one arc (an Aho-Corasick automaton), and names the pieces
    that end there, longest first, with their lengths and weights.  A character that is no piece
    itself is also read by a fallback arc, which writes it as it is with the weight ``fallback``.
    """

    def __init__(self, weights: dict[str, float], fallback: float):
        self.fallback, self.known, self.ends = fallback, {p for p in weights if len(p) == 1}, ahocorasick.Automaton()
        for piece, weight in weights.items():
            self.ends.add_word(piece, (piece, len(piece), weight))
        self.ends.make_automaton()


class AnySequence(dict):
    """The acceptor of all piece sequences: one state, named by any piece, whose arcs weigh nothing."""

    START = ""

    def __init__(self):
        super().__init__()
        self.arcs: dict[str, float] = defaultdict(float)

    def __missing__(self, state: str) -> dict[str, float]:
        return self.setdefault(state, self.arcs)


class AllowedPairs(dict):
    """The acceptor of piece sequences whose adjacent pairs are allowed; its states are the last pieces.

    An arc weighs 0 where ``allowed(left, right)`` (left is empty at the start), else infinity.
    States and arcs are made when first asked for; at most ``most`` states are kept.
    """

    START = ""

    class Arcs(dict):
        def __init__(self, allowed: Callable[[str, str], bool], state: str):
            super().__init__()
            self.allowed, self.state = allowed, state

        def __missing__(self, piece: str) -> float:
            weight = self[piece] = 0.0 if self.allowed(self.state, piece) else INFINITY
            return weight

    def __init__(self, allowed: Callable[[str, str], bool], most: int = 100_000):
        super().__init__()
        self.allowed, self.most = allowed, most

    def __missing__(self, state: str) -> dict[str, float]:
        if len(self) >= self.most:
            self.clear()
        arcs = self[state] = self.Arcs(self.allowed, state)
        return arcs


def shortest_path(text: str, pieces: Pieces, sequences: AnySequence | AllowedPairs) -> list[str]:
    """Pieces on the lightest path of the composition; of equally light ones that whose last piece starts first.

    Both acceptors have one state for all accepted paths to a text position: the one there is, or
    the last piece of the one encoding that a prefix has.  So a position keeps one, and the arcs
    that leave it.
    """
    n, known = len(text), pieces.known
    best, back, follows = [0.0] + [INFINITY] * n, [0] * (n + 1), [sequences[sequences.START]] * (n + 1)
    unknown = [] if known.issuperset(text) else [i for i, c in enumerate(text) if c not in known]
    done = 0

    def fall_back(until: int) -> int:
        """Take the fallback arcs of unknown characters up to a place; the number taken so far."""
        at = done
        while at < len(unknown) and unknown[at] <= until:
            i = unknown[at]
            total = best[i] + pieces.fallback + follows[i][text[i]]
            if total < best[i + 1]:
                best[i + 1], back[i + 1], follows[i + 1] = total, i, sequences[text[i]]
            at += 1
        return at

    for end, (piece, length, weight) in pieces.ends.iter(text):
        if unknown and done < len(unknown) and unknown[done] <= end:
            done = fall_back(end)
        j = end + 1
        i = j - length
        total = best[i] + weight
        if total < best[j] and (total := total + follows[i][piece]) < best[j]:
            best[j], back[j], follows[j] = total, i, sequences[piece]
    fall_back(n)
    out, j = [], n
    while j:
        out.append(text[back[j] : j])
        j = back[j]
    return out[::-1]


class Rewriter:
    """A deterministic transducer that rewrites text from left to right, the longest rule first.

    ``rules`` reads the longest rule at a place: bytes and place to (length, output), or None,
    where one character is copied.
    """

    def __init__(self, rules: Callable[[bytes, int], tuple[int, bytes] | None]):
        self.rules = rules

    def apply(self, text: str) -> str:
        raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(raw):
            found = self.rules(raw, at)
            if found is None:
                first = raw[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = size, raw[at : at + size]
            out.append(found[1])
            at += found[0]
        return b"".join(out).decode("utf-8", "surrogatepass")


def trie_rules(rewrites: dict[str, str]) -> Callable[[bytes, int], tuple[int, bytes] | None]:
    """Rules given as a table, compiled to a trie."""
    table: list[dict[int, int]] = [{}]
    outputs: dict[int, bytes] = {}
    for source, target in rewrites.items():
        state = 0
        for b in source.encode():
            if b not in table[state]:
                table.append({})
                table[state][b] = len(table) - 1
            state = table[state][b]
        outputs[state] = target.encode()

    def longest(raw: bytes, at: int) -> tuple[int, bytes] | None:
        state, best, i = 0, None, at
        while i < len(raw) and (state := table[state].get(raw[i], -1)) >= 0:
            i += 1
            if state in outputs:
                best = i - at, outputs[state]
        return best

    return longest


def character_map_rules(compiled: bytes) -> Callable[[bytes, int], tuple[int, bytes] | None]:
    """Rules of a precompiled character map: a double-array trie over bytes, then zero-ended outputs.

    The first four bytes are the size of the array.  A unit holds the byte that leads to it
    (bits 0 to 7, and bit 31 unset), whether a value hangs on it (bit 8) and the offset of its
    children (from bit 10, in steps of 256 where bit 9 is set); a value is the place of an output.
    """
    size = struct.unpack_from("<I", compiled)[0]
    units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
    outputs = compiled[4 + size :]

    def children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(raw: bytes, at: int) -> tuple[int, bytes] | None:
        node, best = children(units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= children(unit)
            if unit >> 8 & 1:
                place = units[node] & 0x7FFFFFFF
                best = i + 1 - at, outputs[place : outputs.index(b"\0", place)]
        return best

    return longest

