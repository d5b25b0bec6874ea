"""Byte-pair encodings as unique paths.

A sequence of tokens is the encoding of its text exactly when each token encodes to
itself and each adjacent pair of tokens is the encoding of its own concatenation.  So the
encoding is the one accepted path of a lattice whose states are text positions, whose
arcs are vocabulary tokens, and whose acceptor forbids the pairs that merging would
break up.  Every prefix of the text has such a path too, and along a path the exact
token count of each reached prefix is the count at the token's start plus one.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick


class Vocabulary:
    """Tokens over text units (characters, or bytes as characters) with merge priorities.

    ``rank(left, right)`` is the priority of merging two adjacent tokens (lower first),
    or None where they don't merge.  ``units`` that are no tokens are numbered as further ones,
    so that every text over them has a path.
    """

    def __init__(self, tokens: dict[str, int], rank: Callable[[str, str], float | None], units: str = ""):
        self.rank = rank
        self.names = {i: t for t, i in tokens.items()}
        for unit in units:
            if unit not in tokens:
                self.names[max(self.names, default=-1) + 1] = unit
        self._kept_pairs = 0
        self._pairs: dict[int, dict[int, bool]] = {}
        self._ends = ahocorasick.Automaton()
        for i, t in self.names.items():
            self._ends.add_word(t, (i, len(t)))
        self._ends.make_automaton()

    def merge(self, text: str) -> list[str]:
        """The encoding by merging: the definition that the paths are built from."""
        parts, rank = list(text), self.rank
        ranks = [rank(parts[i], parts[i + 1]) for i in range(len(parts) - 1)]
        while ranks:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1], parts[at])
            if at < len(ranks):
                ranks[at] = rank(parts[at], parts[at + 1])
        return parts

    def follows(self, left: int, right: int) -> bool:
        """The acceptor: whether token ``right`` may follow ``left`` (-1 for the start)."""
        a, b = self.names.get(left, ""), self.names[right]
        return self.merge(a + b) == ([a, b] if a else [b])

    def lattice(self, text: str) -> tuple[list[int], list[int]]:
        """Last token and token count of each prefix: the tropical shortest distances.

        An automaton reads the text once and names the tokens that end at each place, longest
        first; the one that may follow the encoding before it is the last of the prefix.
        """
        last, count, pairs = [-1] * (len(text) + 1), [0] * (len(text) + 1), self._pairs
        for at, (token, length) in self._ends.iter(text):
            j = at + 1
            if last[j] >= 0:
                continue
            i = j - length
            before = last[i]
            if i and before < 0:
                continue
            row = pairs.get(before)
            if row is None:
                row = pairs[before] = {}
            fits = row.get(token)
            if fits is None:
                fits = row[token] = self.follows(before, token)
                self._kept_pairs += 1
            if fits:
                last[j], count[j] = token, count[i] + 1
        if self._kept_pairs > 2_000_000:
            self._pairs.clear()
            self._kept_pairs = 0
        return last, count
