"""Helpers of the training-data operators: written tables, white space, character classes, column names."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, recorded, removed, shared_dir, shuffle_partitions, written

__all__ = ["SPACE", "WORD", "character_class", "dropped", "recorded", "removed", "shared_dir", "shuffle_partitions", "with_columns", "written"]

#: ASCII white space of the contracts, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def character_class(categories: tuple[str, ...]) -> str:
    """A character class body of all characters of the Unicode categories."""
    found, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)) in categories
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            found.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(found)


def with_columns(df: DataFrame, new: dict) -> DataFrame:
    """Add result columns; an input column of the same name (any case) gives way."""
    lower = {k.lower() for k in new}
    kept = [c for c in df.columns if c.lower() not in lower]
    return df.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in new.items()])

