"""The canonical form of tags, features and n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

# hyphens (of any script), underscores and white space read as one space
_GAP = re.compile(r"[\s_\-‐‑‒–—―−­﹣－]+")


def canonical(term: str | None) -> str | None:
    """NFKC, lower case, each run of hyphens, underscores and white space as one space, none at the ends.
    Null and empty terms give None."""
    if term is None:
        return None
    return _GAP.sub(" ", unicodedata.normalize("NFKC", term).lower()).strip() or None


def canonical_array(values: pa.Array) -> pa.Array:
    """canonical() of every value; each distinct value of the batch is worked out once."""
    coded = pc.dictionary_encode(values)
    names = pa.array([canonical(x) for x in coded.dictionary.to_pylist()], pa.string())
    return names.take(coded.indices)


def canonical_lists(lists: pa.ListArray) -> Iterator[list[str]]:
    """For every list of strings, its canonical terms in order with repeats, without null and empty ones."""
    flat = canonical_array(lists.flatten()).to_pylist()
    at = 0
    for size in pc.list_value_length(lists).to_pylist():
        yield [x for x in flat[at : at + (size or 0)] if x is not None]
        at += size or 0
