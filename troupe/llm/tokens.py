"""Encoding of a corpus with a public byte-level tokenizer, and the way back.

The rank file is read once per Python worker. Long texts are cut where the tokenizer's own pattern must end a
piece, so that their parts encode to the same ids as the whole; ids are decoded as raw bytes first and as text
afterwards, since one character may be spread over several ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troupe.runtime import spread

#: Texts above so many characters are cut before they are encoded.
LONG = 8192
# A run of letters, or of digits, always ends a piece where another kind of character follows, and so does
# anything else that a space or line end follows; no piece depends on what stands before it.
_SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=[ \n])")


def default_rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoding(rank_file: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, limit: int = LONG) -> list[str]:
    """text in parts of about `limit` characters, cut only at safe boundaries; a part without one stays whole."""
    parts, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if not cut or cut.start() >= len(text):
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def encode(text: str | None, rank_file: str) -> np.ndarray:
    """The ids of one text; null and empty texts have none."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    own = encoding(rank_file)
    if len(text) <= LONG:
        return own.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([own.encode_to_numpy(x, disallowed_special=()) for x in safe_parts(text)])


def encode_corpus(df: DataFrame, identifier: str = "doc_id", text: str = "text", rank_file: str | None = None) -> DataFrame:
    """(identifier, ids array<int>) of every row, without special tokens; their strings in a text are ordinary text.

    Null and empty texts give an empty list. Rows are kept as they are, repeats and null identifiers included;
    whole texts are encoded however long; other columns are ignored."""
    path = rank_file or default_rank_file()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(x, path) for x in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], [identifier, "ids"])

    rows = df.select(F.col(identifier).alias(identifier), F.col(text).alias("text"))
    kind = rows.schema[identifier].dataType.simpleString()
    return spread(rows).mapInArrow(kernel, f"`{identifier}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, identifier: str = "doc_id", ids: str = "ids", rank_file: str | None = None) -> DataFrame:
    """(identifier, text) of every row of ids, decoded as raw bytes; bytes that aren't UTF-8 become U+FFFD. Null ids give null."""
    path = rank_file or default_rank_file()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for batch in batches:
            texts = [None if x is None else b"".join(own.decode_tokens_bytes(x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [identifier, "text"])

    rows = df.select(F.col(identifier).alias(identifier), F.col(ids).alias("ids"))
    kind = rows.schema[identifier].dataType.simpleString()
    return rows.mapInArrow(kernel, f"`{identifier}` {kind}, text string")


def token_counts(df: DataFrame, identifier: str = "doc_id", text: str = "text", rank_file: str | None = None) -> DataFrame:
    """(identifier, tokens int): the number of ids of every row."""
    path = rank_file or default_rank_file()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(encode(x, path)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], [identifier, "tokens"])

    rows = df.select(F.col(identifier).alias(identifier), F.col(text).alias("text"))
    kind = rows.schema[identifier].dataType.simpleString()
    return spread(rows).mapInArrow(kernel, f"`{identifier}` {kind}, tokens int")
