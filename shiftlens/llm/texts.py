"""Words, bytes and hashes of texts, shared by the corpus operators.

A word is a run of ``[^\\x20\\x09-\\x0D]``; lower case changes A-Z only. Both are what ``bytes``
does by itself, so texts stay UTF-8 bytes and are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that one task keeps the hashes of before it starts its table anew.
CACHED_WORDS = 400_000
#: UTF-8 bytes that a task works on at once; a longer text is worked on alone.
CHUNK_BYTES = 4 << 20

U64 = np.uint64


def remainder(key: str, modulus: int) -> Column:
    """Return crc32 of an id's decimal text modulo ``modulus`` (null id: as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def texts_of(column: pa.Array) -> list[bytes]:
    """Return the UTF-8 bytes of a text column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Return all bytes of a text column in one array, and where each text starts and ends."""
    flat = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most_bytes`` of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // most_bytes
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if stop > start:
                yield batch.slice(start, stop - start)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one (a finalizer in the manner of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes:
    """64-bit hashes of words, with a bounded table of those seen last."""

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed
        self.table: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Return one hash per word."""
        table = self.table
        if len(table) > CACHED_WORDS:
            table.clear()
        for word in set(words).difference(table):
            table[word] = xxhash.xxh64_intdigest(word, self.seed)
        return np.fromiter(map(table.__getitem__, words), U64, len(words))


def same_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the named columns only, whatever else the table carries."""
    return df.select(*[F.col(c) for c in columns])
