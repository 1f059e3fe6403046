"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

# Text bytes that a task works on at once inside Python.
CHUNK_BYTES = 4 << 20

# Documents handed to a Python worker at once.
BATCH_ROWS = 1000

# White space that ends a word: tab to carriage return, and the space.
SPACES = bytes([9, 10, 11, 12, 13, 32])


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows, unless the session has chosen their size: texts are long."""
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, BATCH_ROWS)


def text_chunks(texts: Iterable[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``most`` bytes, each with the index of its first text."""
    first, held, size = 0, [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def text_bytes(column: pa.ChunkedArray | pa.Array, rows: int = 64) -> Iterator[bytes]:
    """UTF-8 bytes of each text, empty for null; a few rows at a time are taken out of the batch."""
    for first in range(0, len(column), rows):
        part = column.slice(first, rows).cast(pa.binary())
        yield from (b"" if x is None else x for x in part.to_pylist())


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def n_words(text: Column) -> Column:
    """Number of runs of characters that are not white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")

