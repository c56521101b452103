"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

SPACES = " \t\n\v\f\r"  # [\x20\x09-\x0D]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Workers started from another folder find this package too, where its folder is there for them.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no taken name is the same but for its case."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of_id(column: str = "doc_id"):
    """CRC-32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch with about ``max_bytes`` of text each; one row may be longer."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // max_bytes
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(piece)) + 1, [len(sizes)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers are reused by the stages that follow


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[ord(c) for c in SPACES]] = True
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def words(column: pa.Array, inside: np.ndarray | Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, words per row, starts, ends, bytes) of the runs of bytes for which ``inside`` is true.

    ``inside``: a flag per byte value, or a function of the bytes and the rows' offsets that gives one per byte.
    A-Z count as a-z. A word's 64-bit hash is a polynomial over a random value per byte; two different
    words meet with a probability of about 2^-64.
    """
    data, offsets = utf8(column)
    n = len(data)
    member = inside(data, offsets) if callable(inside) else inside[data]
    begins, finishes = member.copy(), member.copy()
    begins[1:] &= ~member[:-1]
    finishes[:-1] &= ~member[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] |= member[edges]
    finishes[edges - 1] |= member[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts, starts, ends, data
    # Places within words, and only the bytes of words from here on.
    lengths = ends - starts
    values = BYTE_VALUES[data[member]]
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(values), dtype=np.int64) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), WORD_BASE)
    powers[0] = 1
    values *= np.multiply.accumulate(powers)[at]
    return mix64(np.add.reduceat(values, first)), counts, starts, ends, data


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the words per row."""
    return words(column, ~IS_SPACE)[:2]
