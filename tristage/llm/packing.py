"""Best-two-fit packing of token sequences.

Documents become token ids with an end id. Those longer than a sequence are cut into pieces of its
length. The pieces are packed: a bin is filled greedily,
longest fitting piece first; then its smallest piece is taken out again if two unpacked pieces fit
the gap that this leaves more tightly. The pair that fills the gap best is taken.

Packing needs lengths only. Pieces are dealt by hash into groups of about ``GROUP`` and every group is
packed by its own task; a group leaves at most about one sequence that could be fuller, one in
thousands, so the number of groups may grow with the data. A group works on counts per length, so its
time depends on the number of its sequences and not on ties or repeated rows. Null text counts as
empty and still has its end id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tristage.llm.columns import free_name, slices
from tristage.llm.tokens import word_tokenizer
from tristage.session import cut

SEQUENCE = 2048
GROUP = 20_000


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, sequence: int = SEQUENCE, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = True, cache_words: int | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents.

    ``cache_words``: how many words a worker keeps the ids of; it trades memory for time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_tokenizer(tokenizer, cache_words), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                rows, ids = [], []
                for row, text in enumerate(batch.column(text_col).to_pylist()):
                    data = memoryview(own.encode(text or "") + end)
                    for piece, a in enumerate(range(0, len(data), 4 * sequence)):
                        part = data[a : a + 4 * sequence]
                        rows.append((row, piece, a // 4, len(part) // 4, zlib.crc32(part)))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                row, piece, *rest = zip(*rows)
                columns = [batch.column(id_col).take(pa.array(row)), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in rest]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(rest[1]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.concatenate(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, shape)


class _Stock:
    """Unpacked pieces: counts per length, and for every length the longest one in stock up to it."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.upto = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            shorter = self.upto[length - 1]
            end = length + int(np.argmax(self.upto[length:] != length)) if self.upto[-1] != length else len(self.upto)
            self.upto[length:end] = shorter

    def put(self, length: int) -> None:
        self.counts[length] += 1
        if self.counts[length] == 1:
            part = self.upto[length:]
            part[part < length] = length

    def pair(self, gap: int) -> tuple[int, int]:
        """Two lengths in stock with the largest sum up to ``gap``; (0, 0) if there are none."""
        most = min(gap, len(self.counts) - 1)
        longer = np.flatnonzero(self.counts[: most + 1])
        longer = longer[(longer > 0) & (longer < gap)]
        if not len(longer):
            return 0, 0
        other = np.minimum(gap - longer, longer)
        other = self.upto[other]
        # A single piece of a length is no pair with itself.
        same = (other == longer) & (self.counts[longer] < 2)
        other = np.where(same, self.upto[longer - 1], other)
        other = np.where(longer + other <= gap, other, 0)
        sums = np.where(other > 0, longer + other, 0)
        best = int(np.argmax(sums))
        return (int(longer[best]), int(other[best])) if sums[best] else (0, 0)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin number, offset) of every piece; lengths are from 1 to ``capacity``."""
    stock = _Stock(np.bincount(lengths, minlength=capacity + 1))
    bins: list[list[int]] = []
    left = len(lengths)
    while left:
        gap, own = capacity, []
        while gap and (fit := int(stock.upto[gap])):
            stock.take(fit)
            own.append(fit)
            gap -= fit
        if gap and len(own):
            smallest = own[-1]
            a, b = stock.pair(gap + smallest)
            if a + b > smallest:
                own.pop()
                stock.take(a)
                stock.take(b)
                stock.put(smallest)
                own += [a, b]
        bins.append(own)
        left -= len(own)
    flat = np.array([x for own in bins for x in own], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(own) for own in bins])
    ends = np.cumsum(flat)
    first = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1)) if len(flat) else np.zeros(0, np.int64)
    offset = ends - flat - np.repeat((ends - flat)[first], [len(own) for own in bins]) if len(flat) else flat
    # The pieces of a length, in their order, take that length's places in theirs.
    place, piece = np.argsort(flat, kind="stable"), np.argsort(lengths, kind="stable")
    out_bin, out_offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    out_bin[piece], out_offset[piece] = number[place], offset[place]
    return out_bin, out_offset


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset; their other columns stay. Lengths are from 1 to ``capacity``.

    The pieces are numbered and written as a table once. The number of groups follows from their count, only
    numbers and lengths travel into a group, and its places are joined back, so a task's memory depends neither
    on what else a piece carries nor on how many pieces a document has.
    """
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    number = free_name("_piece", kept)
    table = cut(pieces.select(*kept, F.monotonically_increasing_id().alias(number)))
    groups = max(1, -(-table.count() // group))
    bits = 40  # sequences of a group

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")  # a task that runs again gives the same places
        own, offset = best_two_fit(rows.column("length").to_numpy().astype(np.int64), capacity)
        ids = (key[0].as_py() << bits) + own
        return pa.table([rows.column("number"), pa.array(ids), pa.array(offset)], names=[number, "sequence_id", "offset"])

    lengths = table.select(F.col(number).alias("number"), F.col(length_col).alias("length"))
    dealt = lengths.withColumn("_group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("long"))
    places = dealt.groupBy("_group").applyInArrow(run, f"`{number}` long, sequence_id long, offset long")
    return table.join(places, number).select(*kept, "sequence_id", "offset")
