"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period q, at least twice q long, that no neighbouring word
extends. The suffixes of a text are sorted, and neighbours in that order are edges weighted by their
longest common prefix. Edges are taken by decreasing weight; union-find joins the classes of suffixes,
and every class keeps its positions as an ordered set. Where a union makes two positions i < j neighbours
in the joined set, j - i is the smallest period of the words from i to the end of what both have in
common, provided it is at most that common length: a shorter period would have put a position between
them earlier. So each run is met exactly once, as the pair of its start and its start plus its period.

The smaller set always goes into the larger one. Runs of less than ``min_length`` words need no edge
below half of that, so the search stops there. Texts are taken whole and one at a time; several share
the sorting of a slice. Words are byte strings between ``[\\x20\\x09-\\x0D]``, compared as they are.

A null text or one without words has no run and empty collapsed text. Repeated rows each get their own
result, an empty table gives an empty one, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tristage.llm.columns import slices

MIN_LENGTH = 12
BLOCK = 512
RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])


class Positions:
    """An ordered set of positions in short blocks."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int):
        self.blocks, self.firsts, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The members before and after ``x``, which is none itself."""
        at = bisect_right(self.firsts, x) - 1
        if at < 0:
            return None, self.firsts[0]
        block = self.blocks[at]
        k = bisect_right(block, x)
        if k < len(block):
            return block[k - 1], block[k]
        return block[-1], self.firsts[at + 1] if at + 1 < len(self.firsts) else None

    def add(self, x: int) -> None:
        at = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[at]
        insort(block, x)
        self.firsts[at] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts.insert(at + 1, block[BLOCK])


def suffix_order(codes: np.ndarray, text: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it, 0 across texts).

    ``codes`` holds the words of all texts as positive numbers, each text followed by a 0; ``text`` is
    the number of the text at every place. Ranks of ``base`` words are made for all places, and doubled
    only where two places of a text still have the same.
    """
    n = len(codes)
    top = int(codes.max()) + 1
    rank = np.unique((text * top + codes) * top + np.append(codes[1:], 0), return_inverse=True)[1]
    h = 2
    while h < base:
        further = np.zeros(n, np.int64)
        further[: max(n - h, 0)] = rank[h:]
        rank = np.unique(rank * n + further, return_inverse=True)[1]
        h *= 2
    sizes = np.bincount(rank)
    tied = np.flatnonzero(sizes[rank] > 1)
    rank = (np.cumsum(sizes) - sizes)[rank]
    while len(tied):
        # No place here has its text's end within its first h words, so tied + h stays inside.
        further = rank[tied + h]
        by = np.lexsort((further, rank[tied]))
        tied, further, old = tied[by], further[by], rank[tied][by]
        parted = np.append(True, old[1:] != old[:-1])
        begins = parted | np.append(True, further[1:] != further[:-1])
        place = np.arange(len(tied))
        rank[tied] = old + np.maximum.accumulate(np.where(begins, place, 0)) - np.maximum.accumulate(np.where(parted, place, 0))
        alone = begins & np.append(begins[1:], True)
        tied = tied[~alone]
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)

    common = np.zeros(n, np.int64)
    padded = np.concatenate((codes, np.zeros(base, codes.dtype)))
    going = np.flatnonzero(text[order[1:]] == text[order[:-1]]) + 1
    for t in range(base):
        going = going[padded[order[going] + t] == padded[order[going - 1] + t]]
        common[going] += 1
    _extend(codes, order, common, going, base)
    return order, common


def _extend(codes: np.ndarray, order: np.ndarray, common: np.ndarray, going: np.ndarray, base: int) -> None:
    """Common prefixes beyond ``base``, in text order: the next place shares one word less at least."""
    by_place = going[np.argsort(order[going])]
    words, last, h = codes.tolist(), -2, 0
    found = []
    for i, j in zip(order[by_place].tolist(), order[by_place - 1].tolist()):
        h = max(h - 1, base) if i == last + 1 else base
        while words[i + h] == words[j + h]:
            h += 1
        found.append(h)
        last = i
    common[by_place] = found


def periodic_pairs(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, period, common length) of places that become neighbours within their common length."""
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    out: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y, length in zip(order[edges - 1].tolist(), order[edges].tolist(), common[edges].tolist()):
        a, b = root(x), root(y)
        if a not in sets:
            sets[a] = Positions(a)
        if b not in sets:
            sets[b] = Positions(b)
        if sets[a].size < sets[b].size:
            a, b = b, a
        parent[b] = a
        large, small = sets[a], sets.pop(b)
        moved = list(small)
        for k, place in enumerate(moved):
            before, after = large.around(place)
            # A pair is adjacent in the joined set unless the next moved place comes in between.
            if before is not None and place - before <= length and (k == 0 or moved[k - 1] < before):
                out.append((before, place - before, length))
            if after is not None and after - place <= length and (k + 1 == len(moved) or moved[k + 1] > after):
                out.append((place, after - place, length))
        for place in moved:
            large.add(place)
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Rows (start, length, period) of every text's runs, by start and then period."""
    known: dict[bytes, int] = {}
    codes = []
    for words in texts:
        codes += [known.setdefault(w, len(known) + 1) for w in words]
        codes.append(0)
    sizes = np.array([len(words) + 1 for words in texts], np.int64)
    codes, text = np.array(codes, np.int64), np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    least = max(1, -(-min_length // 2))
    base = 1 << max(1, (least - 1).bit_length())
    start, period, common = periodic_pairs(*suffix_order(codes, text, base), least).T
    # The place before a text's first word is a 0, which equals no word.
    whole = (codes[start - 1] != codes[start - 1 + period]) & (common + period >= min_length)
    start, period, length = start[whole], period[whole], (common + period)[whole]
    by = np.lexsort((period, start))
    start, period, length = start[by], period[by], length[by]
    own = text[start]
    cuts = np.searchsorted(own, np.arange(1, len(texts)))
    return np.split(np.stack((start - first[own], length, period), axis=1), cuts)


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats: of every run its first period stays."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(
    df: DataFrame,
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """``df`` with ``runs`` (array of start, length, period) and ``collapsed`` text added.

    ``rewrite`` may change a row's words first; it gets the row's id and its words.
    """
    added = ("runs", "collapsed")
    own = [f for f in df.schema.fields if f.name not in added]
    shape = StructType([*own, StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = [(t or "").encode().split() for t in batch.column(text_col).to_pylist()]
                if rewrite is not None:
                    texts = [rewrite(i, words) for i, words in zip(batch.column(id_col).to_pylist(), texts)]
                found = find_runs(texts, min_length)
                flat = np.concatenate(found)
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], RUN.names)
                runs = pa.ListArray.from_arrays(offsets, values).cast(kind)
                short = [collapse(words, r).decode() for words, r in zip(texts, found)]
                columns = [batch.column(f.name) for f in own]
                yield pa.RecordBatch.from_arrays([*columns, runs, pa.array(short, pa.string())], shape.names)

    return df.select(*[f.name for f in own]).mapInArrow(run, shape)


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in RUN.names]), F.lit("\n")))
    # The longest run; of equals the first to start, then the one of the smaller period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    marked = df.select("doc_id", "collapsed", F.size("runs").cast("bigint").alias("n_runs"), F.concat_ws("", lines).alias("lines"), best.alias("best"))
    length, period = F.col("best.l"), -F.col("best.p")
    return marked.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
