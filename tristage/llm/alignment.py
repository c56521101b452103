"""Alignment of the token sequences of two tokenizers by diagonal run skipping.

Both tokenizers cut the same bytes: a space and the text. Their tokens' end offsets are two rising
sequences, and where both have an end a group closes. While the ends agree at the current index shift,
exponential probing compares stretches of both arrays at that shift, doubling as long as they are equal
and halving at the first difference, so one-to-one stretches are jumped over. A group that is not one to
one is resolved by advancing whichever side is behind; the shift is then the difference of the indices.

The first tokenizer (A) is a byte-level BPE file, the second (B) a sentencepiece model with byte
fallback. Tokens of a text are those of its pieces between spaces, as neither tokenizer has a token that
goes on over a space behind something else; pieces are kept in a bounded cache per worker. Texts where a
piece ends with other white space, or has no byte-exact tokens, are encoded whole instead.

Special tokens' strings are plain text. A text that is null or empty, or whose joined tokens differ from
a space and the text in either tokenizer, has no tokens: zeros, and '' as its digest. Repeated rows are
documents of their own, null ids are kept, and an empty table gives an empty one. Only the named id and
text columns are read, so other columns meet none of the names here.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tristage.llm.bpe import PRE_TOKEN, byte_letters
from tristage.llm.columns import slices
from tristage.session import scratch_path

CACHE_WORDS = 250_000  # of each of the two generations
PAIR_BITS = 16  # of a B id within a pair
HELD_PAIRS = 1 << 21  # pairs whose counts every worker holds; rarer ones beyond that are joined
MERGE_AT = 1 << 21  # pairs a task gathers before it adds them up


class Vocabularies:
    """Two tokenizers, their tokens' bytes, and the ids of pieces seen."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        a_bytes = {i: bytes(map(to_byte.__getitem__, t)) for t, i in spec["vocab"].items() if all(c in to_byte for c in t)}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.encode_a = self._by_rank(spec, a_bytes) or self._by_library(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size()))):
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << PAIR_BITS:
            raise ValueError(f"ids of more than {PAIR_BITS} bits")
        # An id as it is written inside and at the end of a side, A's first, then B's.
        inside = [b"%d," % i for i in range(len(self.a_bytes))], [b"%d," % i for i in range(len(self.b_bytes))]
        ending = [b"%d|" % i for i in range(len(self.a_bytes))], [b"%d;" % i for i in range(len(self.b_bytes))]
        self.written = [*inside[0], *ending[0], *inside[1], *ending[1]]
        self.recent: dict[str, tuple[bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes] | None] = {}
        # Merges that make pieces of a space inside would forbid the cut at spaces.
        self.by_words = not any(re.search(b"[^ ] ", x) for x in self.b_bytes)

    @staticmethod
    def _by_rank(spec: dict, a_bytes: dict):
        """The faster library, where merges stand in the order of their ids behind the bytes."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        if any(spec["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {t: i for i, t in a_bytes.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("a", pat_str=PRE_TOKEN.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _by_library(path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        library.no_padding()
        library.no_truncation()
        return lambda text: library.encode(text, add_special_tokens=False).ids

    def _exact(self, text: str, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        """Both sides' ids if their bytes are a space and the text, else nothing."""
        data = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return struct.pack(f"<{len(a)}H", *a), struct.pack(f"<{len(b)}H", *b)

    def _learn(self, words: list[str]) -> None:
        """Ids of pieces; nothing for those that don't stand by themselves."""
        found = [w for w in words if w and not w[-1].isspace()]
        self.recent.update(dict.fromkeys(words))
        for w, b in zip(found, self.b.encode(found, num_threads=1)):
            self.recent[w] = self._exact(w, self.encode_a(" " + w), b)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(A's ids, B's ids) of texts; both empty where there are no tokens."""
        if not self.by_words:
            return [self._whole(t) for t in texts]
        if len(self.recent) > CACHE_WORDS:  # what is still in use comes over from the last generation
            self.before, self.recent = self.recent, {}
        parts = [t.split(" ") for t in texts]
        new = {w for words in parts for w in words if w not in self.recent}
        kept = {w: self.before[w] for w in new if w in self.before}
        self.recent.update(kept)
        self._learn([w for w in new if w not in kept])
        out = []
        for text, words in zip(texts, parts):
            try:
                a, b = zip(*map(self.recent.__getitem__, words))
                out.append((b"".join(a), b"".join(b)))
            except TypeError:
                out.append(self._whole(text))
        return out

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        if not text:
            return b"", b""
        return self._exact(text, self.encode_a(" " + text), self.b.encode(text)) or (b"", b"")


@functools.lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One pair per worker; tasks that reuse the worker reuse its cache."""
    return Vocabularies(a_path, b_path)


NEAR = 8  # tokens of a stretch compared one by one


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token of A and of B is the last one of its group.

    Both arrays rise and have the same last value. The first ``NEAR`` tokens of a stretch are compared one by
    one, as most stretches are short; probing goes on from there.
    """
    last_a, last_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    width, n_a, n_b = ends_a.itemsize, len(a), len(b)
    a.append(-1)  # behind the ends nothing is equal
    b.append(-2)
    first_a, first_b, sizes, close_a, close_b = [], [], [], [], []
    i = j = 0
    while i < n_a:
        x, y = a[i], b[j]
        if x == y:
            p, q, near = i + 1, j + 1, i + NEAR
            while a[p] == b[q]:
                p += 1
                q += 1
                if p == near:
                    k = step = NEAR
                    most = min(n_a - i, n_b - j)
                    while k < most:
                        step = min(step, most - k)
                        p, q = (i + k) * width, (j + k) * width
                        if raw_a[p : p + step * width] != raw_b[q : q + step * width]:
                            break
                        k += step
                        step *= 2
                    else:
                        step = 1
                    while step > 1:
                        step //= 2
                        p, q = (i + k) * width, (j + k) * width
                        if raw_a[p : p + step * width] == raw_b[q : q + step * width]:
                            k += step
                    p, q = i + k, j + k
                    break
            first_a.append(i)
            first_b.append(j)
            sizes.append(p - i)
            i, j = p, q
            continue
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        close_a.append(i)
        close_b.append(j)
        i += 1
        j += 1
    last_a[close_a] = True
    last_b[close_b] = True
    if sizes:
        size = np.array(sizes)
        along = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        last_a[np.repeat(first_a, size) + along] = True
        last_b[np.repeat(first_b, size) + along] = True
    return last_a, last_b


class Aligned:
    """Alignment of several documents at once: their ends count on, and documents part groups."""

    def __init__(self, sides: list[tuple[bytes, bytes]], own: Vocabularies):
        self.a = np.frombuffer(b"".join(s[0] for s in sides), "<u2").astype(np.int64)
        self.b = np.frombuffer(b"".join(s[1] for s in sides), "<u2").astype(np.int64)
        self.n_a = np.array([len(s[0]) // 2 for s in sides], np.int64)
        self.n_b = np.array([len(s[1]) // 2 for s in sides], np.int64)
        self.ends_a, self.ends_b = np.cumsum(own.a_lengths[self.a]), np.cumsum(own.b_lengths[self.b])

    def groups(self) -> None:
        self.last_a, self.last_b = align(self.ends_a, self.ends_b)

    def counts(self) -> np.ndarray:
        """Groups of every document."""
        closed = np.concatenate(([0], np.cumsum(self.last_a)))
        to = np.cumsum(self.n_a)
        return closed[to] - closed[to - self.n_a]

    def written(self, own: Vocabularies) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of every document, '' without tokens."""
        size_a, size_b = len(own.a_bytes), len(own.b_bytes)
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        upto_a = np.flatnonzero(self.last_a) + 1  # tokens of A up to each group's end
        from_b = np.concatenate(([0], np.flatnonzero(self.last_b) + 1))
        mixed = np.empty(len(self.a) + len(self.b), np.int64)
        mixed[np.arange(len(self.a)) + from_b[group_a]] = self.a + size_a * self.last_a
        mixed[np.arange(len(self.b)) + upto_a[group_b]] = 2 * size_a + self.b + size_b * self.last_b
        to = np.cumsum(self.n_a + self.n_b)
        return [b"".join(map(own.written.__getitem__, mixed[s:e].tolist()))[:-1] for s, e in zip(np.append(0, to[:-1]), to)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair codes, their documents' last link): one link per stretch between neighbouring ends of either side."""
        last = np.sort(np.concatenate((self.ends_a, self.ends_b)), kind="stable")
        last = last[np.append(last[1:] != last[:-1], True)] if len(last) else last
        pairs = self.a[np.searchsorted(self.ends_a, last)] << PAIR_BITS | self.b[np.searchsorted(self.ends_b, last)]
        bounds = np.append(0, self.ends_a)[np.cumsum(self.n_a)]
        return pairs, np.searchsorted(last, bounds, side="right")


def aligned_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> DataFrame:
    """(doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, a_ids, b_ids[, groups]) per document.

    The ids are little-endian unsigned 16-bit numbers; ``row`` tells rows apart once the result is
    written as a table. ``with_groups`` adds the groups as text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids binary, b_ids binary"
    shape += ", groups string" if with_groups else ""
    names = [part.split(" ")[0] for part in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = vocabularies(a_path, b_path), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, text_col):
                sides = own.encode([t or "" for t in batch.column(text_col).to_pylist()])
                found = Aligned(sides, own)
                found.groups()
                n_groups, texts = found.counts(), found.written(own)
                columns = [
                    batch.column(id_col), pa.array(np.arange(row, row + len(sides))), pa.array(found.n_a), pa.array(found.n_b),
                    pa.array(n_groups), pa.array(found.n_a + found.n_b - n_groups),
                    pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts]),
                    pa.array([s[0] for s in sides], pa.binary()), pa.array([s[1] for s in sides], pa.binary()),
                ]
                if with_groups:
                    columns.append(pa.array(texts, pa.string()))
                row += len(sides)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, shape)


def _linked(batches: Iterator[pa.RecordBatch], own: Vocabularies) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, pairs of their links, each row's end among these)."""
    for whole in batches:
        for batch in slices(whole, "a_ids"):
            found = Aligned(list(zip(batch.column("a_ids").to_pylist(), batch.column("b_ids").to_pylist())), own)
            yield batch, *found.links()


def _owners(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, docs): how many documents hold an A id and a B id linked; added up in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def added_up() -> tuple[np.ndarray, np.ndarray]:
            pairs, place = np.unique(np.concatenate([p for p, _ in kept]), return_inverse=True)
            return pairs, np.bincount(place, np.concatenate([n for _, n in kept])).astype(np.int64)

        def rows(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], ["pair", "docs"])

        for _, pairs, ends in _linked(batches, vocabularies(a_path, b_path)):
            held = np.unique(_owners(ends) << 2 * PAIR_BITS | pairs) & (1 << 2 * PAIR_BITS) - 1
            found, n = np.unique(held, return_counts=True)
            kept.append((found, n))
            size += len(found)
            if size > 2 * MERGE_AT:
                kept = [added_up()]
                size = len(kept[0][0])
                if size > MERGE_AT:
                    yield from rows(*kept[0])
                    kept, size = [], 0
        if kept:
            yield from rows(*added_up())

    narrow = aligned.select("a_ids", "b_ids").mapInArrow(run, "pair long, docs long")
    return narrow.groupBy("pair").agg(F.sum("docs").alias("docs"))


def _table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a well compressed table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_pair_counts(aligned: DataFrame, a_path: str, b_path: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """A written table of ``aligned_documents`` with n_best and count_sum added.

    Counts of up to ``held_pairs`` pairs go to every worker, those in the most documents. Links of other
    pairs, each in few documents, are joined with their counts and added up per row.
    """
    spark = aligned.sparkSession
    counts = _table(pair_counts(aligned, a_path, b_path), "pairs")
    counts = counts.withColumn("a", F.shiftright("pair", PAIR_BITS))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    counts = _table(counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "ranked")
    # The number of pairs by the binary digits of their counts: the rarest are left out by whole classes.
    digits = F.length(F.bin("docs"))
    classes = {r["d"]: r["n"] for r in counts.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for d in sorted(classes, reverse=True):
        if total + classes[d] > held_pairs:
            break
        least, total = d, total + classes[d]
    rare = counts.where(digits < least)
    held = counts.where(digits >= least).toArrow()
    pairs = held.column("pair").to_numpy()
    by = np.argsort(pairs)
    known = spark.sparkContext.broadcast(
        (pairs[by], held.column("docs").to_numpy()[by], held.column("best").to_numpy(zero_copy_only=False)[by])
    )
    rest = [c for c in aligned.columns if c not in ("a_ids", "b_ids")]
    shape = aligned.select(*rest, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).schema

    def held_place(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known.value[0]):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        place = np.minimum(np.searchsorted(known.value[0], pairs), len(known.value[0]) - 1)
        return place, known.value[0][place] == pairs

    def sums(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.array(np.diff(np.append(0, np.cumsum(values))[ends], prepend=0).astype(np.int64))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pairs, ends in _linked(batches, vocabularies(a_path, b_path)):
            if len(known.value[0]):
                place, hit = held_place(pairs)
                best, docs = known.value[2][place] & hit, known.value[1][place] * hit
            else:
                best = docs = np.zeros(len(pairs), np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], sums(best, ends), sums(docs, ends)], shape.names)

    out = aligned.mapInArrow(add, shape)
    if total == sum(classes.values()):
        return out

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pairs, ends in _linked(batches, vocabularies(a_path, b_path)):
            other = ~held_place(pairs)[1]
            held, times = np.unique(_owners(ends)[other] << 2 * PAIR_BITS | pairs[other], return_counts=True)
            rows = batch.column("row").to_numpy()[held >> 2 * PAIR_BITS]
            columns = [rows, held & (1 << 2 * PAIR_BITS) - 1, times]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "pair", "times"])

    found = aligned.select("row", "a_ids", "b_ids").mapInArrow(others, "row long, pair long, times long").join(rare, "pair")
    more = found.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("best"), F.col("times"))).alias("_best"), F.sum(F.col("docs") * F.col("times")).alias("_sum")
    )
    joined = out.join(more, F.col("row") == F.col("_row"), "left")
    return joined.select(
        *rest, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum")
    )


def align_corpus(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", held_pairs: int = HELD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of all documents."""
    aligned = _table(aligned_documents(docs, a_path, b_path, id_col, text_col), "aligned")
    return with_pair_counts(aligned, a_path, b_path, held_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
