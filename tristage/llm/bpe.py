"""Byte-level BPE encoding and decoding.

A pre-token starts as one symbol per byte. The symbols form a doubly linked list; a priority queue
holds the merge rank of every adjacent pair. The pair with the least rank (ties: the leftmost) is
merged and its new neighbours are queued; entries whose symbols have changed meanwhile are stale and
are skipped. Decoding concatenates the bytes of the vocabulary's strings.

Encodings of chunks and pre-tokens are kept in bounded caches per Python worker. Null text counts as empty,
and texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tristage.llm.columns import slices

# The pattern of the byte-level pre-tokenizer, as the vocabularies' README gives it (fixed value).
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# A pre-token never goes on over a white space that follows something else, so a text may be cut
# there. Other white space than ASCII's takes the whole-text way.
CHUNK = re.compile(r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+")
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHE_ENTRIES = 150_000  # of a generation
LONGEST_CACHED = 64  # characters


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        letters = byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        to_byte = {c: b for b, c in enumerate(letters)}
        self.strings = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        found = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
        # Two generations of each cache: a full one becomes the last one, and what it holds that is
        # still in use comes over.
        self.chunks: dict[str, bytes] = {}
        self.chunks_before: dict[str, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}
        self.pre_tokens_before: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a list of symbol ids."""
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two was merged away
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((merged, symbols[k])):
                    heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbols[h], merged))):
                heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def _pre_token(self, piece: str) -> bytes:
        ids = self.pre_tokens.get(piece)
        if ids is None:
            ids = self.pre_tokens_before.get(piece)
            if ids is None:
                ids = np.array(self.merge([self.byte_ids[b] for b in piece.encode()]), "<i4").tobytes()
            if len(self.pre_tokens) >= CACHE_ENTRIES:
                self.pre_tokens_before, self.pre_tokens = self.pre_tokens, {}
            if len(piece) <= LONGEST_CACHED:
                self.pre_tokens[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if OTHER_SPACE.search(text):
            return b"".join(map(self._pre_token, PRE_TOKEN.findall(text)))
        pieces = CHUNK.findall(text)
        try:
            return b"".join(map(self.chunks.__getitem__, pieces))
        except KeyError:
            pass
        if len(self.chunks) >= CACHE_ENTRIES:
            self.chunks_before, self.chunks = self.chunks, {}
        chunks, before, out = self.chunks, self.chunks_before, []
        for piece in pieces:
            ids = chunks.get(piece)
            if ids is None:
                ids = before.get(piece)
                if ids is None:
                    ids = b"".join(map(self._pre_token, PRE_TOKEN.findall(piece)))
                if len(piece) <= LONGEST_CACHED:
                    chunks[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. Strings of added tokens in it become those tokens, as the library has it."""
        if self.split_added is None or not any(x in text for x in self.added):
            return np.frombuffer(self._plain(text), "<i4")
        parts = self.split_added.split(text)
        own = [self._plain(x) if i % 2 == 0 else np.array([self.added[x]], "<i4").tobytes() for i, x in enumerate(parts)]
        return np.frombuffer(b"".join(own), "<i4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker; tasks that reuse the worker reuse its cache."""
    return Codec(path)


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], values], [*kept, name])


def _with(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*[f for f in df.schema.fields if f.name != name], StructField(name, kind, True)])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of a text column; all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                ids = [own.encode(t or "") for t in batch.column(text_col).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield _put(batch, ids_col, pa.ListArray.from_arrays(offsets, flat.astype(np.int32)))

    return df.mapInArrow(run, _with(df, ids_col, ArrayType(IntegerType())))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; a null list gives empty text, and all other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            column = batch.column(ids_col)
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield _put(batch, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _with(df, text_col, StringType()))


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded documents."""
    return df.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
