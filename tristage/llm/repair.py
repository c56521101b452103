"""Token ids in files, compressed by a Re-Pair grammar per block.

Documents are dealt by ranges of their id and sorted, so the files hold them in ascending order. A
task cuts its documents into blocks of about ``BLOCK_IDS`` ids. In each block frequent pairs of
adjacent ids or symbols are replaced by new symbols, again and again, until no pair is frequent: the
rules form a grammar. A block is one row of a Parquet table, so writing and reading work on any store
that Spark knows and survive lost tasks:

| column | content |
|---|---|
| shard, block | the range and the place in it |
| first | ids before the block in its shard |
| doc_ids, lengths | the documents of the block in order, with their numbers of ids |
| terminals | the size of the id space; symbol ``terminals + r`` stands for rule r |
| rules | two symbols per rule (unsigned 32 bits, zstandard) |
| expansions | the number of ids each rule stands for (unsigned 32 bits, zstandard) |
| symbols | the compressed sequence (unsigned 32 bits in byte planes, zstandard) |

One document is read by its place alone: the running sum of the symbols' expansion lengths gives the
symbols that cover it, and only those are expanded.

Order among rows that repeat an id: by the hash of the text, then as they come. Null ids come first;
null text counts as empty. A document is never split, so a block is at least one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tristage.llm.columns import text_or_empty
from tristage.llm.tokens import word_tokenizer

BLOCK_IDS = 1 << 20
LEAST_PAIR = 24  # a pair is replaced if it occurs so often in a block
LEAST_USES = 3  # a rule is two symbols, and saves one per use
BLOCKS = "shard int, block int, first long, doc_ids array<long>, lengths array<long>, terminals long, rules binary, expansions binary, symbols binary"


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


SLOTS = 18  # bits of a pair's slot


def _slots(codes: np.ndarray) -> np.ndarray:
    """A number of ``SLOTS`` bits per pair code."""
    bits = 8 * codes.itemsize
    factor = codes.dtype.type(0x9E3779B97F4A7C15 & ((1 << bits) - 1))
    return (codes * factor) >> codes.dtype.type(bits - SLOTS)


def _places(frequent: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a code is among the sorted ``frequent`` ones, its place there)."""
    by_slot = np.full(1 << SLOTS, -1, np.int32)
    by_slot[_slots(frequent)] = np.arange(len(frequent), dtype=np.int32)
    place = by_slot[_slots(codes)]
    hit = frequent[place] == codes
    # Slots of several frequent pairs name one of them; the others are searched.
    rest = np.flatnonzero(~hit & (place >= 0))
    found = np.minimum(np.searchsorted(frequent, codes[rest]), len(frequent) - 1)
    place[rest], hit[rest] = found, frequent[found] == codes[rest]
    return hit, place


def _chosen(at: np.ndarray) -> np.ndarray:
    """Which of the pairs at rising places are taken: from left to right, of overlapping ones every second."""
    begins = np.append(True, np.diff(at) > 1)[: len(at)]
    run = np.maximum.accumulate(np.where(begins, np.arange(len(at), dtype=np.int32), 0))
    return (np.arange(len(at), dtype=np.int32) - run) % 2 == 0


def compress(ids: np.ndarray, terminals: int, least: int = LEAST_PAIR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, symbols) of a sequence of ids below ``terminals``.

    A round looks at all pairs that occur at least ``least`` times and takes their occurrences from left
    to right; of overlapping ones every second. (To take the more frequent of overlapping pairs first
    left 3 % more symbols.) Pairs taken ``LEAST_USES`` times, which is when a rule pays, become rules.
    Pairs of older symbols never grow, so the next round counts only pairs with a symbol just made, and
    frequent ones that are left. The rounds end when none becomes a rule. Within, symbols are ranks among
    those present, and a pair is one number of 32 bits while they are few.
    """
    present = np.flatnonzero(np.bincount(ids, minlength=1))
    ranks = np.zeros(int(present[-1]) + 1 if len(present) else 0, np.uint32)
    ranks[present] = np.arange(len(present), dtype=np.uint32)
    symbols, top = ranks[ids], len(present)
    rules, made, at = [np.zeros((0, 2), np.uint32)], 0, np.arange(len(ids) - 1, dtype=np.int32)
    while len(at):
        wide = np.uint32 if top + made <= 1 << 16 else np.uint64
        shift = wide(16 if wide is np.uint32 else 32)
        left, right = (symbols[:-1], symbols[1:]) if len(at) == len(symbols) - 1 else (symbols[at], symbols[at + 1])
        codes = (left.astype(wide) << shift) | right
        ordered = np.sort(codes)
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        frequent = ordered[edges[:-1][np.diff(edges) >= least]]
        if not len(frequent):
            break
        hit, place = _places(frequent, codes)
        at, place = at[hit], place[hit]
        taken = _chosen(at)
        rule = np.bincount(place[taken], minlength=len(frequent)) >= LEAST_USES
        if not rule.any():
            break
        taken &= rule[place]
        number = np.cumsum(rule, dtype=np.uint32) - 1
        own = at[taken]
        replaced = np.zeros(len(symbols), bool)
        replaced[own] = replaced[own + 1] = True
        waiting = at[~(replaced[at] | replaced[at + 1])]
        symbols[own] = top + made + number[place[taken]]
        keep = np.ones(len(symbols), bool)
        keep[own + 1] = False
        symbols = symbols[keep]
        fresh = own - np.arange(len(own))  # each place before it lost one symbol
        looked = np.zeros(len(symbols) + 1, bool)
        looked[fresh] = looked[fresh - 1] = True
        looked[waiting - np.searchsorted(own, waiting)] = True
        at = np.flatnonzero(looked[: len(symbols) - 1])
        pairs = frequent[rule]
        rules.append(np.stack([pairs >> shift, pairs & wide((1 << int(shift)) - 1)], 1).astype(np.uint32))
        made += int(rule.sum())

    names = np.concatenate((present, terminals + np.arange(made))).astype(np.uint32)
    pairs = names[np.concatenate(rules)]
    sizes = np.ones(terminals + made, np.int64)
    begin = 0
    for own in rules[1:]:
        pair = pairs[begin : begin + len(own)]
        sizes[terminals + begin : terminals + begin + len(own)] = sizes[pair[:, 0]] + sizes[pair[:, 1]]
        begin += len(own)
    return pairs.ravel(), sizes[terminals:].astype(np.uint32), names[symbols]


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that a run of symbols stands for."""
    pairs = rules.reshape(-1, 2)
    symbols = symbols.astype(np.uint32)
    while len(symbols):
        deep = symbols >= terminals
        if not deep.any():
            break
        at = np.arange(len(symbols)) + np.concatenate(([0], np.cumsum(deep[:-1])))
        out = np.empty(len(symbols) + int(deep.sum()), np.uint32)
        own = pairs[symbols[deep] - terminals]
        out[at[~deep]] = symbols[~deep]
        out[at[deep]] = own[:, 0]
        out[at[deep] + 1] = own[:, 1]
        symbols = out
    return symbols


def expand_block(row: dict) -> np.ndarray:
    """All ids of a block: every rule is expanded once, and its uses copy that."""
    terminals, symbols, sizes = row["terminals"], _unpack(row["symbols"]), _unpack(row["expansions"]).astype(np.int64)
    whole = expand(terminals + np.arange(len(sizes)), _unpack(row["rules"]), terminals)
    deep = symbols >= terminals
    widths = np.ones(len(symbols), np.int64)
    widths[deep] = sizes[symbols[deep] - terminals]
    ends = np.cumsum(widths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    out[(ends - widths)[~deep]] = symbols[~deep]
    used, widths, starts = symbols[deep] - terminals, widths[deep], (ends - widths)[deep]
    along = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
    out[np.repeat(starts, widths) + along] = whole[np.repeat((np.cumsum(sizes) - sizes)[used], widths) + along]
    return out


def read_ids(row: dict, start: int, length: int) -> np.ndarray:
    """``length`` ids from place ``start`` of a block, expanding only the symbols that cover them."""
    terminals, symbols = row["terminals"], _unpack(row["symbols"])
    rules, sizes = _unpack(row["rules"]), _unpack(row["expansions"])
    deep = symbols >= terminals
    widths = np.ones(len(symbols), np.int64)
    widths[deep] = sizes[symbols[deep] - terminals]
    ends = np.cumsum(widths)
    a = int(np.searchsorted(ends, start, "right"))
    b = int(np.searchsorted(ends, start + length, "left")) + 1
    before = int(ends[a] - widths[a]) if a < len(ends) else start
    return expand(symbols[a:b], rules, terminals)[start - before : start - before + length]


def write_blocks(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, terminals: int = 1 << 16,
    id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, shards: int | None = None,
) -> None:
    """Encode all documents, append ``end_id`` to each, and write the blocks as a table at ``path``."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    # The ranges are cut by a sample of ids; the tie keeps many rows of one id from one shard.
    dealt = rows.repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie")
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        state = {"block": 0, "first": 0}
        ids, parts, lengths, held, shard = [], [], [], 0, 0

        def block():
            flat = np.frombuffer(b"".join(parts), "<u4")
            space = max(terminals, int(flat.max()) + 1)
            rules, sizes, symbols = compress(flat, space)
            row = {
                "shard": shard, **state, "doc_ids": ids, "lengths": lengths, "terminals": space,
                "rules": _pack(rules), "expansions": _pack(sizes), "symbols": _pack(symbols),
            }
            state["block"] += 1
            state["first"] += len(flat)
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "text", "shard")]
            for key, value, shard in zip(*columns):
                parts.append(own.encode(value) + end)
                ids.append(key)
                lengths.append(len(parts[-1]) // 4)
                held += lengths[-1]
                if held >= block_ids:
                    yield block()
                    ids, parts, lengths, held = [], [], [], 0
        if ids:
            yield block()

    dealt.mapInArrow(run, BLOCKS).write.mode("overwrite").parquet(path)


SCHEMA = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("terminals", pa.int64()), ("rules", pa.binary()),
        ("expansions", pa.binary()), ("symbols", pa.binary()),
    ]
)


def read_blocks(spark, path: str) -> DataFrame:
    """The blocks, each with ``start``: the number of ids before it in all shards.

    The totals are one row per shard, and that is all that is summed in one place and broadcast.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("shard").agg(F.sum(ids).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    joined = blocks.join(F.broadcast(shards), F.col("shard") == F.col("_shard"))
    return joined.withColumn("start", F.col("_before") + F.col("first")).drop("_shard", "_before")


def decode_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, from the blocks of ``read_blocks``."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = expand_block(row)
            ends = np.concatenate(([0], np.cumsum(row["lengths"])))
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends[:-1]), lists], schema=out)

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def digest_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks of ``read_blocks``."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data = memoryview(expand_block(row).astype("<u4").tobytes())
            ends = np.concatenate(([0], np.cumsum(row["lengths"])))
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            columns = [row["doc_ids"], row["start"] + ends[:-1], row["lengths"], crcs]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}
