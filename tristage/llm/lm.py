"""Language-model scoring by deleted interpolation.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end per text. A token's
probability after its predecessor (the end stands before the first word) mixes three estimates:

    p(w | u) = l2 * c(u, w) / c(u) + l1 * c(w) / N + l0 / (V + 1)

The weights depend on the bucket of c(u), a power of two. They are learnt by expectation-maximisation
on a deleted part of the training texts: its events are weighed under the counts of the rest. Scores
then use the counts of all training texts.

All n-grams of all texts are counted; nothing is pruned. To keep that narrow, a task turns its texts
into batches, each a row of packed arrays, and sends for every n-gram *of a batch*, not of a text, its
64-bit hash and count to the part of the hash space that owns it. The part adds up and sends back the
totals in the same order, and the batch is scored with them. Batches and parts grow in number with the
size of the corpus to the power 3/4, so that both stay within a task's memory. Two n-grams share a hash
with a probability of about 2^-64.

Null and empty texts are one end. Ids may repeat or be null; each row has its own score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tristage.llm.columns import mix64, slices, word_hashes
from tristage.session import cut

END = mix64(np.array([1], np.uint64))[0]
_LEFT, _RIGHT = mix64(np.array([2, 3], np.uint64)) | np.uint64(1)
LEARN, DELETED, OTHER = 0, 1, 2  # kinds of texts: counted, counted and used for the weights, only scored
LEAST_CHARS = 2_000_000
BUCKETS = 40
BINS = 48  # of each probability's logarithm, in the summary of events, for up to some ten million tokens
ROUNDS = 60


def _pack(values: np.ndarray) -> bytes:
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _batches(docs: DataFrame, batch_chars: int) -> DataFrame:
    """(batch, kind, ids, counts, vocabulary, tokens): the texts of a batch as numbers of its words."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in (LEARN, DELETED, OTHER)}
        chars = dict.fromkeys(held, 0)
        number = 0

        def row(kind: int) -> pa.RecordBatch:
            nonlocal number
            ids, hashes, counts = zip(*held[kind])
            words, counts = np.concatenate(hashes), np.concatenate(counts)
            vocabulary, tokens = np.unique(words, return_inverse=True)
            batch = (TaskContext.get().partitionId() << 32) | number
            number += 1
            held[kind], chars[kind] = [], 0
            columns = [
                pa.array([batch]), pa.array([kind], pa.int32()), pa.ListArray.from_arrays([0, len(counts)], pa.concat_arrays(ids)),
                pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([_pack(vocabulary)]), pa.array([_pack(tokens.astype(np.uint32))]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["batch", "kind", "ids", "counts", "vocabulary", "tokens"])

        for whole in incoming:
            for batch in slices(whole, "text"):
                kinds = batch.column("kind").to_numpy()
                words, counts = word_hashes(batch.column("text"))
                # One end after the words of every text.
                tokens = np.insert(words, np.cumsum(counts), END)
                counts = counts + 1
                owner = np.repeat(kinds, counts)
                for kind in held:
                    mine = kinds == kind
                    if mine.any():
                        held[kind].append((batch.column("id").filter(pa.array(mine)), tokens[owner == kind], counts[mine]))
                        chars[kind] += int(counts[mine].sum()) * 6
                        if chars[kind] >= batch_chars:
                            yield row(kind)
        for kind in held:
            if held[kind]:
                yield row(kind)

    return docs.mapInArrow(run, f"batch long, kind int, ids array<{id_type}>, counts array<long>, vocabulary binary, tokens binary")


class _Batch:
    """The n-grams of a batch: for order 1 its vocabulary, for order 2 its distinct pairs, by hash."""

    def __init__(self, row: dict):
        self.counts = np.array(row["counts"])
        self.vocabulary = _unpack(row["vocabulary"], np.uint64)
        self.tokens = _unpack(row["tokens"], np.uint32).astype(np.int64)
        end = int(np.searchsorted(self.vocabulary, END))
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]  # what ends a text stands before the next one
        before[0] = end
        self.before = before
        pairs, place = np.unique(before * len(self.vocabulary) + self.tokens, return_inverse=True)
        hashes = mix64(self.vocabulary[pairs // len(self.vocabulary)] * _LEFT + self.vocabulary[pairs % len(self.vocabulary)] * _RIGHT)
        order = np.argsort(hashes)
        self.pairs = hashes[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pair = rank[place]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield 1, self.vocabulary, np.bincount(self.tokens, minlength=len(self.vocabulary))
        yield 2, self.pairs, np.bincount(self.pair, minlength=len(self.pairs))


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _blocks(batches: DataFrame, parts: int) -> DataFrame:
    """(part, gram, batch, kind, hashes, counts): the n-grams of every batch, cut by the part that owns them."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(incoming):
            for gram, hashes, counts in _Batch(row).grams():
                edges = np.searchsorted(_part_of(hashes, parts), np.arange(parts + 1))
                out = []
                for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if b > a:
                        steps = np.diff(hashes[a:b], prepend=np.zeros(1, np.uint64))
                        out.append((part, gram, row["batch"], row["kind"], _pack(steps), _pack(counts[a:b].astype(np.uint32))))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "gram", "batch", "kind", "hashes", "counts"])

    return batches.select("batch", "kind", "ids", "counts", "vocabulary", "tokens").mapInArrow(
        run, "part int, gram int, batch long, kind int, hashes binary, counts binary"
    )


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    """Per block the totals of its n-grams over all counted texts and over the deleted ones, in its own
    order; and one row (batch null) with the part's tokens, deleted tokens and distinct words."""
    rows = table.to_pylist()
    out = []
    for gram in (1, 2):
        own = [r for r in rows if r["gram"] == gram]
        if not own:
            continue
        hashes = [np.cumsum(_unpack(r["hashes"], np.uint64), dtype=np.uint64) for r in own]
        counts = [_unpack(r["counts"], np.uint32) for r in own]
        sizes = [len(h) for h in hashes]
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        kind = np.repeat([r["kind"] for r in own], sizes)
        every = np.concatenate(counts).astype(np.float64)
        learnt = np.bincount(place, np.where(kind != OTHER, every, 0), len(distinct)).astype(np.uint64)
        deleted = np.bincount(place, np.where(kind == DELETED, every, 0), len(distinct)).astype(np.uint64)
        for r, at in zip(own, np.split(place, np.cumsum(sizes)[:-1])):
            back = _pack(deleted[at]) if r["kind"] == DELETED else None
            out.append((r["batch"], r["part"], gram, _pack(learnt[at]), back, None, None, None))
        if gram == 1:
            out.append((None, own[0]["part"], 1, None, None, int(learnt.sum()), int(deleted.sum()), int((learnt > 0).sum())))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["batch", "part", "gram", "learnt", "deleted", "n", "n_deleted", "distinct"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


TOTALS = "batch long, part int, gram int, learnt binary, deleted binary, n long, n_deleted long, distinct long"


def _looked_up(back: pa.Table, column: str) -> dict[int, np.ndarray]:
    rows = sorted(back.select(["gram", "part", column]).to_pylist(), key=lambda r: (r["gram"], r["part"]))
    return {g: np.concatenate([_unpack(r[column], np.uint64) for r in rows if r["gram"] == g]) for g in (1, 2)}


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the logarithm of its count; the last one is open."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def _estimates(own: _Batch, counts: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: the bucket of its context, and the two maximum-likelihood estimates."""
    words, pairs = counts[1].astype(np.float64), counts[2].astype(np.float64)
    context = words[own.before]
    p2 = np.where(context > 0, pairs[own.pair] / np.maximum(context, 1), 0)
    return _bucket(context), p2, words[own.tokens] / max(n, 1)


def bins_for(tokens: int) -> int:
    """Enough bins of half a binary digit for estimates down to one in ``tokens``."""
    return max(BINS, 2 * math.ceil(math.log2(max(tokens, 2))) + 3)


def _bins(p: np.ndarray, bins: int = BINS) -> np.ndarray:
    return np.where(p > 0, 1 + np.clip(-2 * np.log2(np.maximum(p, 1e-300)), 0, bins - 2).astype(np.int64), 0)


def _summary(n: int, key: tuple, texts: pa.Table, back: pa.Table) -> pa.Table:
    """Of the deleted texts' tokens, by bucket and bins of both estimates: number and sums, under the
    counts of the other training texts."""
    out, bins = [], bins_for(n)
    for row in texts.to_pylist():
        own = _Batch(row)
        every, deleted = _looked_up(back, "learnt"), _looked_up(back, "deleted")
        bucket, p2, p1 = _estimates(own, {g: every[g] - deleted[g] for g in every}, n)
        code, place = np.unique((bucket * bins + _bins(p2, bins)) * bins + _bins(p1, bins), return_inverse=True)
        sums = [np.bincount(place, w, len(code)) for w in (np.ones(len(place)), p2, p1)]
        out += zip(code.tolist(), *(s.tolist() for s in sums))
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.table([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=["code", "k", "p2", "p1"])


def mixture_weights(code: np.ndarray, k: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, bins: int = BINS) -> np.ndarray:
    """(l2, l1, l0) per bucket of context frequency, by expectation-maximisation.

    A bucket without events takes the weights of all events; an unseen context has no bigram estimate.
    """
    bucket = code // (bins * bins)
    p = np.stack([p2, p1, np.full(len(code), p0)], 1)

    def learn(mine: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights = start
        for _ in range(ROUNDS):
            share = p[mine] * weights
            share *= (k[mine] / np.maximum(share.sum(1), 1e-300))[:, None]
            weights = (share.sum(0) + 1e-3 * start) / (share.sum() + 1e-3)
        return weights

    overall = learn(np.ones(len(code), bool), np.array([0.4, 0.4, 0.2])) if len(code) else np.array([0.4, 0.4, 0.2])
    out = np.tile(overall, (BUCKETS, 1))
    for b in np.unique(bucket):
        out[b] = learn(bucket == b, overall)
    out[0, 0] = 0
    out[0] /= out[0].sum()
    return out


def _scored(n: int, distinct: int, weights: np.ndarray, key: tuple, texts: pa.Table, back: pa.Table) -> pa.Table:
    out = []
    for i, row in enumerate(texts.to_pylist()):
        own = _Batch(row)
        counts = _looked_up(back, "learnt")
        bucket, p2, p1 = _estimates(own, counts, n)
        mix = weights[bucket]
        model = np.log10(mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] / (distinct + 1))
        seen = counts[1][own.tokens].astype(np.float64)
        base = np.log10((seen + 1) / (n + distinct + 1))
        first = np.cumsum(own.counts) - own.counts
        per_text = lambda x: np.add.reduceat(x, first)
        ids = texts.column("ids").combine_chunks()[i].values
        columns = [ids, pa.array([row["kind"]] * len(first), pa.int32()), pa.array(own.counts), pa.array(per_text((seen > 0).astype(np.int64)))]
        out.append(pa.table([*columns, pa.array(per_text(base)), pa.array(per_text(model))], names=SCORED))
    return pa.concat_tables(out)


SCORED = ["doc_id", "kind", "n_tokens", "n_known", "base_score", "score"]


def score(docs: DataFrame, kind: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``kind`` says of every text whether it is LEARN, DELETED or OTHER.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), kind.cast("int").alias("kind"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil((chars / LEAST_CHARS) ** 0.75))
    batches = cut(_batches(rows, max(LEAST_CHARS, chars // parts)))
    totals = cut(_blocks(batches, parts).groupBy("part").applyInArrow(_totals, TOTALS))
    n, deleted, distinct = totals.where("batch is null").agg(F.sum("n"), F.sum("n_deleted"), F.sum("distinct")).first()
    n, deleted, distinct = n or 0, deleted or 0, distinct or 0
    back = totals.where("batch is not null").select("batch", "part", "gram", "learnt", "deleted").groupBy("batch")

    events = batches.where(F.col("kind") == DELETED).groupBy("batch")
    of_deleted = totals.where("batch is not null and deleted is not null").select("batch", "part", "gram", "learnt", "deleted").groupBy("batch")
    found = events.cogroup(of_deleted).applyInArrow(_with_key(_summary, n - deleted), "code long, k double, p2 double, p1 double")
    # At most BUCKETS * bins * bins rows: 310,000 for 10^13 tokens.
    summed = found.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("k", "p2", "p1")]).orderBy("code").collect()
    code, k, p2, p1 = np.array([tuple(r) for r in summed], np.float64).reshape(-1, 4).T
    weights = mixture_weights(code.astype(np.int64), k, p2 / np.maximum(k, 1), p1 / np.maximum(k, 1), 1 / (distinct + 1), bins_for(n - deleted))

    id_type = rows.schema["id"].dataType.simpleString()
    shape = f"doc_id {id_type}, kind int, n_tokens long, n_known long, base_score double, score double"
    scored = batches.groupBy("batch").cogroup(back).applyInArrow(_with_key(_scored, n, distinct, weights), shape)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def _with_key(function, *first):
    """A cogroup function of (key, left, right) with its first arguments given."""
    bound = partial(function, *first)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return bound(key, left, right)

    return run
