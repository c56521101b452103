"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

The vectors are whole numbers. Their components are cut into ``LISTS`` parts, and for a query each
part gives one list of all candidates, sorted by the part's inner product. The score is the sum over
the lists. They are read from the top in turns. A candidate seen in some lists has at least its seen
sums plus the least value of the other lists, and at most its seen sums plus what those lists show
next. Reading stops when no candidate outside the best k can reach the k-th lower bound any more, and
the candidates left get their final scores from what the lists hold for them.

Queries and candidates are dealt into a grid of cells of bounded size; each cell gives its own top k
per query, and the cells' results are merged. No cell sees more than its share, so a hot vector costs
no more than others.

A vector that is null, empty or holds a null or a non-finite component takes no part. Shorter vectors
count as padded with zeros. A query is one row per distinct id; candidates are all rows with another
id, repeated rows included. Equal scores are ordered by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LISTS = 4
CANDIDATES = 8192  # of a cell
QUERIES = 1024  # of a cell
FIRST_READ = 0.02  # share of a list that the first turn reads; every turn doubles it


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * component); only rows whose vector can be scored."""
    parts: Column = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    usable = F.col(id_col).isNotNull() & (F.size(parts) > 0) & ~F.exists(parts, bad)
    scaled = F.transform(parts, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    if len(flat):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _part_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point where no sum can leave its exact range."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2.0**53:
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    return queries @ candidates.T


def no_random_access(parts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(candidates, scores, entries read): all that are among the k best or tie with the k-th.

    ``parts`` has one row per list and one column per candidate.
    """
    lists, n = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    ordered = np.take_along_axis(parts, order, 1)
    least = ordered[:, -1]
    seen_sum, seen = np.zeros(n, np.int64), np.zeros((lists, n), bool)
    depth, size = 0, max(1, int(n * FIRST_READ))
    while True:
        upto = min(n, depth + size)
        for i in range(lists):
            new = order[i, depth:upto]
            seen_sum[new] += ordered[i, depth:upto]
            seen[i, new] = True
        depth, size = upto, upto
        if depth == n:
            touched, upper, lower = np.arange(n), seen_sum, seen_sum
        else:
            shown = ordered[:, depth]
            touched = np.flatnonzero(seen.any(0))
            unseen = ~seen[:, touched]
            lower = seen_sum[touched] + least @ unseen
            upper = seen_sum[touched] + shown @ unseen
        if len(touched) >= min(k, n):
            kth = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else lower.min()
            if depth == n or int(ordered[:, depth].sum()) < kth:
                # No candidate that is in no list so far can qualify; these may.
                left = touched[upper >= kth]
                if depth == n or len(left) <= max(4 * k, n // 50):
                    return left, parts[:, left].sum(0), depth * lists


def _cell(k: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        ids = candidates.column("id").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and len(ids):
            sizes = [np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max() for t in (queries, candidates)]
            width = int(max(sizes))
            q, c = _matrix(queries.column("v"), width), _matrix(candidates.column("v"), width)
            cuts = np.linspace(0, width, min(LISTS, width) + 1).astype(int)
            names = queries.column("id").to_numpy()
            for at in range(0, len(q), 64):
                parts = np.stack([_part_scores(q[at : at + 64, a:b], c[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
                for i in range(parts.shape[1]):
                    own = names[at + i]
                    found, scores, _ = no_random_access(parts[:, i, :], k + int((ids == own).sum()))
                    other = ids[found] != own
                    found, scores = found[other], scores[other]
                    best = np.lexsort((ids[found], -scores))[:k]
                    out.append((np.full(len(best), own), ids[found[best]], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables (id, v) of ``whole_vectors``."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n, m = candidates.count(), queries.count()
    rows, columns = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    other = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    c = candidates.select(F.pmod(F.xxhash64("id", "v"), F.lit(rows)).cast("int").alias("r"), other(columns).alias("c"), "id", "v")
    q = queries.select(other(rows).alias("r"), F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int").alias("c"), "id", "v")
    found = q.groupBy("r", "c").cogroup(c.groupBy("r", "c")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
