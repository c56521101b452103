"""Intervals, verdicts, confounding checks and paired tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tristage.functions.hashing import keyed, modulo
from tristage.functions.numeric import hypergeometric_cdf, two_sided_p
from tristage.operators.metrics import average_precision
from tristage.operators.ordering import (
    dense_index,
    exact_quantiles,
    join_groups,
    running,
    with_buckets,
)
from tristage.session import cut, with_package

CLASSES = ("real", "borderline", "weak", "indistinguishable", "reversed")


# ---------------------------------------------------------------- cluster bootstrap


REP_BLOCK = 100


def bootstrap_draws(
    groups: DataFrame, by: list[str], n_boot: int, seeds: list[int]
) -> DataFrame:
    """(by, seed, rep, index, mult): how often each group index is drawn, n_groups draws per rep.

    ``groups`` has one row per group with its dense ``index``. Draw (rep, i) is a hash of seed, rep
    and i, so every evaluation and every engine draws the same groups.
    """
    sizes = groups.groupBy(*by).agg(F.count("*").alias("n_groups"))
    sized = groups.join(sizes, by) if by else groups.join(F.broadcast(sizes))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(REP_BLOCK)))
    sd = F.explode(F.array(*[F.lit(s) for s in seeds]))
    # Each group row supplies one draw number per replicate. The few group rows are spread over all
    # tasks by (seed, block of replicates) before they fan out.
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = (
        sized.select(*by, "index", "n_groups", sd.alias("seed"))
        .select("*", blocks.alias("block"))
        .repartition(tasks, *by, "seed", "block", "index")
    )
    last = F.least(F.col("block") + REP_BLOCK, F.lit(n_boot)) - 1
    reps = slots.withColumn("rep", F.explode(F.sequence(F.col("block"), last)))
    key = keyed(F.col("seed"), *[F.col(c) for c in by], F.col("rep"), F.col("index"))
    picked = reps.select(*by, "seed", "rep", modulo(key, F.col("n_groups")).alias("index"))
    return picked.groupBy(*by, "seed", "rep", "index").agg(F.count("*").alias("mult"))


PART_ROWS = 1024  # of a row of packed scores
HELD_BYTES = 32 << 20  # of the multiplicities that one task holds
BUCKET_ROWS = 500_000
REPS = 200  # of a block at most
BLOCKS = 32  # at least, of about equal work, for every task slot
HASHED = 4096  # texts whose digests are held at once


def cluster_bootstrap(
    scores: DataFrame,
    group: str,
    n_boot: int = 2000,
    seeds: list[int] = (20260930,),
    by: list[str] | None = None,
    k: int = 100,
    id_col: str = "id",
    n_buckets: int | None = None,
    run: str | None = None,
) -> DataFrame:
    """PR-AUC/base and lift@k of every replicate that resamples whole groups with replacement.

    A row counts as often as its group was drawn; a NULL group is one group, numbered first. The top k
    takes rows in score order (ties by id) until their multiplicities reach k; the row crossing k counts
    for the missing part only. Draws with a single class are left out, and lift is NULL when a draw has
    fewer than k rows. The draws are those of ``bootstrap_draws``.

    Rows are sorted and packed once. A task takes a block of replicates: it draws their multiplicities,
    a vector per group, and walks over the packed rows in score order, summing the vectors of the rows
    element by element. So rows never meet single replicates in a join; a packed row is copied once per
    block. A task holds the multiplicities of one block, of all groups of a key and at least one
    replicate: a byte for a group. Runs told apart by the column ``run``, other scores of the same
    rows, share their draws.
    """
    by = by or []
    return _replicates(*_packed(scores, group, by, id_col, n_buckets, run), by, n_boot, list(seeds), k, run)


def _packed(
    scores: DataFrame, group: str, by: list[str], id_col: str, n_buckets: int | None, run: str | None
) -> tuple[DataFrame, DataFrame]:
    """The rows in score order, packed by parts, and how many groups every key has."""
    with_package(scores.sparkSession)
    runs = F.lit(None).cast("string") if run is None else F.col(run)
    scores = cut(scores.select(*by, runs.alias("_run"), group, id_col, "y", "score"))
    index = cut(dense_index(scores, group, "index", by))
    sizes = cut(index.groupBy(*by).agg(F.count("*").alias("n_groups")))
    rows = join_groups(scores, index, [*by, group]).drop(group)
    if n_buckets is None:
        n_buckets = min(4096, scores.count() // BUCKET_ROWS + 1)
    rows = with_buckets(rows, [*by, "_run"], "score", n_buckets) if n_buckets > 1 else rows.withColumn("_bucket", F.lit(0))
    bucket = W.partitionBy(*by, "_run", "_bucket").orderBy(F.col("score").desc(), F.col(id_col))
    placed = rows.withColumn("_at", F.row_number().over(bucket) - 1)
    packed = placed.groupBy(*by, "_run", "_bucket", F.floor(F.col("_at") / PART_ROWS).alias("_part")).agg(
        F.sort_array(F.collect_list(F.struct("_at", F.col("index").cast("int").alias("index"), F.col("y").cast("byte").alias("y"), F.col("score").cast("double").alias("score")))).alias("r")
    )
    return cut(packed.select(*by, "_run", "_bucket", "_part", *[F.col(f"r.{c}").alias(c) for c in ("index", "y", "score")])), sizes


def _in_blocks(sizes: DataFrame, n_boot: int, n_seeds: int) -> tuple[DataFrame, int]:
    """``sizes`` with the replicates in a ``block`` of the key, and how many blocks there are.

    Blocks of large and small keys take about the same draws. They meet in tasks by hash, so there are many
    for a slot; no block holds more than memory allows.
    """
    slots = BLOCKS * sizes.sparkSession.sparkContext.defaultParallelism
    n_draws = (sizes.agg(F.sum("n_groups")).first()[0] or 0) * n_boot * n_seeds
    own = F.greatest("n_groups", F.lit(1))
    reps = F.least(F.lit(REPS), F.lit(n_boot), F.floor(F.lit(HELD_BYTES) / own), F.ceil(F.lit(-(-n_draws // slots)) / own))
    sizes = sizes.withColumn("block", F.greatest(reps, F.lit(1)).cast("long"))
    return sizes, (sizes.agg(F.sum(F.ceil(F.lit(n_boot) / F.col("block")))).first()[0] or 0) * n_seeds


def _replicates(
    packed: DataFrame, sizes: DataFrame, by: list[str], n_boot: int, seeds: list[int], k: int, run: str | None
) -> DataFrame:
    sizes, n_blocks = _in_blocks(sizes, n_boot, len(seeds))
    blocks = sizes.select(*by, "block")
    packed_in = join_groups(packed, blocks, by) if by else packed.join(F.broadcast(blocks))  # one row without keys
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"), F.col("block")))
    dealt = [F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("seed"), starts.alias("first")]

    def spread(df: DataFrame, *columns) -> DataFrame:
        return df.select("*", dealt[0]).select("*", dealt[1]).select(*by, "seed", "first", *columns)

    prefix = keyed(F.col("seed"), *[F.col(c) for c in by]).alias("prefix")
    heads, body = spread(sizes, "n_groups", "block", prefix), spread(packed_in, *[c for c in packed.columns if c not in by])
    keys = [*by, "seed", "first"]
    stream = heads.unionByName(body, allowMissingColumns=True).repartition(max(1, min(10_000, n_blocks)), *keys)
    stream = stream.sortWithinPartitions(*keys, F.col("prefix").isNull(), "_run", F.col("_bucket").desc(), "_part")
    shape = StructType(
        [*[sizes.schema[c] for c in by], StructField("seed", LongType()), packed.schema["_run"]]
        + [StructField(c, LongType()) for c in ("rep", "n", "pos")] + [StructField("ap", DoubleType())]
        + [StructField(c, LongType()) for c in ("taken", "hits")]
    )
    walked = stream.mapInArrow(_bootstrap_walk(by, n_boot, k, shape.names), shape)
    base = F.col("pos") / F.col("n")
    precision = F.when(F.col("taken") == k, F.col("hits") / F.lit(k))
    return walked.where("pos > 0 and pos < n").select(
        *by, *([] if run is None else [F.col("_run").alias(run)]), "seed", "rep", (F.col("ap") / F.col("pos") / base).alias("pr_auc_over_base"), (precision / base).alias("lift")
    )


def _multiplicities(prefix: str, first: int, n: int, groups: int) -> np.ndarray:
    """(groups, n): how often each group is drawn in the replicates from ``first`` on; in bytes, if they hold it."""
    out = np.zeros((n, groups), np.uint8)
    for a in range(0, groups, 1 << 18):
        texts = [b":%d" % i for i in range(a, min(groups, a + (1 << 18)))]
        slices = [texts[i : i + HASHED] for i in range(0, len(texts), HASHED)]
        for r in range(n):
            head = f"{prefix}:{first + r}".encode()
            # Digests are joined a few at a time, so that they stay in the processor's cache.
            digests = b"".join([b"".join([sha256(head + t).digest() for t in some]) for some in slices])
            drawn = np.frombuffer(digests, ">u8")[::4].astype(np.uint64) % np.uint64(groups)
            times = np.bincount(drawn.astype(np.int64), minlength=groups) + out[r]
            if times.max() > np.iinfo(out.dtype).max:
                out = out.astype(np.uint32)
            out[r] = times
    return np.ascontiguousarray(out.T)


class _Walk:
    """Running sums of a block of replicates over rows of falling score."""

    def __init__(self, drawn: np.ndarray, first: int, k: int):
        self.drawn, self.first, self.k, n = drawn, first, k, drawn.shape[1]
        # Rows and positives so far, positives up to the last score that is done, and the results.
        self.n, self.pos, self.done, self.taken, self.hits = (np.zeros(n, np.int64) for _ in range(5))
        self.ap, self.score = np.zeros(n), None

    def close(self, done: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (pos - done) * pos / np.maximum(n, 1)

    def add(self, index: np.ndarray, y: np.ndarray, score: np.ndarray) -> None:
        if self.score is not None and score[0] != self.score:
            self.ap += self.close(self.done, self.pos, self.n)
            self.done = self.pos
        drawn = self.drawn[index]
        n, pos = np.cumsum(drawn, 0, np.int64) + self.n, np.cumsum(drawn * y[:, None].astype(drawn.dtype), 0, np.int64) + self.pos
        if (self.n < self.k).any():
            used = np.clip(self.k - (n - drawn), 0, drawn)
            self.taken, self.hits = self.taken + used.sum(0), self.hits + (used * y[:, None]).sum(0)
        ends = np.flatnonzero(score[1:] != score[:-1])
        if len(ends):
            at = pos[ends]
            self.ap += self.close(np.concatenate((self.done[None], at[:-1])), at, n[ends]).sum(0)
            self.done = at[-1]
        self.n, self.pos, self.score = n[-1], pos[-1], score[-1]

    def results(self) -> list[np.ndarray]:
        ap = self.ap + self.close(self.done, self.pos, self.n)
        return [np.arange(self.first, self.first + len(ap)), self.n, self.pos, ap, self.taken, self.hits]


def _bootstrap_walk(by: list[str], n_boot: int, k: int, names: list[str]):
    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = drawn = first = None
        key: list[pa.Scalar] = []

        def done() -> Iterator[pa.RecordBatch]:
            if walk is not None:
                values = walk.results()
                same = [pa.array([v.as_py()] * len(values[0]), v.type) for v in key]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(v) for v in values]], names)

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i, prefix in enumerate(columns["prefix"].to_pylist()):
                own = [columns[c][i] for c in (*by, "seed", "_run")]
                if prefix is not None:  # the first row of a block
                    yield from done()
                    walk, first = None, columns["first"][i].as_py()
                    n_reps = min(columns["block"][i].as_py(), n_boot - first)
                    drawn = _multiplicities(prefix, first, n_reps, columns["n_groups"][i].as_py())
                    continue
                if walk is None or own[-1].as_py() != key[-1].as_py():
                    yield from done()
                    walk, key = _Walk(drawn, first, k), own
                walk.add(*[columns[c][i].values.to_numpy() for c in ("index", "y", "score")])
        yield from done()

    return walk_all


def fold_intervals(
    scores: DataFrame, group: str, by: list[str], n_boot: int, seeds: list[int], real_from: float = 1.10,
    run: str | None = None, id_col: str = "id", asked: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Point, 95% interval of the first seed, agreement of the seeds and effect class per fold (and run).

    An interval that crosses 1 makes an effect indistinguishable, whether the seeds agree or not. So all
    replicates of the first seed are drawn for every fold, and those of the other seeds for the folds (and
    runs) where their agreement is ``asked`` for: a selection from the intervals of the first seed, by default
    all that are clear of 1. ``n_seeds`` tells how many were drawn; ``stable`` speaks of these.
    """
    own = [*by, *([] if run is None else [run])]
    scores = cut(scores.select(*own, group, id_col, "y", "score"))
    packed, sizes = _packed(scores, group, by, id_col, None, run)

    def intervals(rows: DataFrame, groups: DataFrame, some: list[int]) -> DataFrame:
        return cut(percentile_ci(_replicates(rows, groups, by, n_boot, some, 100, run), [*own, "seed"]))

    cis = first = intervals(packed, sizes, seeds[:1])
    point = average_precision(scores, own).select(*own, F.col("pr_auc_over_base").alias("point"))
    found = cut(join_groups(first.select(*own, "lo", "hi"), point, own).withColumn("crosses_1", _crosses()))
    more = found.where("not crosses_1") if asked is None else asked(found)
    more = cut(more.select(*own))
    if len(seeds) > 1 and not more.isEmpty():
        runs = more.select(*by, (F.lit(None).cast("string") if run is None else F.col(run)).alias("_run"))
        folds = join_groups(sizes, more.select(*by).distinct(), by) if by else sizes
        cis = cis.unionByName(intervals(join_groups(packed, runs, [*by, "_run"]), folds, seeds[1:]))
    return classify(join_groups(found, seed_stability(cis, own), own), real_from)


def _crosses() -> Column:
    return (F.col("lo") <= 1) & (F.col("hi") >= 1)


def percentile_ci(draws: DataFrame, by: list[str], value: str = "pr_auc_over_base") -> DataFrame:
    """95% percentile interval (linear); a group has at most n_boot draws per seed."""
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(ends.alias("_ci"), F.count(value).alias("n_draws")).select(
        *by, F.col("_ci")[0].alias("lo"), F.col("_ci")[1].alias("hi"), "n_draws"
    )


def seed_stability(cis: DataFrame, by: list[str]) -> DataFrame:
    """Whether the direction (clear of 1 or not) is the same for every seed."""
    direction = F.when(F.col("lo") > 1, "pos").when(F.col("hi") < 1, "neg").otherwise("cross")
    return cis.groupBy(*by).agg(
        F.count("*").alias("n_seeds"),
        (F.count_distinct(direction) == 1).alias("stable"),
    )


def classify(cis: DataFrame, real_from: float = 1.10) -> DataFrame:
    """Effect class from (point, lo, hi, stable): the interval settles direction, the point size."""
    crosses = _crosses()
    return cis.withColumns(
        {
            "crosses_1": crosses,
            "effect_class": F.when(~F.col("stable") | crosses, "indistinguishable")
            .when(F.col("hi") < 1, "reversed")
            .when(F.col("point") >= real_from, "real")
            .otherwise("weak"),
        }
    )


def downgrade(classified: DataFrame, counterpart: DataFrame, on: list[str]) -> DataFrame:
    """A real effect is borderline when the counterpart run's interval includes 1."""
    other = counterpart.select(*on, F.col("crosses_1").alias("_other"))
    robust = ~F.coalesce(F.col("_other"), F.lit(False))
    return classified.join(other, on, "left").withColumn(
        "effect_class",
        F.when((F.col("effect_class") == "real") & ~robust, "borderline").otherwise(
            F.col("effect_class")
        ),
    ).drop("_other")


def claim(
    classified: DataFrame, counterpart: DataFrame, on: list[str], baseline: float
) -> DataFrame:
    """How many folds pass both conditions: clear of 1 from above, and at least the baseline."""
    joined = downgrade(classified, counterpart, on)
    clear = ~F.col("crosses_1") & (F.col("point") >= 1) & (F.col("effect_class") != "borderline")
    return joined.agg(
        F.count("*").alias("n_folds"),
        F.count_if(clear).alias("n_clear"),
        F.count_if(clear & (F.col("point") >= baseline)).alias("n_pass"),
    )


def direction_table(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Two tasks side by side: direction from the interval, size from the point, opposite or not."""
    def view(df, tag):
        sign = F.when(F.col("lo") > 1, "+").when(F.col("hi") < 1, "-").otherwise("0")
        return df.select(
            *on, sign.alias(f"direction_{tag}"), (F.col("point") - 1).alias(f"magnitude_{tag}")
        )

    a, b = F.col("direction_a"), F.col("direction_b")
    return view(first, "a").join(view(second, "b"), on).withColumn(
        "opposite", (a != b) & (a != "0") & (b != "0")
    )


# ---------------------------------------------------------------- confounding


def rank_auc(
    df: DataFrame, value: str, positive: str, by: list[str] | None = None, n_buckets: int | None = None
) -> DataFrame:
    """P(value of a positive > value of a negative), ties by average rank; NULL without both."""
    by = by or []
    cell = df.groupBy(*by, value).agg(
        F.sum(positive).cast("long").alias("pos"), F.count("*").alias("n")
    )
    ranked = running(cell, by, value, ["n"], n_buckets=n_buckets)
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    out = ranked.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum(F.col("n") - F.col("pos")).alias("n_neg"),
        F.sum(F.col("pos") * rank).alias("_r1"),
    )
    u = F.col("_r1") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    auc = F.try_divide(u, F.col("n_pos").cast("double") * F.col("n_neg"))
    return out.select(*by, "n_pos", "n_neg", auc.alias("rank_auc"))


def simpson_check(
    df: DataFrame, value: str, positive: str, stratum: str, min_n: int = 300
) -> DataFrame:
    """Pooled rank AUC against the strata's median and range, and whether they disagree in sign."""
    pooled = rank_auc(df, value, positive).select(
        F.when((F.col("n_pos") >= min_n) & (F.col("n_neg") >= min_n), F.col("rank_auc")).alias("pooled")
    )
    inner = rank_auc(df, value, positive, [stratum]).where(
        (F.col("n_pos") >= min_n) & (F.col("n_neg") >= min_n)
    )
    within = inner.agg(
        F.count("*").alias("n_strata"),
        F.median("rank_auc").alias("within_median"),
        F.min("rank_auc").alias("within_min"),
        F.max("rank_auc").alias("within_max"),
    )
    # Both sides are one row.
    return pooled.join(F.broadcast(within)).withColumn(
        "reversed",
        F.coalesce((F.col("pooled") - 0.5) * (F.col("within_median") - 0.5) < 0, F.lit(False)),
    )


def risk_ratio(
    df: DataFrame, exposure: str, label: str, by: list[str] | None = None, min_n: int = 300
) -> DataFrame:
    """Failure rates with and without an exposure on observed rows, cells of at least ``min_n``."""
    by = by or []
    e, fail = F.col(exposure), (F.col(label) == 0).cast("long")
    agg = df.where(F.col(label) != -1).groupBy(*by).agg(
        F.count_if(e).alias("n_exposed"),
        F.count_if(~e).alias("n_unexposed"),
        F.avg(F.when(e, fail)).alias("rate_exposed"),
        F.avg(F.when(~e, fail)).alias("rate_unexposed"),
    )
    out = agg.where((F.col("n_exposed") >= min_n) & (F.col("n_unexposed") >= min_n))
    return out.withColumns(
        {
            "risk_diff": F.col("rate_exposed") - F.col("rate_unexposed"),
            "risk_ratio": F.try_divide("rate_exposed", "rate_unexposed"),
        }
    )


def exposure_profile(df: DataFrame, batch: str, length: str, min_n: int = 1000) -> DataFrame:
    """Motif use per batch: rates, positions among the exposed, and length medians by exposure.

    Lengths take few distinct values, so the exact percentile's per-group map stays small.
    """
    e = F.col("has_motif")

    def rate(c):
        return F.avg(F.col(c).cast("int"))

    agg = df.groupBy(batch).agg(
        F.count("*").alias("n"),
        rate("has_motif").alias("exposure_rate"),
        rate("motif_head").alias("_head"),
        rate("motif_tail").alias("_tail"),
        rate("starts_first").alias("starts_first_rate"),
        F.median(length).alias("median_all"),
        F.median(F.when(e, F.col(length))).alias("median_exposed"),
        F.median(F.when(~e, F.col(length))).alias("median_unexposed"),
    ).where(F.col("n") >= min_n)
    x = F.col("exposure_rate")
    return agg.select(
        batch, "n", "exposure_rate", "starts_first_rate",
        F.try_divide("_head", "exposure_rate").alias("head_share"),
        F.try_divide("_tail", "exposure_rate").alias("tail_share"),
        "median_all", "median_exposed", "median_unexposed",
        (F.col("median_exposed") - F.col("median_unexposed")).alias("median_delta"),
        ((x > 0.05) & (x < 0.95)).alias("mixed"),
    )


def adjudicate(
    df: DataFrame, tier: str, exposure: str, label: str, min_n: int = 100, min_events: int = 20
) -> DataFrame:
    """Risk ratio inside each evidence tier of the failures, each against all successes."""
    e = F.col(exposure)
    fails = df.where(F.col(label) == 0).groupBy(tier).agg(
        F.count_if(e).alias("fail_exposed"), F.count_if(~e).alias("fail_unexposed")
    )
    passes = df.where(F.col(label) == 1).agg(
        F.count_if(e).alias("pass_exposed"), F.count_if(~e).alias("pass_unexposed")
    )
    fe, fu = F.col("fail_exposed"), F.col("fail_unexposed")
    ne, nu = fe + F.col("pass_exposed"), fu + F.col("pass_unexposed")
    re, ru = F.try_divide(fe, ne), F.try_divide(fu, nu)
    enough = (ne >= min_n) & (nu >= min_n) & (fe >= min_events) & (fu >= min_events)
    # One row of successes beside one row per tier.
    return fails.join(F.broadcast(passes)).select(
        tier,
        ne.alias("n_exposed"), fe.alias("fail_exposed"), re.alias("rate_exposed"),
        nu.alias("n_unexposed"), fu.alias("fail_unexposed"), ru.alias("rate_unexposed"),
        F.try_divide(re, ru).alias("risk_ratio"),
        enough.alias("sufficient"),
        F.when(enough, "TESTABLE").otherwise("UNRESOLVED").alias("verdict"),
    )


def listed_if_few(df: DataFrame, limit: int = 50) -> DataFrame:
    """The rows themselves when there are at most ``limit``, else none."""
    n = df.agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(n)).where(F.col("_n") <= limit).drop("_n")


# ---------------------------------------------------------------- paired and resolution tests


def paired_runs(first: DataFrame, second: DataFrame, on: list[str], score: str = "score") -> DataFrame:
    """(on, a, b): the scores of two runs for the rows that both have."""
    return first.select(*on, F.col(score).alias("a")).join(second.select(*on, F.col(score).alias("b")), on)


def paired_shift(pairs: DataFrame, before: str = "a", after: str = "b") -> DataFrame:
    """Paired change with a Wilcoxon signed-rank test (zeros left out, tie-corrected normal)."""
    d = pairs.select((F.col(after) - F.col(before)).alias("d"))
    basic = d.agg(
        F.count("*").alias("n"),
        F.avg("d").alias("mean_shift"),
        F.stddev_pop("d").alias("std_shift"),
        F.avg(F.abs("d")).alias("abs_mean"),
        F.avg((F.col("d") > 0).cast("int")).alias("frac_up"),
        F.avg((F.abs("d") > 0.05).cast("int")).alias("frac_gt_05"),
        F.avg((F.abs("d") > 0.10).cast("int")).alias("frac_gt_10"),
    )
    median = exact_quantiles(d, [], "d", {"median_shift": 0.5})
    cell = d.where("d != 0").groupBy(F.abs("d").alias("size")).agg(
        F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up")
    )
    ranked = running(cell, [], "size", ["t"])
    rank = F.col("cum_t") - (F.col("t") - 1) / 2
    cubes = F.col("t").cast("double")
    sums = ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("m"),
        F.coalesce(F.sum(F.col("up") * rank), F.lit(0.0)).alias("r_up"),
        F.coalesce(F.sum(cubes * cubes * cubes - cubes), F.lit(0.0)).alias("ties"),
    )
    m = F.col("m").cast("double")
    r_all = m * (m + 1) / 2
    w = F.least(F.col("r_up"), r_all - F.col("r_up"))
    se = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("ties") / 2) / 24)
    z = F.try_divide(w - r_all / 2, se)
    tested = sums.select(w.alias("w_statistic"), z.alias("z"), two_sided_p(z).alias("wilcoxon_p"))
    return basic.join(F.broadcast(median)).join(F.broadcast(tested))


def resolution_check(top: DataFrame, draws: int = 100) -> DataFrame:
    """Observed against expected positives among the top picks, and P(at most that many | random).

    ``top`` carries n_rows, n_positive and observed; the random pick is without replacement.
    """
    base = F.col("n_positive") / F.col("n_rows")
    return top.where(F.col("n_rows") >= draws).select(
        "*",
        (base * draws).alias("expected"),
        hypergeometric_cdf(
            F.col("observed"), F.col("n_rows"), F.col("n_positive"), draws
        ).alias("p_at_most"),
    )


def ablation_diff(first: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """Relative change of a result between two variants, summarised over the cells both have."""
    joined = first.select(*on, F.col(value).alias("_a")).join(
        second.select(*on, F.col(value).alias("_b")), on
    )
    change = F.try_divide(F.col("_b") - F.col("_a"), F.col("_a"))
    return joined.select(change.alias("c")).where("c is not null").agg(
        F.count("*").alias("n_cells"),
        F.avg("c").alias("mean_change"),
        F.count_if(F.col("c") < 0).alias("n_down"),
        F.max(F.abs("c")).alias("max_abs_change"),
    )
