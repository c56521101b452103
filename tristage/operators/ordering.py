"""Order-dependent results without a one-task window.

A window without (or with a hot) partition key runs in one task. Here the key range is cut into
buckets at values drawn from the data, each bucket is a window of its own, and the bucket totals
carry the running sums across. One key in ``SPAN`` may be a cut point, and the min-hash picks of
``BUCKETS`` hash slots are: so the number of buckets follows the number of keys up to ``BUCKETS`` without
counting them, and small groups are one bucket. The cut points depend on the data only and come out the
same however often and wherever the plan is evaluated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

BUCKETS = 4096
SPAN = 8192
STEP = 64  # cut points that one comparison of the first level stands for


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on the group columns; a NULL group is a group like any other."""
    other = right
    for c in by:
        other = other.withColumnRenamed(c, f"_right_{c}")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(other, same, how).drop(*[f"_right_{c}" for c in by])


def with_buckets(df: DataFrame, by: list[str], key: str, n_buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``, an order-preserving bucket of ``key`` within the groups of ``by``.

    With ``n_buckets`` given, every key may be a cut point, so there are about that many in any data.
    """
    span, slots = (SPAN, BUCKETS) if n_buckets is None else (1, n_buckets)
    # The order of the picks is a hash of the whole row, and no filter leaves rows out before. With a
    # pruned copy of ``df`` its shuffle could not be reused here, and the input would be scanned again.
    row = F.xxhash64(key, *[c for c in df.columns if c not in (*by, key)])
    spread = F.xxhash64(key)
    chosen = F.pmod(F.shiftrightunsigned(spread, 20), F.lit(span)) == 0
    picks = df.groupBy(*by, F.pmod(spread, F.lit(slots)).alias("_slot")).agg(
        F.min_by(F.when(chosen, F.col(key)), F.when(chosen, row)).alias("_pick")
    )
    bounds = picks.groupBy(*by).agg(F.sort_array(F.collect_set("_pick")).alias("_bounds"))
    # ``bounds`` has one row of at most as many values as slots when there are no groups.
    joined = join_groups(df, bounds, by) if by else df.join(F.broadcast(bounds))
    if slots > STEP:
        # Two levels: every STEP-th cut point, then the STEP ones from the last of these below the key.
        coarse = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_bounds") - 1, F.lit(0)), F.lit(STEP)), lambda i: F.get("_bounds", i))
        block = F.size(F.filter(coarse, lambda b: b < F.col(key)))
        near = F.slice("_bounds", F.greatest(block - 1, F.lit(0)) * STEP + 1, F.lit(STEP))
        below = F.greatest(block - 1, F.lit(0)) * STEP + F.size(F.filter(near, lambda b: b < F.col(key)))
    else:
        below = F.size(F.filter("_bounds", lambda b: b < F.col(key)))
    return joined.withColumn("_bucket", below).drop("_bounds")


def running(
    df: DataFrame,
    by: list[str],
    key: str,
    sums: list[str],
    descending: bool = False,
    n_buckets: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``cum_<c>`` in the order of ``key`` (unique within a group), and
    the groups' ``total_<c>``."""
    return running_in_buckets(
        with_buckets(df, by, key, n_buckets), by, key, sums, descending
    ).drop("_bucket")


def running_in_buckets(
    bucketed: DataFrame, by: list[str], key: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """Running sums ``cum_<c>`` and group totals ``total_<c>`` of rows that carry ``_bucket``."""
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    group = W.partitionBy(*by)
    before = group.orderBy(direction("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    within = (
        W.partitionBy(*by, "_bucket")
        .orderBy(direction(key))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    totals = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(c).over(group).alias(f"total_{c}") for c in sums],
    )
    return join_groups(bucketed, offsets, [*by, "_bucket"]).select(
        *bucketed.columns,
        *[(F.sum(c).over(within) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
    )


def dense_index(df: DataFrame, key: str, name: str, by: list[str] | None = None) -> DataFrame:
    """0-based position of every distinct ``key`` in sorted order."""
    by = by or []
    keys = df.select(*by, key).distinct().withColumn("_one", F.lit(1))
    return running(keys, by, key, ["_one"]).select(
        *by, key, (F.col("cum__one") - 1).cast("long").alias(name)
    )


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, qs: dict[str, float], n_buckets: int | None = None
) -> DataFrame:
    """Linear-interpolation quantiles from (value, count) cells, for values with many levels."""
    cells = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(cells, by, value, ["_n"], n_buckets=n_buckets)
    first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1

    def at(position):
        return F.max(F.when(position.between(first, last), F.col(value)))

    out = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("total__n") - 1)
        lo, hi, part = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))
        out.append((lo + (hi - lo) * part).cast("double").alias(name))
    return ranked.groupBy(*by).agg(*out)


def sample_rows(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """Exactly ``n`` rows, the same ones on every run: the first by hash of the id and the seed."""
    order = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))), 256)
    return df.orderBy(order, *ids).limit(n)
