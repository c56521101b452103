"""Leakage-free splits and folds. The unit is always the whole similarity group."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tristage.functions.hashing import keyed, kfold_of, uniform
from tristage.operators.ordering import dense_index, join_groups
from tristage.session import cut, with_package


def representative(df: DataFrame, group: list[str], id_col: str, seed: int) -> DataFrame:
    """One row per group: the first by SHA-256 of ``id:seed`` (rank limit runs before the shuffle)."""
    order = F.sha2(keyed(F.col(id_col), seed), 256)
    spec = W.partitionBy(*group).orderBy(order, id_col)
    return df.withColumn("_rank", F.row_number().over(spec)).where("_rank = 1").drop("_rank")


def repair_membership(clusters: DataFrame, rep: str, member: str) -> DataFrame:
    """A member listed twice keeps the representative that is not itself."""
    own = (F.col(rep) == F.col(member)).cast("int")
    best = F.min(F.struct(own.alias("own"), F.col(rep).alias("rep")))
    return clusters.groupBy(member).agg(best.alias("_b")).select(
        F.col("_b.rep").alias(rep), F.col(member)
    )


def surrogate_ids(df: DataFrame, key: str, name: str = "seq_uid") -> DataFrame:
    """Attach the dense index of the sorted distinct key."""
    return df.join(dense_index(df, key, name), key, "left")


def hash_split(
    df: DataFrame,
    group: str,
    seed: int,
    fractions: tuple[float, float] = (0.8, 0.1),
    pin_above: float = 0.0,
    unit: str | None = None,
) -> DataFrame:
    """Assign whole groups by hash; groups holding more than ``pin_above`` of all units train.

    Rows without a group are one group, hashed by the seed alone.
    """
    train, val = fractions
    u = uniform(keyed(seed, F.col(group)))
    side = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    if not pin_above:
        return df.withColumn("split", side)
    units = df.select(group, unit or group).distinct()
    sizes = units.groupBy(group).agg(F.count("*").alias("_k"))
    total = units.select(unit or group).distinct().agg(F.count("*").alias("_total"))
    sides = sizes.join(F.broadcast(total)).select(
        group, F.when(F.col("_k") > pin_above * F.col("_total"), "train").otherwise(side).alias("split")
    )
    return join_groups(df, cut(sides), [group])


def group_sides(df: DataFrame, is_test: Column, group: str) -> DataFrame:
    """Side per group: mixed groups are dropped from both sides."""
    flags = df.groupBy(group).agg(
        F.bool_or(is_test).alias("_test"), F.bool_or(~is_test).alias("_train")
    )
    return flags.select(
        group,
        F.when(F.col("_test") & F.col("_train"), "dropped")
        .when(F.col("_test"), "test")
        .otherwise("train")
        .alias("split"),
    )


def group_split(df: DataFrame, is_test: Column, group: str) -> DataFrame:
    """The sides are a table, so that the join is between plain shuffles, which the adaptive skew join
    can split at a giant group; over an aggregate it cannot. Rows without a group are one group."""
    return join_groups(df, cut(group_sides(df, is_test, group)), [group])


def greedy_folds(sizes: DataFrame, name: str, size: str, k: int, min_n: int = 0) -> DataFrame:
    """Balance names over k folds: largest first (ties by name), each to the least loaded fold.

    ``sizes`` has one row per batch; batches below ``min_n`` get fold -1 and always train. The greedy
    rule is sequential by definition: the sorted batches stream once through a task that keeps a heap of
    the k loads and nothing else.
    """
    with_package(sizes.sparkSession)
    big = sizes.where(F.col(size) >= min_n).select(name, F.col(size).cast("long").alias("_size"))
    ordered = big.repartition(1).sortWithinPartitions(F.col("_size").desc(), F.col(name))
    shape = sizes.select(name, F.lit(0).alias("fold")).schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, fold) for fold in range(k)]
        for batch in batches:
            folds = []
            for n in batch.column("_size").to_pylist():
                load, fold = loads[0]
                heapq.heapreplace(loads, (load + n, fold))
                folds.append(fold)
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(folds, pa.int32())], [name, "fold"])

    small = sizes.where(F.col(size) < min_n).select(name, F.lit(-1).alias("fold"))
    return ordered.mapInArrow(assign, shape).unionByName(small)


def fold_train_test(df: DataFrame, folds: DataFrame, batch: str, group: str, k: int) -> DataFrame:
    """Rows with (fold, side) for every fold: test = held batches, train = untouched other groups.

    Instead of one semi and one anti join per fold, each group carries the set of folds that touch
    it (at most k), and a row trains in every fold outside that set. Rows without a group form one.
    """
    assigned = df.join(folds, batch, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    touched = assigned.groupBy(group).agg(
        F.collect_set(F.when(F.col("fold") >= 0, F.col("fold"))).alias("_touched")
    )
    every = F.sequence(F.lit(0), F.lit(k - 1))
    roles = F.transform(
        every,
        lambda j: F.struct(
            j.alias("fold"),
            F.when(j == F.col("_own"), "test")
            .when(~F.array_contains("_touched", j), "train")
            .otherwise("dropped")
            .alias("side"),
        ),
    )
    return (
        assigned.withColumnRenamed("fold", "_own")
        .transform(lambda d: join_groups(d, cut(touched), [group]))
        .withColumn("_role", F.explode(roles))
        .select(*df.columns, F.col("_role.fold").alias("fold"), F.col("_role.side").alias("side"))
    )


def fold_summary(
    assigned: DataFrame, batch: str, group: str, label: str, min_test_n: int, min_test_positives: int
) -> DataFrame:
    """Sizes, homology loss and failing groups per fold, and whether the fold can be evaluated."""
    fail = F.col(label) == 0
    per_group = assigned.groupBy("fold", "side", group).agg(
        F.count("*").alias("n"), F.bool_or(fail).alias("failed")
    )

    def total(side, col):
        return F.sum(F.when(F.col("side") == side, col).otherwise(0))

    failed = F.col("failed").cast("long")
    out = per_group.groupBy("fold").agg(
        total("test", F.col("n")).alias("n_test"),
        total("train", F.col("n")).alias("n_train"),
        total("dropped", F.col("n")).alias("n_dropped"),
        total("test", failed).alias("test_neg_groups"),
        total("train", failed).alias("train_neg_groups"),
    )
    batches = (
        assigned.where("side = 'test'").select("fold", batch).distinct()
        .groupBy("fold").agg(F.count("*").alias("n_batches"))
    )
    loss = F.col("n_dropped") * 100.0 / F.nullif(F.col("n_train") + F.col("n_dropped"), F.lit(0))
    enough = F.col("n_test") >= min_test_n
    positive = F.col("test_neg_groups") >= min_test_positives
    return out.join(batches, "fold", "left").select(
        *out.columns,
        F.coalesce("n_batches", F.lit(0)).alias("n_batches"),
        F.coalesce(loss, F.lit(0.0)).alias("homology_loss_pct"),
        (enough & positive).alias("evaluable"),
        F.when(~enough, "test too small").when(~positive, "too few failing groups")
        .otherwise("").alias("reason"),
    )


def side_counts(
    df: DataFrame, cluster: str, stages: list[str], side: str = "split"
) -> DataFrame:
    """Per side and stage: failed records, clusters with a failure, succeeded records."""
    aggs = []
    for s in stages:
        c = F.col(f"label_{s}")
        aggs += [
            F.sum((c == 0).cast("long")).alias(f"f_{s}"), F.sum((c == 1).cast("long")).alias(f"s_{s}")
        ]
    per_cluster = df.groupBy(side, cluster).agg(*aggs)
    sums = []
    for s in stages:
        sums += [
            F.sum(f"f_{s}").alias(f"f_{s}"),
            F.sum((F.col(f"f_{s}") > 0).cast("long")).alias(f"c_{s}"),
            F.sum(f"s_{s}").alias(f"s_{s}"),
        ]
    stack = ", ".join(f"'{s}', f_{s}, c_{s}, s_{s}" for s in stages)
    return per_cluster.groupBy(side).agg(*sums).selectExpr(
        side, f"stack({len(stages)}, {stack}) as (stage, neg_records, neg_clusters, pos_records)"
    )


def cv_fold(df: DataFrame, group: str, seed: int, k: int, name: str = "cv_fold") -> DataFrame:
    return df.withColumn(name, kfold_of(F.col(group), seed, k))
