"""Base-rate-normalised ranking metrics on score tables.

A score table has an id, ``y`` (1 = the positive class, by convention failure; unobserved rows never
enter), ``score`` (higher = more likely positive) and any grouping columns. Every metric is computed
for all groups in one plan; undefined values are NULL. PR-AUC never comes without its base rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tristage.functions.hashing import keyed, uniform
from tristage.operators.ordering import join_groups, running, running_in_buckets, with_buckets

KS = (10, 20, 50, 100)


def _on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    # Without groups the right side is one row.
    return join_groups(left, right, by) if by else left.join(F.broadcast(right))


def cells(scores: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(score, positives, rows) per distinct score: all that tie-grouped metrics need."""
    w = F.lit(1) if weight is None else weight
    bucket = [c for c in scores.columns if c == "_bucket"]
    return scores.groupBy(*by, *bucket, "score").agg(
        F.sum(F.col("y") * w).cast("long").alias("pos"), F.sum(w).cast("long").alias("n")
    )


def thresholds(cell_table: DataFrame, by: list[str]) -> DataFrame:
    """Precision and recall at every distinct score, predicting positive at or above it.

    Cells that carry an order-preserving ``_bucket`` keep it; others get one from their own values.
    """
    if "_bucket" not in cell_table.columns:
        cell_table = with_buckets(cell_table, by, "score")
    ranked = running_in_buckets(cell_table, by, "score", ["pos", "n"], descending=True)
    return ranked.select(
        *by,
        "score",
        "pos",
        "n",
        F.col("cum_pos").alias("tp"),
        F.col("cum_n").alias("predicted"),
        F.col("total_n").alias("n_rows"),
        F.col("total_pos").alias("n_positive"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
    )


def _ap(pos: Column, precision: Column) -> Column:
    return F.try_divide(F.sum(pos * precision), F.max("n_positive"))


def average_precision(scores: DataFrame, by: list[str]) -> DataFrame:
    """n_rows, n_positive, base_rate, pr_auc, pr_auc_over_base per group; ties share a threshold."""
    return average_precision_of(cells(scores, by), by)


def average_precision_of(cell_table: DataFrame, by: list[str]) -> DataFrame:
    t = thresholds(cell_table, by)
    two_classes = (F.max("n_positive") > 0) & (F.max("n_positive") < F.max("n_rows"))
    out = t.groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"),
        F.max("n_positive").alias("n_positive"),
        F.when(two_classes, _ap(F.col("pos"), F.col("precision"))).alias("pr_auc"),
    )
    base = F.col("n_positive") / F.col("n_rows")
    return out.select(
        *by, "n_rows", "n_positive", base.alias("base_rate"), "pr_auc",
        F.try_divide("pr_auc", base).alias("pr_auc_over_base"),
    )


def top_hits(scores: DataFrame, ks: tuple[int, ...], by: list[str], id_col: str) -> DataFrame:
    """Positives among the k highest scores (ties by id); ranks are limited before the shuffle."""
    spec = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col(id_col).asc())
    top = scores.withColumn("_rank", F.row_number().over(spec)).where(F.col("_rank") <= max(ks))
    hit = [
        F.sum(F.when(F.col("_rank") <= k, F.col("y")).otherwise(0)).cast("long").alias(f"_hit_{k}")
        for k in ks
    ]
    return top.groupBy(*by).agg(F.max("_rank").alias("_top"), *hit)


def _at_k(ks: tuple[int, ...], base: Column, positives: Column) -> list[Column]:
    out = []
    for k in ks:
        enough = F.col("_top") >= k
        p = F.when(enough, F.col(f"_hit_{k}") / F.lit(k))
        out += [
            p.alias(f"precision_at_{k}"),
            F.when(enough, F.try_divide(F.col(f"_hit_{k}"), positives)).alias(f"recall_at_{k}"),
            F.try_divide(p, base).alias(f"lift_at_{k}"),
        ]
    return out


def evaluate(
    scores: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None, id_col: str = "id"
) -> DataFrame:
    """Base rate, PR-AUC, PR-AUC/base and precision, recall and lift at k; no k is ever shrunk."""
    by = by or []
    ap = average_precision(scores, by)
    return _on(ap, top_hits(scores, ks, by, id_col), by).select(
        *ap.columns, *_at_k(ks, F.col("base_rate"), F.col("n_positive"))
    )


def precision_recall_at_k(
    scores: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None, id_col: str = "id"
) -> DataFrame:
    """Precision, recall and lift at k without the curve."""
    by = by or []
    size = scores.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum("y").cast("long").alias("n_positive")
    )
    base = F.col("n_positive") / F.col("n_rows")
    return _on(size, top_hits(scores, ks, by, id_col), by).select(
        *by, "n_rows", "n_positive", *_at_k(ks, base, F.col("n_positive"))
    )


def group_spread(
    scores: DataFrame, group: str, ks: tuple[int, ...] = KS, min_n: int = 200, id_col: str = "id"
) -> DataFrame:
    """Best and worst group per measure among groups of at least ``min_n`` rows (long format).

    Also carries how many groups there are and how many were large enough.
    """
    per_group = evaluate(scores, ks, [group], id_col)
    measures = ["pr_auc_over_base"] + [f"{m}_at_{k}" for k in ks for m in ("precision", "lift")]
    stack = ", ".join(f"'{m}', {m}" for m in measures)
    long = per_group.selectExpr(group, "n_rows", f"stack({len(measures)}, {stack}) as (measure, value)")
    large = F.col("n_rows") >= min_n
    usable = large & F.col("value").isNotNull()
    out = long.groupBy("measure").agg(
        F.min(F.when(usable, F.struct((-F.col("value")).alias("v"), F.col(group).alias("g")))).alias("b"),
        F.min(F.when(usable, F.struct(F.col("value").alias("v"), F.col(group).alias("g")))).alias("w"),
        F.count("*").alias("n_groups_total"),
        F.count_if(large).alias("n_groups_evaluated"),
    )
    b, w = -F.col("b.v"), F.col("w.v")
    return out.where("b is not null").select(
        "measure",
        F.col("b.g").alias("best_group"),
        b.alias("best"),
        F.col("w.g").alias("worst_group"),
        w.alias("worst"),
        F.when(w > 0, b / w).otherwise(F.lit(float("inf"))).alias("best_over_worst"),
        (b - w).alias("spread"),
        "n_groups_total",
        "n_groups_evaluated",
    )


def largest_groups(scores: DataFrame, group: str, n: int = 5) -> DataFrame:
    sizes = scores.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.orderBy(F.col("n").desc(), group).limit(n)


def best_f1(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Highest F1 over all thresholds (lowest threshold on a tie) with its precision and recall."""
    by = by or []
    t = thresholds(cells(scores, by), by)
    f1 = F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("n_positive"))
    best = F.max(
        F.struct(
            f1.alias("f1"), (-F.col("score")).alias("neg"), F.col("precision").alias("p"),
            F.col("recall").alias("r"), F.col("score").alias("s"),
        )
    )
    return t.groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"), F.max("n_positive").alias("n_positive"), best.alias("b"),
        _ap(F.col("pos"), F.col("precision")).alias("pr_auc"),
    ).select(
        *by, "n_rows", "n_positive", F.col("b.f1").alias("best_f1"),
        F.col("b.p").alias("precision_at_best"), F.col("b.r").alias("recall_at_best"),
        F.col("b.s").alias("threshold"), "pr_auc",
    )


def best_f1_per_target(
    scores: DataFrame, target: str, reference: float, tolerance: float = 0.05, min_n: int = 20
) -> DataFrame:
    """Mean and median best F1 over two-class targets of ``min_n`` rows, against a reference."""
    usable = (F.col("n_rows") >= min_n) & (F.col("n_positive") > 0) & (
        F.col("n_positive") < F.col("n_rows")
    )
    per = best_f1(scores, [target]).where(usable)
    return per.agg(
        F.count("*").alias("n_targets"),
        F.avg("best_f1").alias("mean_best_f1"),
        F.median("best_f1").alias("median_best_f1"),
    ).withColumns(
        {
            "delta": F.col("mean_best_f1") - reference,
            "within_tolerance": F.abs(F.col("mean_best_f1") - reference) <= tolerance,
        }
    )


def by_score_column(df: DataFrame, columns: dict[str, int], keep: list[str]) -> DataFrame:
    """Long score table from several score columns; a sign of -1 flips lower-is-better scores.

    Missing scores take the column's mean, as long as the column has any value.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    filled = df.join(F.broadcast(means.select(*[F.col(c).alias(f"_m_{c}") for c in columns])))
    stack = ", ".join(
        f"'{c}', {sign} * cast(coalesce({c}, _m_{c}) as double)" for c, sign in columns.items()
    )
    return filled.selectExpr(*keep, f"stack({len(columns)}, {stack}) as (metric, score)").where(
        "score is not null"
    )


def pr_curve(scores: DataFrame, n_points: int = 200) -> DataFrame:
    """The precision-recall curve thinned to evenly spaced thresholds in rising order."""
    t = thresholds(cells(scores, []), [])
    distinct = t.select("score", "precision", "recall", F.lit(1).alias("one"))
    indexed = running(distinct, [], "score", ["one"]).withColumn("_i", F.col("cum_one") - 1)
    m = indexed.agg(F.count("*").alias("m"))
    points = F.least(F.lit(n_points), F.col("m"))
    step = (F.col("m") - 1) / F.nullif(points - 1, F.lit(0))
    wanted = m.select(
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0).cast("long"), points - 1),
                    lambda i: F.when(i == points - 1, F.col("m") - 1)
                    .otherwise(F.floor(i * F.coalesce(step, F.lit(0.0)))),
                )
            )
        ).alias("_i")
    )
    # At most n_points rows.
    return indexed.join(F.broadcast(wanted), "_i").select(
        F.col("_i").alias("point"), F.col("score").alias("threshold"), "precision", "recall"
    )


def calibrate(scores: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Pass rate, precision, recall, lift and lost positives at fixed cut-offs, in one pass."""
    aggs = [F.count("*").alias("n"), F.sum("y").cast("long").alias("p")]
    for i, t in enumerate(cutoffs):
        passed = F.col("score") >= t
        aggs += [
            F.count_if(passed).alias(f"n_{i}"),
            F.sum(F.when(passed, F.col("y")).otherwise(0)).cast("long").alias(f"p_{i}"),
        ]
    wide = scores.agg(*aggs)
    stack = ", ".join(f"cast({t} as double), n_{i}, p_{i}" for i, t in enumerate(cutoffs))
    long = wide.selectExpr(
        "n", "p", f"stack({len(cutoffs)}, {stack}) as (threshold, n_pass, hits)"
    ).where("n_pass > 0")
    precision = F.col("hits") / F.col("n_pass")
    return long.select(
        "threshold",
        "n_pass",
        (F.col("n_pass") / F.col("n")).alias("pass_rate"),
        "hits",
        precision.alias("precision"),
        F.try_divide("hits", "p").alias("recall"),
        F.try_divide(precision, F.col("p") / F.col("n")).alias("lift"),
        (F.col("p") - F.col("hits")).alias("positives_lost"),
        F.try_divide(F.col("p") - F.col("hits"), F.col("p")).alias("recall_lost"),
    )


def polarity(scores: DataFrame) -> DataFrame:
    """The same scores under three readings, tagged: as is, classes swapped, score negated."""
    y, s = F.col("y"), F.col("score")
    variants = F.array(
        F.struct(F.lit("positive_is_failure").alias("reading"), y.alias("y"), s.alias("score")),
        F.struct(F.lit("positive_is_success").alias("reading"), (1 - y).alias("y"), (-s).alias("score")),
        F.struct(F.lit("inverted_score").alias("reading"), y.alias("y"), (-s).alias("score")),
    )
    rest = [c for c in scores.columns if c not in ("y", "score")]
    return scores.select(*rest, F.explode(variants).alias("v")).select(*rest, "v.*")


def random_control(scores: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """The same rows scored by hash of the id; its PR-AUC/base must be near 1."""
    return scores.withColumn("score", uniform(keyed(seed, "random", F.col(id_col))))


def fold_stats(results: DataFrame, by: list[str], value: str) -> DataFrame:
    return results.groupBy(*by).agg(
        F.count(value).alias("n_folds"),
        F.median(value).alias("median"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )


def reversal(results: DataFrame, fold: str, model: str, reading: str, lift: str) -> DataFrame:
    """Folds where every model does better with its score inverted, and better than chance."""
    per_model = results.groupBy(fold, model).agg(
        F.max(F.when(F.col(reading) == "inverted_score", F.col(lift))).alias("inverted"),
        F.max(F.when(F.col(reading) == "positive_is_failure", F.col(lift))).alias("direct"),
    )
    turned = F.coalesce(
        (F.col("inverted") > 1) & (F.col("inverted") > F.col("direct")), F.lit(False)
    )
    return per_model.groupBy(fold).agg(
        F.count("*").alias("n_models"), F.bool_and(turned).alias("reversed")
    )


def ordering_claim(per_metric: DataFrame, first: str, other: str) -> Column:
    """Whether ``first`` beats ``other`` by PR-AUC in a (metric, pr_auc) table."""
    def ap(m):
        return F.max(F.when(F.col("metric") == m, F.col("pr_auc")))

    return ap(first) > ap(other)
