"""Inventories, concentration, redundancy and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tristage.functions.text import (
    DISORDER_PROMOTING,
    HYDROPHOBIC,
    RESIDUES20,
    letter_count,
    letter_set_count,
)
from tristage.operators.labels import fail_on
from tristage.operators.ordering import sample_rows
from tristage.schema import STAGES


def inventory(
    df: DataFrame, group: str, unit: str, stages: list[str] = STAGES
) -> DataFrame:
    """Records, units, failures per stage and both shares per group.

    Units are counted after one aggregation per (group, unit), so no distinct is expanded and a
    hot group is pre-aggregated. Unit shares are of the overall distinct units and may add to
    more than 1.
    """
    fails = [F.sum((F.col(f"label_{s}") == 0).cast("long")).alias(f"fail_{s}") for s in stages]
    per_unit = df.groupBy(group, unit).agg(F.count("*").alias("n"), *fails)
    per_group = per_unit.groupBy(group).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_units"),
        *[F.sum(f"fail_{s}").alias(f"fail_{s}") for s in stages],
    )
    all_units = per_unit.groupBy(unit).agg(F.sum("n").alias("n"))
    total = all_units.agg(F.sum("n").alias("_n"), F.count("*").alias("_u"))
    return per_group.join(F.broadcast(total)).select(
        *per_group.columns,
        (F.col("n") / F.col("_n")).alias("share"),
        (F.col("n_units") / F.col("_u")).alias("unit_share"),
    )


def concentration(
    df: DataFrame, group: str, unit: str, stages: list[str] = STAGES
) -> DataFrame:
    """Per stage: failing units, contributing groups, the largest contributor and its share."""
    flags = [F.bool_or(F.col(f"label_{s}") == 0).alias(s) for s in stages]
    stack = ", ".join(f"'{s}', {s}" for s in stages)
    failing = (
        df.groupBy(group, unit).agg(*flags)
        .selectExpr(group, unit, f"stack({len(stages)}, {stack}) as (stage, failed)")
        .where("failed")
    )
    per_group = failing.groupBy("stage", group).agg(F.count("*").alias("k"))
    top = per_group.groupBy("stage").agg(
        F.count("*").alias("n_groups"),
        F.min(F.struct((-F.col("k")).alias("neg"), F.col(group).alias("g"))).alias("m"),
    )
    total = (
        failing.select("stage", unit).distinct().groupBy("stage").agg(F.count("*").alias("failing_units"))
    )
    return top.join(total, "stage").select(
        "stage", "failing_units", "n_groups", F.col("m.g").alias("top_group"),
        (-F.col("m.neg")).alias("top_units"),
        (-F.col("m.neg") / F.col("failing_units")).alias("top_share"),
    )


def rate_by_group(df: DataFrame, group: str, label: str, min_n: int = 1000) -> DataFrame:
    """Failure rate of observed rows in groups of ``min_n``; a zero rate is flagged as suspicious."""
    fail = F.sum((F.col(label) == 0).cast("long"))
    agg = df.where(F.col(label) != -1).groupBy(group).agg(F.count("*").alias("n"), fail.alias("fail"))
    return agg.where(F.col("n") >= min_n).select(
        group, "n", "fail", (F.col("fail") / F.col("n")).alias("rate"),
        (F.col("fail") == 0).alias("zero_rate"),
    )


def length_profile(df: DataFrame, length: str, short: int = 30, long: int = 2000) -> DataFrame:
    """Exact length quantiles and outlier counts. Lengths have few distinct values."""
    p = F.percentile(length, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    return df.agg(
        F.count("*").alias("n"), F.min(length).alias("min_len"), F.max(length).alias("max_len"),
        p.alias("_p"), F.count_if(F.col(length) < short).alias("n_short"),
        F.count_if(F.col(length) > long).alias("n_long"),
    ).select(
        "n", "min_len", "max_len",
        *[F.col("_p")[i].alias(f"p{q}") for i, q in enumerate((25, 50, 75, 95))],
        "n_short", "n_long",
    )


def year_histogram(df: DataFrame, year: str, stages: list[str]) -> DataFrame:
    """Records and failures per year; unknown years form the group -1."""
    y = F.when(F.col(year) > 0, F.col(year)).otherwise(-1).cast("int")
    fails = [F.sum((F.col(f"label_{s}") == 0).cast("long")).alias(f"fail_{s}") for s in stages]
    return df.groupBy(y.alias("year")).agg(F.count("*").alias("n"), *fails)


def redundancy(df: DataFrame, unit: str, cluster: str) -> DataFrame:
    """Records per unit, units per cluster, the largest cluster and the share of singletons."""
    per_unit = df.groupBy(cluster, unit).agg(F.count("*").alias("n"))
    per_cluster = per_unit.groupBy(cluster).agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    return per_cluster.agg(
        F.sum("n").alias("n_records"), F.sum("k").alias("n_units"), F.count("*").alias("n_clusters"),
        F.max("k").alias("largest_cluster"), F.count_if(F.col("k") == 1).alias("singletons"),
    ).select(
        "*",
        (F.col("n_records") / F.col("n_units")).alias("records_per_unit"),
        (F.col("n_units") / F.col("n_clusters")).alias("units_per_cluster"),
        (F.col("singletons") / F.col("n_clusters")).alias("singleton_share"),
    )


def shrinkage(df: DataFrame, by: list[str], unit: str, where: Column) -> DataFrame:
    """Matching records over distinct units per group, and its decimal logarithm."""
    per_unit = df.where(where).groupBy(*by, unit).agg(F.count("*").alias("n"))
    out = per_unit.groupBy(*by).agg(F.sum("n").alias("n_records"), F.count("*").alias("n_units"))
    ratio = F.col("n_records") / F.col("n_units")
    return out.select("*", ratio.alias("shrinkage"), F.log10(ratio).alias("log10_shrinkage"))


def stage_shrinkage(df: DataFrame, unit: str, value: int, stages: list[str] = STAGES) -> DataFrame:
    """``shrinkage`` of one label value for every stage, in one pass over the records."""
    counts = [F.sum((F.col(f"label_{s}") == value).cast("long")).alias(s) for s in stages]
    stack = ", ".join(f"'{s}', {s}" for s in stages)
    long = (
        df.groupBy(unit).agg(*counts)
        .selectExpr(unit, f"stack({len(stages)}, {stack}) as (stage, n)").where("n > 0")
    )
    out = long.groupBy("stage").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_units"))
    ratio = F.col("n_records") / F.col("n_units")
    return out.select("*", ratio.alias("shrinkage"), F.log10(ratio).alias("log10_shrinkage"))


def tier_counts(df: DataFrame, tier: str, stages: list[str] = STAGES) -> DataFrame:
    """Failures per stage and evidence tier."""
    sums = [F.sum((F.col(f"label_{s}") == 0).cast("long")).alias(s) for s in stages]
    stack = ", ".join(f"'{s}', {s}" for s in stages)
    return (
        df.groupBy(tier).agg(*sums)
        .selectExpr(tier, f"stack({len(stages)}, {stack}) as (stage, n_fail)").where("n_fail > 0")
    )


def group_size_by_failure(df: DataFrame, group: str, label: str) -> DataFrame:
    """Median group size of groups with and without a failure."""
    sizes = df.groupBy(group).agg(
        F.count("*").alias("k"), F.bool_or(F.col(label) == 0).alias("has_failure")
    )
    return sizes.groupBy("has_failure").agg(
        F.count("*").alias("n_groups"), F.median("k").alias("median_size")
    )


def share_alike(df: DataFrame, licences: DataFrame, source: str) -> DataFrame:
    """Records per licence class; ``licences`` is a small (source, share_alike) dimension."""
    per_source = df.groupBy(source).agg(F.count("*").alias("n"))
    joined = per_source.join(licences, source, "left")
    return joined.agg(
        F.sum("n").alias("n_records"),
        F.sum(F.when(F.col("share_alike"), F.col("n")).otherwise(0)).alias("n_share_alike"),
    ).withColumn("share", F.col("n_share_alike") / F.col("n_records"))


def corpus_share(
    df: DataFrame, col: str, letters: dict[str, str], by: list[str] | None = None,
    n: int | None = None, seed: int = 0, id_col: str | None = None,
) -> DataFrame:
    """Share of letter sets in all letters, optionally of a fixed sample of ``n`` rows."""
    if n is not None:
        df = sample_rows(df, n, seed, id_col)
    sums = [F.sum(letter_set_count(F.col(col), ls)).alias(name) for name, ls in letters.items()]
    agg = df.groupBy(*(by or [])).agg(F.sum(F.length(col)).alias("_total"), *sums)
    return agg.select(
        *(by or []),
        *[F.try_divide(name, "_total").alias(name) for name in letters],
    )


def contrast(
    df: DataFrame, flag: str, col: str, length: str, letters: str = RESIDUES20, top: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Flagged against other rows: (one row of summary measures, the largest letter differences)."""
    f = F.col(flag)
    measures = {"disorder": DISORDER_PROMOTING, "hydrophobic": HYDROPHOBIC}
    counts = {name: letter_set_count(F.col(col), ls) for name, ls in measures.items()}
    counts |= {f"aa_{a}": letter_count(F.col(col), a) for a in letters}
    sums = []
    for side, on in (("f", f), ("o", ~f)):
        sums.append(F.sum(F.when(on, F.length(col))).alias(f"{side}_total"))
        sums.append(F.median(F.when(on, F.col(length))).alias(f"{side}_median"))
        sums += [F.sum(F.when(on, c)).alias(f"{side}_{name}") for name, c in counts.items()]
    wide = df.agg(*sums)

    def share(side, name):
        return F.try_divide(f"{side}_{name}", f"{side}_total")

    summary = wide.select(
        F.col("f_median").alias("median_flagged"), F.col("o_median").alias("median_other"),
        *[share(s, m).alias(f"{m}_{n}") for m in measures for s, n in (("f", "flagged"), ("o", "other"))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("letter"), share("f", f"aa_{a}").alias("flagged"),
                share("o", f"aa_{a}").alias("other"),
            )
            for a in letters
        ]
    )
    deltas = wide.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "delta", F.col("flagged") - F.col("other")
    )
    return summary, deltas.orderBy(F.abs("delta").desc(), "letter").limit(top)


def gate(
    df: DataFrame, group: str, unit: str, recent: Column, stages: list[str] = STAGES,
    min_stages: int = 3, min_negatives: int = 10_000, max_share: float = 0.40,
    min_units_for_bias: int = 1000, min_holdout: int = 1000,
) -> DataFrame:
    """One verdict row: enough negatives, no dominating group, holdouts can be built."""
    conc = concentration(df, group, unit, stages)
    stage_row = conc.agg(
        F.count_if(F.col("failing_units") >= min_negatives).alias("stages_ok"),
        F.max(F.when(F.col("failing_units") >= min_units_for_bias, F.col("top_share"))).alias("worst_neg_share"),
    )
    groups = inventory(df, group, unit, []).agg(
        F.max("unit_share").alias("top_unit_share"),
        F.count_if(F.col("n_units") >= min_holdout).alias("holdout_groups"),
    )
    recent_row = df.agg(F.count_if(recent).alias("recent_rows"))
    # Three one-row results side by side.
    row = stage_row.join(F.broadcast(groups)).join(F.broadcast(recent_row))
    checks = {
        "enough_negatives": F.col("stages_ok") >= min_stages,
        "no_dominating_group": F.col("top_unit_share") <= max_share,
        "no_dominating_negatives": F.coalesce(F.col("worst_neg_share") <= max_share, F.lit(False)),
        "holdouts_possible": (F.col("holdout_groups") >= 2) & (F.col("recent_rows") >= min_holdout),
    }
    out = row.withColumns(checks)
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return out.withColumn("passed", passed)


def reproduction_gate(results: DataFrame, value: str, reference: float, tolerance: float,
                      checks: DataFrame, verdict: str) -> DataFrame:
    """Reproduced score within tolerance, and every leakage check passed."""
    score = results.agg(F.avg(value).alias("reproduced"))
    leak = checks.agg(F.coalesce(F.bool_and(F.col(verdict) == "PASS"), F.lit(False)).alias("all_clean"))
    within = F.abs(F.col("reproduced") - reference) <= tolerance
    return score.join(F.broadcast(leak)).withColumns(
        {"within": within, "passed": within & F.col("all_clean")}
    )


def cross_check(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Cells (key, counter) where a stored and a recomputed counter differ, missing ones included."""
    counters = [c for c in expected.columns if c not in on]
    stack = ", ".join(f"'{c}', cast({c} as bigint)" for c in counters)

    def long(df, name):
        return df.selectExpr(*on, f"stack({len(counters)}, {stack}) as (counter, {name})")

    both = long(expected, "expected").join(long(actual, "actual"), [*on, "counter"], "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def require_equal(expected: DataFrame, actual: DataFrame, on: list[str]) -> None:
    fail_on(cross_check(expected, actual, on), "stored and recomputed counters differ", 10)
