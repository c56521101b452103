"""From status histories, replicates and assay tables to one unified table of outcome records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tristage.functions import labels as L
from tristage.operators.ordering import running
from tristage.schema import (
    EXCLUDE,
    EXCLUDED_STATUSES,
    EXCLUDED_STOPS,
    EXTRA_COLUMNS,
    FAIL,
    LABELS,
    POLICIES,
    RECORD_COLUMNS,
    STAGES,
    STATUS_RULES,
    STOP_RULES,
    STOPPED,
    UNOBSERVED,
)




class InvalidData(ValueError):
    """An input breaks a rule that must hold; the message lists what was found."""


# ---------------------------------------------------------------- validation


def violations(df: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """Rows whose label vector is malformed (too short, unknown value, observed after a failure)."""
    return df.where(~L.is_valid(L.as_array(stages)))


def fail_on(bad: DataFrame, what: str, shown: int = 20) -> None:
    """Raise if there are any rows: how many, and a few of them as examples."""
    examples = [tuple(r) if len(r) > 1 else r[0] for r in bad.limit(shown).collect()]
    if examples:
        raise InvalidData(f"{what}: {bad.count()}, for example {examples}")


def require_valid(df: DataFrame) -> DataFrame:
    fail_on(violations(df).select(*[c for c in ("record_id", *LABELS) if c in df.columns]), "invalid label vectors", 5)
    return df


def checked(df: DataFrame) -> DataFrame:
    """``require_valid`` within the plan: a malformed vector fails the job that meets it."""
    bad = F.raise_error(F.concat(F.lit("invalid label vector: "), F.to_json(F.struct(*[c for c in ("record_id", *LABELS) if c in df.columns]))))
    return df.where(F.when(L.is_valid(L.as_array(STAGES)), F.lit(True)).otherwise(bad.cast("boolean")))


def require_domain(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """Fail on values outside the domain (NULL is allowed)."""
    unknown = df.where(F.col(col).isNotNull() & ~F.col(col).isin(allowed)).select(col).distinct()
    fail_on(unknown, f"{col}: unknown values")
    return df


def unknown_values(df: DataFrame, col: str, known: list[str]) -> DataFrame:
    """Values no rule covers, with counts, merged over all partitions."""
    return (
        df.where((F.col(col) != "") & ~F.col(col).isin(list(known)))
        .groupBy(col)
        .agg(F.count("*").alias("n"))
    )


def unmatched(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def require_matched(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that fails when a key has no partner."""
    fail_on(unmatched(df, other, key).select(key), f"{key}: rows without a match", 5)
    return df.join(other, key, "left")


# ---------------------------------------------------------------- status histories


def furthest_stage(
    history: DataFrame, trial: list[str], status: str, rules: dict[str, str | None] = STATUS_RULES
) -> DataFrame:
    """Furthest stage index each trial's statuses prove; -1 for none."""
    return history.groupBy(*trial).agg(
        F.coalesce(F.max(L.stage_index(F.col(status), rules)), F.lit(-1)).alias("reached"),
        F.count("*").alias("n_steps"),
    )


def outcome_from_history(
    trials: DataFrame,
    reached: str = "reached",
    status: str = "status",
    stop_status: str = "stop_status",
    stop_rules: dict[str, str | None] = STOP_RULES,
    policy: str = "keep_unobserved",
    infer_next_step: bool = True,
) -> DataFrame:
    """Add ``label``, ``evidence_tier``, ``exclusion_reason`` and ``conflict`` to trials.

    The history wins over a stop status that is not later than it. A stopped trial without a
    usable stop status fails at its next stage, as an inference. Excluded trials stay, unlabelled.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}, use one of {POLICIES}")
    last = len(STAGES) - 1
    r, st, stop = F.col(reached), F.col(status), F.col(stop_status)
    excluded_stops = [s for s, stage in stop_rules.items() if stage == EXCLUDE] or EXCLUDED_STOPS
    excluded = F.when(st.isin(EXCLUDED_STATUSES), "test_target").when(
        stop.isin(excluded_stops), "duplicate_target"
    )
    failed = F.when(excluded.isNull(), L.stage_index(stop, stop_rules))
    conflict = F.coalesce(failed <= r, F.lit(False))
    explicit = F.coalesce(failed > r, F.lit(False))
    stopped = (
        F.lit(infer_next_step) & (st == STOPPED) & ~explicit & excluded.isNull()
        if infer_next_step
        else F.lit(False)
    )
    nothing = stopped & (r < 0)
    inferred = stopped & (r >= 0) & (r < last)
    kept_blank = F.lit(False)
    if policy == "keep_unobserved":
        kept_blank = nothing
    elif policy == "clone_zero":
        inferred = stopped & (r < last)
    blank = excluded.isNotNull() | kept_blank
    fail_at = F.when(explicit, failed).when(inferred, r + 1)
    out = trials.withColumns(
        {
            "label": L.make_label(
                F.when(~blank, r).otherwise(-1), F.when(~blank, fail_at)
            ),
            "evidence_tier": F.when(explicit, "explicit")
            .when(inferred, "inferred_next_step")
            .otherwise("none"),
            "exclusion_reason": F.coalesce(
                excluded, F.when(kept_blank, "no_last_state_work_stopped"), F.lit("")
            ),
            "conflict": conflict,
        }
    )
    return out.where(~nothing) if policy == "drop" else out


def drop_excluded(
    records: DataFrame, reasons: tuple[str, ...] = ("test_target", "duplicate_target")
) -> DataFrame:
    """Leave tagged records out at pooling time; the tagged source keeps them."""
    return records.where(~F.col("exclusion_reason").isin(*reasons))


# ---------------------------------------------------------------- replicates and assays


def replicate_consensus(
    df: DataFrame,
    key: list[str],
    expression: Column,
    binding: Column,
    strength: Column,
    expressed: list[str],
) -> DataFrame:
    """One row per item: it succeeds when any replicate does, and fails only when none does."""
    e, b = F.lower(expression), F.lower(binding.cast("string"))
    agg = df.groupBy(*key).agg(
        F.count("*").alias("n_replicates"),
        F.coalesce(F.bool_or(e.isin(expressed)), F.lit(False)).alias("any_expressed"),
        F.coalesce(F.bool_or(b == "true"), F.lit(False)).alias("any_bound"),
        F.coalesce(F.bool_or(b == "false"), F.lit(False)).alias("any_unbound"),
        F.array_sort(F.collect_set(e)).alias("expression_values"),
        F.min(strength).alias("strength_min"),
    )
    label = L.replicate_label(F.col("any_expressed"), F.col("any_bound"), F.col("any_unbound"))
    return agg.withColumn("label", label)


def select_assays(
    meta: DataFrame, stage_of: dict[str, str], allow_median: bool = False
) -> DataFrame:
    """Assays that map to a stage (DROP maps to none) and use a manual threshold."""
    rules = {k: v for k, v in stage_of.items() if v != "DROP"}
    kind = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    out = meta.withColumn("stage", F.try_element_at(kind, F.col("selection_type")))
    out = out.where(F.col("stage").isNotNull())
    return out if allow_median else out.where(F.col("binarization") == "manual")


def assay_labels(df: DataFrame, bin_col: str = "score_bin") -> DataFrame:
    """Spread a 1/0 outcome into the six label columns at the row's stage."""
    b = F.col(bin_col)
    value = F.when(b == 1, 1).when(b == 0, 0).otherwise(UNOBSERVED)
    return df.select("*", *L.one_stage(F.col("stage"), value))


def parent_key(
    df: DataFrame, parent: str, is_reference: Column, seq: str, shortest: bool = True
) -> DataFrame:
    """Add ``cluster_key_seq``: the parent's reference sequence, else a fixed member of its family.

    The fallback is the shortest sequence (ties alphabetical), or the alphabetically first one.
    """
    order = F.struct(F.length(seq).alias("n"), F.col(seq).alias("s")) if shortest else F.struct(
        F.col(seq).alias("s")
    )
    keys = df.groupBy(parent).agg(
        F.min(F.when(is_reference, F.col(seq))).alias("_reference"),
        F.min(order)["s"].alias("_fallback"),
    )
    return (
        df.join(keys, parent, "left")
        .withColumn("cluster_key_seq", F.coalesce("_reference", "_fallback", F.col(seq)))
        .drop("_reference", "_fallback")
    )


def unique_ids(df: DataFrame, id_col: str, *order: str) -> DataFrame:
    """Append ``#n`` to ids that occur more than once; ``order`` (unique) fixes which row is which.

    Rows of repeated ids are numbered in buckets of their order, so no task has to hold a hot id; the
    others, and rows without an id, pass through.
    """
    repeated = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_size")).where("_size > 1")
    sized = df.join(repeated, id_col, "left")
    numbered = sized.where(F.col("_size").isNotNull()).withColumns({"_key": F.struct(*order), "_one": F.lit(1)})
    numbered = running(numbered, [id_col], "_key", ["_one"])
    own = F.col(id_col).cast("string")
    fixed = F.concat_ws("#", own, (F.col("cum__one") - 1).cast("string"))
    alone = sized.where(F.col("_size").isNull())
    as_id = lambda value: [value.alias(c) if c == id_col else F.col(c) for c in df.columns]
    return alone.select(*as_id(own)).unionByName(numbered.select(*as_id(fixed)))


# ---------------------------------------------------------------- unification


def normalise(df: DataFrame) -> DataFrame:
    """The fixed record columns in one order, extra columns filled with their defaults."""
    if "cluster_key_seq" not in df.columns:
        df = df.withColumn("cluster_key_seq", F.col("sequence"))
    if "exclusion_reason" not in df.columns:
        df = df.withColumn("exclusion_reason", F.lit(""))
    if "evidence_tier" not in df.columns:
        df = df.withColumn("evidence_tier", L.default_tier())
    types = {c: "int" for c in [*LABELS, "seq_len", "year"]} | {"is_designed": "boolean"}
    return df.select(
        *[F.col(c).cast(types.get(c, "string")).alias(c) for c in RECORD_COLUMNS + EXTRA_COLUMNS]
    )


def demote_duplicates(
    df: DataFrame, weak: str, strong: str, key: str, label: str
) -> DataFrame:
    """Rows of the weak source whose key the strong source also has lose one label, not the row.

    Keys are whole sequences, so their SHA-256 is joined on.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    known = (
        df.where(F.col("source") == strong)
        .select(digest.alias("_k"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    is_weak = F.col("source") == weak
    joined = df.join(known, is_weak & (digest == F.col("_k")), "left")
    return joined.withColumn(
        label, F.when(F.col("_known"), UNOBSERVED).otherwise(F.col(label))
    ).drop("_k", "_known")


def unify(
    sources: list[DataFrame],
    weak: str | None = None,
    strong: str | None = None,
    demoted: str = "label_bind",
) -> DataFrame:
    """Pool sources into one record table with the derived label, checked years and dedup keys."""
    pooled = reduce(DataFrame.unionByName, [drop_excluded(normalise(s)) for s in sources])
    if weak and strong:
        pooled = demote_duplicates(pooled, weak, strong, "sequence", demoted)
    return pooled.withColumns(
        {
            "label_soluble_expression": L.composite_label(
                F.col("label_express"), F.col("label_soluble")
            ),
            "year": L.year_or_unknown(F.col("year")),
            "cluster_key_seq": F.coalesce(F.nullif("cluster_key_seq", F.lit("")), F.col("sequence")),
        }
    )


def label_counts(df: DataFrame, stages: list[str] = STAGES, by: list[str] | None = None) -> DataFrame:
    """Success, failure and unobserved counts per stage."""
    by = by or []
    sums = [
        F.sum(F.when(F.col(f"label_{s}") == v, 1).otherwise(0)).alias(f"{name}_{s}")
        for s in stages
        for name, v in (("success", 1), ("fail", 0), ("unobserved", -1))
    ]
    wide = df.groupBy(*by).agg(*sums)
    stack = ", ".join(f"'{s}', success_{s}, fail_{s}, unobserved_{s}" for s in stages)
    return wide.selectExpr(
        *by, f"stack({len(stages)}, {stack}) as (stage, success, fail, unobserved)"
    )
