"""Tri-state label algebra on columns: 1 success, 0 failure, -1 unobserved, never NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tristage.schema import FAIL, STAGE_INDEX, STAGES, SUCCESS, UNOBSERVED

N = len(STAGES)


def stage_index(col: Column, rules: dict[str, str | None]) -> Column:
    """Index of the stage a status maps to; NULL when unmapped or mapped to nothing."""
    pairs = [
        F.lit(x)
        for status, stage in rules.items()
        if stage in STAGE_INDEX
        for x in (status, STAGE_INDEX[stage])
    ]
    return F.try_element_at(F.create_map(*pairs), col)


def make_label(
    reached: Column, failed: Column, extra: dict[str, Column | int] | None = None
) -> Column:
    """Stage vector from the furthest success and the failed stage (indices, NULL = none).

    NULL marks a contradiction (failure not later than the success); ``violations`` finds it.
    """
    r = F.coalesce(reached.cast("int"), F.lit(-1))
    f = F.coalesce(failed.cast("int"), F.lit(N))
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(N - 1)),
        lambda i: F.when(i <= r, SUCCESS).when(i == f, FAIL).otherwise(UNOBSERVED),
    )
    vector = F.when(f > r, vector)
    for stage, value in (extra or {}).items():
        vector = _replace(vector, STAGE_INDEX[stage], value)
    return vector


def _replace(vector: Column, at: int, value: Column | int) -> Column:
    return F.transform(vector, lambda x, i: F.when(i == at, value).otherwise(x))


def is_valid(label: Column) -> Column:
    """Six known values and nothing observed after the first failure."""
    first_fail = F.array_position(label, FAIL)
    after = F.slice(label, (first_fail + 1).cast("int"), F.lit(N))
    return F.coalesce(
        (F.size(label) == N)
        & F.forall(label, lambda x: x.isin(SUCCESS, FAIL, UNOBSERVED))
        & ((first_fail == 0) | F.forall(after, lambda x: x == UNOBSERVED)),
        F.lit(False),
    )


def fill_success_prefix(label: Column) -> Column:
    """Unobserved stages before the last success become successes; failures are never invented."""
    last = F.array_max(
        F.transform(label, lambda x, i: F.when(x == SUCCESS, i).otherwise(F.lit(-1)))
    )
    return F.transform(
        label, lambda x, i: F.when((x == UNOBSERVED) & (i < last), SUCCESS).otherwise(x)
    )


def as_columns(label: Column) -> list[Column]:
    return [label[i].cast("int").alias(f"label_{s}") for i, s in enumerate(STAGES)]


def as_array(stages: list[str] = STAGES) -> Column:
    return F.array(*[F.col(f"label_{s}").cast("int") for s in stages])


def composite_label(first: Column, second: Column) -> Column:
    """Success only if both succeed; a failure of either (second given first) is a failure."""
    return (
        F.when((first == SUCCESS) & (second == SUCCESS), SUCCESS)
        .when(first == FAIL, FAIL)
        .when((first == SUCCESS) & (second == FAIL), FAIL)
        .otherwise(UNOBSERVED)
    )


def any_failed(stages: list[str] = STAGES) -> Column:
    return F.greatest(*[(F.col(f"label_{s}") == FAIL) for s in stages])


def confident_sign(lo: Column, hi: Column) -> Column:
    """Label of an interval: entirely below 0 fails, entirely above succeeds, else unobserved."""
    return F.when(hi < 0, FAIL).when(lo > 0, SUCCESS).otherwise(UNOBSERVED)


def default_tier(stages: list[str] = STAGES) -> Column:
    return F.when(any_failed(stages), "explicit").otherwise("none")


def one_stage(stage: Column, value: Column) -> list[Column]:
    """Six label columns where only the row's own stage carries the value."""
    return [
        F.when(stage == s, value).otherwise(UNOBSERVED).cast("int").alias(f"label_{s}")
        for s in STAGES
    ]


def replicate_label(any_expressed: Column, any_bound: Column, any_unbound: Column) -> Column:
    """Construct made; expressed or not; binding known only for what was expressed."""
    unobserved = F.lit(UNOBSERVED)
    express = F.when(any_expressed, SUCCESS).otherwise(FAIL)
    bind = (
        F.when(~any_expressed, UNOBSERVED)
        .when(any_bound, SUCCESS)
        .when(any_unbound, FAIL)
        .otherwise(UNOBSERVED)
    )
    return F.array(F.lit(SUCCESS), express, unobserved, unobserved, unobserved, bind)


def year_or_unknown(year: Column, lo: int = 1999, hi: int = 2026) -> Column:
    """Years outside the inclusive range are recording errors: -1."""
    return F.when(year.between(lo, hi), year).otherwise(-1).cast("int")


def year_of_record(dates: Column, created: Column) -> Column:
    """Year of the latest usable date, else of the creation date, else -1."""
    dated = F.filter(dates, lambda d: d.rlike(r"^\d{4}"))
    return F.coalesce(
        F.substring(F.array_max(dated), 1, 4).try_cast("int"),
        F.when(created.rlike(r"^\d{4}"), F.substring(created, 1, 4).try_cast("int")),
        F.lit(-1),
    )


def first_year(dates: Column) -> Column:
    dated = F.filter(dates, lambda d: d.rlike(r"^\d{4}"))
    return F.coalesce(F.substring(F.array_min(dated), 1, 4).try_cast("int"), F.lit(-1))
