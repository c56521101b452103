"""Small numeric functions Spark has no built-in for."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def log_choose(n: Column, k: Column) -> Column:
    """ln C(n, k) as a sum of k logarithms; k is a small bounded budget."""
    k = k.cast("int")
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps, F.lit(0.0), lambda acc, j: acc + F.ln((n - k + j).cast("double") / j)
    )


def hypergeometric_cdf(x: Column, population: Column, positives: Column, draws: int) -> Column:
    """P(at most x positives in ``draws`` random picks without replacement)."""
    lo = F.greatest(F.lit(0), F.lit(draws) - (population - positives)).cast("int")
    total = log_choose(population, F.lit(draws))
    hits = F.when(x >= lo, F.sequence(lo, x.cast("int"))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(hits, lambda i: i <= positives)
    return F.aggregate(
        hits,
        F.lit(0.0),
        lambda acc, i: acc
        + F.exp(
            log_choose(positives, i) + log_choose(population - positives, F.lit(draws) - i) - total
        ),
    )


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value: power series near zero, continued fraction in the tail."""
    x = F.abs(z) / math.sqrt(2.0)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, n: F.struct(
            (-acc["term"] * x * x / n).alias("term"),
            (acc["total"] - acc["term"] * x * x / n / (2 * n + 1)).alias("total"),
        ),
        lambda acc: F.lit(1.0) - acc["total"] * (2.0 / math.sqrt(math.pi)),
    )
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)),
        x,
        lambda acc, n: x + (n / 2.0) / acc,
        lambda acc: F.exp(-x * x) / (acc * math.sqrt(math.pi)),
    )
    return F.when(x < 2.5, series).otherwise(fraction)
