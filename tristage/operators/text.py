"""Text operators that are more than a column: pattern totals, scans and number checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tristage.functions import text as T


def strip_report(
    df: DataFrame, col: str, patterns: list[tuple[str, str]] = T.CONSTRUCT_PATTERNS, min_len: int = 20
) -> DataFrame:
    """Hits per pattern and rows each pattern touched, in pattern order."""
    hits = T.pattern_hits(F.col(col), patterns)
    counted = df.select(*[c.alias(f"h{i}") for i, (_, c) in enumerate(hits)])
    wide = counted.agg(
        *[F.sum(f"h{i}").cast("long").alias(f"n{i}") for i in range(len(hits))],
        *[F.count_if(F.col(f"h{i}") > 0).alias(f"r{i}") for i in range(len(hits))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"), F.lit(name).alias("pattern"),
                F.col(f"n{i}").alias("hits"), F.col(f"r{i}").alias("rows_hit"),
            )
            for i, (name, _) in enumerate(hits)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*").where("hits > 0")


def scan_patterns(
    df: DataFrame, key: str, col: str, needles: list[str] | None
) -> DataFrame:
    """Documents that contain a private address, host or needle: number of hits and first hit."""
    pattern = T.scan_alternation(needles)
    found = F.regexp_extract_all(F.col(col), F.lit(f"({pattern})"), F.lit(1))
    return df.where(F.col(col).rlike(pattern)).select(
        key, F.size(found).alias("n_hits"), F.get(found, F.lit(0)).alias("first_hit")
    )


def number_set_diff(
    left: DataFrame, right: DataFrame, on: list[str], col: str, heading: str | None = None
) -> DataFrame:
    """Numbers that occur in only one of two versions of a text, after an optional heading."""
    def numbers(df, side):
        body = T.body_after(F.col(col), heading) if heading else F.col(col)
        exploded = df.select(*on, F.explode(T.numbers_of(body)).alias("number")).distinct()
        return exploded.withColumn(side, F.lit(True))

    both = numbers(left, "_l").join(numbers(right, "_r"), [*on, "number"], "full")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        *on, "number", F.when(F.col("_r").isNull(), "left").otherwise("right").alias("only_in")
    )
