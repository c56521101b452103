"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after every run of ``[\\x20\\x09-\\x0D]`` became one space.
Three stages, each keyed by the digest *and the whole normalised text*:

1. local: the partial aggregation of every map task keeps one row per text it saw;
2. salted: those rows meet per (digest, salt), so no group of copies lands in one task;
3. global: the winners of the salts, at most ``salts`` per text, meet per digest.

Every document then looks up its winner by digest. Winners of groups with more than
1/``HOT_SHARES`` of all rows are fewer than ``HOT_SHARES``, and only those are broadcast; all other
digests are joined by a shuffle of narrow rows. Digests that two different texts share are found
exactly and joined on the text itself.

Null text counts as empty. A null id sorts behind all others. Of rows that repeat id and text one
stays. Other columns pass through ``deduplicate`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tristage.session import cut

HOT_SHARES = 1000
# A run that is not already one plain space.
_RUN = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUN, " ")


def winners(keyed: DataFrame, salts: int) -> DataFrame:
    """(digest, norm, keep_id, group_size) from (id, digest, norm)."""
    salted = (
        keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "norm", "salt")
        .agg(F.min("id").alias("id"), F.count("*").alias("n"))
    )
    return salted.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 added (their own such columns are replaced)."""
    added = ("keep_id", "group_size", "kept", "text_sha256")
    own = [c for c in docs.columns if c not in added]
    id_type = docs.schema[id_col].dataType
    norm = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(norm, 256).alias("digest"), norm.alias("norm"))
    found = winners(keyed, salts)
    best = cut(
        found.groupBy("digest").agg(
            F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts")
        )
    )
    total = best.agg(F.sum("group_size")).first()[0] or 0
    sized = best.where("texts = 1")
    hot = sized.where(F.col("group_size") * HOT_SHARES > total)
    hot = hot.select(F.col("digest").alias("hot"), F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_n"))
    cold = sized.where(F.col("group_size") * HOT_SHARES <= total)
    cold = cold.select(F.col("digest").alias("key"), F.col("keep_id").alias("cold_id"), F.col("group_size").alias("cold_n"))

    # The documents' own columns travel as one struct, so their names meet none of those used here.
    rows = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("id"), F.sha2(norm, 256).alias("digest"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    own_key = F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", F.when(F.col("hot").isNotNull(), own_key).otherwise(F.col("digest")))
    rows = rows.join(cold, "key", "left")
    shared = best.where("texts > 1").select("digest")
    if shared.limit(1).count():
        # Digests that several texts have: these are told apart by the texts themselves.
        exact = found.join(shared, "digest", "left_semi").select(
            F.col("digest").alias("x"), F.col("norm").alias("x_text"), F.col("keep_id").alias("x_id"), F.col("group_size").alias("x_n")
        )
        same = (F.col("digest") == F.col("x")) & (normalised(F.col(f"row.{text_col}")) == F.col("x_text"))
        rows = rows.join(exact, same, "left")
    else:
        nothing = F.lit(None)
        rows = rows.withColumns({"x_id": nothing.cast(id_type), "x_n": nothing.cast("bigint"), "x_text": nothing.cast("string")})
    keep = F.when(F.col("hot_n").isNotNull(), F.col("hot_id")).when(F.col("cold_n").isNotNull(), F.col("cold_id")).otherwise(F.col("x_id"))
    rows = rows.withColumns({"keep_id": keep, "group_size": F.coalesce("hot_n", "cold_n", "x_n")})
    # Rows that repeat the winner's id and text: one of them stays. The join is dealt by key already.
    turn = F.row_number().over(Window.partitionBy("key", "id", "digest", "x_text").orderBy("keep_id"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (turn == 1)
    return rows.withColumn("kept", kept).select(
        *[F.col("row").getField(c).alias(c) for c in own], "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    return duplicate_groups(docs, id_col, text_col).where("kept").select(*docs.columns)
