"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tristage.session import cut


def _table(least: DataFrame) -> DataFrame:
    """Minima as a table: the joins with them are between plain shuffles then, which the adaptive
    skew join can split at a hub; over an aggregate it cannot."""
    return cut(least)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _table(down.groupBy("u").agg(F.min("v").alias("m")))
    side = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes that keep the edges from being stars: with two links down, or links down and up."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")),
                F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")),
            )
        ).alias("e")
    ).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or (down > 0 and up > 0)").count()


def connected_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(key, comp) for every node; ``edges`` is (a, b), the component id its smallest key.

    Minima are pre-aggregated and joins are plain equi-joins, so a node with very many neighbours
    is split by the skew join instead of being collected. Every round is written out, which cuts
    the lineage and survives lost executors.
    """
    e = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)))
        if _unsettled(e) == 0:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    label = e.select(F.col("u").alias("key"), F.col("v").alias("comp"))
    return nodes.select("key").join(label, "key", "left").select(
        "key", F.coalesce("comp", "key").alias("comp")
    )


def component_stats(comp: DataFrame, unit: str = "key") -> DataFrame:
    sizes = comp.select("comp", unit).distinct().groupBy("comp").agg(F.count("*").alias("k"))
    return sizes.agg(
        F.sum("k").alias("n_units"),
        F.count("*").alias("n_groups"),
        F.max("k").alias("largest"),
        F.count_if(F.col("k") == 1).alias("singletons"),
    )
