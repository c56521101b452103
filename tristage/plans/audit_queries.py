"""Checks that guard a run: domains, matches, stamps, the run log and output namespaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.operators import labels as L
from tristage.operators.labels import InvalidData
from tristage.plans.registry import query
from tristage.session import scratch_path
from tristage.sources import provenance as V
from tristage.sources import sinks as K

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


@query(
    "col:s value:s n:i rejected:b",
    f"""SELECT 'o_orderpriority' AS col, o_orderpriority AS value, count(*) AS n, true AS rejected FROM orders
      WHERE o_orderpriority NOT IN ({', '.join(f"'{p}'" for p in _PRIORITIES)}) GROUP BY 2
    UNION ALL SELECT 'o_orderstatus', NULL, 0, count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) > 0 FROM orders""",
)
def domain_check(t):
    """Values outside a column's domain, and whether the raising form rejects the column."""
    orders = t("orders")

    def rejected(col, allowed):
        try:
            L.require_domain(orders, col, allowed)
        except InvalidData:
            return True
        return False

    unknown = L.unknown_values(orders, "o_orderpriority", _PRIORITIES).select(
        F.lit("o_orderpriority").alias("col"), F.col("o_orderpriority").alias("value"), "n",
        F.lit(rejected("o_orderpriority", _PRIORITIES)).alias("rejected"),
    )
    good = [("o_orderstatus", None, 0, rejected("o_orderstatus", ["F", "O", "P"]))]
    return unknown.unionByName(t.spark.createDataFrame(good, "col string, value string, n bigint, rejected boolean"))


@query(
    "nation:i n_orders:i total:d",
    """SELECT c_nationkey AS nation, count(*) AS n_orders, sum(o_totalprice) AS total
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def backfilled_nation(t):
    """A column filled in by id; an order without its customer would be an error."""
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    filled = L.require_matched(orders, t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return filled.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total")
    )


_LABELLED = "SELECT DISTINCT doc_id FROM labels"


@query(
    "clustering:s n_matched:i n_unmatched:i accepted:b",
    f"""SELECT c AS clustering, sum(hit::INT) AS n_matched, sum((NOT hit)::INT) AS n_unmatched, bool_and(hit) AS accepted FROM (
      SELECT 'sequence' AS c, true AS hit FROM documents
      UNION ALL SELECT 'structure', doc_id IN ({_LABELLED}) FROM documents) GROUP BY c""",
)
def both_clusterings(t):
    """Records joined with two clusterings: all have the first, some lack the second, which is refused."""
    docs = t("documents").select("doc_id")
    sequence = docs.withColumn("cluster", F.floor(F.col("doc_id") / 7))
    structure = t("labels").select("doc_id", F.col("quality").alias("structure")).dropDuplicates(["doc_id"])
    joined = L.require_matched(docs, sequence, "doc_id")

    def accepted(other):
        try:
            L.require_matched(joined, other, "doc_id")
        except InvalidData:
            return False
        return True

    total = joined.agg(F.count("*").alias("n"))
    rows = []
    for name, other in (("sequence", sequence), ("structure", structure)):
        missing = L.unmatched(joined, other, "doc_id").agg(F.count("*").alias("m"))
        rows.append(
            total.join(F.broadcast(missing)).select(
                F.lit(name).alias("clustering"), (F.col("n") - F.col("m")).alias("n_matched"),
                F.col("m").alias("n_unmatched"), F.lit(accepted(other)).alias("accepted"),
            )
        )
    return rows[0].unionByName(rows[1])


@query(
    "step:s n_rows:i problems:i",
    """SELECT step, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_rows, problems FROM
      (VALUES ('unstamped', 1), ('stamped', 0), ('input changed', 1), ('artifact changed too', 2)) AS s(step, problems)""",
)
def freshness_gate(t):
    """An artifact before its stamp, after it, and after changes of its input and of itself."""
    spark, orders = t.spark, t("orders")
    source, artifact, store = (scratch_path(spark, n) for n in ("input", "artifact", "stamps"))
    orders.write.parquet(source)
    finished = spark.read.parquet(source).where("o_orderstatus = 'F'")
    finished.write.parquet(artifact)
    n_rows = spark.read.parquet(artifact).count()
    steps = []

    def look(step):
        try:
            V.require(spark, store, [artifact])
            problems = 0
        except V.StaleArtifact as stale:
            problems = len(str(stale).split("; "))
        steps.append((step, n_rows, problems))

    look("unstamped")
    V.stamp(spark, store, artifact, [source], "freshness_gate")
    look("stamped")
    orders.limit(1).write.mode("append").parquet(source)
    look("input changed")
    orders.limit(1).write.mode("append").parquet(artifact)
    look("artifact changed too")
    return spark.createDataFrame(steps, "step string, n_rows bigint, problems bigint")


@query(
    "run_name:s seed:i sources:s contains_restricted:b splits_used:s results:s same_split:b",
    """SELECT run_name, seed, sources, contains_restricted, 'test,train' AS splits_used,
      '{"rows": ' || (SELECT count(*) FROM lineitem) || '}' AS results, true AS same_split FROM
      (VALUES ('first', 1, 'open', false), ('second', 2, 'closed,open', true)) AS r(run_name, seed, sources, contains_restricted)""",
)
def run_log(t):
    """Two runs on the same splits, logged and read back."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    test = F.col("l_orderkey") % 5 == 0
    splits = {"train": lines.where(~test), "test": lines.where(test)}
    path = scratch_path(t.spark, "runs")
    results = {"rows": lines.count()}
    K.append_run(t.spark, path, "first", ["open"], splits, {"k": 10}, 1, results, restricted="closed")
    K.append_run(t.spark, path, "second", ["open", "closed"], splits, {"k": 10}, 2, results, restricted="closed")
    log = t.spark.read.schema(K.RUN_SCHEMA).parquet(path)
    hashes = log.select(F.map_values("split_hashes").alias("h")).distinct().agg((F.count("*") == 1).alias("same_split"))
    return log.join(F.broadcast(hashes)).select(
        "run_name", "seed", F.array_join("sources", ",").alias("sources"), "contains_restricted",
        F.array_join("splits_used", ",").alias("splits_used"), "results", "same_split",
    )


@query(
    "variant:s strip_tags:b use_length:b source:s n:i",
    """SELECT v.*, source, count(*) AS n FROM documents,
      (VALUES ('default', true, true), ('ablation_keeptags_nolength', false, false)) AS v(variant, strip_tags, use_length)
    GROUP BY ALL""",
)
def variant_namespaces(t):
    """Results of two preprocessing variants, written side by side and read back."""
    counts = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    path = scratch_path(t.spark, "variants")
    for args in ((True, True, True), (False, False, False)):
        K.merge_write(K.variant(counts, *args), path, ["variant", "strip_tags", "use_length"])
    return t.spark.read.parquet(path)
