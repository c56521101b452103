"""Roles of the test tables: which columns act as record, batch, group, label, score and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tristage.functions import labels as L

# The history vocabulary the event types stand for.
EVENT_STATUS = {"signup": "cloned", "click": "expressed", "view": "soluble"}
STOPS = [
    "expression failed", "cloning failed", "purification failed",
    "membrane protein solubilization failed", "PDB duplicate found", "other",
]


class Tables:
    """The tables below one scale-factor folder, raw (``t("orders")``) and by role."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def docs(self) -> DataFrame:
        """Texts as records with two observed or unobserved stages."""
        joined = self("documents").join(self("labels"), "doc_id", "left")
        return joined.select(
            F.col("doc_id").alias("id"), "text", F.col("source").alias("center"),
            F.col("lang").alias("organism"), F.col("n_chars").alias("seq_len"),
            F.coalesce("quality", F.lit(-1)).alias("label_express"),
            F.when(F.col("quality") == 1, 1 - F.col("toxic")).otherwise(-1).alias("label_soluble"),
            F.floor(F.col("doc_id") / 4).alias("grp"),
        )

    def lines(self) -> DataFrame:
        """Order lines as records with a full six-stage outcome, batched by supplier nation."""
        nation = self("nation").select("n_nationkey", F.col("n_name").alias("center"))
        supplier = self("supplier").select("s_suppkey", "s_nationkey")
        line = self("lineitem")
        reached = (
            F.when(F.col("l_quantity") <= 3, -1).when(F.col("l_linestatus") == "O", 1).otherwise(3)
        )
        returned = F.col("l_returnflag") == "R"
        out = line.select(
            F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"),
            F.col("l_partkey").alias("unit"),
            F.year("l_shipdate").alias("year"),
            (F.col("l_discount") >= 0.05).alias("exposed"),
            F.col("l_quantity").cast("long").alias("seq_len"),
            F.col("l_extendedprice").alias("price"),
            returned.cast("int").alias("y"),
            reached.alias("reached"),
            F.when(returned, reached + 1).alias("failed"),
            F.when(returned & (F.col("l_tax") < 0.035), "explicit")
            .when(returned, "inferred_next_step").otherwise("none").alias("tier"),
        ).withColumn("label", L.make_label(F.col("reached"), F.col("failed")))
        out = out.select("*", *L.as_columns(F.col("label"))).drop("label")
        return (
            out.join(supplier, out.l_suppkey == supplier.s_suppkey)
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .drop("s_suppkey", "s_nationkey", "n_nationkey")
        )

    def orders(self) -> DataFrame:
        """Orders as records grouped by customer, batched by customer nation."""
        nation = self("nation").select("n_nationkey", F.col("n_name").alias("center"))
        customer = self("customer").select("c_custkey", "c_nationkey")
        status, price = F.col("o_orderstatus"), F.col("o_totalprice")
        express = F.when(status == "F", 0).when(status == "O", 1).otherwise(-1)
        soluble = F.when(status != "O", -1).when(price > 100000, 1).otherwise(0)
        return (
            self("orders")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), "center",
                F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("target"),
                F.col("o_totalprice").alias("price"),
                express.alias("label_express"), soluble.alias("label_soluble"),
            )
        )

    def history(self) -> DataFrame:
        """Events as status steps of trials (one trial per user and day)."""
        k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
        status = (
            F.when(F.col("event_type") == "purchase", F.when(k >= 90, "in PDB").otherwise("purified"))
            .when(F.col("event_type") == "error", F.when(k == 7, "test target").otherwise("work stopped"))
        )
        for event, name in EVENT_STATUS.items():
            status = status.when(F.col("event_type") == event, name)
        slot = F.floor("value") % 8
        stop = F.lit("")
        for i, name in enumerate(STOPS):
            stop = F.when(slot == i, name).otherwise(stop)
        return self("events").select(
            F.col("user_id").alias("target"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
            "ts", "event_id", status.alias("status"), stop.alias("stop_status"), "value", "event_type",
        )

    def trials(self, rules: dict[str, str | None]) -> DataFrame:
        """One row per trial: furthest stage, current status and stop status (its last step)."""
        last = F.max_by(F.struct("status", "stop_status"), F.struct("ts", "event_id"))
        return (
            self.history().groupBy("target", "day")
            .agg(
                F.coalesce(F.max(L.stage_index(F.col("status"), rules)), F.lit(-1)).alias("reached"),
                F.count("*").alias("n_steps"), last.alias("last"),
            )
            .select("target", "day", "reached", "n_steps", "last.status", "last.stop_status")
        )

    def doc_scores(self) -> DataFrame:
        """Labelled texts ranked by length (many ties); the positive class is low quality."""
        return self("labels").join(self("documents"), "doc_id").select(
            F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("int").alias("y"),
            F.col("n_chars").cast("double").alias("score"), F.col("source").alias("center"),
            F.col("lang").alias("organism"), F.floor(F.col("doc_id") / 4).alias("grp"),
            F.col("toxic"),
        )

    def line_scores(self) -> DataFrame:
        """All order lines ranked by price; the positive class is a return."""
        return self.lines().select(
            F.concat_ws(":", "l_orderkey", "l_linenumber", "unit", "l_suppkey", "price").alias("id"),
            "y", F.col("price").alias("score"), "center", "year", "l_orderkey",
        )

    def vector_scores(self) -> DataFrame:
        """Vectors with two coordinates as scores, 15 targets, and a binary class."""
        return self("embeddings").select(
            F.col("vec_id").alias("id"), (F.col("label") < 3).cast("int").alias("y"),
            F.col("embedding")[0].cast("double").alias("s0"),
            F.col("embedding")[1].cast("double").alias("s1"),
            F.col("embedding")[2].cast("double").alias("s2"),
            (F.col("vec_id") % 15).alias("target"), F.col("label").alias("class"),
        )


# ---------------------------------------------------------------- the same roles in SQL

DOCS_SQL = """docs AS (
  SELECT d.doc_id AS id, d.text, d.source AS center, d.lang AS organism, d.n_chars AS seq_len,
    coalesce(l.quality, -1) AS label_express, CASE WHEN l.quality = 1 THEN 1 - l.toxic ELSE -1 END AS label_soluble,
    d.doc_id // 4 AS grp
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

_STAGES = ["clone", "express", "soluble", "purify", "stable", "bind"]
LINES_SQL = (
    """lines0 AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS unit, year(l_shipdate) AS year,
    l_discount >= 0.05 AS exposed, l_quantity::BIGINT AS seq_len, l_extendedprice AS price,
    (l_returnflag = 'R')::INT AS y, n_name AS center,
    CASE WHEN l_quantity <= 3 THEN -1 WHEN l_linestatus = 'O' THEN 1 ELSE 3 END AS reached,
    CASE WHEN l_returnflag = 'R' AND l_tax < 0.035 THEN 'explicit'
         WHEN l_returnflag = 'R' THEN 'inferred_next_step' ELSE 'none' END AS tier
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
lines AS (SELECT *, """
    + ", ".join(
        f"CASE WHEN {i} <= reached THEN 1 WHEN y = 1 AND {i} = reached + 1 THEN 0 ELSE -1 END"
        f" AS label_{s}"
        for i, s in enumerate(_STAGES)
    )
    + " FROM lines0)"
)

ORDERS_SQL = """ords AS (
  SELECT o_orderkey AS id, o_custkey AS grp, n_name AS center, year(o_orderdate) AS year,
    o_orderpriority AS target, o_totalprice AS price,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS label_express,
    CASE WHEN o_orderstatus <> 'O' THEN -1 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS label_soluble
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

HISTORY_SQL = (
    """hist AS (
  SELECT user_id AS target, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, event_type, value,
    CASE event_type WHEN 'signup' THEN 'cloned' WHEN 'click' THEN 'expressed' WHEN 'view' THEN 'soluble'
      WHEN 'purchase' THEN CASE WHEN k >= 90 THEN 'in PDB' ELSE 'purified' END
      ELSE CASE WHEN k = 7 THEN 'test target' ELSE 'work stopped' END END AS status,
    CASE floor(value)::BIGINT % 8 """
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STOPS))
    + """ ELSE '' END AS stop_status
  FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events))"""
)

# Furthest stage per trial; {stable} is what a solved structure proves (4 stable, 3 purify).
TRIALS_SQL = (
    "WITH "
    + HISTORY_SQL
    + """, steps AS (
  SELECT *, CASE status WHEN 'cloned' THEN 0 WHEN 'expressed' THEN 1 WHEN 'soluble' THEN 2
      WHEN 'purified' THEN 3 WHEN 'in PDB' THEN {stable} ELSE -1 END AS stage,
    row_number() OVER (PARTITION BY target, day ORDER BY ts DESC, event_id DESC) AS rn
  FROM hist),
trials AS (
  SELECT target, day, max(stage) AS reached, count(*) AS n_steps,
    max(CASE WHEN rn = 1 THEN status END) AS status,
    max(CASE WHEN rn = 1 THEN stop_status END) AS stop_status
  FROM steps GROUP BY target, day)"""
)

DOC_SCORES_SQL = """sc AS (
  SELECT l.doc_id AS id, (quality = 0)::INT AS y, n_chars::DOUBLE AS score, source AS center,
    lang AS organism, l.doc_id // 4 AS grp, toxic
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""

LINE_SCORES_SQL = (
    LINES_SQL
    + """, sc AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, unit, l_suppkey, price) AS id, y, price AS score,
    center, year, l_orderkey FROM lines)"""
)

VECTOR_SCORES_SQL = """vec AS (
  SELECT vec_id AS id, (label < 3)::INT AS y, embedding[1]::DOUBLE AS s0, embedding[2]::DOUBLE AS s1,
    embedding[3]::DOUBLE AS s2, vec_id % 15 AS target, label AS class FROM embeddings)"""
