"""Group-safe splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions.hashing import keyed, modulo
from tristage.operators import splits as P
from tristage.plans.bindings import DOCS_SQL, LINES_SQL, ORDERS_SQL
from tristage.plans.registry import query
from tristage.sources.sinks import manifest

SEED = 20260930


def _h(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"('0x' || substr(sha256({text}), 1, 16))::UBIGINT"


def _side(expr: str) -> str:
    return f"CASE WHEN {expr} < 0.8 THEN 'train' WHEN {expr} < 0.9 THEN 'val' ELSE 'test' END"


@query(
    "id:i grp:i",
    f"""WITH {ORDERS_SQL} SELECT id, grp FROM (SELECT id, grp, row_number() OVER
      (PARTITION BY grp ORDER BY sha256(id || ':{SEED}'), id) AS rn FROM ords) WHERE rn = 1""",
)
def group_representatives(t):
    return P.representative(t.orders(), ["grp"], "id", SEED)


@query(
    "rep:i member:i",
    """SELECT member, rep FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY (rep = member)::INT, rep) AS rn
      FROM (SELECT o_orderkey AS member, o_orderkey AS rep FROM orders UNION ALL
            SELECT o_orderkey, o_orderkey // 7 FROM orders WHERE o_orderstatus = 'F')) WHERE rn = 1""",
)
def repaired_membership(t):
    """A cluster list where some members also occur as their own representative."""
    o = t("orders")
    own = o.select(F.col("o_orderkey").alias("rep"), F.col("o_orderkey").alias("member"))
    other = o.where("o_orderstatus = 'F'").select(
        F.floor(F.col("o_orderkey") / 7).alias("rep"), F.col("o_orderkey").alias("member")
    )
    return P.repair_membership(own.unionByName(other), "rep", "member")


@query(
    "id:i seq_uid:i",
    "SELECT doc_id AS id, dense_rank() OVER (ORDER BY text) - 1 AS seq_uid FROM documents",
)
def sequence_ids(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    return P.surrogate_ids(docs, "text")


@query(
    "id:i grp:i split:s",
    f"WITH {ORDERS_SQL} SELECT id, grp, {_side(_h(repr(str(SEED)), 'grp') + ' / 18446744073709551616.0')} AS split FROM ords",
)
def hashed_split(t):
    return P.hash_split(t.orders(), "grp", SEED)


@query(
    "grp:i split:s n:i",
    f"""WITH {LINES_SQL}, u AS (SELECT l_suppkey AS grp, count(DISTINCT unit) AS k, count(*) AS n FROM lines GROUP BY 1)
    SELECT grp, CASE WHEN k > 0.32 * (SELECT count(DISTINCT unit) FROM lines) THEN 'train'
      ELSE {_side(_h(repr(str(SEED)), 'grp') + ' / 18446744073709551616.0')} END AS split, n FROM u""",
)
def hashed_split_pinned(t):
    lines = t.lines().withColumnRenamed("l_suppkey", "grp")
    out = P.hash_split(lines, "grp", SEED, pin_above=0.32, unit="unit")
    return out.groupBy("grp", "split").agg(F.count("*").alias("n"))


def _group_sql(table: str, test: str, where: str = "true") -> str:
    return f"""WITH {table}, f AS (SELECT * FROM ords WHERE {where}),
    g AS (SELECT grp, bool_or({test}) AS te, bool_or(NOT ({test})) AS tr FROM f GROUP BY grp)
    SELECT id, f.grp, CASE WHEN te AND tr THEN 'dropped' WHEN te THEN 'test' ELSE 'train' END AS split
    FROM f JOIN g ON f.grp = g.grp"""


@query("id:i grp:i split:s", _group_sql(ORDERS_SQL, "center IN ('NATION_3', 'NATION_7')"))
def batch_holdout(t):
    return P.group_split(t.orders(), F.col("center").isin("NATION_3", "NATION_7"), "grp")


@query("id:i grp:i split:s", _group_sql(ORDERS_SQL, "year >= 2001"))
def time_holdout(t):
    return P.group_split(t.orders(), F.col("year") >= 2001, "grp")


@query("id:i grp:i split:s", _group_sql(ORDERS_SQL, "target IN ('1-URGENT')", "label_express <> -1"))
def target_holdout(t):
    """Held-out targets among the rows with an observed label."""
    observed = t.orders().where("label_express <> -1")
    return P.group_split(observed, F.col("target").isin("1-URGENT"), "grp")


@query(
    "id:i grp:i split:s",
    f"""WITH {ORDERS_SQL}, f AS (SELECT id, year, CASE WHEN year < 2001 OR target <> '5-LOW' THEN grp END AS grp FROM ords),
    g AS (SELECT grp, bool_or(year >= 2001) AS te, bool_or(year < 2001) AS tr FROM f GROUP BY grp)
    SELECT id, f.grp, CASE WHEN te AND tr THEN 'dropped' WHEN te THEN 'test' ELSE 'train' END AS split
    FROM f JOIN g ON f.grp IS NOT DISTINCT FROM g.grp""",
)
def holdout_with_null_group(t):
    """Late orders of one target have no group: they are one, and it is tested."""
    grouped = (F.col("year") < 2001) | (F.col("target") != "5-LOW")
    return P.group_split(t.orders().withColumn("grp", F.when(grouped, F.col("grp"))), F.col("year") >= 2001, "grp")


@query(
    "pin:d grp:i split:s n:i",
    f"""WITH {ORDERS_SQL}, f AS (SELECT id, CASE WHEN target NOT IN ('1-URGENT', '2-HIGH') THEN grp END AS grp FROM ords),
    u AS (SELECT grp, count(*) AS n FROM f GROUP BY grp), p AS (SELECT unnest([0.3, 0.9]) AS pin)
    SELECT pin, grp, CASE WHEN n > pin * (SELECT count(*) FROM ords) THEN 'train'
      ELSE {_side(f"('0x' || substr(sha256(concat_ws(':', '{SEED}', grp)), 1, 16))::UBIGINT / 18446744073709551616.0")} END AS split, n FROM u, p""",
)
def hashed_split_with_null_group(t):
    """Two fifths of the orders have no group: a giant one at the lower limit, hashed by the seed at the upper."""
    orders = t.orders().withColumn("grp", F.when(~F.col("target").isin("1-URGENT", "2-HIGH"), F.col("grp")))
    out = None
    for pin in (0.3, 0.9):
        split = P.hash_split(orders, "grp", SEED, pin_above=pin, unit="id")
        counted = split.groupBy("grp", "split").agg(F.count("*").alias("n")).withColumn("pin", F.lit(pin))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "split:s n_groups:i n_records:i",
    "SELECT split, count(DISTINCT grp) AS n_groups, count(*) AS n_records FROM ("
    + _group_sql(ORDERS_SQL, "year >= 2001") + ") GROUP BY split",
)
def time_holdout_counts(t):
    sides = P.group_sides(t.orders(), F.col("year") >= 2001, "grp")
    sizes = t.orders().groupBy("grp").agg(F.count("*").alias("n"))
    return sizes.join(sides, "grp").groupBy("split").agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_records")
    )


_FOLDS_SQL = f"""WITH RECURSIVE {ORDERS_SQL}, s AS (SELECT center, count(*) AS n FROM ords GROUP BY center),
    big AS (SELECT *, row_number() OVER (ORDER BY n DESC, center) AS rn FROM s WHERE n >= {{min_n}}),
    g AS (
      SELECT 1::BIGINT AS step, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::VARCHAR AS center, -1::INT AS fold
      UNION ALL
      SELECT step + 1, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + big.n ELSE x END),
        big.center, (list_position(load, list_min(load)) - 1)::INT
      FROM g JOIN big ON big.rn = g.step)
    SELECT center, fold FROM g WHERE center IS NOT NULL
    UNION ALL SELECT center, -1 FROM s WHERE n < {{min_n}}"""


_MIN_N = "(SELECT count(*) * 52 // 1500 FROM orders)"


@query("center:s fold:i", _FOLDS_SQL.format(min_n=_MIN_N))
def balanced_folds(t):
    return folds_of(t)


def orders_share(t, part, whole):
    """A limit that grows with the data: ``part`` of every ``whole`` orders."""
    return t("orders").count() * part // whole


def folds_of(t):
    sizes = t.orders().groupBy("center").agg(F.count("*").alias("n"))
    return P.greedy_folds(sizes, "center", "n", 5, orders_share(t, 52, 1500))


_ASSIGNED_SQL = f"""a AS (
      SELECT o.*, coalesce(f.fold, -1) AS own FROM ords o LEFT JOIN folds f ON f.center = o.center),
    tg AS (SELECT DISTINCT grp, own FROM a WHERE own >= 0),
    r AS (SELECT a.*, j.fold, CASE WHEN a.own = j.fold THEN 'test'
        WHEN (a.grp, j.fold) IN (SELECT (grp, own) FROM tg) THEN 'dropped' ELSE 'train' END AS side
      FROM a, (SELECT unnest(range(5)) AS fold) j)"""
# Orders are regrouped by price so that groups span batches.
_SPAN_SQL = ORDERS_SQL.replace("o_custkey AS grp", "floor(o_totalprice / 40)::BIGINT AS grp")
_FOLD_BASE = f"WITH {_SPAN_SQL}, folds AS ({_FOLDS_SQL.format(min_n=_MIN_N)}), {_ASSIGNED_SQL}"


def assigned(t):
    orders = t.orders().withColumn("grp", F.floor(F.col("price") / 40))
    return P.fold_train_test(orders, folds_of(t), "center", "grp", 5)


@query("fold:i side:s n:i", _FOLD_BASE + " SELECT fold, side, count(*) AS n FROM r GROUP BY ALL")
def fold_sides(t):
    return assigned(t).groupBy("fold", "side").agg(F.count("*").alias("n"))


@query(
    "fold:i n_batches:i n_test:i n_train:i n_dropped:i test_neg_groups:i train_neg_groups:i homology_loss_pct:d evaluable:b reason:s",
    _FOLD_BASE + """, x AS (SELECT fold, count(DISTINCT center) FILTER (side = 'test') AS n_batches,
      sum((side = 'test')::INT) AS n_test, sum((side = 'train')::INT) AS n_train, sum((side = 'dropped')::INT) AS n_dropped,
      count(DISTINCT grp) FILTER (side = 'test' AND label_express = 0) AS test_neg_groups,
      count(DISTINCT grp) FILTER (side = 'train' AND label_express = 0) AS train_neg_groups FROM r GROUP BY fold)
    SELECT *, 100.0 * n_dropped / (n_train + n_dropped) AS homology_loss_pct, n_test >= lim.n AND test_neg_groups >= lim.g AS evaluable,
      CASE WHEN n_test < lim.n THEN 'test too small' WHEN test_neg_groups < lim.g THEN 'too few failing groups' ELSE '' END AS reason
      FROM x, (SELECT count(*) * 15 // 1500 AS n, count(*) * 91 // 1500 AS g FROM orders) lim""",
)
def fold_report(t):
    return P.fold_summary(assigned(t), "center", "grp", "label_express", orders_share(t, 15, 1500), orders_share(t, 91, 1500))


@query(
    "fold:i n_cross:i n_within:i ratio:d",
    _FOLD_BASE + """ SELECT fold, sum((side = 'train')::INT) AS n_cross, sum((side = 'test')::INT) AS n_within,
      sum((side = 'train')::INT) / nullif(sum((side = 'test')::INT), 0) AS ratio FROM r GROUP BY fold""",
)
def training_size_ratio(t):
    from tristage.operators.models import size_ratio

    return size_ratio(assigned(t))


@query(
    "id:i cv_fold:i inner_fold:i",
    f"""WITH {ORDERS_SQL} SELECT id, {_h(repr(str(SEED)), "'cv'", 'grp')} % 5 AS cv_fold,
      {_h(repr(str(SEED)), "'inner'", 'grp')} % 3 AS inner_fold FROM ords""",
)
def within_batch_folds(t):
    folded = P.cv_fold(t.orders(), "grp", SEED, 5)
    return folded.withColumn("inner_fold", modulo(keyed(SEED, "inner", F.col("grp")), 3))


_SIDE_SQL = "WITH s AS (" + _group_sql(ORDERS_SQL, "year >= 2001").replace("SELECT id, f.grp,", "SELECT f.*,") + ") "
_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT split, '{s}' AS stage, sum((label_{s} = 0)::INT) AS neg_records,"
    f" count(DISTINCT grp) FILTER (label_{s} = 0) AS neg_clusters, sum((label_{s} = 1)::INT) AS pos_records"
    f" FROM s GROUP BY split" for s in ("express", "soluble")
)


@query("split:s stage:s neg_records:i neg_clusters:i pos_records:i", _SIDE_SQL + _COUNTS_SQL)
def side_stage_counts(t):
    split = P.group_split(t.orders(), F.col("year") >= 2001, "grp")
    return P.side_counts(split, "grp", ["express", "soluble"])


@query(
    "split:s stage:s neg_records:i neg_clusters:i pos_records:i n_records:i n_clusters:i",
    _SIDE_SQL + f"""SELECT c.*, n_records, n_clusters FROM ({_COUNTS_SQL}) c JOIN
      (SELECT split, count(*) AS n_records, count(DISTINCT grp) AS n_clusters FROM s GROUP BY split) z ON z.split = c.split""",
)
def split_manifest(t):
    """The manifest of a frozen split; its content hash is Spark's own and left out of the comparison."""
    split = P.group_split(t.orders(), F.col("year") >= 2001, "grp")
    return manifest(split, "grp", ["express", "soluble"])


@query(
    "n_shared:i",
    "WITH s AS (" + _group_sql(ORDERS_SQL, "year >= 2001") + ") SELECT count(*) AS n_shared FROM ("
    "SELECT grp FROM s WHERE split = 'train' INTERSECT SELECT grp FROM s WHERE split = 'test')",
)
def split_overlap(t):
    split = P.group_split(t.orders(), F.col("year") >= 2001, "grp")
    train, test = (split.where(F.col("split") == s).select("grp") for s in ("train", "test"))
    return train.intersect(test).agg(F.count("*").alias("n_shared"))
