"""Inventories, concentration, redundancy and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions import text as T
from tristage.functions.labels import any_failed
from tristage.operators import metrics as M
from tristage.operators import quality as Q
from tristage.plans.bindings import DOCS_SQL, LINES_SQL, LINE_SCORES_SQL, ORDERS_SQL
from tristage.plans.registry import query
from tristage.schema import STAGES

_FAILS = ", ".join(f"sum((label_{s} = 0)::INT) AS fail_{s}" for s in STAGES)
_FAIL_SPEC = " ".join(f"fail_{s}:i" for s in STAGES)


@query(
    f"center:s n:i n_units:i share:d unit_share:d {_FAIL_SPEC}",
    f"""WITH {LINES_SQL} SELECT center, count(*) AS n, count(DISTINCT unit) AS n_units, {_FAILS},
      count(*) / (SELECT count(*) FROM lines) AS share,
      count(DISTINCT unit) / (SELECT count(DISTINCT unit) FROM lines) AS unit_share FROM lines GROUP BY center""",
)
def center_inventory(t):
    return Q.inventory(t.lines(), "center", "unit")


_CONC = " UNION ALL ".join(
    f"SELECT '{s}' AS stage, center, count(DISTINCT unit) AS k, any_value(tot) AS tot FROM lines,"
    f" (SELECT count(DISTINCT unit) AS tot FROM lines WHERE label_{s} = 0) WHERE label_{s} = 0 GROUP BY center"
    for s in STAGES
)


@query(
    "stage:s failing_units:i n_groups:i top_group:s top_units:i top_share:d",
    f"""WITH {LINES_SQL}, g AS ({_CONC}),
    r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY k DESC, center) AS rn,
      count(*) OVER (PARTITION BY stage) AS n_groups FROM g)
    SELECT stage, tot AS failing_units, n_groups, center AS top_group, k AS top_units, k / tot AS top_share
    FROM r WHERE rn = 1""",
)
def negative_concentration(t):
    return Q.concentration(t.lines(), "center", "unit")


@query(
    "n:i min_len:i max_len:i p25:d p50:d p75:d p95:d n_short:i n_long:i",
    """SELECT count(*) AS n, min(n_chars) AS min_len, max(n_chars) AS max_len,
      quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75,
      quantile_cont(n_chars, 0.95) AS p95, sum((n_chars < 30)::INT) AS n_short, sum((n_chars > 2000)::INT) AS n_long
    FROM documents""",
)
def length_distribution(t):
    return Q.length_profile(t("documents"), "n_chars")


@query(
    f"year:i n:i {_FAIL_SPEC}",
    f"""WITH {LINES_SQL} SELECT CASE WHEN year >= 1997 THEN year ELSE -1 END AS year, count(*) AS n, {_FAILS}
    FROM lines GROUP BY 1""",
)
def failures_by_year(t):
    known = F.when(F.col("year") >= 1997, F.col("year")).otherwise(-1)
    return Q.year_histogram(t.lines().withColumn("year", known), "year", STAGES)


@query(
    "n_records:i n_units:i n_clusters:i largest_cluster:i singletons:i records_per_unit:d units_per_cluster:d singleton_share:d",
    """WITH c AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY 1)
    SELECT sum(n) AS n_records, sum(k) AS n_units, count(*) AS n_clusters, max(k) AS largest_cluster,
      sum((k = 1)::INT) AS singletons, sum(n) / sum(k) AS records_per_unit, sum(k) / count(*) AS units_per_cluster,
      sum((k = 1)::INT) / count(*) AS singleton_share FROM c""",
)
def redundancy_ratios(t):
    return Q.redundancy(t("lineitem"), "l_partkey", "l_suppkey")


_SHRINK = "count(*) AS n_records, count(DISTINCT unit) AS n_units, count(*) / count(DISTINCT unit) AS shrinkage, log10(count(*) / count(DISTINCT unit)) AS log10_shrinkage"


@query(
    "stage:s n_records:i n_units:i shrinkage:d log10_shrinkage:d",
    f"WITH {LINES_SQL} " + " UNION ALL ".join(
        f"SELECT '{s}' AS stage, {_SHRINK} FROM lines WHERE label_{s} = 0 HAVING count(*) > 0" for s in STAGES
    ),
)
def shrinkage_by_stage(t):
    return Q.stage_shrinkage(t.lines(), "unit", 0)


@query(
    "center:s n_records:i n_units:i shrinkage:d log10_shrinkage:d",
    f"WITH {LINES_SQL} SELECT center, {_SHRINK} FROM lines WHERE "
    + " OR ".join(f"label_{s} = 0" for s in STAGES) + " GROUP BY center",
)
def shrinkage_by_center(t):
    return Q.shrinkage(t.lines(), ["center"], "unit", any_failed())


@query(
    "tier:s stage:s n_fail:i",
    f"WITH {LINES_SQL} " + " UNION ALL ".join(
        f"SELECT tier, '{s}' AS stage, count(*) AS n_fail FROM lines WHERE label_{s} = 0 GROUP BY tier" for s in STAGES
    ),
)
def failures_by_tier(t):
    return Q.tier_counts(t.lines(), "tier")


def _set_sum(ls, cond):
    return f"sum(length(u) - length(translate(u, '{ls}', ''))) FILTER ({cond}) / sum(length(u)) FILTER ({cond})"


@query(
    "median_flagged:d median_other:d disorder_flagged:d disorder_other:d hydrophobic_flagged:d hydrophobic_other:d",
    f"""SELECT median(n_chars) FILTER (f) AS median_flagged, median(n_chars) FILTER (NOT f) AS median_other,
      {_set_sum(T.DISORDER_PROMOTING, 'f')} AS disorder_flagged, {_set_sum(T.DISORDER_PROMOTING, 'NOT f')} AS disorder_other,
      {_set_sum(T.HYDROPHOBIC, 'f')} AS hydrophobic_flagged, {_set_sum(T.HYDROPHOBIC, 'NOT f')} AS hydrophobic_other
    FROM (SELECT upper(replace(text, 'ß', 'ss')) AS u, n_chars, lang = 'en' AS f FROM documents)""",
)
def contrast_summary(t):
    docs = t("documents").select(F.upper("text").alias("u"), "n_chars", (F.col("lang") == "en").alias("f"))
    return Q.contrast(docs, "f", "u", "n_chars")[0]


@query(
    "letter:s flagged:d other:d delta:d",
    "SELECT *, flagged - other AS delta FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS letter, {_set_sum(a, 'f')} AS flagged, {_set_sum(a, 'NOT f')} AS other"
        " FROM (SELECT upper(replace(text, 'ß', 'ss')) AS u, lang = 'en' AS f FROM documents)" for a in T.RESIDUES20
    ) + ") ORDER BY abs(flagged - other) DESC, letter LIMIT 8",
)
def contrast_letters(t):
    docs = t("documents").select(F.upper("text").alias("u"), "n_chars", (F.col("lang") == "en").alias("f"))
    return Q.contrast(docs, "f", "u", "n_chars")[1]


@query(
    "n_records:i n_share_alike:i share:d",
    "SELECT count(*) AS n_records, sum((n_name LIKE '%1%')::INT) AS n_share_alike, sum((n_name LIKE '%1%')::INT) / count(*) AS share"
    " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
)
def licence_share(t):
    licences = t("nation").select(F.col("n_name").alias("center"), F.col("n_name").contains("1").alias("share_alike"))
    return Q.share_alike(t.lines(), licences, "center")


@query(
    "has_failure:b n_groups:i median_size:d",
    f"""WITH {ORDERS_SQL}, g AS (SELECT grp, count(*) AS k, bool_or(label_express = 0) AS has_failure FROM ords GROUP BY grp)
    SELECT has_failure, count(*) AS n_groups, median(k) AS median_size FROM g GROUP BY 1""",
)
def group_size_by_failure(t):
    return Q.group_size_by_failure(t.orders(), "grp", "label_express")


_GATE = """stages_ok:i worst_neg_share:d top_unit_share:d holdout_groups:i recent_rows:i enough_negatives:b
 no_dominating_group:b no_dominating_negatives:b holdouts_possible:b passed:b"""


@query(
    _GATE,
    f"""WITH {LINES_SQL}, g AS ({_CONC}),
    st AS (SELECT stage, any_value(tot) AS tot, max(k) / any_value(tot) AS sh FROM g GROUP BY stage),
    a AS (SELECT sum((tot >= 500)::INT) AS stages_ok, max(sh) FILTER (tot >= 100) AS worst_neg_share FROM st),
    c AS (SELECT center, count(DISTINCT unit) AS k FROM lines GROUP BY 1),
    b AS (SELECT max(k) / (SELECT count(DISTINCT unit) FROM lines) AS top_unit_share, sum((k >= 1000)::INT) AS holdout_groups FROM c),
    r AS (SELECT sum((year >= 2000)::INT) AS recent_rows FROM lines),
    v AS (SELECT *, stages_ok >= 3 AS enough_negatives, top_unit_share <= 0.4 AS no_dominating_group,
      worst_neg_share <= 0.4 AS no_dominating_negatives, holdout_groups >= 2 AND recent_rows >= 1000 AS holdouts_possible FROM a, b, r)
    SELECT *, enough_negatives AND no_dominating_group AND no_dominating_negatives AND holdouts_possible AS passed FROM v""",
)
def data_gate(t):
    return Q.gate(
        t.lines(), "center", "unit", F.col("year") >= 2000, min_negatives=500, min_units_for_bias=100
    )


@query(
    "center:s counter:s expected:i actual:i",
    f"""WITH {LINES_SQL}, a AS (
      SELECT center, 'n' AS counter, count(*) AS expected, sum((tier <> 'none' OR y = 0)::INT) AS actual FROM lines GROUP BY center
      UNION ALL SELECT center, 'n_fail', sum(y), sum((label_soluble = 0 OR label_stable = 0)::INT) FROM lines GROUP BY center)
    SELECT * FROM a WHERE expected <> actual""",
)
def counter_mismatches(t):
    """Returns counted from the flag against failures counted from the labels (differ at first-stage failures)."""
    lines = t.lines()
    stored = lines.groupBy("center").agg(F.count("*").alias("n"), F.sum("y").alias("n_fail"))
    again = lines.groupBy("center").agg(
        F.count_if((F.col("tier") != "none") | (F.col("y") == 0)).alias("n"),
        F.count_if((F.col("label_soluble") == 0) | (F.col("label_stable") == 0)).alias("n_fail"),
    )
    return Q.cross_check(stored, again, ["center"])


@query(
    "center:s n:i",
    f"WITH {LINE_SCORES_SQL} SELECT center, count(*) AS n FROM sc GROUP BY center ORDER BY n DESC, center LIMIT 5",
)
def largest_centers(t):
    return M.largest_groups(t.line_scores(), "center")
