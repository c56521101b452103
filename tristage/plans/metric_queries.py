"""Ranking metrics: PR-AUC with its base rate, precision at k, best F1, curves, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.operators import metrics as M
from tristage.plans.bindings import DOC_SCORES_SQL, LINE_SCORES_SQL, VECTOR_SCORES_SQL
from tristage.plans.registry import query

KS = (10, 20, 50, 100)


def ap_sql(src: str, by: list[str], name: str = "ap") -> str:
    """CTEs ending in ``name`` (by, n_rows, n_positive, base_rate, pr_auc, pr_auc_over_base)."""
    cols = ", ".join(by) + ", " if by else ""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""{name}_c AS (SELECT {cols}score, sum(y) AS pos, count(*) AS n FROM {src} GROUP BY {cols}score),
    {name}_r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS pred,
        sum(pos) OVER ({part}) AS pt, sum(n) OVER ({part}) AS nt FROM {name}_c
      WINDOW w AS ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    {name} AS (SELECT {cols}max(nt) AS n_rows, max(pt) AS n_positive, max(pt) / max(nt) AS base_rate,
        CASE WHEN max(pt) > 0 AND max(pt) < max(nt) THEN sum(pos * tp / pred) / max(pt) END AS pr_auc,
        CASE WHEN max(pt) > 0 AND max(pt) < max(nt) THEN sum(pos * tp / pred) / max(pt) END
          / nullif(max(pt) / max(nt), 0) AS pr_auc_over_base
      FROM {name}_r {group})"""


def top_sql(src: str, by: list[str], ks=KS, name: str = "tk") -> str:
    cols = ", ".join(by) + ", " if by else ""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    out = []
    for k in ks:
        hit = f"sum(y) FILTER (rk <= {k})"
        ok = f"count(*) >= {k}"
        base = "sum(y) / count(*)"
        out.append(
            f"CASE WHEN {ok} THEN {hit} / {k} END AS precision_at_{k}, CASE WHEN {ok} THEN {hit} / nullif(sum(y), 0) END AS recall_at_{k},"
            f" CASE WHEN {ok} THEN {hit} / {k} END / nullif({base}, 0) AS lift_at_{k}"
        )
    return f"""{name}_r AS (SELECT *, row_number() OVER ({part}ORDER BY score DESC, id) AS rk FROM {src}),
    {name} AS (SELECT {cols}count(*) AS n_rows, sum(y) AS n_positive, {', '.join(out)} FROM {name}_r {group})"""


_AP = "n_rows:i n_positive:i base_rate:d pr_auc:d pr_auc_over_base:d"
_AT = " ".join(f"{m}_at_{k}:d" for k in KS for m in ("precision", "recall", "lift"))


@query(
    f"center:s {_AP}",
    f"WITH {LINE_SCORES_SQL}, {ap_sql('sc', ['center'])} SELECT * FROM ap",
)
def pr_auc_by_center(t):
    return M.average_precision(t.line_scores(), ["center"])


@query(
    f"center:s n_rows:i n_positive:i {_AT}",
    f"WITH {LINE_SCORES_SQL}, {top_sql('sc', ['center'])} SELECT * FROM tk",
)
def precision_at_k(t):
    return M.precision_recall_at_k(t.line_scores(), KS, ["center"])


@query(
    f"organism:s {_AP} {_AT}",
    f"""WITH {DOC_SCORES_SQL}, {ap_sql('sc', ['organism'])}, {top_sql('sc', ['organism'])}
    SELECT ap.*, {', '.join(f'{m}_at_{k}' for k in KS for m in ('precision', 'recall', 'lift'))}
    FROM ap JOIN tk ON ap.organism = tk.organism""",
)
def evaluation_by_language(t):
    return M.evaluate(t.doc_scores(), KS, ["organism"])


@query(
    f"{_AP} {_AT}",
    f"""WITH {LINE_SCORES_SQL}, {ap_sql('sc', [])}, {top_sql('sc', [])}
    SELECT ap.*, {', '.join(f'{m}_at_{k}' for k in KS for m in ('precision', 'recall', 'lift'))} FROM ap, tk""",
)
def evaluation_overall(t):
    return M.evaluate(t.line_scores(), KS)


_MEASURES = ["pr_auc_over_base"] + [f"{m}_at_{k}" for k in (10, 100) for m in ("precision", "lift")]


@query(
    "measure:s best_group:s best:d worst_group:s worst:d best_over_worst:d spread:d n_groups_total:i n_groups_evaluated:i",
    f"""WITH {LINE_SCORES_SQL}, z AS (SELECT year, count(*) AS n FROM sc GROUP BY year),
    b AS (SELECT * FROM sc WHERE year IN (SELECT year FROM z WHERE n >= 200)),
    {ap_sql('b', ['year'])}, {top_sql('b', ['year'], (10, 100))},
    e AS (SELECT ap.pr_auc_over_base, tk.* FROM ap JOIN tk ON ap.year = tk.year),
    l AS ({' UNION ALL '.join(f"SELECT year, '{m}' AS measure, {m} AS v FROM e" for m in _MEASURES)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY v DESC, year) AS rb,
      row_number() OVER (PARTITION BY measure ORDER BY v, year) AS rw FROM l WHERE v IS NOT NULL),
    x AS (SELECT measure, max(year) FILTER (rb = 1) AS best_group, max(v) AS best, max(year) FILTER (rw = 1) AS worst_group,
      min(v) AS worst FROM r GROUP BY measure)
    SELECT *, CASE WHEN worst > 0 THEN best / worst ELSE 'inf'::DOUBLE END AS best_over_worst, best - worst AS spread,
      (SELECT count(*) FROM z) AS n_groups_total, (SELECT count(*) FROM z WHERE n >= 200) AS n_groups_evaluated FROM x""",
)
def group_spread_by_year(t):
    return M.group_spread(t.line_scores(), "year", (10, 100), 200)


def f1_sql(src: str, by: list[str], name: str = "bf") -> str:
    cols = ", ".join(by) + ", " if by else ""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    ap = ap_sql(src, by, name + "p")
    return f"""{ap}, {name}_f AS (SELECT *, 2.0 * tp / (pred + pt) AS f1 FROM {name}p_r),
    {name}_o AS (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, score) AS rn FROM {name}_f),
    {name} AS (SELECT {cols}nt AS n_rows, pt AS n_positive, f1 AS best_f1, tp / pred AS precision_at_best,
      tp / pt AS recall_at_best, score AS threshold FROM {name}_o WHERE rn = 1)"""


_LONG = (
    f"WITH {VECTOR_SCORES_SQL}, m AS (SELECT 's0' AS metric, y, s0 AS score FROM vec UNION ALL SELECT 's1', y, -s1 FROM vec"
    " UNION ALL SELECT 's2', y, CASE WHEN id % 9 = 0 THEN (SELECT avg(s2) FROM vec WHERE id % 9 <> 0) ELSE s2 END FROM vec)"
)


@query(
    "metric:s n_rows:i n_positive:i best_f1:d precision_at_best:d recall_at_best:d threshold:d pr_auc:d",
    f"{_LONG}, {f1_sql('m', ['metric'])} SELECT bf.*, bfp.pr_auc FROM bf JOIN bfp ON bf.metric = bfp.metric",
)
def best_f1_by_score(t):
    return M.best_f1(long_scores(t), ["metric"])


def long_scores(t):
    vec = t.vector_scores().withColumn("s2", F.when(F.col("id") % 9 != 0, F.col("s2")))
    return M.by_score_column(vec, {"s0": 1, "s1": -1, "s2": 1}, ["id", "y", "target"])


@query(
    "s0_beats_s1:b s0_beats_s2:b",
    f"{_LONG}, {ap_sql('m', ['metric'])} SELECT "
    + ", ".join(
        f"(SELECT pr_auc FROM ap WHERE metric = 's0') > (SELECT pr_auc FROM ap WHERE metric = '{o}') AS s0_beats_{o}"
        for o in ("s1", "s2")
    ),
)
def metric_ordering(t):
    ap = M.average_precision(long_scores(t), ["metric"])
    return ap.agg(*[M.ordering_claim(ap, "s0", o).alias(f"s0_beats_{o}") for o in ("s1", "s2")])


@query(
    "n_targets:i mean_best_f1:d median_best_f1:d delta:d within_tolerance:b",
    f"""WITH {VECTOR_SCORES_SQL}, m AS (SELECT target, y, s0 AS score FROM vec), {f1_sql('m', ['target'])}
    SELECT count(*) AS n_targets, avg(best_f1) AS mean_best_f1, median(best_f1) AS median_best_f1,
      avg(best_f1) - 0.61 AS delta, abs(avg(best_f1) - 0.61) <= 0.05 AS within_tolerance
    FROM bf WHERE n_rows >= 20 AND n_positive > 0 AND n_positive < n_rows""",
)
def best_f1_of_targets(t):
    scores = t.vector_scores().withColumnRenamed("s0", "score")
    return M.best_f1_per_target(scores, "target", reference=0.61)


@query(
    "point:i threshold:d precision:d recall:d",
    f"""WITH {LINE_SCORES_SQL}, {ap_sql('sc', [])},
    i AS (SELECT *, row_number() OVER (ORDER BY score) - 1 AS point, count(*) OVER () AS m FROM ap_r),
    w AS (SELECT DISTINCT CASE WHEN k = least(200, m) - 1 THEN m - 1 ELSE floor(k * ((m - 1) / (least(200, m) - 1)))::BIGINT END AS point
      FROM (SELECT DISTINCT m FROM i), (SELECT unnest(range(200)) AS k) WHERE k < least(200, m))
    SELECT i.point, score AS threshold, tp / pred AS precision, tp / pt AS recall FROM i JOIN w ON i.point = w.point""",
)
def pr_curve_points(t):
    return M.pr_curve(t.line_scores())


@query(
    f"reading:s {_AP}",
    f"""WITH {DOC_SCORES_SQL}, v AS (SELECT 'positive_is_failure' AS reading, y, score FROM sc
      UNION ALL SELECT 'positive_is_success', 1 - y, -score FROM sc UNION ALL SELECT 'inverted_score', y, -score FROM sc),
    {ap_sql('v', ['reading'])} SELECT * FROM ap""",
)
def polarity_readings(t):
    return M.average_precision(M.polarity(t.doc_scores()), ["reading"])


@query(
    _AP,
    f"""WITH {DOC_SCORES_SQL}, v AS (SELECT y, ('0x' || substr(sha256('11:random:' || id), 1, 16))::UBIGINT / 18446744073709551616.0 AS score FROM sc),
    {ap_sql('v', [])} SELECT * FROM ap""",
)
def random_control(t):
    return M.average_precision(M.random_control(t.doc_scores(), 11), [])


CUTOFFS = [5000.0, 10000.0, 20000.0, 40000.0, 60000.0, 90000.0, 200000.0]


@query(
    "threshold:d n_pass:i pass_rate:d hits:i precision:d recall:d lift:d positives_lost:i recall_lost:d",
    f"""WITH {LINE_SCORES_SQL}, c AS (SELECT unnest({CUTOFFS}) AS threshold), tot AS (SELECT count(*) AS n, sum(y) AS p FROM sc)
    SELECT threshold::DOUBLE AS threshold, count(*) AS n_pass, count(*) / any_value(n) AS pass_rate, sum(y) AS hits,
      sum(y) / count(*) AS precision, sum(y) / any_value(p) AS recall, (sum(y) / count(*)) / (any_value(p) / any_value(n)) AS lift,
      any_value(p) - sum(y) AS positives_lost, (any_value(p) - sum(y)) / any_value(p) AS recall_lost
    FROM sc JOIN c ON score >= threshold, tot GROUP BY threshold""",
)
def threshold_calibration(t):
    return M.calibrate(t.line_scores(), CUTOFFS)


@query(
    "n_folds:i median:d mean:d std:d",
    f"""WITH {LINE_SCORES_SQL}, {ap_sql('sc', ['year'])} SELECT count(pr_auc_over_base) AS n_folds,
      median(pr_auc_over_base) AS median, avg(pr_auc_over_base) AS mean, stddev_pop(pr_auc_over_base) AS std FROM ap""",
)
def fold_statistics(t):
    return M.fold_stats(M.average_precision(t.line_scores(), ["year"]), [], "pr_auc_over_base")


_REV_SQL = f"""WITH {DOC_SCORES_SQL}, mo AS (SELECT organism, 'length' AS model, id, y, score FROM sc
      UNION ALL SELECT organism, 'hash', id, y, ('0x' || substr(sha256('3:random:' || id), 1, 16))::UBIGINT / 18446744073709551616.0 FROM sc),
    v AS (SELECT organism, model, id, 'positive_is_failure' AS reading, y, score FROM mo
      UNION ALL SELECT organism, model, id, 'inverted_score', y, -score FROM mo)"""


@query(
    "organism:s n_models:i reversed:b",
    f"""{_REV_SQL}, {top_sql('v', ['organism', 'model', 'reading'], (10,))},
    p AS (SELECT organism, model, max(lift_at_10) FILTER (reading = 'inverted_score') AS i,
      max(lift_at_10) FILTER (reading = 'positive_is_failure') AS d FROM tk GROUP BY ALL)
    SELECT organism, count(*) AS n_models, bool_and(coalesce(i > 1 AND i > d, false)) AS reversed FROM p GROUP BY organism""",
)
def reversed_folds(t):
    scores = t.doc_scores()
    models = scores.withColumn("model", F.lit("length")).unionByName(
        M.random_control(scores, 3).withColumn("model", F.lit("hash"))
    )
    tagged = M.polarity(models).where("reading <> 'positive_is_success'")
    at = M.precision_recall_at_k(tagged, (10,), ["organism", "model", "reading"])
    return M.reversal(at, "organism", "model", "reading", "lift_at_10")
