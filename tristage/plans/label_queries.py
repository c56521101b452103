"""Tri-state labels, status histories, replicates, assays and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions import labels as L
from tristage.operators import labels as O
from tristage.operators import quality as Q
from tristage.plans.bindings import DOCS_SQL, HISTORY_SQL, LINES_SQL, ORDERS_SQL, TRIALS_SQL
from tristage.plans.registry import query
from tristage.schema import LABELS, STAGES, STATUS_RULES, status_rules

_SIX = ", ".join(LABELS)
_SIX_SPEC = " ".join(f"{c}:i" for c in LABELS)


@query(
    "center:s n:i fail:i rate:d zero_rate:b",
    f"""WITH {DOCS_SQL}
    SELECT center, count(*) AS n, sum((label_express = 0)::INT) AS fail,
      sum((label_express = 0)::INT) / count(*) AS rate, sum((label_express = 0)::INT) = 0 AS zero_rate
    FROM docs WHERE label_express <> -1 GROUP BY center HAVING count(*) >= 10""",
)
def failure_rate_by_source(t):
    return Q.rate_by_group(t.docs(), "center", "label_express", min_n=10)


@query(
    f"{_SIX_SPEC} n:i",
    f"WITH {LINES_SQL} SELECT {_SIX}, count(*) AS n FROM lines GROUP BY {_SIX}",
)
def outcome_vectors(t):
    return t.lines().groupBy(*LABELS).agg(F.count("*").alias("n"))


@query(
    "tier:s n:i n_bad:i",
    f"""WITH {LINES_SQL}
    SELECT tier, count(*) AS n,
      sum((CASE WHEN label_soluble = 0 AND seq_len % 10 = 0 THEN 1 WHEN seq_len % 49 = 0 THEN 1 ELSE 0 END)::INT) AS n_bad
    FROM lines GROUP BY tier""",
)
def label_violations(t):
    """An override makes some vectors observed after a failure, and some values unknown."""
    tail = F.when((F.col("label_soluble") == 0) & (F.col("seq_len") % 10 == 0), 1).otherwise(
        F.when(F.col("seq_len") % 49 == 0, 7).otherwise(F.col("label_bind"))
    )
    lines = t.lines().withColumn("label_bind", tail)
    bad = O.violations(lines).groupBy("tier").agg(F.count("*").alias("n_bad"))
    every = lines.groupBy("tier").agg(F.count("*").alias("n"))
    return every.join(bad, "tier", "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))


_LAST = "greatest(" + ", ".join(
    f"CASE WHEN label_{s} = 1 THEN {i} ELSE -1 END" for i, s in enumerate(STAGES)
) + ")"


@query(
    f"{_SIX_SPEC} n:i",
    f"WITH {LINES_SQL}, gaps AS (SELECT * REPLACE (CASE WHEN exposed THEN -1 ELSE label_clone END AS label_clone) FROM lines), "
    f"filled AS (SELECT "
    + ", ".join(
        f"CASE WHEN label_{s} = -1 AND {i} < {_LAST} THEN 1 ELSE label_{s} END AS label_{s}"
        for i, s in enumerate(STAGES)
    )
    + f" FROM gaps) SELECT {_SIX}, count(*) AS n FROM filled GROUP BY {_SIX}",
)
def filled_success_prefix(t):
    gaps = t.lines().withColumn(
        "label_clone", F.when(F.col("exposed"), -1).otherwise(F.col("label_clone"))
    )
    filled = gaps.select(L.fill_success_prefix(L.as_array()).alias("label"))
    return filled.select(*L.as_columns(F.col("label"))).groupBy(*LABELS).agg(F.count("*").alias("n"))


@query(
    "stage:s success:i fail:i unobserved:i",
    f"WITH {LINES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS stage, sum((label_{s} = 1)::INT) AS success, sum((label_{s} = 0)::INT) AS fail,"
        f" sum((label_{s} = -1)::INT) AS unobserved FROM lines"
        for s in STAGES
    ),
)
def stage_label_counts(t):
    return O.label_counts(t.lines())


@query(
    "label_express:i label_soluble:i label_both:i n:i",
    f"""WITH {ORDERS_SQL}
    SELECT label_express, label_soluble,
      CASE WHEN label_express = 1 AND label_soluble = 1 THEN 1 WHEN label_express = 0 THEN 0
           WHEN label_express = 1 AND label_soluble = 0 THEN 0 ELSE -1 END AS label_both, count(*) AS n
    FROM ords GROUP BY ALL""",
)
def composite_outcome(t):
    both = L.composite_label(F.col("label_express"), F.col("label_soluble"))
    return t.orders().withColumn("label_both", both).groupBy(
        "label_express", "label_soluble", "label_both"
    ).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- status histories

_TRIAL_SPEC = f"target:i day:s reached:i {_SIX_SPEC} evidence_tier:s exclusion_reason:s conflict:b"


def _trial_sql(policy: str) -> str:
    fail_at = """CASE WHEN excl = '' AND f > reached THEN f
        WHEN inferred THEN reached + 1 END"""
    inferred = "reached >= 0 AND reached < 5" if policy != "clone_zero" else "reached < 5"
    kept = "stopped AND reached < 0" if policy == "keep_unobserved" else "false"
    where = "WHERE NOT (stopped AND reached < 0)" if policy == "drop" else ""
    cols = ", ".join(
        f"CASE WHEN blank THEN -1 WHEN {i} <= reached THEN 1 WHEN {i} = fail_at THEN 0 ELSE -1 END"
        f" AS label_{s}"
        for i, s in enumerate(STAGES)
    )
    return TRIALS_SQL.format(stable=4) + f""", a AS (
      SELECT *, CASE WHEN status = 'test target' THEN 'test_target'
          WHEN stop_status = 'PDB duplicate found' THEN 'duplicate_target' ELSE '' END AS excl,
        CASE stop_status WHEN 'cloning failed' THEN 0 WHEN 'expression failed' THEN 1
          WHEN 'membrane protein solubilization failed' THEN 2 WHEN 'purification failed' THEN 3 END AS f
      FROM trials),
    b AS (SELECT *, excl = '' AND coalesce(f <= reached, false) AS conflict,
        status = 'work stopped' AND excl = '' AND NOT coalesce(f > reached, false) AS stopped FROM a),
    c AS (SELECT *, stopped AND {inferred} AS inferred, {kept} AS kept FROM b {where}),
    d AS (SELECT *, excl <> '' OR kept AS blank, {fail_at} AS fail_at FROM c)
    SELECT target, day, reached, {cols},
      CASE WHEN excl = '' AND f > reached THEN 'explicit' WHEN inferred THEN 'inferred_next_step'
           ELSE 'none' END AS evidence_tier,
      CASE WHEN excl <> '' THEN excl WHEN kept THEN 'no_last_state_work_stopped' ELSE '' END AS exclusion_reason,
      conflict FROM d"""


def _outcomes(t, policy):
    out = O.outcome_from_history(t.trials(STATUS_RULES), policy=policy)
    return out.select("*", *L.as_columns(F.col("label")))


@query(_TRIAL_SPEC, _trial_sql("keep_unobserved"))
def trial_outcomes(t):
    return _outcomes(t, "keep_unobserved")


@query(_TRIAL_SPEC, _trial_sql("drop"))
def trial_outcomes_dropping(t):
    return _outcomes(t, "drop")


@query(_TRIAL_SPEC, _trial_sql("clone_zero"))
def trial_outcomes_first_stage_zero(t):
    return _outcomes(t, "clone_zero")


@query(
    "toggle:s reached:i n:i",
    "SELECT 'stable' AS toggle, reached, count(*) AS n FROM (" + TRIALS_SQL.format(stable=4)
    + " SELECT * FROM trials) GROUP BY reached UNION ALL SELECT 'purify', reached, count(*) FROM ("
    + TRIALS_SQL.format(stable=3) + " SELECT * FROM trials) GROUP BY reached",
)
def structure_rule_toggle(t):
    """Furthest stages with the structure inference on and demoted, in one pass over the history."""
    on, off = status_rules(True), status_rules(False)
    per = t.history().groupBy("target", "day").agg(
        *[
            F.coalesce(F.max(L.stage_index(F.col("status"), r)), F.lit(-1)).alias(name)
            for name, r in (("stable", on), ("purify", off))
        ]
    )
    long = per.selectExpr("stack(2, 'stable', stable, 'purify', purify) as (toggle, reached)")
    return long.groupBy("toggle", "reached").agg(F.count("*").alias("n"))


@query(
    "event_type:s n:i",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'click', 'view') GROUP BY 1",
)
def unknown_status_values(t):
    return O.unknown_values(t("events"), "event_type", ["signup", "click", "view"])


@query(
    "exclusion_reason:s kept:b n:i",
    "SELECT exclusion_reason, exclusion_reason NOT IN ('test_target', 'duplicate_target') AS kept, count(*) AS n"
    f" FROM ({_trial_sql('keep_unobserved')}) GROUP BY ALL",
)
def exclusions_at_pooling(t):
    tagged = _outcomes(t, "keep_unobserved")
    kept = O.drop_excluded(tagged).groupBy("exclusion_reason").agg(F.count("*").alias("k"))
    every = tagged.groupBy("exclusion_reason").agg(F.count("*").alias("n"))
    return every.join(kept, "exclusion_reason", "left").withColumn("kept", F.col("k").isNotNull())


@query(
    "target:i year:i year_first:i",
    """SELECT o_custkey AS target, coalesce(max(year(o_orderdate)) FILTER (o_orderstatus <> 'P'),
        CASE WHEN o_custkey % 2 = 0 THEN 1900 ELSE -1 END) AS year,
      coalesce(min(year(o_orderdate)) FILTER (o_orderstatus <> 'P'), -1) AS year_first
    FROM orders GROUP BY o_custkey""",
)
def year_of_record(t):
    """Year of the last usable date of each history, else of the creation date, else unknown."""
    dates = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    per = t("orders").groupBy(F.col("o_custkey").alias("target")).agg(F.collect_set(dates).alias("dates"))
    created = F.when(F.col("target") % 2 == 0, "1900-01-01").otherwise("unknown")
    return per.select(
        "target", L.year_of_record(F.col("dates"), created).alias("year"),
        L.first_year(F.col("dates")).alias("year_first"),
    )


@query(
    "year:i n:i",
    """SELECT CASE WHEN y BETWEEN 1999 AND 2026 THEN y ELSE -1 END AS year, count(*) AS n
    FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY 1""",
)
def year_range_check(t):
    checked = L.year_or_unknown(F.year("o_orderdate"))
    return t("orders").groupBy(checked.alias("year")).agg(F.count("*").alias("n"))


@query(
    "default_tier:s tier:s n:i",
    f"""WITH {LINES_SQL} SELECT CASE WHEN {" OR ".join(f"{c} = 0" for c in LABELS)} THEN 'explicit'
      ELSE 'none' END AS default_tier, tier, count(*) AS n FROM lines GROUP BY ALL""",
)
def default_evidence_tier(t):
    return t.lines().groupBy(L.default_tier().alias("default_tier"), "tier").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- replicates and assays


@query(
    f"target:i day:s n_replicates:i any_expressed:b any_bound:b any_unbound:b values_seen:s strength_min:d {_SIX_SPEC}",
    f"""WITH {HISTORY_SQL}, a AS (
      SELECT target, day, count(*) AS n_replicates, bool_or(event_type IN ('signup', 'view')) AS any_expressed,
        bool_or(event_type = 'purchase') AS any_bound, bool_or(event_type = 'error') AS any_unbound,
        array_to_string(list_sort(list(DISTINCT event_type)), '/') AS values_seen, min(value) AS strength_min
      FROM hist GROUP BY target, day)
    SELECT *, 1 AS label_clone, any_expressed::INT AS label_express, -1 AS label_soluble, -1 AS label_purify,
      -1 AS label_stable, CASE WHEN NOT any_expressed THEN -1 WHEN any_bound THEN 1 WHEN any_unbound THEN 0
      ELSE -1 END AS label_bind FROM a""",
)
def replicate_outcomes(t):
    binding = F.when(F.col("event_type") == "purchase", "TRUE").when(F.col("event_type") == "error", "False")
    out = O.replicate_consensus(
        t.history(), ["target", "day"], F.upper("event_type"), binding, F.col("value"), ["signup", "view"]
    )
    return out.select(
        "*", F.array_join("expression_values", "/").alias("values_seen"), *L.as_columns(F.col("label"))
    )


_TYPES = {"ECONOMY": "express", "SMALL": "bind", "STANDARD": "stable", "MEDIUM": "DROP", "PROMO": "DROP"}


@query(
    f"stage:s allow_median:b n:i {' '.join(f'fail_{s}:i' for s in STAGES)}",
    "WITH a AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'express' WHEN 'SMALL' THEN 'bind' WHEN 'STANDARD' THEN 'stable' END AS stage,"
    " p_size % 3 <> 0 AS manual, l_returnflag = 'R' AS fail FROM lineitem JOIN part ON l_partkey = p_partkey),"
    " b AS (SELECT *, true AS allow_median FROM a WHERE stage IS NOT NULL UNION ALL"
    " SELECT *, false FROM a WHERE stage IS NOT NULL AND manual)"
    " SELECT stage, allow_median, count(*) AS n, "
    + ", ".join(f"sum((stage = '{s}' AND fail)::INT) AS fail_{s}" for s in STAGES)
    + " FROM b GROUP BY ALL",
)
def assay_outcomes(t):
    """Assays select by type and threshold method; their rows carry one observed stage."""
    meta = t("part").select(
        "p_partkey", F.col("p_type").alias("selection_type"),
        F.when(F.col("p_size") % 3 == 0, "median").otherwise("manual").alias("binarization"),
    )
    rows = t("lineitem").select(
        F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") != "R").cast("int").alias("score_bin")
    )
    parts = []
    for allow in (True, False):
        chosen = O.select_assays(meta, _TYPES, allow)
        labelled = O.assay_labels(rows.join(chosen, "p_partkey"))
        parts.append(
            labelled.groupBy("stage").agg(
                F.count("*").alias("n"), *[F.count_if(F.col(f"label_{s}") == 0).alias(f"fail_{s}") for s in STAGES]
            ).withColumn("allow_median", F.lit(allow))
        )
    return parts[0].unionByName(parts[1])


@query(
    "sign:i n:i n_unparsed:i",
    """WITH a AS (SELECT l_discount - l_tax AS mid, TRY_CAST(l_returnflag AS DOUBLE) AS bad FROM lineitem)
    SELECT CASE WHEN mid + 0.015 < 0 THEN 0 WHEN mid - 0.015 > 0 THEN 1 ELSE -1 END AS sign, count(*) AS n,
      sum((bad IS NULL)::INT) AS n_unparsed FROM a GROUP BY 1""",
)
def interval_signs(t):
    mid = F.col("l_discount") - F.col("l_tax")
    return t("lineitem").groupBy(
        L.confident_sign(mid - 0.015, mid + 0.015).alias("sign")
    ).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_returnflag").try_cast("double").isNull()).alias("n_unparsed"),
    )


@query(
    "center:s key_md5:s n:i",
    """WITH p AS (SELECT source, min(text) FILTER (lang = 'de' AND n_chars > 3000) AS ref,
        min({'n': length(text), 's': text}).s AS fb FROM documents GROUP BY source)
    SELECT d.source AS center, md5(coalesce(ref, fb)) AS key_md5, count(*) AS n
    FROM documents d JOIN p ON p.source = d.source GROUP BY ALL""",
)
def parent_keys(t):
    reference = (F.col("lang") == "de") & (F.col("n_chars") > 3000)
    out = O.parent_key(t("documents"), "source", reference, "text")
    return out.groupBy(F.col("source").alias("center"), F.md5("cluster_key_seq").alias("key_md5")).agg(
        F.count("*").alias("n")
    )


@query(
    "id:s part:i",
    """SELECT CASE WHEN count(*) OVER w1 > 1 THEN concat(rid, '#', row_number() OVER w2 - 1) ELSE rid END AS id,
      l_partkey AS part
    FROM (SELECT *, concat_ws(':', l_orderkey, l_linenumber) AS rid FROM lineitem)
    WINDOW w1 AS (PARTITION BY rid), w2 AS (PARTITION BY rid ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate)""",
)
def unique_record_ids(t):
    rows = t("lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").alias("part"),
        "l_suppkey", "l_extendedprice", "l_shipdate",
    )
    return O.unique_ids(rows, "id", "part", "l_suppkey", "l_extendedprice", "l_shipdate")


# ---------------------------------------------------------------- pooling


@query(
    "source:s label_express:i n:i",
    f"""WITH {DOCS_SQL}, s AS (SELECT *, CASE WHEN id % 2 = 1 THEN 'weak' ELSE 'strong' END AS source FROM docs)
    SELECT source, CASE WHEN source = 'weak' AND text IN (SELECT text FROM s WHERE source = 'strong') THEN -1
      ELSE label_express END AS label_express, count(*) AS n FROM s GROUP BY ALL""",
)
def demoted_duplicates(t):
    s = t.docs().withColumn("source", F.when(F.col("id") % 2 == 1, "weak").otherwise("strong"))
    return O.demote_duplicates(s, "weak", "strong", "text", "label_express").groupBy(
        "source", "label_express"
    ).agg(F.count("*").alias("n"))


def pooled(t):
    """Three sources of different shape as one record table."""
    none = {c: F.lit(-1) for c in LABELS}

    def source(df, name, **cols):
        base = {
            "source": F.lit(name), "center": F.lit(name), "organism": F.lit(""), "target_id": F.lit(""),
            "year": F.lit(-1), "is_designed": F.lit(False), "evidence": F.lit(""), **none,
        }
        return df.select(*[c.alias(n) for n, c in (base | cols).items()])

    docs = source(
        t.docs(), "documents", record_id=F.concat(F.lit("d:"), F.col("id")), sequence=F.col("text"),
        seq_len=F.col("seq_len"), center=F.col("center"), organism=F.col("organism"), year=1995 + F.col("id") % 40,
        label_express=F.col("label_express"), label_soluble=F.col("label_soluble"),
    )
    talk = source(
        t("conversations"), "conversations", record_id=F.concat(F.lit("c:"), F.col("conv_id"), F.lit(":"), F.col("turn")),
        sequence=F.col("text"), seq_len=F.length("text"), is_designed=F.col("role") == "assistant",
        label_bind=F.when(F.col("role") == "assistant", 0).otherwise(1),
    ).withColumn("cluster_key_seq", F.lit(""))
    items = source(
        t("benchmark"), "benchmark", record_id=F.concat(F.lit("b:"), F.col("item_id")), sequence=F.col("text"),
        seq_len=F.length("text"),
    ).withColumn("exclusion_reason", F.when(F.col("record_id").endswith("7"), "duplicate_target").otherwise(""))
    return O.checked(O.unify([docs, talk, items], "documents", "benchmark", "label_express"))


@query(
    "source:s tier:s unknown_year:b both_ok:i n:i n_chars:i",
    f"""WITH {DOCS_SQL}, u AS (
      SELECT 'documents' AS source, text AS seq, 1995 + id % 40 AS year,
        CASE WHEN text IN (SELECT text FROM benchmark WHERE item_id % 10 <> 7) THEN -1 ELSE label_express END AS e,
        label_soluble AS s, CASE WHEN label_express = 0 OR label_soluble = 0 THEN 'explicit' ELSE 'none' END AS tier FROM docs
      UNION ALL SELECT 'conversations', text, -1, -1, -1, CASE WHEN role = 'assistant' THEN 'explicit' ELSE 'none' END FROM conversations
      UNION ALL SELECT 'benchmark', text, -1, -1, -1, 'none' FROM benchmark WHERE item_id % 10 <> 7)
    SELECT source, tier, NOT (year BETWEEN 1999 AND 2026) AS unknown_year,
      CASE WHEN e = 1 AND s = 1 THEN 1 WHEN e = 0 OR (e = 1 AND s = 0) THEN 0 ELSE -1 END AS both_ok,
      count(*) AS n, sum(length(seq)) AS n_chars FROM u GROUP BY ALL""",
)
def pooled_records(t):
    return pooled(t).groupBy(
        "source", F.col("evidence_tier").alias("tier"), (F.col("year") == -1).alias("unknown_year"),
        F.col("label_soluble_expression").alias("both_ok"),
    ).agg(F.count("*").alias("n"), F.sum(F.length("cluster_key_seq")).alias("n_chars"))


@query(
    "n_missing:i n_matched:i",
    "SELECT sum((l.doc_id IS NULL)::INT) AS n_missing, sum((l.doc_id IS NOT NULL)::INT) AS n_matched"
    " FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id",
)
def join_completeness(t):
    missing = O.unmatched(t("documents"), t("labels"), "doc_id").agg(F.count("*").alias("n_missing"))
    matched = t("documents").join(t("labels"), "doc_id", "left_semi").agg(F.count("*").alias("n_matched"))
    return missing.join(F.broadcast(matched))
