import pytest
from pyspark.sql import functions as F

from tristage.functions import labels as L
from tristage.operators import labels as O
from tristage.schema import LABELS, STAGE_INDEX


def vector(spark, reached=None, failed=None, **extra):
    r, f = (F.lit(STAGE_INDEX[x] if x else None).cast("int") for x in (reached, failed))
    return spark.range(1).select(L.make_label(r, f, extra or None).alias("v")).first()["v"]


def valid(spark, v):
    return spark.createDataFrame([(v,)], "v array<int>").select(L.is_valid(F.col("v"))).first()[0]


def test_make_label(spark):
    assert vector(spark, "clone", "express") == [1, 0, -1, -1, -1, -1]
    assert vector(spark, "bind") == [1] * 6
    assert vector(spark, stable=0) == [-1, -1, -1, -1, 0, -1]
    assert vector(spark, "soluble", "express") is None  # contradiction


@pytest.mark.parametrize(
    "v,ok",
    [
        ([1, 0, 1, -1, -1, -1], False), ([1, 0, 0, -1, -1, -1], False), ([2, -1, -1, -1, -1, -1], False),
        ([1, 1, 1], False), ([1, 1, -1, 0, -1, 1], False), (None, False),
        ([1, 1, -1, -1, -1, 1], True), ([1, 1, -1, -1, -1, 0], True), ([-1, -1, 1, 0, -1, -1], True),
    ],
)
def test_is_valid(spark, v, ok):
    assert valid(spark, v) is ok


def test_fill_success_prefix(spark):
    df = spark.createDataFrame([([-1, -1, 1, -1, -1, -1],), ([-1] * 6,), ([-1, 1, 0, -1, -1, -1],)], "v array<int>")
    out = [r[0] for r in df.select(L.fill_success_prefix(F.col("v"))).collect()]
    assert out == [[1, 1, 1, -1, -1, -1], [-1] * 6, [1, 1, 0, -1, -1, -1]]


def outcomes(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id int, reached int, status string, stop_status string")
    out = O.outcome_from_history(df, **kw)
    return {r["id"]: r for r in out.collect()}


def test_history_rules(spark):
    rows = [
        (1, 2, "soluble", "expression failed"),        # the history wins
        (2, 0, "cloned", "expression failed"),          # explicit
        (3, 1, "work stopped", "other"),                # inferred next step
        (4, -1, "work stopped", ""),                    # nothing known
        (5, 5, "work stopped", ""),                     # no next stage
        (6, 3, "test target", "purification failed"),   # excluded
        (7, 3, "purified", "PDB duplicate found"),      # excluded
        (8, 2, "work stopped", "cloning failed"),       # conflict, then inferred
    ]
    o = outcomes(spark, rows)
    assert o[1]["conflict"] and o[1]["label"] == [1, 1, 1, -1, -1, -1] and o[1]["evidence_tier"] == "none"
    assert o[2]["label"] == [1, 0, -1, -1, -1, -1] and o[2]["evidence_tier"] == "explicit"
    assert o[3]["label"] == [1, 1, 0, -1, -1, -1] and o[3]["evidence_tier"] == "inferred_next_step"
    assert o[4]["label"] == [-1] * 6 and o[4]["exclusion_reason"] == "no_last_state_work_stopped"
    assert o[5]["label"] == [1] * 6 and o[5]["evidence_tier"] == "none"
    assert o[6]["label"] == [-1] * 6 and o[6]["exclusion_reason"] == "test_target"
    assert o[7]["exclusion_reason"] == "duplicate_target"
    assert o[8]["conflict"] and o[8]["label"] == [1, 1, 1, 0, -1, -1]
    assert 4 not in outcomes(spark, rows, policy="drop")
    assert outcomes(spark, rows, policy="clone_zero")[4]["label"] == [0, -1, -1, -1, -1, -1]
    assert outcomes(spark, rows, infer_next_step=False)[3]["label"] == [1, 1, -1, -1, -1, -1]
    with pytest.raises(ValueError):
        outcomes(spark, rows, policy="guess")


def test_guards(spark):
    df = spark.createDataFrame([("True",), ("Ture",), (None,)], "m string")
    assert O.require_domain(df, "m", ["True", "Ture", "False"]).count() == 3
    with pytest.raises(O.InvalidData):
        O.require_domain(df, "m", ["True"])
    bad = spark.createDataFrame([(1, 0, 1, -1, -1, -1)], ", ".join(f"{c} int" for c in LABELS))
    with pytest.raises(O.InvalidData):
        O.require_valid(bad)
    with pytest.raises(Exception, match="invalid label vector"):
        O.checked(bad).collect()
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(O.InvalidData):
        O.require_matched(left, spark.createDataFrame([(1, "a")], "k int, v string"), "k")


def test_parent_key_and_ids(spark):
    df = spark.createDataFrame(
        [("p", True, "CCC"), ("p", False, "AAAA"), ("q", False, "BBBB"), ("q", False, "ZZ")],
        "parent string, wt boolean, seq string",
    )
    keys = {r["seq"]: r["cluster_key_seq"] for r in O.parent_key(df, "parent", F.col("wt"), "seq").collect()}
    assert keys == {"CCC": "CCC", "AAAA": "CCC", "BBBB": "ZZ", "ZZ": "ZZ"}
    alpha = O.parent_key(df, "parent", F.col("wt"), "seq", shortest=False)
    assert {r["cluster_key_seq"] for r in alpha.where("parent = 'q'").collect()} == {"BBBB"}
    rep = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n int")
    assert sorted(r["id"] for r in O.unique_ids(rep, "id", "n").collect()) == ["a#0", "a#1", "b"]
