import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tristage.functions.numeric import hypergeometric_cdf, two_sided_p
from tristage.operators import metrics as M
from tristage.operators import ordering as O
from tristage.operators import stats as S
from tristage.operators.ordering import dense_index, exact_quantiles, join_groups, running


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_matches_brute_force(spark, partitions):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", rnd.random(), rnd.randrange(5)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k double, n bigint").repartition(partitions)
    got = {(r["g"], r["k"]): (r["cum_n"], r["total_n"]) for r in running(df, ["g"], "k", ["n"], n_buckets=8).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((k, n) for h, k, n in rows if h == g)
        acc, total = 0, sum(n for _, n in own)
        for k, n in own:
            acc += n
            assert got[(g, k)] == (acc, total)


def test_dense_index_and_quantiles(spark):
    df = spark.createDataFrame([(w,) for w in ["b", "a", "c", "a", "Z"]], "w string")
    assert {r["w"]: r["i"] for r in dense_index(df, "w", "i").collect()} == {"Z": 0, "a": 1, "b": 2, "c": 3}
    q = exact_quantiles(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), [], "v", {"q25": 0.25, "q50": 0.5})
    assert tuple(q.first()) == (1.75, 2.5)


def scores(spark, y, s):
    return spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(y, s))], "id int, y int, score double")


def test_metric_golden_cases(spark):
    y, s = [1, 1, 1] + [0] * 7, [9, 8, 7] + [1] * 7
    r = M.evaluate(scores(spark, y, s), (3, 20)).first()
    assert (r["precision_at_3"], r["recall_at_3"], r["pr_auc"]) == (1, 1, 1)
    assert r["base_rate"] == pytest.approx(0.3) and r["lift_at_3"] == pytest.approx(1 / 0.3)
    assert r["precision_at_20"] is None and r["recall_at_20"] is None
    flipped = M.evaluate(scores(spark, y, [-x for x in s]), (3,)).first()
    assert flipped["precision_at_3"] == 0
    single = M.evaluate(scores(spark, [1, 1], [1, 2]), (1,)).first()
    assert single["pr_auc"] is None
    rnd = random.Random(1)
    many = [int(rnd.random() < 0.8) for _ in range(500)]
    noisy = [v + rnd.gauss(0, 0.5) for v in many]
    r = M.average_precision(scores(spark, many, noisy), []).first()
    assert r["pr_auc"] > 0.9 and r["pr_auc_over_base"] < 1.3


def test_resolution_matches_published_values(spark):
    rows = [(791, 263, 45), (834, 256, 38), (850, 239, 37)]
    df = spark.createDataFrame(rows, "n bigint, p bigint, x int")
    out = [r[0] for r in df.select(hypergeometric_cdf(F.col("x"), F.col("n"), F.col("p"), 100)).collect()]
    assert out == pytest.approx([0.996867449367835, 0.9626495372091807, 0.9853371710952763], rel=1e-9)


@pytest.mark.parametrize("n_buckets", [None, 65, 5000])
def test_order_over_many_buckets(spark, n_buckets, monkeypatch):
    monkeypatch.setattr(O, "SPAN", 7)
    rnd = random.Random(4)
    keys = rnd.sample(range(10**6), 6000)
    df = spark.createDataFrame([(k, k % 7, "g" if i % 3 else None) for i, k in enumerate(keys)], "k long, n long, g string").repartition(5)
    bucketed = O.with_buckets(df, ["g"], "k", n_buckets)
    spans = bucketed.groupBy("g", "_bucket").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("g", "_bucket").collect()
    assert len(spans) > (100 if n_buckets != 65 else 60)
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]) if a["g"] == b["g"])
    got = {r["k"]: (r["cum_n"], r["total_n"]) for r in running(df, ["g"], "k", ["n"], n_buckets=n_buckets).collect()}
    assert len(got) == len(keys)
    for own in (sorted(k for i, k in enumerate(keys) if i % 3), sorted(k for i, k in enumerate(keys) if i % 3 == 0)):
        sums = list(itertools.accumulate(k % 7 for k in own))
        assert all(got[k] == (s, sums[-1]) for k, s in zip(own, sums))
    ids = {r["k"]: r["at"] for r in dense_index(df.select("k"), "k", "at").collect()}
    assert ids == {k: i for i, k in enumerate(sorted(keys))}


def test_two_sided_p(spark):
    zs = [0.0, 0.5, 1.96, 3.0, 3.6, 5.0, 9.3, -9.3]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select(two_sided_p(F.col("z")))
    got = [r[0] for r in df.collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=1e-9)


def test_bootstrap_resamples_whole_groups(spark):
    rnd = random.Random(5)
    rows = [(i, i // 5, int(rnd.random() < 0.4), rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g int, y int, score double")
    draws = S.bootstrap_draws(dense_index(df, "g", "index"), [], 30, [1, 2])
    per = draws.groupBy("seed", "rep").agg(F.sum("mult").alias("m")).collect()
    assert len(per) == 60 and {r["m"] for r in per} == {40}
    one = S.cluster_bootstrap(df, "g", 20, [1]).orderBy("rep").collect()
    two = S.cluster_bootstrap(df.repartition(5), "g", 20, [1], n_buckets=3).orderBy("rep").collect()
    assert [r["lift"] for r in one] == [r["lift"] for r in two]
    assert [r["pr_auc_over_base"] for r in one] == pytest.approx([r["pr_auc_over_base"] for r in two])


def _plain_bootstrap(rows, n_boot, seed, k, prefix=""):
    """(rep, PR-AUC/base, lift) of rows (id, group, y, score), drawn and counted one by one."""
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, g))
    out = []
    for rep in range(n_boot):
        text = [f"{seed}{prefix}:{rep}:{i}".encode() for i in range(len(groups))]
        drawn = [int.from_bytes(hashlib.sha256(x).digest()[:8], "big") % len(groups) for x in text]
        times = Counter(groups[g] for g in drawn)
        own = sorted(((r, times[r[1]]) for r in rows if times[r[1]]), key=lambda x: (-x[0][3], x[0][0]))
        n, pos = sum(m for _, m in own), sum(m * r[2] for r, m in own)
        if not 0 < pos < n:
            continue
        ap = seen = hits = 0
        for _, cell in itertools.groupby(own, lambda x: x[0][3]):
            cell = list(cell)
            here = sum(m * r[2] for r, m in cell)
            seen, hits = seen + sum(m for _, m in cell), hits + here
            ap += here * hits / seen
        flat = [r[2] for r, m in own for _ in range(m)]
        out.append((rep, ap / pos / (pos / n), sum(flat[:k]) / k / (pos / n) if n >= k else None))
    return out


@pytest.mark.parametrize("n_buckets", [None, 3])
def test_bootstrap_is_that_of_rows_drawn_one_by_one(spark, n_buckets, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 7)  # scores go on over parts
    rnd = random.Random(9)
    rows = []
    for fold in ("a", "b", None):
        for i in range(90):
            group = None if rnd.random() < 0.3 else rnd.randrange(12)
            rows.append((fold, i, group, int(rnd.random() < 0.3), float(rnd.randrange(25))))
    rows += [("one class", i, i % 3, 1, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "fold string, id int, g int, y int, score double").repartition(4)
    both = df.withColumn("run", F.lit("up")).unionByName(df.withColumns({"run": F.lit("down"), "score": -F.col("score")}))
    got = S.cluster_bootstrap(both, "g", 25, [4, 5], ["fold"], k=30, n_buckets=n_buckets, run="run").collect()
    found = {(r["fold"], r["run"], r["seed"], r["rep"]): (r["pr_auc_over_base"], r["lift"]) for r in got}
    assert len(found) == len(got)
    want = {}
    for fold in ("a", "b", None, "one class"):
        for run, sign in (("up", 1), ("down", -1)):
            own = [(i, g, y, sign * s) for f, i, g, y, s in rows if f == fold]
            for seed in (4, 5):
                prefix = "" if fold is None else f":{fold}"
                want |= {(fold, run, seed, rep): (v, lift) for rep, v, lift in _plain_bootstrap(own, 25, seed, 30, prefix)}
    assert set(found) == set(want)
    for key, (value, lift) in want.items():
        assert found[key][0] == pytest.approx(value) and found[key][1] == pytest.approx(lift)


def test_other_seeds_are_drawn_only_where_the_class_depends_on_them(spark):
    rnd = random.Random(3)
    rows = []
    for fold, pull in (("clear", 0.6), ("noise", 0.0), (None, 0.6)):
        for i in range(120):
            y = int(rnd.random() < 0.4)
            rows.append((fold, "up", i, i // 2, y, rnd.random() + pull * y))
            rows.append((fold, "flat", i, i // 2, y, rnd.random()))
    df = spark.createDataFrame(rows, "fold string, run string, id int, g int, y int, score double")
    seeds, own = [4, 5, 6], ["fold", "run"]

    def found(asked=None):
        got = S.fold_intervals(df, "g", ["fold"], 40, seeds, run="run", asked=asked).collect()
        return {(r["fold"], r["run"]): (r["lo"], r["hi"], r["effect_class"], r["n_seeds"]) for r in got}

    cis = S.percentile_ci(S.cluster_bootstrap(df, "g", 40, seeds, ["fold"], run="run"), [*own, "seed"])
    first = join_groups(cis.where("seed = 4").select(*own, "lo", "hi"), S.seed_stability(cis, own), own)
    point = M.average_precision(df, own).select(*own, F.col("pr_auc_over_base").alias("point"))
    want = S.classify(join_groups(first, point, own)).collect()
    got = found()
    assert len(got) == len(want) == 6
    for r in want:
        lo, hi, name, _ = got[r["fold"], r["run"]]
        assert (lo, hi) == (pytest.approx(r["lo"]), pytest.approx(r["hi"])) and name == r["effect_class"]
    assert {k: v[3] for k, v in got.items()} == {(r["fold"], r["run"]): 1 if r["crosses_1"] else 3 for r in want}
    assert {v[3] for v in got.values()} == {1, 3}
    main = found(lambda iv: iv.where("run = 'up' and not crosses_1"))
    assert {k: v[3] for k, v in main.items()} == {k: v[3] if k[1] == "up" else 1 for k, v in got.items()}
    assert {v[3] for v in found(lambda iv: iv.where("false")).values()} == {1}


def test_blocks_of_large_and_small_keys_take_about_the_same_draws(spark):
    sizes = spark.createDataFrame([("large", 100_000), ("small", 500), ("one", 1)], "fold string, n_groups long")
    blocks, n = S._in_blocks(sizes, 2000, 5)
    got = {r["fold"]: r["block"] for r in blocks.collect()}
    slots = S.BLOCKS * spark.sparkContext.defaultParallelism
    assert got["large"] * 100_000 <= 1.1 * 100_501 * 10_000 / slots + 100_000
    assert got["small"] == got["one"] == S.REPS and n == 5 * (-(-2000 // got["large"]) + 20)
    assert S._in_blocks(sizes.where("false"), 2000, 5)[1] == 0


def test_bootstrap_of_no_rows(spark):
    empty = spark.createDataFrame([], "id int, g int, y int, score double")
    assert S.cluster_bootstrap(empty, "g", 5, [1]).count() == 0


def test_verdict_classes(spark):
    rows = [("a", 1.2, 1.1, 1.3, True), ("b", 1.05, 1.02, 1.08, True), ("c", 1.0, 0.9, 1.1, True),
            ("d", 0.8, 0.7, 0.9, True), ("e", 1.3, 1.2, 1.4, False)]
    df = S.classify(spark.createDataFrame(rows, "fold string, point double, lo double, hi double, stable boolean"))
    got = {r["fold"]: r["effect_class"] for r in df.collect()}
    assert got == {"a": "real", "b": "weak", "c": "indistinguishable", "d": "reversed", "e": "indistinguishable"}
    other = spark.createDataFrame([("a", True)], "fold string, crosses_1 boolean")
    assert S.downgrade(df, other, ["fold"]).where("fold = 'a'").first()["effect_class"] == "borderline"


def test_null_groups_are_groups(spark):
    rows = [(None, 0.9, 1), (None, 0.1, 0), ("g", 0.8, 0), ("g", 0.7, 1)]
    out = M.average_precision(spark.createDataFrame(rows, "g string, score double, y int"), ["g"]).collect()
    assert {r["g"]: (r["n_rows"], r["pr_auc"]) for r in out} == {None: (2, 1.0), "g": (2, 0.5)}


def test_multiplicities_take_a_byte_unless_a_group_is_drawn_more_often(monkeypatch):
    got = S._multiplicities("7:f", 3, 2, 500)
    want = [Counter(int.from_bytes(hashlib.sha256(f"7:f:{r}:{i}".encode()).digest()[:8], "big") % 500 for i in range(500)) for r in (3, 4)]
    assert got.dtype.itemsize == 1 and got.T.tolist() == [[c[i] for i in range(500)] for c in want]
    monkeypatch.setattr(S, "sha256", lambda x: hashlib.sha256(b"the same"))
    assert sorted(S._multiplicities("7:f", 3, 2, 500)[:, 1].tolist())[-2:] == [0, 500]
