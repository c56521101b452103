"""Model operators on data whose answer is known."""

import random

import pytest
from pyspark.sql import functions as F

from tristage.operators import models as D


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        y = int(i % 4 == 0)
        rows.append((i, i // 3, f"b{i % 4}", [rng.gauss(2.0 * y, 0.5), rng.gauss(0, 1), float(i % 4)], y))
    return spark.createDataFrame(rows, "id bigint, grp bigint, center string, embedding array<double>, y int").cache()


def test_embedding_head_separates(vectors):
    model = D.embedding_head(vectors.where("id % 5 <> 0"))
    scored = D.score_embeddings(model, vectors.where("id % 5 = 0"))
    right = scored.select(F.avg(((F.col("score") > 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
    assert right > 0.9 and "features" not in scored.columns


def test_perceptron_learns_what_no_line_parts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        a, b = rng.choice([-1.0, 1.0]), rng.choice([-1.0, 1.0])
        y = int(a * b > 0)
        if y and rng.random() < 0.6:  # the positives are the rarer class
            continue
        rows.append((i, [a + rng.gauss(0, 0.15), b + rng.gauss(0, 0.15)], y))
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, y int").cache()
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")

    def right(model):
        scored = D.score_embeddings(model, test)
        return scored.select(F.avg(((F.col("score") > 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]

    assert right(D.embedding_head(train)) < 0.8 < 0.95 < right(D.perceptron_head(train, hidden=8, seed=3))
    with pytest.raises(ValueError):
        D.perceptron_head(train.limit(0))


def test_cross_against_within_scores_the_same_rows(spark):
    """In every batch the class follows a sign of the batch's own: only its own rows teach it."""
    rng = random.Random(6)
    rows = []
    for i in range(800):
        fold, side, y = i % 2, ("test", "train")[i // 2 % 2], i // 4 % 2
        sign = 1 if side == "test" else -1
        rows.append((i, i // 8, fold, side, [sign * (2 * y - 1) + rng.gauss(0, 0.3)], y))
    df = spark.createDataFrame(rows, "id bigint, grp bigint, fold int, side string, embedding array<double>, y int")
    out = D.cross_vs_within(
        df, "grp", D.embedding_head, D.score_embeddings, k_inner=2, min_test=20, min_positives=5, min_within=20, min_within_positives=5, ks=(10,)
    ).collect()
    got = {(r["fold"], r["inner"], r["regime"]): r for r in out}
    assert len(got) == 8
    for fold in (0, 1):
        for inner in (0, 1):
            cross, within = got[fold, inner, "cross"], got[fold, inner, "within"]
            assert (cross["n_rows"], cross["n_positive"]) == (within["n_rows"], within["n_positive"])
            assert within["pr_auc"] > 0.9 > 0.6 > cross["pr_auc"]
    with pytest.raises(ValueError):
        D.cross_vs_within(df, "grp", D.embedding_head, D.score_embeddings, min_test=10_000)


def test_identity_probe_names_the_batch(vectors):
    row = D.identity_probe(vectors, "center", "embedding", "id", 3).first()
    assert row["n_test"] > 50 and row["accuracy"] > 0.9 and abs(row["gain"] - (row["accuracy"] - row["majority_share"])) < 1e-12


def test_stage_is_skipped_with_a_reason(spark):
    rows = [(i, "train" if i % 2 else "test", i, "MKV" * (i % 7 + 1), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, split string, grp bigint, seq string, label int")
    result, reason, scored = D.run_stage(df, "label", "grp", "seq", "id", 1)
    assert result is None and scored is None and reason == "too few rows (train=20, test=20)"
    result, reason, _ = D.run_stage(df, "label", "grp", "seq", "id", 1, min_train=5, min_test=5)
    assert result is None and reason.startswith("too few failures")


def test_importance_goes_to_what_decides(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        y = int(i % 2 == 0)
        n = rng.randint(30, 60) if y else rng.randint(90, 120)
        rows.append((i, "".join(rng.choice("MKVLA") for _ in range(n)), y))
    df = spark.createDataFrame(rows, "id bigint, seq string, y int")
    x = D.features(df, "seq", letters="MK")
    model = D.fit_baseline(x, 1, max_iter=3, depth=2)
    names = D.feature_names(letters="MK")
    drops = D.permutation_importance(model, x, names, n_repeats=2, seed=1)
    got = {r["feature"]: r["mean_drop"] for r in drops.collect()}
    assert set(got) == set(names) and max(got["seq_len"], got["log_seq_len"]) > max(got["aa_M"], got["aa_K"])
    assert D.length_share(drops).first()["seq_len_share"] > 0.9


def test_size_ratio_of_an_empty_side(spark):
    rows = [(0, "train"), (0, "train"), (0, "test"), (1, "train")]
    got = {r["fold"]: tuple(r)[1:] for r in D.size_ratio(spark.createDataFrame(rows, "fold int, side string")).collect()}
    assert got == {0: (2, 1, 2.0), 1: (1, 0, None)}
