"""Features, baselines, importance, batch identity, and cross- against within-batch training."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tristage.functions.hashing import keyed, modulo
from tristage.functions.text import RESIDUES20
from tristage.operators import metrics as M
from tristage.operators import models as D
from tristage.operators import splits as P
from tristage.plans.registry import query
from tristage.plans.split_queries import SEED
from tristage.session import cut

ROUNDS = 300  # of boosting at most; a validation tenth stops it early
_NAMES = D.feature_names()
_AT = "n_rows:i n_positive:i base_rate:d pr_auc:d pr_auc_over_base:d precision_at_10:d lift_at_10:d"


@query(
    "id:i " + " ".join(f"{n}:d" for n in _NAMES),
    "SELECT doc_id AS id, length(u) AS seq_len, ln(1 + length(u)) AS log_seq_len, "
    + ", ".join(f"(length(u) - length(replace(u, '{a}', ''))) / length(u) AS aa_{a}" for a in RESIDUES20)
    + " FROM (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS u FROM documents)",
)
def feature_table(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), F.upper("text").alias("text"))
    return D.features(docs, "text", strip=False).select("id", *_NAMES)


def labelled_docs(t):
    """Labelled texts split by group into train and test."""
    docs = t.docs().where("label_express <> -1")
    return P.hash_split(docs, "grp", SEED, (0.6, 0.0))


@query(f"{_AT} reason:s")
def baseline_stage(t):
    """One stage of one split: representatives, tree baseline, metrics or the reason for none."""
    result, reason, _ = D.run_stage(
        labelled_docs(t), "label_express", "grp", "text", "id", SEED,
        min_train=50, min_test=20, min_train_fail=5, min_test_fail=2, ks=(10,), max_iter=ROUNDS,
    )
    if result is None:
        return t("labels").agg(F.count("*").alias("n_rows"), F.lit(reason).alias("reason")).select(
            "*", *[F.lit(None).alias(c.split(":")[0]) for c in _AT.split()[1:]]
        )
    return result.withColumn("reason", F.lit(reason))


def _importance(t):
    docs = labelled_docs(t).withColumn("y", (F.col("label_express") == 0).cast("int"))
    x = cut(D.features(docs, "text", upper=True))
    model = D.fit_baseline(x.where("split = 'train'"), SEED, max_iter=ROUNDS)
    return D.permutation_importance(model, x.where("split = 'test'"), _NAMES, n_repeats=10, seed=SEED)


@query("feature:s mean_drop:d std_drop:d")
def feature_importance(t):
    return _importance(t)


@query("seq_len_share:d")
def importance_of_length(t):
    """How much of the positive importance the two length features hold."""
    return D.length_share(cut(_importance(t)))


def _vectors(t):
    return t("embeddings").select(
        F.col("vec_id").alias("id"), "embedding", (F.col("label") < 3).cast("int").alias("y"),
        F.concat(F.lit("batch"), F.col("vec_id") % 10).alias("center"),
        F.floor(F.col("vec_id") / 13).alias("grp"), F.col("label").cast("string").alias("class"),
    )


@query(_AT)
def embedding_head(t):
    part = modulo(keyed(SEED, "head", F.col("grp")), 4)
    v = _vectors(t)
    model = D.embedding_head(v.where(part != 0))
    return M.evaluate(D.score_embeddings(model, v.where(part == 0)), (10,))


@query("n_test:i accuracy:d majority_share:d gain:d")
def batch_identity(t):
    """How far the vectors give away their class, the role of the batch here."""
    return D.identity_probe(_vectors(t), "class", "embedding", "id", SEED)


@query(_AT)
def perceptron_head(t):
    part = modulo(keyed(SEED, "head", F.col("grp")), 4)
    v = _vectors(t)
    model = D.perceptron_head(v.where(part != 0), hidden=32, seed=SEED % 1000)
    return M.evaluate(D.score_embeddings(model, v.where(part == 0)), (10,))


def _held_batches(t, k):
    v = _vectors(t)
    sizes = v.groupBy("center").agg(F.count("*").alias("n"))
    folds = P.greedy_folds(sizes, "center", "n", k)
    # Groups of 13 consecutive ids span all batches; coarser ones would leave no training rows.
    v = v.withColumn("grp", F.floor(F.col("id") / 2) * 2 + F.when(F.col("id") % 8 == 0, 0).otherwise(F.col("id") % 2))
    return P.fold_train_test(v, folds, "center", "grp", k)


_SMALL = {"min_test": 10, "min_positives": 2, "min_within": 20, "min_within_positives": 4}


@query(f"fold:i inner:i regime:s {_AT}")
def cross_against_within(t):
    """Five folds of held batches with three inner folds each."""
    return D.cross_vs_within(
        _held_batches(t, 5), "grp", D.embedding_head, D.score_embeddings, k_inner=3, seed=SEED, ks=(10,), **_SMALL
    )


@query(f"fold:i inner:i regime:s {_AT}")
def cross_against_within_trees(t):
    """The tree baseline in the same place, on the vectors' components."""
    def fit(rows):
        return D.fit_baseline(rows.withColumn("features", array_to_vector("embedding")), SEED, max_iter=ROUNDS)

    return D.cross_vs_within(_held_batches(t, 2), "grp", fit, D.score_embeddings, k_inner=3, seed=SEED, ks=(10,), **_SMALL)
