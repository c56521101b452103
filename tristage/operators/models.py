"""Baselines on Spark MLlib: features, tree and linear models, importance, batch identity."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tristage.functions import text as T
from tristage.functions.hashing import keyed, modulo, uniform
from tristage.operators.metrics import KS, average_precision, evaluate
from tristage.operators.ordering import running
from tristage.operators.splits import representative
from tristage.session import cut


def feature_names(seq_len: bool = True, log_len: bool = True, letters: str = T.RESIDUES20) -> list[str]:
    names = ["seq_len"] * seq_len + ["log_seq_len"] * log_len
    return names + [f"aa_{a}" for a in letters]


def features(
    df: DataFrame, seq: str, strip: bool = True, seq_len: bool = True, log_len: bool = True,
    letters: str = T.RESIDUES20, upper: bool = False,
) -> DataFrame:
    """Length, log length and letter frequencies as columns and as one vector ``features``."""
    text = T.strip_patterns(F.col(seq)) if strip else F.col(seq)
    df = df.withColumn("_seq", F.upper(text) if upper else text)
    cols = []
    if seq_len:
        cols.append(F.length("_seq").cast("double").alias("seq_len"))
    if log_len:
        cols.append(F.log1p(F.length("_seq").cast("double")).alias("log_seq_len"))
    cols += T.composition(F.col("_seq"), letters)
    names = feature_names(seq_len, log_len, letters)
    out = df.select(*[c for c in df.columns if c not in (*names, "_seq")], *cols)
    return VectorAssembler(inputCols=names, outputCol="features").transform(out)


def probability(model, df: DataFrame, score: str = "score") -> DataFrame:
    """Score = probability of the positive class; the raw model columns are dropped."""
    out = model.transform(df)
    return out.withColumn(score, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def fit_baseline(
    train: DataFrame, seed: int, max_iter: int = 20, depth: int = 5, step: float = 0.1,
    validation: float = 0.1, id_col: str = "id",
):
    """Gradient-boosted trees with early stopping on a fixed tenth of the training rows."""
    marked = train.select(
        "features", F.col("y").cast("double").alias("label"),
        (uniform(keyed(seed, "validation", F.col(id_col))) < validation).alias("_validate"),
    )
    model = GBTClassifier(
        maxIter=max_iter, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="_validate",
        featuresCol="features", labelCol="label",
    )
    return model.fit(cut(marked))


def embedding_head(train: DataFrame, emb: str = "embedding", reg: float = 1e-4, max_iter: int = 50):
    """Class-weighted linear head on stored vectors: positives weigh negatives/positives."""
    counts = train.agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    weighted = train.join(F.broadcast(counts)).select(
        array_to_vector(emb).alias("features"), F.col("y").cast("double").alias("label"),
        F.when(F.col("y") == 1, (F.col("n") - F.col("p")) / F.greatest("p", F.lit(1)))
        .otherwise(1.0).alias("w"),
    )
    return LogisticRegression(weightCol="w", regParam=reg, maxIter=max_iter).fit(weighted)


def perceptron_head(
    train: DataFrame, emb: str = "embedding", hidden: int = 256, max_iter: int = 100, seed: int = 0
):
    """A head with one hidden layer on stored vectors. Its learner takes no weights, so rows of the
    rarer class are repeated, as often as the other class outnumbers it (rounded)."""
    p, n, width = train.agg(F.sum("y"), F.count("*"), F.max(F.size(emb))).first()
    if not n:
        raise ValueError("no rows to learn from")
    ratio = max(1, round(max(p, n - p) / max(1, min(p, n - p))))
    rarer = F.col("y") == (1 if p <= n - p else 0)
    times = F.explode(F.array_repeat(F.lit(1), F.when(rarer, ratio).otherwise(1)))
    rows = train.select(array_to_vector(emb).alias("features"), F.col("y").cast("double").alias("label"), times)
    # The outcomes differ with the sigmoid's start only, which the seed fixes.
    learner = MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=max_iter, seed=seed, blockSize=256)
    return learner.fit(cut(rows.select("features", "label")))


def score_embeddings(model, df: DataFrame, emb: str = "embedding") -> DataFrame:
    return probability(model, df.withColumn("features", array_to_vector(emb))).drop("features")


def run_stage(
    records: DataFrame, stage_label: str, group: str, seq: str, id_col: str, seed: int,
    min_train: int = 500, min_test: int = 200, min_train_fail: int = 50, min_test_fail: int = 20,
    ks: tuple[int, ...] = KS, **model_args,
) -> tuple[DataFrame | None, str, DataFrame | None]:
    """Train and score one stage of one split: (metrics, reason when skipped, scored test rows).

    ``records`` carries ``split``. Unobserved rows leave, each group keeps one representative per
    side, and small or one-sided data is skipped with a reason instead of a number.
    """
    d = records.where((F.col(stage_label) != -1) & F.col("split").isin("train", "test"))
    d = representative(d, ["split", group], id_col, seed).withColumn(
        "y", (F.col(stage_label) == 0).cast("int")
    )
    d = cut(d.select(F.col(id_col).alias("id"), "split", group, seq, "y"))
    n = {r["split"]: r for r in d.groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("f")).collect()}
    sizes = {s: (n[s]["n"], n[s]["f"]) if s in n else (0, 0) for s in ("train", "test")}
    if sizes["train"][0] < min_train or sizes["test"][0] < min_test:
        return None, f"too few rows (train={sizes['train'][0]}, test={sizes['test'][0]})", None
    if sizes["train"][1] < min_train_fail or sizes["test"][1] < min_test_fail:
        return None, f"too few failures (train={sizes['train'][1]}, test={sizes['test'][1]})", None
    x = features(d, seq, upper=True)
    model = fit_baseline(x.where("split = 'train'"), seed, **model_args)
    scored = cut(probability(model, x.where("split = 'test'")))
    return evaluate(scored, ks), "", scored


def permutation_importance(
    model, test: DataFrame, names: list[str], n_repeats: int = 10, seed: int = 0, id_col: str = "id"
) -> DataFrame:
    """Mean and spread of the drop in average precision when one feature is shuffled.

    Per repeat one donor row is drawn for every row by matching ranks of two hashes (a random
    permutation), so shuffling is a join on the rank. All repeats and features form one table.
    """
    base = cut(test.select(F.col(id_col).alias("id"), "y", *names))
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("rep")

    def ranked(tag, cols):
        h = F.struct(
            F.xxhash64(F.lit(seed), F.lit(tag), F.col("rep"), F.col("id")).alias("h"), F.col("id").alias("i")
        )
        keyed_rows = base.select(reps, "id", *cols).withColumns({"_k": h, "_one": F.lit(1)})
        return running(keyed_rows, ["rep"], "_k", ["_one"]).drop("_k", "_one")

    rows = ranked("row", ["y", *names])
    donors = ranked("donor", names).select(
        "rep", "cum__one", *[F.col(c).alias(f"_d_{c}") for c in names]
    )
    paired = rows.join(donors, ["rep", "cum__one"])
    variants = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.array(*[F.col(f"_d_{c}") if c == f else F.col(c) for c in names]).alias("x"),
            )
            for f in names
        ]
    )
    shuffled = paired.select("rep", "id", "y", F.explode(variants).alias("v")).select(
        "rep", "id", "y", "v.feature", array_to_vector("v.x").alias("features")
    )
    ap = average_precision(probability(model, shuffled), ["feature", "rep"])
    plain = base.select("id", "y", array_to_vector(F.array(*names)).alias("features"))
    reference = average_precision(probability(model, plain), []).select(F.col("pr_auc").alias("_ref"))
    drop = F.col("_ref") - F.col("pr_auc")
    return ap.join(F.broadcast(reference)).groupBy("feature").agg(
        F.avg(drop).alias("mean_drop"), F.stddev_pop(drop).alias("std_drop")
    )


def length_share(importance: DataFrame) -> DataFrame:
    """Share of the positive importance that the length features hold."""
    gain = F.greatest(F.col("mean_drop"), F.lit(0.0))
    of_length = F.when(F.col("feature").isin("seq_len", "log_seq_len"), gain).otherwise(0.0)
    return importance.agg(F.try_divide(F.sum(of_length), F.sum(gain)).alias("seq_len_share"))


def identity_probe(df: DataFrame, batch: str, emb: str, id_col: str, seed: int) -> DataFrame:
    """How well a linear head names the batch of held-out rows, against the largest batch's share."""
    indexed = StringIndexer(inputCol=batch, outputCol="label").fit(df).transform(
        df.withColumn("features", array_to_vector(emb))
    )
    part = modulo(keyed(seed, "probe", F.col(id_col)), 5)
    train, test = indexed.where(part != 0), indexed.where(part == 0)
    model = LogisticRegression(regParam=1e-3, maxIter=50, family="multinomial").fit(train)
    hit = model.transform(test).agg(
        F.count("*").alias("n_test"),
        F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"),
    )
    largest = test.groupBy("label").agg(F.count("*").alias("k")).agg(
        (F.max("k") / F.sum("k")).alias("majority_share")
    )
    return hit.join(F.broadcast(largest)).withColumn("gain", F.col("accuracy") - F.col("majority_share"))


def cross_vs_within(
    assigned: DataFrame, group: str, fit, score, k_inner: int = 3, seed: int = 0,
    min_test: int = 150, min_positives: int = 20, min_within: int = 200, min_within_positives: int = 30,
    ks: tuple[int, ...] = KS,
) -> DataFrame:
    """Cross-batch against within-batch training, scored on identical test rows.

    ``assigned`` is the output of ``fold_train_test`` with ``id`` and ``y``. Held groups are split
    into inner folds; the cross model (one fit per fold) trains on untouched groups, the within
    model on the other inner folds of the held batches. Returns metrics per (fold, inner, regime).
    """
    d = cut(assigned.withColumn("inner", modulo(keyed(seed, "inner", F.col(group)), k_inner).cast("int")))
    sizes = (
        d.where("side = 'test'").groupBy("fold", "inner")
        .agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("fold", "inner").collect()
    )  # folds x inner folds rows
    by_fold: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sizes:
        by_fold.setdefault(r["fold"], {})[r["inner"]] = (r["n"], r["p"])
    scored = []
    for fold, inner in by_fold.items():
        usable = [i for i, (n, p) in inner.items() if n >= min_test and p >= min_positives]
        if not usable:
            continue
        rows = d.where(F.col("fold") == fold)
        held = rows.where("side = 'test'")
        cross = fit(rows.where("side = 'train'"))
        every = score(cross, held.where(F.col("inner").isin(usable)))
        scored.append(every.select("id", "fold", "inner", "y", "score", F.lit("cross").alias("regime")))
        for i in usable:
            n, p = (sum(v[x] for j, v in inner.items() if j != i) for x in (0, 1))
            if n < min_within or p < min_within_positives:
                continue
            within = fit(held.where(F.col("inner") != i))
            own = score(within, held.where(F.col("inner") == i))
            scored.append(own.select("id", "fold", "inner", "y", "score", F.lit("within").alias("regime")))
    if not scored:
        raise ValueError("no fold is large enough to evaluate")
    return evaluate(cut(reduce(DataFrame.unionByName, scored)), ks, ["fold", "inner", "regime"])


def size_ratio(assigned: DataFrame) -> DataFrame:
    """Cross training rows over held rows per fold."""
    return assigned.groupBy("fold").agg(
        F.count_if(F.col("side") == "train").alias("n_cross"),
        F.count_if(F.col("side") == "test").alias("n_within"),
    ).withColumn("ratio", F.try_divide("n_cross", "n_within"))
