"""The weights of deleted interpolation against expectation-maximisation over single events."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import kind_of, language_docs, plain_words
from tristage.llm import lm


def exact_em(p, rounds, start=(0.4, 0.4, 0.2)):
    weights = np.array(start)
    for _ in range(rounds):
        share = p * weights
        share /= share.sum(1, keepdims=True)
        weights = share.mean(0)
    return weights


@pytest.mark.parametrize("low", [8, 24, 36])
def test_weights_of_small_estimates(low):
    """Unigram estimates from 2^-low on, as large corpora have them."""
    rng = np.random.default_rng(low)
    n = 6000
    p1 = 2.0 ** -rng.uniform(low - 8, low, n)
    p2 = np.where(rng.random(n) < 0.3, 2.0 ** -rng.uniform(1, low, n), 0)
    p0 = 2.0 ** -(low - 3)
    bins = lm.bins_for(2**low)
    code, place = np.unique((5 * bins + lm._bins(p2, bins)) * bins + lm._bins(p1, bins), return_inverse=True)
    k = np.bincount(place).astype(float)
    got = lm.mixture_weights(code, k, np.bincount(place, p2) / k, np.bincount(place, p1) / k, p0, bins)[5]
    assert got == pytest.approx(exact_em(np.stack([p2, p1, np.full(n, p0)], 1), 2 * lm.ROUNDS), abs=0.03)


def test_no_estimate_falls_below_the_bins():
    for tokens in (1, 10, 10**7, 2**36, 10**13):
        bins = lm.bins_for(tokens)
        low = lm._bins(np.array([1 / tokens, 2 / tokens, 0.0]), bins)
        assert low[0] < bins and (tokens < 10 or low[1] < low[0]) and low[2] == 0


def test_weights_are_learnt_on_deleted_texts_under_the_counts_of_the_rest(spark, monkeypatch):
    """From the texts to the weights, by plain counts and single events."""
    monkeypatch.setattr(lm, "LEAST_CHARS", 3000)
    found = {}
    learn = lm.mixture_weights
    monkeypatch.setattr(lm, "mixture_weights", lambda *a: found.setdefault("w", learn(*a)))
    docs = language_docs(3, 200)
    df = spark.createDataFrame([(i, t, kind_of(i)) for i, t in docs], "doc_id long, text string, k int")
    lm.score(df, F.col("k")).count()
    words = [([*plain_words(t), None], kind_of(i)) for i, t in docs]
    rest = [ws for ws, k in words if k == lm.LEARN]
    one = Counter(w for ws in rest for w in ws)
    two = Counter(p for ws in rest for p in zip([None, *ws], ws))
    n, v = sum(one.values()), len({w for ws, k in words if k != lm.OTHER for w in ws})
    events = {}
    for ws, kind in words:
        for u, w in zip([None, *ws], ws):
            if kind == lm.DELETED:
                bucket = int(np.log2(one[u])) + 1 if one[u] else 0
                events.setdefault(bucket, []).append((two[u, w] / one[u] if one[u] else 0, one[w] / n, 1 / (v + 1)))
    overall = exact_em(np.array(sum(events.values(), [])), lm.ROUNDS)
    checked = 0
    for bucket, own in events.items():
        if bucket and len(own) >= 30:
            want = exact_em(np.array(own), lm.ROUNDS, overall)
            assert found["w"][bucket] == pytest.approx(want, abs=0.03), bucket
            checked += 1
    assert checked >= 3
