"""Language model, top-k search, Jaccard join, toxicity and pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tristage.llm import jaccard, lm, topk, toxicity

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in SPACES.split(lowered) if w]


# --- language model


def language_docs(seed=1, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "Dog", "é", "É", "runs", "to", "a\xa0b", "z"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(2, 70)]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return docs + [(500, None), (501, " \n\t "), (502, "the cat " * 20_000), (503, "tie"), (503, "tie"), (None, "no id")]


def kind_of(doc_id):
    rest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7
    return lm.OTHER if rest == 2 else lm.DELETED if rest == 3 else lm.LEARN


def test_language_model_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_CHARS", 3000)  # many batches and parts
    weights = {}
    learn = lm.mixture_weights
    monkeypatch.setattr(lm, "mixture_weights", lambda *a: weights.setdefault("w", learn(*a)))
    docs = language_docs()
    df = spark.createDataFrame([(i, t, kind_of(i)) for i, t in docs], "doc_id long, text string, k int").withColumn("tokens", F.lit("own"))
    got = lm.score(df, F.col("k")).collect()
    tokens = [(i, [*plain_words(t), None], kind_of(i)) for i, t in docs]
    trained = [(ws, k) for _, ws, k in tokens if k != lm.OTHER]
    one = Counter(w for ws, _ in trained for w in ws)
    two = Counter(p for ws, _ in trained for p in zip([None, *ws], ws))
    n, v = sum(one.values()), len(one)
    mix = weights["w"]
    want = []
    for i, ws, _ in tokens:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        model = 0.0
        for u, w in zip([None, *ws], ws):
            l2, l1, l0 = mix[1 + int(math.log2(one[u]))] if one[u] else mix[0]
            model += math.log10(l2 * (two[u, w] / one[u] if one[u] else 0) + l1 * one[w] / n + l0 / (v + 1))
        want.append((str(i), len(ws), sum(one[w] > 0 for w in ws), n, round(base, 6), round(model, 6)))
    own = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    for a, b in zip(sorted(own), sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-8, abs=2e-6)


def test_weights_come_near_those_of_exact_events():
    rng = np.random.default_rng(0)
    p2, p1, p0 = rng.random(4000), rng.random(4000) / 10, 0.01
    exact = np.array([0.4, 0.4, 0.2])
    for _ in range(300):
        share = np.stack([p2, p1, np.full(4000, p0)], 1) * exact
        share /= share.sum(1, keepdims=True)
        exact = share.mean(0)
    code, place = np.unique((3 * lm.BINS + lm._bins(p2)) * lm.BINS + lm._bins(p1), return_inverse=True)
    k = np.bincount(place).astype(float)
    got = lm.mixture_weights(code, k, np.bincount(place, p2) / k, np.bincount(place, p1) / k, p0)[3]
    assert got == pytest.approx(exact, abs=0.03)
    assert lm.mixture_weights(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0), 0.1).sum(1) == pytest.approx(np.ones(lm.BUCKETS))


def test_language_model_of_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, F.lit(lm.LEARN)).count() == 0


def test_language_model_without_training_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(df, F.lit(lm.OTHER)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0), (0, 0, 0.0)]


# --- top-k


def plain_top(vectors, k, query):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in dict(reversed([(i, v) for i, v in sorted(good, key=lambda r: (r[0], r[1])) if query(i)])).items():
        found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_top_k_is_exact(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(seed)
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(10)]) for i in range(200)]
    vectors += [(200 + i, vectors[0][1]) for i in range(60)] + [(300, vectors[1][1]), (300, vectors[1][1])]  # copies and ties
    vectors += [(400, None), (401, []), (402, [1.0, None]), (403, [math.nan]), (404, [math.inf]), (405, [0.5, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"id": F.lit(0), "v": F.lit(1)})
    whole = topk.whole_vectors(df, "vec_id", "embedding", 64)
    got = {}
    for r in topk.top_k(whole.where("id % 20 = 0"), whole, 7).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == plain_top(vectors, 7, lambda i: i % 20 == 0)


def test_no_random_access_stops_early_and_keeps_ties():
    rng = np.random.default_rng(2)
    parts = rng.integers(-300, 300, (4, 5000))
    parts[:, :30] = 290
    found, scores, read = topk.no_random_access(parts, 20)
    assert set(range(30)) <= set(found.tolist()) and (scores == parts[:, found].sum(0)).all()
    assert read < parts.size / 4


def test_top_k_few_rows_and_huge_numbers(spark):
    big = [(0, [1e15, -1e15]), (20, [1.0, 1.0]), (1, [2.0, 1.0])]
    whole = topk.whole_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1)
    got = [tuple(r) for r in topk.top_k(whole.where("id % 20 = 0"), whole, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 10**15), (0, 2, 20, 0), (20, 1, 1, 3), (20, 2, 0, 0)]
    assert topk.top_k(whole.where("id < 0"), whole, 5).count() == 0


# --- Jaccard join


def plain_classes(docs):
    sets = []
    for _, t in docs:
        w = plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    top = {i: i for i, _ in docs}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, _) in enumerate(docs):
        for b, (j, _) in enumerate(docs[:a]):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and i is not None and j is not None and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None) for (i, _), s in zip(docs, sets)), key=str)


def family_docs(seed):
    """Chains of edits, exact copies, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(500)}"
    passage = " ".join(word() for _ in range(60))
    docs = []
    for _ in range(14):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 9)):
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.2:
                base = base[: max(5, len(base) - rng.randint(1, 6))]
            docs.append(" ".join(base))
        docs.append(passage + " " + " ".join(word() for _ in range(rng.randint(1, 60))))
    docs += ["a b c", "A  b\tc", "a b", "", " \n", None, "one", passage, passage.upper()]
    docs = [(i, t) for i, t in enumerate(docs)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot", [20_000, 2])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    monkeypatch.setattr(jaccard, "CELL", 3)
    if hot == 2:
        monkeypatch.setattr(jaccard, "BLOCK", 2)
        monkeypatch.setattr(jaccard, "HOT_SHARE", 80)  # sets of two rows are hot
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    docs = [*family_docs(hot), (900, "x y z " * 30_000), (None, "a b c"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("own"), "gid": F.lit(1), "token": F.lit(2)})
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similarity_classes(df).collect() if r["doc_id"] is not None}
    assert got == {r for r in plain_classes(docs) if r[0] is not None}
    kept = jaccard.one_of_each(df)
    want = {i for i, n, c in plain_classes(docs) if i is None or n == 0 or c == i}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == want


def test_groups_with_one_prefix_are_compared_inside(spark, monkeypatch):
    # With one counter for all shingles and a constant order, many sets share size and prefix.
    rng = random.Random(3)
    base = [f"v{i}" for i in range(100)]
    docs = []
    for i in range(40):
        own = list(base)
        for _ in range(i // 8):
            own[rng.randrange(50, 100)] = f"u{rng.randrange(9)}"
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "_bits", lambda n: 16)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similarity_classes(df).collect()), key=str)
    assert got == plain_classes(docs)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_of_lists_come_once(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [(t, g) for t, size in ((1, 1), (2, 2), (3, 25)) for g in range(size)]
    got = jaccard.list_pairs(spark.createDataFrame(rows, "token long, gid long")).collect()
    want = sorted((t, g, h) for t, g in rows for u, h in rows if t == u and g < h)
    assert sorted((r["token"], *sorted((r["gid_x"], r["gid_y"]))) for r in got) == want


def test_no_task_holds_the_pairs_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    keys = ["token", "_bx", "_by"]
    dealt = jaccard.list_pairs(spark.range(2000).selectExpr("7L token", "id gid")).groupBy(*keys).count().collect()
    assert sum(r["count"] for r in dealt) == 2000 * 1999 // 2 and max(r["count"] for r in dealt) < 90 * 90


@pytest.mark.parametrize("texts", [["a"], ["a b"], ["a b c d"], ["", None], ["a b c d e"], ["a b c d e f", "g"]])
def test_shingles_of_few_words(texts):
    code, sizes = jaccard.shingles(pa.array(texts, pa.string()))
    assert sizes.tolist() == [0 if not t else max(1, len(t.split()) - 4) for t in texts] and len(code) == sizes.sum()


def test_classes_of_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similarity_classes(df).count() == 0


# --- toxicity


def toxic_docs(n, seed):
    rng = random.Random(seed)
    parts = ["the", "an", "er", "tion", "ing", "ou", "re", "ly", "st", "nd", "ea", "wh"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 300))]
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["grubo", "vlixte"]) + word())
        out.append((" ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def network():
    texts, labels = zip(*toxic_docs(600, 1))
    return toxicity.fit(list(texts), np.array(labels))


def test_network_finds_unseen_forms_of_a_stem(network):
    texts, labels = zip(*toxic_docs(400, 2))
    rejected = network.score(pa.array(texts)) >= 0.7
    labels = np.array(labels) == 1
    assert rejected[labels].mean() > 0.9 and rejected[~labels].mean() < 0.03


def test_words_hold_signs_between_letters():
    rng = random.Random(0)
    for _ in range(500):
        texts = ["".join(rng.choice("ab0$ Z") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))] + [None]
        _, counts, starts, ends, data = toxicity.text_words(pa.array(texts, pa.string()))
        want = [re.findall(r"[a-zA-Z](?:[0-9$]{0,2}[a-zA-Z])*", t or "") for t in texts]
        assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == sum(want, [])
        assert counts.tolist() == [len(w) for w in want]


def test_scripts_without_spaces_are_read_in_pieces():
    texts = ["a b", "\u5b57" * 5000, "", "x" * (toxicity.LONGEST + 1) + " y", "x" * toxicity.LONGEST]
    hashes, counts, starts, ends, data = toxicity.text_words(pa.array(texts))
    assert counts.sum() == len(starts) and counts[0] == 2 and counts[1] > 1000 and counts[2] == 0 and counts[4] == 1
    assert (ends - starts).max() == toxicity.LONGEST
    own = slice(counts[0], counts[0] + counts[1])  # the pieces of a text cover it, overlapping
    assert starts[own][0] == 3 and ends[own][-1] == 3 + 15_000 and (starts[own][1:] < ends[own][:-1]).all()
    assert len(toxicity.Words(pa.array(texts)).window_row) > 1000 // toxicity.STRIDE
    # A piece is the word of the same bytes.
    at = counts[0] + counts[1]
    assert hashes[at] == toxicity.text_words(pa.array(["x" * toxicity.PIECE]))[0][0]


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network({k: v.astype(np.float64) for k, v in toxicity.Network.fresh().w.items()})
    own = toxicity.Words(pa.array(["some words here and there " * 9, "short", "the end of it " * 20]))
    windows, target = own.windows(np.arange(4)), np.array([1.0, 0, 1, 0])
    table = net.inputs(own).astype(np.float64)
    grads = net.gradients(table, windows, target)

    def loss():
        p = toxicity._sigmoid(net.logits(table, windows))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    for name in ("xf", "xb", "uf", "ub", "cf", "cb", "attend", "out", "bias"):
        w = net.w[name]
        for at in {0, w.size // 2, w.size - 1}:
            i = np.unravel_index(at, w.shape)
            old, values = w[i], []
            for step in (1e-3, -1e-3):
                w[i] = old + step
                values.append(loss())
            w[i] = old
            assert grads[name][i] == pytest.approx((values[0] - values[1]) / 2e-3, rel=2e-2, abs=1e-6)


def test_every_window_is_scored(network):
    clean = " ".join(["the andtion erly"] * 2000)
    words = clean.split()
    for place in (0, 17, 2999, len(words)):
        text = " ".join([*words[:place], "grubotion", "vlixteing", *words[place:]])
        assert network.score(pa.array([text]))[0] > network.score(pa.array([clean]))[0]


def test_scores_depend_on_the_text_alone(spark, network):
    docs = [(1, None), (2, ""), (3, "123 !?"), (4, "the grubotion vlixteer"), (4, "the grubotion vlixteer"), (None, "er " * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"toxicity": F.lit("own"), "words": F.lit(1)})
    got = toxicity.score(df, network).collect()
    score = {r["text"]: r["toxicity"] for r in got}
    assert len(got) == 6 and all(0 <= s <= 1 for s in score.values())
    assert score[None] == score[""] == score["123 !?"] < 0.7
    assert toxicity.score(df.limit(0), network).count() == 0


def test_fit_without_both_labels():
    assert 0 <= toxicity.fit([], np.zeros(0, np.int64)).score(pa.array(["a"]))[0] <= 1
    assert toxicity.fit(["a b", "c"], np.zeros(2, np.int64)).score(pa.array(["a"]))[0] < 0.5


def test_training_reads_no_other_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(toxic_docs(60, 4))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(0, 0), (None, 1), (999, 1), (41, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, max_rows=20)
    assert np.isfinite(net.w["scale"]).all()
