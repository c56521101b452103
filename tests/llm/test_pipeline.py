"""The pipeline from end to end against plain versions of its stages."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tristage.llm import secrets, toxicity
from tristage.llm.queries import REJECT, WORD_BPE, tokenizer_path, toxicity_network

SF = "/root/testdata/sf0.001"
SPACE = re.compile("[\x20\x09-\x0d]+")


def shingles(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables and odd documents: null, empty, repeated, nearly equal, with a secret."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    rng = random.Random(1)
    words = [f"word{rng.randrange(10**6)}" for _ in range(60)]
    near = [*words[:58], "other"]
    texts = [
        None, "", "", " \t ", "one two", "one  two", "one\ttwo", " ".join(words), " ".join(words), " ".join(near),
        "password = Xk29fQz81LmVw0 " + " ".join(words[::-1]), "plain " * 4000,
    ]
    extra = spark.createDataFrame([(10_000 + i, t, "en", "odd", len(t or "")) for i, t in enumerate(texts)], docs.schema)
    docs.unionByName(extra).unionByName(extra.where("doc_id = 10007")).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_is_its_plain_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = toxicity.score(docs, toxicity_network(spark, folder), score_col="s")
    rows = [(r["doc_id"], r["text"]) for r in scored.where(F.col("s") < REJECT).select("doc_id", "text").collect()]
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        first.setdefault(SPACE.sub(" ", text or ""), (i, text))
    kept = dict(first.values())
    sets = {i: shingles(t) for i, t in kept.items()}
    comp = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in kept:
            for j in kept:
                a, b = sets[i], sets[j]
                if i < j and comp[i] != comp[j] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    assert {10007} <= set(kept) and 10009 not in kept and 10005 not in kept
    clean = secrets.redact(spark.createDataFrame(sorted(kept.items()), "doc_id long, text string"))
    clean = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "Xk29fQz81LmVw0" not in clean[10010]

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in clean.items()}
    found = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        found.setdefault(r["doc_id"], []).extend(r["ids"])
        assert r["start"] + r["length"] == len(found[r["doc_id"]]) and len(r["ids"]) == r["length"]
    assert found == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[1:]])
def test_stages_of_no_documents(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    assert out.count() == 0
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns


def test_stages_keep_clashing_columns_and_need_no_length(spark, folder):
    docs = spark.createDataFrame([(1, "password = Xk29fQz81LmVw0", 5), (2, None, 6), (2, None, 6)], "doc_id long, text string, _Toxicity int")
    kept = corpus_pipeline.not_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r["_Toxicity"] for r in kept.collect()) == [5, 6, 6]
    clean = corpus_pipeline.without_secrets(spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == 3
    numbered = docs.withColumnRenamed("_Toxicity", "_piece")
    assert corpus_pipeline.packed(spark, numbered, folder).count() == 3
