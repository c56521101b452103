"""Periodic runs against a search of all periods and starts."""

import hashlib
import random
import re
import zlib

import pytest

from tristage.llm import runs
from tristage.llm.queries import op11_periodic_runs, with_repeats

SF = "/root/testdata/sf0.001"


def all_runs(words, least):
    """Every (start, length, period), tried one period at a time."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(words[i : i + length - g] == words[i + g : i + length] for g in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def as_tuples(found):
    return [tuple(r) for r in found.tolist()]


def random_words(rng, longest=60):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, longest))]
    if len(words) > 3 and rng.random() < 0.5:
        a, p = rng.randrange(len(words) - 1), rng.randint(1, 9)
        words = words[:a] + [words[a:][i % min(p, len(words) - a)] for i in range(len(words) - a)]
    return words


@pytest.mark.parametrize("least", [2, 3, 6, 12, 17])
def test_runs_are_those_of_a_full_search(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        for words, found in zip(texts, runs.find_runs(texts, least)):
            assert as_tuples(found) == all_runs(words, least), words


def test_runs_within_runs_of_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 250:
        a, b = b, b + a
    assert as_tuples(runs.find_runs([b])[0]) == all_runs(b, 12)


def test_long_stretches_of_one_word_and_of_a_long_period():
    assert as_tuples(runs.find_runs([[b"x"] * 200_000])[0]) == [(0, 200_000, 1)]
    assert as_tuples(runs.find_runs([[b"%d" % (i % 5000) for i in range(60_000)]])[0]) == [(0, 60_000, 5000)]


def test_position_sets_keep_order_over_many_blocks():
    places = random.Random(3).sample(range(100_000), 6000)
    own = runs.Positions(places[0])
    for x in places[1:]:
        before, after = own.around(x)
        own.add(x)
        if x % 50 == 0:
            near = sorted(own)
            k = near.index(x)
            assert before == (near[k - 1] if k else None)
            assert after == (near[k + 1] if k + 1 < len(near) else None)
    assert list(own) == sorted(places) and own.size == len(places)


def test_odd_rows_and_clashing_columns(spark):
    rows = [
        (1, None, "r", "c"), (2, "", "r", "c"), (3, " \t\v ", "r", "c"), (4, "a b " * 10, "r", "c"), (4, "a b " * 10, "r", "c"),
        (None, "é x " * 12, "r", "c"), (-5, "A a " * 8, "r", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string")
    got = runs.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    by_text = {r["text"]: r for r in got.collect()}
    assert got.count() == len(rows)
    for empty in (None, "", " \t\v "):
        assert by_text[empty]["runs"] == [] and by_text[empty]["collapsed"] == ""
    assert [tuple(r) for r in by_text["a b " * 10]["runs"]] == [(0, 20, 2)]
    assert by_text["a b " * 10]["collapsed"] == "a b"
    assert by_text["é x " * 12]["collapsed"] == "é x"  # a no-break space parts no words
    assert by_text["A a " * 8]["collapsed"] == "A a"
    digests = runs.digests(got).where("n_runs = 0").first()
    assert digests["start"] is None and digests["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert runs.digests(runs.periodic_runs(df.limit(0))).count() == 0


def test_query_against_the_full_search(spark):
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    checked = 0
    for doc_id, text in docs:
        words = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
        if len(words) > 1500:
            continue  # the full search is quadratic
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert with_repeats(doc_id, [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text or "")]) == words
        want = all_runs(words, 12)
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        best = max(want, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        row = got[doc_id]
        assert (row["start"], row["length"], row["period"]) == best and row["n_runs"] == len(want)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in want)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        short = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert row["collapsed_sha256"] == hashlib.sha256(short).hexdigest()
        checked += bool(want)
    assert checked >= 10
