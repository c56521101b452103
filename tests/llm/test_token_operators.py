"""Packing, token files and byte-level BPE against the tokenizers library and plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tristage.llm import bpe, packing, repair
from tristage.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path
from tristage.llm.tokens import word_tokenizer

PIECES = ["a", "B", "the", "Th", " ", "  ", "\n", "\t", "\xa0", "\x1c", "　", ".", ",", "'s", "'", "é", "é", "İ", "Σ", "ß", "1", "日", "<|endoftext|>", "<|start", "oftext|>", "\x85", "​", "🙂", "LL", "ſ", "ŉ", "ŉs"]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(tokenizer_path(name)) for name in (BYTE_BPE, WORD_BPE)}


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 24))) for _ in range(n)]


def test_word_ids_are_the_library_s(libraries):
    own = word_tokenizer(tokenizer_path(WORD_BPE))
    letters = [p + c + s for c in map(chr, range(0x180)) for p in ("", "a") for s in ("", "b", ".")]
    for text in odd_texts(4000) + letters:
        want = libraries[WORD_BPE].encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, repr(text)


def test_word_ids_survive_a_full_cache(libraries, monkeypatch):
    from tristage.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    own = tokens.WordTokenizer(tokenizer_path(WORD_BPE))
    for text in odd_texts(300, 2):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == libraries[WORD_BPE].encode(text, add_special_tokens=False).ids


def test_byte_bpe_is_the_library_s(libraries):
    own, library = bpe.Codec(tokenizer_path(BYTE_BPE)), libraries[BYTE_BPE]
    for text in odd_texts(4000, 3):
        ids = own.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_byte_bpe_merges_by_rank_not_by_place():
    own = bpe.Codec(tokenizer_path(BYTE_BPE))
    long = "ab" * 5000 + "thing" * 2000
    assert own.decode(own.encode(long).tolist()) == long


def test_byte_bpe_frame(spark):
    docs = [(1, "Hello there"), (2, None), (3, ""), (4, "x" * 100_000), (None, "Hello there")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit("own"), "decoded": F.lit(3)})
    path = tokenizer_path(BYTE_BPE)
    got = bpe.decode(bpe.encode(df, path), path).select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == 5 and all(r["decoded"] == (r["text"] or "") for r in got)
    assert bpe.encode(df.limit(0), path).count() == 0


# --- packing


def check_bins(lengths, number, offset, capacity):
    by_bin = {}
    for length, b, o in zip(lengths, number, offset):
        by_bin.setdefault(int(b), []).append((int(o), int(length)))
    for own in by_bin.values():
        place = 0
        for o, length in sorted(own):
            assert o == place
            place += length
        assert place <= capacity
    return len(by_bin)


@pytest.mark.parametrize("seed", range(8))
def test_best_two_fit_is_tight(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 300))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 400)))
    bins = check_bins(lengths, *packing.best_two_fit(lengths, capacity), capacity)
    big = np.sort(lengths[lengths * 2 > capacity])
    assert bins >= max(-(-lengths.sum() // capacity), len(big))
    assert bins <= 1.25 * max(lengths.sum() / capacity, len(big)) + 2


def test_best_two_fit_replaces_the_smallest_piece():
    # Greedy puts 5 + 4 into the first bin of 10; 3 + 2 fit the gap of 5 more tightly than 4.
    number, _ = packing.best_two_fit(np.array([5, 4, 3, 2]), 10)
    assert number[0] == number[2] == number[3] != number[1]


def test_two_fit_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        counts = np.zeros(31, np.int64)
        for x in rng.integers(1, 31, int(rng.integers(1, 12))):
            counts[x] += 1
        stock, gap = packing._Stock(counts.copy()), int(rng.integers(1, 31))
        have = [x for x in range(31) for _ in range(counts[x])]
        best = max([a + b for i, a in enumerate(have) for b in have[i + 1 :] if a + b <= gap], default=0)
        assert sum(stock.pair(gap)) == best


def test_packing_frame(spark, libraries):
    texts = ["word " * 5000, None, "", "a b c", "a b c", *odd_texts(60, 5)]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"piece": F.lit("own"), "_group": F.lit(1)})
    pieces = packing.token_pieces(df, tokenizer_path(WORD_BPE), sequence=64)
    got = packing.pack(pieces, capacity=64, group=20).collect()
    check_bins([r["length"] for r in got], [r["sequence_id"] for r in got], [r["offset"] for r in got], 64)
    for i, t in docs:
        ids = [*libraries[WORD_BPE].encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == list(range(0, len(ids), 64))
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()) for a in range(0, len(ids), 64)]
    assert packing.pack(packing.token_pieces(df.limit(0), tokenizer_path(WORD_BPE))).count() == 0


# --- token files


@pytest.mark.parametrize("seed", range(6))
def test_grammar_expands_to_its_ids(seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([rng.integers(0, 6, 3000), np.full(401, 3), np.tile([1, 2, 1], 200), rng.integers(0, 6, int(rng.integers(0, 3)))]).astype(np.uint32)
    rules, sizes, symbols = repair.compress(ids, 6, least=4)
    assert len(symbols) < len(ids) and (repair.expand(symbols, rules, 6) == ids).all()
    assert [len(repair.expand(np.array([6 + r], np.uint32), rules, 6)) for r in range(len(sizes))] == sizes.tolist()
    row = {"terminals": 6, "symbols": repair._pack(symbols), "rules": repair._pack(rules), "expansions": repair._pack(sizes)}
    for _ in range(40):
        a = int(rng.integers(0, len(ids)))
        n = int(rng.integers(0, len(ids) - a + 1))
        assert (repair.read_ids(row, a, n) == ids[a : a + n]).all()


@pytest.mark.parametrize("ids", [[], [1], [1, 1], [1, 1, 1]])
def test_grammar_of_short_sequences(ids):
    ids = np.array(ids, np.uint32)
    rules, _, symbols = repair.compress(ids, 4, least=1)
    assert repair.expand(symbols, rules, 4).tolist() == ids.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_grammar_goes_on_until_no_pair_is_frequent(seed):
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 50, 700)
    ids = np.concatenate([np.concatenate([passage, rng.integers(0, 50, 30)]) for _ in range(60)]).astype(np.uint32)
    rules, sizes, symbols = repair.compress(ids, 50, least=24)
    pairs = np.unique((symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:], return_counts=True)
    assert pairs[1].max() < 24 and sizes.max() > 16
    assert (repair.expand(symbols, rules, 50) == ids).all()


def test_grammar_of_copies_shrinks_below_a_sixteenth():
    ids = np.tile(np.arange(64, dtype=np.uint32), 4096)
    rules, sizes, symbols = repair.compress(ids, 64)
    assert len(symbols) < len(ids) // 1000 and (repair.expand(symbols, rules, 64) == ids).all()


def test_token_files(spark, tmp_path, libraries):
    docs = [(i, t) for i, t in enumerate(odd_texts(80, 6))] + [(200, "word " * 3000), (201, None), (202, ""), (203, "tie"), (203, "tie"), (None, "no id")]
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("own"), "shard": F.lit(1)})
    path = str(tmp_path / "blocks")
    repair.write_blocks(df, path, tokenizer_path(WORD_BPE), block_ids=500, shards=4)
    blocks = repair.read_blocks(spark, path).cache()
    assert blocks.count() > 4
    got = repair.digest_documents(blocks).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in docs), key=lambda i: -1 if i is None else i)
    place = 0
    texts = {i: t for i, t in docs}
    for r in got:
        ids = [*libraries[WORD_BPE].encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)
    whole = {r["start"]: r["ids"] for r in repair.decode_documents(blocks).collect()}
    one = blocks.where("size(lengths) > 1").first()
    assert repair.read_ids(one.asDict(), one["lengths"][0], one["lengths"][1]).tolist() == whole[one["start"] + one["lengths"][0]]


def test_token_files_of_no_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    repair.write_blocks(df, str(tmp_path / "none"), tokenizer_path(WORD_BPE), shards=2)
    assert repair.digest_documents(repair.read_blocks(spark, str(tmp_path / "none"))).count() == 0
