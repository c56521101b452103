"""Cross-tokenizer alignment against the libraries and plain sets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tristage.llm import alignment
from tristage.llm.queries import BYTE_BPE, PIECE_BPE, op13_token_alignment, tokenizer_path

SF = "/root/testdata/sf0.001"
PIECES = [
    "a", "B", "the", "Th", " ", "  ", "   ", "\n", "\t", "\xa0", "\x1c", "　", ".", ",", "'s", "'", "é", "é", "İ", "Σ", "ß", "1", "日",
    "<|endoftext|>", "</s>", "<s>", "<0x0A>", "<unk>", "\x85", "​", "🙂", "LL", "▁", "\x00", "ſ", "ŉ", "\r\n",
]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20))) for _ in range(n)]


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)


@pytest.fixture(scope="module")
def library(paths):
    """A text's ids and token bytes on both sides by the two libraries, or None."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    shown = {}
    for c in map(chr, range(0x500)):
        data, letters = c.encode(), ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
        shown.update(zip(letters, data))
    for lead in range(0xC0, 0x100):  # lead bytes of longer characters, which no letter above has
        shown.setdefault(chr(lead), lead)

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xs, ys = [bytes(shown[c] for c in a.id_to_token(i)) for i in x], [b_bytes(i) for i in y]
        if b"".join(xs) != b" " + text.encode() or b"".join(ys) != b" " + text.encode():
            return None
        return x, y, np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()

    return tokens


def plain(texts, library):
    """The contract's columns, by sets of ends and all overlapping pairs."""
    found, counts = [], Counter()
    for text in texts:
        tokens = library(text)
        if tokens is None:
            found.append(None)
            continue
        x, y, ex, ey = tokens
        links, j = [], 0
        for i, (s, e) in enumerate(zip([0, *ex], ex)):
            while ey[j] <= s:
                j += 1
            k = j
            while k < len(y) and ([0, *ey][k]) < e:
                links.append((x[i], y[k]))
                k += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(ex) & set(ey)):
            p, q = ex.index(cut, i) + 1, ey.index(cut, j) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        counts.update(set(links))
        found.append((len(x), len(y), groups, links))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        best = sum(counts[k] == top[k[0]] for k in links)
        rows.append((n_a, n_b, len(groups), len(links), best, sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_ids_are_the_libraries(paths, library):
    own = alignment.Vocabularies(*paths)
    texts = odd_texts(6000, 1)
    some = 0
    for text, (a, b) in zip(texts, own.encode(texts)):
        want = library(text) or ([], [])
        assert np.frombuffer(a, "<u2").tolist() == want[0] and np.frombuffer(b, "<u2").tolist() == want[1], repr(text)
        some += bool(want[0])
    assert some > 2000


def test_ids_survive_a_full_cache(paths, monkeypatch):
    whole = alignment.Vocabularies(*paths)
    monkeypatch.setattr(alignment, "CACHE_WORDS", 3)
    small = alignment.Vocabularies(*paths)
    texts = odd_texts(400, 2)
    assert [small.encode([t])[0] for t in texts] == whole.encode(texts)


def test_alignment_closes_groups_at_all_common_ends():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randint(1, 80)
        a = sorted({n, *rng.sample(range(1, n + 1), rng.randint(1, n))})
        b = sorted({n, *rng.sample(range(1, n + 1), rng.randint(1, n))})
        if rng.random() < 0.5:
            b = sorted({*a, rng.randint(1, n)})
        last_a, last_b = alignment.align(np.array(a), np.array(b))
        both = set(a) & set(b)
        assert last_a.tolist() == [e in both for e in a] and last_b.tolist() == [e in both for e in b]


def test_long_one_to_one_stretches_take_few_comparisons():
    ends = np.arange(1, 2_000_001)
    assert all(x.all() for x in alignment.align(ends, ends.copy()))
    shifted = np.delete(ends, 7)
    last_a, last_b = alignment.align(ends, shifted)
    assert not last_a[7] and last_a.sum() == len(ends) - 1 and last_b.all()


def test_short_one_to_one_stretches_are_compared_without_slices():
    slices = []

    class Raw(bytes):
        def __getitem__(self, at):
            slices.append(at)
            return bytes.__getitem__(self, at)

    class Ends(np.ndarray):
        def tobytes(self):
            return Raw(np.ndarray.tobytes(self))

    ends = np.arange(1, 501)
    other = np.delete(ends, np.arange(3, 499, 5))  # stretches of three or four between groups of two to one
    last_a, last_b = alignment.align(ends.view(Ends), other.view(Ends))
    assert last_a.tolist() == np.isin(ends, other).tolist() and last_b.all() and not slices


@pytest.mark.parametrize("held", [1 << 21, 40, 0])
def test_corpus_counts(spark, paths, library, held):
    texts = odd_texts(300, 3) + ["the cat sat", "the cat sat", None, "", "a " * 4000, "▁", "x"]
    rows = [(i // 2 if i % 5 else None, t, i, "n", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, groups_sha256 string, a_ids int").repartition(3)
    got = alignment.align_corpus(df, *paths, held_pairs=held)
    assert got.columns == ["doc_id", *COLUMNS]
    want = Counter((r[0], *p) for r, p in zip(rows, plain(texts, library)))
    assert Counter((r["doc_id"], *[r[c] for c in COLUMNS]) for r in got.collect()) == want


def test_groups_as_text_and_empty_tables(spark, paths):
    df = spark.createDataFrame([(1, "the cat")], "doc_id long, text string")
    row = alignment.aligned_documents(df, *paths, with_groups=True).first()
    assert row["groups"].count(";") + 1 == row["n_groups"] and hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]
    assert alignment.align_corpus(df.limit(0), *paths).count() == 0


def test_query_against_plain_counts(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(d["doc_id"], *p) for d, p in zip(docs, plain([d["text"] for d in docs], library))]
    got = op13_token_alignment(spark, SF).orderBy("doc_id").collect()
    assert [(r["doc_id"], *[r[c] for c in COLUMNS]) for r in got] == want
