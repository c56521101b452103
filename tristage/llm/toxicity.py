"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (runs of letters; digits and signs between two letters belong to them, as in "l0ser") are
read in overlapping windows. A run of more than ``LONGEST`` bytes, such as a text in a script without spaces,
is read as overlapping pieces of ``PIECE`` bytes, so its windows are no longer than others. A word enters the
network as a word vector plus the vectors of its character n-grams, so unseen forms of a known stem still speak. Two
gated recurrent layers read a window in both directions, attention weighs their states, and the
pooled state gives the window's logit. A text scores as its worst window.

All windows of every whole text are scored, in the tasks that read the texts; no text leaves its
partition. Only the fit sees a sample: at most ``MAX_ROWS`` rows of each label, none with more than
``MAX_CHARS`` characters, picked by the hash of their id. Labels are per text, so each epoch trains on
the windows that the network so far finds worst.

Null or empty texts, and those without a letter, get the score of an empty window. Other columns,
repeated rows and ties do not matter: a score depends on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tristage.llm.columns import BYTE_VALUES, WORD_BASE, mix64, slices, words

MAX_ROWS = 1500
MAX_CHARS = 32_000  # with MAX_ROWS, under 100 MB of text to fit on; longer texts are still scored whole
WINDOW, STRIDE = 32, 16
WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 16
GRAMS = (3, 4, 5, 6)
WIDTH, HIDDEN = 8, 8
WORDS_AT_ONCE, TEXTS_AT_ONCE = 8192, 32  # what temporary arrays cover
EPOCHS = 5
BATCH, RATE = 256, 0.1
FLOOR = 1e-5  # start of the squared gradients of word and n-gram vectors; keeps rare ones from being learnt by heart
KNOWN = 0.3  # share of words that training lets be recognised as a whole
SEED = 7

LETTERS = np.zeros(256, bool)
LETTERS[128:] = True
LETTERS[[*range(65, 91), *range(97, 123)]] = True
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in "0123456789$!*+"]] = True
LONGEST, PIECE, STEP = 64, 24, 12  # bytes


def _word_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes are in words: letters, and one or two signs between letters of the same text."""
    letter, sign = LETTERS[data], SIGNS[data]
    member, edges = letter.copy(), offsets[1:-1]
    for gap in (2, 3):
        if len(data) <= gap:
            break
        held = letter[:-gap] & letter[gap:]
        for i in range(1, gap):
            held &= sign[i : len(data) - gap + i]
        for i in range(1, gap + 1):  # both letters are of one text
            over = edges - i
            held[over[(over >= 0) & (over < len(held))]] = False
        for i in range(1, gap):
            member[i : len(data) - gap + i] |= held
    return member


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, words per row, starts, ends, bytes) of a text column's words, long ones in pieces."""
    hashes, counts, starts, ends, data = words(column, _word_bytes)
    sizes = ends - starts
    if not (sizes > LONGEST).any():
        return hashes, counts, starts, ends, data
    pieces = np.where(sizes > LONGEST, 1 + -(-(sizes - PIECE) // STEP), 1)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    whole = np.repeat(pieces == 1, pieces)
    starts = np.repeat(starts, pieces) + place * STEP
    ends = np.where(whole, np.repeat(ends, pieces), np.minimum(starts + PIECE, np.repeat(ends, pieces)))
    hashes = np.repeat(hashes, pieces)
    cut_up = np.flatnonzero(~whole)
    code, power = np.zeros(len(cut_up), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(PIECE):
            at = starts[cut_up] + i
            there = at < ends[cut_up]
            code[there] += BYTE_VALUES[data[at[there]]] * power
            power = power * WORD_BASE
    hashes[cut_up] = mix64(code)
    return hashes, np.add.reduceat(np.append(pieces, 0), np.cumsum(counts) - counts) * (counts > 0), starts, ends, data


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, number per word) of the character n-grams of words marked at both ends, word by word."""
    slots, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(starts), WORDS_AT_ONCE):
        own = _some_grams(data, starts[at : at + WORDS_AT_ONCE], ends[at : at + WORDS_AT_ONCE])
        slots.append(own[0])
        counts.append(own[1])
    return np.concatenate(slots), np.concatenate(counts)


def _some_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = ends - starts + 2
    first = np.cumsum(lengths) - lengths
    whole = np.empty(int(lengths.sum()), np.uint8)
    whole[first], whole[first + lengths - 1] = ord("<"), ord(">")
    body = np.ones(len(whole), bool)
    body[first], body[first + lengths - 1] = False, False
    at = np.arange(int((lengths - 2).sum())) - np.repeat(np.cumsum(lengths - 2) - (lengths - 2), lengths - 2)
    whole[body] = data[np.repeat(starts, lengths - 2) + at]
    values = BYTE_VALUES[whole]
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    left = np.repeat(first + lengths, lengths) - np.arange(len(whole))
    slots, owners = [], []
    for n in GRAMS:
        code = np.zeros(len(whole), np.uint64)
        for i in range(min(n, len(whole))):
            code[: len(whole) - i] = code[: len(whole) - i] * WORD_BASE + values[i:]
        fits = left >= n
        slots.append((mix64(code[fits] + np.uint64(n)) % np.uint64(GRAM_SLOTS)).astype(np.int32))
        owners.append(owner[fits])
    slot, word = np.concatenate(slots), np.concatenate(owners)
    return slot[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(starts))


class Words:
    """The distinct words of some texts, their inputs, and the windows over them."""

    def __init__(self, column: pa.Array):
        hashes, counts, starts, ends, data = text_words(column)
        distinct, at, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.n, self.rows, self.counts = len(distinct), len(counts), counts
        self.word_slots = (distinct % np.uint64(WORD_SLOTS)).astype(np.int64)
        if self.n:
            self.gram_slots, self.gram_counts = _grams(data, starts[at], ends[at])
            self.gram_first = np.cumsum(self.gram_counts) - self.gram_counts
        begins = np.cumsum(counts) - counts
        per_row = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
        self.window_row = np.repeat(np.arange(len(counts)), per_row)
        step = np.arange(len(self.window_row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        self.window_at = begins[self.window_row] + step * STRIDE
        self.window_size = np.minimum(WINDOW, counts[self.window_row] - step * STRIDE)

    def grams_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of n-grams of each chosen word, the places of all of them)."""
        counts = self.gram_counts[chosen]
        return counts, np.repeat(self.gram_first[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Word numbers of some windows, one row each; ``self.n`` where there is no word."""
        at = self.window_at[chosen][:, None] + np.arange(WINDOW)
        there = np.arange(WINDOW) < self.window_size[chosen][:, None]
        return np.where(there, self.ids[np.minimum(at, len(self.ids) - 1)], self.n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Weights by name; everything is float32."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls) -> Network:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"word": 0.05 * rng.standard_normal((WORD_SLOTS, WIDTH)).astype(np.float32)}
        w["gram"] = 0.05 * rng.standard_normal((GRAM_SLOTS, WIDTH)).astype(np.float32)
        for side in "fb":
            w[f"x{side}"], w[f"u{side}"] = draw(WIDTH, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)
            w[f"c{side}"] = np.zeros(3 * HIDDEN, np.float32)
        w["attend"], w["out"], w["bias"] = draw(2 * HIDDEN), draw(2 * HIDDEN), np.zeros(1, np.float32)
        w["scale"] = np.array([1, 0], np.float32)
        return cls(w)

    def inputs(self, own: Words, chosen: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
        """A vector per distinct word (or per chosen one), and zeros for no word.

        known: which of the words may be recognised as a whole; the others are their n-grams alone."""
        chosen = np.arange(own.n) if chosen is None else chosen
        out = np.zeros((len(chosen) + 1, WIDTH), np.float32)
        for a in range(0, len(chosen), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, len(chosen))
            counts, at = own.grams_of(chosen[a:b])
            out[a:b] = np.add.reduceat(self.w["gram"][own.gram_slots[at]], np.cumsum(counts) - counts, axis=0)
            out[a:b] /= np.sqrt(counts)[:, None].astype(np.float32)
            whole = self.w["word"][own.word_slots[chosen[a:b]]]
            out[a:b] += whole if known is None else whole * known[a:b, None]
        return out

    def _read(self, side: str, projected: np.ndarray, order: range, keep: list | None):
        """States after each word, in the order of the text."""
        u, n = self.w[f"u{side}"], projected.shape[1]
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((len(projected), n, HIDDEN), np.float32)
        for t in order:
            x = projected[t]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            rh = r * h
            new = np.tanh(x[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, rh, new))
            h = h + z * (new - h)
            states[t] = h
        return states

    def logits(self, table: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit per window; ``table``: the input vectors."""
        w, at = self.w, windows.T
        steps = {"f": range(WINDOW), "b": range(WINDOW - 1, -1, -1)}
        both = []
        for side, order in steps.items():
            projected = (table @ w[f"x{side}"] + w[f"c{side}"])[at]
            trace = [] if keep is not None else None
            both.append(self._read(side, projected, order, trace))
            if keep is not None:
                keep[side] = trace
        states = np.concatenate(both, 2)
        e = states @ w["attend"]
        e[at == len(table) - 1] = -1e9
        e[0][(at == len(table) - 1).all(0)] = 0
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        if keep is not None:
            keep |= {"states": states, "a": a, "pooled": pooled}
        return pooled @ w["out"] + w["bias"][0]

    def gradients(self, table: np.ndarray, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over some windows."""
        w, keep, at = self.w, {}, windows.T
        d_logit = ((_sigmoid(self.logits(table, windows, keep)) - target) / len(target)).astype(np.float32)
        states, a, pooled = keep["states"], keep["a"], keep["pooled"]
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["out"]
        d_states = a[:, :, None] * d_pooled
        d_e = a * ((states - pooled) * d_pooled).sum(2)
        g["attend"] = np.einsum("tn,tnh->h", d_e, states)
        d_states += d_e[:, :, None] * w["attend"]
        d_table = np.zeros_like(table)
        for i, side in enumerate("fb"):
            u, d_u = w[f"u{side}"], np.zeros_like(w[f"u{side}"])
            d_x = np.empty((WINDOW, len(windows), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(windows), HIDDEN), np.float32)
            for t, h, z, r, rh, new in reversed(keep[side]):
                d_h = d_h + d_states[t][:, i * HIDDEN : (i + 1) * HIDDEN]
                d_new = d_h * z * (1 - new * new)
                d_rh = d_new @ u[:, 2 * HIDDEN :].T
                d_gates = np.concatenate([d_h * (new - h) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
                d_x[t] = np.concatenate([d_gates, d_new], 1)
                d_u[:, : 2 * HIDDEN] += h.T @ d_gates
                d_u[:, 2 * HIDDEN :] += rh.T @ d_new
                d_h = d_h * (1 - z) + d_rh * r + d_gates @ u[:, : 2 * HIDDEN].T
            flat = np.zeros((len(table), 3 * HIDDEN), np.float32)
            np.add.at(flat, at.ravel(), d_x.reshape(-1, 3 * HIDDEN))
            g |= {f"u{side}": d_u, f"c{side}": d_x.sum((0, 1)), f"x{side}": table.T @ flat}
            d_table += flat @ w[f"x{side}"].T
        g["table"] = d_table[:-1]
        return g

    def worst(self, own: Words, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(logit of every window, logit of every text's worst window)."""
        table = self.inputs(own) if table is None else table
        every = np.empty(len(own.window_row), np.float32)
        for a in range(0, len(every), 2048):
            chosen = np.arange(a, min(a + 2048, len(every)))
            every[chosen] = self.logits(table, own.windows(chosen))
        empty = self.logits(table, np.full((1, WINDOW), own.n))[0]
        texts = np.full(own.rows, -np.inf, np.float32)
        np.maximum.at(texts, own.window_row, every)
        texts[np.isinf(texts)] = empty
        return every, texts

    def score(self, column: pa.Array) -> np.ndarray:
        """From 0 to 1 for every text."""
        scale, shift = self.w["scale"].astype(np.float64)
        return _sigmoid(self.worst(Words(column))[1].astype(np.float64) * scale + shift)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Train a network on labelled texts (1: toxic)."""
    net, rng = Network.fresh(), np.random.default_rng(SEED)
    own, labels = Words(pa.array(texts, pa.string())), np.asarray(labels)
    if not own.n or not 0 < labels.sum() < len(labels):
        net.w["scale"][:] = 0, np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)) if len(labels) else 0
        return net
    _prime(net, own, labels)
    total = {k: np.full_like(v, FLOOR if k in ("word", "gram") else 1e-6) for k, v in net.w.items()}

    def step(name: str, grad: np.ndarray, rate: float, rows=slice(None)):
        total[name][rows] += grad * grad
        net.w[name][rows] -= rate * grad / (np.sqrt(total[name][rows]) + 1e-6)

    toxic = labels[own.window_row] == 1
    for epoch in range(epochs):
        every = net.worst(own)[0] if epoch else _first_guess(net, own)
        order = np.lexsort((-every, own.window_row))
        rank = np.arange(len(order)) - np.searchsorted(own.window_row[order], own.window_row[order])
        bad = order[toxic[order] & (rank == 0)]
        good = order[~toxic[order] & ((rank < 2) | (rng.random(len(order)) < 0.02))]
        chosen = np.concatenate([np.tile(bad, max(1, len(good) // (3 * len(bad)))), good])
        rng.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            part = chosen[a : a + BATCH]
            used, windows = np.unique(own.windows(part), return_inverse=True)
            used, windows = (used[:-1] if used[-1] == own.n else used), windows.reshape(len(part), WINDOW)
            known = (rng.random(len(used)) < KNOWN).astype(np.float32)
            g = net.gradients(net.inputs(own, used, known), windows, toxic[part].astype(np.float32))
            d_words = g.pop("table")
            for name, grad in g.items():
                step(name, grad, RATE)
            slots, place = np.unique(own.word_slots[used], return_inverse=True)
            grad = np.zeros((len(slots), WIDTH), np.float32)
            np.add.at(grad, place, d_words * known[:, None])
            step("word", grad, RATE, slots)
            counts, at = own.grams_of(used)
            slots, place = np.unique(own.gram_slots[at], return_inverse=True)
            grad = np.zeros((len(slots), WIDTH), np.float32)
            np.add.at(grad, place, np.repeat(d_words / np.sqrt(counts)[:, None].astype(np.float32), counts, axis=0))
            step("gram", grad, RATE, slots)
    net.w["scale"][:] = _calibrated(net.worst(own)[1].astype(np.float64), labels)
    return net


def _prime(net: Network, own: Words, labels: np.ndarray) -> None:
    """Start two input dimensions from how much oftener toxic texts hold a word or an n-gram."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    prior = 4 * n1 / (n1 + n0), 4 * n0 / (n1 + n0)  # what occurs once or twice says little
    sizes = {"word": WORD_SLOTS, "gram": GRAM_SLOTS}
    has = {name: np.zeros((2, size)) for name, size in sizes.items()}
    ends = np.cumsum(own.counts)
    for a in range(0, own.rows, TEXTS_AT_ONCE):
        b = min(a + TEXTS_AT_ONCE, own.rows)
        ids = own.ids[ends[a] - own.counts[a] : ends[b - 1]]
        pairs = np.unique(np.repeat(np.arange(b - a), own.counts[a:b]) * own.n + ids)
        row, word = pairs // own.n, pairs % own.n
        if not len(word):
            continue
        counts, at = own.grams_of(word)
        for name, rows, slots in (("word", row, own.word_slots[word]), ("gram", np.repeat(row, counts), own.gram_slots[at])):
            both = np.unique(rows * sizes[name] + slots)
            for y in (0, 1):
                has[name][y] += np.bincount((both % sizes[name])[labels[a + both // sizes[name]] == y], minlength=sizes[name])
    for name, (in0, in1) in has.items():
        odds = np.log((in1 + prior[0]) / n1) - np.log((in0 + prior[1]) / n0)
        net.w[name][:, 0] = np.clip(odds, 0, None) / 4
        net.w[name][:, 1] = np.clip(-odds, 0, None) / 4


def _first_guess(net: Network, own: Words) -> np.ndarray:
    """What to look at first: the most suspicious word of every window, by the primed dimensions."""
    table = net.inputs(own)
    value = np.append((table[:-1, 0] - table[:-1, 1]), -np.inf)
    every = np.arange(len(own.window_row))
    return np.concatenate([value[own.windows(every[a : a + 2048])].max(1) for a in range(0, len(every), 2048)])


def _calibrated(logit: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve over worst windows, by Newton's method with a weak prior."""
    x = np.stack([logit, np.ones_like(logit)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        grad = x.T @ (p - labels) + 0.05 * (beta - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), grad)
        beta = beta - np.clip(step, -1, 1)
    return max(beta[0], 0.05), beta[1]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic): of each label the ``max_rows`` ids
    that come first by hash. Of ids labelled both ways the label 1 counts."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    marked = marked.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy("h", "doc_id").limit(max_rows).collect()]
    if not chosen:
        return fit([], np.zeros(0, np.int64))
    ids = docs.sparkSession.createDataFrame(chosen, marked.schema)  # at most 2 * max_rows
    rows = docs.select("doc_id", F.col("text").alias("t")).where(F.length("t") <= MAX_CHARS).join(F.broadcast(ids), "doc_id")
    picked = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy("h", "doc_id", "t").limit(max_rows).collect()]
    return fit([r["t"] for r in picked], np.array([r["y"] for r in picked], np.int64))


def score(df: DataFrame, net: Network, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``df`` with the toxicity of its texts, from 0 to 1; all other columns stay."""
    kept = [c for c in df.columns if c != score_col]
    shared = df.sparkSession.sparkContext.broadcast(net.w)  # its size is set by the constants above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shared.value)
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                scores = pa.array(own.score(batch.column(text_col)), pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores], [*kept, score_col])

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in kept], StructField(score_col, DoubleType())]))
