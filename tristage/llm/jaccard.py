"""N-gram Jaccard join by grouped prefixes.

A text's set holds the 64-bit hashes of its distinct ``WORDS``-word shingles (two different shingles
of any texts meet with a probability of about 2^-64). Two documents link when their sets have
100 * intersection >= 80 * union.

1. A count sketch over all shingle occurrences gives the global order of shingles, rarest first. Its
   size is fixed by the number of rows and at most 64 MB, so it may be broadcast; every order gives
   the same result, a better one only fewer candidates.
2. Documents with equal sets become one. Those left with the same size and the same prefix (the
   first n - ceil(0.8 n) + 1 shingles in the global order) become one group, and only its leader's
   prefix is spread over the cluster.
3. Each leader is checked against one centre, the smallest leader that shares a prefix shingle and
   its size class; members are checked against their leader. What links is contracted. Candidates
   are linear in the documents here, however many near copies there are.
4. Then every pair of groups that shares a prefix shingle, passes the size and position filters and
   is not yet connected is expanded to its members, and those pairs are checked. No pair inside a
   component is listed, and no pair that could connect two is left out.

Checks read the whole texts of both sides; a document with many partners is compared in cells of about
``CELL``. Frequent shingles are salted, and the pairs of a long list are dealt in blocks of ``BLOCK`` rows by
``BLOCK``. Sets of more than a thousandth of all rows get their component by broadcast, so that no task has
all their rows. Rows without words have an empty set and no link. Rows that
share an id are one document that links if any of its texts does; rows without an id get the
component of the documents whose set they share, if there is one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tristage.llm.columns import mix64, slices, word_hashes
from tristage.operators.graph import connected_components
from tristage.session import cut

WORDS = 5
SIMILAR = 80  # percent
CHUNK = 4096  # counters of a row of the sketch
CELL = 256
BLOCK = 4096  # rows of a list on either side of a task's pairs
HOT_SHARE = 1000  # a set with more than one row in so many is hot
BROADCAST_ROWS = 1_000_000  # two or three numbers each
HOT_ROWS = 20_000  # rows of a shingle in one salt, about
_STEPS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all rows, ascending within a row; their number per row)."""
    words, counts = word_hashes(column)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    first = np.cumsum(counts) - counts
    n = len(words)
    code = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        code[: n - j] += words[j:] * _STEPS[j]
    left = np.repeat(first + counts, counts) - np.arange(n)
    code, row = code[left >= k], np.repeat(np.arange(len(counts)), counts)[left >= k]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[first[r] : first[r] + counts[r]]
        short = (own * _STEPS[: len(own)]).sum(keepdims=True, dtype=np.uint64) + _STEPS[-1:] * np.uint64(len(own))
        code, row = np.append(code, short), np.append(row, r)
    code = mix64(code)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[fresh], np.bincount(row[fresh], minlength=len(counts))


def _bits(rows: int) -> int:
    return min(24, max(16, math.ceil(math.log2(rows + 1)) + 2))


def shingle_counts(docs: DataFrame, text_col: str, bits: int) -> np.ndarray:
    """Counters of all documents' shingles, by the top bits of their hash."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for whole in batches:
            for batch in slices(whole, text_col):
                code, _ = shingles(batch.column(text_col))
                total += np.bincount((code >> np.uint64(64 - bits)).astype(np.int64), minlength=size).astype(np.uint32)
        if total.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            rows = [pack(total[a : a + CHUNK].tobytes()) for a in range(0, size, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(unpack(data), np.uint32)
                sums[chunk] = sums[chunk] + own if chunk in sums else own.astype(np.uint64)
        if sums:
            rows = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["chunk", "counts"])

    shape = "chunk int, counts binary"
    found = docs.select(text_col).mapInArrow(count, shape).repartition("chunk").mapInArrow(add, shape)
    out = np.zeros(size, np.uint32)
    for row in found.collect():  # the sketch: its size is fixed
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint32)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def document_sets(docs: DataFrame, id_col: str, text_col: str, counts: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, n, set_id, prefix_id, prefix, hot): size, digests and prefix of every document's set.

    hot: per prefix shingle, into how many salts its rows should be dealt.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["doc_id", "n", "set_id", "prefix_id", "prefix", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                code, sizes = shingles(batch.column(text_col))
                count = often[(code >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((code, count, np.repeat(np.arange(len(sizes)), sizes)))
                first = np.cumsum(sizes) - sizes
                lengths = np.where(sizes > 0, sizes - -(-sizes * SIMILAR // 100) + 1, 0)
                at = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                picked = order[at]
                prefix = code[picked]
                digest = lambda data: hashlib.blake2b(data, digest_size=16).digest()
                ends = np.cumsum(lengths)
                sets = [digest(code[a : a + n].tobytes()) for a, n in zip(first, sizes)]
                heads = [digest(prefix[e - m : e].tobytes()) for e, m in zip(ends, lengths)]
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                hot = np.minimum(256, 1 + count[picked] // HOT_ROWS).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(_signed(prefix)), pa.array(hot))]
                columns = [batch.column(id_col), pa.array(sizes), pa.array(sets, pa.binary()), pa.array(heads, pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, set_id binary, prefix_id binary, prefix array<long>, hot array<int>"
    return docs.select(id_col, text_col).mapInArrow(run, shape)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _small_side(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it is counted to have at most ``BROADCAST_ROWS`` rows; beyond
    that the join with it is a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def linked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose texts link, checked on their whole sets."""
    pairs = cut(pairs.distinct())
    need = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = cut(texts.join(_small_side(need), "id", "left_semi"))
    many = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / CELL).cast("int").alias("_cells")).where("_cells > 1"))
    spread = F.pmod(F.xxhash64("a"), F.coalesce("_cells", F.lit(1))).cast("int")
    celled = cut(pairs.join(_small_side(many), "b", "left").select("a", "b", spread.alias("cell")))
    cells = cut(celled.select("b", "cell").distinct())
    left = texts.withColumnRenamed("id", "a").join(_small_side(celled), "a").select("b", "cell", "a", "text")
    right = texts.withColumnRenamed("id", "b").join(_small_side(cells), "b").select("b", "cell", "text")
    right = right.toDF("centre", "part", "text")  # other names than those of the left side

    def check(key: tuple, centre: pa.Table, others: pa.Table) -> pa.Table:
        own, sets = _sets(centre.column("text")), _sets(others.column("text"))
        hit = {a for a, s in zip(others.column("a").to_pylist(), sets) if any(len(s) and len(o) and _similar(s, o) for o in own)}
        found = pa.array(list(hit), others.schema.field("a").type)
        return pa.table([found, pa.array([key[0].as_py()] * len(hit), found.type)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return right.groupBy("centre", "part").cogroup(left.groupBy("b", "cell")).applyInArrow(check, f"a {kind}, b {kind}")


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        for batch in slices(pa.RecordBatch.from_arrays([chunk], ["text"]), "text"):
            code, sizes = shingles(batch.column("text"))
            out += np.split(code, np.cumsum(sizes)[:-1])
    return out


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    bits = _bits(docs.count())
    sets = cut(document_sets(docs, id_col, text_col, shingle_counts(docs, text_col, bits), bits))
    worded = sets.where("n > 0 and doc_id is not null")
    # One row per set; equal sets have equal prefixes.
    reps = cut(worded.groupBy("set_id", "n", "prefix_id").agg(F.min("doc_id").alias("id"), F.min(F.struct("prefix", "hot")).alias("p")))
    groups = reps.groupBy("prefix_id", "n").agg(F.min("id").alias("gid"))
    members = cut(reps.select("prefix_id", "n", "id").join(groups, ["prefix_id", "n"]).select("id", "gid", "n"))
    leaders = reps.join(groups, ["prefix_id", "n"]).where("id = gid").select("gid", "n", "p")
    # Groups of other sizes may share their leader's id; the leader's prefix then comes once for each.
    spread = leaders.select("gid", "n", F.posexplode(F.arrays_zip("p.prefix", "p.hot")).alias("pos", "t"))
    spread = spread.select(
        F.col("t.prefix").alias("token"), F.col("t.hot").alias("salts"), "gid", "n", "pos",
        F.pmod(F.xxhash64("gid"), F.col("t.hot")).cast("int").alias("salt"),
    )
    tokens = cut(_shared(spread))

    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1.25) + 1e-9)
    lists = tokens.withColumn("class", size_class)
    centred = lists.withColumn("centre", F.min("gid").over(Window.partitionBy("token", "salt", "class")))
    local = centred.select("gid", "centre")
    between = centred.where("salts > 1").select("token", "class", F.col("centre").alias("gid")).distinct()
    between = between.select("gid", F.min("gid").over(Window.partitionBy("token", "class")).alias("centre"))
    stars = local.unionByName(between).where("gid > centre").groupBy("gid").agg(F.min("centre").alias("centre"))
    pairs = stars.select(F.col("gid").alias("a"), F.col("centre").alias("b")).unionByName(
        members.where("id > gid").select(F.col("id").alias("a"), F.col("gid").alias("b"))
    )
    edges = cut(linked(pairs, docs, id_col, text_col))
    nodes = members.select(F.col("id").alias("key")).distinct()
    comps = cut(connected_components(edges, nodes))

    # A group all of whose members are connected has their component as its label, any other its own.
    labelled = members.join(comps, members["id"] == comps["key"]).select("id", "gid", "n", "comp")
    labels = labelled.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    labels = cut(labels.select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat(F.lit("#"), "gid")).alias("label")))
    rows = tokens.join(labels, "gid").select("token", "gid", "n", "pos", "label")
    mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    rows = cut(rows.join(mixed, "token", "left_semi"))
    needed = F.expr(f"ceil({SIMILAR} * (n_x + n_y) / {100 + SIMILAR}D - 1e-6)")
    possible = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= needed
    sizes = (100 * F.least("n_x", "n_y") >= SIMILAR * F.greatest("n_x", "n_y")) & possible
    apart = list_pairs(rows).where((F.col("gid_x") != F.col("gid_y")) & (F.col("label_x") != F.col("label_y")) & sizes)
    apart = apart.select(F.least("gid_x", "gid_y").alias("gid_x"), F.greatest("gid_x", "gid_y").alias("gid_y")).unionByName(
        labels.where("label like '#%'").select(F.col("gid").alias("gid_x"), F.col("gid").alias("gid_y"))
    ).distinct()
    m = labelled.select("gid", "id", "comp", "n")
    wide = apart.join(m.select(*[F.col(c).alias(f"{c}_x") for c in m.columns]), "gid_x").join(
        m.select(*[F.col(c).alias(f"{c}_y") for c in m.columns]), "gid_y"
    )
    wide = wide.where((F.col("comp_x") != F.col("comp_y")) & (100 * F.least("n_x", "n_y") >= SIMILAR * F.greatest("n_x", "n_y")))
    rest = wide.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b"))
    # Of each pair of components the pairs are checked once; what they link joins the components.
    more = cut(linked(rest, docs, id_col, text_col))
    joined = more.join(comps.select(F.col("key").alias("a"), F.col("comp").alias("ca")), "a").join(
        comps.select(F.col("key").alias("b"), F.col("comp").alias("cb")), "b"
    )
    heads = comps.select(F.col("comp").alias("key")).distinct()
    final = connected_components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")), heads)
    comps = comps.join(final.select(F.col("key").alias("comp"), F.col("comp").alias("component_id")), "comp").select("key", "component_id")

    classes = reps.join(comps, reps["id"] == comps["key"]).select("set_id", "component_id")
    classes = cut(classes.groupBy("set_id").agg(F.min("component_id").alias("component_id")))
    return _with_component(sets, classes).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def list_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of every token's rows, once each and in no order; columns get the suffixes _x and _y.

    A list of more than ``BLOCK`` rows is dealt into blocks, and each pair of its blocks is a join key of its
    own. A row goes to as many keys as its list has blocks.
    """
    long = cut(rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).where("_blocks > 1"))
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = rows.join(_small_side(long), "token", "left").withColumn("_own", F.pmod(F.xxhash64("gid"), blocks).cast("int"))
    dealt = dealt.withColumn("_last", blocks - 1)
    own = [c for c in rows.columns if c != "token"]

    def side(name: str, others) -> DataFrame:
        keys = [F.col("_own"), F.col("_other")] if name == "x" else [F.col("_other"), F.col("_own")]
        out = dealt.withColumn("_other", F.explode(others))
        return out.select("token", keys[0].alias("_bx"), keys[1].alias("_by"), *[F.col(c).alias(f"{c}_{name}") for c in own])

    x = side("x", F.sequence(F.col("_own"), F.col("_last")))
    y = side("y", F.sequence(F.lit(0), F.col("_own")))
    return x.join(y, ["token", "_bx", "_by"]).where("_bx < _by or gid_x < gid_y")


def _with_component(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``sets`` with the component of their set, null where it has none. Hot sets, fewer than ``HOT_SHARE``,
    are broadcast; rows without words meet nothing."""
    total = sets.count()
    often = sets.where("n > 0").groupBy("set_id").agg(F.count("*").alias("_rows")).where(F.col("_rows") * HOT_SHARE > total)
    often = cut(often.select("set_id"))
    hot = cut(F.broadcast(often).join(classes, "set_id", "left")).withColumn("_hot", F.lit(True))
    marked = sets.where("n > 0").join(F.broadcast(hot), "set_id", "left")
    rest = marked.where("_hot is null").drop("component_id").join(classes, "set_id", "left")
    names = ["doc_id", "n", "component_id"]
    bare = sets.where("n = 0").withColumn("component_id", F.lit(None).cast(classes.schema["component_id"].dataType))
    return marked.where("_hot").select(names).unionByName(rest.select(names)).unionByName(bare.select(names))


def _shared(spread: DataFrame) -> DataFrame:
    """The rows of shingles that have another row; rows of salted shingles all stay."""
    dealt = spread.repartition("token", "salt").sortWithinPartitions("token", "salt")
    names = spread.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and whether the row before it has its shingle
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            token, salt = batch.column("token").to_numpy(), batch.column("salt").to_numpy()
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            keep = batch.column("salts").to_numpy() > 1
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None:
                keep[0] |= held[1]
            last = bool(same[-1]) if len(same) else bool(held is not None and held[1])
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
            held = (batch.slice(batch.num_rows - 1), last)
        if held is not None and (held[1] or held[0].column("salts")[0].as_py() > 1):
            yield held[0]

    return dealt.select(*names).mapInArrow(run, spread.schema)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every similarity class the document with the smallest id, with its own columns; documents
    without words or without an id stay."""
    classes = similarity_classes(docs, id_col, text_col)
    gone = classes.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
