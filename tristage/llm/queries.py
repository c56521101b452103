"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tristage.llm import alignment, bpe, chat, exact_dedup, jaccard, lm, packing, repair, runs, secrets, topk, toxicity, warc
from tristage.llm.columns import crc_of_id, table
from tristage.session import cut, scratch_path

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.duplicate_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


HELD_OUT_SEVENTH, DELETED_SEVENTH = 2, 3


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = crc_of_id() % 7
    kind = F.when(rest == HELD_OUT_SEVENTH, lm.OTHER).when(rest == DELETED_SEVENTH, lm.DELETED).otherwise(lm.LEARN)
    scored = lm.score(table(spark, sf_dir, "documents"), kind)
    return scored.select(
        "doc_id", (F.col("kind") == lm.OTHER).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.expand(turns))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizer_path(WORD_BPE), with_ids=False)
    return packing.pack(pieces)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.top_k(vectors.where("id % 20 = 0"), vectors, 20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-blocks")
    repair.write_blocks(docs, path, tokenizer_path(WORD_BPE))
    return repair.digest_documents(repair.read_blocks(spark, path))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(BYTE_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path).select("doc_id", "ids")
    return bpe.digests(bpe.decode(encoded, path))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


HELD_OUT_THIRD = 1
REJECT = 0.7


def toxicity_network(spark: SparkSession, sf_dir: str) -> toxicity.Network:
    """Learnt from the labels outside the held-out third only."""
    labels = table(spark, sf_dir, "labels").where(crc_of_id() % 3 != HELD_OUT_THIRD)
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_network(spark, sf_dir), score_col="score")
    return scored.select(
        "doc_id",
        (crc_of_id() % 3 == HELD_OUT_THIRD).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )


def with_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text, by the checksum of its id, repeats a stretch of its words up to its end."""
    rest, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if rest % 10 or not n:
        return words
    g = rest // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digests(runs.periodic_runs(docs, rewrite=with_repeats))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written, indexed, looked up by their urls, and read back."""
    pages = table(spark, sf_dir, "pages")
    captures = warc.write_archives(pages, scratch_path(spark, "warc"))
    index = warc.build_index(captures, scratch_path(spark, "captures"))
    found = cut(warc.look_up(index, pages))
    records = warc.read_records(found, pages.schema["page_id"].dataType.simpleString())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Five hexadecimal digits of the SHA-1 are four letters of base 32.
OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, upper(sha1(html)) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align_corpus(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_chat_format": op3_chat_format,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_top_k": op5_top_k,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_files": op7_token_files,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc": op12_warc,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op5_top_k": OP5_SQL, "op12_warc": OP12_SQL}
