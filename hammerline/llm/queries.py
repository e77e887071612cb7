"""The queries of this subpackage: each operator over its whole table, as digests that are easy to compare."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hammerline.llm.alignment import aligned_texts, linked_counts, sha256_or_empty
from hammerline.llm.conversations import repair_conversations
from hammerline.llm.crf_quality import quality_scores
from hammerline.llm.exact_dedup import equal_texts, folded
from hammerline.llm.jaccard_join import jaccard_components
from hammerline.llm.license_scan import license_notices
from hammerline.llm.multi_index import nearest_vectors
from hammerline.llm.packing import pack_documents
from hammerline.llm.pieces import piece_ids
from hammerline.llm.pii import personal_spans
from hammerline.llm.ppm import score_documents
from hammerline.llm.quality_rules import quality_verdicts
from hammerline.llm.suffix_dedup import repeated_bytes

WORD_VOCABULARY, BYTE_VOCABULARY, PIECE_MODEL = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op2_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_notices(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(_table(spark, sf_dir, "documents")).drop("spans")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op7_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op9_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_information_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_spans(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_secret", "n_found")


def op11_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_table(spark, sf_dir, "conversations"))


def op12_radix_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_texts(_table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(folded(F.col("text")).cast("binary"), 256)})


def op13_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_MODEL)
    return linked_counts(aligned_texts(_table(spark, sf_dir, "documents"), *files, groups=sha256_or_empty)).withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_perplexity_rules, op2_count_vector_join, op3_line_field_quality, op4_fuzzy_notices, op5_suffix_dedup, op6_best_fit_packing, op7_partial_matching, op8_inverted_multi_index, op9_distinct_chunks, op10_information_sanitising, op11_run_length_repair, op12_radix_copies, op13_interval_alignment]
    return {f.__name__: f for f in found}


_OP2_SQL = r"""
WITH RECURSIVE
words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT d.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id
"""


_OP12_SQL = r"""
WITH folded AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
groups AS (
    SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM folded)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM groups
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_count_vector_join": _OP2_SQL, "op12_radix_copies": _OP12_SQL}
