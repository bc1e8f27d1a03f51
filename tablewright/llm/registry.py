"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import ship_package

Query = Callable[[SparkSession, str], DataFrame]

WINDOW_TOKENS = 4096
TOKEN_LIMIT = 2048
END_ID = 2


def vocabulary() -> str:
    """Place of the vocabulary file on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_words

    return remove_repeated_words(table(spark, sf_dir, "documents"), length=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(), TOKEN_LIMIT)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), vocabulary(), END_ID)


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(), WINDOW_TOKENS, END_ID)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_earlier_bytes

    return remove_earlier_bytes(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import link_documents

    return link_documents(table(spark, sf_dir, "documents"), percent=85, n=3)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .manifest import FIELDS, leaf_digest, leaf_table, manifest
    from .shared import fold

    docs = table(spark, sf_dir, "documents")
    fields = [docs[c] for c in FIELDS]
    lowered = F.when(docs["text"].isNotNull(), fold(docs["text"]))
    tampered = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, leaf_digest(*fields[:-1], lowered))
    return manifest(leaf_table(docs, "source", "doc_id", leaf_digest(*fields), tampered))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), sized AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM folded
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM sized
"""

OP8_SQL = """
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM texts
), shingles AS (
  SELECT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM split WHERE len(w) > 0
), own AS (
  SELECT DISTINCT kind, id, s FROM shingles
), sizes AS (
  SELECT id, count(*) AS n_item FROM own WHERE kind = 'i' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM own d JOIN own i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY d.id, i.id
)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM shared JOIN sizes ON shared.item_id = sizes.id WHERE n_shared * 5 >= n_item * 4
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_substring_dedup, op4_token_counts, op5_exact_dedup, op6_token_files, op7_retrieval_packing, op8_decontamination, op9_suffix_dedup, op10_near_dedup, op11_spelling_variants, op12_merkle_manifest, op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    longer = {"op11_spelling_variants": oracles.OP11, "op12_merkle_manifest": oracles.op12(), "op13_personal_data": oracles.op13()}
    return {"op5_exact_dedup": OP5_SQL, "op8_decontamination": OP8_SQL} | longer
