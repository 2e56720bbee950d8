"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reflume.llm import chat_format, chroma, embedding_dedup, mixing, ngram_join, quality, secrets, sentencepiece_codec, token_scan, toxicity


#: Where the vocabulary files of public tokenizers lie.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_RANKS, BYTE_EOD = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: Fixed value: how that vocabulary splits texts.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.align(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.cosine_components(_table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"), sentencepiece_codec.read_model(model))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str, ranks: str = BYTE_RANKS) -> DataFrame:
    return token_scan.document_tokens(_table(spark, sf_dir, "documents"), ranks, BYTE_PATTERN, BYTE_EOD)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chroma_fingerprints": op1_chroma_fingerprints,
        "op2_secret_scan": op2_secret_scan,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_source_mixing": op7_source_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_token_counts": op9_token_counts,
        "op10_chat_format": op10_chat_format,
    }


_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))) END AS grams
  FROM w
), g AS (SELECT doc_id, unnest(grams) AS gram FROM s
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM both_ JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.grams) + len(y.grams) - n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(grams)
"""


_OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_near_dedup": _OP3, "op6_ngram_jaccard": _OP6}
