"""A corpus pipeline of five stages, each by one operator of reflume.llm.

toxicity rejects documents, the n-gram Jaccard join keeps one document of each
group of near-duplicates, the secret scan replaces secrets in texts, mixing
draws documents towards source weights, and SentencePiece encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reflume.llm import mixing, ngram_join, secrets, sentencepiece_codec, toxicity
from reflume.llm.common import Scratch
from reflume.llm.queries import PIECE_MODEL


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, does not find toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group, and all documents without words or without a doc_id.

    Of rows that share doc_id and text one stays.
    """
    scratch = Scratch(spark, "near-duplicates")
    groups = scratch.write(ngram_join.jaccard_components(docs), "groups")
    keep = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = docs.join(keep.select("doc_id"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    again = scratch.write(keep.where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    many = kept.join(again, "doc_id", "left_semi").withColumn("_h", F.sha2("text", 256)).dropDuplicates(["doc_id", "_h"]).drop("_h")
    return kept.join(again, "doc_id", "left_anti").unionByName(many).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, n_chars counted again."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece_ids and n_pieces of every row."""
    coded = sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(PIECE_MODEL))
    return coded.select("doc_id", "source", "piece_ids", F.size("piece_ids").alias("n_pieces"))


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents; every stage is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
