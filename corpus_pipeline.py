"""From documents to token ids: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and all but the last return the columns of
documents. Documents that a stage rejects are gone for the next ones. A stage begins with the heaps that the one before has filled,
so that these are freed first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, jaccard, lines, pieces, registry, toxicity
from lattica.llm.common import free_heaps, materialize


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic (score below 0.3)."""
    return toxicity.drop_toxic(docs, registry.table(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text less the lines that are like an earlier one (edit similarity of 0.8). n_chars is the length of what is left; a document that loses all its
    lines stays, empty."""
    free_heaps(spark)
    out = lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8.
    Multi-index hashing of SimHash fingerprints (seven bits) finds most links, prefix filtering those that are farther apart."""
    free_heaps(spark)
    return jaccard.drop_similar(docs, max_distance=7, shingle=5, min_similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    free_heaps(spark)
    return decontam.drop_contaminated(docs, registry.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and decoded_md5."""
    free_heaps(spark)
    return pieces.with_tokens(docs, registry.MODEL_PATH)


STAGES = [("toxicity", toxic_out), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("sentencepiece", tokenize)]

#: SQL can express none of the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each one keeps is written to the shared folder and read again."""
    docs = registry.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
