"""The corpus pipeline: quality rules, near copies, repeated passages, benchmark leaks, piece ids.

Every stage takes what the one before kept, whole. Rejected documents, further copies and leaked or repeated words are gone for good;
where a text changes, ``n_chars`` follows it. The last stage gives piece ids in place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlog.llm import decontaminate, jaccard, pieces, quality, substrings
from decisionlog.llm.shared import stored


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the length of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule of the cascade lets pass."""
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words that a document with a smaller id has too."""
    return _counted(substrings.remove_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows."""
    return _counted(decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best piece ids of each text, the next paths, and the other columns."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: A* over a piece lattice has no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
