"""The corpus pipeline: documents through five operators, each stage's rows written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, neardup, quality_model, sentencepiece_scan, substring
from quillon.llm.common import discard, documents, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.classify(docs.select(COLUMNS), labels).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of least doc_id."""
    return neardup.keep_one_of_each(docs.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every later occurrence of a passage of 20 words or more goes; documents stay, n_chars follows the text."""
    out = substring.remove_repeats(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.mix(docs.select(COLUMNS))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids; the text itself stays behind, as decoding gives it back."""
    vocabulary = sentencepiece_scan.Pieces.load(PIECES)
    encoded = sentencepiece_scan.encode(docs.select(COLUMNS), vocabulary)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: SQL cannot express the classifier, the sampling or the encoding; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; between stages the rows are a table in the shared folder, deleted once its successor stands.

    The table before the last stage stays, as the result reads it.
    """
    docs, spent = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            if spent is not None:
                discard(spent)
            spent = docs
    return docs
