"""From raw documents to packed sequences: five operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm import decontam, jaccard, lines, packing, quality, tokens
from tallyveil.llm.queries import tokenizer_file
from tallyveil.llm.store import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The end id of a document, and the tokens of a sequence.
END_ID, SEQUENCE = 0, 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go. It is fitted on the labels outside the held-out fold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs.select(COLUMNS), model, threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more have go from all of them; n_chars counts what stays."""
    kept = lines.dedup_lines(docs.select(COLUMNS), min_documents=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 or more connect, the one with the smallest id stays."""
    return jaccard.keep_one(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 10 words in a row of a benchmark item, or a shorter item, go."""
    return decontam.clean_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    pieces = packing.tokenize(docs, lambda: tokens.byte_bpe(tokenizer_file("byte_bpe_50k.json")), END_ID, SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Trees, links through several documents and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents; what each stage but the last returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
