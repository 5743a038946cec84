"""From raw documents to packed training sequences: five stages, each an operator of
outvote/llm, written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outvote.llm.columns import Beside
from outvote.llm.curriculum_mix import in_training_order, mix
from outvote.llm.jaccard_join import one_of_each
from outvote.llm.line_dedup import dedup_lines
from outvote.llm.packing import pack
from outvote.llm.tokens import default_tokenizer
from outvote.llm.toxicity import without_toxic
from outvote.staging import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models reject go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that has them; n_chars follows the text."""
    rows = Beside(docs)  # under numbers no column can be taken for one that the operator adds
    cleaned = dedup_lines(rows.df, rows.number("doc_id"), rows.number("text")).select(*rows.others())
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken, in the order of training."""
    rows = Beside(docs)
    mixed = mix(rows.df, rows.number("doc_id"), rows.number("text"), rows.number("source"))
    return in_training_order(mixed, rows.numbers).select(*rows.others())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return pack(docs, tokenizer=default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: A language model and MinHash are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
