"""A training corpus from ``documents``: quality, repeated lines, near-duplicates, source mixture, packed sequences.

Each stage is one operator; its rows are written as Parquet and read again by the
next. All stages but the last return the columns of ``documents``; further columns of
the input are left out. Null, empty and blank texts go in the first stage, as do rows
without an id; the other stages take them too and keep them as their operators say. Rows
that repeat an id go on together: the quality stage keeps all if it keeps one, and the
near-duplicate stage keeps all rows of an id that stays. Texts of any length are read
whole, and an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalox.llm.common import materialize, scratch
from catalox.llm.line_dedup import line_dedup
from catalox.llm.mixing import MAX_EPOCHS, mix
from catalox.llm.near_dedup import near_dedup
from catalox.llm.packing import pack
from catalox.llm.quality import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = r"[^\x20\x09-\x0D]+"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Blank texts and rows without an id go; an id stays if one of its rows is kept."""
    kept = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select("doc_id")
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share; ``n_chars`` is that of the text left."""
    return line_dedup(docs, carry=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    kept = near_dedup(docs).filter("kept").select("doc_id")
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents that the mixture takes, once for each epoch that draws them; a leaf's last one is cut to its part of the words, joined by one space."""
    taken = mix(docs, max_epochs=max_epochs).groupBy("doc_id", "epoch").agg(F.max("taken").alias("taken"), F.max("tokens").alias("tokens"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") < F.col("tokens"), cut).otherwise(F.col("text"))
    return docs.select(COLUMNS).join(taken, "doc_id").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", repeated_lines), ("near_dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: The quality and packing stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):  # what the stages leave goes at the end, but for the last one's rows
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=name == STAGES[-1][0])
    return docs
