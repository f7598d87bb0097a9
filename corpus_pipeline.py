"""From raw documents to packed sequences: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes the documents that the stage before kept, is written as Parquet in the shared folder and read again.

All stages read doc_id and text (and n_chars where it is there) and let other columns through, whatever they are called. Rows
without id are documents of their own, an empty table stays empty, and texts are used whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm import decontamination, linededup, neardup, packing, toxicity
from storeglean.llm.common import fresh, scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is under 0.5. A null or empty text has the score of a text without any known feature; repeated
    rows have one score. Without usable labels nothing is toxic."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that recur; n_chars is that of the text that is left. Null and empty texts stay, and so does a
    document whose whole text is that of an earlier one. Rows that share an id, and all rows without one, count as one
    document: what recurs only among them stays."""
    n = fresh(docs, "_n")
    changed = linededup.dedup_lines(docs, out=n)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", n_chars)
    return changed.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8; that with the smallest id. Null, empty and
    wordless texts and rows without id stay; of rows that share an id the longest does."""
    return neardup.keep_one(docs, 5, 0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by the benchmark. Texts without words are not; items without words have no part."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences; a null or empty text is its separator alone."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near-duplicates", near), ("decontamination", benchmark), ("packing", pack)]
#: The classifier, the links and the tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
