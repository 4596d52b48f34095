"""A corpus pipeline of five stages over documents; each stage's result is written and reread as the next one's input.

All stages bear null ids, which no stage but the last leaves out, null and empty texts, rows that repeat, empty tables and further columns; but for the last they
return the columns they were given. What they do in such cases is said beside the operators that they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.llm import decontam, line_dedup, mixing, ngram_join, quality
from chunkwise.llm.common import new_folder, table, unused


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occurred before; those of which nothing is left go."""
    return line_dedup.drop_repeated_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each_group(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mixture: a row with all columns of the document for each epoch in which it is taken, and domain, epoch and n_tokens.

    Texts without a token and null ids are never taken. Rows alike in id and text are taken as often as there are of them, each with the columns of one of
    them. Names that docs has already get an underscore in front.
    """
    key, digest, *names = unused(docs, "__id", "__md5", "domain", "epoch", "n_tokens")
    taken = mixing.mix(docs).select(F.col("doc_id").alias(key), F.col("__text").alias(digest), *(F.col(c).alias(n) for c, n in zip(("__domain", "__epoch", "__tokens"), names)))
    texts = docs.dropDuplicates(["doc_id", "text"])
    return texts.join(taken, (texts["doc_id"] == F.col(key)) & (F.md5(texts["text"]) == F.col(digest))).drop(key, digest)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources", mixed),
]

#: The classifier and the budgets are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, in order."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
