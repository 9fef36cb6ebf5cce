"""The corpus pipeline: from the documents table to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is written and read again before the next one.
All but the last return the columns of documents. Empty tables pass through; nulls, repeated rows and odd texts are handled as
each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, ngram_join, packing, quality, secrets
from tidewatch.session import materialise, shared_dir, working_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    with working_tables(spark):  # texts are judged by the model and the limits alone
        judge = quality.Classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge.kept(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; a repeated row once.

    Documents without words are in no group and stay, as does a row without a doc_id, which nothing could name.
    """
    with working_tables(spark) as keep:
        groups = keep(materialise(ngram_join.ngram_jaccard_join(docs)))
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    # the dropped ids grow with the corpus: a merge join at every size, never a broadcast
    kept = docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if not repeated.head(1):
        return kept
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(
        kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked; n_chars follows the text."""
    masked = secrets.redact(docs, shared_dir(spark, "ledger"))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: Models, edit distances and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
