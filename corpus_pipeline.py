"""A pipeline over whole documents: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Empty tables and nulls pass as the stages'
operators define; a stage never fails on extra columns, which it carries on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.llm import bpe, mixing, quality_rules, secret_scan, simhash
from lumenry.llm.common import ids_sent, settle, table

#: SQL has no learned rules, SimHash classes or byte-pair merges; tests compare with brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.

    Rules are learned from the labelled documents among docs. The verdict is computed in the pass that reads the texts; the row mark in
    the filter keeps the optimizer from computing the figures a second time inside it.
    """
    labels = table(spark, sf_dir, "labels")
    rules = quality_rules.fit(quality_rules.measure_table(quality_rules.labelled_only(docs, labels)), labels)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    measures = quality_rules.figures(quality_rules.measured(whole)).withColumn("_q_row", F.monotonically_increasing_id())
    return quality_rules.judge(measures, rules).where(F.col("kept") & (F.col("_q_row") >= 0)).select("_doc.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of documents alike by 0.8 or more in five-word shingles; of rows that share that doc_id, one.

    Rows without doc_id stay.
    """
    found = settle(simhash.near_duplicates(docs, width=5, similarity=0.8).select("doc_id", "component_id"), narrow=True)
    gone = settle(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    left = docs.join(ids_sent(gone), "doc_id", "left_anti")
    if twice.isEmpty():
        return left
    return left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to two times."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document as digests, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = bpe.vocabulary()
    return bpe.encode_table(docs.select("doc_id", "text"), path, pattern, keep_ids=False, digests=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again; the files go when the session ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
