"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import fresh, spool, table
from reelquery.llm.languages import fit, keep_accepted
from reelquery.llm.line_dedup import remove_boilerplate
from reelquery.llm.mixing import mix
from reelquery.llm.ngram_join import similar_classes
from reelquery.llm.pieces import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents most of whose words are in a known language stay. Null texts and texts without letters go."""
    return keep_accepted(docs, fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but one each; a document that loses all its text goes."""
    cleaned = remove_boilerplate(docs)
    return cleaned.filter((F.col(fresh(docs, "lines_removed")) == 0) | (F.trim("text") != "")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that are connected over similar n-gram sets, the one with the smallest doc_id stays.

    Null doc_ids, null texts and texts without words are similar to nothing and stay; of rows
    with one doc_id all stay or go.
    """
    gone = fresh(docs, "gone")
    dropped = spool(similar_classes(docs).filter("doc_id <> class_id").select(F.col("doc_id").alias(gone)), "dropped")
    return docs.join(dropped.hint("shuffle_hash"), docs["doc_id"] == dropped[gone], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, in a random order."""
    return mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded of each document's whole text."""
    return encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: EM and the segmentation by pieces can't be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = spool(docs, name)
    return docs
