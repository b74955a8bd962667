"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Every stage calls one operator of ``prepkit.llm``; its decisions take effect on
the documents, and all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prepkit.llm.common import stage, table
from prepkit.llm.line_dedup import LineDedup
from prepkit.llm.mixing import Mix
from prepkit.llm.packing import pack_documents
from prepkit.llm.simhash import drop_near_duplicates
from prepkit.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the labels of ``labels`` teach the scorer."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, short ones too (blank ones stay), and documents that lose all their words."""
    return LineDedup(docs, min_words=1).texts()


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each pass that takes any words of a document."""
    return Mix(docs).texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return pack_documents(docs, with_ids=True)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_dedup),
          ("mixing sources to target weights", mixing), ("packing", packing)]

#: Learned models, XXH64, pseudorandom permutations and tokenizers have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
