"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whole and as they came, whatever other
columns the table has and whatever they are called. A null column other than doc_id, text and source
plays no part; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailstat.llm.common import discard, documents, passing, spool
from trailstat.llm.exact_dedup import distinct_documents
from trailstat.llm.mixing import mixed_documents
from trailstat.llm.neardup import unlike_documents
from trailstat.llm.packing import pack_documents
from trailstat.llm.quality import accepted_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    A null or empty text has no words and goes; a very long one is read whole; repeated rows are judged
    alike; ids and sources, null or not, aren't looked at.
    """
    return accepted_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays.

    A null text is an empty one; texts that differ by runs of white space are equal, however long. A null
    id counts as largest; of repeated rows with the smallest id, the first by file and row stays.
    """
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id stays.

    Texts without words, null or empty, are linked with nothing and stay. So do rows without an id, and
    all rows that bear the smallest id of their group; long texts are compared by all of their shingles.
    """
    return unlike_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves the sources by their target weights.

    A null source is a source of its own; texts aren't read; equal ids come in the order of files and rows.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences.

    A null or empty text is its end alone; a long one is cut and lies in several sequences whole; repeated
    rows are packed each on its own, and a row with a null id under that id.
    """
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The stream's state, signatures, the schedule and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. Each stage's rows are deleted when the next one has been written."""
    return run_over(spark, documents(spark, sf_dir), sf_dir)


def run_over(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:
            made = keep(spool(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = made
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # the pieces lie in tables of their own
    return packed
