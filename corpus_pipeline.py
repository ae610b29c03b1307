"""The corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), with the columns of documents in docs,
and works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import packing, simhash, substring, toxicity
from placeloom.llm.common import cut, table

ORACLE_SQL = None  # learned weights, bit majorities and token ids can't be said in SQL


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon doesn't reject, each row by its own text.

    Null and empty texts are never rejected; null ids, repeated ids and repeated rows go the way of their
    texts; very long texts are read whole. All columns stay, whatever their names. An empty table gives no rows.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.accepts(lexicon)(F.col("text")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates (five-word shingles, similarity 0.8).

    Null and empty texts are one group. Rows with a null id stay. Of rows that repeat an id each goes with its own
    text; of repeated rows one stays. All columns stay, whatever their names. An empty table gives no rows.
    """
    return simhash.near_deduplicated(docs)


def own_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a smaller id has; those of which nothing is left go. n_chars is counted anew.

    Texts that are null, empty or white space before stay. Null ids are larger than any other; rows that repeat an
    id, and repeated rows, take nothing from each other. All columns stay. An empty table gives no rows.
    """
    return substring.cleaned(docs, drop_emptied=True)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids.

    Null and empty texts have their end id; rows with null or repeated ids are documents of their own. An empty table gives no rows.
    """
    return packing.packed(docs)


STAGES = [("toxicity", clean_language), ("near duplicates", one_of_each), ("repeated passages", own_passages), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}-{name.replace(' ', '-')}")
    return docs
