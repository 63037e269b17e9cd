"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps; all
but the last return the columns of ``documents``. SQL cannot express the
learned and merging stages, so ``tests/llm`` checks them against brute force.

Every stage takes whole texts of any length. An empty table stays empty, and columns
besides the five of ``documents`` go at the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm import langid, packing, quality, simhash, suffix
from papersieve.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    Null and empty texts have fewer than ten words and go. Repeated rows are judged alike.
    """
    return quality.keep_good(docs).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language, with ``lang`` as predicted.

    Texts without a letter, null ones among them, go. Learning uses the labels of ``docs``
    that are not held out; without any, documents with a letter stay as they are.
    """
    return langid.keep_identified(docs, langid.fit(docs)).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: texts that are
    connected by pairs with a Jaccard similarity of 0.8 or more over five-word shingles.

    Null counts as the empty text. Of repeated rows one stays; rows without an id all stay.
    """
    return simhash.keep_first(docs).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; ``n_chars`` follows.

    Null texts stay null; a document that loses its whole text stays, empty.
    """
    cut = suffix.without_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    Null and empty texts are one piece of length 0 that takes no place.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
