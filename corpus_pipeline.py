"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor left; all but
the last return the columns of ``docs``. Decisions take effect: rejected documents go,
frequent lines are cut out, one document of each group of near copies stays, and the mixture
repeats or leaves out rows. Documents that rejection and dedup do not touch come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import langid, linededup, mixing, nearcopies, packing
from textloom.llm.common import held_out, table
from textloom.llm.queries import END_ID, ROOM, tokenizer_file
from textloom.runtime import cut


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that language ID rejects go."""
    return langid.keep_known(docs, ~held_out(F.col("doc_id")))


def rare_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    kept = linededup.dedup(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints within four bits, by the rules of the SimHash query,
    and five-word shingles of Jaccard similarity 0.8 or more, most of which four bits miss.
    """
    return nearcopies.dedup(docs, words=5, least=0.8, radius=4, print_words=4)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packed(docs, tokenizer_file(), END_ID, ROOM)


STAGES = [
    ("language", known_language),
    ("lines", rare_lines),
    ("near_copies", one_of_each),
    ("mixture", mixture),
    ("packing", sequences),
]

#: SQL has no such language model, tokenizer or packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
