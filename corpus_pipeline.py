"""A corpus pipeline of five stages over ``documents``, each applying one operator of ``corpuslens.llm``.

Quality rules drop documents, line chunks drop repeated passages, the Jaccard join keeps one
document of each class of near copies, Pfair scheduling orders the sources, and packing cuts the
ordered corpus into token windows.  Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import jaccard_join, line_chunks, mixing, packing, quality_rules
from corpuslens.llm.common import read_table, written


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs certified on the labelled ones."""
    return quality_rules.filtered(docs, read_table(spark, sf_dir, "labels"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that occur earlier; those left without words go."""
    return line_chunks.cleaned(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id."""
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents stored in the order of their slots; reading by file and row follows the mix."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the mixed corpus lies in the token windows, with its ids."""
    return packing.pack(docs)


STAGES = [("quality rules", judged), ("line dedup", without_repeats), ("jaccard join", without_near_copies),
          ("mixing", mixed), ("packing", packed)]

#: SQL cannot express shingle joins over hashes, the schedule or token ids; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "_"), texts=True)
    return docs
