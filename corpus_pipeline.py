"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing of
sources to target weights, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept, written as Parquet and read again; all but the last return the columns of
``documents``.  Stage 5 returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pertscope.llm import line_dedup, mixing, packing, quality_rules, simhash_dedup
from pertscope.llm.common import materialize
from pertscope.llm.queries import MAX_BITS, SHINGLE, tokenizer_path
from pertscope.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs deleted; every document stays."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash_dedup.keep_one(docs, SHINGLE, MAX_BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; a document taken twice is packed twice."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates),
          ("mixing to target weights", mix), ("packing", pack)]

# SQL can't express XXH64 fingerprints, sampling keys or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
