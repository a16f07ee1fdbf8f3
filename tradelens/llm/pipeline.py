"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is
written as Parquet and reread as the next stage's docs. Every stage but the last returns the columns
of ``documents``.

All stages: null texts are empty texts, null ids come before all others, repeated rows are judged
alike, very long texts are read whole, empty tables give empty tables, and further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import near, packing, quality, repeats, tiling
from tradelens.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language and source's robust ellipsoid go.

    A document without words fails. There are no ties: a distance equal to the cutoff stays.
    """
    return quality.passing(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays; linked are sets of five-word shingles with a Jaccard similarity of 0.8 or more.

    It is the one with the least doc_id; of several rows with that id, one. A row without an id stays
    only where its whole class has none. All texts without words are one class.
    """
    return near.first_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a 13-word window that a document with a smaller id has are cut out; n_chars is that of what is left.

    Rows with one id do not cut each other. A document may be left without words; its row stays.
    """
    cut = repeats.remove_repeats(docs, carry=("lang", "source"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item go; one without words stays."""
    judged = tiling.contaminated(docs, read(spark, sf_dir, "benchmark"), carry=("text", "lang", "source", "n_chars"))
    return judged.where("not contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. A document without words still has its end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]

#: Fingerprints, concentration steps and packing have no SQL form; tests/llm/test_pipeline.py tests each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
