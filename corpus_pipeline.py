"""The corpus pipeline: documents filtered, deduplicated, mixed and packed in stages.

Each stage is written as Parquet and read again as the next one's documents; all
but the last return the columns of documents.  ``run`` applies them in order, and
removes what a stage's operator wrote on its way once the stage itself is written.

Edge cases, in every stage: a null or empty text has no n-grams and no passages, and is a copy of
nothing; the quality classifier scores it by its intercept alone, the mix takes it with 0 words,
and packing makes it one piece, the end mark.  A null id is like any other; of a class
of copies the smallest id stays, null ids last, and of rows that repeat an id and its text one.  Ties
fall to the smaller id, then the earlier row.  A very long text is read as a whole.  An empty
table gives an empty result.  Further columns stay up to the last stage, whatever their names; the last one
returns the columns of ``packing.packed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherscape.llm import jaccard, mixing, packing, quality, substring
from cipherscape.llm.common import scratch, stage, table
from cipherscape.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labels of rows that aren't held out."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts, the one with the smallest id; texts without words are no class."""
    return jaccard.single_documents(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start in a document with a smaller id."""
    cut = substring.without_repeats(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.packed(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL has no tokenizer, no classifier training and no dependent rounding; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(step(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
