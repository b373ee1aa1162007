"""A corpus in five stages: language, quality, near-duplicates, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns the columns of documents, the last
one token pieces in their sequences. ``run`` writes each stage's rows to the shared checkpoint folder and reads them again.
The first two stages return what runs later in small Arrow batches, so a stage called by itself leaves the session's batch size small;
``run`` restores it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.llm import langid, quality
from lagfield.llm.common import BATCH, bound_batches, bounded_batches, discard, materialise, owned, sweep, table
from lagfield.llm.mixing import mixed_documents
from lagfield.llm.packing import pack, pieces
from lagfield.llm.simhash import keep_one

#: Pieces to a packed sequence, at most: very short documents meet this limit before that of the tokens.
DOCUMENTS = 32


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose two best languages encode them alike. The dictionaries come from documents with a lang."""
    model = langid.learn(docs)
    if not model:
        return docs
    bound_batches(spark)
    return docs.where(langid.predict(F.col("text"), model)["accepted"])


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are more likely toxic or poor than good by a model of the rated ones; without ratings all stay."""
    bound_batches(spark)
    model = quality.learn(docs, quality.grades_of(table(spark, sf_dir, "labels")), 3)
    return docs.where(quality.grade(F.col("text"), model)["selected"]) if model.weights.any() else docs


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates: SimHash links, each checked by the texts' shingles, and the exact join's for what SimHash leaves apart."""
    return keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out and repeat documents so that their sources come near the target weights."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2,048 tokens and DOCUMENTS pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with bounded_batches(spark):
        return pack(pieces(docs, by_task=True), documents=DOCUMENTS)


def tidy(stage: Callable) -> Callable:
    """``stage``, before which the tables go that an earlier stage has written for itself and ``docs`` no longer reads."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, "pipeline", docs)
        with owned("pipeline"):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, tidy(stage)) for name, stage in (("language", language), ("quality", graded), ("near-duplicates", deduplicated), ("mixing", mixed), ("packing", packed))]

#: Compression, hashing and tokens are beyond SQL; tests/llm/test_registered.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, batch = table(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES[:-1]:
            before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
            discard(before)  # the documents themselves are no table of ours and stay
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(BATCH, batch)
