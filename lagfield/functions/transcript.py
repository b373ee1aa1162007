"""Transcripts and event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_split_words(words: DataFrame) -> DataFrame:
    """The first row, by row_id, of each (recording, start)."""
    nth = F.row_number().over(Window.partitionBy("recording", "start").orderBy("row_id"))
    return words.withColumn("nth", nth).where("nth = 1").drop("nth")


def normalize_transcript(words: DataFrame, language: str = "english") -> DataFrame:
    """Words without punctuation rows (a null pos stays), lower case, letters only; duration is end - start."""
    kept = words.where(~F.col("pos").eqNullSafe("punct"))
    text = F.regexp_replace(F.lower("word"), "[^a-zA-Z]", "")
    return kept.withColumns({"duration": F.col("end") - F.col("start"), "text": text, "type": F.lit("Word"), "language": F.lit(language)}).drop("word")


def element_times(events: DataFrame, kind: str) -> DataFrame:
    """Events of one type with t, the time of their end."""
    return events.where(F.col("type") == kind).withColumn("t", F.col("start") + F.col("duration"))


def union_events(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def label_offsets(words: DataFrame, gap: float = 0.15, step: float = 0.3) -> DataFrame:
    """Adds level and offset: in a sentence each word that starts within ``gap`` of the one before is raised a step above it."""
    order = Window.partitionBy("recording", "sentence_id").orderBy("start", "row_id")
    apart = F.when(F.col("start") - F.lag("start").over(order) < gap, 0).otherwise(1)
    session = Window.partitionBy("recording", "sentence_id", "session").orderBy("start", "row_id")
    crowded = words.withColumn("apart", apart).withColumn("session", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return crowded.withColumn("level", F.row_number().over(session) - 1).withColumn("offset", F.col("level") * step).drop("apart", "session")
