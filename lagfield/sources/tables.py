"""Readers and writers. Types are explicit, columns of text files are found by the names in their header, and the order of rows is a column."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

EVENTS = "row_id BIGINT, type STRING, start DOUBLE, duration DOUBLE, text STRING, sentence_id INT, filepath STRING, language STRING"
TRANSCRIPT = "row_id BIGINT, word STRING, start DOUBLE, end DOUBLE, pos STRING, sentence_id INT"
CHANNELS = "recording STRING, name STRING, status STRING, ord INT"
ELECTRODES = "recording STRING, name STRING, x DOUBLE, y DOUBLE, z DOUBLE"


#: What a file's row is where it has not the cells that its header names; and a row's place, while row numbers are made.
MALFORMED, PLACE = "malformed", ["_file", "_start"]


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """The names in the first line; every other file under ``path`` must have the same ones in the same order, which Spark checks as it reads."""
    return spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path).columns


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with row_id: places in file order, from 0 on, by the name of the file, then within it. A file's blocks are counted, and no sort of all rows is needed."""
    spark = rows.sparkSession
    placed = rows.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    blocks = placed.groupBy(*PLACE).agg(F.min("_at").alias("_least"), F.count("*").alias("_rows")).collect()  # one row to a block that is read as one
    before, out = 0, []
    for r in sorted(blocks, key=lambda r: (r["_file"], r["_start"])):
        out.append((r["_file"], r["_start"], before - r["_least"]))
        before += r["_rows"]
    offsets = spark.createDataFrame(out, "_file string, _start long, _offset long")
    return placed.join(F.broadcast(offsets), PLACE).withColumn("row_id", F.col("_at") + F.col("_offset")).drop(*PLACE, "_at", "_offset")


def _text(spark: SparkSession, path: str, schema: str, sep: str, malformed: bool) -> DataFrame:
    """Columns of ``schema`` by the names in the header, in any order. One that the files lack is null, and row_id then the row's place in file order; others are left out.

    Empty cells and ``n/a`` are null. Rows with too few or too many cells, or with a cell that is not of its type, are left out, or with ``malformed`` kept with their line
    in a column of that name, which is null for whole rows. Files of one path share one header: where another file has other names or another order the read fails instead
    of moving cells.
    """
    wanted = StructType.fromDDL(schema)
    names = _header(spark, path, sep)
    held = StructType([StructField(n, StringType()) for n in [*names, MALFORMED]])
    rows = spark.read.schema(held).option("header", True).option("sep", sep).option("enforceSchema", False).option("columnNameOfCorruptRecord", MALFORMED).csv(path)
    at = {n.strip(): F.col(f"`{n}`") for n in names}
    if any(f.name == "row_id" for f in wanted) and "row_id" not in at:
        rows = _numbered(rows)
        at["row_id"] = F.col("row_id").cast("string")
    cell = lambda name: F.when(F.trim(at[name]) != "n/a", at[name])
    typed = {f.name: cell(f.name).try_cast(f.dataType) if f.name in at else F.lit(None).cast(f.dataType) for f in wanted}
    wrong = [cell(n).isNotNull() & c.isNull() for n, c in typed.items() if n in at]
    line = F.coalesce(MALFORMED, F.when(reduce(or_, wrong, F.lit(False)), F.concat_ws(sep, *(F.coalesce(f"`{n}`", F.lit("")) for n in names))))
    out = rows.select(*(c.alias(n) for n, c in typed.items()), line.alias(MALFORMED))
    return out if malformed else out.where(F.col(MALFORMED).isNull()).drop(MALFORMED)


def read_events(spark: SparkSession, path: str, malformed: bool = False) -> DataFrame:
    return _text(spark, path, EVENTS, ",", malformed)


def read_transcript(spark: SparkSession, path: str, malformed: bool = False) -> DataFrame:
    return _text(spark, path, TRANSCRIPT, "\t", malformed)


def read_channels(spark: SparkSession, path: str, malformed: bool = False) -> DataFrame:
    """Channels in file order: ``ord`` is the place in the file where the files have no such column."""
    rows = _text(spark, path, "row_id BIGINT, " + CHANNELS, "\t", malformed)
    return rows.withColumn("ord", F.coalesce("ord", F.col("row_id").cast("int"))).drop("row_id")


def read_electrodes(spark: SparkSession, path: str, malformed: bool = False) -> DataFrame:
    return _text(spark, path, ELECTRODES, "\t", malformed)


def read_features(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """Elements of one feature out of a table that is partitioned by feature."""
    return spark.read.parquet(path).where(F.col("feature") == feature)


def latency_ids(names: DataFrame, key: str) -> DataFrame:
    """Latency ids of the names ``key`` followed by digits, in numeric order."""
    return names.select(F.regexp_extract("name", f"^{key}(\\d+)$", 1).alias("digits")).where("digits <> ''").select(F.col("digits").cast("int").alias("time_id")).orderBy("time_id")


def read_signal(spark: SparkSession, path: str, time_ids: list[int] | None = None, keep: DataFrame | None = None, chunk_size: int = -1, chunk_start: int = 0) -> DataFrame:
    """(recording, time_id, target, t_idx, value) of the latency ids (all by default), the kept targets and, with a size, those from ``chunk_start`` in target order."""
    rows = spark.read.parquet(path)
    if time_ids is not None:
        rows = rows.where(F.col("time_id").isin(*time_ids))  # partitions are pruned
    if keep is None and chunk_size == -1:
        return rows
    targets = rows.select("target").distinct() if keep is None else keep.where("keep").select("target")
    if chunk_size != -1:
        targets = targets.orderBy("target").offset(chunk_start).limit(chunk_size)
    return rows.join(targets, "target", "left_semi")


def write_signal(signal: DataFrame, path: str, mode: str = "overwrite") -> None:
    signal.write.mode(mode).partitionBy("recording").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """One model's long results; only the partitions that ``results`` holds are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "fold", "chunk").parquet(path)


def finished(spark: SparkSession, path: str, model: str) -> set[tuple[int, int]]:
    """The (fold, chunk) of ``model`` that :func:`write_results` has written; none where nothing was."""
    try:
        rows = spark.read.parquet(path).where(F.col("model") == model).select("fold", "chunk").distinct().collect()  # a row to a partition
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {(r.fold, r.chunk) for r in rows}


def gather_results(spark: SparkSession, path: str, model: str, kind: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("model") == model) & (F.col("kind") == kind))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared ``spark.checkpoint.dir``; where that is unset and Spark runs on one machine, in a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/lagfield-{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read back, so that it is computed once and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
