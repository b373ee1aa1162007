"""What the operators of this subpackage share: table access and cutting lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than one in so many rows is hot: there are fewer than this many such keys, whatever the table.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By application: the folder of a session that names none.
_own: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; where it is unset and Spark runs on one machine, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-")
        path = _own[app]
    return path.rstrip("/")


#: Who writes tables now, and by application and owner the tables that were written and not discarded.
_owner: list[str] = []
_held: dict[tuple[str, str], list[str]] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts lineage and survives lost executors. :func:`discard` removes it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lagfield-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _owner:
        _held.setdefault((spark.sparkContext.applicationId, _owner[-1]), []).append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialise` that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "written_to", None) if "written_to" in vars(df) else None
        if path:
            _delete(df.sparkSession, path)
            for held in _held.values():
                if path in held:
                    held.remove(path)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables that are written within belong to ``owner``, for :func:`sweep`."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def sweep(spark: SparkSession, owner: str, still: DataFrame) -> None:
    """Remove what ``owner`` has written and not discarded, but for the tables that ``still`` reads."""
    key = (spark.sparkContext.applicationId, owner)
    if not _held.get(key):
        return
    read = "\n".join(still.inputFiles())
    for path in _held.pop(key):
        if path.rsplit("/", 1)[1] in read:
            _held.setdefault(key, []).append(path)
        else:
            _delete(spark, path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python by ``rows`` at a time from now on, for what is returned before it runs."""
    spark.conf.set(BATCH, rows)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Hand texts to Python by ``rows`` at a time within, so that a worker's memory does not follow the session's default; what runs within must be written within."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


#: What empties the caches that Python workers keep from one task to the next.
_emptied: list[Callable[[], None]] = []


def kept_by_workers(empty: Callable[[], None]) -> None:
    """``empty`` clears a cache of a module; tasks under :func:`lean` begin and end without what it holds."""
    _emptied.append(empty)


def give_back() -> None:
    """Empty the caches of :func:`kept_by_workers` and return what is free to the system, which neither Arrow's pool nor the C library does by itself."""
    for empty in _emptied:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, from batches to batches, in a Python worker that gives back what is free before it and after it.

    Workers live on from stage to stage: without this, each holds the sum of what the tasks of all stages have left in it.
    """

    def each(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return each


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str, merge: bool = False, total: int | None = None) -> DataFrame:
    """``rows`` with what ``keyed`` holds, one row to a ``key`` that is never null, with ``count`` rows of ``rows`` each; ``count`` is left out.

    Hot keys are broadcast, fewer than :data:`HOT` of them, so that no task receives the rows of one; the others are joined by key, with ``merge`` at any size by sorting.
    ``total`` is the sum of ``count``, where it is known.
    """
    if total is None:
        total = keyed.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT > total
    hot = F.broadcast(keyed.where(is_hot).drop(count))
    others = keyed.where(~is_hot).drop(count)
    cold = rows.join(F.broadcast(keyed.where(is_hot).select(key)), key, "left_anti").join(others.hint("merge") if merge else others, key)
    return rows.join(hot, key).unionByName(cold)
