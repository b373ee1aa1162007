"""Passages that repeat one sequence of words at once, several times.

A text's words become numbers, and the numbers are compared with themselves shifted by every lag up to n / min_exp: a stretch of equal
places is a passage of that period. For larger lags the comparison first looks at every few places only: a passage of exponent min_exp is
so long that four of them in a row fall into it, and lags without four equal places in a row are done. Texts are read row by row; long
ones are dealt out as ranges of lags, so that several machines compare one text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table

MIN_WORDS, MIN_EXP = 6, 4
#: Bytes of a text that one task compares whole; longer ones are dealt by lags, so many that lags times words are about CELLS.
LONG, CELLS = 1 << 16, 1 << 25
#: Places of a block of lags that are compared at a time.
BLOCK = 1 << 21


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes.split takes exactly space and 9-13


def planted(words: list, doc_id: int | str | None) -> list:
    """The contract's texts: one of ten ids has the words from a place on replaced by repetitions of the first of them; a null id has none."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def word_ids(words: list) -> np.ndarray:
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _stretches(x: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each longest run of places i with x[i] = x[i + lag], of ``least`` places or more."""
    differs = np.flatnonzero(x[lag:] != x[:-lag])
    borders = np.concatenate([[-1], differs, [len(x) - lag]])
    for k in np.flatnonzero(np.diff(borders) > least).tolist():
        yield int(borders[k]) + 1, int(borders[k + 1] - borders[k]) - 1


def repetitions(x: np.ndarray, lo: int, hi: int, min_words: int = MIN_WORDS, min_exp: int = MIN_EXP) -> list[tuple[int, int, int]]:
    """(start, length, lag) of all longest passages of lag ``lo`` to ``hi`` - 1 that have at least max(min_words, min_exp * lag) words; multiples of a passage's least period are among them."""
    n, out = len(x), []
    hi = min(hi, n // min_exp + 1)
    least = lambda q: max(1, min_words - q, (min_exp - 1) * q)  # noqa: E731  equal places of a passage
    while lo < hi:
        step = least(lo) // 4  # a passage of lag lo or more holds four places of this step
        end = min(hi, 2 * lo, lo + max(1, BLOCK // max(1, n // max(step, 1))))
        lags = np.arange(lo, end)
        if step > 1:
            at = np.arange(0, n, step)
            there = at[None, :] + lags[:, None]
            same = (x[np.minimum(there, n - 1)] == x[at][None, :]) & (there < n)
            four = same[:, :-3] & same[:, 1:-2] & same[:, 2:-1] & same[:, 3:]
            lags = lags[four.any(1)]
        for q in lags.tolist():
            out += [(s, m + q, q) for s, m in _stretches(x, q, least(q))]
        lo = end
    return out


def runs_of(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period: what :func:`repetitions` gives for a multiple of a period is the same stretch as for the period itself."""
    least: dict[tuple[int, int], int] = {}
    for s, m, q in found:
        least[s, m] = min(q, least.get((s, m), q))
    return sorted(((s, m, q) for (s, m), q in least.items()), key=lambda r: (r[0], r[2]))


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    marks = np.zeros(len(words) + 1, np.int64)
    for s, m, q in runs:
        marks[s + q] += 1
        marks[s + m] -= 1
    kept = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
    collapsed = words if len(kept) == len(words) else [words[i] for i in kept.tolist()]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed)).hexdigest())


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[:5], "Int64"))


def _short(doc_id: Column, text: Column, plant: bool) -> Column:
    def each(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for i, t in zip(ids, texts, strict=True):
            w = planted(words_of(t), i) if plant else words_of(t)
            out.append(digest(w, runs_of(repetitions(word_ids(w), 1, len(w)))))
        return _frame(out)

    each.__annotations__ = {"ids": pd.Series, "texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(each, FIELDS)(doc_id.cast("string"), text)


def _long(doc_id: Column, text: Column, runs: Column, plant: bool) -> Column:
    def each(ids: pd.Series, texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for i, t, f in zip(ids, texts, found, strict=True):
            w = planted(words_of(t), i) if plant else words_of(t)
            some = [] if f is None else [(int(r["start"]), int(r["length"]), int(r["period"])) for r in f]
            out.append(digest(w, sorted(some, key=lambda r: (r[0], r[2]))))
        return _frame(out)

    each.__annotations__ = {"ids": pd.Series, "texts": pd.Series, "found": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(each, FIELDS)(doc_id.cast("string"), text, runs)


def _lag_ranges(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) to (doc_id, key, lo, hi, ids): the numbers of a text's words with each range of lags."""
    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            w = planted(words_of(text), doc_id) if plant else words_of(text)
            x, most = word_ids(w).tobytes(), len(w) // MIN_EXP + 1
            width = max(1, CELLS // max(1, len(w)))
            los = range(1, most, width)
            columns = [pa.array([v] * len(los), t) for v, t in ((doc_id, pa.int64()), (key, pa.string()))]
            columns += [pa.array(list(los), pa.int32()), pa.array([lo + width for lo in los], pa.int32()), pa.array([x] * len(los), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "lo", "hi", "ids"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, key, lo, hi, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            found = repetitions(np.frombuffer(ids, np.int32), lo, hi)
            columns = [pa.array([doc_id] * len(found), pa.int64()), pa.array([key] * len(found), pa.string())]
            columns += [pa.array([r[i] for r in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "start", "length", "lag"])


def periodic_runs(docs: DataFrame, plant: bool = False, long: int = LONG) -> DataFrame:
    """The runs of every row of ``docs`` (doc_id, text): doc_id and n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    A run is a longest stretch of words with least period q that has max(MIN_WORDS, MIN_EXP * q) words or more; of runs of equal length the first, then that of the lesser
    period, is shown. ``collapsed`` is the text without what a run repeats. A null or empty text, and one of white space, has no words and no run: nulls and the digests of
    nothing. Repeated rows stay; a null id stays null; other columns are ignored. With ``plant`` texts are first changed by their ids as the contract says.

    Texts over ``long`` bytes are dealt out as ranges of lags; a task holds one text, and a text's runs are fewer than its words.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    far = rows.where(is_long).select("doc_id", F.md5("text").alias("key"), "text")
    with bounded_batches(spark):
        short = materialise(rows.where(~is_long).select("doc_id", _short(F.col("doc_id"), F.col("text"), plant).alias("r")).select("doc_id", "r.*"), "short")
    with bounded_batches(spark, 16):
        ranges = far.dropDuplicates(["doc_id", "key"]).mapInArrow(lambda b: _lag_ranges(b, plant), "doc_id long, key string, lo int, hi int, ids binary")
        compared = ranges.repartition("doc_id", "key", "lo").mapInArrow(_compared, "doc_id long, key string, start long, length long, lag long")
        runs = compared.groupBy("doc_id", "key", "start", "length").agg(F.min("lag").alias("period"))
        by_text = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
        joined = far.join(by_text.withColumnsRenamed({"doc_id": "of_id", "key": "of"}), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of")), "left")
        whole = materialise(joined.select("doc_id", _long(F.col("doc_id"), F.col("text"), F.col("runs"), plant).alias("r")).select("doc_id", "r.*"), "whole")
    return short.unionByName(whole)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
