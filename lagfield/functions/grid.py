"""The time grid: samples, active windows, shifts, folds. Sample numbers truncate toward zero."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def n_samples(duration: float, frequency: float) -> int:
    return ceil(duration * frequency)


def time_grid(recordings: DataFrame, frequency: float) -> DataFrame:
    """``recordings`` (recording, duration) to one row (recording, t_idx) for each sample."""
    last = F.ceil(F.col("duration") * frequency).cast("int") - 1
    return recordings.where(last >= 0).select("recording", F.explode(F.sequence(F.lit(0), last)).alias("t_idx"))


def sample(time: Column, frequency: float) -> Column:
    return (time * frequency).cast("int")


#: A column of rows that know how many samples their own recording has.
LENGTH = "n_samples"


def lengths(signal: DataFrame) -> DataFrame:
    """(recording, n_samples): up to the last sample that the signal has; a row to a recording."""
    return signal.where("t_idx >= 0").groupBy("recording").agg((F.max("t_idx") + 1).cast("int").alias(LENGTH))


def active_window(start: float, end: float, frequency: float, n: int | Column) -> tuple[Column, Column]:
    """The samples [lo, hi) of an element's window [t + start, t + end); none where hi <= lo.

    A window's first sample is kept within the grid of ``n`` samples, so an element that starts after the end still meets the last sample.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    return F.greatest(F.lit(0), F.least(sample(F.col("t") + start, frequency), n - 1)), F.least(sample(F.col("t") + end, frequency), n)


def active_elements(elements: DataFrame, start: float, end: float, frequency: float, n: int | Column) -> DataFrame:
    """Each element at every sample of its :func:`active_window`: an interval join without a join."""
    lo, hi = active_window(start, end, frequency, n)
    return elements.withColumns({"lo": lo, "hi": hi}).where("hi > lo").withColumn("t_idx", F.explode(F.sequence("lo", F.col("hi") - 1))).drop("lo", "hi")


def timeshift(series: DataFrame, shifts: list[int], n: int | Column) -> DataFrame:
    """Lags of a series on the grid (recording, t_idx, vec): slot i holds at row t what the series had at t - shifts[i]. Rows without a source are absent."""
    moved = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), (F.col("t_idx") + s).cast("int").alias("t_idx")) for i, s in enumerate(shifts))))
    return series.withColumn("to", moved).where((F.col("to.t_idx") >= 0) & (F.col("to.t_idx") < n)).select("recording", "to.t_idx", "to.slot", "vec")


def slice_time(df: DataFrame, lo: float, hi: float, column: str = "t") -> DataFrame:
    """Rows strictly between ``lo`` and ``hi``."""
    return df.where((F.col(column) > lo) & (F.col(column) < hi))


def decimate(df: DataFrame, k: int) -> DataFrame:
    """Every k-th sample, renumbered; to be done before any statistics."""
    return df.where(F.col("t_idx") % k == 0).withColumn("t_idx", F.expr(f"CAST(t_idx DIV {k} AS INT)"))


def fold_cuts(n: int, folds: int) -> list[int]:
    """Borders of contiguous folds, the first n % folds of them one longer."""
    small, longer = divmod(n, folds)
    return [i * small + min(i, longer) for i in range(folds + 1)]


def nested_folds(n: int, outer: int = 4, inner: int = 5) -> tuple[list[int], list[tuple[int, int, str, int]]]:
    """Segments and their roles: the sorted borders of all folds, and (outer, inner, role, segment).

    inner -1 has the roles train and test of the outer fold; inner folds cut the rows that the outer test leaves, in order, with
    the roles train and validation.
    """
    cuts = fold_cuts(n, outer)
    spans: list[tuple[int, int, str, list[tuple[int, int]]]] = []
    for o in range(outer):
        lo, hi = cuts[o], cuts[o + 1]
        rest = n - (hi - lo)
        real = lambda a, b: [s for s in ((a, min(b, lo)), (max(a, lo) + hi - lo, b + hi - lo)) if s[0] < s[1]]  # noqa: B023, E731
        spans += [(o, -1, "test", [(lo, hi)]), (o, -1, "train", real(0, rest))]
        within = fold_cuts(rest, inner)
        for i in range(inner):
            a, b = within[i], within[i + 1]
            spans += [(o, i, "validation", real(a, b)), (o, i, "train", real(0, a) + real(b, rest))]
    borders = sorted({0, n, *(x for *_, parts in spans for s in parts for x in s)})
    roles = [(o, i, role, k) for o, i, role, parts in spans for a, b in parts for k in range(len(borders) - 1) if a <= borders[k] and borders[k + 1] <= b]
    return borders, sorted(set(roles))


def with_segment(df: DataFrame, borders: list[int]) -> DataFrame:
    """Adds the number of the segment that a row's sample falls in."""
    inner = [F.when(F.col("t_idx") >= b, 1).otherwise(0) for b in borders[1:-1]]
    return df.withColumn("segment_id", sum(inner, F.lit(0)).cast("int"))


def fold_of(t: Column, n: Column, folds: int) -> Column:
    """The fold that sample ``t`` of ``n`` falls in, with the borders of :func:`fold_cuts`."""
    small, longer = F.floor(n / folds), n % folds
    head = longer * (small + 1)
    return F.when(t < head, F.floor(t / (small + 1))).otherwise(longer + F.floor((t - head) / F.greatest(small, F.lit(1)))).cast("int")


@dataclass(frozen=True)
class Segments:
    """Nested folds of recordings of any lengths, each cut by its own length: ``lengths`` is (recording, n_samples).

    A segment is all samples that have the same part in every outer fold: -1 where they are its test, else the inner fold that they validate. Its number has a digit for each
    outer fold, so that the parts can be read off it, and recordings of different lengths share segments.
    """

    lengths: DataFrame
    outer: int = 4
    inner: int = 5

    def __post_init__(self):
        if (self.inner + 1) ** self.outer >= 1 << 63:
            raise ValueError(f"{self.outer} outer folds of {self.inner} inner ones are too many")

    @property
    def count(self) -> int:
        """How many segments a long recording has."""
        return len(nested_folds(1 << 20, self.outer, self.inner)[0]) - 1

    def on(self, df: DataFrame) -> DataFrame:
        """``df`` (recording, t_idx) with segment_id; samples that lie outside of their recording go."""
        t, n, code = F.col("t_idx"), F.col(LENGTH), F.lit(0).cast("long")
        own = fold_of(t, n, self.outer)
        for o in range(self.outer):
            size = F.floor(n / self.outer) + F.when(n % self.outer > o, 1).otherwise(0)
            part = F.when(own == o, -1).otherwise(fold_of(F.when(own < o, t).otherwise(t - size), n - size, self.inner))
            code = code + (part + 1) * F.lit((self.inner + 1) ** o)
        return df.drop(LENGTH).join(self.lengths, "recording").where((t >= 0) & (t < n)).withColumn("segment_id", code).drop(LENGTH)

    def parts(self, tiles: DataFrame) -> DataFrame:
        """``tiles`` once for each outer fold, with fold and part."""
        digit = lambda o: F.expr(f"CAST(segment_id DIV {(self.inner + 1) ** o}L % {self.inner + 1} - 1 AS INT)")
        roles = F.array(*(F.struct(F.lit(o).alias("fold"), digit(o).alias("part")) for o in range(self.outer)))
        return tiles.withColumn("role", F.explode(roles)).withColumns({"fold": F.col("role.fold"), "part": F.col("role.part")}).drop("role")


def fold_table(spark: SparkSession, n: int, outer: int = 4, inner: int = 5) -> DataFrame:
    """(outer, inner, role, segment_id), a few dozen rows."""
    return spark.createDataFrame(nested_folds(n, outer, inner)[1], "outer int, inner int, role string, segment_id int")


def position_in_sentence(words: DataFrame, order: str = "row_id") -> DataFrame:
    return words.withColumn("position", F.row_number().over(Window.partitionBy("recording", "sentence_id").orderBy(order)) - 1)
