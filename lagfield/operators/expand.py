"""Events onto the time grid: taps, stacks, queues, sentence-aware buffers and lags.

``elements``: (recording, element_id, t, vec array<double>), with sentence_id and position for the sentence-aware buffers, whose vec
is an array of arrays indexed [context][dim], or whatever the window's ``in_context`` makes a context's vector of. Elements whose vector
is null or holds null or NaN are dropped. All return a
design (recording, t_idx, slot, vec): an absent row is a slot that was not written. Slots count from 0. Where rows have n_samples, the
grid of their recording ends there, else where the window's duration does.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagfield.functions.grid import LENGTH, active_elements, active_window, n_samples, sample, timeshift


def stored_context(vec: Column, context: Column) -> Column:
    """The vector that an array of vectors has for a context; null where it has none."""
    return F.try_element_at(vec, (context + 1).cast("int"))


@dataclass(frozen=True)
class Buffer:
    """A band's window. ``dim`` is the length of its vectors.

    ``in_context`` (vec, context) gives an element's vector in a context to the sentence-aware buffers. Where it can be computed, no row needs to carry
    those of all contexts, which are as many as a sentence has elements.
    """

    frequency: float
    duration: float
    dim: int
    prediction_start: float = 0.0
    prediction_end: float = 2.0
    period: float = 0.05
    nb_buffer: int = 40
    buffer_duration: float = 2.0
    in_context: Callable[[Column, Column], Column] = stored_context

    @property
    def n(self) -> int:
        return n_samples(self.duration, self.frequency)

    @property
    def tap(self) -> int:
        return ceil(self.period * self.frequency)


def vec_sum(dim: int, vec: str = "vec") -> Column:
    return F.array(*(F.sum(F.col(vec)[d]) for d in range(dim)))


def whole(elements: DataFrame) -> DataFrame:
    return elements.where("vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x))")


def grid_end(rows: DataFrame, b: Buffer) -> Column:
    """How many samples the grid of a row's recording has."""
    return F.col(LENGTH) if LENGTH in rows.columns else F.lit(b.n)


def _taps(elements: DataFrame, b: Buffer, start: float) -> DataFrame:
    """Bins are summed before their slots are written out, so a crowded sample is expanded once."""
    bins = whole(elements).groupBy("recording", grid_end(elements, b).alias(LENGTH), sample(F.col("t") + start, b.frequency).alias("s0")).agg(vec_sum(b.dim).alias("vec"))
    at = bins.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(b.nb_buffer - 1))))
    if b.tap == 1:
        placed = at.withColumn("t_idx", F.col("s0") + F.col("slot"))
    else:
        placed = at.withColumn("t_idx", F.explode(F.sequence(F.col("s0") + F.col("slot") * b.tap, F.col("s0") + (F.col("slot") + 1) * b.tap - 1)))
    placed = placed.where((F.col("t_idx") >= 0) & (F.col("t_idx") < F.col(LENGTH))).select("recording", "t_idx", "slot", "vec")
    return placed if b.tap == 1 else placed.groupBy("recording", "t_idx", "slot").agg(vec_sum(b.dim).alias("vec"))


def tap_add(elements: DataFrame, b: Buffer) -> DataFrame:
    """Future taps: slot k of an element covers its start + k taps; what coincides adds up, what leaves the grid is dropped."""
    return _taps(elements, b, b.prediction_start)


def reverse_tap_add(elements: DataFrame, b: Buffer) -> DataFrame:
    """Past taps: the same from nb_buffer periods earlier."""
    return _taps(elements, b, b.prediction_start - b.period * b.nb_buffer)


def drop_empty_slots(design: DataFrame, band: list[str] | None = None) -> DataFrame:
    """Slots that were never written are removed and the others renumbered, by ``band``; slots are few."""
    by = band or []
    held = design.select(*by, "slot").distinct().withColumn("dense", F.row_number().over(Window.partitionBy(*by).orderBy("slot")) - 1)
    return design.join(held, [*by, "slot"]).withColumn("slot", F.col("dense")).drop("dense")


def _ranked(active: DataFrame, b: Buffer, newest_first: bool) -> DataFrame:
    order = F.desc("element_id") if newest_first else F.asc("element_id")
    rank = F.row_number().over(Window.partitionBy("recording", "t_idx").orderBy(order)) - 1
    return active.withColumn("slot", F.least(rank, F.lit(b.nb_buffer - 1)))


def _buffer(elements: DataFrame, b: Buffer, newest_first: bool, shift: float = 0.0) -> DataFrame:
    active = active_elements(whole(elements), b.prediction_start + shift, b.prediction_end + shift, b.frequency, grid_end(elements, b))
    return _ranked(active, b, newest_first).groupBy("recording", "t_idx", "slot").agg(vec_sum(b.dim).alias("vec"))


def stack_buffer(elements: DataFrame, b: Buffer) -> DataFrame:
    """The active elements of a sample, newest first; those beyond the last slot are added into it."""
    return _buffer(elements, b, True)


def queue_buffer(elements: DataFrame, b: Buffer, shift: float = 0.0) -> DataFrame:
    """The active elements of a sample, oldest first; those beyond the last slot are added into it."""
    return _buffer(elements, b, False, shift)


def _near(elements: DataFrame, windows: list[tuple[Column, Column]], block: int) -> DataFrame:
    """Elements dealt by recording and block of samples, once to each block that their windows meet.

    Rows grow after this shuffle, by the samples of every window, so partitions are not left to be merged by what is shuffled.
    """
    parts = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions")) * len(windows)
    none = F.array().cast("array<int>")
    met = (F.coalesce(F.when(hi > lo, F.sequence(F.floor(lo / block).cast("int"), F.floor((hi - 1) / block).cast("int"))), none) for lo, hi in windows)
    return elements.withColumn("block", F.explode(F.array_distinct(F.concat(*met)))).repartition(parts, "recording", "block")


def _parse_reset(elements: DataFrame, b: Buffer, sides: list[tuple[bool, float]], legacy_overflow: bool = False) -> DataFrame:
    """``sides``: for each whether the newest comes first, and the shift of its window; the slots of one follow those of the one before.

    Elements are shuffled once to a block, not once to a sample, and meet their samples there.
    """
    windows = [active_window(b.prediction_start + shift, b.prediction_end + shift, b.frequency, grid_end(elements, b)) for _, shift in sides]
    block = 4 * max(1, ceil((b.prediction_end - b.prediction_start) * b.frequency))
    first = F.col("block") * block
    spans = F.array(*(F.struct(F.lit(i).alias("side"), F.greatest(lo, first).alias("lo"), F.least(hi, first + block).alias("hi")) for i, (lo, hi) in enumerate(windows)))
    active = _near(elements.where("vec IS NOT NULL"), windows, block).withColumn("span", F.explode(spans)).where("span.hi > span.lo")
    active = active.withColumns({"side": F.col("span.side"), "t_idx": F.explode(F.sequence("span.lo", F.col("span.hi") - 1))}).drop("span")
    key = Window.partitionBy("t_idx", "side", "recording", "block")
    newest = key.orderBy(F.desc("element_id"))
    turn = F.when(F.col("sentence_id") != F.lag("sentence_id").over(newest), 1).otherwise(0)
    kept = active.withColumn("turn", turn).withColumn("turns", F.sum("turn").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where("turns = 0")
    kept = kept.withColumns({"context": F.max("position").over(key), "held": F.count("*").over(key), "rank": F.row_number().over(newest) - 1})
    age = F.col("held") - 1 - F.col("rank")
    rank = F.when(F.element_at(F.array(*(F.lit(n) for n, _ in sides)), F.col("side") + 1), F.col("rank")).otherwise(age)
    slot = F.col("side") * b.nb_buffer + F.least(rank, F.lit(b.nb_buffer - 1))
    context = F.when(age >= b.nb_buffer, F.col("held") - 1).otherwise(F.col("context")) if legacy_overflow else F.col("context")
    at = kept.select("recording", "block", "t_idx", slot.cast("int").alias("slot"), b.in_context(F.col("vec"), context).alias("vec"))
    return whole(at).groupBy("recording", "block", "t_idx", "slot").agg(vec_sum(b.dim).alias("vec")).drop("block")


def stack_parse_reset(elements: DataFrame, b: Buffer) -> DataFrame:
    """As the stack, but an element of another sentence than the one before clears it: the last run of one sentence stays. Vectors are those of the largest kept position."""
    return _parse_reset(elements, b, [(True, 0.0)])


def queue_parse_reset(elements: DataFrame, b: Buffer, shift: float = 0.0, legacy_overflow: bool = False) -> DataFrame:
    """The same, oldest first; with ``legacy_overflow`` what is added into the last slot takes the context numbered by how many are kept."""
    return _parse_reset(elements, b, [(False, shift)], legacy_overflow)


def _both(past: DataFrame, future: DataFrame, b: Buffer) -> DataFrame:
    """Past slots, then future ones."""
    return past.unionByName(future.withColumn("slot", F.col("slot") + b.nb_buffer))


def sym_tap(elements: DataFrame, b: Buffer) -> DataFrame:
    return _both(reverse_tap_add(elements, b), tap_add(elements, b), b)


def sym_buffer(elements: DataFrame, b: Buffer) -> DataFrame:
    """A queue over the window buffer_duration earlier, then a stack: the nearest element has slot 0 on both sides."""
    return _both(queue_buffer(elements, b, -b.buffer_duration), stack_buffer(elements, b), b)


def sym_parse_reset(elements: DataFrame, b: Buffer) -> DataFrame:
    """The queue over the window buffer_duration earlier, then the stack, both out of one shuffle."""
    return _parse_reset(elements, b, [(False, -b.buffer_duration), (True, 0.0)])


def sym_timeshift(series: DataFrame, b: Buffer, missing_as_zero: bool = False, negated_past: bool = False) -> DataFrame:
    """Past, then future lags of a series that is on the grid. ``missing_as_zero`` fills rows without a source; ``negated_past`` takes minus the future's shift for the past."""
    future = [int((b.prediction_start + i * b.period) * b.frequency) for i in range(b.nb_buffer)]
    past = [-s for s in future] if negated_past else [int((b.prediction_start - i * b.period) * b.frequency) for i in range(b.nb_buffer)]
    lags = timeshift(series, past + future, grid_end(series, b))
    if not missing_as_zero:
        return lags
    grid = series.select("recording", grid_end(series, b).alias(LENGTH)).distinct().select("recording", F.explode(F.sequence(F.lit(0), F.col(LENGTH) - 1)).alias("t_idx")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(2 * b.nb_buffer - 1))))
    zero = F.array(*[F.lit(0.0)] * b.dim)
    filled = F.transform(F.coalesce("vec", zero), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    return grid.join(lags, ["recording", "t_idx", "slot"], "left").withColumn("vec", filled)


def identity_band(series: DataFrame, b: Buffer) -> DataFrame:
    return series.where((F.col("t_idx") >= 0) & (F.col("t_idx") < grid_end(series, b))).select("recording", "t_idx", F.lit(0).alias("slot"), "vec")


def checked_tap(elements: DataFrame, b: Buffer) -> DataFrame:
    """A single-direction tap, which needs one sample to a period."""
    if abs(b.period * b.frequency - 1) > 1e-9:
        raise ValueError("a tap's period must be one sample")
    return tap_add(elements, b)


@dataclass(frozen=True)
class Kind:
    """What a buffer is: everything that a model has to know of it.

    ``expand`` turns its input and a window into a design (recording, t_idx, slot, vec); ``slots`` says how many slots that window has, counted from 0, and ``parameters``
    the class of its windows, which may hold more than :class:`Buffer` does. ``takes`` is its input: elements, elements with ``contexts``, or a ``series`` on the grid.
    """

    expand: Callable[[DataFrame, Buffer], DataFrame]
    slots: Callable[[Buffer], int]
    takes: str = "elements"
    parameters: type = Buffer

    def __call__(self, rows: DataFrame, b: Buffer) -> DataFrame:
        if not isinstance(b, self.parameters):
            raise TypeError(f"this buffer takes a {self.parameters.__name__}, not a {type(b).__name__}")
        lacking = sorted(set(INPUTS[self.takes]) - set(rows.columns))
        if lacking:
            raise ValueError(f"{self.takes} lack {', '.join(lacking)}")
        return self.expand(rows, b)


#: The columns of each kind of input.
INPUTS = {
    "elements": ("recording", "element_id", "t", "vec"),
    "contexts": ("recording", "element_id", "t", "sentence_id", "position", "vec"),
    "series": ("recording", "t_idx", "vec"),
}


def one_side(b: Buffer) -> int:
    return b.nb_buffer


def two_sides(b: Buffer) -> int:
    return 2 * b.nb_buffer


def _lazy(series: DataFrame, b: Buffer) -> DataFrame:
    return sym_timeshift(series, b, missing_as_zero=True, negated_past=True)


#: Buffers by name: :func:`register` puts a user's own beside these.
BUFFERS = {
    "tap": Kind(checked_tap, one_side),
    "reverse_tap": Kind(reverse_tap_add, one_side),
    "stack": Kind(stack_buffer, one_side),
    "queue": Kind(queue_buffer, one_side),
    "stack_parse_reset": Kind(stack_parse_reset, one_side, "contexts"),
    "queue_parse_reset": Kind(queue_parse_reset, one_side, "contexts"),
    "sym_tap": Kind(sym_tap, two_sides),
    "sym_buffer": Kind(sym_buffer, two_sides),
    "sym_parse_reset": Kind(sym_parse_reset, two_sides, "contexts"),
    "sym_timeshift": Kind(sym_timeshift, two_sides, "series"),
    "lazy_timeshift": Kind(_lazy, two_sides, "series"),
    "identity": Kind(identity_band, lambda b: 1, "series"),
}


def register(name: str, expand: Callable[[DataFrame, Buffer], DataFrame], slots: Callable[[Buffer], int], takes: str = "elements", parameters: type = Buffer) -> None:
    """A buffer of a user's own, by a new name."""
    if name in BUFFERS:
        raise ValueError(f"there is a buffer {name!r}")
    if takes not in INPUTS:
        raise ValueError(f"unknown input {takes!r}")
    BUFFERS[name] = Kind(expand, slots, takes, parameters)


def expand(elements: DataFrame | Mapping[str, DataFrame], bands: dict[str, tuple[str, Buffer]], shared_reg: bool = True, lengths: DataFrame | None = None) -> DataFrame:
    """(recording, t_idx, band, slot, vec) of all features: ``bands`` maps a feature to its buffer's name and window. Without shared_reg each slot is a band of its own, whose slot is 0.

    ``elements``: a table for each feature, of the columns that its buffer takes; so vectors, vectors by context and series on the grid meet in one model. Or one table with
    feature, which each band filters; that prunes partitions where it is stored by feature, as read_features expects, and reads other layouts once a band. ``lengths``
    (recording, n_samples) ends the grid of each recording; recordings that it lacks have no rows.
    """
    out = None
    for feature, (name, b) in bands.items():
        rows = elements.where(F.col("feature") == feature).drop("feature") if isinstance(elements, DataFrame) else elements[feature]
        rows = rows if lengths is None else rows.drop(LENGTH).join(lengths, "recording")
        own = BUFFERS[name](rows, b)
        band = F.lit(feature) if shared_reg else F.concat_ws("/", F.lit(feature), "slot")
        own = own.select("recording", "t_idx", band.alias("band"), (F.col("slot") if shared_reg else F.lit(0)).alias("slot"), "vec")
        out = own if out is None else out.unionByName(own)
    return out
