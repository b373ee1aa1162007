"""One-pass Gram statistics of a banded design and its targets, by segment of the time grid.

Rows become [x, m, 1]: values with missing ones as 0, presence of each slot, and ones. Their Gram and their products with the targets, by
segment, give means, deviations and the Gram of the standardised design for any union of segments, without another pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.functions.grid import Segments, with_segment

from .solve import Stats

#: Samples to a dense block, columns to a tile, and partial tiles that one group adds up.
ROWS, TILE, FAN_IN = 1024, 256, 64

TILES = "segment_id long, ti int, tj int, part long, g array<double>"


@dataclass(frozen=True)
class Layout:
    """Columns of a design: (band, slots, dim) in order; within a band slot-major, then dim."""

    bands: tuple[tuple[str, int, int], ...]

    @property
    def slots(self) -> list[tuple[str, int, int]]:
        return [(b, s, d) for b, n, d in self.bands for s in range(n)]

    @property
    def columns(self) -> list[tuple[str, int, int]]:
        return [(b, s, k) for b, s, d in self.slots for k in range(d)]

    @property
    def band_of(self) -> np.ndarray:
        return np.concatenate([np.full(n * d, i) for i, (_, n, d) in enumerate(self.bands)])

    @property
    def slot_of(self) -> np.ndarray:
        return np.concatenate([np.full(d, i) for i, (_, _, d) in enumerate(self.slots)])

    def only(self, slots: set[int]) -> Layout:
        """The bands and their slots of these numbers; slots are counted anew in their order, and a band without any goes."""
        first = np.cumsum([0, *(n for _, n, _ in self.bands)]).tolist()
        held = [(b, sum(k in slots for k in range(lo, lo + n)), d) for lo, (b, n, d) in zip(first, self.bands, strict=False)]
        return Layout(tuple(x for x in held if x[1]))

    def dense(self, design: pd.DataFrame, times: np.ndarray) -> np.ndarray:
        """Rows [x, m, 1] of the sorted ``times``."""
        p, s = len(self.columns), len(self.slots)
        out = np.zeros((len(times), p + s + 1))
        out[:, -1] = 1
        first = np.concatenate([[0], np.cumsum([d for _, _, d in self.slots])])
        row = np.searchsorted(times, design["t_idx"].to_numpy())
        place = {(b, k): i for i, (b, k, _) in enumerate(self.slots)}
        vecs = design["vec"].to_numpy()
        for key, own in design.groupby(["band", "slot"]).indices.items():
            if key not in place:
                raise ValueError(f"band {key[0]!r} has no slot {int(key[1])} in the layout: a buffer wrote more than it declares")
            i = place[key]
            np.add.at(out, (row[own], slice(first[i], first[i + 1])), np.stack(vecs[own]))
            out[row[own], p + i] = 1
        return out


def partial_tiles(design: DataFrame, signal: DataFrame, layout: Layout, borders: list[int] | Segments, chunk_of: DataFrame, rows: int = ROWS, parts: int | None = None) -> tuple[DataFrame, int]:
    """(segment_id, ti, tj, part, g) for :func:`gram_tiles`, and how many parts a segment has.

    ``borders`` are those of the segments of all recordings, or :class:`Segments` that cut each by its own length. Samples are dealt by segment and by blocks of ``rows`` of a recording into ``parts`` parts, as many as there are shuffle partitions if not given. A task reads its
    blocks in order, holds one of them and one sum, and hands on the sum once for each part: what is handed on grows with the parts and not with the samples.
    """
    targets = [(r.target, r.chunk) for r in chunk_of.select("target", "chunk").orderBy("chunk", "target").collect()]  # the dimension table
    chunks = {c: [t for t, k in targets if k == c] for c in sorted({k for _, k in targets})}
    names, ends = [t for own in chunks.values() for t in own], np.cumsum([0, *(len(own) for own in chunks.values())]).tolist()
    parts = parts or int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segmented = borders.on if isinstance(borders, Segments) else lambda df: with_segment(df, borders)
    of_segment = max(1, -(-parts // max(borders.count if isinstance(borders, Segments) else len(borders) - 1, 1)))
    size = len(layout.columns) + len(layout.slots) + 1
    key = ["segment_id", "part", "recording", "block"]
    placed = lambda df: segmented(df).withColumn("block", F.expr(f"CAST(t_idx DIV {rows} AS INT)")).withColumn("part", F.pmod(F.xxhash64("recording", "block"), F.lit(of_segment)))
    both = placed(design).select(*key, "t_idx", "band", "slot", "vec").unionByName(placed(signal).select(*key, "t_idx", "target", "value"), allowMissingColumns=True)

    def accumulated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by ``key``: blocks are added to the sums of their segment and part."""
        at, unit, held = None, None, []
        g, c, yy = np.zeros((size, size)), np.zeros((size, len(names))), np.zeros(len(names))

        def add() -> None:
            own = pd.concat(held)
            y = own[own["target"].notna()]
            if not len(y):
                return
            wide = y.pivot_table(index="t_idx", columns="target", values="value", aggfunc="sum", fill_value=0.0)
            times = wide.index.to_numpy()
            x = own[own["band"].notna()]
            a, v = layout.dense(x[x["t_idx"].isin(times)], times), wide.reindex(columns=names, fill_value=0.0).to_numpy()
            g.__iadd__(a.T @ a)
            c.__iadd__(a.T @ v)
            yy.__iadd__((v * v).sum(0))

        def handed_on() -> pd.DataFrame:
            out = []
            for i in range(0, size, TILE):
                out += [(*at, i // TILE, j // TILE, g[i : i + TILE, j : j + TILE].flatten()) for j in range(i, size, TILE)]
                out += [(*at, i // TILE, -1 - 2 * k, c[i : i + TILE, lo:hi].flatten()) for k, lo, hi in zip(chunks, ends, ends[1:], strict=False)]
            out += [(*at, 0, -2 - 2 * k, yy[lo:hi].copy()) for k, lo, hi in zip(chunks, ends, ends[1:], strict=False)]
            frame = pd.DataFrame(out, columns=["segment_id", "part", "ti", "tj", "g"])[["segment_id", "ti", "tj", "part", "g"]]
            for sums in (g, c, yy):
                sums.fill(0)
            return frame

        for batch in batches:
            keys = batch[key]
            borders_of = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy()).tolist()
            for lo, hi in zip(borders_of, [*borders_of[1:], len(batch)], strict=True):
                here = tuple(keys.iloc[lo])
                if here != unit:
                    if held:
                        add()
                    if at is not None and here[:2] != at and g[-1, -1]:
                        yield handed_on()
                    unit, at, held = here, (int(here[0]), int(here[1])), []
                held.append(batch.iloc[lo:hi])
        if held:
            add()
            if g[-1, -1]:
                yield handed_on()

    return both.repartition("segment_id", "part").sortWithinPartitions(*key).mapInPandas(accumulated, TILES), of_segment


def gram_tiles(design: DataFrame, signal: DataFrame, layout: Layout, borders: list[int] | Segments, chunk_of: DataFrame, rows: int = ROWS, parts: int | None = None) -> DataFrame:
    """Tiles of the Gram (tj from 0) and of the products with each chunk's targets (tj = -1 - 2 * chunk; the squares of its targets in tj = -2 - 2 * chunk), summed by segment.

    ``design``: (recording, t_idx, band, slot, vec); ``signal``: (recording, t_idx, target, value); ``chunk_of``: (target, chunk). Samples
    count where there is a signal. The sums of all parts are added in rounds of a bounded number; ``rows`` and ``parts`` as for :func:`partial_tiles`.
    """

    def added(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment_id": [key[0]], "ti": [key[1]], "tj": [key[2]], "part": [key[3]], "g": [np.sum(np.stack(g["g"].to_numpy()), 0)]})

    tiles, groups = partial_tiles(design, signal, layout, borders, chunk_of, rows, parts)
    while True:
        groups = -(-groups // FAN_IN)
        tiles = tiles.groupBy("segment_id", "ti", "tj", F.pmod("part", F.lit(groups)).alias("part")).applyInPandas(added, TILES)
        if groups == 1:
            return tiles.drop("part")


def fold_sums(tiles: DataFrame, roles: list[tuple[int, int, str, int]] | Segments) -> DataFrame:
    """``tiles`` by segment to (fold, part, ti, tj, g): part -1 is the outer fold's test, part i its inner validation i. Parts are disjoint, so every training set is a sum of parts."""
    if isinstance(roles, Segments):
        placed = roles.parts(tiles)
    else:
        parts = tiles.sparkSession.createDataFrame([(o, -1 if r == "test" else i, s) for o, i, r, s in roles if r in ("test", "validation")], "fold int, part int, segment_id int")
        placed = tiles.join(F.broadcast(parts), "segment_id")  # a few dozen parts

    def added(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "part": [key[1]], "ti": [key[2]], "tj": [key[3]], "g": [np.sum(np.stack(g["g"].to_numpy()), 0)]})

    return placed.groupBy("fold", "part", "ti", "tj").applyInPandas(added, "fold int, part int, ti int, tj int, g array<double>")


def written_slots(sums: DataFrame, layout: Layout) -> set[int]:
    """Which slots of the layout any sample has, read off the counts on the diagonal of ``sums`` by fold: the parts of fold 0 are all samples."""
    p, size = len(layout.columns), len(layout.columns) + len(layout.slots) + 1
    width = F.least(F.lit(TILE), F.lit(size) - F.col("ti") * TILE)
    diagonal = F.transform(F.sequence(F.lit(0), width - 1), lambda d: F.element_at("g", (d * width + d + 1).cast("int")))
    own = sums.where(f"fold = 0 AND ti = tj AND ti >= {p // TILE}").select("ti", F.posexplode(diagonal).alias("d", "count"))
    held = own.where("count > 0").select((F.col("ti") * TILE + F.col("d") - p).alias("slot")).where(f"slot BETWEEN 0 AND {size - p - 2}").distinct()
    return {r.slot for r in held.collect()}  # no more than the layout has slots


def predict_dense(design: DataFrame, signal: DataFrame, weights: DataFrame, layout: Layout, rows: int = ROWS, most: int = 1 << 23) -> DataFrame:
    """(recording, t_idx, target, value, yhat): predictions beside the observed ``signal`` of the targets that ``weights`` (target, band, slot, dim, value) have.

    ``design`` holds standardised columns. Weights go to every task as one dense matrix of at most ``most`` numbers (and no less than a target's), read as Arrow; beyond that targets
    are predicted group by group, each with a matrix of its own. A task holds one block of ``rows`` samples of a recording. A weight of a column that the layout lacks is an error.
    """
    spark, p = signal.sparkSession, len(layout.columns)
    names = [r.target for r in weights.select("target").where("target IS NOT NULL").distinct().orderBy("target").collect()]  # the dimension table of targets
    per, kind = max(1, most // max(1, p)), weights.schema["target"].dataType.simpleString()
    columns = spark.createDataFrame([(*c, i) for i, c in enumerate(layout.columns)], "band string, slot int, dim int, i int")
    out = None
    for lo in range(0, max(1, len(names)), per):
        own = names[lo : lo + per]
        nth = spark.createDataFrame([(t, j) for j, t in enumerate(own)], f"target {kind}, j int")
        held = weights.join(F.broadcast(nth), "target").join(F.broadcast(columns), ["band", "slot", "dim"], "left").select("i", "j", "value").toArrow()  # no more than columns times ``per``
        if held.column("i").null_count:
            raise ValueError("weights have a column that the layout lacks")
        w = np.zeros((p, len(own)))
        w[held.column("i").to_numpy(), held.column("j").to_numpy()] = held.column("value").to_numpy()
        part = _predicted(design, signal, w, own, layout, rows)
        out = part if out is None else out.unionByName(part)
    return out


def _predicted(design: DataFrame, signal: DataFrame, w: np.ndarray, names: list, layout: Layout, rows: int) -> DataFrame:
    """Predictions of the targets ``names`` by the weights ``w`` (columns, targets)."""
    place = {t: j for j, t in enumerate(names)}
    block = F.expr(f"CAST(t_idx DIV {rows} AS INT)").alias("block")

    def each(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y[y["target"].isin(place)]
        times = np.unique(y["t_idx"].to_numpy())
        yhat = layout.dense(x[x["t_idx"].isin(times)], times)[:, : len(w)] @ w
        own = yhat[np.searchsorted(times, y["t_idx"].to_numpy()), y["target"].map(place).to_numpy(int)] if len(y) else np.zeros(0)
        return y[["recording", "t_idx", "target", "value"]].assign(yhat=own)

    schema = ", ".join(f"{c} {signal.schema[c].dataType.simpleString()}" for c in ("recording", "t_idx", "target", "value")) + ", yhat double"
    left = design.select("recording", block, "t_idx", "band", "slot", "vec").groupBy("recording", "block")
    return left.cogroup(signal.select("recording", block, "t_idx", "target", "value").groupBy("recording", "block")).applyInPandas(each, schema)


class Sums:
    """The assembled sums of one or more chunks' targets by segment or part, and what standardisation makes of them. ``chunks``: how many targets each has; ``slots``: the only ones that count."""

    def __init__(self, tiles: pd.DataFrame, layout: Layout, chunks: dict[int, int], by: str = "part", slots: set[int] | None = None):
        self.layout = layout
        targets, at = sum(chunks.values()), dict(zip(chunks, np.cumsum([0, *chunks.values()]).tolist(), strict=False))
        size = len(layout.columns) + len(layout.slots) + 1
        segments = sorted(tiles[by].unique())
        self.g = {s: np.zeros((size, size)) for s in segments}
        self.c = {s: np.zeros((size, targets)) for s in segments}
        self.yy = {s: np.zeros(targets) for s in segments}
        for s, ti, tj, g in tiles[[by, "ti", "tj", "g"]].itertuples(index=False):
            rows = slice(ti * TILE, min((ti + 1) * TILE, size))
            if tj >= 0:
                cols = slice(tj * TILE, min((tj + 1) * TILE, size))
                part = np.asarray(g).reshape(rows.stop - rows.start, -1)
                self.g[s][rows, cols] = part
                self.g[s][cols, rows] = part.T
            elif (chunk := (-1 - tj) // 2) in chunks:
                own = slice(at[chunk], at[chunk] + chunks[chunk])
                if tj == -1 - 2 * chunk:
                    self.c[s][rows, own] = np.asarray(g).reshape(-1, chunks[chunk])
                else:
                    self.yy[s][own] = np.asarray(g)
        if slots is not None:
            p = len(layout.columns)
            kept = np.concatenate([np.flatnonzero(np.isin(layout.slot_of, sorted(slots))), p + np.array(sorted(slots), int), [size - 1]])
            self.layout = layout.only(slots)
            self.g, self.c = {s: g[np.ix_(kept, kept)] for s, g in self.g.items()}, {s: c[kept] for s, c in self.c.items()}

    def total(self, segments: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = [s for s in segments if s in self.g]
        if not held:
            raise ValueError(f"no sample lies in parts {segments} of a fold: the signal is too short for so many folds")
        return sum(self.g[s] for s in held), sum(self.c[s] for s in held), sum(self.yy[s] for s in held)

    def scaling(self, segments: list[int]) -> np.ndarray:
        """The map from [x, m, 1] to columns standardised by these rows: without variance or never present gives 0."""
        g, _, _ = self.total(segments)
        p, slot = len(self.layout.columns), self.layout.slot_of
        n = np.diag(g)[p + slot]
        some = np.maximum(n, 1)
        mean = g[np.arange(p), p + slot] / some
        var = np.diag(g)[:p] / some - mean**2
        ok = (n > 0) & (var > 1e-12 * np.maximum(1, mean**2))
        scale = np.where(ok, 1 / np.sqrt(np.where(ok, var, 1)), 0)
        out = np.zeros((g.shape[0], p))
        out[np.arange(p), np.arange(p)] = scale
        out[p + slot, np.arange(p)] -= mean * scale
        return out

    def moments(self, segments: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        """Rows, and mean and population variance of the targets."""
        g, c, yy = self.total(segments)
        n = g[-1, -1]
        mean = c[-1] / n
        return n, mean, np.maximum(yy / n - mean**2, 0)

    def stats(self, segments: list[int], scaling: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Stats:
        """Sums of the standardised columns and of (y - mean) / scale over these rows."""
        g, c, yy = self.total(segments)
        n = g[-1, -1]
        cross = (c - np.outer(g[:, -1], mean)) / scale
        return Stats(scaling.T @ g @ scaling, scaling.T @ cross, (yy - 2 * mean * c[-1] + n * mean**2) / scale**2, n)
