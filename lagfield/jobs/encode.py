"""Encoding models: nested cross-validated banded ridge on the Gram statistics.

The sums of every outer fold's test and inner validation parts are formed once. A task to an outer and an inner fold standardises them, makes their one eigendecomposition,
which serves the alpha search of all targets, and writes all of it to a factor store; Spark adds and compares the losses. Penalties are then tuned chunk of targets by chunk of
targets, by tasks that read the store.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.functions.grid import decimate as every_kth
from lagfield.functions.grid import Segments, lengths
from lagfield.operators.expand import BUFFERS, Buffer, expand
from lagfield.operators.gram import Layout, Sums, fold_sums, gram_tiles, written_slots
from lagfield.operators.scores import best_alpha
from lagfield.operators.solve import DIRECT, Stats, banded_ridge, r2_parts, ridge_cv_init, tune
from lagfield.sources.tables import finished, write_results, written_once


@dataclass(frozen=True)
class Config:
    """``bands`` maps a feature to its buffer's name and window; all windows share one frequency. Slots that no sample has are left out of the fits (``drop_empty``)."""

    model: str
    bands: dict[str, tuple[str, Buffer]]
    outer: int = 4
    inner: int = 5
    alphas: tuple[float, ...] = field(default_factory=lambda: tuple(np.logspace(-3, 8, 40)))
    n_iter: int = 100
    lr: float = 0.01
    optimizer: str = "adam"
    alpha_scope: str = "chunk"
    freeze_forward: bool = False
    chunk_size: int = 100
    rows: int = 1024
    shared_reg: bool = True
    decimate: int = 1
    decimation: Callable[[DataFrame, int], DataFrame] = every_kth
    drop_empty: bool = True

    def layout(self) -> Layout:
        """Without shared_reg each slot is a band of its own."""
        if len({b.frequency for _, b in self.bands.values()}) != 1:
            raise ValueError("all bands share one frequency")
        bands = [(f, BUFFERS[name].slots(b), b.dim) for f, (name, b) in self.bands.items()]
        return Layout(tuple(bands if self.shared_reg else [(f"{f}/{k}", 1, d) for f, n, d in bands for k in range(n)]))

    def layout_of(self, slots: set[int]) -> Layout:
        """The layout of these slots alone, counted anew within their feature: past ones come first, so each direction keeps its order."""
        held = self.layout().only(slots)
        if self.shared_reg:
            return held
        at: dict[str, int] = {}
        named = []
        for band, n, d in held.bands:
            feature = band.rsplit("/", 1)[0]
            named.append((f"{feature}/{at.setdefault(feature, 0)}", n, d))
            at[feature] += 1
        return Layout(tuple(named))


RESULT = "fold int, chunk int, kind string, target int, band string, slot int, dim int, iter int, value double"


def run_encoding(elements: DataFrame | Mapping[str, DataFrame], signal: DataFrame, targets: DataFrame, config: Config, path: str | None = None) -> DataFrame:
    """Fit and score all kept targets. Long rows (fold, chunk, kind, target, band, slot, dim, iter, value, model): kinds are weight, r2, log_lambda and loss.

    ``elements``: as for expand, one table with feature or one for each feature; ``signal``: (recording, t_idx, target, value); ``targets``: (target, keep). Recordings and targets
    keep their types, and each recording is cut into folds by the length of its own signal, where its grid ends as well; if ``targets`` has time_id, each (time_id, target) is fitted as a target of its own, and all three tables' rows carry it.
    With ``path`` results are written there by fold, what is there already is not fitted again, and all that is there of the model is returned.
    """
    spark, keys = signal.sparkSession, _keys(targets)
    index, size, chunks = _numbered(targets, config)
    done = finished(spark, path, config.model) if path else set()
    jobs = [(o, c) for o in range(config.outer) for c in chunks if (o, c) not in done]

    if jobs:
        factors, layout = _store(elements, signal, index, keys, chunks, config)
        alphas = _alphas(factors, config.alpha_scope == "target")

        def result(some: list[tuple[int, int]]) -> DataFrame:
            named = _fit(factors, alphas, layout, chunks, some, size, config).withColumnRenamed("target", "nth").join(index.drop("chunk"), "nth", "left")
            return named.select("fold", "chunk", "kind", *keys, "band", "slot", "dim", "iter", "value", F.lit(config.model).alias("model"))

        if not path:
            return result(jobs)
        alphas = written_once(alphas, "alphas")
        for o in sorted({o for o, _ in jobs}):
            write_results(result([x for x in jobs if x[0] == o]), path)
    elif not path:
        return spark.createDataFrame([], RESULT + ", model string")
    return spark.read.parquet(path).where(F.col("model") == config.model)


def holdout_tuning(elements: DataFrame | Mapping[str, DataFrame], signal: DataFrame, targets: DataFrame, config: Config, optimizers: tuple[str, ...] = ("adam", "lbfgs")) -> DataFrame:
    """Penalties by band that all targets share, tuned on one held-out part: (optimizer, fold, inner, kind, band, iter, value), kinds log_lambda and loss, for every outer and inner fold.

    A task to a fold and its inner part reads the factor store, which is written once for all ``optimizers``: Adam at the rate ``config.lr``, and L-BFGS whose steps meet the strong
    Wolfe conditions. Without kept targets there are no rows.
    """
    index, _, chunks = _numbered(targets, config)
    steps, lr = config.n_iter, config.lr
    if not chunks:
        return signal.sparkSession.createDataFrame([], TUNED)
    factors, layout = _store(elements, signal, index, _keys(targets), chunks, config)
    factors = factors.where("inner >= 0 AND name <> 'loss'").drop("nth", "alpha", "loss")

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = {n: _matrix(own) for n, own in rows[rows["chunk"] == -1].groupby("name")}
        by_chunk = {n: [_matrix(part) for _, part in own.groupby("chunk")] for n, own in rows[rows["chunk"] >= 0].groupby("name")}
        of = lambda role, at: Stats(held[role], np.concatenate(by_chunk[f"{role}_y"], 1), np.concatenate(by_chunk[f"{role}_yy"])[:, 0], float(held["n"][at, 0]))
        out = []
        for name in optimizers:
            delta, losses = tune(of("train", 0), of("val", 1), layout.band_of, len(layout.bands), steps, lr, name)
            at = (name, int(key[0]), int(key[1]))
            out += [(*at, "log_lambda", b, None, float(delta[i])) for i, (b, _, _) in enumerate(layout.bands)]
            out += [(*at, "loss", None, i, float(x)) for i, x in enumerate(losses)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in TUNED.split(", ")]).astype({"iter": "Int32"})

    return factors.groupBy("fold", "inner").applyInPandas(each, TUNED)


TUNED = "optimizer string, fold int, inner int, kind string, band string, iter int, value double"


def _keys(targets: DataFrame) -> list[str]:
    return [c for c in ("time_id", "target") if c in targets.columns]


def _numbered(targets: DataFrame, config: Config) -> tuple[DataFrame, int, dict[int, int]]:
    """Kept targets with their number and chunk, the size of a chunk, and how many targets each chunk has."""
    keys = _keys(targets)
    kept = targets.where("keep").select(*keys).distinct().orderBy(*keys).collect()  # the dimension table of targets
    size = config.chunk_size if config.chunk_size > 0 else max(len(kept), 1)
    kinds = ", ".join(f"{k} {targets.schema[k].dataType.simpleString()}" for k in keys)
    index = targets.sparkSession.createDataFrame([(*r, i, i // size) for i, r in enumerate(kept)], f"{kinds}, nth int, chunk int")
    return index, size, {c: min(size, len(kept) - c * size) for c in range(-(-len(kept) // size))}


def _store(elements: DataFrame | Mapping[str, DataFrame], signal: DataFrame, index: DataFrame, keys: list[str], chunks: dict[int, int], config: Config) -> tuple[DataFrame, Layout]:
    """The written factor store of all kept targets, and the layout of the slots that it has."""
    layout, thins = config.layout(), config.decimate > 1
    thin = (lambda df: config.decimation(df, config.decimate)) if thins else lambda df: df
    grid = written_once(lengths(signal), "lengths")
    segments = Segments(written_once(lengths(thin(signal)), "thin-lengths") if thins else grid, config.outer, config.inner)
    design = thin(expand(elements, config.bands, config.shared_reg, grid))
    own = thin(signal.join(index, keys).select("recording", "t_idx", F.col("nth").alias("target"), "value"))
    tiles = gram_tiles(design, own, layout, segments, index.select(F.col("nth").alias("target"), "chunk"), config.rows)
    sums = written_once(fold_sums(tiles, segments), "fold-sums")
    every = set(range(len(layout.slots)))
    slots = (written_slots(sums, layout) if config.drop_empty else every) or every  # a model without any written slot keeps its bands
    return written_once(_factors(sums, layout, chunks, config, slots), "factors"), config.layout_of(slots)


#: Rows of the factor store: matrices in binary blocks of BLOCK rows, those of all targets (chunk -1) and those of a chunk, and the losses of the alpha search.
FACTORS, BLOCK = "fold int, inner int, chunk int, name string, block int, width int, data binary, nth int, alpha double, loss double", 256


def _rows(fold: int, inner: int, chunk: int, **matrices: np.ndarray) -> list[tuple]:
    wide = {n: m.reshape(len(m), -1) for n, m in matrices.items()}
    return [(fold, inner, chunk, n, i, m.shape[1], np.ascontiguousarray(m[i * BLOCK : (i + 1) * BLOCK]).tobytes(), None, None, None) for n, m in wide.items() for i in range(-(-len(m) // BLOCK))]


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    own = rows.sort_values("block")
    return np.frombuffer(b"".join(own["data"]), np.float64).reshape(-1, int(own["width"].iloc[0]))


def factored(fold: int, inner: int, rows: pd.DataFrame, layout: Layout, chunks: dict[int, int], folds: int, alphas: tuple[float, ...], slots: set[int] | None = None) -> list[tuple]:
    """Rows of the store for an inner fold: its training Gram with the one eigendecomposition that is made of it, its validation Gram, products with the targets by chunk,
    and the losses of all alphas. ``inner`` -1 is the last fit: all training rows, and those held out."""
    sums, size = Sums(rows, layout, chunks, slots=slots), max(chunks.values())
    layout = sums.layout
    if inner >= 0:
        train, val = _inner(sums, folds, inner)
    else:
        parts = list(range(folds))
        scaling = sums.scaling(parts)
        _, mean, var = sums.moments(parts)
        sd = np.where(var > 0, np.sqrt(var), 1.0)
        train, val = sums.stats(parts, scaling, mean, sd), sums.stats([-1], scaling, sums.moments([-1])[1], sd)
    out = _rows(fold, inner, -1, train=train.xtx, val=val.xtx, n=np.array([train.n, val.n]))
    if inner >= 0 or len(layout.columns) > DIRECT:
        values, vectors = np.linalg.eigh(train.xtx)
        out += _rows(fold, inner, -1, values=values, vectors=vectors)
    for chunk, m in chunks.items():
        own = slice(chunk * size, chunk * size + m)
        out += _rows(fold, inner, chunk, train_y=train.xty[:, own], val_y=val.xty[:, own], train_yy=train.yty[own], val_yy=val.yty[own])
    if inner >= 0:
        losses = ridge_cv_init([(train, val)], 1, np.array(alphas), "target", [(values, vectors)])[1] * val.n
        out += [(fold, inner, t // size, "loss", 0, 1, None, t, float(a), float(losses[k, t])) for k, a in enumerate(alphas) for t in range(losses.shape[1])]
    return out


def _factors(sums: DataFrame, layout: Layout, chunks: dict[int, int], config: Config, slots: set[int]) -> DataFrame:
    """The factor store: one task to an outer and an inner fold, and one to an outer fold for the last fit. No more than this reads the Gram."""
    folds, alphas = config.inner, config.alphas
    keyed = sums.withColumn("inner", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1)))).where("part >= 0 OR inner = -1")
    names = [c.split()[0] for c in FACTORS.split(", ")]

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(factored(int(key[0]), int(key[1]), rows, layout, chunks, folds, alphas, slots), columns=names).astype({"nth": "Int32"})

    return keyed.groupBy("fold", "inner").applyInPandas(each, FACTORS)


def _alphas(factors: DataFrame, by_target: bool) -> DataFrame:
    """(fold, chunk, nth, alpha): the alpha of the least validation loss over the inner folds, by chunk (nth null) or by target."""
    losses = factors.where("name = 'loss'").select("fold", "chunk", F.col("nth") if by_target else F.lit(None).cast("int").alias("nth"), "alpha", "loss")
    return best_alpha(losses.groupBy("fold", "chunk", "nth", "alpha").agg(F.sum("loss").alias("loss")), ["fold", "chunk", "nth"])


def _inner(sums: Sums, inner: int, i: int) -> tuple[Stats, Stats]:
    parts = list(range(inner))
    rest = [p for p in parts if p != i]
    scaling = sums.scaling(parts)
    _, _, var = sums.moments(parts)
    sd = np.where(var > 0, np.sqrt(var), 1.0)
    count, mean, inner_var = sums.moments(rest)
    scale = np.maximum(np.sqrt(inner_var * count / max(count - 1, 1)) / sd, 1e-8) * sd
    return sums.stats(rest, scaling, mean, scale), sums.stats([i], scaling, mean, scale)


class Fold:
    """An outer fold out of the factor store: what all chunks share, read once by a task."""

    def __init__(self, shared: pd.DataFrame, inner: int):
        held = {(int(i), n): _matrix(own) for (i, n), own in shared.groupby(["inner", "name"])}
        self.held, self.inner = held, inner
        self.bases = [(held[i, "values"][:, 0], held[i, "vectors"]) for i in range(inner)]
        self.full_basis = (held[-1, "values"][:, 0], held[-1, "vectors"]) if (-1, "values") in held else None

    def chunk(self, own: pd.DataFrame) -> list[tuple[Stats, Stats]]:
        """Training and validation sums of the inner folds, and last those of the whole fit and of what is held out."""
        y = {(int(i), n): _matrix(rows) for (i, n), rows in own.groupby(["inner", "name"])}
        of = lambda i, role, at: Stats(self.held[i, role], y[i, f"{role}_y"], y[i, f"{role}_yy"][:, 0], float(self.held[i, "n"][at, 0]))
        return [(of(i, "train", 0), of(i, "val", 1)) for i in [*range(self.inner), -1]]


def _fit(factors: DataFrame, alphas: DataFrame, layout: Layout, chunks: dict[int, int], jobs: list[tuple[int, int]], size: int, config: Config) -> DataFrame:
    """Weights, scores and penalties by (fold, chunk); a target is its number.

    Chunks are dealt to lanes, no more than run at a time: a lane reads what they share once, so that it is copied by lane and not by chunk.
    """
    spark = factors.sparkSession
    lanes = max(1, min(len(chunks), -(-spark.sparkContext.defaultParallelism // max(1, config.outer))))
    wanted = lambda: F.broadcast(spark.createDataFrame(jobs, "fold int, chunk int").withColumn("lane", F.col("chunk") % lanes))  # noqa: E731  folds times chunks of targets
    own = factors.where("chunk >= 0 AND name <> 'loss'").join(wanted(), ["fold", "chunk"])
    shared = factors.where("chunk = -1").join(F.broadcast(wanted().select("fold", "lane").distinct()), "fold")
    some = shared.unionByName(own).drop("nth", "alpha", "loss")
    inner, optimizer = config.inner, (config.n_iter, config.lr, config.optimizer)
    frozen = config.freeze_forward

    def fit(key: tuple, rows: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        fold, out = Fold(rows[rows["chunk"] == -1], inner), []
        for chunk, mine in rows[rows["chunk"] >= 0].groupby("chunk"):
            *folds, (whole, held) = fold.chunk(mine)
            names = [int(chunk) * size + j for j in range(chunks[int(chunk)])]
            found = best[best["chunk"] == chunk]
            alpha = np.full(len(names), found["alpha"].iloc[0]) if found["nth"].isna().all() else found.set_index("nth")["alpha"].reindex(names).to_numpy()
            start = np.repeat(np.log(alpha)[None, :], len(layout.bands), 0)
            w, delta, losses = banded_ridge(folds, layout.band_of, start, *optimizer, whole, frozen, fold.bases, fold.full_basis)
            r2, at = r2_parts(held, w, layout.slot_of), (int(key[0]), int(chunk))
            out += [(*at, "weight", t, b, s, d, None, w[i, j]) for i, (b, s, d) in enumerate(layout.columns) for j, t in enumerate(names)]
            out += [(*at, "r2", t, b, s, None, None, r2[i, j]) for i, (b, s, _) in enumerate(layout.slots) for j, t in enumerate(names)]
            out += [(*at, "log_lambda", t, b, None, None, None, delta[i, j]) for i, (b, _, _) in enumerate(layout.bands) for j, t in enumerate(names)]
            out += [(*at, "loss", None, None, None, None, i, x) for i, x in enumerate(losses)]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
        return frame.astype({c: "Int32" for c in ("target", "slot", "dim", "iter")})

    best_of = alphas.select(*(F.col(c).alias(c) for c in alphas.columns))  # columns of their own beside those of the store
    found = best_of.join(wanted(), ["fold", "chunk"]).groupBy("fold", "lane")
    return some.groupBy("fold", "lane").cogroup(found).applyInPandas(fit, RESULT)


def model_suite(features: dict[str, Buffer], trees: tuple[str, ...], phonemes: tuple[str, ...]) -> dict[str, Config]:
    """The four models: taps with and without the tree features, buffers, and taps for phonemes with buffers for the rest."""
    of = lambda name, fs: {f: (name, features[f]) for f in fs}
    words = [f for f in features if f not in phonemes]
    return {
        "taps": Config("taps", of("sym_tap", features)),
        "taps_without_trees": Config("taps_without_trees", of("sym_tap", [f for f in features if f not in trees])),
        "buffer": Config("buffer", of("sym_buffer", features)),
        "mixed": Config("mixed", of("sym_tap", [f for f in features if f in phonemes]) | of("sym_buffer", words)),
    }
