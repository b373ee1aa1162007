"""Folds, statistics, ridge and scores against dense numpy."""

from dataclasses import dataclass, replace
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagfield.functions.grid import Segments, fold_cuts, nested_folds
from lagfield.jobs import encode
from lagfield.jobs.encode import Config, model_suite, run_encoding
from lagfield.operators import expand as ex
from lagfield.operators import scores, solve
from lagfield.operators.envelope import envelope, high_gamma
from lagfield.operators.expand import Buffer, expand, tap_add
from lagfield.operators.gram import Layout, gram_tiles, partial_tiles, predict_dense


@pytest.mark.parametrize("n", [10, 203])
def test_nested_folds(n):
    assert np.diff(fold_cuts(n, 4)).tolist() == [n // 4 + (i < n % 4) for i in range(4)]
    borders, roles = nested_folds(n, 4, 3)
    rows = lambda o, i, r: {t for a, b, c, k in roles if (a, b, c) == (o, i, r) for t in range(borders[k], borders[k + 1])}
    for o in range(4):
        test, train = rows(o, -1, "test"), rows(o, -1, "train")
        assert test | train == set(range(n)) and not test & train
        seen = set()
        for i in range(3):
            v, t = rows(o, i, "validation"), rows(o, i, "train")
            assert v | t == train and not v & t and not v & seen
            seen |= v
            left = sorted(train)
            cuts = fold_cuts(len(left), 3)
            assert sorted(v) == left[cuts[i] : cuts[i + 1]]
        assert seen == train


def problem(seed=0, n=60, targets=3, sizes=(3, 2)):
    rng = np.random.default_rng(seed)
    band = np.repeat(np.arange(len(sizes)), sizes)
    x, y = rng.normal(size=(n, len(band))), rng.normal(size=(n, targets))
    y += x @ rng.normal(size=(len(band), targets))
    return x, y, band


def stats(x, y):
    return solve.Stats(x.T @ x, x.T @ y, (y * y).sum(0), len(x))


def test_ridge_equals_the_dense_solution():
    x, y, band = problem()
    d = np.random.default_rng(1).normal(size=(2, 3))
    w = solve.solve_ridge(stats(x, y), d, band)
    for t in range(3):
        dense = np.linalg.solve(x.T @ x + np.diag(np.exp(d[band, t])), x.T @ y[:, t])
        assert np.allclose(w[:, t], dense)
    assert np.allclose(solve.solve_ridge(stats(x, y), d, band, direct=0), w, atol=1e-9)  # conjugate gradients


def test_gradient_equals_finite_differences():
    x, y, band = problem()
    train, val = stats(x[:40], y[:40]), stats(x[40:], y[40:])
    for d in (np.array([0.3, -0.7]), np.random.default_rng(2).normal(size=(2, 3))):
        _, g, _ = solve.holdout_gradient(train, val, d, band)
        for at in np.ndindex(d.shape):
            e = np.zeros_like(d)
            e[at] = 1e-5
            up, down = (solve.holdout_gradient(train, val, d + s * e, band)[0] for s in (1, -1))
            assert abs(g[at] - (up - down) / 2e-5) < 1e-6


def test_cv_picks_the_best_alpha():
    x, y, band = problem(3)
    folds = [(stats(np.delete(x, slice(a, a + 20), 0), np.delete(y, slice(a, a + 20), 0)), stats(x[a : a + 20], y[a : a + 20])) for a in (0, 20, 40)]
    alphas = np.logspace(-2, 3, 7)
    delta, losses = solve.ridge_cv_init(folds, 2, alphas)
    by_hand = [sum(solve.holdout_loss(v, solve.solve_ridge(t, np.log([a, a]), band)) * v.n / 60 for t, v in folds) for a in alphas]
    assert np.allclose(losses.sum(1), by_hand) and np.allclose(delta, np.log(alphas[np.argmin(by_hand)]))
    for optimizer in ("adam", "lbfgs"):
        _, _, seen = solve.banded_ridge(folds, band, delta, n_iter=30, lr=0.1, optimizer=optimizer)
        assert seen[-1] < seen[0] and abs(seen[0] - min(by_hand)) < 1e-9
    frozen = solve.banded_ridge(folds, band, delta, n_iter=4, freeze_forward=True)[2]
    assert np.allclose(frozen, frozen[0])
    with pytest.raises(ValueError):
        solve.banded_ridge(folds, band, delta, optimizer="sgd")
    assert all(solve.tune(*folds[0], band, 2, 15, optimizer=o)[1][-1] < solve.tune(*folds[0], band, 2, 1)[1][0] for o in ("adam", "lbfgs"))


def test_t_tail_against_published_points():
    for t, df, p in ((2.776445, 4, 0.025), (1.812461, 10, 0.05), (3.169273, 10, 0.005), (1.644854, 10**7, 0.05)):
        assert abs(scores.t_tail(t, df, "greater") - p) < 1e-6 and abs(scores.t_tail(-t, df, "less") - p) < 1e-6


def test_paired_ttest(spark):
    a = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, float("nan"), 7.0])], "target int, r2 double")
    b = spark.createDataFrame([(i, 0.0) for i in range(6)], "target int, r2 double")
    row = scores.paired_ttest(a, b, "greater").first()
    d = np.array([1, 2, 3, 4, 7.0])
    assert row.n == 5 and abs(row.t - d.mean() / (d.std(ddof=1) / 5**0.5)) < 1e-12 and not row.star


def test_paired_ttests_of_many_pairs(spark):
    """One plan, a row a pair: equal to each pair by itself; models without common targets have no t, an unknown name is no error."""
    rng = np.random.default_rng(3)
    rows = [(m, t, float(rng.normal() + i)) for i, m in enumerate("abc") for t in range(9)] + [("d", 100, 1.0), ("a", 50, float("nan")), ("b", 50, 1.0)]
    table = spark.createDataFrame(rows, "model string, target int, r2 double")
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("a", "none"), ("a", "b")]
    got = {(r.model, r.other): r for r in scores.paired_ttests(table, pairs).collect()}
    assert len(got) == 5 and got["a", "d"].n == got["a", "none"].n == 0 and got["a", "d"].p is None and got["a", "none"].t is None
    for a, b in pairs[:3]:
        one = scores.paired_ttest(table.where(F.col("model") == a), table.where(F.col("model") == b)).first()
        assert (got[a, b].n, one.n) == (9, 9) and abs(got[a, b].t - one.t) < 1e-9 and abs(got[a, b].p - one.p) < 1e-12 and got[a, b].star == one.star
    assert scores.paired_ttests(table.limit(0), [("a", "b")]).first().n == 0
    with pytest.raises(ValueError):
        scores.paired_ttests(table, pairs, "both")


def test_strong_wolfe_steps():
    """Both conditions at every step of the tuner, on a ragged line too, and a gradient near zero at its end."""
    x, y, band = problem(3, n=200, targets=3, sizes=(4, 3))
    train, val = stats(x[:120], y[:120]), stats(x[120:], y[120:])
    steps: list = []
    delta, losses = solve.tune(train, val, band, 2, 60, optimizer="lbfgs", accepted=steps)
    assert steps and all(b < a for a, b in zip(losses, losses[1:]))
    for before, way, loss, slope, there, new, slope2, both in steps:
        size = np.linalg.norm(there - before) / np.linalg.norm(way)
        f, g, _ = solve.holdout_gradient(train, val, there, band)
        assert abs(f - new) < 1e-12 and abs(g @ way - slope2) < 1e-9
        if both:
            assert new <= loss + solve.DECREASE * size * slope + 1e-12 and abs(slope2) <= solve.CURVATURE * abs(slope) + 1e-12
    assert sum(s[-1] for s in steps) >= len(steps) - 2  # all but steps at the limit of the arithmetic
    adam = solve.tune(train, val, band, 2, 500, 0.1)[1][-1]
    assert losses[-1] <= adam + 1e-9
    flat = lambda v: (float(np.exp(-v[0])), np.array([-np.exp(-v[0])])) if v[0] < 50 else (0.0, np.array([np.nan]))
    there, new, g2, _ = solve.strong_wolfe(flat, np.zeros(1), 1.0, np.array([-1.0]), np.array([40.0]))
    assert new < 1 and np.isfinite(g2).all() and there[0] < 50
    for scale in (1e-3, 1.0, 1e3):  # far too short and far too long first steps
        f = lambda v: (float((v * v).sum() / 2 + np.cos(3 * v).sum()), v - 3 * np.sin(3 * v))
        at = np.array([4.0, -3.0])
        loss, g = f(at)
        there, new, g2, both = solve.strong_wolfe(f, at, loss, g, -scale * g)
        size = np.linalg.norm(there - at) / np.linalg.norm(scale * g)
        assert both and new <= loss - solve.DECREASE * size * scale * (g @ g) and abs(g2 @ (-scale * g)) <= solve.CURVATURE * scale * (g @ g)


@pytest.mark.parametrize("fs_in, fs_out, n", [(512, 20, 2500), (250, 20, 1300), (499.5, 20, 1700), (1000, 20, 2990), (512, 20, 1)])
def test_envelope_at_any_ratio_of_rates(spark, fs_in, fs_out, n):
    """Blocks give what one block of the whole recording gives away from their edges; bins are means by exact shares; gaps count as 0."""
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.normal(size=n)) * 0.01 + np.sin(2 * np.pi * 100 * np.arange(n) / fs_in)
    raw = spark.createDataFrame([(0, "a", i, float(v)) for i, v in enumerate(x)], "recording int, channel string, t_idx int, value double")
    y = envelope(x, fs_in)
    ratio = Fraction(str(fs_in)) / fs_out
    want = []
    for k in range(-int(-n // ratio)):
        lo, hi = k * ratio, min((k + 1) * ratio, n)
        want.append(sum(y[i] * float(min(i + 1, hi) - max(i, lo)) for i in range(floor(lo), ceil(hi))) / float(hi - lo))
    whole = high_gamma(raw, fs_in, fs_out, block_s=1000).orderBy("t_idx").collect()
    assert [r.t_idx for r in whole] == list(range(len(want))) and np.allclose([r.value for r in whole], want, atol=1e-9)
    blocks = high_gamma(raw.where("t_idx % 7 < 7"), fs_in, fs_out, block_s=1).orderBy("t_idx").collect()
    assert [r.t_idx for r in blocks] == list(range(len(want)))
    assert n == 1 or np.median(np.abs(np.array([r.value for r in blocks]) - want)) < 0.01


def test_envelope_of_a_carrier_and_block_edges(spark):
    t = np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 100 * t) * (1 + 0.5 * np.sin(2 * np.pi * t)) + np.sin(2 * np.pi * 60 * t)
    assert np.abs(envelope(x, 1000)[500:3500] - (1 + 0.5 * np.sin(2 * np.pi * t))[500:3500]).max() < 0.05
    raw = spark.createDataFrame([(0, "a", i, float(v)) for i, v in enumerate(x)], "recording int, channel string, t_idx long, value double")
    rows = high_gamma(raw, 1000, 20, block_s=1).orderBy("t_idx").collect()
    whole = envelope(x, 1000).reshape(80, 50).mean(1)
    assert [r.t_idx for r in rows] == list(range(80)) and np.abs(np.array([r.value for r in rows]) - whole)[4:76].max() < 0.05


def dense_model(spark, elements, signal, config):
    """The first outer fold by plain arrays."""
    n = next(iter(config.bands.values()))[1].n
    layout = config.layout()
    x = np.full((n, len(layout.columns)), np.nan)
    at = {c: i for i, c in enumerate(layout.columns)}
    for r in expand(elements, config.bands).collect():
        for k, v in enumerate(r.vec):
            x[r.t_idx, at[r.band, r.slot, k]] = v
    y = np.zeros((n, 2))
    for r in signal.collect():
        y[r.t_idx, r.target] = r.value
    test = np.arange(n) < fold_cuts(n, config.outer)[1]
    mean, sd = np.nanmean(x[~test], 0), np.nanstd(x[~test], 0)
    z = np.nan_to_num((x - mean) / np.where(sd > 0, sd, 1)) * (sd > 0)
    ym, ys = y[~test].mean(0), y[~test].std(0)
    return z, (y - ym) / ys, (y[test] - y[test].mean(0)) / ys, test, layout


@dataclass(frozen=True)
class Lopsided(Buffer):
    """A window with more slots before an element than after it."""

    before: int = 3
    after: int = 1


def lopsided(elements, b):
    past = tap_add(elements, replace(b, prediction_start=-b.before * b.period, nb_buffer=b.before))
    return past.unionByName(tap_add(elements, replace(b, nb_buffer=b.after)).withColumn("slot", F.col("slot") + b.before))


def check_first_fold(out, z, y, ytest, test, layout, bands):
    """Weights are the ridge solution for the penalties found, and the scores add up to the joint one."""
    at = {c: i for i, c in enumerate(layout.columns)}
    for t in (0, 1):
        w, d = np.zeros(len(at)), np.zeros(len(bands))
        for r in out:
            if r.target == t and r.kind == "weight":
                w[at[r.band, r.slot, r.dim]] = r.value
            if r.target == t and r.kind == "log_lambda":
                d[bands.index(r.band)] = r.value
        ridge = np.linalg.solve(z[~test].T @ z[~test] + np.diag(np.exp(d[layout.band_of])), z[~test].T @ y[~test, t])
        assert np.allclose(w, ridge, atol=1e-7) and np.abs(w).max() > 0
        joint = 1 - ((ytest[:, t] - z[test] @ w) ** 2).sum() / (ytest[:, t] ** 2).sum()
        assert abs(joint - sum(r.value for r in out if r.kind == "r2" and r.target == t)) < 1e-7


def test_features_of_different_shapes_and_a_user_s_buffer_in_one_model(spark, monkeypatch):
    """Taps, sentence-aware vectors by context, a series on the grid and a registered two-sided buffer are fitted together, each from its own table."""
    rng = np.random.default_rng(8)
    n = 83
    rows = [(0, i, float(rng.uniform(0, n)), [float(v) for v in rng.normal(size=2)]) for i in range(40)]
    elements = spark.createDataFrame(rows, "recording int, element_id long, t double, vec array<double>")
    parsed = [(0, i, 2.0 * i, i // 4, i % 4, [[float(v)] for v in rng.normal(size=4)]) for i in range(40)]
    contexts = spark.createDataFrame(parsed, "recording int, element_id long, t double, sentence_id int, position int, vec array<array<double>>")
    series = spark.createDataFrame([(0, t, [float(v) for v in rng.normal(size=3)]) for t in range(n)], "recording int, t_idx int, vec array<double>")
    signal = spark.createDataFrame([(0, t, k, float(rng.normal())) for t in range(n) for k in range(2)], "recording int, t_idx int, target int, value double")
    targets = spark.createDataFrame([(0, True), (1, True)], "target int, keep boolean")
    monkeypatch.setattr(ex, "BUFFERS", dict(ex.BUFFERS))
    monkeypatch.setattr(encode, "BUFFERS", ex.BUFFERS)
    ex.register("lopsided", lopsided, lambda b: b.before + b.after, parameters=Lopsided)
    b = Buffer(frequency=1, duration=n, dim=2, period=1.0, nb_buffer=2, prediction_end=6.0, buffer_duration=3.0)
    bands = {"tap": ("sym_tap", b), "parse": ("stack_parse_reset", replace(b, dim=1)), "lag": ("sym_timeshift", replace(b, dim=3)), "own": ("lopsided", Lopsided(frequency=1, duration=n, dim=2, period=1.0))}
    tables = {"tap": elements, "parse": contexts, "lag": series, "own": elements}
    config = Config("m", bands, alphas=(0.1, 10.0), n_iter=2, lr=0.1, chunk_size=1, rows=16)
    assert [s for _, s, _ in config.layout().bands] == [4, 2, 4, 4]
    out = run_encoding(tables, signal, targets, config).where("fold = 0").collect()
    check_first_fold(out, *dense_model(spark, tables, signal, config), list(bands))
    with pytest.raises(TypeError):
        expand(tables, {"own": ("lopsided", b)})
    with pytest.raises(ValueError, match="position"):
        expand(tables, {"tap": ("stack_parse_reset", b)})
    with pytest.raises(ValueError):
        ex.register("tap", lopsided, lambda b: 1)
    ex.register("short", lopsided, lambda b: b.after, parameters=Lopsided)  # declares fewer slots than it writes
    with pytest.raises(Exception, match="has no slot"):
        run_encoding(tables, signal, targets, replace(config, bands={"own": ("short", bands["own"][1])})).count()


@pytest.mark.parametrize(("outer", "inner"), [(4, 5), (2, 3), (5, 2)])
def test_segments_by_recording(spark, outer, inner):
    """Recordings of any lengths, shorter than the folds too: the parts of every sample are those of its own nested folds; samples outside of a recording go."""
    sizes = {"a": 83, "b": 1, "c": 120, "d": outer * inner + 3}
    lengths = spark.createDataFrame(list(sizes.items()), "recording string, n_samples int")
    samples = spark.createDataFrame([(r, t) for r, n in sizes.items() for t in range(-1, n + 1)], "recording string, t_idx int")
    segments = Segments(lengths, outer, inner)
    got = {(x.recording, x.fold, x.t_idx): x.part for x in segments.parts(segments.on(samples)).collect()}
    assert len(got) == outer * sum(sizes.values())
    for r, n in sizes.items():
        cuts = fold_cuts(n, outer)
        for o in range(outer):
            test = set(range(cuts[o], cuts[o + 1]))
            rest = [t for t in range(n) if t not in test]
            within = fold_cuts(len(rest), inner)
            assert all(got[r, o, t] == -1 for t in test)
            assert all(got[r, o, t] == i for i in range(inner) for t in rest[within[i] : within[i + 1]])
    with pytest.raises(ValueError):
        Segments(lengths, 40, 40)


def test_recordings_of_different_lengths(spark):
    """Each recording is cut by its own length and ends its own grid, whatever duration the windows name; slots that no sample has give no band, weight or penalty."""
    rng = np.random.default_rng(12)
    sizes, outer = {"long": 97, "short": 41}, 3
    rows = [(r, i, float(rng.uniform(0, n - 8)), [float(v) for v in rng.normal(size=2)]) for r, n in sizes.items() for i in range(n // 2)]
    rows += [("short", 1000, 45.0, [1.0, 2.0]), ("none", 0, 1.0, [1.0, 1.0])]  # one starts after its recording has ended, one has no signal
    elements = spark.createDataFrame(rows, "recording string, element_id long, t double, vec array<double>")
    signal = spark.createDataFrame([(r, t, k, float(rng.normal())) for r, n in sizes.items() for t in range(n) for k in range(2)], "recording string, t_idx int, target int, value double")
    targets = spark.createDataFrame([(0, True), (1, True)], "target int, keep boolean")
    b = Buffer(frequency=1, duration=60, dim=2, period=1.0, nb_buffer=2, prediction_end=3.0, buffer_duration=3.0)
    far = replace(b, prediction_start=200.0)  # never on the grid
    bands = {"tap": ("sym_tap", b), "far": ("tap", far), "buffer": ("sym_buffer", b), "mixed": ("sym_tap", replace(b, prediction_start=95.0, nb_buffer=3))}
    config = Config("m", bands, outer=outer, inner=2, alphas=(0.1, 10.0), n_iter=2, lr=0.1, chunk_size=1, rows=16)
    out = run_encoding({f: elements for f in bands}, signal, targets, config).where("fold = 0").collect()

    blocks, kept = [], None
    for r, n in sizes.items():
        own = {f: (name, replace(w, duration=n)) for f, (name, w) in bands.items()}
        x = {(c.t_idx, c.band, c.slot): c.vec for c in expand({f: elements.where(F.col("recording") == r) for f in bands}, own).collect()}
        blocks.append((n, x))
    seen = sorted({(band, slot) for _, x in blocks for _, band, slot in x}, key=lambda k: (list(bands).index(k[0]), k[1]))
    kept = Layout(tuple((f, sum(k[0] == f for k in seen), 2) for f in bands if any(k[0] == f for k in seen)))
    assert 0 < dict((f, n) for f, n, _ in kept.bands)["mixed"] < 6 and "far" not in [f for f, _, _ in kept.bands]
    x = np.concatenate([[np.concatenate([at.get((t, *k), [np.nan] * 2) for k in seen]) for t in range(n)] for n, at in blocks])
    values = {(r.recording, r.t_idx, r.target): r.value for r in signal.collect()}
    y = np.array([[values[r, t, k] for k in range(2)] for r, n in sizes.items() for t in range(n)])
    test = np.concatenate([np.arange(n) < fold_cuts(n, outer)[1] for n in sizes.values()])
    with np.errstate(invalid="ignore"):
        mean, sd = np.nanmean(x[~test], 0), np.nanstd(x[~test], 0)
    z = np.nan_to_num((x - mean) / np.where(sd > 0, sd, 1)) * (sd > 0)
    ym, ys = y[~test].mean(0), y[~test].std(0)
    check_first_fold(out, z, (y - ym) / ys, (y[test] - y[test].mean(0)) / ys, test, kept, [f for f, _, _ in kept.bands])
    assert {(r.band, r.slot) for r in out if r.kind == "r2"} == {(f, s) for f, s, _ in kept.slots}
    assert {r.band for r in out if r.kind == "log_lambda"} == {f for f, _, _ in kept.bands}

    each = run_encoding({f: elements for f in bands}, signal, targets, replace(config, shared_reg=False, n_iter=0))
    assert {r.band for r in each.where("kind = 'log_lambda'").collect()} == {f"{f}/{s}" for f, s, _ in kept.slots}
    whole = run_encoding({f: elements for f in bands}, signal, targets, replace(config, drop_empty=False, n_iter=0))
    assert {r.band for r in whole.where("kind = 'log_lambda'").collect()} == set(bands)
    with pytest.raises(Exception, match="too short"):
        run_encoding({f: elements for f in bands}, signal.where("t_idx < 2"), targets, config).count()


def test_what_gram_tasks_hand_on_follows_the_parts(spark):
    """Ten times the samples: the same sums by plain arrays, and no more tiles."""
    layout, handed = Layout((("a", 2, 1), ("b", 1, 2))), []
    for n in (60, 600):
        rng = np.random.default_rng(n)
        design = [("r", t, b, s, [float(v) for v in rng.normal(size=d)]) for t in range(n) for b, s, d in layout.slots if rng.random() < 0.8]
        values = {(t, c): float(rng.normal()) for t in range(n) for c in ("x", "y", "z") if rng.random() < 0.9}
        borders = [0, n // 3, n]
        args = (
            spark.createDataFrame(design, "recording string, t_idx int, band string, slot int, vec array<double>"),
            spark.createDataFrame([("r", t, c, v) for (t, c), v in values.items()], "recording string, t_idx int, target string, value double"),
            layout,
            borders,
            spark.createDataFrame([("z", 1), ("x", 0), ("y", 0)], "target string, chunk int"),
        )
        handed.append(partial_tiles(*args, rows=4, parts=6)[0].count())
        a, at = np.zeros((n, 8)), {b: i for i, b in enumerate([("a", 0), ("a", 1), ("b", 0)])}
        a[:, 7] = 1
        for _, t, b, s, v in design:
            a[t, {("a", 0): [0], ("a", 1): [1], ("b", 0): [2, 3]}[b, s]] = v
            a[t, 4 + at[b, s]] = 1
        y = np.array([[values.get((t, c), 0.0) for c in ("x", "y", "z")] for t in range(n)])
        held = np.array([any((t, c) in values for c in ("x", "y", "z")) for t in range(n)])
        for parts in (1, 6, 200):
            got = {(r.segment_id, r.ti, r.tj): np.array(r.g) for r in gram_tiles(*args, rows=4, parts=parts).collect()}
            assert len(got) == 2 * 5
            for k in (0, 1):
                own = np.arange(n)[held & (np.arange(n) >= borders[k]) & (np.arange(n) < borders[k + 1])]
                assert np.allclose(got[k, 0, 0], (a[own].T @ a[own]).ravel())
                assert np.allclose(got[k, 0, -1], (a[own].T @ y[own, :2]).ravel()) and np.allclose(got[k, 0, -3], a[own].T @ y[own, 2])
                assert np.allclose(got[k, 0, -2], (y[own, :2] ** 2).sum(0)) and np.allclose(got[k, 0, -4], (y[own, 2] ** 2).sum())
    assert max(handed) <= 6 * 5


def test_each_fold_is_decomposed_once_and_chunks_read_it(monkeypatch):
    """The store of one outer fold, by hand: three decompositions for three inner folds, none for the chunks, and the same fits as without it."""
    rng = np.random.default_rng(4)
    layout, chunks = Layout((("a", 2, 2), ("b", 1, 1))), {0: 2, 1: 1}
    size, rows = len(layout.columns) + len(layout.slots) + 1, []
    for part in (-1, 0, 1, 2):
        a, y = np.column_stack([rng.normal(size=(30, 5)), np.ones((30, 4))]), rng.normal(size=(30, 3))
        rows += [(part, 0, 0, (a.T @ a).ravel()), (part, 0, -1, (a.T @ y[:, :2]).ravel()), (part, 0, -2, (y[:, :2] ** 2).sum(0)), (part, 0, -3, (a.T @ y[:, 2:]).ravel()), (part, 0, -4, (y[:, 2:] ** 2).sum(0))]
    tiles = pd.DataFrame(rows, columns=["part", "ti", "tj", "g"])
    assert size == 9
    plain, calls = np.linalg.eigh, []
    monkeypatch.setattr(np.linalg, "eigh", lambda x: calls.append(1) or plain(x))
    names = [c.split()[0] for c in encode.FACTORS.split(", ")]
    monkeypatch.setattr(encode, "BLOCK", 2)
    store = pd.DataFrame([r for i in (-1, 0, 1, 2) for r in encode.factored(0, i, tiles, layout, chunks, 3, (0.1, 1.0))], columns=names)
    assert len(calls) == 3 and (store["name"] == "loss").sum() == 3 * 2 * 3
    fold = encode.Fold(store[(store["chunk"] == -1)], 3)
    for chunk, m in chunks.items():
        *folds, (whole, held) = fold.chunk(store[(store["chunk"] == chunk) & (store["name"] != "loss")])
        start = np.zeros((2, m))
        w, delta, losses = solve.banded_ridge(folds, layout.band_of, start, 3, 0.1, "adam", whole, False, fold.bases, fold.full_basis)
        assert w.shape == (5, m) and losses[-1] < losses[0] and held.n == 30
        assert len(calls) == 3
        again = solve.banded_ridge([encode._inner(encode.Sums(tiles, layout, chunks), 3, i) for i in range(3)], layout.band_of, np.zeros((2, 3)), 3, 0.1)[1]
        assert np.allclose(delta, again[:, 2 * chunk : 2 * chunk + m])
        calls[:] = calls[:3]


def test_warm_starts_take_fewer_steps(monkeypatch):
    """Beyond DIRECT columns each optimiser step starts from the last one's solutions: the same minimum in fewer conjugate-gradient steps."""
    x, y, band = problem(5, n=900, targets=2, sizes=(180, 150))
    folds = [(stats(x[:600], y[:600]), stats(x[600:], y[600:]))]
    start = np.array([[1.0, 2.0], [3.0, 1.5]])
    taken = {}
    for name in ("warm", "cold"):
        warm = [solve.Warm()]
        if name == "cold":
            plain = solve._cg
            monkeypatch.setattr(solve, "_cg", lambda *a, **k: plain(*a[:3], None, *a[4:], **k))
        taken[name] = (solve.banded_ridge(folds, band, start, 12, 0.05, warm=warm)[1], warm[0].steps)
    assert np.allclose(taken["warm"][0], taken["cold"][0], atol=1e-8) and taken["warm"][1] < 0.9 * taken["cold"][1]


def test_run_encoding_equals_dense_numpy(spark):
    rng = np.random.default_rng(5)
    n = 83
    rows = [(0, i, float(rng.uniform(0, n)), "a" if i % 2 else "b", [float(v) for v in rng.normal(size=2)]) for i in range(40)]
    elements = spark.createDataFrame(rows, "recording int, element_id long, t double, feature string, vec array<double>")
    signal = spark.createDataFrame([(0, t, k, float(rng.normal())) for t in range(n) for k in range(2)], "recording int, t_idx int, target int, value double")
    targets = spark.createDataFrame([(0, True), (1, True), (2, False)], "target int, keep boolean")
    b = Buffer(frequency=1, duration=n, dim=2, period=1.0, nb_buffer=2, prediction_end=3.0, buffer_duration=3.0)
    config = Config("m", {"a": ("sym_tap", b), "b": ("sym_buffer", b)}, alphas=(0.1, 1.0, 10.0), n_iter=3, lr=0.1, chunk_size=1, rows=16)
    out = run_encoding(elements, signal, targets, config).where("fold = 0").collect()
    z, y, ytest, test, layout = dense_model(spark, elements, signal, config)
    at = {c: i for i, c in enumerate(layout.columns)}
    for t in (0, 1):
        w, d = np.zeros(len(at)), np.zeros(2)
        for r in out:
            if r.target == t and r.kind == "weight":
                w[at[r.band, r.slot, r.dim]] = r.value
            if r.target == t and r.kind == "log_lambda":
                d[["a", "b"].index(r.band)] = r.value
        ridge = np.linalg.solve(z[~test].T @ z[~test] + np.diag(np.exp(d[layout.band_of])), z[~test].T @ y[~test, t])
        assert np.allclose(w, ridge, atol=1e-8)
        joint = 1 - ((ytest[:, t] - z[test] @ w) ** 2).sum() / (ytest[:, t] ** 2).sum()
        assert abs(joint - sum(r.value for r in out if r.kind == "r2" and r.target == t)) < 1e-8
    again = run_encoding(elements.repartition(7), signal.repartition(3), targets, Config(**{**config.__dict__, "rows": 50})).where("fold = 0 AND kind = 'r2'")
    first = {(r.target, r.band, r.slot): r.value for r in out if r.kind == "r2"}
    assert all(abs(first[r.target, r.band, r.slot] - r.value) < 1e-8 for r in again.collect())


def test_holdout_tuning_equals_dense_numpy(spark):
    """Both tuners over the factor store end where the gradient of dense arrays vanishes, or near it; losses are those of dense arrays."""
    rng = np.random.default_rng(11)
    n = 83
    rows = [(0, i, float(rng.uniform(0, n)), "a" if i % 2 else "b", [float(v) for v in rng.normal(size=2)]) for i in range(60)]
    elements = spark.createDataFrame(rows, "recording int, element_id long, t double, feature string, vec array<double>")
    signal = spark.createDataFrame([(0, t, k, float(rng.normal() + np.sin(t))) for t in range(n) for k in range(2)], "recording int, t_idx int, target int, value double")
    targets = spark.createDataFrame([(0, True), (1, True), (2, False)], "target int, keep boolean")
    b = Buffer(frequency=1, duration=n, dim=2, period=1.0, nb_buffer=2, prediction_end=3.0, buffer_duration=3.0)
    config = Config("m", {"a": ("sym_tap", b), "b": ("sym_buffer", b)}, n_iter=30, lr=0.1, chunk_size=1, rows=16)
    out = encode.holdout_tuning(elements, signal, targets, config).collect()
    z, y, _, test, layout = dense_model(spark, elements, signal, config)
    z, y = z[~test], y[~test]
    cuts = fold_cuts(len(z), config.inner)
    assert {(r.optimizer, r.fold, r.inner) for r in out} == {(o, f, i) for o in ("adam", "lbfgs") for f in range(4) for i in range(5)}
    for i in range(config.inner):
        val = np.zeros(len(z), bool)
        val[cuts[i] : cuts[i + 1]] = True
        mean, sd = y[~val].mean(0), y[~val].std(0, ddof=1)
        own = (y - mean) / sd
        sides = [solve.Stats(z[k].T @ z[k], z[k].T @ own[k], (own[k] ** 2).sum(0), float(k.sum())) for k in (~val, val)]
        for o in ("adam", "lbfgs"):
            mine = [r for r in out if (r.optimizer, r.fold, r.inner) == (o, 0, i)]
            losses = [r.value for r in sorted((r for r in mine if r.kind == "loss"), key=lambda r: r.iter)]
            delta = np.array([r.value for k in ("a", "b") for r in mine if r.kind == "log_lambda" and r.band == k])
            w = np.linalg.solve(sides[0].xtx + np.eye(len(z.T)), sides[0].xty)
            assert abs(losses[0] - ((own[val] - z[val] @ w) ** 2).sum() / (2 * val.sum())) < 1e-8
            w = np.linalg.solve(sides[0].xtx + np.diag(np.exp(delta)[layout.band_of]), sides[0].xty)
            assert ((own[val] - z[val] @ w) ** 2).sum() / (2 * val.sum()) <= min(losses) + 1e-6 or o == "adam"
            assert losses[-1] < losses[0]
    assert encode.holdout_tuning(elements, signal, targets.where("NOT keep"), config).count() == 0


def test_string_keys_latencies_decimation_and_a_band_per_slot(spark, tmp_path):
    """Two recordings and two latency ids under names, every second sample, each slot with a penalty of its own: the written table equals dense numpy."""
    rng = np.random.default_rng(6)
    n, names = 84, [(k, t) for k in (2, 10) for t in ("x", "y")]
    rows = [(f"sub-{i % 2}", i, float(rng.uniform(0, n)), "a", [float(rng.normal())]) for i in range(60)]
    elements = spark.createDataFrame(rows, "recording string, element_id long, t double, feature string, vec array<double>")
    raw = {(r, k, c, t): float(rng.normal()) for r in ("sub-0", "sub-1") for k, c in names for t in range(n)}
    signal = spark.createDataFrame([(r, k, c, t, v) for (r, k, c, t), v in raw.items()], "recording string, time_id int, target string, t_idx int, value double")
    targets = spark.createDataFrame([(*x, True) for x in names] + [(2, "z", False)], "time_id int, target string, keep boolean")
    b = Buffer(frequency=1, duration=n, dim=1, period=1.0, nb_buffer=2)
    config = Config("slots", {"a": ("sym_tap", b)}, alphas=(0.1, 10.0), n_iter=2, lr=0.1, chunk_size=3, rows=16, shared_reg=False, decimate=2)
    path = str(tmp_path / "results")
    out = run_encoding(elements, signal, targets, config, path).collect()
    assert {(r.fold, r.chunk) for r in out} == {(o, c) for o in range(4) for c in range(2)} and {r.model for r in out} == {"slots"}
    assert {(r.time_id, r.target) for r in out if r.kind == "weight"} == set(names)
    layout = config.layout()
    assert [x[0] for x in layout.columns] == ["a/0", "a/1", "a/2", "a/3"]
    at = {c[0]: i for i, c in enumerate(layout.columns)}
    x = {r: np.full((n // 2, 4), np.nan) for r in ("sub-0", "sub-1")}
    for r in expand(elements, config.bands, False).where("t_idx % 2 = 0").collect():
        x[r.recording][r.t_idx // 2, at[r.band]] = r.vec[0]
    test = np.arange(n // 2) < fold_cuts(n // 2, 4)[1]
    both = np.concatenate([x["sub-0"][~test], x["sub-1"][~test]])
    mean, sd = np.nanmean(both, 0), np.nanstd(both, 0)
    z = {r: np.nan_to_num((v - mean) / sd) for r, v in x.items()}
    for k, c in names:
        y = {r: np.array([raw[r, k, c, t] for t in range(0, n, 2)]) for r in x}
        train, held = np.concatenate([y[r][~test] for r in x]), np.concatenate([y[r][test] for r in x])
        own = {r.band: r.value for r in out if (r.fold, r.kind, r.time_id, r.target) == (0, "weight", k, c)}
        lam = {r.band: np.exp(r.value) for r in out if (r.fold, r.kind, r.time_id, r.target) == (0, "log_lambda", k, c)}
        a = np.concatenate([z[r][~test] for r in x])
        dense = np.linalg.solve(a.T @ a + np.diag([lam[f"a/{i}"] for i in range(4)]), a.T @ ((train - train.mean()) / train.std()))
        assert np.allclose([own[f"a/{i}"] for i in range(4)], dense, atol=1e-8)
        yt = (held - held.mean()) / train.std()
        joint = 1 - ((yt - np.concatenate([z[r][test] for r in x]) @ dense) ** 2).sum() / (yt**2).sum()
        assert abs(joint - sum(r.value for r in out if (r.fold, r.kind, r.time_id, r.target) == (0, "r2", k, c))) < 1e-8
    again = run_encoding(elements.limit(0), signal, targets, config, path)  # all is there: nothing is fitted, nothing changes
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out))


def test_dense_prediction_beside_the_signal(spark):
    rng = np.random.default_rng(7)
    layout = Layout((("a", 2, 1), ("b", 1, 2)))
    design = [("r", t, b, s, [float(v) for v in rng.normal(size=d)]) for t in range(50) for b, s, d in layout.slots if rng.random() < 0.8]
    weights = [(c, b, s, d, float(rng.normal())) for c in ("x", "y") for b, s, d in layout.columns]
    signal = [("r", t, c, float(t)) for t in range(50) for c in ("x", "y", "z")]
    tables = (
        spark.createDataFrame(design, "recording string, t_idx int, band string, slot int, vec array<double>"),
        spark.createDataFrame(signal, "recording string, t_idx int, target string, value double"),
        spark.createDataFrame(weights, "target string, band string, slot int, dim int, value double"),
        layout,
    )
    w = {x[:4]: x[4] for x in weights}
    want = {(t, c): sum(v * w[c, b, s, k] for _, u, b, s, vec in design if u == t for k, v in enumerate(vec)) for t in range(50) for c in ("x", "y")}
    for most in (1 << 20, 5, 1):  # one matrix, and one for each target
        got = predict_dense(*tables, rows=16, most=most).collect()
        assert len(got) == 100 and all(r.value == r.t_idx and abs(r.yhat - want[r.t_idx, r.target]) < 1e-9 for r in got)
    assert predict_dense(tables[0], tables[1], tables[2].limit(0), layout).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        predict_dense(*tables[:2], tables[2].withColumn("slot", F.col("slot") + 1), layout)


def test_envelope_keeps_the_recording_s_type(spark):
    raw = spark.createDataFrame([("sub-01", "a", i, float(i % 7)) for i in range(300)], "recording string, channel string, t_idx long, value double")
    rows = high_gamma(raw, 1000, 20, block_s=1).collect()
    assert {r.recording for r in rows} == {"sub-01"} and len(rows) == 6


def test_model_suite():
    b = Buffer(frequency=1, duration=9, dim=1)
    suite = model_suite({"word": b, "tree": b, "phone": b}, ("tree",), ("phone",))
    assert {k: {f: n for f, (n, _) in c.bands.items()} for k, c in suite.items()} == {
        "taps": {"word": "sym_tap", "tree": "sym_tap", "phone": "sym_tap"},
        "taps_without_trees": {"word": "sym_tap", "phone": "sym_tap"},
        "buffer": {"word": "sym_buffer", "tree": "sym_buffer", "phone": "sym_buffer"},
        "mixed": {"phone": "sym_tap", "word": "sym_buffer", "tree": "sym_buffer"},
    }
