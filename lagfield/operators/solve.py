"""Ridge with one penalty per band and target, on Gram matrices. Small dense helpers for grouped-map tasks.

Penalties are log_lambda of shape (bands, targets); (bands,) means shared by all targets. The objective is
half |Xw - y|^2 plus half the sum over bands of exp(log_lambda) |w_band|^2.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Stats:
    """Sums over a set of rows of standardised columns: xtx (P, P), xty (P, M), yty (M,), n rows; ``s`` scales the loss, by target."""

    xtx: np.ndarray
    xty: np.ndarray
    yty: np.ndarray
    n: float
    s: np.ndarray | float = 1.0


def spread(log_lambda: np.ndarray, band_of: np.ndarray, targets: int) -> np.ndarray:
    """Penalties by column and target."""
    d = np.asarray(log_lambda, float)
    d = np.repeat(d[:, None], targets, 1) if d.ndim == 1 else d
    return np.exp(d[band_of])


@dataclass
class Warm:
    """What one solve leaves for the next one of nearly the same system: its solutions by role, and how many steps all of them took."""

    solutions: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0


def _cg(xtx: np.ndarray, penalty: np.ndarray, rhs: np.ndarray, start: np.ndarray | None, basis: tuple[np.ndarray, np.ndarray], warm: Warm | None = None, tol: float = 1e-12, most: int = 2000) -> np.ndarray:
    """Conjugate gradients for all targets at once, preconditioned in the eigenbasis of xtx under each target's mean penalty."""
    values, vectors = basis
    shift = np.maximum(values, 0)[:, None] + penalty.mean(0)[None, :]
    before = lambda r: vectors @ ((vectors.T @ r) / shift)
    w = np.zeros_like(rhs) if start is None else start.copy()
    r = rhs - xtx @ w - penalty * w
    z = before(r)
    p, rz = z.copy(), (r * z).sum(0)
    size = np.maximum((rhs * rhs).sum(0), 1e-300)
    for _ in range(most):
        live = (r * r).sum(0) > tol * tol * size
        if not live.any():
            break
        if warm is not None:
            warm.steps += 1
        hp = xtx @ p + penalty * p
        step = np.where(live, rz / np.maximum((p * hp).sum(0), 1e-300), 0)
        w += step * p
        r -= step * hp
        z = before(r)
        fresh = (r * z).sum(0)
        p = z + np.where(live, fresh / np.maximum(rz, 1e-300), 0) * p
        rz = fresh
    return w


#: Columns up to which each target's system is factorised.
DIRECT = 300


def solve_ridge(
    stats: Stats, log_lambda: np.ndarray, band_of: np.ndarray, warm: Warm | None = None, basis: tuple[np.ndarray, np.ndarray] | None = None, direct: int = DIRECT, role: str = "weights"
) -> np.ndarray:
    """Weights (P, M). Shared penalties take one factorisation; penalties by target one each up to ``direct`` columns, and beyond conjugate gradients, which start from what ``warm`` holds for the ``role``."""
    m = stats.xty.shape[1]
    penalty = spread(log_lambda, band_of, m)
    if (penalty == penalty[:, :1]).all():
        return np.linalg.solve(stats.xtx + np.diag(penalty[:, 0]), stats.xty)
    if len(band_of) <= direct:
        return np.column_stack([np.linalg.solve(stats.xtx + np.diag(penalty[:, t]), stats.xty[:, t]) for t in range(m)])
    w = _cg(stats.xtx, penalty, stats.xty, warm.solutions.get(role) if warm else None, basis or np.linalg.eigh(stats.xtx), warm)
    if warm is not None:
        warm.solutions[role] = w
    return w


def adjoint(stats: Stats, log_lambda: np.ndarray, band_of: np.ndarray, rhs: np.ndarray, basis: tuple[np.ndarray, np.ndarray] | None = None, warm: Warm | None = None) -> np.ndarray:
    return solve_ridge(Stats(stats.xtx, rhs, stats.yty, stats.n), log_lambda, band_of, warm, basis, role="adjoint")


def holdout_loss(val: Stats, w: np.ndarray) -> float:
    """Half the mean squared validation residual over s^2, summed over targets."""
    sse = val.yty - 2 * (w * val.xty).sum(0) + (w * (val.xtx @ w)).sum(0)
    return float((sse / np.square(val.s)).sum() / (2 * val.n))


def holdout_gradient(train: Stats, val: Stats, log_lambda: np.ndarray, band_of: np.ndarray, w: np.ndarray | None = None, basis: tuple[np.ndarray, np.ndarray] | None = None, warm: Warm | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, its gradient in the log penalties (their shape), and the weights; ``w`` given is taken as the solution."""
    w = solve_ridge(train, log_lambda, band_of, warm, basis) if w is None else w
    slope = (val.xtx @ w - val.xty) / np.square(val.s) / val.n
    mu = adjoint(train, log_lambda, band_of, slope, basis, warm)
    k = int(band_of.max()) + 1
    grad = np.zeros((k, w.shape[1]))
    np.add.at(grad, band_of, w * mu)
    d = np.asarray(log_lambda, float)
    grad *= -np.exp(d[:, None] if d.ndim == 1 else d)
    return holdout_loss(val, w), grad.sum(1) if d.ndim == 1 else grad, w


def ridge_cv_init(folds: list[tuple[Stats, Stats]], bands: int, alphas: np.ndarray, scope: str = "chunk", bases: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log penalties (bands, M) of the best uniform alpha, and the losses (alphas, M); the first of equals. One eigendecomposition of each fold serves all alphas.

    ``scope`` "chunk" picks one alpha for all targets, "target" one each.
    """
    total = sum(v.n for _, v in folds)
    m = folds[0][0].xty.shape[1]
    losses = np.zeros((len(alphas), m))
    for (train, val), (values, vectors) in zip(folds, bases or [np.linalg.eigh(t.xtx) for t, _ in folds], strict=True):
        rhs, vty, vtv = vectors.T @ train.xty, vectors.T @ val.xty, vectors.T @ val.xtx @ vectors
        for i, a in enumerate(alphas):
            w = rhs / (np.maximum(values, 0) + a)[:, None]
            sse = val.yty - 2 * (w * vty).sum(0) + (w * (vtv @ w)).sum(0)
            losses[i] += sse / np.square(val.s) / (2 * total)
    best = np.full(m, losses.sum(1).argmin()) if scope == "chunk" else losses.argmin(0)
    return np.repeat(np.log(np.asarray(alphas, float)[best])[None, :], bands, 0), losses


def _log_softmax(phi: np.ndarray) -> np.ndarray:
    top = phi - phi.max(0)
    return top - np.log(np.exp(top).sum(0))


class Adam:
    """Adam steps on one array."""

    def __init__(self, lr: float):
        self.lr, self.m, self.v, self.t = lr, 0.0, 0.0, 0

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return x - self.lr * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _lbfgs_direction(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, used = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        used.append((a, s, y))
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for a, s, y in reversed(used):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def banded_ridge(
    folds: list[tuple[Stats, Stats]],
    band_of: np.ndarray,
    start: np.ndarray,
    n_iter: int = 100,
    lr: float = 0.1,
    optimizer: str = "adam",
    full: Stats | None = None,
    freeze_forward: bool = False,
    bases: list[tuple[np.ndarray, np.ndarray]] | None = None,
    full_basis: tuple[np.ndarray, np.ndarray] | None = None,
    warm: list[Warm] | None = None,
) -> tuple[np.ndarray | None, np.ndarray, list[float]]:
    """Tune log penalties by the mean inner hold-out loss; returns weights of a last fit on ``full``, the penalties and a loss for each step.

    Adam works on (phi, log_alpha) with log_lambda = log_alpha - log_softmax(phi), started so that it reproduces ``start``; L-BFGS with
    a history of ten takes fixed steps on the log penalties. ``freeze_forward`` keeps the first solutions while penalties move. ``bases`` are the
    eigendecompositions of the folds' training Grams, which are made here if not given; each step starts from the solutions of the one before.
    """
    if optimizer not in ("adam", "lbfgs"):
        raise ValueError(f"unknown optimizer {optimizer!r}")
    m = folds[0][0].xty.shape[1]
    delta = np.array(start, float)
    delta = np.repeat(delta[:, None], m, 1) if delta.ndim == 1 else delta
    total = sum(v.n for _, v in folds)
    bases = bases or [np.linalg.eigh(t.xtx) for t, _ in folds]
    warm = warm or [Warm() for _ in folds]
    frozen: list[np.ndarray | None] = [None] * len(folds)

    def evaluate(d: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = 0.0, np.zeros_like(d)
        for i, (train, val) in enumerate(folds):
            one, g, w = holdout_gradient(train, val, d, band_of, frozen[i], bases[i], warm[i])
            if freeze_forward:
                frozen[i] = w
            loss += one * val.n / total
            grad += g * val.n / total
        return loss, grad

    losses: list[float] = []
    if optimizer == "adam":
        phi = -delta + delta.mean(0)
        log_alpha = delta.mean(0) - np.log(np.exp(phi - phi.max(0)).sum(0)) - phi.max(0)
        a, b = Adam(lr), Adam(lr)
        for _ in range(n_iter):
            delta = log_alpha - _log_softmax(phi)
            loss, g = evaluate(delta)
            losses.append(loss)
            soft = np.exp(_log_softmax(phi))
            phi, log_alpha = a.step(phi, soft * g.sum(0) - g), b.step(log_alpha, g.sum(0))
        delta = log_alpha - _log_softmax(phi)
    else:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        last: tuple[np.ndarray, np.ndarray] | None = None
        for _ in range(n_iter):
            loss, g = evaluate(delta)
            losses.append(loss)
            if last is not None:
                s, y = (delta - last[0]).ravel(), (g - last[1]).ravel()
                if s @ y > 1e-12 * (y @ y):
                    pairs = [*pairs, (s, y)][-10:]
            last = delta.copy(), g
            delta = delta + lr * _lbfgs_direction(g.ravel(), pairs).reshape(delta.shape)
    return None if full is None else solve_ridge(full, delta, band_of, None, full_basis), delta, losses


#: A step is taken if the loss falls by DECREASE of what the slope promises and the slope has fallen to CURVATURE of what it was.
DECREASE, CURVATURE = 1e-4, 0.9


def strong_wolfe(
    loss_at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, loss: float, g: np.ndarray, way: np.ndarray, most: int = 30
) -> tuple[np.ndarray, float, np.ndarray, bool]:
    """Point, loss and gradient along ``way``, a direction of descent, and whether both strong Wolfe conditions hold there.

    Steps double until an interval must hold such a point, which is then narrowed by the cubic through both ends, or halved where the cubic leaves its middle. After ``most``
    evaluations the lowest point found is taken, ``x`` itself if none is lower. Points whose loss or gradient is not finite are never taken.
    """
    slope = float(g @ way)
    best = (0.0, loss, slope, g)

    def at(step: float) -> tuple[float, float, float, np.ndarray]:
        nonlocal best
        with np.errstate(over="ignore", invalid="ignore"):
            f, grad = loss_at(x + step * way)
        if not np.isfinite(grad).all():
            f = np.inf  # beyond what penalties can be: never taken
        here = (step, f, float(grad @ way), grad)
        best = here if f < best[1] else best
        return here

    falls = lambda p: p[1] <= loss + DECREASE * p[0] * slope
    flat = lambda p: abs(p[2]) <= -CURVATURE * slope
    low, high, step = (0.0, loss, slope, g), None, 1.0
    for _ in range(most):
        p = at(step)
        if falls(p) and p[1] <= low[1] and flat(p):
            return x + step * way, p[1], p[3], True
        if not falls(p) or p[1] > low[1] or not np.isfinite(p[1]):
            high = p
        else:
            if p[2] * ((high[0] if high else np.inf) - low[0]) >= 0:
                high = low
            low = p
        if high is None:
            step *= 2
            continue
        width = high[0] - low[0]
        bend = low[2] + high[2] - 3 * (high[1] - low[1]) / width if np.isfinite(high[1]) else np.nan
        root = bend * bend - low[2] * high[2]
        step = low[0] + width / 2
        if np.isfinite(root) and root >= 0:
            turn = np.sign(width) * np.sqrt(root)
            below = high[2] - low[2] + 2 * turn
            cubic = high[0] - width * (high[2] + turn - bend) / below if below else np.nan
            if 0.1 <= (cubic - low[0]) / width <= 0.9:
                step = cubic
        if abs(width) < 1e-14:
            break
    return x + best[0] * way, best[1], best[3], False


def tune(train: Stats, val: Stats, band_of: np.ndarray, bands: int, n_iter: int = 100, lr: float = 0.1, optimizer: str = "adam", accepted: list | None = None) -> tuple[np.ndarray, list[float]]:
    """Shared log penalties for one split, started at 0: Adam on them directly, or L-BFGS whose steps meet the strong Wolfe conditions.

    A loss for each step taken; L-BFGS ends before ``n_iter`` where no step lowers the loss. ``accepted`` collects (x, way, loss, slope, new x, new loss, new slope, whether both conditions hold) of its steps.
    """
    delta, losses, opt = np.zeros(bands), [], Adam(lr)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    if optimizer not in ("adam", "lbfgs"):
        raise ValueError(f"unknown optimizer {optimizer!r}")
    at = lambda d: holdout_gradient(train, val, d, band_of)[:2]
    loss, g = at(delta)
    for _ in range(n_iter):
        losses.append(loss)
        if optimizer == "adam":
            delta = opt.step(delta, g)
            loss, g = at(delta)
            continue
        way = _lbfgs_direction(g, pairs)
        if g @ way >= 0:
            pairs, way = [], -g
        there, new, g2, both = strong_wolfe(at, delta, loss, g, way)
        if new >= loss:
            break
        if accepted is not None:
            accepted.append((delta, way, loss, float(g @ way), there, new, float(g2 @ way), both))
        s, y = there - delta, g2 - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-10:]
        delta, loss, g = there, new, g2
    return delta, losses


def r2_parts(test: Stats, w: np.ndarray, group_of: np.ndarray) -> np.ndarray:
    """Share of the test variance by group of columns and target, with correlation: they add up to the joint value. No predictions are needed."""
    part = 2 * w * test.xty - w * (test.xtx @ w)
    out = np.zeros((int(group_of.max()) + 1, w.shape[1]))
    np.add.at(out, group_of, part)
    return out / np.where(test.yty > 0, test.yty, np.nan)
