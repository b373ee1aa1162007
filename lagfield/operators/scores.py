"""Scores of fitted models: explained variance by band and slot, summaries and comparisons."""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predict_long(columns: DataFrame, weights: DataFrame) -> DataFrame:
    """Predictions (recording, t_idx, target, band, slot, yhat) from ``columns`` (recording, t_idx, band, slot, dim, x) and ``weights`` (target, band, slot, dim, w)."""
    return columns.join(weights, ["band", "slot", "dim"]).groupBy("recording", "t_idx", "target", "band", "slot").agg(F.sum(F.col("x") * F.col("w")).alias("yhat"))


def r2_split(predictions: DataFrame, signal: DataFrame, keys: list[str], include_correlation: bool = True) -> DataFrame:
    """Share of each part, ``keys`` beside target: (2 sum yhat_k y - sum yhat_k yhat) / sum y^2, which add up to the joint value.

    Without the correlation the second sum is of yhat_k^2. ``predictions``: (recording, t_idx, target, keys, yhat).
    """
    each = predictions.groupBy("recording", "t_idx", "target", *keys).agg(F.sum("yhat").alias("yhat"))
    total = F.sum("yhat").over(Window.partitionBy("recording", "t_idx", "target")) if include_correlation else F.col("yhat")
    joined = each.withColumn("total", total).join(signal, ["recording", "t_idx", "target"])
    sums = joined.groupBy("target", *keys).agg(F.sum(2 * F.col("yhat") * F.col("value") - F.col("yhat") * F.col("total")).alias("part"))
    sst = signal.groupBy("target").agg(F.sum(F.col("value") * F.col("value")).alias("sst"))
    return sums.join(sst, "target").select("target", *keys, (F.col("part") / F.col("sst")).alias("r2"))


def fold_summary(r2_slot: DataFrame) -> DataFrame:
    """Sum over slots, then mean over folds, by band and target."""
    return r2_slot.groupBy("band", "target", "fold").agg(F.sum("r2").alias("r2")).groupBy("band", "target").agg(F.avg("r2").alias("r2"))


def total_and_ratio(summary: DataFrame, clip: bool = True) -> DataFrame:
    """Adds a target's total over bands and each band's share of it; negative values count as 0 under ``clip``. A total of zero has no shares."""
    r2 = F.greatest("r2", F.lit(0.0)) if clip else F.col("r2")
    total = F.sum("clipped").over(Window.partitionBy("target"))
    return summary.withColumn("clipped", r2).withColumn("total", total).select("band", "target", "r2", "total", F.when(F.col("total") != 0, F.col("clipped") / F.col("total")).alias("ratio"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(target, difference) of the scores (target, r2) of two models; NaN counts as null."""
    both = a.select("target", F.col("r2").alias("a")).join(b.select("target", F.col("r2").alias("b")), "target")
    return both.select("target", F.nanvl(F.col("a") - F.col("b"), F.lit(None).cast("double")).alias("difference"))


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    return differences(a, b).agg(F.avg("difference").alias("mean"), F.max("difference").alias("max"), F.min("difference").alias("min"))


def paired_t(a: DataFrame, b: DataFrame) -> DataFrame:
    """Count, mean and t of the paired differences; t is null for fewer than two pairs or no spread."""
    return _t_of(differences(a, b), [])


def _t_of(pairs: DataFrame, keys: list[str]) -> DataFrame:
    d = pairs.groupBy(*keys).agg(F.count("difference").alias("n"), F.avg("difference").alias("mean"), F.stddev_samp("difference").alias("sd"))
    return d.select(*keys, "n", "mean", F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def _continued(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def t_tail(t: float, df: float, alternative: str) -> float:
    """P(T <= t) for "less", P(T >= t) for "greater"."""
    if alternative not in ("less", "greater"):
        raise ValueError(f"unknown alternative {alternative!r}")
    upper = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    upper = upper if t > 0 else 1 - upper
    return upper if alternative == "greater" else 1 - upper


def t_tails(t: Column, df: Column, alternative: str) -> Column:
    """:func:`t_tail` of a column of t; null where t is. Its rows are tests, not samples."""
    t_tail(0.0, 1.0, alternative)  # refuses an unknown alternative before any task

    def tails(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) else t_tail(t, d, alternative) for t, d in zip(ts, dfs, strict=True)], dtype="float64")

    tails.__annotations__ = {"ts": pd.Series, "dfs": pd.Series, "return": pd.Series}
    return F.pandas_udf(tails, "double")(t, df)


def _with_p(tests: DataFrame, alternative: str, alpha: float) -> DataFrame:
    return tests.withColumn("p", t_tails(F.col("t"), (F.col("n") - 1).cast("double"), alternative)).withColumn("star", F.col("p") < alpha)


def paired_ttest(a: DataFrame, b: DataFrame, alternative: str = "less", alpha: float = 0.001) -> DataFrame:
    """As paired_t, with p and whether it is below ``alpha``."""
    return _with_p(paired_t(a, b), alternative, alpha)


def paired_ttests(scores: DataFrame, pairs: list[tuple[str, str]], alternative: str = "less", alpha: float = 0.001) -> DataFrame:
    """(model, other, n, mean, t, p, star) of all ``pairs`` of models in one plan over ``scores`` (model, target, r2): a row to each pair, n 0 and nulls where no target has both.

    Scores meet by target, so that what is shuffled is the scores once, and each target's list of models is as long as there are models. NaN counts as null; a repeated pair gives one row.
    """
    wanted = list(dict.fromkeys(pairs))
    names = list(dict.fromkeys(m for pair in wanted for m in pair))
    side = scores.where(F.col("model").isin(names)).groupBy("target").pivot("model", names).agg(F.max(F.nanvl("r2", F.lit(None).cast("double"))))
    at = {m: f"m{i}" for i, m in enumerate(names)}
    side = side.toDF("target", *at.values())
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("model"), F.lit(b).alias("other"), (F.col(at[a]) - F.col(at[b])).alias("difference")) for a, b in wanted)))
    tests = _t_of(side.select(each.alias("x")).select("x.*"), ["model", "other"])
    asked = scores.sparkSession.createDataFrame(wanted, "model string, other string")
    return _with_p(asked.join(tests, ["model", "other"], "left").withColumn("n", F.coalesce("n", F.lit(0))), alternative, alpha)


def model_bars(scores: DataFrame) -> DataFrame:
    """Mean and standard error (population deviation over the root of the count) of (model, r2)."""
    return scores.groupBy("model").agg(F.avg("r2").alias("mean"), (F.stddev_pop("r2") / F.sqrt(F.count("r2"))).alias("error"))


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min("r2").alias("min"), F.max("r2").alias("max"), F.avg("r2").alias("mean"))


def best_target(scores: DataFrame) -> DataFrame:
    """The target of the largest score, the smallest of equals."""
    return scores.orderBy(F.desc("r2"), "target").limit(1)


def unexplained_share(r2_band: DataFrame) -> DataFrame:
    return r2_band.groupBy("target").agg((1 - F.sum("r2")).alias("unexplained"))


def best_alpha(losses: DataFrame, keys: list[str]) -> DataFrame:
    """The alpha of the least loss, the smallest of equals, by ``keys``."""
    return losses.groupBy(*keys).agg(F.min_by("alpha", F.struct("loss", "alpha")).alias("alpha"), F.min("loss").alias("loss"))


