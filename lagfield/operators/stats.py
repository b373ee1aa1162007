"""Column and target statistics, standardisation, and long Gram tables, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_design(design: DataFrame, band: bool = True) -> DataFrame:
    """(recording, t_idx, band, slot, dim, x) of a design."""
    keys = ["recording", "t_idx", *(["band"] if band else []), "slot"]
    return design.select(*keys, F.posexplode("vec").alias("dim", "x"))


def column_stats(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population standard deviation and count of ``x`` by ``keys``; null and NaN do not count."""
    x = F.nanvl("x", F.lit(None).cast("double"))
    return columns.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"))


def standardize(columns: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``x`` less its mean over its deviation; a column without variance or without rows to learn from is 0, and so are null and NaN."""
    x = F.nanvl("x", F.lit(None).cast("double"))
    z = F.when(F.col("std") > 0, (x - F.col("mean")) / F.col("std"))
    return columns.join(stats.select(*keys, "mean", "std"), keys, "left").withColumn("z", F.coalesce(z, F.lit(0.0))).drop("mean", "std")


def target_scale(signal: DataFrame, train: str, test: str) -> DataFrame:
    """``value`` by target less the mean of its own set (train or test, as these predicates say) over the train deviation; a deviation of zero counts as 1."""
    stats = signal.groupBy("target").agg(*(f(F.when(F.expr(p), F.col("value"))).alias(n) for f, p, n in ((F.avg, train, "train_mean"), (F.stddev_pop, train, "std"), (F.avg, test, "test_mean"))))
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    mean = F.when(F.expr(test), F.col("test_mean")).when(F.expr(train), F.col("train_mean"))
    return signal.join(stats, "target").withColumn("scaled", (F.col("value") - mean) / scale).drop("train_mean", "std", "test_mean")


def inner_target_scale(signal: DataFrame, train: str) -> DataFrame:
    """``value`` by target less the train mean over the train sample deviation, 1e-8 at least."""
    stats = signal.where(train).groupBy("target").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return signal.join(stats, "target").withColumn("scaled", (F.col("value") - F.col("mean")) / F.greatest(F.coalesce("std", F.lit(0.0)), F.lit(1e-8))).drop("mean", "std")


def gram_long(columns: DataFrame, signal: DataFrame) -> DataFrame:
    """For a few columns: sums of x, x*x and x*y by column and target over the samples both have. ``columns``: (recording, t_idx, col, x)."""
    joined = columns.join(signal, ["recording", "t_idx"])
    x, y = F.col("x"), F.col("value")
    return joined.groupBy("col", "target").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
