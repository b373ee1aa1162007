"""High-frequency envelope of raw signals, by channel and block of time."""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelope(x: np.ndarray, fs: float, notch: float = 60.0, band: tuple[float, float] = (70.0, 200.0), width: float = 2.0) -> np.ndarray:
    """Magnitude of the analytic signal within ``band``, without ``notch`` and its multiples by ``width`` to either side."""
    f = np.fft.fftfreq(len(x), 1 / fs)
    keep = (f >= band[0]) & (f <= band[1])
    if notch > 0:
        keep &= np.abs(f - notch * np.round(f / notch)) > width
    return np.abs(np.fft.ifft(np.where(keep, 2 * np.fft.fft(x), 0)))


def bin_means(y: np.ndarray, first: float, step: float, n: int) -> np.ndarray:
    """Means of ``y``, constant within a sample, over ``n`` bins of ``step`` samples from place ``first``: a sample that a border cuts counts on both sides by its share. The last bin may be shorter."""
    edges = np.minimum(first + step * np.arange(n + 1), len(y))
    area = np.interp(edges, np.arange(len(y) + 1), np.concatenate([[0.0], np.cumsum(y)]))
    return np.diff(area) / np.diff(edges)


def high_gamma(signal: DataFrame, fs_in: float, fs_out: float = 20, notch: float = 60.0, band: tuple[float, float] = (70.0, 200.0), block_s: int = 60, overlap_s: int = 1) -> DataFrame:
    """(recording, channel, t_idx, value) at ``fs_in`` to the mean envelope at ``fs_out``, whatever their ratio. Blocks of about ``block_s`` seconds, whole samples of the result, carry ``overlap_s``
    from their neighbours, so no task holds a whole recording; samples that are missing count as 0."""
    ratio = Fraction(str(fs_in)) / Fraction(str(fs_out))
    if ratio <= 0:
        raise ValueError("rates are positive")
    bins, edge = max(1, round(block_s * fs_out)), ceil(overlap_s * fs_in)
    size = bins * ratio  # samples to a block; what a border cuts belongs to both blocks
    up, down = size.numerator, size.denominator
    first, last = F.expr(f"(t_idx - {edge}L) * {down}L DIV {up}L"), F.expr(f"((t_idx + {edge + 1}L) * {down}L - 1L) DIV {up}L")
    blocks = signal.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        begin = int(key[2]) * size
        lo, hi = floor(begin), ceil(begin + size)
        own = rows.loc[(rows["t_idx"] >= lo) & (rows["t_idx"] < hi), "t_idx"]
        if not len(own):
            return rows.iloc[:0][["recording", "channel", "t_idx", "value"]]
        start, end, stop = max(0, lo - edge), int(rows["t_idx"].max()) + 1, int(own.max()) + 1
        x = np.zeros(end - start)
        x[rows["t_idx"].to_numpy() - start] = rows["value"].to_numpy()
        y = envelope(x, fs_in, notch, band)[lo - start : stop - start]
        n = min(bins, ceil((stop - begin) / ratio))
        return pd.DataFrame({"recording": [key[0]] * n, "channel": [rows["channel"].iloc[0]] * n, "t_idx": int(key[2]) * bins + np.arange(n), "value": bin_means(y, float(begin - lo), float(ratio), n)})

    kind = signal.schema["recording"].dataType.simpleString()
    return blocks.groupBy("recording", "channel", "block").applyInPandas(each, f"recording {kind}, channel string, t_idx long, value double")
