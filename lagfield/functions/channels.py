"""Channel tables, targets and referencing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify_channels(channels: DataFrame) -> DataFrame:
    """Adds kind (misc, ecg, seeg) and bad by name and status; drops the pulse channel."""
    name = F.col("name")
    kind = F.when(name.startswith("DC") | (name == "Pulse Rate"), "misc").when(name.contains("EKG"), "ecg").otherwise("seeg")
    return channels.withColumns({"kind": kind, "bad": F.coalesce(F.col("status") == "bad", F.lit(False))}).where(name != "Pulse Rate")


def pick_channels(channels: DataFrame, kinds: tuple[str, ...] = ("seeg",), drop_bads: bool = True) -> DataFrame:
    picked = channels.where(F.col("kind").isin(*kinds))
    return picked.where("NOT bad") if drop_bads else picked


def attach_coords(channels: DataFrame, electrodes: DataFrame) -> DataFrame:
    """Channels in their order with x, y, z, null where an electrode is missing. Both are dimension tables; the engine picks the join by their size."""
    return channels.join(electrodes.select("name", "x", "y", "z"), "name", "left")


def assign_chunk(targets: DataFrame, chunk_size: int = -1) -> DataFrame:
    """Adds chunk to the kept targets: their rank in target order over the chunk size; -1 puts all in one."""
    kept = targets.where("keep")
    if chunk_size == -1:
        return kept.withColumn("chunk", F.lit(0))
    rank = F.row_number().over(Window.orderBy("target")) - 1
    return kept.withColumn("chunk", F.floor(rank / chunk_size).cast("int"))


def keep_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    return df.join(targets.where("keep").select("target"), "target", "left_semi")


def joint_targets(signal: DataFrame) -> DataFrame:
    """Signals (recording, channel, t_idx, value) of several recordings under one stimulus as one: each channel of each recording is a target of its own, ``recording/channel``."""
    return signal.select(F.lit("all").alias("recording"), "t_idx", F.concat_ws("/", F.col("recording").cast("string"), "channel").alias("target"), "value")


def bipolar(signal: DataFrame, channels: DataFrame) -> DataFrame:
    """Each channel less the next contact of its shaft, the letters that its name begins with. ``channels``: (recording, name, ord); ``signal``: (recording, channel, t_idx, value)."""
    shaft = F.regexp_extract("name", "^[^0-9]*", 0)
    pairs = channels.withColumn("shaft", shaft).withColumn("other", F.lead("name").over(Window.partitionBy("recording", "shaft").orderBy("ord"))).where("other IS NOT NULL").select("recording", F.col("name").alias("channel"), "other")
    minuend = signal.join(pairs, ["recording", "channel"])
    other = signal.select("recording", F.col("channel").alias("other"), "t_idx", F.col("value").alias("less"))
    return minuend.join(other, ["recording", "other", "t_idx"]).select("recording", F.concat_ws("-", "channel", "other").alias("channel"), "t_idx", (F.col("value") - F.col("less")).alias("value"))
