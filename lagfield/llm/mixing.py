"""Mixing sources to target weights by blocks.

Each source's words, document after document, are packed into blocks of a fixed length. Every output shard draws multinomial
counts of slots for the sources; a source's slots are numbered through the shards, and slot j maps to a block by a
pseudorandom permutation of the source's block indices, a fresh one for each pass. Slots and blocks are joined by block index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Words to a block, output shards, share of all words to take, most uses of a source, weights by source in turn.
BLOCK, SHARDS, SHARE, MOST = 64, 64, 1.5, 2.0
WEIGHTS = (3.0, 1.0, 2.0)
#: Cells of a source over which its documents are laid end to end, so that no source is numbered in one task.
CELLS = 1024
SEED = 7


def n_words(text: Column) -> Column:
    """Runs of characters other than space and 9 to 13; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes``: (source, source_size), one row to a source. Adds nth (0 from the smallest source by code point, null last), weight and target.

    Targets share ``share`` of all sizes by weight and stop at ``most`` times their source's size, the excess reshared until none
    is above: target = least(most * size, level * weight), for the level at which they add up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    rows = rows.withColumns({"cap": most * F.col("source_size"), "all": share * F.sum("source_size").over(Window.partitionBy())})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    # the level holds from the first source, by ratio, that does not reach its cap under it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "nth", "weight", "target")


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A hash of 32-bit values."""
    x = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 4, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 ... n-1 by key: a Feistel network on the next even number of bits, walked until it falls within n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, open_ = index.astype(np.uint64), np.ones(len(index), bool)
    while open_.any():
        x = out[open_]
        left, right = x >> np.uint64(half), x & mask
        for r in reversed(range(rounds)) if inverse else range(rounds):
            if inverse:
                left, right = right ^ (_mixed(left, key * rounds + r) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, key * rounds + r) & mask)
        out[open_] = left << np.uint64(half) | right
        open_[open_] = out[open_] >= n
    return out.astype(np.int64)


def _key(nth: int, turn: int, seed: int) -> int:
    return (seed * 1_000_003 + nth) * 1_009 + turn


def slots_of(sources: list[tuple[int, int, float]], block: int = BLOCK, seed: int = SEED) -> dict[int, tuple[int, int]]:
    """For (nth, size, target) of each source: its number of slots, and the words of the last one that the mix takes, so that words add up to the target, rounded."""
    out = {}
    for nth, size, target in sources:
        words, blocks = round(target), -(-size // block)
        turns, rest = divmod(words, size) if size else (0, 0)
        if not rest:
            out[nth] = turns * blocks, block
            continue
        short = block * blocks - size  # the last block of a source may be short; it counts where its turn comes
        at = int(permuted(np.array([blocks - 1]), blocks, _key(nth, turns, seed), inverse=True)[0])
        n = -(-rest // block)
        if n > at:
            n = -(-(rest + short) // block)
        got = n * block - (short if n > at else 0)
        last = (block - short if at == n - 1 else block) - (got - rest)
        out[nth] = turns * blocks + n, last
    return out


def draw(slots: dict[int, int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Multinomial counts (shards, sources): each shard draws its equal part of all slots from what the sources still have, so that the totals come out exactly."""
    left = np.array([slots[k] for k in sorted(slots)], np.int64)
    rng, total = np.random.default_rng(seed), int(left.sum())
    out = np.zeros((shards, len(left)), np.int64)
    for h in range(shards):
        want = total * (h + 1) // shards - total * h // shards
        while want and left.sum():
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[h] += got
            left -= got
            want -= int(got.sum())
    return out


def block_pieces(docs: DataFrame, block: int = BLOCK, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """``docs``: (uid, doc_id, source, size, print), print a hash of the text. Returns (uid, doc_id, source, size, begin), begin the document's first word in its source, and (source, source_size).

    Order within a source is by a hash cell and then by doc_id, size and print, so that it is the same however the rows are split; rows alike in all of these are interchangeable.
    """
    same = lambda *names: [F.coalesce(F.col(c), F.lit("")) if c == "source" else F.col(c) for c in names]
    spread = F.xxhash64("doc_id", "size", "print")  # rows without an id, or under one id, do not share a cell
    rows = docs.withColumns({"cell": F.pmod(spread, F.lit(cells)).cast("int"), "no_source": F.col("source").isNull()})
    key = [*same("source"), F.col("no_source")]
    sums = rows.groupBy("source", "no_source", "cell").agg(F.sum("size").alias("cell_size"))
    before = sums.withColumn("cell_begin", F.sum("cell_size").over(Window.partitionBy(*key).orderBy("cell")) - F.col("cell_size"))
    within = Window.partitionBy(*key, "cell").orderBy("doc_id", "size", "print", "uid").rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.withColumn("in_cell", F.sum("size").over(within) - F.col("size"))
    a, b = laid.alias("a"), before.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.cell") == F.col("b.cell")))
    begun = joined.select("a.uid", "a.doc_id", "a.source", "a.size", (F.col("b.cell_begin") + F.col("a.in_cell")).alias("begin"))
    return begun, sums.groupBy("source").agg(F.sum("cell_size").alias("source_size"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source), and its documents.

    Returns (uid, shard, slot, block, first_word, n_words), the words of each document that each slot takes, and (uid, doc_id, source,
    size, source_size, target). uid is the long column ``row_id`` of ``docs``, or else numbers its rows, so repeated and null ids stay apart. A null text has no words
    and is never taken; null sources are one source; no documents give empty results. Reruns with one seed agree, with or without ids; rows of one id and text may change places.
    """
    spark = docs.sparkSession
    uid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    sized = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("print"), uid.alias("uid")), "sizes")
    laid, sizes = block_pieces(sized, block)
    laid = materialise(laid, "laid")
    goals = materialise(targets(sizes, weights, share, most), "targets")
    known = [(r.nth, r.source_size, r.target) for r in goals.orderBy("nth").collect()]  # one row to a source: what any mix is configured by
    ends = slots_of(known, block, seed)
    counts = draw({k: n for k, (n, _) in ends.items()}, shards, seed) if known else np.zeros((shards, 0), np.int64)
    firsts = np.cumsum(counts, 0) - counts
    n_blocks = {nth: -(-size // block) for nth, size, _ in known}
    drawn = [(h, k, int(firsts[h, k]), int(counts[h, k])) for h in range(shards) for k in range(counts.shape[1]) if counts[h, k]]

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, k, first, n in b[["shard", "nth", "first", "n"]].itertuples(index=False):
                for lo in range(first, first + n, 1 << 18):
                    j = np.arange(lo, min(lo + (1 << 18), first + n))
                    turn = j // n_blocks[k]
                    at = np.empty(len(j), np.int64)
                    for t in np.unique(turn):
                        at[turn == t] = permuted(j[turn == t] % n_blocks[k], n_blocks[k], _key(k, int(t), seed))
                    total, last = ends[k]
                    yield pd.DataFrame({"shard": np.int32(h), "nth": np.int32(k), "slot": j, "block": at, "most": np.where(j == total - 1, last, block)})

    made = spark.createDataFrame(drawn, "shard int, nth int, first long, n long").repartition(shards, "shard", "nth").mapInPandas(slots, "shard int, nth int, slot long, block long, most long")
    docs_of = laid.join(F.broadcast(goals.withColumnRenamed("source", "goal_source")), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    spans = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
    parts = docs_of.where("size > 0").select("uid", "nth", "begin", "size", F.explode(spans).alias("block"))
    lo = F.greatest(F.col("begin"), F.col("block") * block)
    hi = F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.col("most"))
    # a few drawn rows become very many slots, which the planner cannot see: it would broadcast them
    taken = made.hint("merge").join(parts, ["nth", "block"]).withColumns({"first_word": lo - F.col("begin"), "n_words": hi - lo}).where("n_words > 0").select("uid", "shard", "slot", "block", "first_word", "n_words")
    return taken, docs_of.select("uid", "doc_id", "source", "size", "source_size", "target")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all their columns, each whole document as often as the mix takes it: its taken words over its size, rounded up or down by a hash of the id so that sources come near their targets in whole documents too. Documents without words go."""
    row, copies = "row_of_mix", "times_of_mix"
    while {row, copies} & set(docs.columns):
        row, copies = f"{row}_", f"{copies}_"
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken, sized = mix(rows, row_id=row, **options)
    sums = taken.groupBy("uid").agg(F.sum("n_words").alias("taken")).join(sized.select("uid", "doc_id", "size"), "uid")
    chance = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1_000_003)) / 1_000_003
    times = sums.select(F.col("uid").alias(row), F.floor(F.col("taken") / F.col("size") + chance).cast("int").alias(copies)).where(F.col(copies) > 0)
    back = rows.join(times, row)
    return back.withColumn(copies, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def op2_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, docs = mix(table(spark, sf_dir, "documents"))
    sums = taken.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    return docs.join(sums, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
