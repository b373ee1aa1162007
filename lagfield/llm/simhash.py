"""SimHash near-duplicates by covering locality-sensitive hashing.

For a radius r every bit position gets a random (r + 1)-bit vector, and every non-zero (r + 1)-bit vector v gives one table whose
mask drops the positions whose vector is orthogonal to v over GF(2). Differing positions are r at most, so some v is
orthogonal to all their vectors: each pair within the radius collides in at least one of the 2^(r+1) - 1 tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, join_hot, lean, materialise, table
from .components import components
from .jaccard import BLOCK, ROUNDS, _Hashes, set_key, similar_sets

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingle words, seed of their hash and radius in bits.
WORDS, SEED, RADIUS = 4, 42, 4
#: What keep_one compares: the sets of five-word shingles, which share at least this part (in hundredths) of their union.
KEEP_WORDS, KEEP_PERCENT = 5, 80
#: Fingerprints that are compared with one another; larger buckets are dealt anew.
CHUNK = 2048


def shingle_hashes(text: str | bytes, words: int = WORDS, seed: int = SEED) -> list[int]:
    found = (text.encode() if isinstance(text, str) else text).translate(LOWER).split()  # bytes.split takes exactly space and 9-13
    line, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [h(line, seed)] if found else []
    starts = [0, *(e + 1 for e in ends[:-words])]
    return [h(line[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=True)]


def fingerprint(text: str | bytes | None, words: int = WORDS, seed: int = SEED, distinct: bool = False) -> int:
    """Bits set in over half of the shingle hashes, as a signed 64-bit integer; zero for a text without words. ``distinct`` counts repeated shingles once."""
    found = shingle_hashes(text or "", words, seed)
    hashes = np.array(list(set(found)) if distinct else found, np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[i : i + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = 2 * total > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, words: int = WORDS, seed: int = SEED, distinct: bool = False) -> Column:
    def all_of(texts: pd.Series) -> pd.Series:
        known: dict = {}
        for x in texts:
            if x not in known:
                known[x] = fingerprint(x, words, seed, distinct)
        return pd.Series([known[x] for x in texts], dtype="int64")

    all_of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(all_of, "long")(text)


def sets_and_prints(text: Column, words: int) -> Column:
    """Struct (node, size, fp): what :func:`jaccard.set_of` and :func:`fingerprints` give. Two functions of unlike kinds are two workers to a task; this is one."""

    @lean
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for texts in batches:
            known: dict = {}
            for x in texts:
                if x not in known:
                    known[x] = (*set_key(x, hashes, words), fingerprint(x))
            node, size, fp = ([known[x][i] for x in texts] for i in range(3))
            yield pd.DataFrame({"node": pd.array(node, "Int64"), "size": size, "fp": fp})

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(each, "node long, size long, fp long")(text.cast("binary"))


@lru_cache
def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 20) -> tuple[int, ...]:
    """The signed masks of the covering code; vectors are dealt evenly over the positions before they are shuffled."""
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % (1 << radius + 1))
    out = []
    for v in range(1, 1 << radius + 1):
        kept = [int(m & v).bit_count() % 2 == 1 for m in vectors] + [False] * (64 - bits)
        out.append(int(np.packbits(kept, bitorder="little").view(np.int64)[0]))
    return tuple(out)


def _forest(rest: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges within the radius that connect whatever pairs within it connect: fewer than there are fingerprints."""
    a, b = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius
            if near.any():
                queue += list(rest[near])
                a += [int(x)] * int(near.sum())
                b += rest[near].tolist()
                rest = rest[~near]
    return a, b


def _finer(mask: int, radius: int, bits: int = 64) -> list[int]:
    """The signed ``mask`` with each of radius + 1 parts of the bits it leaves free: fingerprints within the radius agree on one of the parts."""
    free = [b for b in range(bits) if not mask >> b & 1]
    parts = [sum(1 << b for b in free[i :: radius + 1]) | mask % (1 << 64) for i in range(min(radius + 1, len(free)))]
    return [p - (1 << 64) if p >> 63 else p for p in parts]


def near_edges(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Distinct ``prints`` (fp long) to edges (a, b), each within the radius, that connect whatever pairs within the radius connect.

    A bucket is what agrees on a mask. One of up to ``chunk`` fingerprints is searched at once, and gives a spanning forest, not its
    pairs. A larger one is dealt anew by the bits its mask leaves free: cut into radius + 1 parts, a pair agrees on one of them, so
    each fingerprint goes to as many smaller buckets, and no pair is lost. A bucket whose mask leaves few bits free cannot be large,
    as fingerprints differ, so this ends.
    """
    spark = prints.sparkSession
    schema = "a long, b long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (mask, key, fp): a bucket, of ``chunk`` rows at most, is a run of one mask and key."""

        def done(held: list[np.ndarray]) -> tuple[list[int], list[int]]:
            x = np.concatenate(held) if len(held) > 1 else held[0]
            return _forest(x, radius) if len(x) > 1 else ([], [])

        key, held = None, []
        for batch in batches:
            m, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            borders = np.concatenate([[0], np.flatnonzero((np.diff(m) != 0) | (np.diff(k) != 0)) + 1, [len(fp)]])
            a, b = [], []
            for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                if key == (m[lo], k[lo]):
                    held.append(fp[lo:hi])
                    continue
                if held:
                    x, y = done(held)
                    a += x
                    b += y
                key, held = (m[lo], k[lo]), [fp[lo:hi]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            a, b = done(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    masks = covering_masks(radius)
    dealt = prints.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    edges = None
    while True:
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        large = materialise(sizes.where(F.col("n") > chunk).select("mask", "key"), "large-buckets")
        here = dealt.join(large, ["mask", "key"], "left_anti")
        found = here.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp").mapInArrow(search, schema)
        edges = found if edges is None else edges.unionByName(found)
        over = [r.mask for r in large.select("mask").distinct().collect()]  # at most 2^(radius + 1) (radius + 1)^level masks
        if not over:
            return edges
        finer = spark.createDataFrame([(m, _finer(m, radius)) for m in over], "mask long, finer array<long>")
        again = dealt.join(large, ["mask", "key"], "left_semi").join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask"))
        # the parts of two tables can be one mask
        dealt = materialise(again.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct(), "dealt")


def _labels(rows: DataFrame, radius: int) -> DataFrame:
    """``rows``: (doc_id, fp). Returns (fp, n, component_id), one row for each fingerprint, with n rows."""
    firsts = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    roots = components(near_edges(firsts.select("fp"), radius))
    rooted = materialise(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints")), "least")
    return materialise(join_hot(rooted, least, "root", "prints").select("fp", "n", "component_id"), "labels")


def simhash_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text): component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.

    Null and empty texts, and those of white space, have fingerprint zero and link like any other. Null ids are no candidates for
    component_id, which is null where a component holds no other; repeated rows stay; other columns are ignored.
    """
    rows = materialise(docs.select("doc_id", fingerprints(F.col("text"), words, seed).alias("fp")), "fingerprints")
    return join_hot(rows, _labels(rows, radius), "fp", "n").select("doc_id", "fp", "component_id")


def print_pairs(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (node, leader, size, leader_size) that fingerprints link. ``rows``: (node, size, fp), a set of shingles and the fingerprint of a text that has it.

    The smallest set of each fingerprint stands for it: it leads the others of its fingerprint, and meets those of the fingerprints within ``radius`` bits that :func:`near_edges` joins to its own.
    """
    named = materialise(rows.groupBy("fp", "node").agg(F.max("size").alias("size")), "prints")
    led = materialise(named.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("led"), F.count("*").alias("n")).select("fp", F.col("led.node").alias("leader"), F.col("led.size").alias("leader_size"), "n"), "firsts")
    pairs = join_hot(named, led.where("n > 1"), "fp", "n").select("node", "leader", "size", "leader_size")
    # a fingerprint has fewer edges than its buckets hold others, some ten thousand at most
    edges = near_edges(led.select("fp"), radius).join(led.select(F.col("fp").alias("a"), F.col("leader").alias("node"), F.col("leader_size").alias("size")), "a")
    near = edges.join(led.select(F.col("fp").alias("b"), "leader", "leader_size"), "b").select("node", "leader", "size", "leader_size")
    return pairs.unionByName(near).where(F.col("node") != F.col("leader"))


def keep_one(docs: DataFrame, words: int = KEEP_WORDS, percent: int = KEEP_PERCENT, rounds: int = ROUNDS, block: tuple[int, int] = BLOCK, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one kept of each group, that of the smallest doc_id; all columns stay as they are.

    Fingerprints within ``radius`` bits link texts first, as in :func:`simhash_components`, and each of these links is checked: texts are linked if they share ``percent`` hundredths
    of their distinct shingles or more. What is still apart then is compared by the exact join (:mod:`jaccard`), which finds the pairs that fingerprints of this radius miss, at every size of
    a table and of a group. Groups are what links connect. Texts without words are one group; of equal rows one stays; a null id is kept only where a group holds no other.
    """
    spark = docs.sparkSession
    text_key = F.md5(F.coalesce("text", F.lit("")))
    with bounded_batches(spark):
        found = docs.select("doc_id", text_key.alias("key"), sets_and_prints(F.col("text"), words).alias("s"))
        rows = materialise(found.select("doc_id", "key", F.coalesce("s.node", F.lit(0)).alias("node"), "s.size", "s.fp"), "sets")
    nodes = materialise(rows.where("size > 0").groupBy("node").agg(F.max("size").alias("size")), "nodes")
    roots = similar_sets(docs, nodes, words, percent, rounds, block, print_pairs(rows.where("size > 0").select("node", "size", "fp"), radius))
    texts = rows.groupBy("node", "key").agg(F.min("doc_id").alias("first"))  # copies are few rows before they meet
    firsts = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = firsts.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "key")).alias("kept"))
    kept = materialise(least.select(F.col("kept.key").alias("own_key"), F.col("kept.first").alias("own_id")), "kept")
    same = (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    pairs = rows.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    # out goes what is not kept, and what is kept and repeated, of which one row comes back
    out = pairs.join(kept, same, "left").where("own_key IS NULL OR n > 1")
    out = materialise(out.select(F.col("key").alias("own_key"), F.col("doc_id").alias("own_id"), F.col("own_key").isNotNull().alias("repeated")), "out")
    discard(rows, nodes, roots, kept)
    marked = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_key.alias("key"))
    once_each = marked.join(out.hint("merge"), same, "left_anti").select("row.*")
    if not out.where("repeated").limit(1).count():
        return once_each
    nth = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("key"))
    return once_each.unionByName(marked.join(out.where("repeated").hint("merge"), same, "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
