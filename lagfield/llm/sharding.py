"""Sharding by minimax contiguous partition, in DataFrame and SQL functions only.

Atomic groups are equal texts, in the order of their hash. Buckets of that order are a list of sizes of bounded length; over it a
binary search finds the smallest capacity with which a greedy walk needs no more than ``n_shards`` shards. Buckets in which a cut of
some feasible capacity could fall are then split by further bits of the hash, and the search is run again, until such buckets are
single groups: the capacity is then that of the groups themselves. The cuts keep to that capacity and, within what it leaves
free, to equal parts of what remains. A group larger than the capacity stands alone in its shard, so one giant group of copies does
not let the others grow to its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Bits of the hash that make a bucket, and by how many more one is split where a cut may fall in it.
BITS, MORE_BITS = 14, 4
#: Slots are numbered within (shard, salt) cells, so that a shard holding a third of all rows is still dealt to many tasks.
SLOT_SALTS = 1024


def _searched(groups: DataFrame, n_shards: int) -> DataFrame:
    """One row of ``groups`` (bucket, size, single): atoms in order, their ends, the capacity, the cuts (places after which a shard ends) and lows and highs, between which the j-th cut of any capacity that single groups allow must lie."""
    steps = ", ".join(f"{1 << b}L" for b in reversed(range(22)))
    cums = groups.where("size > 0").withColumn("cum", F.sum("size").over(Window.orderBy("bucket")))
    one = cums.agg(F.array_sort(F.collect_list(F.struct("cum", "bucket", "single"))).alias("atoms"), F.max(F.when(F.col("single"), 0).otherwise(F.col("size"))).alias("widest"))
    one = one.withColumn("ends", F.expr("transform(atoms, a -> a.cum)"))  # a bounded list of buckets

    def fit(limit: str) -> str:
        """How many leading groups end at or before ``limit``: a bit-wise descent in the sorted ends."""
        return f"aggregate(array({steps}), 0L, (held, step) -> CASE WHEN held + step > size(ends) THEN held WHEN element_at(ends, CAST(held + step AS INT)) <= {limit} THEN held + step ELSE held END)"

    def end(pos: str) -> str:
        return f"(CASE WHEN {pos} = 0 THEN 0L ELSE element_at(ends, CAST({pos} AS INT)) END)"

    def walk_on(pos: str, cap: str) -> str:
        return f"least(CAST(size(ends) AS BIGINT), greatest({pos} + 1, {fit(f'{end(pos)} + {cap}')}))"

    def walk_back(pos: str, cap: str) -> str:
        return f"CASE WHEN {end(pos)} <= {cap} THEN 0L ELSE least({pos} - 1, {fit(f'{end(pos)} - {cap} - 1')} + 1) END"

    reach = f"aggregate(sequence(1, {n_shards}), 0L, (at, i) -> {walk_on('at', 'cap')})"
    search = f"""aggregate(sequence(1, 63), struct(1L AS lo, coalesce(element_at(ends, -1), 1L) AS hi),
        (s, j) -> CASE WHEN s.lo >= s.hi THEN s ELSE element_at(transform(array((s.lo + s.hi) div 2), cap ->
            CASE WHEN {reach} >= size(ends) THEN struct(s.lo AS lo, cap AS hi) ELSE struct(cap + 1 AS lo, s.hi AS hi) END), 1) END)"""
    # backs[j]: where j shards must begin at the earliest to hold the rest
    backs = f"aggregate(sequence(1, {n_shards}), array(CAST(size(ends) AS BIGINT)), (b, i) -> concat(b, array({walk_back('element_at(b, -1)', 'capacity')})))"
    here = "element_at(c, -1)"
    part = fit(f"{end(here)} + CAST(ceil((element_at(ends, -1) - {end(here)}) / ({n_shards} - i + 1)) AS BIGINT)")
    following = f"least({walk_on(here, 'capacity')}, greatest({here} + 1, {part}, element_at(backs, {n_shards} - i + 1)))"
    cuts = f"aggregate(sequence(1, {n_shards}), array(0L), (c, i) -> concat(c, array({following})))"
    low = f"aggregate(sequence(1, {n_shards}), array(0L), (c, i) -> concat(c, array({fit(f'{end(here)} + greatest(capacity - widest, 1L)')})))"
    above = f"least(CAST(size(ends) AS BIGINT), greatest({here}, {fit(f'{end(here)} + capacity - 1')}) + 1)"
    high = f"aggregate(sequence(1, {n_shards}), array(0L), (c, i) -> concat(c, array({above})))"
    searched = one.where("size(ends) > 0").withColumn("capacity", F.expr(f"{search}.hi")).withColumn("backs", F.expr(backs))
    return searched.withColumns({"cuts": F.expr(cuts), "lows": F.expr(low), "highs": F.expr(high)})


def minimax_cuts(groups: DataFrame, n_shards: int) -> DataFrame:
    """``groups``: (bucket, size), a list of bounded length. Returns (bucket, shard), shards contiguous in bucket order."""
    return _shards_of(_searched(groups.withColumn("single", F.lit(True)), n_shards))


def _shards_of(searched: DataFrame) -> DataFrame:
    return searched.select("cuts", F.posexplode("atoms").alias("nth", "atom")).select("atom.bucket", F.expr("CAST(size(filter(cuts, c -> c > 0 AND c <= nth)) AS INT)").alias("shard"))


def _floor(bits: int) -> Column:
    """The first place of a bucket of so many bits that ``place`` lies in."""
    return F.shiftleft(F.shiftright("place", 63 - bits), 63 - bits)


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, bits: int = BITS, more_bits: int = MORE_BITS, salts: int = SLOT_SALTS) -> DataFrame:
    """Deal ``docs`` (doc_id, text) to shards of nearly equal bytes; equal texts share a shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (gapless from 0 in each shard). A null text
    counts and hashes as the empty text; repeated rows and null ids each keep a slot; an empty table gives an empty result;
    other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("place"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "sizes").withColumn("bucket", _floor(bits))
    while True:
        groups = rows.groupBy("bucket").agg(F.sum("size").alias("size"), (F.min("place") == F.max("place")).alias("single"))
        searched = materialise(_searched(groups, n_shards), "cuts")
        cut = searched.select("lows", "highs", F.posexplode("atoms").alias("nth", "atom")).where("NOT atom.single AND exists(zip_with(lows, highs, (a, b) -> nth >= a AND nth < b), x -> x)")
        open_ = materialise(cut.select("atom.bucket", F.lit(True).alias("open")), "open")
        if not open_.count():
            break
        bits += more_bits
        rows = rows.join(F.broadcast(open_), "bucket", "left").withColumn("bucket", F.when(F.col("open"), _floor(min(bits, 63))).otherwise(F.col("bucket"))).drop("open")  # buckets near the cuts
    dealt = rows.join(F.broadcast(_shards_of(searched)), "bucket").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))  # the list of buckets
    cells = dealt.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = cells.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    return dealt.withColumn("rank", rank).join(F.broadcast(before), ["shard", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot"))  # n_shards * salts rows at most


def op6_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
