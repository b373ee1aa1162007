"""Exact top-k inner-product search over a pivot-distance index.

A vector x of the table becomes the point (x, sqrt(M^2 - |x|^2)) of length M, the largest norm, and a query q the point (q, 0): their
angle a has q.x = |q| M cos(a), so the largest inner products are the smallest angles, and angles obey the triangle inequality.
Every point is keyed by its nearest pivot and its angle to it; sorted by that key, the points are packed into blocks, each an
annulus about one pivot, which also holds its least and largest angle to every other pivot. A row within T of a query has angles
to each pivot within T of the query's own, so an annulus whose interval lies farther off, for any pivot, holds no such row. T
comes from the k-th best score known: first that of the pivots (rows themselves), then that of the annuli about a query's own
pivot next to it, then that of the annuli expanded so far, the nearest first: each makes T smaller, and what T rules out is not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Pivots are as many as the root of the rows, between these: distinct rows out of a sample of four times as many; every task holds them.
LEAST_PIVOTS, MOST_PIVOTS = 32, 512
#: Rows of an index block and of a query block: bounds what a task holds.
BLOCK, QUERY_BLOCK = 1024, 256
#: Annuli about its own pivot that a query reads first.
HOME = 2
#: Slack on angles, against rounding in the bounds; scores themselves are integers.
SLACK = 1e-6

RESULT = "query_id long, rank int, vec_id long, score long"


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): components become floor(scale * x). Vectors that are null or hold null, NaN or infinite components, and rows without an id, are left out."""
    x = "CAST(x AS DOUBLE)"
    fine = f"embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('Infinity'))"
    return vectors.select("vec_id", "embedding").where(f"vec_id IS NOT NULL AND {fine}").select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> CAST(floor({scale} * {x}) AS BIGINT))").alias("v"))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))


class Space:
    """What every task knows: the pivots, the largest norm, and how components are stored."""

    def __init__(self, pivots: np.ndarray, pivot_ids: np.ndarray, norm2: float, largest: int, k: int):
        self.pivots, self.pivot_ids, self.norm2, self.k = pivots, pivot_ids, norm2, k
        self.dim = pivots.shape[1]
        self.kind = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64
        self.exact_float = norm2 < 2**50  # sums of products are whole numbers that a double holds
        self.lifted = self.points(pivots)

    def points(self, x: np.ndarray) -> np.ndarray:
        """Rows on the unit sphere of one more dimension."""
        x = x.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))]) / np.sqrt(self.norm2)

    def directions(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries on that sphere, and their norms."""
        q = q.astype(float)
        norm = np.sqrt((q * q).sum(1))
        return np.column_stack([q / np.where(norm > 0, norm, 1)[:, None], np.zeros(len(q))]), norm

    def angles(self, points: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(points @ self.lifted.T, -1, 1))

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if self.exact_float else q.astype(np.int64) @ x.T.astype(np.int64)

    def unpack(self, m: bytes) -> np.ndarray:
        return np.frombuffer(m, self.kind).reshape(-1, self.dim)


class Asked:
    """A block of queries: their angles to the pivots, the k-th best score known of each and the angle T that it allows."""

    def __init__(self, space: Space, row):
        self.ids, self.q = np.frombuffer(row.q_ids, np.int64), space.unpack(row.q_m)
        least = np.iinfo(np.int64).min
        self.tau = np.full(len(self.ids), least)
        s = space.products(self.q, space.pivots)
        if s.shape[1] > space.k:
            for i, own_id in enumerate(self.ids):
                own = s[i][space.pivot_ids != own_id]
                self.tau[i] = np.partition(own, len(own) - space.k)[len(own) - space.k]
        known = dict(zip(row.known_ids, row.known_scores, strict=True))
        self.tau = np.maximum(self.tau, [known.get(i, least) for i in self.ids.tolist()])
        points, norm = space.directions(self.q)
        self.angles = space.angles(points)
        self.home = self.angles.argmin(1)
        self.scale, self.k = norm * np.sqrt(space.norm2), space.k
        self.top: dict[int, np.ndarray] = {}
        self.within = np.full(len(self.ids), np.inf)
        self.tighten(np.arange(len(self.ids)))

    def tighten(self, at: np.ndarray) -> None:
        """T of the queries ``at``: infinite for one that nothing is known of, or whose scores are all zero."""
        ok = at[(self.scale[at] > 0) & (self.tau[at] > np.iinfo(np.int64).min)]
        self.within[ok] = np.arccos(np.clip(self.tau[ok] / self.scale[ok], -1, 1)) + SLACK

    def learn(self, i: int, scores: np.ndarray) -> None:
        """Takes in scores of rows that are new to query ``i``."""
        top = np.sort(np.append(self.top.get(i, scores[:0]), scores))[-self.k :]
        self.top[i] = top
        if len(top) == self.k and top[0] > self.tau[i]:
            self.tau[i] = top[0]
            self.tighten(np.array([i]))


def _key(rows: DataFrame, space: Space, query: bool) -> DataFrame:
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], space.dim)
            d = space.angles(space.directions(x)[0] if query else space.points(x))
            near = d.argmin(1)
            yield b.assign(pivot=near.astype(np.int32), r=d[np.arange(len(b)), near])

    return rows.mapInPandas(keyed, "vec_id long, v array<long>, pivot int, r double").repartitionByRange("pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id")


def _pack(rows: DataFrame, space: Space, most: int, query: bool) -> DataFrame:
    """Runs of at most ``most`` sorted rows, of one pivot if they are no queries, as (block, pivot, r_min, r_max, n, lo, hi, ids, m); lo and hi are the bounds of their angles to all pivots."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, k = (TaskContext.get().partitionId() + 1) << 32, 0
        for b in batches:
            borders = [0, *([] if query else (np.flatnonzero(np.diff(b["pivot"].to_numpy())) + 1).tolist()), len(b)]
            out = []
            for first, end in zip(borders, borders[1:], strict=False):
                for i in range(first, end, most):
                    part = b.iloc[i : min(i + most, end)]
                    x = _matrix(part["v"], space.dim)
                    lo = hi = np.zeros(0, np.float32)
                    if not query:
                        d = space.angles(space.points(x))
                        lo, hi = (d.min(0) - SLACK).astype(np.float32), (d.max(0) + SLACK).astype(np.float32)
                    out.append((base + k, int(part["pivot"].iloc[0]), float(part["r"].min()), float(part["r"].max()), len(part), lo.tobytes(), hi.tobytes(), part["vec_id"].to_numpy(np.int64).tobytes(), x.astype(space.kind).tobytes()))
                    k += 1
            yield pd.DataFrame(out, columns=["block", "pivot", "r_min", "r_max", "n", "lo", "hi", "ids", "m"])

    return rows.mapInPandas(packed, "block long, pivot int, r_min double, r_max double, n int, lo binary, hi binary, ids binary, m binary")


def _reach(asked: DataFrame, space: Space) -> DataFrame:
    """For each block of queries and each pivot the angles [lo, hi] within which a row as good as the k-th known can lie, and the span [home_lo, home_hi] of the queries that are nearest to it."""

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                a = Asked(space, r)
                lo, hi = (a.angles - a.within[:, None]).min(0), (a.angles + a.within[:, None]).max(0)
                spans = {int(p): a.angles[a.home == p, p] for p in np.unique(a.home)}
                out += [(r.qblock, p, float(lo[p]), float(hi[p]), float(spans[p].min()) if p in spans else None, float(spans[p].max()) if p in spans else None) for p in range(len(lo))]
            yield pd.DataFrame(out, columns=["qblock", "pivot", "lo", "hi", "home_lo", "home_hi"])

    return asked.mapInPandas(reach, "qblock long, pivot int, lo double, hi double, home_lo double, home_hi double")


def _score(met: DataFrame, space: Space) -> DataFrame:
    """``met``: blocks of queries with annuli, and how: "home" for the queries of the annulus's pivot alone, "rest" for all but those, "all".

    Returns rows (qblock, query_id, vec_id, score) as good as the k-th known, and for each pair of blocks a row without ids: how many scores were computed in ``met``.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Asked] = {}
        for b in batches:
            found = []
            for r in b.itertuples(index=False):
                if r.qblock not in held:
                    if len(held) >= 16:
                        held.clear()
                    held[r.qblock] = Asked(space, r)
                a = held[r.qblock]
                lo, hi = np.frombuffer(r.lo, np.float32), np.frombuffer(r.hi, np.float32)
                open_ = np.maximum(lo - a.angles, a.angles - hi).max(1) <= a.within
                if r.how != "all":
                    open_ &= (a.home == r.pivot) == (r.how == "home")
                near = np.flatnonzero(open_)
                found.append((r.qblock, None, None, None, len(near) * r.n))
                if not len(near):
                    continue
                ids = np.frombuffer(r.ids, np.int64)
                s, tau = space.products(a.q[near], space.unpack(r.m)), a.tau[near]
                for i in np.flatnonzero((s >= tau[:, None]).any(1)):
                    own = int(a.ids[near[i]])
                    at = np.flatnonzero((s[i] >= tau[i]) & (ids != own))
                    at = at[_best(s[i][at], ids[at], space.k)]
                    a.learn(int(near[i]), s[i][at])
                    found += zip([r.qblock] * len(at), [own] * len(at), ids[at].tolist(), s[i][at].tolist(), [0] * len(at), strict=True)
            yield pd.DataFrame(found, columns=["qblock", "query_id", "vec_id", "score", "met"]).astype({c: "Int64" for c in ("query_id", "vec_id", "score", "met")})

    return met.mapInPandas(score, "qblock long, query_id long, vec_id long, score long, met long")


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, is_query: str = "vec_id % 50 = 0", n_pivots: int | None = None) -> tuple[DataFrame, float]:
    """:func:`top_k`, and the share of (query, row) pairs that the bounds ruled out."""
    spark = vectors.sparkSession
    rows = materialise(vectors.select("vec_id", "v"), "quantised")
    largest = F.max(F.expr("aggregate(v, 0L, (s, x) -> greatest(s, abs(x)))"))
    norm2, dim, most, n = rows.agg(F.max(F.expr("aggregate(v, double(0), (s, x) -> s + double(x) * x)")), F.max(F.size("v")), largest, F.count("*")).first()
    asked = (rows.where(is_query) if queries is None else queries.select("vec_id", "v")).distinct()
    if not n:
        return spark.createDataFrame([], RESULT), 0.0
    if not dim or not norm2:
        return _all_zero(rows, asked, k), 1.0
    if queries is not None:
        most = max(most, asked.agg(largest).first()[0] or 0)
    n_pivots = n_pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, isqrt(n)))
    seeds = {tuple(r.v): r.vec_id for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * n_pivots).collect()}  # a bounded number of rows
    space = Space(_matrix(pd.Series(list(seeds)[:n_pivots]), dim), np.array(list(seeds.values())[:n_pivots]), norm2, most, k)

    index = materialise(_pack(_key(rows, space, False), space, BLOCK, False), "annuli")
    qblocks = materialise(_pack(_key(asked, space, True), space, QUERY_BLOCK, True), "queries")
    blocks = qblocks.select(F.col("block").alias("qblock"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    annuli = index.select("block", "pivot", "r_min", "r_max")
    none = F.expr("CAST(array() AS array<bigint>)")

    def ranked(found: DataFrame) -> DataFrame:
        return found.where("query_id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    def expand(pairs: DataFrame, known: DataFrame) -> DataFrame:
        met = pairs.join(known, "qblock").join(index.select("block", "pivot", "n", "lo", "hi", "ids", "m"), "block")
        return materialise(_score(met.sortWithinPartitions("qblock", "gap"), space), "scored")

    known = blocks.withColumns({"known_ids": none, "known_scores": none})
    at_home = _reach(known, space).where("home_lo IS NOT NULL").join(annuli, "pivot").withColumn("gap", F.greatest(F.col("home_lo") - F.col("r_max"), F.col("r_min") - F.col("home_hi"), F.lit(0.0)))
    nth = F.row_number().over(Window.partitionBy("qblock", "pivot").orderBy("gap", "block"))
    home = materialise(at_home.withColumn("nth", nth).where(F.col("nth") <= HOME).select("qblock", "block", "gap", F.lit("home").alias("how")), "home")
    first = expand(home, known)
    kth = ranked(first).where(F.col("rank") == k).groupBy("qblock").agg(F.collect_list("query_id").alias("known_ids"), F.collect_list("score").alias("known_scores"))  # a block's queries
    known = materialise(blocks.join(kth, "qblock", "left").withColumns({c: F.coalesce(c, none) for c in ("known_ids", "known_scores")}), "known")
    gap = F.greatest(F.col("lo") - F.col("r_max"), F.col("r_min") - F.col("hi"))  # the lower, the deeper within reach
    reached = _reach(known, space).join(annuli, "pivot").withColumn("gap", gap).where("gap <= 0").select("qblock", "block", "gap")
    pairs = reached.join(home.select("qblock", "block", F.lit("rest").alias("how")), ["qblock", "block"], "left").withColumn("how", F.coalesce("how", F.lit("all")))
    found = first.unionByName(expand(pairs, known))
    n_asked = qblocks.agg(F.sum("n")).first()[0]
    met = found.agg(F.sum("met")).first()[0] or 0
    best = ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return best, 1 - met / (n_asked * n) if n_asked else 0.0


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, is_query: str = "vec_id % 50 = 0", n_pivots: int | None = None) -> DataFrame:
    """The k largest integer inner products of every query with every row of another id: (query_id, rank, vec_id, score).

    ``vectors``: (vec_id, v) as :func:`quantise` gives it; ``queries``: the same, or else the rows that fit ``is_query``. Ties go
    to the smaller vec_id; a query with fewer than k candidates gets all. Shorter vectors count as padded with zeros. Repeated
    query rows count once, repeated candidates each; other columns are ignored. No queries or no rows give an empty result. Scores are exact below 2^63.
    """
    return search(vectors, queries, k, is_query, n_pivots)[0]


def _all_zero(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Vectors without components, or of zeros, all score zero: each query gets the smallest other ids, which are among the k + 1 smallest."""
    smallest = rows.orderBy("vec_id").limit(k + 1).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    own = asked.select(F.col("vec_id").alias("query_id")).distinct().join(F.broadcast(smallest)).select("query_id", F.posexplode(F.expr(f"slice(filter(ids, x -> x != query_id), 1, {k})")))  # one row
    return own.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col").alias("vec_id"), F.lit(0).cast("long").alias("score"))


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantise(table(spark, sf_dir, "embeddings")))


ORACLE = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
