"""An exact similarity join of texts by their sets of word shingles.

The global order of all shingles is cut into fragments. Each fragment counts, for itself, how often its shingles occur; a set can have a partner only
if enough of its shingles occur elsewhere too, so what the fragments found is added up by set, and most sets are done. Those that are left take
their rarest shingles as a prefix, of which two similar sets share one. Sets that share one are compared with a leader of theirs, fragment by
fragment: partial overlaps are counted apart and summed by pair. After each round, what is linked already need not be compared; the sets whose
pairs are still open after the last round are compared by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, join_hot, lean, materialise, table
from .components import components

WORDS, PERCENT = 5, 80
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles to a fragment while they are counted, about, the least number of fragments, and those of a pair's sets while it is compared.
FRAGMENT, FRAGMENTS, PARTS = 2_000_000, 64, 8
#: Rounds of leaders, and sets and shingles that one block compares after them.
ROUNDS, BLOCK = 2, (1024, 500_000)
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Times an index has been counted anew among the sets that are left.
PEELS = 2


class _Hashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, hashes: _Hashes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as ascending unsigned 64-bit hashes, mixed of the hashes of their words; a text of fewer words is one shingle."""
    found = (text or b"").translate(LOWER).split()  # bytes.split takes exactly space and 9-13
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ x >> np.uint64(32))


def _set_id(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def set_key(text: bytes | None, hashes: _Hashes, words: int = WORDS) -> tuple[int | None, int]:
    """The hash of a text's shingle set, None without words, and how many shingles it has."""
    s = shingle_set(text, hashes, words)
    return (_set_id(s) if len(s) else None), len(s)


def set_of(text: Column, words: int = WORDS) -> Column:
    """Struct (node, size): the hash of a text's shingle set, null without words, and how many shingles it has."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for texts in batches:
            known: dict = {}
            for x in texts:
                if x not in known:
                    known[x] = set_key(x, hashes, words)
            yield pd.DataFrame({"node": pd.array([known[x][0] for x in texts], "Int64"), "size": [known[x][1] for x in texts]})

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(each, "node long, size long")(text.cast("binary"))


def _packed(batches: Iterator[pa.RecordBatch], fragments: int, words: int) -> Iterator[pa.RecordBatch]:
    """Texts to rows (f, nodes, counts, sizes, tokens): the shingles of all sets of a batch within fragment f, set by set, and the sizes of the whole sets."""
    hashes = _Hashes()
    for batch in batches:
        sets = {}
        for text in set(batch.column(0).to_pylist()):
            s = shingle_set(text, hashes, words)
            if len(s):
                sets[_set_id(s)] = s
        if not sets:
            continue
        nodes, tokens = np.fromiter(sets, np.int64, len(sets)), np.concatenate(list(sets.values()))
        sizes = np.array([len(s) for s in sets.values()], np.int32)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        f = ((tokens >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(f, kind="stable")
        f, owner, tokens = f[order], owner[order], tokens[order]
        borders = np.flatnonzero(np.diff(f, prepend=-1, append=fragments).astype(bool))
        out = []
        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            own, counts = np.unique(owner[lo:hi], return_counts=True)
            out.append((int(f[lo]), nodes[own].tobytes(), counts.astype(np.int32).tobytes(), sizes[own].tobytes(), tokens[lo:hi].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["f", "nodes", "counts", "sizes", "tokens"])


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """What a binary column holds, end to end, as numbers; no value becomes an object of its own."""
    out = [np.zeros(0, kind)]
    for x in column.chunks:
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else [0]
        if ends[-1] > ends[0]:
            out.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate(out)


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``values`` cut at ``ends``, from 0, as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _counted(f: int, tokens: np.ndarray, owners: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Of fragment ``f``, the sets to those of their shingles there that another set has as well, and in how many sets each is.

    ``tokens`` are the shingles of the sets ``owners``, ``counts`` of each; ``sizes`` are those of the whole sets.
    """
    known, at, own = np.unique(owners, return_index=True, return_inverse=True)
    nodes = np.repeat(own.astype(np.int32), counts)
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    once = np.ones(len(tokens), bool)  # copies of a set come from several batches
    once[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes = tokens[once], nodes[once]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    lengths = np.diff(np.append(np.flatnonzero(first), len(tokens))).astype(np.int32)
    sets = np.repeat(lengths, lengths)
    some = sets > 1
    tokens, nodes, sets = tokens[some], nodes[some], sets[some]
    order = np.argsort(nodes, kind="stable")
    held = np.bincount(nodes, minlength=len(known))
    has = np.flatnonzero(held)
    ends = np.concatenate([[0], np.cumsum(held[has])])
    return pa.table(
        {"f": np.full(len(has), f, np.int32), "node": known[has], "size": sizes[at[has]].astype(np.int64), "tokens": _cut(tokens[order], ends), "sets": _cut(sets[order], ends)}
    )


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of :func:`_packed` of a fragment, counted."""
    return _counted(key[0].as_py(), _flat(rows["tokens"], np.uint64), _flat(rows["nodes"], np.int64), _flat(rows["counts"], np.int32), _flat(rows["sizes"], np.int32))


def _recount(key: tuple, rows: pa.Table) -> pa.Table:
    """Rows (node, n, size, tokens) of a fragment, a set each, counted anew among themselves."""
    node, n, size = (rows[c].to_numpy() for c in ("node", "n", "size"))
    return _counted(key[0].as_py(), _flat(rows["tokens"], np.uint64), node, n, size)


SHARED = "f int, node long, size long, tokens binary, sets binary"


def _with_prefix(tokens: Column, sets: Column, size: Column, percent: int) -> Column:
    """Struct (shingles, prefix, central): a set's shared shingles ascending, the rarest of them that a partner cannot all lack, and the share of shared ones in thousandths."""

    def each(tokens: pd.Series, sets: pd.Series, size: pd.Series) -> pd.DataFrame:
        out = []
        for t, d, n in zip(tokens, sets, size, strict=True):
            x, df = np.concatenate([np.frombuffer(b, np.uint64) for b in t]), np.concatenate([np.frombuffer(b, np.int32) for b in d])
            order = np.argsort(x)
            x, df = x[order], df[order]
            needed = -(-percent * int(n) // 100)
            prefix = x[np.argsort(df, kind="stable")[: len(x) - needed + 1]]
            out.append((x.tobytes(), prefix.view(np.int64).tolist(), 1000 * len(x) // int(n)))
        return pd.DataFrame(out, columns=["shingles", "prefix", "central"])

    each.__annotations__ = {"tokens": pd.Series, "sets": pd.Series, "size": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(each, "shingles binary, prefix array<long>, central long")(tokens, sets, size)


def _parted(shingles: Column) -> Column:
    """A set's shingles by PARTS fragments of their order."""

    def each(sets: pd.Series) -> pd.Series:
        borders = (np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS)).astype(np.uint64)
        return pd.Series([[p.tobytes() for p in np.split(x, np.searchsorted(x, borders))] for x in (np.frombuffer(s, np.uint64) for s in sets)])

    each.__annotations__ = {"sets": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "array<binary>")(shingles)


def _overlap(a: Column, b: Column) -> Column:
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")

    each.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "long")(a, b)


def connected(sets: list[np.ndarray], sizes: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """``label`` (numbers of sets), with labels made equal where a pair of ``percent`` hundredths or more connects them: exact, in whole numbers.

    A set is compared with all others at once by its shingles' postings. The sets of the largest group are left out: what links them to others is seen from the others.
    """
    m, label, held = len(sets), label.copy(), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), held)
    shingles, ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    post, ends = owner[order], np.cumsum(np.bincount(ids, minlength=len(shingles)))
    spread = np.bincount(ids, minlength=len(shingles))
    own = np.split(ids, np.cumsum(held)[:-1]) if m else []
    largest = np.bincount(label, minlength=m).argmax() if m else -1
    for x in range(m):
        if label[x] == label[largest] or not held[x]:
            continue
        lists = [post[e - n : e] for e, n in zip(ends[own[x]].tolist(), spread[own[x]].tolist(), strict=True)]
        both = np.bincount(np.concatenate(lists), minlength=m)
        near = (100 + percent) * both >= percent * (sizes[x] + sizes)
        for other in np.unique(label[near]).tolist():
            if other != label[x]:
                label[label == other] = label[x]
    return label


def _viable(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, size, shingles, prefix, central) of the sets that can have a partner: at least ``percent`` hundredths of their shingles are in another such set."""
    total = nodes.agg(F.sum("size")).first()[0] or 0
    fragments = max(FRAGMENTS, total // FRAGMENT + 1)  # rows of a set and fragment follow the data, not how many partitions there are
    packed = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(lambda b: _packed(b, fragments, words)), "f int, nodes binary, counts binary, sizes binary, tokens binary")
    found = materialise(packed.repartition(fragments, "f").groupBy("f").applyInArrow(_shared, SHARED), "shared")
    for peel in range(PEELS):
        held, enough = F.sum(F.expr("octet_length(tokens) DIV 8")).alias("held"), 100 * F.col("held") >= percent * F.col("size")
        if peel == PEELS - 1:
            by_set = found.groupBy("node").agg(F.collect_list("tokens").alias("t"), F.collect_list("sets").alias("d"), F.first("size").alias("size"), held).where(enough)
            out = materialise(by_set.select("node", "size", _with_prefix(F.col("t"), F.col("d"), F.col("size"), percent).alias("p")).select("node", "size", "p.*"), "viable")
            discard(found)
            return out
        left = found.groupBy("node").agg(F.first("size").alias("size"), held).where(enough).select("node")
        kept = found.join(left, "node")
        one = kept.select("f", "node", F.expr("octet_length(tokens) DIV 8").alias("n"), "size", "tokens")
        again = materialise(one.groupBy("f").applyInArrow(_recount, SHARED), "shared")
        discard(found)
        found = again
    raise AssertionError


def _labelled(frame: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``frame`` with the label of each node."""
    return frame.withColumn("label", F.col("node")) if roots is None else frame.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _size_fits(percent: int) -> Column:
    return 100 * F.least("size", "leader_size") >= percent * F.greatest("size", "leader_size")


def _checked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among ``pairs`` (node, leader, size, leader_size), written before, by all shingles that both sets hold."""
    # a leader may meet a third of all sets: what it holds is broadcast, where it is met so often
    of = materialise(pairs.groupBy(F.col("leader")).agg(F.count("*").alias("n")).join(parts.select(F.col("node").alias("leader"), "part", F.col("tokens").alias("theirs")), "leader").select(F.struct("leader", "part").alias("at"), "theirs", "n"), "theirs")
    mine = pairs.join(parts, "node").withColumn("at", F.struct("leader", "part"))
    both = join_hot(mine, of, "at", "n").select("node", "leader", "size", "leader_size", _overlap(F.col("tokens"), F.col("theirs")).alias("both"))
    summed = both.groupBy("node", "leader", "size", "leader_size").agg(F.sum("both").alias("both"))
    near = summed.where((100 + percent) * F.col("both") >= percent * (F.col("size") + F.col("leader_size")))
    found = materialise(near.select(F.col("node").alias("a"), F.col("leader").alias("b")), "links")
    discard(of)
    return found


def similar_sets(docs: DataFrame, nodes: DataFrame, words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS, block: tuple[int, int] = BLOCK, candidates: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets that links connect with others. ``docs``: (text); ``nodes``: (node, size) of all distinct sets of shingles.

    ``candidates`` (node, leader, size, leader_size) are pairs that are checked first: the rounds compare only what their links leave apart.
    """
    spark = docs.sparkSession
    with bounded_batches(spark):
        sets = _viable(docs, nodes, words, percent)
        keys = sets.select("node", "size", "central", F.explode("prefix").alias("key"))
        many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        open_ = materialise(keys.join(many, "key").select("key", "node", "size", "central"), "buckets")
        parts = materialise(sets.select("node", F.posexplode(_parted(F.col("shingles"))).alias("part", "tokens")).where("octet_length(tokens) > 0"), "parts")
        links, roots = None, None
        if candidates is not None:
            pairs = materialise(candidates.where(_size_fits(percent)).distinct(), "candidates")
            links = _checked(pairs, parts, percent)
            roots = components(links)
            discard(pairs)
        for _ in range(rounds):
            leaders = open_.groupBy("key").agg(F.max(F.struct("central", "node", "size")).alias("leader"), F.count("*").alias("n"))
            led = materialise(leaders.select("key", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size"), "n"), "leaders")
            pairs = join_hot(open_, led, "key", "n").where((F.col("node") != F.col("leader")) & _size_fits(percent))
            pairs = pairs.select("node", "leader", "size", "leader_size").distinct()
            if roots is not None:
                pairs = _labelled(pairs, roots).join(roots.select(F.col("node").alias("leader"), F.col("root").alias("with")), "leader", "left").where(F.col("label") != F.coalesce("with", "leader")).drop("label", "with")
            pairs = materialise(pairs, "pairs")
            found, before = _checked(pairs, parts, percent), roots
            # what is linked already is a star about each root
            links = found if before is None else found.unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = components(links)
            discard(pairs, found, *([before] if before is not None else []))
            # a leader has met all of its bucket; a bucket whose others have one label is done
            rest = _labelled(join_hot(open_, led, "key", "n").where(F.col("node") != F.col("leader")).select("key", "node", "size", "central"), roots)
            several = rest.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
            left = materialise(rest.join(several, "key", "left_semi").drop("label"), "buckets")
            discard(open_, led)
            open_ = left
        last = _open_pairs(open_, sets, roots, percent, block)
        if last is not None:
            before = roots
            roots = components(last if before is None else last.unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            if before is not None:
                discard(before)
        elif roots is None:
            roots = components(sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
        discard(open_, sets, parts)
    return roots


def _open_pairs(open_: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, block: tuple[int, int]) -> DataFrame | None:
    """Links between the sets of ``open_`` (key, node) that share a key and have no label in common; None where there are none.

    What keys connect is a group. Small groups go to cells together; a larger one is cut into blocks, and each pair of blocks is a cell.
    """
    if not open_.limit(1).count():
        return None
    first = open_.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    edges = join_hot(open_.select("key", "node"), materialise(first, "firsts"), "key", "n")
    group = components(edges.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("root", "group")
    rows = _labelled(group, roots).join(sets.select("node", "size", "shingles"), "node")
    sums = materialise(rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "group-sums")
    cuts = F.greatest(F.ceil(F.col("n") / block[0]), F.ceil(F.col("total") / block[1])).cast("int")
    cells = 1 + (sums.agg(F.sum("total")).first()[0] or 0) // block[1]
    cut = join_hot(rows, sums.select("group", "n", cuts.alias("cuts")), "group", "n").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    small = cut.where("cuts = 1").withColumn("cell", F.struct(F.pmod(F.xxhash64("group"), F.lit(cells)).alias("at"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    large = cut.where("cuts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where("own <> other")
    large = large.withColumn("cell", F.struct(F.col("group").alias("at"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))).drop("other")
    dealt = small.unionByName(large).select("cell.*", "group", "node", "label", "size", "shingles")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby("group", sort=False):
            nodes, names = own["node"].to_numpy(np.int64), own["label"].to_numpy(np.int64)
            before = np.unique(names, return_index=True, return_inverse=True)
            start = before[1][before[2]]
            after = connected([np.frombuffer(x, np.uint64) for x in own["shingles"]], own["size"].to_numpy(np.int64), start, percent)
            moved = np.flatnonzero(after != start)
            out.append(pd.DataFrame({"a": nodes[moved], "b": nodes[after[moved]]}))
        return pd.concat(out)

    return dealt.groupBy("at", "i", "j").applyInPandas(compared, "a long, b long")


def similarity_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS, block: tuple[int, int] = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); component_id is the smallest doc_id reachable over links, its own without one.

    Two rows are linked if their sets of ``words``-word shingles share ``percent`` hundredths of their union or more, so texts with equal sets are. A text of fewer words is one
    shingle; a null or empty one, and one of white space, has none, is linked with nothing and has its own id. Null ids are no candidates for component_id, which is null where a component
    holds no other; repeated rows stay; other columns are ignored. Shingles are 64-bit hashes.
    """
    with bounded_batches(docs.sparkSession):
        rows = materialise(docs.select("doc_id", set_of(F.col("text"), words).alias("s")).select("doc_id", "s.node", "s.size"), "sets")
    nodes = materialise(rows.where("node IS NOT NULL").groupBy("node").agg(F.max("size").alias("size"), F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = similar_sets(docs, nodes, words, percent, rounds, block)
    rooted = materialise(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("sets")), "least")
    labels = materialise(join_hot(rooted, least, "root", "sets").select("node", "n", "component_id"), "labels")
    discard(nodes, rooted, least)
    own = F.col("doc_id").alias("component_id")
    found = join_hot(rows.where("node IS NOT NULL"), labels, "node", "n").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return found.unionByName(rows.where("node IS NULL").select("doc_id", F.col("size").alias("n_shingles"), own))


def op13_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))
