"""Phrases whose words occur together more often than apart.

All runs of 1 to max_n words become rows with their counts, which Spark adds up by language and phrase. A task counts what it reads before it
hands it on, and hands on many phrases of one bucket in a row, so that the shuffle moves little more than the phrases' letters. What is left
after the least count is a small table: the counts of a phrase's parts are joined to it, scores are whole-number divisions of decimals, and
phrases that mostly stand inside a longer one are removed by an anti-join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, materialise, table

MAX_N, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Words whose phrases a task counts before it hands them on.
HELD = 600_000
#: Lowers A-Z and makes a line feed of whatever ends a piece.
TABLE = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text to a bucket of phrases, and the least number of buckets of a language: small ones, so that partitions are even and their sums stay in memory.
BUCKET, BUCKETS = 1 << 26, 256
#: Salts of the ranking's first step.
SALTS = 64


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of each piece of ``text`` that holds one."""
    for piece in (text or b"").translate(TABLE).split(b"\n"):
        w = piece.split()  # bytes.split takes space and 9-13, and pieces hold no 10-13
        if w:
            yield w


def count_grams(words: list[bytes], pieces: list[int], max_n: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to ``max_n`` of ``words`` that stay within a piece, and how often each occurs; ``pieces`` says how many words each piece holds."""
    w, piece = pa.array(words, pa.large_binary()), np.repeat(np.arange(len(pieces)), pieces)
    grams, runs = [w], w
    for k in range(1, min(max_n, len(words))):
        runs = pc.binary_join_element_wise(runs[:-1], w[k:], pa.scalar(b" ", pa.large_binary()))  # a run of k words and the word after it
        grams.append(runs.filter(pa.array(piece[:-k] == piece[k:])))
    found = pc.value_counts(pa.chunked_array(grams))
    return found.field("values"), found.field("counts").to_numpy()


def gram_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to ``max_n`` words that occur ``least`` times or more in a language, and of the empty phrase, whose f is the number of words.

    A null lang is ``und``, a null text empty. Buckets are cut by a phrase's hash, so no language or word meets in one task.
    """
    buckets = max(BUCKETS, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET)  # follows the texts, not how many partitions there are
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("phrases", pa.string()), ("counts", pa.list_(pa.int64()))])

    def flush(lang: str, words: list[bytes], lengths: list[int]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"lang": [lang], "bucket": [-1], "phrases": [""], "counts": [[len(words)]]}, schema=schema)
        phrases, counts = count_grams(words, lengths, max_n)
        at = np.fromiter(map(zlib.crc32, phrases.to_pylist()), np.uint32, len(phrases)) % buckets
        order = np.argsort(at.astype(np.uint16) if buckets < 1 << 16 else at, kind="stable")
        own, starts = np.unique(at[order], return_index=True)
        offsets = np.append(starts, len(order))
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), phrases.take(pa.array(order))), pa.scalar(b"\n", pa.large_binary()))
        held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(counts[order], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int32()), lines.cast(pa.large_string()).cast(pa.string()), held], schema=schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, lengths = held.setdefault(lang, ([], []))
                for w in words_of(text):
                    words += w
                    lengths.append(len(w))
                    n += len(w)
                    if n > HELD:
                        for known, (own, parts) in held.items():
                            if own:
                                yield from flush(known, own, parts)
                        held, n = {}, 0
                        words, lengths = held.setdefault(lang, ([], []))
        for known, (own, parts) in held.items():
            if own:
                yield from flush(known, own, parts)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    packed = rows.mapInArrow(counted, "lang string, bucket int, phrases string, counts array<bigint>").repartition("lang", "bucket")
    each = packed.select("lang", "bucket", "counts", F.posexplode(F.split("phrases", "\n")).alias("at", "phrase")).select("lang", "bucket", "phrase", F.get("counts", F.col("at")).alias("f"))
    # rows of a language and bucket are in one partition already, so this moves nothing
    return each.groupBy("lang", "bucket", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")).drop("bucket")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_n`` words: (lang, rank, phrase, a, l, r, n, score), numbers long.

    ``docs``: (text, lang), other columns are ignored. A null or empty text has no words, a null lang is ``und``; repeated rows count again. A language without a
    phrase of ``least`` occurrences, and an empty table, give no rows. Ties of score go to the larger count, then to the lesser phrase by its bytes; of cuts
    with equal scores the first counts. Scores are exact for up to 10^16 occurrences of a phrase.
    """
    with bounded_batches(docs.sparkSession):
        counts = materialise(gram_counts(docs, max_n, least), "grams")
    key = lambda phrase: F.concat_ws("\n", "lang", phrase)  # noqa: E731  neither a lang of one line nor a phrase holds a line feed
    words = F.size(F.split("phrase", " "))
    found = counts.where((F.col("phrase") != "") & (words > 1)).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))

    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.expr("substring_index(phrase, ' ', k)").alias("part")), F.struct(F.lit("r").alias("side"), F.expr("substring_index(phrase, ' ', k - words)").alias("part")))
    parts = cut.withColumn("s", F.explode(sides)).select("lang", "phrase", "a", "k", "s.side", key("s.part").alias("key"))
    uses = parts.groupBy("key").agg(F.count("*").alias("uses"))
    known = materialise(counts.where("phrase <> ''").select(key("phrase").alias("key"), "f").join(uses, "key"), "parts")
    of = join_hot(parts, known, "key", "uses").groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    big = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    score = F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * ({big('a')} * {big('a')}) DIV ({big('l')} * {big('r')})")
    least_cut = of.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = least_cut.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    # a phrase inside a longer one is inside one of one more word, which occurs as often at least
    ends = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    longer = found.where("words > 2").select("lang", F.explode(ends).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    same = (F.col("x.lang") == F.col("y.lang")) & (F.col("x.phrase") == F.col("y.phrase")) & (100 * F.col("longer") >= inside * F.col("a"))
    kept = scored.alias("x").join(longer.alias("y"), same, "left_anti").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # SALTS * top rows of a language at most
    n = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", *(F.col(c).cast("long").alias(c) if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3)) AS sizes(m) WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
halves AS (SELECT *, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:m], ' ') AS right_part FROM cuts),
scored AS (
  SELECT h.lang, h.m, h.phrase, h.a, h.k, x.f AS l, y.f AS r, 1000000 * h.a * h.a // (x.f * y.f) AS score
  FROM halves h JOIN counts x ON x.lang = h.lang AND x.phrase = h.left_part JOIN counts y ON y.lang = h.lang AND y.phrase = h.right_part),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = s.lang AND c.m > s.m AND 100 * c.a >= 50 * s.a AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
