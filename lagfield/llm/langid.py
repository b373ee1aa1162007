"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

Each language's dictionary is raw content for zstandard: normalised texts of that language, end to end. A text is encoded in
pieces, each with every dictionary, so that a dictionary helps the end of a long text as much as its start; the sums are compared.
Each piece is encoded after a run of one letter: zstandard stores what it cannot shorten, and with the run it always can, so that a
few words differ in size as well.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_by_workers, table

#: The bounded sample of a language: whole texts, and characters that they may have before another is taken; they bound its dictionary.
SAMPLE_TEXTS, SAMPLE_CHARS = 200, 240_000
#: Bytes to a piece, the compression level, and the run before each piece.
PIECE, LEVEL, RUN = 4096, 6, b"q" * 64
#: Below this share of the second-best size a margin is narrow.
NARROW = 0.004
UNKNOWN = "und"

_TO_SPACE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
SCHEMA = "lang_pred string, score double, accepted boolean"


def normalise(text: str) -> bytes:
    """Lower case; what is no letter within ASCII becomes one space."""
    return b" ".join(text.lower().encode().translate(_TO_SPACE).split())


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """(language, dictionary) of each language, the most frequent first, from ``docs`` (doc_id, text, lang).

    Rows with a null text, lang or empty text teach nothing; equal rows count each. The sample is bounded in rows, which teach whole: of each language the first by a hash, until
    ``texts`` are taken or those taken have ``chars`` characters. A text that is longer than that by itself comes after all others, and teaches only where they are too few.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy("large", "h", "text")
    first = rows.withColumn("large", F.length("text") > chars).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= texts)
    before = F.coalesce(F.sum(F.length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample: dict[str, list[bytes]] = {}
    for r in first.withColumn("before", before).where(F.col("before") < chars).select("lang", "text", "nth").orderBy("lang", "nth").collect():
        sample.setdefault(r.lang, []).append(normalise(r.text))
    return [(k, b" ".join(sample[k])) for k in sorted(sample, key=lambda k: (-counts[k], k))]


@lru_cache(maxsize=1)
def _encoders(model: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    found = []
    for _, content in model:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        found.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False))
    return found


kept_by_workers(_encoders.cache_clear)


def classify(text: str | None, model: tuple[tuple[str, bytes], ...], narrow: float = NARROW) -> tuple[str, float, bool]:
    """Language, margin as a share of the second-best size, and whether the margin is wide enough. Ties go to the more frequent language."""
    if not text or not any(map(str.isalpha, text)) or not model:
        return UNKNOWN, 0.0, False
    data, encoders = normalise(text), _encoders(model)
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]
    sizes = [sum(len(e.compress(RUN + p)) for p in pieces) for e in encoders]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
    margin = (second - sizes[best]) / second
    return model[best][0], margin, margin >= narrow


def predict(text: Column, model: list[tuple[str, bytes]], narrow: float = NARROW) -> Column:
    """Struct (lang_pred, score, accepted): ``und``, 0 and false for a null text or one without a letter."""
    fixed = tuple(model)

    def each(texts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        for x in texts:
            if x not in known:
                known[x] = classify(x, fixed, narrow)
        return pd.DataFrame([known[x] for x in texts], columns=["lang_pred", "score", "accepted"])

    each.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(each, SCHEMA)(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """One in five documents by the CRC-32 of their id as text; those without an id too."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def op9_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")
