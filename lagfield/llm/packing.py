"""Token packing by vector best-fit: every sequence has a capacity of tokens, of documents and of attention cost.

Texts become token pieces of one sequence at most. Whole-sequence pieces stand alone; the rest are dealt evenly to groups, and in
each the pieces, longest first, go to the open sequence that they fit best under every capacity.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import kept_by_workers, lean, materialise, table

TOKENIZER = "word_bpe_49k.json"
TOKENS, END = 2048, 0
#: Documents and attention cost (sum of squared lengths) that a sequence may hold; the defaults never bind before the tokens do.
DOCUMENTS, ATTENTION = TOKENS, TOKENS * TOKENS
#: Pieces packed together by one task.
GROUP = 4096
#: Words and parts that a worker remembers, those that a task remembers by itself, and the longest of them.
REMEMBERED, BY_TASK, LONGEST = 1_200_000, 200_000, 40

#: The split pattern of this vocabulary file, fixed by it.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters for which Unicode tables of any version agree; words with others take the library's own way.
_LATIN = regex.compile(r"[\x21-\x7e\xa1-ɏ]*")
#: Separators to Python that are none to the library, and its special tokens: texts that hold them take its own way.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|startoftext|>", "<|endoftext|>")


@lru_cache
def _settings(path: str) -> str:
    """What a tokenizer file says besides its vocabulary."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    held["model"] = {k: v for k, v in held["model"].items() if k not in ("vocab", "merges")}
    return json.dumps(held, sort_keys=True)


def _byte_letters() -> list[str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Words:
    """Token ids of texts, remembered by white-space word: ids do not depend on what stands across white space.

    That holds for a file that normalises, splits and decodes as the default one does; texts go whole to the library for any other.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.by_word = _settings(path) == _settings(public_tokenizers.path(TOKENIZER))
        self.letters = dict(enumerate(_byte_letters()))
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.whole.get_vocab().values()) + 1)]
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            of = self.id_bytes
            ids = b"".join([of[t.id] for t in self.model.tokenize(letters)])
            if len(part) <= LONGEST:
                self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = self._part(word.lower())
        elif word[-1] in ",." and word.isascii() and word[:-1].isalpha():
            ids = self._part(word[:-1].lower()) + self._part(word[-1])
        elif _LATIN.fullmatch(word):
            ids = b"".join(map(self._part, _PARTS.findall(unicodedata.normalize("NFC", word).lower())))
        else:
            ids = self._library(word)
        if len(self.words) + len(self.parts) >= self.remembered:
            self.words.clear()
            self.parts.clear()
        if len(word) <= LONGEST:
            self.words[word] = ids
        return ids

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_word or any(x in text for x in _ODD):
            return self._library(text)
        known = self.words
        out = [known[w] if w in known else self._word(w) for w in text.split()]
        return b"".join(out)


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


kept_by_workers(_words.cache_clear)


def pieces(docs: DataFrame, tokens: int = TOKENS, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), by_task: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` with piece, start, length, ids_crc32: the ids of each whole text and an end id, cut every ``tokens`` ids. A null text is an empty one, which has the end id alone; repeated rows and null ids stay. ``path`` names another tokenizer file. ``by_task`` remembers fewer words, and none after a task, which takes more time and leaves workers less to hold."""
    name = path or TOKENIZER

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        file = name if "/" in name else public_tokenizers.path(name)
        words = Words(file, BY_TASK) if by_task else _words(file)
        for texts in batches:
            out = []
            for text in texts:
                ids = words.ids(text or "") + END.to_bytes(4, "little")
                out.append((len(ids) // 4, [zlib.crc32(ids[i : i + 4 * tokens]) for i in range(0, len(ids), 4 * tokens)]))
            yield pd.DataFrame(out, columns=["n", "crc"])

    made_by = lean(cut) if by_task else cut
    made_by.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = docs.select(*keep, F.pandas_udf(made_by, "n long, crc array<long>")(F.col("text")).alias("t"))
    each = made.select(*keep, F.col("t.n").alias("n"), F.posexplode("t.crc").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * tokens
    return each.select(*keep, "piece", start.alias("start"), F.least(F.lit(tokens), F.col("n") - start).alias("length"), "ids_crc32")


def best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order. A piece demands (length, 1, length^2) and must fit all three capacities.

    ``rule`` "norm" takes the bin whose weighted residual vector is the shortest afterwards; "dot" the bin whose residual points
    most along the demand. Both count in shares of the capacities; ties go to the oldest bin. A piece that fits no empty bin raises.
    """
    cap, w = np.array(capacities, float), np.array(weights)
    n, k, live = len(lengths), 0, np.zeros(0, np.int64)
    residual, used = np.zeros((n, 3)), np.zeros(n, np.int64)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = np.minimum.accumulate(lengths[::-1])[::-1] if n else lengths
    for i, length in enumerate(lengths.tolist()):
        demand = np.array([length, 1, length * length], float)
        if (demand > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        at = -1
        if len(live):
            left = residual[live]
            fits = np.flatnonzero((left >= demand).all(1))
            if len(fits):
                share = (left[fits] - (demand if rule == "norm" else 0)) / cap
                score = (w * share * share).sum(1) if rule == "norm" else -(w * share * (demand / cap)).sum(1) / np.sqrt((w * share * share).sum(1))
                at = int(live[fits[score.argmin()]])
        if at < 0:
            at, residual[k], k = k, cap, k + 1
            live = np.append(live, at)
        residual[at] -= demand
        bins[i], offsets[i] = at, used[at]
        used[at] += length
        if i + 1 < n and (residual[at] < [least[i + 1], 1, least[i + 1] ** 2]).any():
            live = live[live != at]
    return bins, offsets


def pack(cut: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, group: int = GROUP, rule: str = "norm") -> DataFrame:
    """``cut`` (with length) with sequence_id and offset for every row: sequences hold at most ``tokens`` tokens, ``documents`` pieces and ``attention`` squared lengths.

    Groups hold about ``group`` pieces whatever the input's size, dealt by row and not by key, so equal rows spread evenly. A row's other columns stay, of any name but sequence_id and offset. A piece of ``tokens`` tokens stands alone
    and must fit the other capacities too; a piece that fits no empty sequence raises. An empty table gives an empty result.
    """
    row, of = "row_of_pack", "group_of_pack"
    while {row, of} & set(cut.columns):
        row, of = f"{row}_", f"{of}_"
    rows = materialise(cut.withColumn(row, F.monotonically_increasing_id()), "pieces")
    names = cut.columns
    loose = rows.where(F.col("length") < tokens)
    n_groups = max(1, -(-loose.count() // group))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", row], ascending=[False, True], kind="stable")
        bins, offsets = best_fit(g["length"].to_numpy(np.int64), (tokens, documents, attention), rule=rule)
        return g.assign(sequence_id=g[of].to_numpy(np.int64) * (1 << 24) + bins, offset=offsets)[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    dealt = loose.withColumn(of, F.pmod(F.xxhash64(row), F.lit(n_groups))).groupBy(of).applyInPandas(packed, schema)
    if documents < 1 or attention < tokens * tokens and rows.where(F.col("length") >= tokens).limit(1).count():
        raise ValueError(f"a piece of {tokens} tokens exceeds a capacity")
    full = rows.where(F.col("length") >= tokens).select(*names, (-1 - F.col(row)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.unionByName(full)


def op10_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
