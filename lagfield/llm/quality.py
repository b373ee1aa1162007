"""Quality by ordinal cumulative-link regression: one score for a text, ordered thresholds for the grades.

P(grade > k) = sigmoid(f(x) - t_k) with t_0 < t_1 < ...; f is linear in hashed features that all grades share: the words of a
text, 1 + log count each over the root of their length as a vector, and the shares of word shapes (punctuation, capitals, digits, repeats).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by_workers, table

#: Hash dimension; the bounded sample in graded texts, which teach whole; passes over it, step and penalty.
DIM, SAMPLE, PASSES, STEP, RIDGE = 1 << 18, 8000, 200, 0.5, 1e-4
#: A feature counts from this share of the graded rows, and this many of them.
SUPPORT, SUPPORT_ROWS = 1 / 400, 3
#: Weights of the shape shares and of the words, and the tail probability from which a text is selected.
SHAPES, WORDS, SELECT = 4.0, 0.3, 0.5
#: Words whose features a worker remembers.
REMEMBERED = 100_000

SCHEMA = "expected_grade double, tail_probability double, selected boolean"
_LETTERS = re.compile(r"[\W\d_]+")
_known: dict[str, tuple[int, int]] = {}
kept_by_workers(_known.clear)


def _word(word: str) -> tuple[int, int]:
    """Hashed feature of a word's letters and of its shape."""
    found = _known.get(word)
    if found is None:
        core = _LETTERS.sub("", word)
        rest = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "", word))[:8]
        case = "U" if len(core) > 1 and core.isupper() else "l" if core else "-"
        found = zlib.crc32(("w" + core.lower()).encode()) % DIM, zlib.crc32(f"s{case}{rest}".encode()) % DIM
        if len(_known) >= REMEMBERED:
            _known.clear()
        _known[word] = found
    return found


_REPEAT, _FEW = zlib.crc32(b"repeat") % DIM, zlib.crc32(b"few") % DIM


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; none for a text without words."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    n, tf, shapes = len(words), Counter(), Counter()
    for w, c in Counter(words).items():
        a, s = _word(w)
        tf[a] += c
        shapes[s] += c
    repeats = sum(map(str.__eq__, words, words[1:]))
    values = [1 + log(c) for c in tf.values()]
    norm = sqrt(sqrt(sum(v * v for v in values))) / WORDS
    index = [*tf, *shapes, _REPEAT, _FEW]
    value = [*(v / norm for v in values), *(SHAPES * sqrt(c / n) for c in shapes.values()), SHAPES * repeats / n, 1 / n]
    return np.array(index, np.int32), np.array(value, np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        index, value = features(text)
        return _sigmoid(float(self.weights[index] @ value) - self.thresholds)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(index: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, n_grades: int, passes: int = PASSES) -> Model:
    """Adagrad on the mean log-loss of the graded rows; thresholds stay ordered as a first one plus positive gaps.

    Features are (``row``, ``index``, ``value``) triples. Grades weigh alike in all, however many rows each has.
    """
    n, k = len(grade), n_grades - 1
    held = np.bincount(index, minlength=DIM)[index] >= max(SUPPORT_ROWS, SUPPORT * n)
    index, value, row = index[held], value[held], row[held]
    w, gaps, first = np.zeros(DIM), np.zeros(max(k - 1, 0)), 0.0
    share = np.bincount(grade, minlength=n_grades)
    each = 1 / np.sqrt(np.maximum(share, 1))[grade]
    each /= each.sum()
    gw, gg, gf = np.full(DIM, 1e-8), np.full(len(gaps), 1e-8), 1e-8
    for _ in range(passes):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])[:k]
        z = np.bincount(row, w[index] * value, n)
        above = np.column_stack([np.ones(n), _sigmoid(z[:, None] - t[None, :]), np.zeros(n)])  # P(grade >= g), g = 0 ... n_grades
        p = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-9)
        slope = above * (1 - above)
        up, down = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        dz = -(up - down) / p * each
        dt = np.zeros(k)
        np.add.at(dt, grade[grade > 0] - 1, (up / p * each)[grade > 0])
        np.add.at(dt, grade[grade < k], -(down / p * each)[grade < k])
        g = np.bincount(index, dz[row] * value, DIM) + RIDGE * w
        gw += g * g
        w -= STEP * g / np.sqrt(gw)
        d_first, d_gaps = dt.sum(), np.array([dt[j + 1 :].sum() for j in range(len(gaps))]) * np.exp(gaps)
        gf += d_first**2
        gg += d_gaps**2
        first -= STEP * d_first / np.sqrt(gf) / 4
        gaps -= STEP * d_gaps / np.sqrt(gg) / 4
    return Model(w.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])[:k])


def learn(docs: DataFrame, graded: DataFrame, n_grades: int, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample: the texts in ``docs`` (doc_id, text) of the first ``sample`` ids, by a hash, that ``graded`` (doc_id, grade) grades 0 to n_grades - 1.

    Null ids, texts and grades teach nothing. An id teaches once: the higher of two grades counts, and of several texts the
    least. Whole texts teach; only their features leave the tasks, no more of a text than it has different words and shapes.
    Without graded rows all texts score alike, and thresholds put all in the middle.
    """
    teach = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    ids = teach.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it can be broadcast
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def featured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(x) for x in texts], columns=["i", "v"])

    featured.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    got = rows.select("grade", F.pandas_udf(featured, "i array<int>, v array<float>")("text").alias("f")).select("grade", "f.i", "f.v").toArrow()
    if not got.num_rows:
        return Model(np.zeros(DIM, np.float32), np.linspace(-1, 1, n_grades - 1))
    lists = got.column("i").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    index, value = lists.flatten().to_numpy(), got.column("v").combine_chunks().flatten().to_numpy()
    return fit(index, value.astype(float), np.repeat(np.arange(len(lengths)), lengths), got.column("grade").to_numpy().astype(int), n_grades)


def grade(text: Column, model: Model, select: float = SELECT) -> Column:
    """Struct (expected_grade, tail_probability, selected): the tail is that of the highest grade. A null text and one without words score as no features do."""

    def each(texts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        for x in texts:
            if x not in known:
                tails = model.tails(x)
                known[x] = float(tails.sum()), float(tails[-1]), bool(tails[-1] >= select)
        return pd.DataFrame([known[x] for x in texts], columns=["expected_grade", "tail_probability", "selected"])

    each.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(each, SCHEMA)(text)


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings of ``labels`` (doc_id, quality, toxic): toxic 0, poor 1, good 2."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, grades_of(table(spark, sf_dir, "labels")), 3)
    return docs.select("doc_id", grade(F.col("text"), model).alias("q")).select("doc_id", "q.expected_grade", "q.tail_probability", "q.selected")
