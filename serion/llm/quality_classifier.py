"""Operator 7: quality classifier by ordinal cumulative-link regression.

Method. Texts become sets of hashed features: their distinct words, with and without marks, and the
shapes of their words (case, digits, marks; runs of one kind count once) with the
share of words that have them, in powers of two. One weight vector s = w . x is
shared by all grades; ordered thresholds turn it into P(grade >= k) =
logistic(s - t_k). The expected grade is the sum of these tails, a tail is the
probability that selection asks for.

Grades come from the labels: 0 toxic, 1 poor, 2 good. The model is fitted on the
driver by proximal gradient steps with an L1 penalty, from a bounded sample of
LEARN_DOCS labelled texts in expectation, drawn by a hash of the id; texts of the
sample are read whole, and all texts are scored whole.

Defined cases: a null or empty text has no feature and gets the model's base
probabilities; without labels every text gets the probabilities of an untrained
model (tails of one half) and is kept; null labels are not learnt from; of
several labels of one id the lowest grade counts; a null id has no label; repeated
rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serion.llm.words import NOT_ALNUM, SLICE_BYTES, SPACE, _byte_codes, _power, mix, slices, words

BITS = 18
GRADES = 3
LEARN_DOCS = 8000
STEPS, RATE, PENALTY = 150, 0.3, 2e-4
#: A feature of fewer sample texts is not learnt.
LEAST_TEXTS = 4
#: Least probability of the best grade for a text to be selected.
LEAST_TAIL = 0.5
SEED = 3

_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48


class Ordinal(NamedTuple):
    weights: np.ndarray  # 2**BITS
    thresholds: np.ndarray  # GRADES - 1, ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _shapes(w, data: np.ndarray) -> np.ndarray:
    """A hash per word of its kinds of characters, runs counted once."""
    kind = _KIND[data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[w.start] = True
    rank = np.cumsum(fresh)
    rank -= np.repeat(rank[w.start] - 1, np.diff(np.append(w.start, len(kind)))) if len(w.start) and w.start[0] == 0 else _rank_base(rank, w.start)
    value = np.where(fresh, _byte_codes()[kind] * _power(0xD6E8FEB86659FD93, max(len(kind), SLICE_BYTES))[np.minimum(rank, len(kind))], np.uint64(0))
    total = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[w.end] - total[w.start])


def _rank_base(rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    edges = np.concatenate([[0], start]) if len(start) else np.zeros(1, np.int64)
    return np.repeat(np.concatenate([[0], rank[start] - 1]) if len(start) else np.zeros(1, rank.dtype), np.diff(np.append(edges, len(rank))))


def features(at: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text of a slice."""
    w = words(at, data, SPACE)
    plain = words(at, data, NOT_ALNUM)  # marks do not part a word from its feature
    shape = _shapes(w, data)
    down = np.uint64(64 - BITS)
    out = []
    for a, z, c, e in zip(*[x.tolist() for x in (w.bounds[:-1], w.bounds[1:], plain.bounds[:-1], plain.bounds[1:])], strict=True):
        n = z - a
        if not n:
            out.append(np.zeros(0, np.int64))
            continue
        token, bare = np.unique(w.hash[a:z]), np.unique(plain.hash[c:e])
        kinds, times = np.unique(shape[a:z], return_counts=True)
        level = np.floor(np.log2(n / times)).astype(np.uint64)  # 0: more than half of the words
        varied = np.uint64(int(8 * len(token) / n))
        parts = [token, bare, mix(kinds + (level + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)), mix(np.array([varied + np.uint64(77)], np.uint64))]
        out.append(np.unique((np.concatenate(parts) >> down).astype(np.int64)))
    return out


def loss_and_gradient(w: np.ndarray, t: np.ndarray, at: np.ndarray, text: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood and its gradient in weights and thresholds; text ``text[k]`` has feature ``at[k]``."""
    row, n = np.arange(len(grades)), len(grades)
    s = np.bincount(text, w[at], n)
    tail = np.ones((n, GRADES + 1))
    tail[:, 1:GRADES] = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -50, 50)))
    tail[:, GRADES] = 0
    p = (tail[row, grades] - tail[row, grades + 1]).clip(1e-9)
    slope = tail * (1 - tail)
    low, high = slope[row, grades] / p, slope[row, grades + 1] / p
    g = np.bincount(at, (-(low - high) / n)[text], len(w))
    g_t = np.array([(low[grades == k].sum() - high[grades == k - 1].sum()) / n for k in range(1, GRADES)])
    return float(-np.log(p).mean()), g, g_t


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Ordinal:
    """Minimises the mean negative log-likelihood plus PENALTY times the L1 norm."""
    size = np.array([len(x) for x in rows])
    at, text = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    often = np.bincount(at, minlength=1 << BITS) >= LEAST_TEXTS
    at, text = at[often[at]], text[often[at]]
    w, seen = np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = np.array([(grades >= k).mean() for k in range(1, GRADES)]).clip(1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    t_seen = np.zeros(GRADES - 1)
    for _ in range(STEPS):
        _, g, g_t = loss_and_gradient(w, t, at, text, grades)
        seen += g * g
        t_seen += g_t * g_t
        rate = RATE / (np.sqrt(seen) + 1e-3)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        t = np.sort(t - RATE / (np.sqrt(t_seen) + 1e-3) * g_t)
    return Ordinal(w.astype(np.float32), t)


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null if a label is missing."""
    return F.when(quality.isNull() | toxic.isNull(), F.lit(None)).when(toxic != 0, F.lit(0)).when(quality == 0, F.lit(1)).otherwise(F.lit(2))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """The model of a labelled sample of docs; labels: (id_col, grade)."""
    graded = labels.where(F.col("grade").isNotNull()).groupBy(id_col).agg(F.min("grade").alias("_serion_grade"))
    total = graded.count()
    drawn = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col).cast("string")), F.lit(1 << 24)) < int(min(1.0, LEARN_DOCS / max(total, 1)) * (1 << 24))
    sample = F.broadcast(graded.where(drawn))  # LEARN_DOCS rows in expectation

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, at, data in slices(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), b.column(1).slice(first, end - first), pa.array(features(at, data), pa.list_(pa.int64()))], ["id", "grade", "at"])

    rows = docs.join(sample, id_col).select(F.col(id_col).cast("string").alias("id"), F.col("_serion_grade").cast("int").alias("grade"), F.col(text_col).alias("text"))
    got = rows.mapInArrow(task, "id string, grade int, at array<long>").toArrow()
    order = np.argsort(np.array(got.column(0).to_pylist(), dtype=object), kind="stable") if got.num_rows else []
    if not len(order):
        return Ordinal(np.zeros(1 << BITS, np.float32), np.zeros(GRADES - 1))
    lists, grades = got.column(2).combine_chunks(), got.column(1).to_numpy()
    return fit([lists[int(k)].values.to_numpy() for k in order], grades[order].astype(np.int64))


def with_grade(docs: DataFrame, model: Ordinal, *, text_col: str = "text", out: str = "grade") -> DataFrame:
    """docs and a struct column ``out``: expected_grade, tails (array) and selected."""
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))

    @F.arrow_udf("struct<expected_grade:double,tails:array<double>>")
    def score(texts: pa.Array) -> pa.Array:
        used, values, thresholds = shared.value
        weights = np.zeros(1 << BITS)
        weights[used] = values
        s = np.zeros(len(texts))
        for first, _, at, data in slices(texts):
            for k, x in enumerate(features(at, data)):
                s[first + k] = weights[x].sum()
        tails = Ordinal(weights, thresholds).tails(s)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(tails.ravel()), GRADES - 1).cast(pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([pa.array(tails.sum(1)), lists], ["expected_grade", "tails"])

    got = docs.withColumn(out, score(F.col(text_col)))
    return got.withColumn(out, F.col(out).withField("selected", F.element_at(F.col(out)["tails"], -1) >= LEAST_TAIL))
