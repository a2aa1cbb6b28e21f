"""Operator 4: language identification with a byte convolutional network.

Method. Bytes are embedded; filters of several widths run over windows of fixed
length; rectified maxima over each window feed a softmax. The network is trained
in numpy on the driver from a bounded sample of labelled texts: LEARN_DOCS rows
per language at most in expectation, drawn by a hash of the id (of the text where
the id is null), and of each text all windows, or LEARN_WINDOWS of them at equal
distances over the whole text, cut and drawn in the tasks: the driver gets 4 MB per
language at most, however long texts are. Languages of less than LEAST_SHARE of the
labelled rows are not learnt, so there are 1 / LEAST_SHARE of them at most. Languages
weigh alike, and so do windows of a language. Prediction runs over all windows of the whole text, in batches, in Arrow
tasks; a text's language is that of the largest mean log-probability, its score
the mean probability of that language.

Defined cases: a null text or one without any letter is ``und`` with score 0; the
last window of a text is padded with spaces; without a labelled row everything is
``und``; with one language everything that has a letter is that one; repeated
rows are judged alike; only the text is an input of a prediction. A row with a null
id is held out by no rule (``held_out`` is null), so the registered query does not
learn from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serion.llm.storage import free_name
from serion.llm.words import LOWER, slices

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
LEARN_DOCS, LEARN_WINDOWS = 300, 64
LEAST_SHARE = 1 / 1000
#: A text's weight is its number of windows to this power (chosen by fitting on one half of the
#: training side and testing on the other: 6, 5 and 4 errors in 2500 texts for 0, 0.5 and 1).
TEXT_WEIGHT = 1.0
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 7
UNKNOWN = "und"
#: A filtering stage keeps a text from this score on.
LEAST_SCORE = 0.4


class Network(NamedTuple):
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (max width * EMBED) x all filters; rows beyond a filter's width stay 0
    bias: np.ndarray
    dense: np.ndarray  # all filters x languages
    dense_bias: np.ndarray


def _mask() -> np.ndarray:
    """Which rows of ``filters`` belong to a filter of each width."""
    out = np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for k, w in enumerate(WIDTHS):
        out[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    return out


def _columns(embedded: np.ndarray) -> np.ndarray:
    """(windows, positions, max width * EMBED): what each filter position sees."""
    n, length, size = embedded.shape
    wide = max(WIDTHS)
    step = embedded.strides
    return np.lib.stride_tricks.as_strided(embedded, (n, length - wide + 1, wide * size), (step[0], step[1], step[2]))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _pooled(net: Network, windows: np.ndarray) -> np.ndarray:
    columns = _columns(np.ascontiguousarray(net.embed[windows]))
    n, places, size = columns.shape
    out = columns.reshape(n * places, size) @ net.filters
    return np.maximum(out.reshape(n, places, -1).max(1) + net.bias, 0)


def probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """windows x languages; windows: rows of WINDOW bytes."""
    out = [_softmax(_pooled(net, windows[k : k + BATCH]) @ net.dense + net.dense_bias) for k in range(0, len(windows), BATCH)]
    return np.concatenate(out) if out else np.zeros((0, len(net.langs)))


def fit(windows: np.ndarray, labels: np.ndarray, texts: np.ndarray, langs: list[str]) -> Network:
    """Adam on the cross-entropy; a pooled maximum passes its gradient to the place it came from. texts: the text of each window."""
    rng = np.random.default_rng(SEED)
    n_filters, mask = FILTERS * len(WIDTHS), _mask()
    p = [
        rng.normal(0, 0.5, (256, EMBED)),
        rng.normal(0, 0.3, mask.shape) * mask,
        np.zeros(n_filters),
        rng.normal(0, 0.3, (n_filters, len(langs))),
        np.zeros(len(langs)),
    ]
    p = [x.astype(np.float32) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    # languages weigh alike; a text of n windows weighs as much as n ** TEXT_WEIGHT texts of one
    each = np.bincount(texts)[texts] ** (TEXT_WEIGHT - 1.0)
    of_lang = np.bincount(labels, each, len(langs))
    weight = each / of_lang[labels]
    weight = (weight / weight.mean()).astype(np.float32)
    places, t = np.arange(max(WIDTHS)), 0
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            x, y, t = windows[pick], labels[pick], t + 1
            embedded = np.ascontiguousarray(p[0][x])
            columns = _columns(embedded)
            b, n, size = columns.shape
            conv = (columns.reshape(b * n, size) @ p[1]).reshape(b, n, -1)
            top = conv.argmax(1)
            pooled = np.take_along_axis(conv, top[:, None], 1)[:, 0] + p[2]
            active = np.maximum(pooled, 0)
            d = _softmax(active @ p[3] + p[4])
            d[np.arange(b), y] -= 1
            d *= weight[pick][:, None] / b
            g3, g4 = active.T @ d, d.sum(0)
            back = (d @ p[3].T) * (pooled > 0)
            seen = columns[np.arange(b)[:, None], top]  # b x filters x size
            g1 = np.einsum("bf,bfs->sf", back, seen) * mask
            g0 = np.zeros_like(p[0])
            into = np.einsum("bf,sf->bfs", back, p[1]).reshape(b, n_filters, len(places), EMBED)
            np.add.at(g0, x[np.arange(b)[:, None, None], top[:, :, None] + places], into)
            for k, g in enumerate((g0, g1, back.sum(0), g3, g4)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= (RATE * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(langs, *p)


def to_windows(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts of a slice, and the first window of each text (and the end)."""
    size = np.diff(at)
    n = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(first[-1] * WINDOW, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - at[:-1], size)] = LOWER[data]
    return out.reshape(-1, WINDOW), first


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from the rows that have a language; None without any.

    The counts per language take one pass without the texts; the sample is drawn
    by a hash of the id, alike at every size.
    """
    named = labelled.where(F.col(lang_col).isNotNull())
    total = F.broadcast(named.agg(F.count("*").alias("_of")))  # one row
    often = named.groupBy(F.col(lang_col).alias("lang")).count().join(total).where(F.col("count") >= F.col("_of") * LEAST_SHARE)
    counts = {r[0]: r[1] for r in often.select("lang", "count").collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, LEARN_DOCS / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(1 << 24)) < share * (1 << 24)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, at, data in slices(b.column(1)):
                windows, first = to_windows(at, data)
                some = [windows[i : i + n] if n <= LEARN_WINDOWS else windows[i + np.arange(LEARN_WINDOWS) * n // LEARN_WINDOWS] for i, n in zip(first[:-1], np.diff(first), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([x.tobytes() for x in some], pa.binary())], ["lang", "windows"])

    rows = named.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0) & drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = sorted((r.lang, bytes(r.windows)) for r in rows.mapInArrow(cut, "lang string, windows binary").collect())  # LEARN_DOCS rows per language
    if not got:
        return None
    langs = sorted({lang for lang, _ in got})
    size = [len(x) // WINDOW for _, x in got]
    windows, texts = np.frombuffer(b"".join(x for _, x in got), np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(got)), size)
    return fit(windows, np.array([langs.index(lang) for lang, _ in got])[texts], texts, langs)


def predict_column(network: Network | None, text: Column, spark) -> Column:
    """struct<lang_pred, score> of a text column."""
    if network is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(network)  # a few thousand weights

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        net = shared.value
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for a, z, at, data in slices(texts):
            windows, first = to_windows(at, data)
            p = probabilities(net, windows)
            logs = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(np.log(p + 1e-6), 0)])
            sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
            n = np.maximum(np.diff(first), 1)
            best[a:z] = (logs[first[1:]] - logs[first[:-1]]).argmax(1)
            score[a:z] = ((sums[first[1:]] - sums[first[:-1]]) / n[:, None])[np.arange(z - a), best[a:z]]
        names = pa.array(net.langs, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(np.clip(score, 0, 1))], ["lang_pred", "score"])

    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    got = predict.asNondeterministic()(text)
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(letter, got).otherwise(none)


def with_language(df: DataFrame, network: Network | None, *, text_col: str = "text", out: str = "language") -> DataFrame:
    """df and a struct column ``out`` of lang_pred and score."""
    return df.withColumn(out, predict_column(network, F.col(text_col), df.sparkSession))


def held_out(id_col: Column) -> Column:
    """Rows that learning never sees."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1


def keep_recognised(docs: DataFrame, *, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of docs whose language is told with a score of ``least`` or more; learnt from docs' own labels."""
    network = learn(docs.where(~held_out(F.col("doc_id"))))
    name = free_name(docs, "language")
    got = with_language(docs, network, out=name)
    return got.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= least)).drop(name)
