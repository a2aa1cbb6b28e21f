"""Operator 10: language-model scoring with a hidden Markov model.

Method. Latent states emit classes of tokens; within a class a token has its
smoothed share of the class's training counts. Baum-Welch: every partition runs
the forward-backward recursion over its training texts and returns expected
counts, Spark sums them, the driver turns the sums (a table of fixed size) into
new parameters. Scoring runs the scaled forward recursion over each whole text.

Each of the OWN most frequent tokens is a class of its own, and so is the end of a
text; all other tokens are in the class of a part of their 64-bit hash. Long texts are
worked off in segments, all segments of many texts at a time: a segment's recursion
is first run from every state at once, and the segments are chained. That gives the
exact likelihood of the whole text, and in training the exact forward and backward
messages at every cut, so expected counts are those of whole texts, too.

Counts of all training tokens are kept as a table (token, count). Texts meet it in
two ways: a fixed number of the most frequent tokens is broadcast; all other
tokens of a text are joined to the table. So no count is left out, frequent tokens
make no hot key, and what is broadcast does not grow.

Defined cases: a null text is empty and has the end token only; without training
texts all counts are 0; repeated rows are scored one by one; texts of any length
are scored whole; a row with a null id is not held out, so it is learnt from.
Scores are log10 probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serion.llm.storage import Scratch
from serion.llm.words import SPACE, crc_mod, slices, words

STATES = 6
CLASS_BITS = 12
#: Most frequent tokens that are classes of their own.
OWN = 1 << 12
CLASSES = (1 << CLASS_BITS) + OWN + 1  # parts of the hash, own tokens, the end
END_CLASS = CLASSES - 1
#: The end's token number.
END = 0
ROUNDS = 6
#: Tokens of a segment.
SEGMENT = 512
#: Tokens that are broadcast with their counts (16 bytes each).
FREQUENT = 1 << 16
#: Tokens that one step of a task works on, unless one text is longer.
STEP_TOKENS = 1 << 20
#: Distinct tokens that a task gathers before it emits their counts.
GATHER = 1 << 21
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 5, 1
SEED = 11


class Model(NamedTuple):
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def held_out(id_col: Column) -> Column:
    """Rows that learning never sees; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(HELD_OUT_MODULUS)) == HELD_OUT_REMAINDER, F.lit(False))


def _train_rows(ids: pa.Array) -> np.ndarray:
    named = np.array([i is not None for i in ids.to_pylist()], bool)
    return ~named | (crc_mod(ids.to_pylist(), HELD_OUT_MODULUS) != HELD_OUT_REMAINDER)


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, count) over all training texts; each task counts its own tokens first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            token, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return token, np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)

        def batch(token: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], ["token", "count"])

        for b in batches:
            train = _train_rows(b.column(0))
            texts = 0
            for first, end, at, data in slices(b.column(1)):
                w = words(at, data, SPACE)
                texts += int(train[first:end].sum())
                keep = np.repeat(train[first:end], np.diff(w.bounds))
                held.append(np.unique(w.hash[keep], return_counts=True))
                if sum(len(t) for t, _ in held) > GATHER:
                    held = [merged()]
                    if len(held[0][0]) > GATHER // 2:
                        yield batch(*held[0])
                        held = []
            if texts:
                yield batch(np.array([END], np.uint64), np.array([texts]))
        if held:
            yield batch(*merged())

    got = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(task, "token long, count long")
    return got.groupBy("token").agg(F.sum("count").alias("count"))


class Counts(NamedTuple):
    """What scoring needs of the counts besides the table itself; of fixed size."""

    total: int
    distinct: int
    class_norm: np.ndarray  # per class: its smoothed total
    class_share: np.ndarray
    frequent: np.ndarray
    frequent_count: np.ndarray
    frequent_class: np.ndarray


def summarise(table: DataFrame) -> Counts:
    """Totals, class totals and the most frequent tokens of a count table."""
    total, distinct = table.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    kind = F.when(F.col("token") == END, F.lit(END_CLASS)).otherwise(F.shiftrightunsigned("token", 64 - CLASS_BITS))
    sums, sizes = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, c, n in table.groupBy(kind.alias("k")).agg(F.sum("count"), F.count("*")).collect():
        sums[k], sizes[k] = c, n
    top = table.where(F.col("token") != END).orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    token, count = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy().astype(np.int64)
    own = np.arange(len(token)) < OWN  # leave the class of their hash for one of their own
    part = (token[own] >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
    np.subtract.at(sums, part, count[own])
    np.subtract.at(sizes, part, 1)
    kinds = (token >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
    kinds[own] = (1 << CLASS_BITS) + np.arange(own.sum())
    sums[kinds[own]] = count[own]
    # an own class holds one token, the end's too: all others keep room for one that training has not seen
    room = np.where(np.arange(CLASSES) < 1 << CLASS_BITS, sizes + 1, 1)
    order = np.argsort(token)
    return Counts(int(total), int(distinct), sums + 0.5 * room, (sums + 0.5) / (sums + 0.5).sum(), token[order], count[order], kinds[order].astype(np.uint16))


_ENCODED = "key long, id {id}, train boolean, n_tokens long, known long, log_count double, seen binary, rare array<long>, rare_n array<int>"


def encode(docs: DataFrame, counts: Counts, id_col: str, text_col: str) -> DataFrame:
    """Per row: the classes of its tokens, the share of frequent tokens in its count terms, and its other tokens.

    log_count sums log10(count + 0.5), with count 0 for the other tokens. key
    numbers the rows of each partition, so it is the same when a task is repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = shared.value
        end_count = int(round(float(c.class_norm[END_CLASS]) - 0.5))
        log_frequent = np.log10(c.frequent_count + 0.5)
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            train = _train_rows(b.column(1))
            for first, end, at, data in slices(b.column(2)):
                w = words(at, data, SPACE)
                n, row = np.diff(w.bounds), w.row()
                place = np.searchsorted(c.frequent, w.hash)
                place[place == len(c.frequent)] = 0
                common = c.frequent[place] == w.hash if len(c.frequent) else np.zeros(len(w.hash), bool)
                known = np.bincount(row[common], minlength=len(n)) + (end_count > 0)
                logs = np.bincount(row, np.where(common, log_frequent[place] if len(c.frequent) else 0.0, np.log10(0.5)), len(n)) + np.log10(end_count + 0.5)
                seen = (w.hash >> np.uint64(64 - CLASS_BITS)).astype(np.uint16)
                seen[common] = c.frequent_class[place[common]]
                seen = np.insert(seen, w.bounds[1:], END_CLASS).astype(np.uint16)
                ends = w.bounds[1:] + np.arange(1, len(n) + 1)
                starts = ends - n - 1
                rare, rare_row = w.hash[~common], np.searchsorted(np.flatnonzero(~common), w.bounds)
                each = [np.unique(rare[a:z], return_counts=True) for a, z in zip(rare_row[:-1], rare_row[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + np.arange(len(n))),
                        b.column(0).slice(first, end - first),
                        pa.array(train[first:end]),
                        pa.array(n + 1, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(logs),
                        pa.array([seen[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([t.view(np.int64) for t, _ in each], pa.list_(pa.int64())),
                        pa.array([k for _, k in each], pa.list_(pa.int32())),
                    ],
                    ["key", "id", "train", "n_tokens", "known", "log_count", "seen", "rare", "rare_n"],
                )
                key += len(n)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("s"), F.col(text_col).alias("text")).mapInArrow(task, _ENCODED.format(id=kind))


def first_model(counts: Counts) -> Model:
    """Sticky states whose emissions are the corpus's, each a little off in its own way."""
    rng = np.random.default_rng(SEED)
    emit = counts.class_share[:, None] * np.exp(rng.normal(0, 0.3, (CLASSES, STATES)))
    move = np.full((STATES, STATES), 0.05 / max(STATES - 1, 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def _segments(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments of some token rows: tokens (one behind the other), starts and lengths, in text order."""
    size = np.array([len(x) for x in texts])
    n = -(-size // SEGMENT)
    base = np.repeat(np.cumsum(size) - size, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base + k * SEGMENT
    return np.concatenate(texts).astype(np.int64), start, np.minimum(SEGMENT, np.repeat(size, n) - k * SEGMENT)


def _steps(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows with at most STEP_TOKENS tokens, one row at least, and their tokens."""
    for b in batches:
        seen = [np.frombuffer(x.as_py(), np.uint16) for x in b.column(column)]
        first = total = 0
        for k, x in enumerate(seen):
            if total and total + len(x) > STEP_TOKENS:
                yield b.slice(first, k - first), seen[first:k]
                first, total = k, 0
            total += len(x)
        if seen:
            yield b.slice(first), seen[first:]


def _transfers(model: Model, token: np.ndarray, start: np.ndarray, length: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per segment: probabilities of its tokens and its last state from every state before it, and their common log10 factor.

    lead: a text's first segment; its first token is drawn from the start, whatever the state.
    """
    order = np.argsort(-length, kind="stable")
    ranked, sizes, lead = start[order], length[order], lead[order]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")  # segments longer than t
    out = np.empty((len(start), STATES, STATES))
    scale = np.zeros(len(start))
    now = np.empty((len(start), STATES, STATES))
    for t, k in enumerate(active):
        if k < len(now):
            out[k : len(now)] = now[k:]
            now = now[:k]
        emit = model.emit[token[ranked[:k] + t]]
        if t == 0:
            now = np.where(lead[:k, None, None], model.start[None, None, :], model.move[None, :, :]) * emit[:, None, :]
        else:
            now = (now.reshape(k * STATES, STATES) @ model.move).reshape(k, STATES, STATES) * emit[:, None, :]
        if t % 16 == 15:
            top = now.max((1, 2))
            now /= top[:, None, None]
            scale[:k] += np.log10(top)
    out[: len(now)] = now
    by_text = np.empty(len(start), np.int64)
    by_text[order] = np.arange(len(start))
    return out[by_text], scale[by_text]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(1, keepdims=True)


def _messages(model: Model, token: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per segment of texts of ``n`` segments each: the forward message that enters it, the backward one that meets its end."""
    enters, meets = np.ones((len(start), STATES)), np.ones((len(start), STATES))
    long = np.flatnonzero(np.repeat(n, n) > 1)
    if not len(long):
        return enters, meets
    heads, n = np.cumsum(n[n > 1]) - n[n > 1], n[n > 1]
    lead = np.zeros(len(long), bool)
    lead[heads] = True
    passed, _ = _transfers(model, token, start[long], length[long], lead)
    state = _normal(passed[heads][:, 0, :])
    for k in range(1, int(n.max())):
        live = np.flatnonzero(n > k)
        at = heads[live] + k
        enters[long[at]] = state[live]
        state[live] = _normal(np.einsum("ns,nst->nt", state[live], passed[at]))
    for k in range(int(n.max()) - 1, 0, -1):
        at = heads[n > k] + k
        meets[long[at - 1]] = _normal(np.einsum("nst,nt->ns", passed[at], meets[long[at]]))
    return enters, meets


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of whole texts by the scaled forward-backward recursion."""
    token, start, length = _segments(texts)
    n = np.array([-(-len(x) // SEGMENT) for x in texts])
    enters, meets = _messages(model, token, start, length, n)
    lead = np.zeros(len(start), bool)
    lead[np.cumsum(n) - n] = True
    order = np.argsort(-length, kind="stable")
    start, length, lead, enters, meets = start[order], length[order], lead[order], enters[order], meets[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(1, steps + 1), "right")  # segments longer than t
    forward = []
    now = _normal(np.where(lead[:, None], model.start, enters @ model.move) * model.emit[token[start]])
    forward.append(now)
    for t in range(1, steps):
        now = _normal((now[: active[t]] @ model.move) * model.emit[token[start[: active[t]] + t]])
        forward.append(now)
    moves, emits = np.zeros_like(model.move), np.zeros_like(model.emit)
    back = meets[: active[-1]]
    seen, share = [], []
    for t in range(steps - 1, -1, -1):
        if len(back) < active[t]:
            back = np.concatenate([back, meets[len(back) : active[t]]])
        gamma = _normal(forward[t] * back)
        now = token[start[: active[t]] + t]
        seen.append(now)
        share.append(gamma)
        # the move to this token, at a segment's first one out of the segment before
        ahead, before = back * model.emit[now], forward[t - 1][: active[t]] if t else enters
        if not t:
            ahead, before = ahead[~lead], before[~lead]
        pair = (before @ model.move * ahead).sum(1, keepdims=True)
        moves += (before / pair).T @ ahead
        if t:
            back = _normal(ahead @ model.move.T)
    seen, share = np.concatenate(seen), np.concatenate(share)
    for s in range(STATES):
        emits[:, s] = np.bincount(seen, share[:, s], CLASSES)
    return gamma[lead].sum(0), moves * model.move, emits


def train(encoded: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training rows; each round one pass and one small sum."""
    model = first_model(counts)
    spark = encoded.sparkSession
    texts = encoded.where("train").select("seen")
    size = STATES + STATES * STATES + CLASSES * STATES
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for _, rows in _steps(batches, 0):
                total += np.concatenate([x.ravel() for x in expected_counts(shared.value, rows)])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])

        # rounded sums do not depend on the order of the parts
        got = texts.mapInArrow(task, "at int, n double").groupBy("at").agg(F.sum(F.round(F.col("n") * 1e6).cast("decimal(38,0)")).cast("double").alias("n")).toArrow()
        sums = np.zeros(size)
        sums[got.column(0).to_numpy()] = got.column(1).to_numpy() / 1e6
        start, move, emit = np.split(sums, [STATES, STATES + STATES * STATES])
        start, move = start + 1, move.reshape(STATES, STATES) + 1
        emit = emit.reshape(CLASSES, STATES) + CLASSES * counts.class_share[:, None] * 0.1
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the exact probability of each row of classes."""
    token, start, length = _segments(texts)
    n = np.array([-(-len(x) // SEGMENT) for x in texts])
    heads = np.cumsum(n) - n
    lead = np.zeros(len(start), bool)
    lead[heads] = True
    passed, scale = _transfers(model, token, start, length, lead)
    state, score = passed[heads][:, 0, :], scale[heads]
    for k in range(1, int(n.max())):
        live = np.flatnonzero(n > k)
        at = heads[live] + k
        top = state[live].sum(1, keepdims=True)
        score[live] += np.log10(top[:, 0]) + scale[at]
        state[live] = np.einsum("ns,nst->nt", state[live] / top, passed[at])
    return score + np.log10(state.sum(1))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    scratch = Scratch(docs.sparkSession, "lm")
    table = scratch.save("counts", token_counts(docs, id_col, text_col))
    counts = summarise(table)
    encoded = scratch.save("encoded", encode(docs, counts, id_col, text_col))
    model = train(encoded, counts, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model, np.log10(counts.class_norm)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_norm = shared.value
        for b, rows in _steps(batches, 6):
            # the classes' probability, over each class's smoothed total
            hidden = log_likelihoods(model, rows) - np.array([log_norm[x].sum() for x in rows])
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(hidden)], ["key", "id", "train", "n_tokens", "known", "log_count", "hidden"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = encoded.select("key", "id", "train", "n_tokens", "known", "log_count", "seen").mapInArrow(task, f"key long, id {kind}, train boolean, n_tokens long, known long, log_count double, hidden double")
    rare = encoded.select("key", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("key", F.col("x.rare").alias("token"), F.col("x.rare_n").alias("times"))
    met = rare.join(table, "token").groupBy("key").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * (F.log10(F.col("count") + 0.5) - F.log10(F.lit(0.5)))).alias("more_log"))
    both = scored.join(met, "key", "left")
    logs = F.col("log_count") + F.coalesce("more_log", F.lit(0.0))
    norm = float(np.log10(counts.total + 0.5 * (counts.distinct + 1)))
    out = both.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * norm).alias("base_score"),
        (logs + F.col("hidden")).alias("score"),
    )
    out = scratch.save("scores", out)
    scratch.drop_others("scores")
    return out
