"""Operator 13: removal of repeated word sequences, found by recompression.

A window is ``width`` consecutive words of one document. Every word is removed that
lies in a window whose words also start in a document of a smaller id.

Method. A text is recompressed in rounds: each round names the maximal runs of one
symbol, then parts the symbols by a bit of their names into left and right ones and
names each pair of a left and a right neighbour. Names are made of what they stand
for, so all tasks name alike without asking each other, and equal substrings get equal
symbols except near their borders. Three rounds of Spark follow, in each of which the
blocks of texts send keys, a shuffle by key finds which are shared, and the blocks get
their answers:

1. High symbols (REVEAL_ROUNDS rounds, some 30 words): each pair of neighbours sends the
   128-bit digest of its words. If a document of smaller id has them too, all windows
   inside are settled. Whole copies and long repeats end here.
2. Anchors: a low symbol (ANCHOR_ROUNDS rounds) whose making depends on no word outside
   a window is found in every other occurrence of that window, too. Of the low symbols
   inside each window not settled, the one whose next ANCHOR_WORDS words hash lowest is
   its anchor; anchors send that 64-bit hash. Windows of an anchor that one block alone
   has, and there one document, are unique. (Windows that hold no such symbol, as in
   runs of one word, take their anchor from all their words.)
3. Windows that have a shared anchor and are not settled send the 128-bit digest of
   their words; the answer is the smallest id that has it.

A window settled in round 1 need not speak later: the smallest document that has it is
never settled and does. Each block sends a key once, with the smallest id that has it,
so a key that a third of all documents share is one row per block. Only keys travel:
blocks are a table bucketed by the part of a task that wrote it, answers are joined to it there,
and no text is shuffled.

Defined cases: a null or empty text has no words, removes and keeps nothing (its kept
text is empty); texts of fewer words than a window have no windows; documents of equal
id do not take windows from each other, nor does one document from itself; a null id
comes after all others; repeated rows are judged one by one; an empty table gives an
empty result. Ids are integers. A text is never cut, so a very long one is one block.
Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from serion.llm.storage import Scratch
from serion.llm.words import SPACE, Spans, Words, mix, slices, span_hashes, words

WINDOW = 13
#: Bytes of text in a block, unless a single text is longer.
BLOCK_BYTES = 1 << 19
#: Bytes of text that a task writes under one number; they are read by one task.
PART_BYTES = 8 << 20
REVEAL_ROUNDS, ANCHOR_ROUNDS, ANCHOR_WORDS = 12, 1, 6
_LAST = (1 << 63) - 1
_U = np.uint64


def _borders(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a symbol is the first, the last of its text."""
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    last = np.ones(len(row), bool)
    last[:-1] = first[1:]
    return first, last


class Symbols:
    """The symbols of all texts of a block after some rounds.

    ``start``: the first word of each. ``low`` and ``high``: the words on which the
    symbol's making depends, borders of the text counting as words outside.
    """

    def __init__(self, w: Words, depends: bool = False):
        self.name, self.row, self.start = w.hash, w.row(), np.arange(len(w.hash))
        self.low, self.high = (self.start, self.start + 1) if depends else (None, None)

    def _beside(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """low of the left neighbour, high of the right one."""
        low, high = np.empty_like(self.low), np.empty_like(self.high)
        low[1:], high[:-1] = self.low[:-1], self.high[1:]
        low[first], high[last] = self.start[first] - 1, _LAST
        return low, high

    def runs(self) -> None:
        """Names the maximal runs of one symbol."""
        first, last = _borders(self.row)
        opens = first.copy()
        opens[1:] |= self.name[1:] != self.name[:-1]
        at = np.flatnonzero(opens)
        n = np.diff(at, append=len(opens))
        if self.low is not None:  # that a run ends is seen from the neighbours
            low, high = self._beside(first, last)
            self.low, self.high = np.minimum(low, self.low)[at], np.maximum(high, self.high)[at + n - 1]
        name = self.name[at]
        long = n > 1
        name[long] = mix(name[long] ^ mix(n[long].astype(_U)))
        self.name, self.row, self.start = name, self.row[at], self.start[at]

    def pairs(self, salt: int) -> None:
        """Names each pair of a left and a right symbol."""
        first, last = _borders(self.row)
        right = (mix(self.name ^ _U(salt)) & _U(1)).astype(bool)
        fused = np.zeros(len(right), bool)
        fused[:-1] = ~right[:-1] & right[1:] & ~last[:-1]
        second = np.zeros(len(right), bool)
        second[1:] = fused[:-1]
        at = np.flatnonzero(~second)
        pair = at[fused[at]]
        name = self.name.copy()
        name[pair] = mix(name[pair] ^ mix(self.name[pair + 1] + _U(salt)))
        if self.low is not None:
            # a right symbol alone: its left neighbour is no left one; a left symbol alone likewise; a pair's own words tell it
            low, high = self._beside(first, last)
            self.low = np.where(right & ~second, np.minimum(low, self.low), self.low)
            self.high = np.where(~right & ~fused, np.maximum(high, self.high), self.high)
            self.low[pair] = np.minimum(self.low[pair], self.low[pair + 1])
            self.high[pair] = np.maximum(self.high[pair], self.high[pair + 1])
            self.low, self.high = self.low[at], self.high[at]
        self.name, self.row, self.start = name[at], self.row[at], self.start[at]

    def compress(self, rounds: int) -> Symbols:
        for k in range(rounds):
            self.runs()
            self.pairs(k + 1)
        return self


def revealing(w: Words, rounds: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, text) of each pair of neighbouring high symbols, or of one that is its whole text."""
    s = Symbols(w).compress(rounds)
    first, last = _borders(s.row)
    end = np.where(last, w.bounds[1:][s.row], np.append(s.start[1:], len(w.hash)))
    until = np.where(last, end, np.append(end[1:], len(w.hash)))
    use = (~last | first) & (until - s.start >= width)
    return s.start[use], until[use], s.row[use]


def anchors(w: Words, free: np.ndarray, hashes: np.ndarray, rounds: int, size: int, width: int) -> np.ndarray:
    """The anchor of each window of ``free`` (first words): where the lowest of ``hashes`` stands among its candidates."""
    s = Symbols(w, depends=True).compress(rounds)
    # candidates in order of their first word: the least end that any candidate from there on has
    low, high = s.low, np.maximum(s.high, s.low + size)
    sure = np.flatnonzero((low >= w.bounds[:-1][s.row]) & (high - low <= width)) if len(low) else np.zeros(0, np.int64)
    low, high = low[sure], high[sure]
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    best = np.full(len(free), -1, np.int64)
    for at, until in ((low, high), (None, None)):
        todo = np.flatnonzero(best < 0)
        p = free[todo]
        k = np.searchsorted(at, p) if at is not None else p
        found = np.full(len(p), -1, np.int64)
        least = np.full(len(p), np.iinfo(np.uint64).max, np.uint64)
        for step in count() if at is not None else range(width - size + 1):
            i = k + step
            if at is not None:
                live = np.flatnonzero(i < len(at))
                live = live[at[i[live]] <= p[live] + width - size]
                if not len(live):
                    break
                live = live[until[i[live]] <= p[live] + width]
                place = at[i[live]]
            else:
                live, place = np.arange(len(p)), i
            lower = hashes[place] <= least[live]
            better = lower & ((hashes[place] < least[live]) | (found[live] < 0))
            found[live[better]], least[live[better]] = place[better], hashes[place[better]]
        best[todo] = found
    return best


class Block:
    """One row of the block table, with its answers so far."""

    def __init__(self, b: pa.RecordBatch, k: int):
        get = lambda name: b.column(b.schema.get_field_index(name))[k]
        self.ids = get("ids").values
        self.number = _number(get("part").as_py(), get("seq").as_py())
        at = np.frombuffer(get("at").as_buffer(), np.int64)
        self.w = words(at, np.frombuffer(get("text").as_buffer(), np.uint8), SPACE, lower=False)
        self.doc = _numbers(self.ids)
        self.row = self.w.row()
        self.spans = np.frombuffer(get("spans").as_buffer(), _SPAN)

    def windows(self, width: int) -> np.ndarray:
        """Whether a window starts at each word."""
        return np.arange(len(self.row)) + width <= self.w.bounds[1:][self.row]

    def digests(self) -> tuple[Spans, Spans]:
        second = span_hashes(self.w.data, self.w.start, self.w.end, 1)
        return Spans(self.w.hash), Spans(second, 1)

    def settled(self, answer: np.ndarray, width: int) -> np.ndarray:
        """Windows inside spans that a smaller document has; an answer names the first span of its key in the block."""
        n = len(self.row)
        depth = np.zeros(n + 1, np.int64)
        if len(answer):
            at, least = answer["at"], answer["least"]
            group, _ = _groups(self.spans["k1"], self.spans["k2"])
            smallest = np.full(group.max() + 1, _LAST, np.int64)
            smallest[group[at]] = least
            hit = self.spans[smallest[group] < self.doc[self.spans["row"]]]
            np.add.at(depth, hit["start"], 1)
            np.add.at(depth, hit["end"] - width + 1, -1)
        return np.cumsum(depth)[:n] > 0


_SPAN = np.dtype([("start", np.int32), ("end", np.int32), ("row", np.int32), ("k1", np.uint64), ("k2", np.uint64)])
_ANSWER = np.dtype([("at", np.int64), ("least", np.int64)])


def _number(part: int, seq: int) -> int:
    return (part << 16) | seq


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _groups(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each 128-bit key, first place of each group)."""
    order = np.lexsort((k2, k1))
    opens = np.ones(len(order), bool)
    opens[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    first = np.full(int(opens.sum()), len(order), np.int64)
    np.minimum.at(first, group, np.arange(len(order)))
    return group, first


def _keys(number: int, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Each key of a block once: smallest document, whether larger ones have it too, the block and where its first place is."""
    group, first = _groups(k1, k2)
    least, most = np.full(len(first), _LAST), np.full(len(first), -_LAST)
    np.minimum.at(least, group, doc)
    np.maximum.at(most, group, doc)
    n = len(first)
    return pa.RecordBatch.from_arrays([pa.array(k1[first].view(np.int64)), pa.array(k2[first].view(np.int64)), pa.array(least), pa.array(np.full(n, number)), pa.array(np.where(most > least, ~place[first], place[first]))], ["k1", "k2", "least", "block", "at"])


_KEYS = "k1 long, k2 long, least long, block long, at long"


def write_blocks(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The block table: ids, texts and their revealing spans, bucketed by the writing task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId() << 24, 0, 0
        for b in batches:
            for a, z, at, data in slices(b.column(1), BLOCK_BYTES):
                if seq and size + len(data) > PART_BYTES or seq >> 16:
                    part, seq, size = part + 1, 0, 0
                w = words(at, data, SPACE, lower=False)
                start, end, row = revealing(w, REVEAL_ROUNDS, width)
                spans = np.zeros(len(start), _SPAN)
                spans["start"], spans["end"], spans["row"] = start, end, row
                spans["k1"], spans["k2"] = Spans(w.hash).of(start, end), Spans(span_hashes(data, w.start, w.end, 1), 1).of(start, end)
                values = [[part], [seq], [b.column(0).slice(a, z - a).to_pylist()], [np.ascontiguousarray(at).tobytes()], [data.tobytes()], [spans.tobytes()]]
                kinds = [pa.int64(), pa.int64(), pa.list_(b.column(0).type), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "seq", "ids", "at", "text", "spans"])
                seq, size = seq + 1, size + len(data)

    kind = docs.schema[id_col].dataType.simpleString()
    blocks = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"part long, seq long, ids array<{kind}>, at binary, text binary, spans binary")
    return scratch.save_bucketed("blocks", blocks, "part")


def _answers(keys: DataFrame, scratch: Scratch, name: str, needed: Column) -> DataFrame:
    """One row per part: (block, place, least id) of the keys that ``needed`` keeps, given all rows of their key."""
    w = Window.partitionBy("k1", "k2") if "k2" in keys.columns else Window.partitionBy("k1")
    found = keys.withColumn("smallest", F.min("least").over(w)) if "least" in keys.columns else keys.withColumn("n", F.count("*").over(w))
    found = found.where(needed).select(F.shiftright("block", 16).alias("of"), F.struct((F.col("block").bitwiseAND((1 << 16) - 1)).alias("seq"), F.when(F.col("at") < 0, F.bitwise_not("at")).otherwise(F.col("at")).alias("at"), F.col("smallest") if "least" in keys.columns else F.lit(0).cast("long").alias("smallest")).alias("a"))
    return scratch.save(name, found.groupBy("of").agg(F.collect_list("a").alias("answers")))


def _with(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The blocks with their own answers; the answers come to the bucket that holds the block."""
    told = answers.select("of", F.col("answers").alias(name)).hint("shuffle_hash")
    own = F.filter(F.col(name), lambda x: x["seq"] == F.col("seq"))
    return blocks.join(told, blocks["part"] == told["of"], "left").drop("of").withColumn(name, own)


def _answer(b: pa.RecordBatch, k: int, name: str) -> np.ndarray:
    got = b.column(b.schema.get_field_index(name))[k]
    out = np.zeros(len(got) if got.is_valid else 0, _ANSWER)
    if len(out):
        out["at"], out["least"] = got.values.field("at").to_numpy(), got.values.field("smallest").to_numpy()
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept: the words left, joined by one space) of every document."""
    if width < ANCHOR_WORDS:
        raise ValueError(f"windows have {ANCHOR_WORDS} words at least")
    scratch = Scratch(docs.sparkSession, "repeats")
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = write_blocks(docs, scratch, id_col=id_col, text_col=text_col, width=width)

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                get = lambda name: b.column(b.schema.get_field_index(name))[k]  # noqa: B023, E731
                spans = np.frombuffer(get("spans").as_buffer(), _SPAN)
                if len(spans):
                    yield _keys(_number(get("part").as_py(), get("seq").as_py()), spans["k1"], spans["k2"], _numbers(get("ids").values)[spans["row"]], np.arange(len(spans)))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = Block(b, k)
                free = np.flatnonzero(x.windows(width) & ~x.settled(_answer(b, k, "settled"), width))
                n = len(x.row)
                grams = Spans(x.w.hash).of(np.arange(n), np.minimum(np.arange(n) + ANCHOR_WORDS, n))
                place = np.unique(anchors(x.w, free, grams, ANCHOR_ROUNDS, ANCHOR_WORDS, width))
                key, group = np.unique(grams[place], return_inverse=True)
                first, doc = np.full(len(key), n, np.int64), x.doc[x.row[place]]
                np.minimum.at(first, group, place)
                more = np.zeros(len(key), bool)
                more[group[doc != doc[np.searchsorted(place, first)][group]]] = True
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), x.number)), pa.array(np.where(more, ~first, first))], ["k1", "block", "at"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = Block(b, k)
                shared = _answer(b, k, "shared")["at"]
                if not len(shared):
                    continue
                n = len(x.row)
                grams = Spans(x.w.hash).of(np.arange(n), np.minimum(np.arange(n) + ANCHOR_WORDS, n))
                met = np.append(0, np.cumsum(np.isin(grams, grams[shared])))
                free = x.windows(width) & ~x.settled(_answer(b, k, "settled"), width)
                p = np.flatnonzero(free)
                p = p[met[p + width - ANCHOR_WORDS + 1] > met[p]]
                if len(p):
                    d1, d2 = x.digests()
                    yield _keys(x.number, d1.of(p, p + width), d2.of(p, p + width), x.doc[x.row[p]], p)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = Block(b, k)
                starts = x.settled(_answer(b, k, "settled"), width)
                met = _answer(b, k, "met")
                if len(met):
                    d1, d2 = x.digests()
                    p = np.flatnonzero(x.windows(width))
                    k1, at = d1.of(p, p + width), met["at"]
                    p = p[np.isin(k1, d1.of(at, at + width))]
                    group, _ = _groups(d1.of(p, p + width), d2.of(p, p + width))
                    smallest = np.full(len(p), _LAST, np.int64)
                    smallest[group[np.searchsorted(p, at)]] = met["least"]
                    starts[p[smallest[group] < x.doc[x.row[p]]]] = True
                n = len(x.row)
                depth = np.zeros(n + width, np.int64)
                p = np.flatnonzero(starts)
                depth[p] += 1
                depth[p + width] -= 1
                gone = np.cumsum(depth)[:n] > 0
                yield _kept(x, gone)

    revealed = blocks.select("part", "seq", "ids", "spans").mapInArrow(reveal, _KEYS)
    settled = _answers(revealed, scratch, "settled", (F.col("smallest") < F.col("least")) | (F.col("at") < 0))
    # an anchor's smallest id is not asked for: two blocks or two documents share it
    anchored = _with(blocks, settled, "settled").mapInArrow(anchor, "k1 long, block long, at long")
    shared = _answers(anchored, scratch, "shared", (F.col("n") > 1) | (F.col("at") < 0))
    verified = _with(_with(blocks, settled, "settled"), shared, "shared").mapInArrow(verify, _KEYS)
    met = _answers(verified, scratch, "met", (F.col("smallest") < F.col("least")) | (F.col("at") < 0))
    scratch.drop("shared")
    out = _with(_with(blocks, settled, "settled"), met, "met").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def _kept(x: Block, gone: np.ndarray) -> pa.RecordBatch:
    """A block's documents with the words that are left, joined by one space."""
    rows = len(x.ids)
    n_words, n_gone = np.diff(x.w.bounds), np.bincount(x.row[gone], minlength=rows)
    start, size, row = x.w.start[~gone], (x.w.end - x.w.start)[~gone], x.row[~gone]
    _, last = _borders(row)
    wide = size + ~last  # a space behind each word but a text's last
    to = np.cumsum(wide) - wide
    byte = np.repeat(start - to, wide) + np.arange(int(wide.sum()))
    text = np.append(x.w.data, np.uint8(0x20))[np.minimum(byte, len(x.w.data))]
    text[(to + size)[~last]] = 0x20
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, weights=wide, minlength=rows)).astype(np.int64)])
    kept = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)])
    return pa.RecordBatch.from_arrays([x.ids, pa.array(n_words.astype(np.int64)), pa.array(n_gone.astype(np.int64)), kept.cast(pa.string())], ["id", "n_words", "n_removed", "kept"])
