"""Operator 12: product codes of vectors by exact integer k-means with an exponion search.

Method. Components become integers, vectors are cut into equal parts, and each part
position has a codebook. The vectors are kept as packed blocks together with each
part's entry of the round before. A round is one pass over the blocks: the search for
the nearest entry starts at the previous one, a, and scans a's list of neighbour
entries in order of distance. An entry that is as near as a or nearer lies within
twice the part's distance to a (triangle inequality), so with squares the scan may
stop where ``between(a, j) > 4 * own``. All of it is integer arithmetic, so the radius
is exact and ties go to the lower index. Parts of one entry are searched together, the
far ones first: each neighbour is compared with the head of the list only. A block
also holds its sums and counts per entry; they are added up by task, then by Spark,
and the driver gets one row per component of the codebooks (entries x dimensions).

Nothing is shuffled but those sums and the errors per label. The label table, whose
size Spark knows since it is written first, is broadcast by Spark below its threshold
and joined by shuffle beyond it.

Defined cases: vectors that are null or hold null or non-finite components are
dropped; the kept vector of the smallest id gives the dimension (it must be a multiple
of the parts, else ValueError). Vectors of another length, and those with a component
so large that a squared distance may not fit in 64 bits (over 32,768 for 64
dimensions), are returned with null code and error and take no part in the learning.
Null ids come last; rows of equal ids stand in the order of their vectors; repeated
rows are coded one by one; fewer vectors than entries make smaller codebooks; an empty
table gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serion.llm.storage import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one block.
BLOCK_ROWS = 16_384


class Codes(NamedTuple):
    rows: DataFrame  # id, label, code, error, label_error of every kept vector
    books: np.ndarray  # parts x entries x components

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def kept(vector: Column) -> Column:
    """Whether a vector has finite components only."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row of x, searched from its entry ``start``."""
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    code, best = start.copy(), ((x - book[start]) ** 2).sum(1)
    for a in range(len(book)):
        rows = np.flatnonzero(start == a)
        rows = rows[np.argsort(-best[rows], kind="stable")]  # the farthest first: a neighbour matters to a head of the list
        reach = -4 * best[rows]
        for j in np.argsort(between[a], kind="stable"):
            if j == a:
                continue
            head = rows[: np.searchsorted(reach, -between[a, j], "right")]
            if not len(head):
                break
            d = ((x[head] - book[j]) ** 2).sum(1)
            better = (d < best[head]) | ((d == best[head]) & (j < code[head]))
            code[head[better]], best[head[better]] = j, d[better]
    return code, best


def _assign(values: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all parts and the squared distance summed over them."""
    parts = [nearest(values[:, p, :], books[p], codes[:, p]) for p in range(len(books))]
    return np.stack([c for c, _ in parts], 1), np.sum([d for _, d in parts], 0, dtype=np.int64)


def _totals(values: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Per part and entry: how many rows, then their sum."""
    parts, entries, wide = books.shape
    out = np.zeros((parts, entries, 1 + wide), np.int64)
    for p in range(parts):
        order = np.argsort(codes[:, p], kind="stable")
        n = np.bincount(codes[:, p], minlength=entries)
        out[p, :, 0] = n
        there = np.flatnonzero(n)
        if wide and len(there):
            out[p, there, 1:] = np.add.reduceat(values[order, p, :], (np.cumsum(n) - n)[there])
    return out


def _column(b: pa.RecordBatch, name: str, k: int):
    return b.column(b.schema.get_field_index(name))[k]


def _block(b: pa.RecordBatch, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(_column(b, "codes", k).as_buffer(), np.uint8).reshape(-1, parts)
    values = np.frombuffer(_column(b, "parts", k).as_buffer(), np.int32)
    return values.reshape(len(codes), parts, values.size // max(codes.size, 1)).astype(np.int64), codes


def _packed(vectors: DataFrame, parts: int, id_kind: str, label_kind: str) -> DataFrame:
    """Blocks of ids, labels, integer components and codes (at first entry 0 everywhere)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                values = np.floor(SCALE * flat).astype(np.int32)
                row = [[b.column(0).to_pylist()], [b.column(1).to_pylist()], [values.tobytes()], [bytes(b.num_rows * parts)]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.list_(b.column(0).type)), pa.array(row[1], pa.list_(b.column(1).type)), pa.array(row[2], pa.binary()), pa.array(row[3], pa.binary())], ["ids", "labels", "parts", "codes"])

    return vectors.mapInArrow(task, f"ids array<{id_kind}>, labels array<{label_kind}>, parts binary, codes binary")


def _searched(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """The blocks with new codes and what the next codebooks are made of."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                values, codes = _block(b, k, len(books))
                codes, _ = _assign(values, codes, books)
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), pa.array([codes.tobytes()], pa.binary()), pa.array([_totals(values, codes, books).tobytes()], pa.binary())], ["ids", "labels", "parts", "codes", "totals"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields[:4])
    return blocks.select("ids", "labels", "parts", "codes").mapInArrow(task, f"{shape}, totals binary")


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: each entry its parts' mean, rounded down; an unused entry stays."""
    parts, entries, wide = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * entries * (1 + wide), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                total += np.frombuffer(_column(b, "totals", k).as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "n"])

    got = blocks.select("totals").mapInArrow(task, "at long, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    total = np.zeros(parts * entries * (1 + wide), object)
    for at, n in got:
        total[at] = int(n)
    total = total.reshape(parts, entries, 1 + wide)
    out = books.copy()
    for p in range(parts):
        for e in range(entries):
            if total[p, e, 0]:
                out[p, e] = [int(s // total[p, e, 0]) for s in total[p, e, 1:]]
    return out


def _coded(blocks: DataFrame, books: np.ndarray, id_kind: str, label_kind: str) -> DataFrame:
    """(id, label, code, error) of every vector of the blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * len(books)
        for b in batches:
            for k in range(b.num_rows):
                codes, error = _assign(*_block(b, k, len(books)), books)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([_column(b, "ids", k).values, _column(b, "labels", k).values, pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return blocks.select("ids", "labels", "parts", "codes").mapInArrow(task, f"id {id_kind}, label {label_kind}, code string, error long")


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors and the codebooks they were learnt with."""
    if not 0 < entries <= 256:
        raise ValueError("an index has 8 bits")
    scratch = Scratch(vectors.sparkSession, "codes")
    kinds = [vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(kept(F.col("v")))
    by = [F.asc_nulls_last("id"), "v"]
    head = rows.orderBy(*by).limit(1).collect()
    dimension = len(head[0].v) if head else 0
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components have no {parts} equal parts")
    most = math.isqrt((1 << 62) // max(dimension, 1)) / 2 / SCALE
    able = (F.size("v") == dimension) & F.forall("v", lambda x: F.abs(x) < most)
    first = rows.where(able).orderBy(*by).limit(entries).select("v").collect()
    books = np.floor(SCALE * np.array([r.v for r in first], np.float64)).astype(np.int64).reshape(len(first), parts, dimension // parts).transpose(1, 0, 2)

    other = rows.where(~able).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        coded = other
    else:
        blocks = scratch.save("round0", _packed(rows.where(able).select("id", "label", "v"), parts, *kinds))
        for k in range(rounds):
            blocks = scratch.save(f"round{k + 1}", _searched(blocks, books))
            scratch.drop(f"round{k}")
            books = _moved(blocks, books)
        coded = scratch.save("coded", _coded(blocks, books, *kinds).unionByName(other))
        scratch.drop(f"round{rounds}")
    sums = scratch.save("sums", coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    coded = coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error")
    return Codes(coded, books)
