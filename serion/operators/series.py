"""Operators on ordered numeric series.

A series is a table, or the rows of one key in a table, with one numeric order
column. No operator sorts a whole long series in one task: a series of more than
CHUNK_ROWS rows is cut at quantiles of the order column into chunks, each chunk is
one window partition, and what crosses a border (one row, one count or one value
per chunk, or the last rows before it) is carried over. Shorter series are one
window partition each. Cutting takes one pass over the order column; with keys, one
that counts rows per key and a second one over the long series only, where there are
any. The borders, MAX_CHUNKS at most, are searched by halving; beyond MAX_CHUNKS
chunks grow, and their windows spill.

An order value that more than a chunk's rows share gets chunks of its own, for which
the rows are first dealt by ranges of (key, order, the further order columns, a hash
of the row) and stored: only rows that are equal in all columns stay together.

Rows with a null order value are dropped. Rows of equal order value stand in the
order of the columns ``then``, then of the values asked for (nulls first); what
they still share, they share in any order. Null keys are a series of their own.
Names that begin with ``_serion_`` are taken and refused in the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serion.sources.storage import Scratch

#: Rows that a chunk should hold.
CHUNK_ROWS = 1_000_000
MAX_CHUNKS = 4096
#: Rows of short series that one task of a frame operator takes together.
GROUP_ROWS = 100_000
#: Rows that a chunk of a frame operator should hold, in Python and with as many guests (CHUNK_ROWS, if that is less).
FRAME_ROWS = 200_000

Names = tuple[str, ...]


class _Cut(NamedTuple):
    rows: DataFrame  # with _serion_chunk, and _serion_long: whether a row's series is cut
    chunk: Callable[[Column], Column]  # number of the chunk that an order value falls into
    many: bool
    total: int
    top: DataFrame | None  # the largest order value of each long series
    borders: tuple = ()  # least order values of all chunks but the first, where order values alone tell the chunk


def _below(borders: list, x: Column, under: Callable[[Column], Column] | None = None) -> Column:
    """How many of the sorted borders are not above x (or: under holds, for the first ones of all only), by halving."""
    under = under or (lambda border: border <= x)
    steps, n = [], 1
    while n <= len(borders):
        steps.insert(0, n)
        n *= 2
    cuts = F.array(*[F.lit(c) for c in borders])

    def go(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(borders)) & (under(F.element_at(cuts, F.least(at + step, F.lit(len(borders)))))), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), go)


def _same(a: DataFrame, b: DataFrame, keys: Names) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_of_{k}"])
    return out


def _joined(rows: DataFrame, carried: DataFrame, keys: Names) -> DataFrame:
    """rows left join carried, which has one row per key and chunk; without keys it has a row per chunk and is broadcast."""
    renamed = carried.select(*[F.col(k).alias(f"_of_{k}") for k in (*keys, "_serion_chunk")], *[c for c in carried.columns if c not in (*keys, "_serion_chunk")])
    renamed = renamed if keys else F.broadcast(renamed)
    return rows.join(renamed, _same(rows, renamed, (*keys, "_serion_chunk")), "left").drop(*[f"_of_{k}" for k in (*keys, "_serion_chunk")])


def _cut(df: DataFrame, order: str, keys: Names, by: Names = (), size: int | None = None) -> _Cut:
    """Chunks of size (CHUNK_ROWS) rows of all longer series; by: the columns that order rows of one order value."""
    size = size or CHUNK_ROWS
    if taken := [c for c in df.columns if c.startswith("_serion_")]:
        raise ValueError(f"reserved column names: {taken}")
    df = df.where(F.col(order).isNotNull())
    plain = df.withColumns({"_serion_long": F.lit(False), "_serion_chunk": F.lit(0)})
    marked = df.withColumn("_serion_long", F.lit(True))
    if keys:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_serion_n"), F.max(order).alias("_serion_top"))
        one = F.struct(*keys, "_serion_n", "_serion_top")
        # one row; total / size keys at most are long
        got = sizes.agg(F.coalesce(F.sum("_serion_n"), F.lit(0)).alias("total"), F.collect_list(F.when(F.col("_serion_n") > size, one)).alias("long")).first()
        total, rows = got.total, sum(r._serion_n for r in got.long)
        if not rows:
            return _Cut(plain, lambda x: F.lit(0), False, total, None)
        long = df.sparkSession.createDataFrame([tuple(r) for r in got.long], sizes.schema)
        top = long.drop("_serion_n")
        known = F.broadcast(long.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.lit(True).alias("_serion_is_long")))
        marked = df.join(known, _same(df, known, keys), "left").withColumn("_serion_long", F.coalesce("_serion_is_long", F.lit(False))).drop("_serion_is_long", *[f"_of_{k}" for k in keys])
        n = min(MAX_CHUNKS, -(-rows // size))
        found = marked.where("_serion_long").agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5], 10 * n).alias("cuts")).first().cuts
    else:
        shares = [k / MAX_CHUNKS for k in range(1, MAX_CHUNKS)]
        got = df.agg(F.count("*").alias("n"), F.max(order).alias("_serion_top"), F.percentile_approx(order, shares, 10 * MAX_CHUNKS).alias("cuts")).first()
        total = rows = got.n
        if total <= size:
            return _Cut(plain, lambda x: F.lit(0), False, total, None)
        n = min(MAX_CHUNKS, -(-rows // size))
        found = [got.cuts[k * MAX_CHUNKS // n - 1] for k in range(1, n)]
        top = df.sparkSession.createDataFrame([(got._serion_top,)], df.select(F.col(order).alias("_serion_top")).schema)
    cuts = found or []
    if by and len(set(cuts)) < len(cuts):  # an order value fills whole chunks
        every = [*keys, order, *by, F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])]
        dealt = marked.where("_serion_long").repartitionByRange(len(cuts) + 1, *every).withColumn("_serion_chunk", F.spark_partition_id())
        dealt = Scratch(df.sparkSession, "ordered").save("rows", dealt)
        short = marked.where("NOT _serion_long").withColumn("_serion_chunk", F.lit(0))
        return _Cut(dealt.unionByName(short), lambda x: F.lit(None), True, total, top)
    borders = sorted(set(cuts))
    if not borders:
        return _Cut(plain, lambda x: F.lit(0), False, total, None)
    chunk = lambda x: F.when(F.col("_serion_long"), _below(borders, x)).otherwise(F.lit(0))
    return _Cut(marked.withColumn("_serion_chunk", chunk(F.col(order))), chunk, True, total, top, tuple(borders))


def _window(keys: Names, order: Names):
    return Window.partitionBy(*keys, "_serion_chunk").orderBy(*order)


def previous(df: DataFrame, order: str, values: list[str], keys: Names = (), prefix: str = "prev_", then: Names = ()) -> DataFrame:
    """df and, per value, its value in the row before (null in the first row)."""
    by = (order, *then, *[v for v in values if v not in (order, *then)])
    cut = _cut(df, order, keys, by[1:] or (order,))
    rows, w = cut.rows, _window(keys, by)
    out = rows.select("*", *[F.lag(v).over(w).alias(prefix + v) for v in values], (F.row_number().over(w) == 1).alias("_serion_first"))
    if cut.many:
        # the last row of each chunk, handed to the next chunk of the series that has rows
        last = rows.where("_serion_long").groupBy(*keys, "_serion_chunk").agg(F.max(F.struct(*by)).alias("_serion_last"))
        following = Window.partitionBy(*keys).orderBy("_serion_chunk")  # one row per chunk
        last = last.select(*keys, F.lead("_serion_chunk").over(following).alias("_serion_chunk"), "_serion_last").where("_serion_chunk IS NOT NULL")
        out = _joined(out, last, keys)
        for v in values:
            out = out.withColumn(prefix + v, F.when(F.col("_serion_first"), F.col("_serion_last")[v]).otherwise(F.col(prefix + v)))
        out = out.drop("_serion_last")
    return out.drop("_serion_chunk", "_serion_first", "_serion_long")


def _ranked(cut: _Cut, order: str, name: str, keys: Names, then: Names) -> DataFrame:
    rows = cut.rows
    out = rows.withColumn(name, F.row_number().over(_window(keys, (order, *then))).cast("long"))
    if not cut.many:
        return out.drop("_serion_chunk")
    sizes = rows.where("_serion_long").groupBy(*keys, "_serion_chunk").count()  # one row per chunk
    before = sizes.select(*keys, "_serion_chunk", (F.sum("count").over(Window.partitionBy(*keys).orderBy("_serion_chunk")) - F.col("count")).alias("_serion_before"))
    return _joined(out, before, keys).withColumn(name, F.col(name) + F.coalesce("_serion_before", F.lit(0))).drop("_serion_chunk", "_serion_before")


def ranked(df: DataFrame, order: str, name: str = "n", keys: Names = (), then: Names = ()) -> DataFrame:
    """df and a 1-based rank in ascending order, within each key."""
    return _ranked(_cut(df, order, keys, then or (order,)), order, name, keys, then).drop("_serion_long")


def running_totals(df: DataFrame, order: str, value: str, name: str = "running", keys: Names = (), then: Names = ()) -> DataFrame:
    """df and the sum of the value up to each row (nulls add nothing; null before the first value)."""
    by = (order, *[c for c in (*then, value) if c != order])
    cut = _cut(df, order, keys, by[1:] or (order,))
    out = cut.rows.withColumn(name, F.sum(value).over(_window(keys, by).rowsBetween(Window.unboundedPreceding, 0)))
    if cut.many:
        sums = cut.rows.where("_serion_long").groupBy(*keys, "_serion_chunk").agg(F.sum(value).alias("_serion_sum"))
        before = Window.partitionBy(*keys).orderBy("_serion_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
        out = _joined(out, sums.select(*keys, "_serion_chunk", F.sum("_serion_sum").over(before).alias("_serion_before")), keys)
        both = F.coalesce(name, F.lit(0)) + F.coalesce("_serion_before", F.lit(0))
        out = out.withColumn(name, F.when(F.col(name).isNotNull() | F.col("_serion_before").isNotNull(), both)).drop("_serion_before")
    return out.drop("_serion_chunk", "_serion_long")


def largest_before(df: DataFrame, order: str, value: str, name: str, keys: Names = (), then: Names = ()) -> DataFrame:
    """df and the largest value of the rows before each (nulls do not count; null where none before has a value)."""
    by = (order, *then, *[c for c in (value,) if c not in (order, *then)])
    cut = _cut(df, order, keys, by[1:] or (order,))
    out = cut.rows.withColumn(name, F.max(value).over(_window(keys, by).rowsBetween(Window.unboundedPreceding, -1)))
    if cut.many:
        largest = cut.rows.where("_serion_long").groupBy(*keys, "_serion_chunk").agg(F.max(value).alias("_serion_largest"))
        before = Window.partitionBy(*keys).orderBy("_serion_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
        out = _joined(out, largest.select(*keys, "_serion_chunk", F.max("_serion_largest").over(before).alias("_serion_before")), keys)
        out = out.withColumn(name, F.greatest(name, "_serion_before")).drop("_serion_before")
    return out.drop("_serion_chunk", "_serion_long")


def gaps(df: DataFrame, order: str, keys: tuple[str, ...] = (), name: str = "gap") -> DataFrame:
    """First differences of the order column; the first row of a series has none and is dropped."""
    out = previous(df, order, [order], keys, "_prev_")
    return out.withColumn(name, F.col(order) - F.col(f"_prev_{order}")).where(F.col(name).isNotNull()).drop(f"_prev_{order}")


def sign_changes(df: DataFrame, order: str, value: str, keys: tuple[str, ...] = (), zero_hits: bool = False) -> DataFrame:
    """Rows whose value has another sign than the row before: (prev_order, order) is a bracket.

    The test is strict; with zero_hits a value of exactly 0 counts, too, once.
    """
    out = previous(df, order, [order, value], keys)
    change = F.col(f"prev_{value}") * F.col(value) < 0
    if zero_hits:
        change = change | (F.col(value) == 0)
    return out.where(change)


def carried_forward(df: DataFrame, order: str, value: str, keys: Names, name: str, then: Names = ()) -> DataFrame:
    """df and the last non-null value up to each row."""
    by = (order, *[c for c in (*then, value) if c != order])
    cut = _cut(df, order, keys, by[1:] or (order,))
    out = cut.rows.withColumn(name, F.last(value, ignorenulls=True).over(_window(keys, by).rowsBetween(Window.unboundedPreceding, 0)))
    if cut.many:
        last = cut.rows.where("_serion_long").groupBy(*keys, "_serion_chunk").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*by)))[value].alias("_serion_last"))
        before = Window.partitionBy(*keys).orderBy("_serion_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
        last = last.select(*keys, "_serion_chunk", F.last("_serion_last", ignorenulls=True).over(before).alias("_serion_carried"))
        out = _joined(out, last, keys).withColumn(name, F.coalesce(name, "_serion_carried")).drop("_serion_carried")
    return out.drop("_serion_chunk", "_serion_long")


def ring_stats(df: DataFrame, order: str, value: str, keys: Names, rows: int = 300, then: Names = ()) -> DataFrame:
    """df and n, least, largest, total and mean value of the last ``rows`` rows."""
    by: Names = (order, *[c for c in (*then, value) if c != order])
    cut = _cut(df, order, keys, by[1:] or (order,))
    if cut.many:
        # chunks of equal numbers of rows; the last rows of a chunk are guests of the next one
        out = _ranked(cut, order, "_serion_n", keys, by[1:])
        size = max(CHUNK_ROWS, rows)
        own = F.when(F.col("_serion_long"), F.floor((F.col("_serion_n") - 1) / size).cast("int")).otherwise(0)
        border = F.col("_serion_long") & ((F.col("_serion_n") - 1) % size >= size - (rows - 1))
        out = out.withColumn("_serion_own", own).withColumn("_serion_chunk", F.explode(F.when(border, F.array(F.col("_serion_own"), F.col("_serion_own") + 1)).otherwise(F.array("_serion_own"))))
        by = ("_serion_n",)
    else:
        out = cut.rows.withColumn("_serion_own", F.lit(0))
    w = _window(keys, by).rowsBetween(-(rows - 1), 0)
    out = out.select("*", F.count(value).over(w).alias("n"), F.min(value).over(w).alias("least"), F.max(value).over(w).alias("largest"), F.sum(value).over(w).alias("total"), F.avg(value).over(w).alias("mean"))
    return out.where("_serion_chunk = _serion_own").drop("_serion_chunk", "_serion_own", "_serion_long", *(["_serion_n"] if cut.many else []))


class _Totals(NamedTuple):
    """Count, sum, least and largest of something, element by element."""

    n: np.ndarray
    total: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    def with_(self, other: _Totals) -> _Totals:
        return _Totals(self.n + other.n, self.total + other.total, np.minimum(self.least, other.least), np.maximum(self.largest, other.largest))

    def at(self, k) -> _Totals:
        return _Totals(*(x[k] for x in self))

    @staticmethod
    def none(n: int) -> _Totals:
        return _Totals(np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf))

    @staticmethod
    def of(values: np.ndarray) -> _Totals:
        """One value each; NaN: none."""
        gone = np.isnan(values)
        return _Totals((~gone).astype(np.int64), np.where(gone, 0.0, values), np.where(gone, np.inf, values), np.where(gone, -np.inf, values))


def range_totals(each: _Totals, first: np.ndarray, end: np.ndarray) -> _Totals:
    """Totals of the elements first .. end - 1 of every range.

    A sparse table, one level at a time: the level of size s holds the totals of s
    elements from each place on, and a range is put together from one entry of each
    level that its length has as a bit. Nothing is subtracted, so sums keep their digits.
    """
    out, place, length, size = _Totals.none(len(first)), first.copy(), end - first, 1
    while True:
        k = np.flatnonzero(length & size)
        if len(k):
            got = out.at(k).with_(each.at(place[k]))
            for whole, part in zip(out, got, strict=True):
                whole[k] = part
            place[k] += size
        if not len(length) or 2 * size > length.max():
            return out
        each = each.at(slice(None, -size)).with_(each.at(slice(size, None)))
        size *= 2


def _codes(table: pa.Table, keys: Names) -> np.ndarray:
    """A number for each combination of keys (null is a key)."""
    out = np.zeros(table.num_rows, np.int64)
    for k in keys:
        coded = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode")
        _, out = np.unique(out * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    return out


def _numeric(column: pa.ChunkedArray) -> np.ndarray:
    column = column if pa.types.is_integer(column.type) and not column.null_count else column.cast(pa.float64())
    return column.to_numpy()


def _between(keys: Names) -> Callable[[pa.Table], pa.Table]:
    """Per chunk of a series: totals of the rows before it that lie in the frames of all its rows."""

    def task(g: pa.Table) -> pa.Table:
        own, leave = g["own"].to_numpy(), g["leave"].to_numpy()
        order = np.lexsort((leave, own))  # later rows leave later: leave is in order, too
        own, leave = own[order], leave[order]
        each = _Totals(*(g[c].to_numpy()[order] for c in ("n", "total", "least", "largest")))
        chunk = np.unique(np.concatenate([np.arange(a + 1, b) for a, b in zip(own, leave, strict=True)]))
        first, end = np.searchsorted(leave, chunk, "right"), np.searchsorted(own, chunk, "left")
        got = range_totals(each, first, end)
        key = [pa.repeat(g[k][0], len(chunk)) for k in keys]
        return pa.table([*key, pa.array(chunk.astype(np.int32)), *map(pa.array, got)], [*keys, "_serion_chunk", "n", "total", "least", "largest"])

    return task


def clipped_stats(df: DataFrame, seconds: str, value: str, keys: Names, span: float = 300) -> DataFrame:
    """df and n, least, largest, total and mean (of doubles) of the rows of the last ``span`` seconds.

    Rows of one second count alike. However many rows or chunks a frame spans, a row is
    in its own chunk and, without its other columns, in the one chunk where it leaves the
    frame; what lies between the two is one total per chunk. Rows of one second are one
    chunk.
    """
    cut = _cut(df, seconds, keys, size=min(CHUNK_ROWS, FRAME_ROWS))
    kind = df.schema[seconds].dataType
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-cut.total // GROUP_ROWS)))) if keys else F.lit(0)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("total", "double"), ("least", "double"), ("largest", "double"))]
    own = cut.rows.select(*[F.col(k).alias(f"_serion_key_{i}") for i, k in enumerate(keys)], "_serion_chunk", bucket.cast("long").alias("_serion_bucket"), F.col(seconds).alias("_serion_o"), v.alias("_serion_v"), *none, F.struct(*df.columns).alias("_serion_row"))
    names = tuple(f"_serion_key_{i}" for i in range(len(keys)))
    if cut.many:
        renamed = cut.top.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_serion_top")
        light = cut.rows.where("_serion_long").select(*keys, "_serion_chunk", "_serion_long", F.col(seconds).alias("_serion_o"), v.alias("_serion_v"), bucket.cast("long").alias("_serion_bucket"))
        light = light.join(F.broadcast(renamed), _same(light, renamed, keys), "left").drop(*[f"_of_{k}" for k in keys])
        until = F.col("_serion_o") + span
        light = light.withColumn("_serion_leave", F.when(until < F.col("_serion_top"), cut.chunk(until)).otherwise(MAX_CHUNKS + 1))
        light = light.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_serion_chunk", "_serion_leave", "_serion_o", "_serion_v", "_serion_bucket")
        shape = own.drop("_serion_row").schema
        guests = light.where((F.col("_serion_leave") > F.col("_serion_chunk")) & (F.col("_serion_leave") <= MAX_CHUNKS)).withColumn("_serion_chunk", F.col("_serion_leave"))
        guests = guests.select(*names, "_serion_chunk", "_serion_bucket", F.col("_serion_o").cast(kind), "_serion_v", *none)
        # a row per pair of chunks where rows enter and leave: twice the chunks of a series at most
        pairs = light.where(F.col("_serion_leave") > F.col("_serion_chunk") + 1).groupBy(*names, F.col("_serion_chunk").alias("own"), F.least(F.col("_serion_leave"), F.lit(MAX_CHUNKS)).alias("leave"))
        pairs = pairs.agg(F.count("_serion_v").alias("n"), F.coalesce(F.sum("_serion_v"), F.lit(0.0)).alias("total"), F.coalesce(F.min("_serion_v"), F.lit(float("inf"))).alias("least"), F.coalesce(F.max("_serion_v"), F.lit(float("-inf"))).alias("largest"))
        kinds = "".join(f"{n} {shape[n].dataType.simpleString()}, " for n in names)
        middle = pairs.groupBy(*names).applyInArrow(_between(names), f"{kinds}_serion_chunk int, n long, total double, least double, largest double")
        placed = F.pmod(F.xxhash64(*names), F.lit(max(1, -(-cut.total // GROUP_ROWS)))) if keys else F.lit(0)
        middle = middle.select(*names, "_serion_chunk", placed.cast("long").alias("_serion_bucket"), F.lit(None).cast(kind).alias("_serion_o"), F.lit(None).cast("double").alias("_serion_v"), "n", "total", "least", "largest")
        own = own.unionByName(guests.unionByName(middle).withColumn("_serion_row", F.lit(None).cast(own.schema["_serion_row"].dataType)))

    own_columns = df.columns

    def frames(g: pa.Table) -> pa.Table:
        o_there = pc.is_valid(g["_serion_o"]).to_numpy()
        code = _codes(g, names)
        rest = _Totals.none(int(code.max()) + 1)
        for k in np.flatnonzero(~o_there):
            for whole, c in zip(rest, ("n", "total", "least", "largest"), strict=True):
                whole[code[k]] = g[c][k].as_py()
        t = g.filter(pa.array(o_there))
        code, o, v = code[o_there], _numeric(t["_serion_o"]), t["_serion_v"].cast(pa.float64()).to_numpy()
        order = np.lexsort((o, code))
        t, code, o, v = t.take(pa.array(order)), code[order], o[order], v[order]
        n = len(o)
        mine = pc.is_valid(t["_serion_row"]).to_numpy()
        # the first row of each frame: how many rows stand before (code, o - span)
        asked = np.lexsort((np.repeat([1, 0], n), np.concatenate([o, o - span]), np.tile(code, 2)))
        before = np.cumsum(asked < n)
        first = np.empty(n, np.int64)
        first[asked[asked >= n] - n] = before[asked >= n]
        # its end: behind the last row of the same second
        ends = np.append(np.flatnonzero((code[1:] != code[:-1]) | (o[1:] != o[:-1])) + 1, n)
        end = ends[np.searchsorted(ends, np.arange(n), "right")] if n else np.zeros(0, np.int64)
        got = range_totals(_Totals.of(v), first[mine], end[mine]).with_(rest.at(code[mine]))
        any_ = got.n > 0
        fields = t["_serion_row"].combine_chunks().filter(pa.array(mine, pa.bool_())).flatten()
        stats = [pa.array(got.n), *[pa.array(x, mask=~any_) for x in (got.least, got.largest, got.total, got.total / np.maximum(got.n, 1))]]
        return pa.table([*fields, *stats], [*own_columns, "n", "least", "largest", "total", "mean"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return own.groupBy("_serion_bucket", "_serion_chunk").applyInArrow(frames, f"{columns}, n long, least double, largest double, total double, mean double")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, left, right, n) for equal bins over [min, max]; the last one is closed; empty bins are listed.

    Null values are left out; a table without values has no bins.
    """
    span = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where("_low IS NOT NULL")  # one row
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) / width).cast("int"), F.lit(bins - 1))).otherwise(0)
    counted = df.where(F.col(value).isNotNull()).join(F.broadcast(span)).groupBy((place + 1).alias("bin")).agg(F.count("*").alias("n"))
    edges = span.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "_low", width.alias("_width"))
    return edges.join(counted, "bin", "left").select("bin", (F.col("_low") + (F.col("bin") - 1) * F.col("_width")).alias("left"), (F.col("_low") + F.col("bin") * F.col("_width")).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


#: Cells that a task of histogram_once holds.
CELLS = 4096


class _Cells(NamedTuple):
    """Count, least and largest value of the cells [i, i + 1) * 2**k that have values, sorted by i."""

    k: int
    i: np.ndarray
    n: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    @staticmethod
    def scale(least: float, largest: float) -> int:
        """The finest k of CELLS cells at most, whose numbers a double holds exactly."""
        top = max(abs(least), abs(largest))
        exact = max(int(np.frexp(top)[1]) - 52, -1022)
        return max(int(np.frexp(largest / CELLS - least / CELLS)[1]) + 1, exact)

    def doubled(self, k: int) -> _Cells:
        """Cells of width 2**k, k not below the own one: neighbours are put together."""
        i, first = np.unique(self.i >> min(k - self.k, 63), return_index=True)
        if not len(i):
            return self._replace(k=k)
        return _Cells(k, i, np.add.reduceat(self.n, first), np.minimum.reduceat(self.least, first), np.maximum.reduceat(self.largest, first))

    def with_(self, other: _Cells) -> _Cells:
        """Both together, in cells that double in width until the whole range fits."""
        k = max(self.k, other.k, self.scale(min(self.least[0], other.least[0]), max(self.largest[-1], other.largest[-1])))
        a, b = self.doubled(k), other.doubled(k)
        order = np.argsort(np.concatenate([a.i, b.i]), kind="stable")
        return _Cells(k, *(np.concatenate(c)[order] for c in zip(a[1:], b[1:], strict=True))).doubled(k)

    @staticmethod
    def of(values: np.ndarray) -> _Cells:
        v = np.sort(values)
        k = _Cells.scale(v[0], v[-1])
        return _Cells(k, np.floor(np.ldexp(v, -k)).astype(np.int64), np.ones(len(v), np.int64), v, v).doubled(k)


def _counted_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: _Cells | None = None
    for b in batches:
        v = b.column(0).to_numpy(zero_copy_only=False)
        v = v[np.isfinite(v)]
        if len(v):
            held = _Cells.of(v) if held is None else held.with_(_Cells.of(v))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held.i), held.k, np.int32)), *map(pa.array, held[1:])], ["k", "i", "n", "least", "largest"])


def histogram_once(df: DataFrame, value: str, bins: int) -> DataFrame:
    """What histogram gives, of values as doubles, with one pass over df's rows; it runs when called.

    Each task counts into at most CELLS cells whose width doubles as the range grows, with
    each cell's least and largest value; tasks' cells are put together at the coarsest
    width. A cell whose least and largest value fall into one bin is counted there, so
    bins are exact. Only where an edge of a bin parts the values of a cell (bins - 1 cells
    at most) a second pass deals the values of those cells. Values that are not finite
    are left out.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "histogram")
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    cells = scratch.save("cells", v.mapInArrow(_counted_cells, "k int, i long, n long, least double, largest double"))
    schema = "bin int, left double, right double, n long"
    span = cells.agg(F.max("k").alias("k"), F.min("least").alias("low"), F.max("largest").alias("high")).first()
    if span.k is None:
        scratch.drop("cells")
        return spark.createDataFrame([], schema)
    low, high, k = span.low, span.high, max(span.k, _Cells.scale(span.low, span.high))
    width = (high - low) / bins
    place = lambda x: F.least(F.floor((x - low) / width).cast("int"), F.lit(bins - 1)) if width > 0 else F.lit(0)
    coarse = F.floor(F.col("i") / F.pow(F.lit(2.0), F.lit(k) - F.col("k"))).cast("long")  # |i| is below 2**53
    merged = cells.groupBy(coarse.alias("i")).agg(F.sum("n").alias("n"), F.min("least").alias("a"), F.max("largest").alias("b"))  # CELLS + 1 rows at most
    got = merged.select("i", "n", place(F.col("a")).alias("a"), place(F.col("b")).alias("b")).collect()
    n = [0] * bins
    for r in got:
        if r.a == r.b:
            n[r.a] += r.n
    parted = [r.i for r in got if r.a != r.b]
    if parted:
        of = F.floor(F.col("v") / F.lit(2.0**k)) if k < 1024 else F.floor(F.col("v") / 2.0**1023 / 2.0 ** (k - 1023))
        finite = F.abs("v") < float("inf")
        for r in v.where(finite & of.cast("long").isin(parted)).groupBy(place(F.col("v")).alias("bin")).count().collect():
            n[r.bin] += r["count"]
    scratch.drop("cells")
    return spark.createDataFrame([(b + 1, low + b * width, low + (b + 1) * width, m) for b, m in enumerate(n)], schema)


def summary(df: DataFrame, order: str) -> DataFrame:
    """One row: count, first, last, mean gap."""
    return df.agg(F.count(order).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), ((F.max(order) - F.min(order)) / F.nullif(F.count(order) - 1, F.lit(0))).alias("mean_gap"))


def snapshots(df: DataFrame, order: str, every: int = 100) -> DataFrame:
    """(snapshot, n, order value) of every ``every``-th row: snapshot k covers the first n rows."""
    return ranked(df, order).where(F.col("n") % every == 0).select((F.col("n") / every).cast("long").alias("snapshot"), "n", F.col(order))


def compared(left: DataFrame, right: DataFrame, value: str, reference: str, on: str = "n") -> DataFrame:
    """Positional pairing of two ranked series, cut to the shorter, with absolute and relative (percent) error."""
    both = left.join(right, on)
    error = F.abs(F.col(value) - F.col(reference))
    return both.select(on, value, reference, error.alias("abs_err"), (error / F.nullif(F.abs(F.col(reference)), F.lit(0.0)) * 100).alias("rel_err_pct"))


#: Places that the rows of a hot value are dealt to, and the share of all rows from which a value is hot.
SALTS, HOT_SHARE = 64, 1 / 256


def unmatched(left: DataFrame, right: DataFrame, value: str, reference: str, tolerance: float) -> DataFrame:
    """Rows of left without a reference value nearer than the tolerance.

    The distinct values of left are joined by cells of the tolerance's width and their
    two neighbours, so the join is an equi-join; cells keep each value once. Rows then
    meet the verdict of their value, those of a hot value in many places by a hash of the row. A null value
    has nothing near.
    """
    scratch = Scratch(left.sparkSession, "unmatched")
    sizes = scratch.save("values", left.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_rows")))
    near = right.where(F.col(reference).isNotNull()).select(F.col(reference).alias("_ref"), F.floor(F.col(reference) / tolerance).alias("_cell"))
    ends = scratch.save("ends", near.groupBy("_cell").agg(F.min("_ref").alias("_low"), F.max("_ref").alias("_high")))
    # a reference in the value's own cell is near; of the neighbours, only the nearest end can be
    out = sizes.select("_v", F.floor(F.col("_v") / tolerance).alias("_at")).join(ends.select(F.col("_cell").alias("_at")), "_at", "left_anti")
    below = ends.select((F.col("_cell") + 1).alias("_at"), F.col("_high").alias("_below"))
    above = ends.select((F.col("_cell") - 1).alias("_at"), F.col("_low").alias("_above"))
    out = out.join(below, "_at", "left").join(above, "_at", "left")
    met = F.coalesce(F.col("_v") - F.col("_below") < tolerance, F.lit(False)) | F.coalesce(F.col("_above") - F.col("_v") < tolerance, F.lit(False))
    alone = out.where(~met).select("_v")
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    hot = [r._v for r in sizes.where(F.col("_rows") > max(total * HOT_SHARE, CHUNK_ROWS / SALTS)).select("_v").collect()]  # 1 / HOT_SHARE at most
    is_hot = lambda c: F.col(c).isin(hot) if hot else F.lit(False)
    place = F.when(is_hot(value), F.pmod(F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind]), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    alone = alone.withColumn("_place", F.explode(F.when(is_hot("_v"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    rows = left.where(F.col(value).isNotNull()).withColumn("_at", place)
    rows = rows.join(alone, (F.col(value) == F.col("_v")) & (F.col("_at") == F.col("_place")), "left_semi").drop("_at")
    return rows.unionByName(left.where(F.col(value).isNull()))
