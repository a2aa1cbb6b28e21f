"""Operator 3: exact Jaccard join of word n-gram sets by parity sketches.

Method. Each distinct shingle of a text flips one bit of a wide bit sketch, so
the Hamming distance of two sketches never exceeds the symmetric difference of
the sets. Texts are put into bands by set size; a band fixes the largest
symmetric difference D that a link can have, and the sketch is cut into more than
D blocks, so linked texts agree in some block (pigeonhole). A block is never
materialised: its key is the XOR of a 64-bit code of each bit that is flipped an
odd number of times. Texts that meet in a block are candidates; every link that
counts is verified on the whole sets.

Blocks of at most one shingle tell little and would gather many texts. A band
therefore has E blocks more than the pigeonhole needs, so linked texts agree in
E + 1 blocks: a text that has E poor blocks at most leaves them out and is still
found by another block. If both texts have more and agree in poor blocks only,
then of a text's E + x poor blocks fewer than x disagree, so the first two that
agree are among its first x + 1, and pairs of these are its further keys. Bands of
small sets use pairs of blocks throughout. So nothing is capped and no link is lost.

Passages that many texts share would make blocks agree without a link. Shingles
that are frequent in a sample (any choice is correct) count as hot. The sets
without their hot shingles differ by D at most, too, so a text is keyed by its
cold shingles alone if it has enough of them, by all if most are hot, and both
ways in between, with a margin that no link can jump.

Only connected components are asked for, so the pairs of a block need not all be
tried: first every member is verified against the block's most central member and
components are formed. Of members of different components that still share a
block, a pair becomes a row only if sizes and the Hamming distance of two sketches
(of hot and of cold shingles) allow a link; such pairs are verified. In a block
of more than BLOCK_ROWS members not even these are tried: its members are keyed
anew by the rarest shingles of each set, as many as any link must share one of
(of n shingles, two linked sets share ceil(n * percent / 100) at least, so one of
the first n - that + 1 in any common order). Groups of these keys that are still
large are cut into cells of CELL_ROWS members a side, and pairs of cells are dealt
to all tasks.

Texts with equal sets are one vertex, named by one of its rows, so copies never
become pairs. Sets are told apart by 128-bit digests (with n distinct texts the
chance that any two agree is about n * n / 2**129). Texts without a shingle take
no part in any join.

No large key of a join lands in one task: a key that holds more than HOT_KEY of a
table's rows (there are 1 / HOT_KEY of them at most) and more than HOT_ROWS is dealt
to SALTS places, and its one row of the other table is repeated there.

Defined cases: a null or empty text has no shingle and is linked with nothing; a
text shorter than a shingle is one shingle; repeated rows are in one component;
rows with a null id take part like all others, and a component's id is its
smallest that is not null, if it has any; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serion.llm.storage import Scratch, free_name
from serion.llm.words import SPACE, mix, slices, words

#: Ratio of the bounds of a size band.
BAND_RATIO = 1.15
#: Bands of at most this difference use pairs of blocks.
SMALL_DIFFERENCE = 6
#: A block of at most this many shingles is poor.
POOR = 1
#: Counted rows of one or two numbers up to which a table is broadcast (about 24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Texts of the sample that tells hot shingles, at least; its share of all texts, at least; sample texts that have a hot shingle, at least.
HOT_SAMPLE, HOT_SHARE, HOT_TEXTS = 5000, 1 / 128, 10
#: Hot shingles that are kept (8 bytes each, broadcast), the most frequent ones.
HOT_SHINGLES = 200_000
#: A join key is hot if it holds more than this share of a table's rows, and more than HOT_ROWS; it is dealt to SALTS places.
HOT_KEY, HOT_ROWS, SALTS = 1 / 256, 1000, 256
#: Members of a block up to which its pairs are tried; members of a cell of a larger group.
BLOCK_ROWS, CELL_ROWS = 256, 256
#: Words of 64 bits of the sketches of cold and of hot shingles.
COLD_WORDS, HOT_WORDS = 8, 4

_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Hot(NamedTuple):
    """Hot shingles."""

    hashes: np.ndarray  # in order
    rank: np.ndarray  # of each, the rarest first


class Band(NamedTuple):
    number: int
    low: int
    high: int
    reach: int  # largest size of a partner
    blocks: int
    spare: int  # blocks beyond the pigeonhole's need; -1: pairs of blocks; -2: only equal sets can be linked


def _poor_share(mean: float) -> float:
    return math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(POOR + 1))


def _spare(low: int, most: int) -> int:
    """Blocks to add so that a text of a band gives the fewest keys in expectation."""

    def cost(spare: int) -> float:
        blocks = most + 1 + spare
        share = _poor_share(low / blocks)
        poor, sigma = blocks * share, math.sqrt(blocks * share * (1 - share))
        excess = [max(0.0, poor + z * sigma - spare) for z in (-1.5, -0.5, 0.5, 1.5)]
        return blocks - poor + sum(x * (x + 1) / 2 for x in excess) / len(excess)

    return min(range(1, most + 2, max(1, most // 100)), key=cost)


@lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 31) -> list[Band]:
    """Size bands for links of at least ``percent`` of the union."""
    out, low = [], 1
    while low <= largest:
        high = max(low, math.ceil(low * BAND_RATIO) - 1)
        reach = high * 100 // percent
        most = (high + reach) * (100 - percent) // (100 + percent)
        if most == 0:
            blocks, spare = 0, -2
        elif most <= SMALL_DIFFERENCE:
            blocks, spare = most + 2, -1
        else:
            spare = _spare(low, most)
            blocks = most + 1 + spare
        out.append(Band(len(out), low, high, reach, blocks, spare))
        low = high + 1
    return out


def _shingles(at: np.ndarray, data: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each row of a slice, and the rows' word counts."""
    w = words(at, data, SPACE)
    n = np.diff(w.bounds)
    h = np.zeros(max(0, len(w.hash) - size + 1), np.uint64)
    for k in range(size):
        h = h * _GOLD + w.hash[k : len(w.hash) - size + 1 + k]
    h = mix(h)
    out = []
    for a, z in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(h[a : z - size + 1]))
        elif z > a:
            one = np.full(1, z - a, np.uint64)
            for x in w.hash[a:z]:
                one = one * _GOLD + x
            out.append(mix(one ^ _GOLD))
        else:
            out.append(h[:0])
    return out, n


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two independent 64-bit digests of each set."""
    n = np.array([len(h) for h in sets], np.uint64)
    a = np.array([np.bitwise_xor.reduce(mix(h ^ np.uint64(0x5851F42D4C957F2D))) for h in sets], np.uint64)
    b = np.array([np.add.reduce(mix(h + _GOLD)) for h in sets], np.uint64)
    return [pa.array(mix(x + n * _GOLD).view(np.int64)) for x in (a, b)]


def _keys(h: np.ndarray, n: int, percent: int, tag: int) -> list[np.ndarray]:
    """Block keys of sorted hashes, over all bands that a set of size n takes part in; h: the set or its cold part."""
    every, out = bands(percent), []
    k = _band_of(percent, n)
    flips = mix((h & np.uint64(0xFFFFFFFF)) ^ _GOLD)
    place = h >> np.uint64(32)
    while k >= 0 and n <= every[k].reach:
        band = every[k]
        k -= 1
        if band.spare == -2:
            continue
        block = (place * np.uint64(band.blocks)) >> np.uint64(32)
        counts = np.bincount(block.astype(np.int64), minlength=band.blocks)
        value = np.zeros(band.blocks, np.uint64)
        there = np.flatnonzero(counts)
        if len(there):
            value[there] = np.bitwise_xor.reduceat(flips, (np.cumsum(counts) - counts)[there])
        value = mix(value + (np.arange(band.blocks, dtype=np.uint64) + np.uint64((2 * band.number + tag) << 32)) * _GOLD)
        if band.spare == -1:
            out.append(_paired(value))
            continue
        poor = counts <= POOR
        out.append(value[~poor])
        excess = int(poor.sum()) - band.spare
        if excess > 0:
            out.append(_paired(value[poor][: excess + 1]))
    return out


def keys_of(h: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """All block keys of a sorted set of hashes; hot: which of them are hot."""
    n, cold = len(h), len(h) - int(hot.sum())
    margin = 1.5 * (100 - percent) / (100 + percent)
    out = []
    if cold >= n * (0.5 - margin):
        out += _keys(h[~hot], n, percent, 1)
    if cold <= n * (0.5 + margin):
        out += _keys(h, n, percent, 0)
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def prefix_of(h: np.ndarray, hot: Hot, percent: int) -> np.ndarray:
    """The first shingles of a set, the rarest first, of which any linked set shares one."""
    last = _is_hot(h, hot.hashes)
    rank = np.zeros(len(h), np.int64)
    if last.any():
        rank[last] = 1 + hot.rank[np.searchsorted(hot.hashes, h[last])]
    return h[np.lexsort((h, rank))][: len(h) - -(-percent * len(h) // 100) + 1]


def _parity(h: np.ndarray, words64: int) -> np.ndarray:
    """Parity sketch of a set: one bit flips per hash."""
    bits = np.bincount((mix(h) & np.uint64(64 * words64 - 1)).astype(np.int64), minlength=64 * words64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(h), bool)
    at = np.searchsorted(hot, h)
    at[at == len(hot)] = 0
    return hot[at] == h


def _paired(value: np.ndarray) -> np.ndarray:
    a, b = np.triu_indices(len(value), 1)
    return mix(value[a] * _GOLD + value[b])


@lru_cache(maxsize=8)
def _lows(percent: int) -> np.ndarray:
    return np.array([b.low for b in bands(percent)])


def _band_of(percent: int, n: int) -> int:
    return int(np.searchsorted(_lows(percent), n, "right")) - 1


def hot_shingles(df: DataFrame, id_col: str, text_col: str, shingle: int) -> Hot:
    """The shingles that many sampled texts have."""
    share = min(1.0, max(HOT_SAMPLE / max(df.count(), 1), HOT_SHARE))
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(1 << 24)) < int(share * (1 << 24))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, at, data in slices(b.column(0)):
                sets, _ = _shingles(at, data, shingle)
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counted = df.where(drawn).select(F.col(text_col).alias("text")).mapInArrow(task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TEXTS)
    found = counted.orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).toArrow()
    h, n = found.column(0).to_numpy().astype(np.int64).view(np.uint64), found.column(1).to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return Hot(h[order], rank[order])


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, hot: Hot) -> DataFrame:
    """(row, id, n, d1, d2, keys, cold, sketch) per row; row: a number of its own; cold: number of cold shingles."""
    shared = df.sparkSession.sparkContext.broadcast(hot.hashes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, end, at, data in slices(b.column(1)):
                sets, _ = _shingles(at, data, shingle)
                hot = [_is_hot(h, shared.value) for h in sets]
                keys = [keys_of(h, x, percent) for h, x in zip(sets, hot, strict=True)]
                marks = [np.concatenate([_parity(h[~x], COLD_WORDS), _parity(h[x], HOT_WORDS)]) for h, x in zip(sets, hot, strict=True)]
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in x])]), pa.int32()), pa.array(np.concatenate(x)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(end - first)), b.column(0).slice(first, end - first), pa.array([len(h) for h in sets], pa.int64()), *_digests(sets), lists(keys), pa.array([len(x) - int(x.sum()) for x in hot], pa.int64()), lists(marks)],
                    ["row", "id", "n", "d1", "d2", "keys", "cold", "sketch"],
                )
                row += end - first

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"row long, id {kind}, n long, d1 long, d2 long, keys array<long>, cold long, sketch array<long>")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(d1, d2, hashes) of each distinct set of a one-column table of texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, at, data in slices(b.column(0)):
                sets, _ = _shingles(at, data, shingle)
                yield pa.RecordBatch.from_arrays([*_digests(sets), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["d1", "d2", "hashes"])

    return texts.mapInArrow(task, "d1 long, d2 long, hashes array<long>").dropDuplicates(["d1", "d2"])


def _small(df: DataFrame) -> DataFrame:
    """Marks a stored table of one or two numbers for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hot_keys(counts: DataFrame, key: str, total: int) -> list[int]:
    """Keys of more than HOT_KEY of all rows, so 1 / HOT_KEY at most. counts: (key, rows)."""
    return [r[0] for r in counts.where(F.col("rows") > max(total * HOT_KEY, HOT_ROWS)).select(key).collect()]


def looked_up(rows: DataFrame, found: DataFrame, key: str, hot: list[int], by: str, how: str = "inner") -> DataFrame:
    """rows joined with found, which has one row per key; rows of hot keys are dealt by a hash of the column ``by``.

    Without hot keys the join is the same, so its plan does not depend on the data.
    """
    is_hot = F.col(key).isin(*hot, -1)
    salt = F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_salt", salt).join(found.withColumn("_salt", F.explode(places)), [key, "_salt"], how).drop("_salt")


def linked(a: Column, b: Column, percent: int) -> Column:
    """The join's condition on two arrays of hashes."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(100 * small < percent * large, F.lit(False)).otherwise(100 * shared >= percent * (F.size(a) + F.size(b) - shared))


def _counted(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows"))


def components(scratch: Scratch, name: str, edges: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex that each vertex reaches; edges: a stored table (a, b)."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    centres = hot_keys(_counted(both, "b"), "b", 2 * edges.count())
    now = scratch.save(name, both.groupBy(F.col("a").alias("vertex")).agg(F.min(F.least("a", "b")).alias("label")))
    total, k = now.count(), 0
    while True:
        k += 1
        label = now.select(F.col("vertex").alias("b"), F.col("label").alias("of_b"))
        near = looked_up(both, label, "b", centres, "a").groupBy(F.col("a").alias("vertex")).agg(F.min("of_b").alias("near"))
        hooked = now.join(near, "vertex").select("vertex", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label's own label is never larger
        jump = now.select(F.col("vertex").alias("label"), F.col("label").alias("of_label"))
        large = hot_keys(_counted(now, "label"), "label", total)
        after = looked_up(hooked, jump, "label", large, "vertex").select("vertex", "old", F.least("label", "of_label").alias("label"))
        after = scratch.save(f"{name}{k}", after)
        scratch.drop(f"{name}{k - 1}" if k > 1 else name)
        now = after.select("vertex", "label")
        if after.where("old != label").isEmpty():
            return now


def join_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id) per row of df."""
    scratch = Scratch(df.sparkSession, "jaccard")
    hot = hot_shingles(df, id_col, text_col, shingle)
    made = scratch.save("sketches", sketches(df, id_col, text_col, shingle, percent, hot))
    there = made.where("n > 0")
    total = there.count()
    # of rows with equal sets, the first one stands for all
    copies = scratch.save("copies", there.groupBy("d1", "d2").agg(F.min("row").alias("vertex"), F.count("*").alias("rows")).where("rows > 1"))
    often = hot_keys(copies, "d1", total)
    moved = looked_up(there.select("row", "d1", F.col("d2").alias("own")), copies.select("d1", "d2", "vertex"), "d1", often, "row").where("own = d2 AND row != vertex").select("row", "vertex")
    moved = scratch.save("moved", moved)
    labels = _labels(scratch, df, there, moved, hot, id_col, text_col, shingle, percent)
    rows = there.select("row", "id", "n").join(moved, "row", "left").select("row", "id", "n", F.coalesce("vertex", "row").alias("vertex"))
    vertices = rows.groupBy("vertex").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    if labels is not None:
        vertices = vertices.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    else:
        vertices = vertices.withColumn("label", F.col("vertex"))
    vertices = scratch.save("vertices", vertices)
    groups = vertices.groupBy("label").agg(F.min("first").alias("component"), F.sum("rows").alias("size"), F.count("*").alias("rows"))
    large = hot_keys(groups, "label", total)
    groups = groups.where("size > 1").select("label", "component")
    of_vertex = looked_up(vertices.select("vertex", "label"), groups, "label", large, "vertex").select("vertex", "component")
    often = hot_keys(vertices, "vertex", total)
    out = looked_up(rows, of_vertex, "vertex", often, "row", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    out = scratch.save("result", out.union(made.where("n = 0").select("id", "n", F.col("id").alias("component"))))
    scratch.drop_others("result")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _labels(scratch: Scratch, df: DataFrame, there: DataFrame, moved: DataFrame, hot: Hot, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame | None:
    """(vertex, label) of all vertices that have a link; None if none has."""
    keyed = there.join(_small(moved.select("row")), "row", "left_anti").select(F.explode("keys").alias("key"), F.col("row").alias("vertex"))
    met = scratch.save("met", keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    n_members = met.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    crowded = hot_keys(met, "key", n_members)
    members = scratch.save("members", looked_up(keyed, met.withColumnRenamed("rows", "size"), "key", crowded, "vertex").select("key", "vertex", "size"))
    # how many others a vertex meets over all its blocks
    central = scratch.save("central", members.groupBy("vertex").agg(F.sum("size").alias("score"), F.count("*").alias("rows")))
    busy = hot_keys(central, "vertex", n_members)
    own = there.select(F.col("row").alias("vertex"), "id", "n", "d1", "d2", "cold", "sketch").join(_small(central.select("vertex")), "vertex", "left_semi")
    own = scratch.save("own", own)
    ids = scratch.save("ids", own.where("id IS NOT NULL").select(F.col("id").alias(id_col)).distinct())
    texts = df.join(_small(ids), id_col, "left_semi").select(text_col).union(df.where(F.col(id_col).isNull()).select(text_col))
    sets = scratch.save("sets", sets_of(texts, shingle).join(own.select("d1", "d2", "vertex"), ["d1", "d2"]).select("vertex", "hashes"))

    def verified(name: str, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are linked, stored under the name."""
        pairs = scratch.save(f"{name}_pairs", pairs.distinct())
        total = pairs.count()
        left = sets.select(F.col("vertex").alias("a"), F.col("hashes").alias("of_a"))
        right = sets.select(F.col("vertex").alias("b"), F.col("hashes").alias("of_b"))
        both = looked_up(pairs, left, "a", hot_keys(_counted(pairs, "a"), "a", total), "b")
        both = looked_up(both, right, "b", hot_keys(_counted(pairs, "b"), "b", total), "a")
        found = scratch.save(name, both.where(linked(F.col("of_a"), F.col("of_b"), percent)).select("a", "b"))
        scratch.drop(f"{name}_pairs")
        return found

    # the most central member is a block's pivot
    scored = looked_up(members, central.select("vertex", "score"), "vertex", busy, "key")
    pivots = scored.groupBy("key").agg(F.max_by("vertex", "score").alias("b"))
    pairs = looked_up(members.select("key", "vertex"), pivots, "key", crowded, "vertex").where("vertex != b").select(F.col("vertex").alias("a"), "b")
    edges = verified("edges", pairs)
    labels = None if edges.isEmpty() else components(scratch, "first", edges)
    at = members.select("key", "vertex")
    if labels is None:
        at = at.withColumn("label", F.col("vertex"))
    else:
        at = looked_up(at, labels, "vertex", busy, "key", "left").select("key", "vertex", F.coalesce("label", "vertex").alias("label"))
    # blocks that still hold several components
    open_ = at.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x != y").select("key", "size")
    at = scratch.save("open", looked_up(at, open_, "key", crowded, "vertex"))
    marks = own.select("vertex", "n", "cold", *[F.col("sketch")[k].alias(f"s{k}") for k in range(COLD_WORDS + HOT_WORDS)])
    small = at.where(F.col("size") <= BLOCK_ROWS).select("key", "vertex", "label", F.lit(1).alias("cells"))
    crowd = at.where(F.col("size") > BLOCK_ROWS).select("vertex", "label").distinct()
    again = scratch.save("again", prefix_keys(sets.join(crowd, "vertex"), hot, percent))
    groups = _counted(again, "key").where("rows > 1")
    shared = groups.select("key", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("cells"))
    again = looked_up(again, shared, "key", hot_keys(groups, "key", again.count()), "vertex").select("key", "vertex", "label", "cells")
    rows = scratch.save("cells", small.union(again))
    scratch.drop("met", "members", "open", "ids", "again")
    n_rows = rows.count()
    busy = hot_keys(_counted(rows, "vertex"), "vertex", n_rows)
    more = verified("more", _cell_pairs(looked_up(rows, marks, "vertex", busy, "key"), percent)) if n_rows else edges.limit(0)
    if not more.isEmpty():
        if labels is not None:
            more = scratch.save("all", labels.where("vertex != label").select(F.col("vertex").alias("a"), F.col("label").alias("b")).union(more))
        labels = components(scratch, "second", more)
    return labels


def prefix_keys(sets: DataFrame, hot: Hot, percent: int) -> DataFrame:
    """(key, vertex, label): each set's rarest shingles, of which any linked set shares one."""
    shared = sets.sparkSession.sparkContext.broadcast(hot)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [prefix_of(x.values.to_numpy(zero_copy_only=False).view(np.uint64), shared.value, percent) for x in b.column(2)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["key", "vertex", "label"])

    return sets.select("vertex", "label", "hashes").mapInArrow(task, "key long, vertex long, label long")


def _cell_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows that share a key and may be linked. A key's members are dealt to its cells; each pair of cells is a join key of its own."""
    cell = F.pmod(F.xxhash64("vertex"), F.col("cells")).cast("int")
    values = [c for c in rows.columns if c not in ("key", "cells")]
    one = rows.withColumn("i", cell).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("cells") - 1)))
    two = rows.withColumn("j", cell).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))
    one = one.select("key", "i", "j", *[F.col(c).alias(f"a_{c}") for c in values])
    two = two.select("key", "i", "j", *[F.col(c).alias(f"b_{c}") for c in values])
    met = one.join(two, ["key", "i", "j"]).where(_may_link(percent))
    return met.select(F.least("a_vertex", "b_vertex").alias("a"), F.greatest("a_vertex", "b_vertex").alias("b"))


def _may_link(percent: int) -> Column:
    """What a pair of different components must fulfil before its sets are looked at."""
    a, b = F.col("a_n"), F.col("b_n")
    most = F.floor((100 - percent) * (a + b) / (100 + percent))
    away = F.lit(0)
    for k in range(COLD_WORDS + HOT_WORDS):
        away = away + F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}")))
    # within a cell, each pair comes in both orders
    once = (F.col("i") < F.col("j")) & (F.col("a_label") != F.col("b_label")) | (F.col("a_label") < F.col("b_label"))
    return once & (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.abs(F.col("a_cold") - F.col("b_cold")) <= most) & (away <= most)


def keep_representatives(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns: of each component the one row of its smallest id; rows without words all stay.

    Where several rows share that id, or none of a component has an id, one of them
    stays. Rows whose id is null or stands on other rows too are told apart by a
    stored key, so a row goes only if its own text is a copy.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    vague = scratch.save("vague", docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("rows")).where("rows > 1 OR id IS NULL").select(F.col("id").alias(id_col)))
    if vague.isEmpty():
        found = join_components(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
        lost = scratch.save("lost", found.where(F.col(id_col) != F.col("component_id")).select(id_col))
        return docs.join(_small(lost), id_col, "left_anti").select(docs.columns)
    row, key = free_name(docs, "row"), free_name(docs, "key")
    known, repeated = docs.where(F.col(id_col).isNotNull()), vague.where(F.col(id_col).isNotNull())
    single = known.join(_small(repeated), id_col, "left_anti").select(docs.columns)
    several = docs.where(F.col(id_col).isNull()).union(known.join(_small(repeated), id_col, "left_semi").select(docs.columns))
    several = scratch.save("several", several.withColumn(row, F.expr("uuid()")))

    def keyed(rows: DataFrame, own: Column) -> DataFrame:
        # by this key, rows with an id come first
        return rows.select(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), own.alias("row")).alias(key), text_col)

    found = join_components(keyed(single, F.lit("")).union(keyed(several, F.col(row))), id_col=key, text_col=text_col, shingle=shingle, percent=percent)
    lost = scratch.save("lost", found.where(F.col(key) != F.col("component_id")).select(F.col(key)["id"].alias(id_col), F.col(key)["row"].alias(row)))
    of_single = single.join(_small(lost.where(F.col(row) == "").select(id_col)), id_col, "left_anti")
    of_several = several.join(_small(lost.where(F.col(row) != "").select(row)), row, "left_anti")
    return of_single.select(docs.columns).union(of_several.select(docs.columns))
