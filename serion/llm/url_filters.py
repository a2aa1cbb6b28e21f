"""Operator 6: URL filters with path rules and a Bloom filter cascade.

Method. The cascade encodes a list of blocked host keys against the corpus's
complete key universe (all hosts of the corpus and their parent domains). Level 1
is a Bloom filter of the listed keys; level 2 one of the universe's keys that
level 1 wrongly accepts; level 3 one of the listed keys that level 2 wrongly
accepts; and so on until no key is wrong. A key is listed if the first level that
rejects it is even, or if an odd number of levels all accept it: exact for every
key of the universe, without a join.

Keys are 64-bit hashes of the strings; a host and its parents are hashed from one
running sum, so a host of any number of labels takes linear time. (A universe of U
keys and L listed ones hold a wrong pair of equal hashes with chance U * L / 2**64.)

The key space is cut into ranges of about RANGE_KEYS keys. Each range has a cascade
of its own, built by one task from the range's part of list and universe; its first
level's error rate is set so that about as many keys pass wrongly as are listed, so
a cascade takes a few bits per listed key. Urls are judged against the cascades of
PASS_BYTES at a time, which are broadcast; a longer list takes more passes over the
urls, each written and read again. So neither a task, the driver nor a broadcast
grows with list or universe.

Rules (allow or block, host and path prefix) come first: the longest that fits
the host or a parent of it and the start of the path decides.

Defined cases: a null url or one without ``://`` has empty host and path, fits no
rule and is allowed; hosts are lower-cased in A-Z only; an empty corpus or list
allows what no rule blocks; null and empty listed hosts are ignored; repeated rows
are judged alike; other columns pass untouched.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serion.llm.storage import Scratch
from serion.llm.words import mix, slices, span_hashes

#: Keys of list and universe together that one cascade covers (16 bytes each in its task).
RANGE_KEYS = 4_000_000
#: Bytes of cascades that are broadcast at once, unless a single one is larger.
PASS_BYTES = 64 << 20
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PathRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules and the blocked hosts of the registered query.
RULES = (
    PathRule("org", "/", "allow"),
    PathRule("example.org", "/es/", "block"),
    PathRule("example.org", "/en/1", "block"),
    PathRule("com", "/fr/", "allow"),
    PathRule("com", "/de/", "block"),
)
BLOCKED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "casino-win.example.net", "free-bets.example.net", "ads-track.example.com", "adult-x.example.com")


class Bloom(NamedTuple):
    bits: np.ndarray
    hashes: int
    seed: int

    def _places(self, keys: np.ndarray):
        size = np.uint64(len(self.bits) * 8)
        a = mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (self.seed + 1) % (1 << 64)))
        b = mix(a) | np.uint64(1)
        for k in range(self.hashes):
            yield (a + np.uint64(k) * b) % size

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self._places(keys):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom(keys: np.ndarray, rate: float, seed: int) -> Bloom:
    hashes = max(1, round(-math.log2(rate)))
    size = max(1, math.ceil(len(keys) * hashes / math.log(2) / 8))
    out = Bloom(np.zeros(size, np.uint8), hashes, seed)
    for p in out._places(keys):
        np.bitwise_or.at(out.bits, p >> np.uint64(3), (1 << (p & np.uint64(7))).astype(np.uint8))
    return out


def listed_by(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Membership by the cascade."""
    out, open_ = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    for k, level in enumerate(levels):
        passed = level.has(keys)
        out[open_ & ~passed] = k % 2 == 1
        open_ &= passed
    out[open_] = len(levels) % 2 == 1
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER_CASE), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domain_keys(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each host of a slice and of all its parent domains, and the first key of each host (and the end)."""
    dots = np.flatnonzero(data == 46) + 1
    start = np.sort(np.concatenate([at[:-1][np.diff(at) > 0], dots]))
    row = np.searchsorted(at, start, "right") - 1
    end = at[np.minimum(row + 1, len(at) - 1)]
    inside = np.ones(len(start), bool)
    inside[1:] = start[1:] != start[:-1]  # a dot may end the host before
    inside &= start < len(data)
    start, row, end = start[inside], row[inside], end[inside]
    return span_hashes(data, start, end), np.searchsorted(row, np.arange(len(at)))


def _whole_keys(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    there = np.flatnonzero(np.diff(at))
    return span_hashes(data, at[:-1][there], at[1:][there])


def _keys(hosts: DataFrame, parents: bool) -> DataFrame:
    """(key): the distinct keys of a one-column table of hosts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, at, data in slices(b.column(0)):
                keys = np.unique(domain_keys(at, data)[0] if parents else _whole_keys(at, data))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return hosts.mapInArrow(task, "key long").distinct()


def build_cascade(universe: np.ndarray, listed: np.ndarray) -> list[Bloom]:
    """Levels that tell the keys of ``listed`` from the other keys of ``universe`` (both distinct; listed in universe)."""
    if not len(listed):
        return []
    inside, outside = listed, np.setdiff1d(universe, listed, assume_unique=True)
    rate = min(0.5, max(1e-9, len(listed) / max(len(outside), 1)))
    levels: list[Bloom] = []
    while len(inside):
        levels.append(bloom(inside, rate, len(levels)))
        inside, outside, rate = outside[levels[-1].has(outside)], inside, 0.5
    return levels


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def build_cascades(universe: DataFrame, listed: DataFrame, ranges: int) -> DataFrame:
    """(range, bytes, cascade) of the ranges that hold listed keys; both inputs: one column of distinct keys."""
    tagged = universe.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True).alias("listed")))
    place = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(ranges), 32)

    def task(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_numpy().astype(np.int64).view(np.uint64)
        flag = t.column("listed").to_numpy(zero_copy_only=False).astype(bool)
        there = keys[~flag]
        levels = build_cascade(there, np.intersect1d(keys[flag], there, assume_unique=True))
        if not levels:
            return pa.table({"range": pa.array([], pa.int64()), "bytes": pa.array([], pa.int64()), "cascade": pa.array([], pa.binary())})
        packed = pickle.dumps(levels)
        return pa.table({"range": [t.column("range")[0].as_py()], "bytes": [len(packed)], "cascade": pa.array([packed], pa.binary())})

    return tagged.withColumn("range", place).groupBy("range").applyInArrow(task, "range long, bytes long, cascade binary")


def judge_urls(pages: DataFrame, blocked: DataFrame, *, url_col: str = "url", blocked_col: str = "host", rules: tuple[PathRule, ...] = RULES, out: str = "url_filter") -> DataFrame:
    """pages and a struct column ``out``: host, path, rule, listed, verdict. blocked: a table of hosts."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = split_url(F.col(url_col))
    universe = scratch.save("universe", _keys(pages.select(host.alias("h")).distinct(), True))
    named = blocked.select(F.translate(F.col(blocked_col), UPPER, LOWER_CASE).alias("h")).where("h <> ''").distinct()
    listed = scratch.save("listed", _keys(named, False))
    ranges = max(1, -(-(universe.count() + listed.count()) // RANGE_KEYS))
    cascades = scratch.save("cascades", build_cascades(universe, listed, ranges))
    scratch.drop("universe", "listed")
    rows = pages.withColumn(out, F.struct(host.alias("host"), path.alias("path"), F.lit(False).alias("listed")))
    h, p, found = F.col(out)["host"], F.col(out)["path"], F.col(out)["listed"]
    passes: list[list[int]] = []
    size = PASS_BYTES
    for k, n in cascades.select("range", "bytes").orderBy("range").collect():  # a row per RANGE_KEYS keys
        if size + n > PASS_BYTES:
            passes.append([])
            size = 0
        passes[-1].append(k)
        size += n
    for k, held in enumerate(passes):
        if k:
            rows = scratch.save(f"rows{k}", rows)
        packed = cascades.where(F.col("range").between(held[0], held[-1])).select("range", "cascade").collect()
        rows = rows.withColumn(out, F.col(out).withField("listed", found | _any_listed(spark, {r: c for r, c in packed}, ranges)(h)))
    return _verdict(rows, h, p, found, rules, out)


def _any_listed(spark, packed: dict[int, bytearray], ranges: int):
    """Whether a host or a parent of it is in one of some ranges' cascades."""
    shared = spark.sparkContext.broadcast({r: pickle.loads(bytes(c)) for r, c in packed.items()})

    @F.arrow_udf("boolean")
    def any_listed(hosts: pa.Array) -> pa.Array:
        out = np.zeros(len(hosts), bool)
        for a, z, at, data in slices(hosts):
            keys, first = domain_keys(at, data)
            place = _range_of(keys, ranges)
            hit = np.zeros(len(keys), bool)
            for r in np.unique(place).tolist():
                if levels := shared.value.get(r):
                    mine = np.flatnonzero(place == r)
                    hit[mine] = listed_by(levels, keys[mine])
            sums = np.concatenate([[0], np.cumsum(hit)])
            out[a:z] = sums[first[1:]] > sums[first[:-1]]
        return pa.array(out)

    return any_listed


def _verdict(df: DataFrame, h: Column, p: Column, listed: Column, rules: tuple[PathRule, ...], out: str) -> DataFrame:
    rule, verdict = F.lit(None).cast("string"), F.when(listed, F.lit("block")).otherwise(F.lit("allow"))
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return df.withColumn(out, F.struct(h.alias("host"), p.alias("path"), rule.alias("rule"), listed.alias("listed"), verdict.alias("verdict")))
