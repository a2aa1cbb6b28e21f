"""Operator 11: importance resampling towards a target distribution, by external sort-count.

Method. The features of a text, all runs of 1 to ``max_words`` consecutive words,
fall into hashed buckets. Each slice of texts is written as one packed stream of
16-bit bucket numbers with the offset of every text in it. For the counts, each
slice's stream is sorted and run-length encoded, the runs of a task are added up and
Spark sums them by bucket. A bucket's gain is the log ratio of its smoothed shares in
the target and in the corpus; the written streams are then read once more, gains are
gathered by bucket and added up per text by ``np.add.reduceat``. A text's score is
its mean gain and a Gumbel term of its id, so the highest scores are a draw without
replacement. The draw's least score comes from the counts of scores (some tens of
thousands of values at any size); only texts from there on are put in order, by
ranges of (score, id), and numbered range by range.

Per-bucket tables have ``buckets`` rows (65536 at most) and are all that reaches the
driver or every task. Nothing is shuffled by bucket but a row per bucket and task.

Defined cases: a null or empty text has no features, weight 0, and is never drawn
(nor is any text of fewer than ``min_words`` words); a null id is the empty text in
the Gumbel term and comes after all other ids among equal scores; repeated rows are
drawn one by one; an empty target or corpus gives every bucket its smoothed gain; of
no texts none are drawn. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serion.llm.storage import Scratch
from serion.llm.words import NOT_ALNUM, slices, words

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"
#: Words of more bytes go through zlib one by one.
LONG_WORD = 64
_ALL = 0xFFFFFFFF


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each span's bytes, carried on from the crc32 values ``state``."""
    out, size = state.astype(np.uint32) ^ np.uint32(_ALL), end - start
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]], int(out[i]) ^ _ALL) ^ _ALL
    order = np.argsort(size, kind="stable")
    order = order[: np.searchsorted(size[order], LONG_WORD, "right")]
    sizes, register, at = size[order], out[order], start[order]
    for j in range(int(sizes[-1]) if len(sizes) else 0):
        k = np.searchsorted(sizes, j, "right")  # words of more than j bytes
        register[k:] = _CRC[(register[k:] ^ data[at[k:] + j]) & 255] ^ (register[k:] >> np.uint32(8))
    out[order] = register
    return out ^ np.uint32(_ALL)


def bucket_stream(at: np.ndarray, data: np.ndarray, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream of 16-bit buckets, first feature of each text and the end, words of each text) of a slice."""
    w = words(at, data, NOT_ALNUM)
    row, n = w.row(), len(w.start)
    crc, space = np.zeros(n, np.uint32), np.array([0x20], np.uint8)
    found, rows = [], []
    for k in range(max_words):
        m = max(n - k, 0)
        if k:  # a space, then the next word
            crc = crc_spans(space, np.zeros(m, np.int64), np.ones(m, np.int64), crc[:m])
        crc = crc_spans(w.data, w.start[k:], w.end[k:], crc[:m])
        inside = row[:m] == row[k:]
        found.append((crc % np.uint32(buckets)).astype(np.uint16)[inside])
        rows.append(row[:m][inside])
    stream, of = np.concatenate(found), np.concatenate(rows)
    if max_words > 1:
        stream = stream[np.argsort(of, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(at) - 1))])
    return stream, first.astype(np.int32), np.diff(w.bounds).astype(np.int32)


def write_streams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per slice of texts: ids, words per text, offsets (one more than texts) and the packed stream."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, at, data in slices(b.column(1)):
                stream, first, n = bucket_stream(at, data, max_words, buckets)
                row = [pa.array([b.column(0).slice(a, z - a).to_pylist()], pa.list_(b.column(0).type)), pa.array([n], pa.list_(pa.int32())), pa.array([first], pa.list_(pa.int32())), pa.array([stream.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["ids", "words", "first", "stream"])

    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket number has 16 bits")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"ids array<{kind}>, words array<int>, first array<int>, stream binary")


def _stream(b: pa.RecordBatch, k: int) -> np.ndarray:
    return np.frombuffer(b.column(b.schema.get_field_index("stream"))[k].as_buffer(), np.uint16)


def count_buckets(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: every stream sorted and run-length encoded, runs added up by task, then by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                s = np.sort(_stream(b, k))
                opens = np.flatnonzero(np.diff(s, prepend=s[:1] ^ 1)) if len(s) else np.zeros(0, np.int64)
                total[s[opens]] += np.diff(opens, append=len(s))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = streams.select("stream").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket
    out = np.zeros(buckets, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, in thousandths, rounded down."""
    buckets, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight, tie) of every text; tie tells rows of equal ids apart, alike on every run."""
    kind = streams.schema["ids"].dataType.elementType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                stream = _stream(b, k)
                ids, n_words, first = (b.column(b.schema.get_field_index(c))[k].values for c in ("ids", "words", "first"))
                first = first.to_numpy().astype(np.int64)
                n = np.diff(first)
                there = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(there):
                    weight[there] = np.add.reduceat(gain[stream], first[there]) // n[there]
                tie = (zlib.crc32(stream) << 31) + np.arange(len(n))
                yield pa.RecordBatch.from_arrays([ids, n_words.cast(pa.int64()), pa.array(n), pa.array(weight), pa.array(tie)], ["id", "n_words", "n_features", "weight", "tie"])

    return streams.select("ids", "words", "first", "stream").mapInArrow(task, f"id {kind}, n_words long, n_features long, weight long, tie long")


def _gumbel(seed: str):
    """-1000 ln(-ln(u)), u from the first 32 bits of sha256(seed:id), rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_words: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every text of docs; rank counts the drawn ones from 1, others have none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    streams = scratch.save("streams", write_streams(docs, id_col=id_col, text_col=text_col, max_words=max_words, buckets=buckets))
    wanted = write_streams(target.withColumn("_none", F.lit(0)), id_col="_none", text_col=target_col, max_words=max_words, buckets=buckets)
    gain = gains(count_buckets(streams, buckets), count_buckets(wanted, buckets))
    scored = scratch.save("scored", weigh(streams, gain).withColumn("score", F.col("weight") + _gumbel(seed)))
    scratch.drop("streams")

    able = F.col("n_words") >= min_words
    counts = sorted(scored.where(able).groupBy("score").count().collect(), reverse=True)  # a row per value of the score
    draw = percent * sum(r["count"] for r in counts) // 100
    least, above = None, 0
    for score, n in counts:
        if above >= draw:
            break
        least, above = score, above + n
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))

    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("tie")]
    first = scored.where(able & (F.col("score") >= least)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    first = scratch.save("first", first.withColumn("at", F.monotonically_increasing_id()))  # range << 33, place in the range
    sizes, before, total = sorted(first.groupBy(F.shiftright("at", 33).alias("range")).count().collect()), [], 0  # a row per range
    for of, n in sizes:
        before.append((of, total))
        total += n
    before = F.broadcast(spark.createDataFrame(before, "range long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = first.withColumn("range", F.shiftright("at", 33)).join(before, "range").withColumn("rank", rank)
    ranked = ranked.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~(able & (F.col("score") >= least))).select(*columns, F.lit(None).cast("long").alias("rank")))
