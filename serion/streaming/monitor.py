"""Streaming forms of the monitor: bounded row buffers, tumbling windows with their late rows, dashboard refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from serion.functions import classify
from serion.operators import matching, series
from serion.sources.storage import delete

ROWS = 300
#: Rows that a task holds while it trims.
HELD = 1 << 18
#: Bytes of files that one micro-batch takes, one file at least.
BATCH_BYTES = 1 << 30


def _last_rows(t: pa.Table, rows: int) -> pa.Table:
    """The last ``rows`` rows of each key k in the order (o, v)."""
    t = t.sort_by([("k", "ascending"), ("o", "ascending"), ("v", "ascending")])
    code = pc.dictionary_encode(t["k"].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))
    return t.filter(pa.array(ends[np.searchsorted(ends, np.arange(len(code)), "right")] - np.arange(len(code)) <= rows)) if len(code) else t


def _trimmed(df: DataFrame, rows: int) -> DataFrame:
    """Of the rows (k, o, v) of each task no more than the last ``rows`` of each key: others are in no buffer."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = _last_rows(pa.concat_tables([held, new]) if held is not None else new, rows)
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return df.mapInArrow(task, df.schema)


def ring_buffers(stream: DataFrame, key: str, order: str, value: str, rows: int = ROWS) -> DataFrame:
    """(key, n, least, largest, mean) of each key's last ``rows`` rows, updated with every batch.

    The state of a key is its buffer, ``rows`` pairs at most, and each task sends no more
    of a key to it, however many rows the batch has. Rows that arrive late still take
    their place in the order; null values are dropped.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        o, v = (np.array(x, np.float64) for x in (state.get if state.exists else ([], [])))
        for f in frames:
            o, v = np.concatenate([o, f["o"].to_numpy()]), np.concatenate([v, f["v"].to_numpy()])
            last = np.lexsort((v, o))[-rows:]
            o, v = o[last], v[last]
        state.update((o.tolist(), v.tolist()))
        yield pd.DataFrame({"key": [k[0]], "n": [len(v)], "least": [v.min()], "largest": [v.max()], "mean": [v.sum() / len(v)]})

    kind = stream.schema[key].dataType.simpleString()
    rows_in = stream.where(F.col(value).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("k"), F.col(order).cast("double").alias("o"), F.col(value).cast("double").alias("v"))
    return _trimmed(rows_in, rows).groupBy("k").applyInPandasWithState(update, f"key {kind}, n long, least double, largest double, mean double", "o array<double>, v array<double>", "update", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, ts: str, value: str, width: str = "30 seconds", late: str | None = None) -> DataFrame:
    """(start, n, mean) per window of event time.

    A stream keeps the state of every window and counts all rows, in whatever order
    its files come. For a stream without end, ``late`` bounds the state: windows older
    than that are forgotten, and rows that come later still are dropped.
    """
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming and late is not None:
        rows = rows.withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", width).alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")


def windows_and_late(stream: DataFrame, ts: str, value: str, path: str, checkpoint: str, *, width_s: int = 30, late_s: int = 60, every: str | None = None) -> None:
    """Tumbling windows that close, and the rows that come after that, kept: nothing is dropped.

    A window closes when the latest time of all batches so far is ``late_s`` past its end.
    Under ``path``: ``closed/<batch>`` (start_us, n, total) of the windows that a batch
    closed, ``late/<batch>`` the batch's rows for windows closed before it, whole, and
    ``open/<batch>`` what is open after it (with the latest time so far), the only state,
    of which the last two versions stay. A batch that is run again, also after a restart
    from the checkpoint, writes its own versions again. Rows without a time are dropped.
    """
    spark = stream.sparkSession
    width, late = width_s * 1_000_000, late_s * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    start = F.floor(us / width).cast("long") * width
    state = "start_us long, n long, total double, latest long"

    def refresh(batch: DataFrame, k: int) -> None:
        held = spark.read.schema(state).parquet(f"{path}/open/{k - 1}") if k else spark.createDataFrame([], state)
        before = held.agg(F.max("latest")).first()[0]
        rows = batch.where(F.col(ts).isNotNull())
        past = F.lit(False) if before is None else start + width + late <= before
        rows.where(past).write.mode("overwrite").parquet(f"{path}/late/{k}")
        new = rows.groupBy(start.alias("start_us"), past.alias("past")).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"), F.max(us).alias("latest"))
        latest = F.lit(before).cast("long")
        both = held.withColumn("past", F.lit(False)).unionByName(new)
        # the newest time also counts if it came with a late row (it cannot be newer then) or with no value
        both = both.where(~F.col("past")).groupBy("start_us").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest"))
        both.write.mode("overwrite").parquet(f"{path}/all/{k}")
        both = spark.read.schema(state).parquet(f"{path}/all/{k}")
        now = both.agg(F.max(F.greatest("latest", latest))).first()[0]
        done = F.col("start_us") + width + late <= F.lit(now)
        both.where(done & F.col("n").isNotNull()).drop("latest").write.mode("overwrite").parquet(f"{path}/closed/{k}")
        # a row of no window carries the latest time on when no window is open
        mark = spark.createDataFrame([(None, None, None, now)] if now is not None else [], state)
        both.where(~done & F.col("start_us").isNotNull()).unionByName(mark).write.mode("overwrite").parquet(f"{path}/open/{k}")
        delete(spark, f"{path}/all/{k}")
        if k > 1:
            delete(spark, f"{path}/open/{k - 2}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresh)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def all_windows(spark: SparkSession, path: str, ts: str, value: str, width_s: int = 30) -> DataFrame:
    """(start_us, n, total, n_late) of what windows_and_late has so far: closed, open and late rows together."""
    width = width_s * 1_000_000
    # the newest state is the one of the highest batch
    opened = spark.read.parquet(f"{path}/open/*").withColumn("batch", F.element_at(F.split(F.input_file_name(), "/"), -2).cast("long"))
    last = F.broadcast(opened.agg(F.max("batch").alias("last")))  # one row
    opened = opened.join(last).where("batch = last AND start_us IS NOT NULL").select("start_us", "n", "total", F.lit(0).cast("long").alias("n_late"))
    closed = spark.read.parquet(f"{path}/closed/*").select("start_us", "n", "total", F.lit(0).cast("long").alias("n_late"))
    late = spark.read.parquet(f"{path}/late/*").groupBy((F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / width).cast("long") * width).alias("start_us"))
    late = late.agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"), F.count(value).alias("n_late"))
    return opened.unionByName(closed).unionByName(late).groupBy("start_us").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("n_late").alias("n_late"))


def _as_sessions(rows: DataFrame, us: Column, value: str, keys: tuple[str, ...], gap_s: float) -> DataFrame:
    """(keys, begin_us, end_us, n, total) of rows: their own sessions."""
    rows = rows.select(*keys, us.alias("end_us"), F.col(value).cast("double").alias("_value"))
    rows = matching.sessions(rows, "end_us", gap_s * 1_000_000, keys, "begin_us")
    return rows.groupBy(*keys, "begin_us").agg(F.max("end_us").alias("end_us"), F.count("_value").alias("n"), F.sum("_value").alias("total"))


def sessions_and_late(stream: DataFrame, ts: str, value: str, keys: tuple[str, ...], path: str, checkpoint: str, *, gap_s: int, late_s: int = 60, every: str | None = None) -> None:
    """Sessions of each key (rows no more than ``gap_s`` apart) that close, and the rows that come too late, kept: nothing is dropped.

    A session closes when the latest time of all batches so far is ``gap_s + late_s`` past
    its last row; rows ``late_s`` or more before the latest time of the batches before are late.
    Rows of a batch are first made sessions of their own, by chunks of time, so a hot key is
    no single task; these are merged with the open ones. Tables and restarts are as
    with windows_and_late: ``closed/<batch>``, ``late/<batch>`` and the state ``open/<batch>``.
    Rows without a time are dropped; null keys are a key.
    """
    spark = stream.sparkSession
    gap, late = gap_s * 1_000_000, late_s * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    kinds = "".join(f"`{c}` {stream.schema[c].dataType.simpleString()}, " for c in keys)
    state = f"{kinds}begin_us long, end_us long, n long, total double, latest long"

    def refresh(batch: DataFrame, k: int) -> None:
        held = spark.read.schema(state).parquet(f"{path}/open/{k - 1}") if k else spark.createDataFrame([], state)
        before = held.agg(F.max("latest")).first()[0]
        rows = batch.where(F.col(ts).isNotNull())
        past = F.lit(False) if before is None else us + late <= before
        rows.where(past).write.mode("overwrite").parquet(f"{path}/late/{k}")
        rows = rows.where(~past)
        new = _as_sessions(rows, us, value, keys, gap_s)
        merged = matching.merged_spans(new.unionByName(held.drop("latest")), "begin_us", "end_us", gap, keys, ("n", "total"))
        merged.write.mode("overwrite").parquet(f"{path}/all/{k}")
        merged = spark.read.schema(merged.schema).parquet(f"{path}/all/{k}")
        # the newest row is in an open session or in a new one; late rows are never the newest
        now = merged.agg(F.max(F.greatest("end_us", F.lit(before).cast("long")))).first()[0]
        now = before if now is None else now
        done = F.col("end_us") + gap + late <= F.lit(now).cast("long")
        merged.where(done).write.mode("overwrite").parquet(f"{path}/closed/{k}")
        # a row of no session carries the latest time on
        mark = spark.createDataFrame([(*[None] * (len(keys) + 4), now)] if now is not None else [], state)
        merged.where(~done).withColumn("latest", F.lit(now).cast("long")).unionByName(mark).write.mode("overwrite").parquet(f"{path}/open/{k}")
        delete(spark, f"{path}/all/{k}")
        if k > 1:
            delete(spark, f"{path}/open/{k - 2}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresh)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def all_sessions(spark: SparkSession, path: str, ts: str, value: str, keys: tuple[str, ...], gap_s: int) -> DataFrame:
    """(keys, begin_us, end_us, n, total) of what sessions_and_late has so far: closed, open and late rows merged as if none had been late."""
    parts = [*keys, "begin_us", "end_us", "n", "total"]
    opened = spark.read.parquet(f"{path}/open/*").withColumn("batch", F.element_at(F.split(F.input_file_name(), "/"), -2).cast("long"))
    last = F.broadcast(opened.agg(F.max("batch").alias("last")))  # one row
    opened = opened.join(last).where("batch = last AND begin_us IS NOT NULL").select(*parts)
    late = _as_sessions(spark.read.parquet(f"{path}/late/*"), F.unix_micros(F.col(ts).cast("timestamp")), value, keys, gap_s)
    every = spark.read.parquet(f"{path}/closed/*").select(*parts).unionByName(opened).unionByName(late)
    return matching.merged_spans(every, "begin_us", "end_us", gap_s * 1_000_000, keys, ("n", "total"))


def run_to_end(df: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works off all that a source has now, batch by batch."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def dashboard(buffer: DataFrame, bins: int = 20) -> dict[str, DataFrame]:
    """What one refresh shows of a retained buffer (elapsed_s, temp_c, cpu_pct): current values, statistics, histogram."""
    known = buffer.where(F.col("temp_c").isNotNull())
    now = known.orderBy(F.desc("elapsed_s")).limit(1)
    return {
        "current": now.select("elapsed_s", "temp_c", "cpu_pct", classify.temperature_class(F.col("temp_c")).alias("temp_class"), classify.load_class(F.col("cpu_pct")).alias("cpu_class"), classify.gauge_angle(F.col("cpu_pct")).alias("angle")),
        "stats": known.agg(F.min("temp_c").alias("least"), F.max("temp_c").alias("largest"), F.avg("temp_c").alias("mean")),
        "histogram": series.histogram(known, "temp_c", bins).withColumn("class", classify.temperature_class(F.col("left"))),
    }


def live_dashboard(stream: DataFrame, show: Callable[[dict[str, DataFrame], int], None], checkpoint: str, path: str, *, rows: int = ROWS, bins: int = 20, every: str | None = None) -> None:
    """Refreshes the dashboard with every micro-batch of samples (elapsed_s, temp_c, cpu_pct).

    The retained buffer, the last ``rows`` samples with a temperature, is a table under
    ``path``, one version per batch, of which the last two stay; a batch that is run again
    reads the version before its own and writes its own again, so with that one missing the
    stream fails. Fewer than two retained samples give no dashboard. every: the interval of an endless
    run (the query is returned to no one and runs until it is stopped); without it, what
    the source has now is worked off.
    """
    spark = stream.sparkSession
    kept = stream.where(F.col("temp_c").isNotNull()).select("elapsed_s", "temp_c", "cpu_pct")
    shape = kept.schema

    def refresh(batch: DataFrame, k: int) -> None:
        held = spark.read.schema(shape).parquet(f"{path}/{k - 1}") if k else spark.createDataFrame([], shape)
        last = held.union(batch).orderBy(F.desc("elapsed_s"), "temp_c", "cpu_pct").limit(rows)
        last.write.mode("overwrite").parquet(f"{path}/{k}")
        now = spark.read.schema(shape).parquet(f"{path}/{k}")
        if now.limit(2).count() == 2:
            show(dashboard(now, bins), k)
        if k > 1:
            delete(spark, f"{path}/{k - 2}")

    writer = kept.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresh)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def read_files(spark: SparkSession, path: str, schema: Any, per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files, BATCH_BYTES to a micro-batch, or ``per_batch`` files."""
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", per_batch) if per_batch else source.option("maxBytesPerTrigger", BATCH_BYTES)
    return source.parquet(path)
