"""A sink of whole runs: tasks write files, the driver publishes a manifest, readers see what is published.

``df.write.format("serion_runs").option("path", p).option("run", name).mode("append").save()``
writes one run; a stream writes one run per micro-batch (``name-00000007``). Tasks stream
their Arrow batches into Parquet files of names of their own. Only when all are done does
the driver put one manifest into place, by a rename: a run is there as a whole or not at
all. A task that fails deletes its file, an aborted job those of its finished tasks; what
a lost executor leaves is in no manifest (``vacuum`` deletes it).

Modes: "append" refuses the name of a published run (a stream takes it for the same batch
run again and leaves the published one); "overwrite" publishes in its place, and the old
run is read until then. An empty DataFrame makes an empty run. Schemas of runs may differ
in columns that are added; readers get the union, nulls where a run has none.

The path is any that ``pyarrow.fs.FileSystem.from_uri`` opens (file, hdfs, s3, gcs) or an
absolute local one; driver and executors must share it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "serion_runs"
#: Column by which rows of a run can be counted in ranges, if the option ``ranges`` names one.
Ranges = list[list[int]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def merged(ranges: Ranges) -> Ranges:
    """Closed ranges of whole numbers in order, those that touch made one."""
    out: Ranges = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _ranges(numbers: list[int]) -> Ranges:
    return merged([[n, n] for n in numbers])


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    ranges: Ranges


class _Files:
    """What batch and stream writers share."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.run, self.counted = options["path"], options["run"], options.get("ranges")
        self.schema = schema.json()
        if not self.run or "/" in self.run or self.run.startswith("."):
            raise ValueError(f"{self.run!r} is no name of a run")

    def write_file(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = _open(self.path)
        name, rows, writer, numbers = f"{self.run}-{uuid.uuid4().hex}.parquet", 0, None, set()
        store.create_dir(f"{base}/data", recursive=True)
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if writer is None:
                    writer = pq.ParquetWriter(store.open_output_stream(f"{base}/data/{name}"), b.schema)
                writer.write_batch(b)
                rows += b.num_rows
                if self.counted:
                    numbers.update(b.column(b.schema.get_field_index(self.counted)).unique().to_pylist())
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.close()
                self._delete([name])
            raise
        return Written(name if rows else None, rows, _ranges(sorted(n for n in numbers if n is not None)))

    def _delete(self, files: list[str | None]) -> None:
        store, base = _open(self.path)
        for f in files:
            if f is not None:
                try:
                    store.delete_file(f"{base}/data/{f}")
                except FileNotFoundError:
                    pass

    def publish(self, run: str, messages: list[Written], replace: bool, again: bool = False) -> None:
        store, base = _open(self.path)
        store.create_dir(f"{base}/runs", recursive=True)
        target = f"{base}/runs/{run}.json"
        if not replace and store.get_file_info(target).type != fs.FileType.NotFound:
            self._delete([m.file for m in messages])
            if again:
                return
            raise FileExistsError(f"run {run} is published")
        told = {"run": run, "published_us": time.time_ns() // 1000, "rows": sum(m.rows for m in messages), "files": sorted(m.file for m in messages if m.file), "schema": self.schema, "ranges": merged([r for m in messages for r in m.ranges])}
        part = f"{base}/runs/.{run}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps(told).encode())
        store.move(part, target)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.files, self.overwrite = _Files(options, schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.files.write_file(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.files.publish(self.files.run, [m for m in messages if m is not None], self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.files._delete([m.file for m in messages if m is not None])


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.files = _Files(options, schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.files.write_file(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self.files.publish(f"{self.files.run}-{batchId:08d}", [m for m in messages if m is not None], False, again=True)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self.files._delete([m.file for m in messages if m is not None])


class RunSink(DataSource):
    """The data source ``serion_runs``; it only writes (see read_runs)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        raise NotImplementedError("runs are read by read_runs")

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:  # noqa: N802
        return _StreamWriter(dict(self.options), schema)


def write_run(df: DataFrame, path: str, run: str, *, replace: bool = False, ranges: str | None = None) -> None:
    """Publishes df as one run. ranges: a whole-number column whose values the manifest lists in ranges."""
    df.sparkSession.dataSource.register(RunSink)
    out = df.write.format(NAME).option("path", path).option("run", run).mode("overwrite" if replace else "append")
    (out.option("ranges", ranges) if ranges else out).save()


def write_runs(stream: DataFrame, path: str, run: str, checkpoint: str, every: str | None = None) -> None:
    """Publishes each micro-batch of a stream as a run; without ``every`` what the source has now."""
    stream.sparkSession.dataSource.register(RunSink)
    out = stream.writeStream.format(NAME).option("path", path).option("run", run).option("checkpointLocation", checkpoint)
    (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start().awaitTermination()


def manifests(path: str, prefix: str = "") -> list[dict]:
    """The published runs whose names begin with the prefix, the oldest first."""
    store, base = _open(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/runs", allow_not_found=True))
    out = []
    for f in found:
        if f.base_name.startswith(prefix) and f.base_name.endswith(".json") and not f.base_name.startswith("."):
            with store.open_input_stream(f.path) as text:
                out.append(json.loads(text.read()))
    return sorted(out, key=lambda m: (m["published_us"], m["run"]))


def read_runs(spark: SparkSession, path: str, prefix: str = "", *, latest: bool = False) -> DataFrame:
    """Rows of the published runs (latest: of the one published last) and the name of each one's run, ``run``."""
    told = manifests(path, prefix)
    told = told[-1:] if latest else told
    if not told:
        raise FileNotFoundError(f"no run {prefix}* in {path}")
    schema = StructType()
    for m in told:
        for f in StructType.fromJson(json.loads(m["schema"])):
            if f.name not in schema.names:
                schema.add(f.name, f.dataType, True)
    if "run" in schema.names:
        raise ValueError("the runs have a column named run")
    base = path.rstrip("/")
    files = [f"{base}/data/{f}" for m in told for f in m["files"]]
    if not files:
        return spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))
    # <run>-<32 hex digits>.parquet; a stream's runs add their batch's number
    of = spark.createDataFrame([(f, m["run"]) for m in told for f in m["files"]], "_file string, run string")
    rows = spark.read.schema(schema).parquet(*files).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.join(of, "_file").drop("_file")


def vacuum(path: str, older_than_s: float = 24 * 3600) -> int:
    """Deletes data files that no manifest lists and that are older; returns how many."""
    store, base = _open(path)
    listed = {f for m in manifests(path) for f in m["files"]}
    old = time.time() - older_than_s
    gone = [f for f in store.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)) if f.base_name not in listed and f.mtime.timestamp() <= old]
    for f in gone:
        store.delete_file(f.path)
    return len(gone)


def publish_snapshots(rows: DataFrame, path: str, run: str, every: int = 100, number: str = "n") -> None:
    """Adds the whole snapshots that are not published yet; snapshot k holds the rows number k * every + 1 .. (k + 1) * every.

    A snapshot that lacks rows waits for a later run that has them all; published ones
    are never touched. Rows without a number are left out.
    """
    known = merged([r for m in manifests(path) for r in m["ranges"]])
    new = F.lit(True)
    for a, b in known:  # ranges that touch are one: few, however many runs there were
        new = new & ~F.col("snapshot").between(a, b)
    dealt = rows.where(F.col(number).isNotNull()).withColumn("snapshot", F.floor((F.col(number) - 1) / every).cast("long")).where(new)
    whole = dealt.groupBy("snapshot").agg(F.count_distinct(number).alias("_rows")).where(F.col("_rows") == every).select("snapshot")
    write_run(dealt.join(whole, "snapshot").select(*rows.columns, "snapshot"), path, run, ranges="snapshot")
