"""The sink of whole runs, snapshots over several runs, windows that keep late rows, numbers read back."""

import os
import random

import pytest
from pyspark.sql import functions as F

from serion.operators import points
from serion.sources import runs, tables, tokens
from serion.streaming import monitor


def _files(path):
    return sorted(os.listdir(f"{path}/data")) if os.path.isdir(f"{path}/data") else []


def test_runs_are_whole(spark, tmp_path):
    path = str(tmp_path / "r")
    runs.write_run(spark.range(100).repartition(3), path, "T500_1")
    runs.write_run(spark.range(5).withColumn("more", F.lit("x")), path, "T500_2")
    runs.write_run(spark.range(0), path, "T20_1")
    assert [(m["run"], m["rows"]) for m in runs.manifests(path)] == [("T500_1", 100), ("T500_2", 5), ("T20_1", 0)]
    assert runs.read_runs(spark, path).groupBy("run", "more").count().orderBy("run").collect() == [("T500_1", None, 100), ("T500_2", "x", 5)]
    assert runs.read_runs(spark, path, "T500_", latest=True).count() == 5
    assert runs.read_runs(spark, path, "T20_").count() == 0
    with pytest.raises(FileNotFoundError):
        runs.read_runs(spark, path, "T1000_")
    before = _files(path)
    with pytest.raises(Exception, match="is published"):
        runs.write_run(spark.range(7), path, "T500_2")
    assert _files(path) == before  # a refused run leaves no file
    runs.write_run(spark.range(7), path, "T500_2", replace=True)
    assert runs.read_runs(spark, path, "T500_2").count() == 7
    assert len(_files(path)) > len(set(_files(path)) - set(before))
    assert runs.vacuum(path, -1) == 1 or runs.vacuum(path, -1) == 0
    assert {f for m in runs.manifests(path) for f in m["files"]} == set(_files(path))
    with pytest.raises(Exception, match="no name"):
        runs.write_run(spark.range(1), path, "a/b")


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    runs.write_run(spark.range(10), path, "first")
    before = _files(path)

    def fails(batches):
        import pyarrow as pa

        for b in batches:
            yield b.slice(0, 1)
            if 77 in b.column(0).to_pylist():
                raise RuntimeError("broken row")
            yield pa.RecordBatch.from_arrays(b.slice(1).columns, b.schema.names)

    with pytest.raises(Exception, match="broken row"):
        runs.write_run(spark.range(0, 100, 1, 4).mapInArrow(fails, "id long"), path, "second")
    assert _files(path) == before
    assert [m["run"] for m in runs.manifests(path)] == ["first"]
    assert not [x for x in os.listdir(f"{path}/runs") if x.startswith(".")]


def test_a_later_run_only_adds_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda a, z, mark: spark.range(a, z + 1).select(F.col("id").alias("n"), F.lit(mark).alias("mark"))
    have = lambda: {(r.snapshot, r.mark): r["count"] for r in tables.read_snapshots(spark, path).groupBy("snapshot", "mark").count().collect()}
    tables.write_snapshots(rows(1, 150, "a"), path, "one")
    assert have() == {(0, "a"): 100}
    tables.write_snapshots(rows(200, 350, "b"), path, "two")  # of snapshot 1 there is one row only: it waits
    assert have() == {(0, "a"): 100, (2, "b"): 100}
    tables.write_snapshots(rows(1, 420, "c"), path, "three")
    assert have() == {(0, "a"): 100, (1, "c"): 100, (2, "b"): 100, (3, "c"): 100}
    tables.write_snapshots(rows(1, 420, "d"), path, "four")
    assert len(have()) == 4
    assert runs.merged([[5, 6], [0, 2], [3, 3], [7, 9]]) == [[0, 3], [5, 9]]


def test_a_stream_publishes_its_batches(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: monitor.read_files(spark, str(tmp_path / "in"), "id long", 2)
    runs.write_runs(stream(), str(tmp_path / "out"), "live", str(tmp_path / "state"))
    first = [m["run"] for m in runs.manifests(str(tmp_path / "out"))]
    assert first[0] == "live-00000000"
    assert runs.read_runs(spark, str(tmp_path / "out")).count() == 30
    spark.range(30, 40).write.mode("append").parquet(str(tmp_path / "in"))
    runs.write_runs(stream(), str(tmp_path / "out"), "live", str(tmp_path / "state"))
    assert sorted(r.id for r in runs.read_runs(spark, str(tmp_path / "out")).collect()) == list(range(40))


@pytest.mark.parametrize("restart", [False, True])
def test_windows_and_late_rows_are_all_rows(spark, tmp_path, restart):
    """Files in shuffled order: many rows come after their window closed, and none is lost."""
    pick = random.Random(2)
    times = [pick.randrange(3000) for _ in range(400)]
    pick.shuffle(times)
    path, shape = str(tmp_path / "in"), "ts timestamp, v double"

    def add(part):
        for k in range(0, len(part), 50):
            spark.createDataFrame([(t, float(t % 7) if t % 5 else None) for t in part[k : k + 50]], "s long, v double").select(F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(path)

    def run():
        monitor.windows_and_late(monitor.read_files(spark, path, shape, 1), "ts", "v", str(tmp_path / "out"), str(tmp_path / "state"), late_s=200)

    if restart:
        add(times[:200])
        run()
        add(times[200:])
    else:
        add(times)
    run()
    got = {r.start_us // 1_000_000: (r.n, r.total) for r in monitor.all_windows(spark, str(tmp_path / "out"), "ts", "v").collect()}
    want = {}
    for t in times:
        n, total = want.get(t // 30 * 30, (0, None))
        want[t // 30 * 30] = (n + 1, (total or 0.0) + t % 7) if t % 5 else (n, total)
    assert got == want
    late = sum(r.n_late for r in monitor.all_windows(spark, str(tmp_path / "out"), "ts", "v").collect())
    assert 0 < late < 400
    assert len([x for x in os.listdir(tmp_path / "out/open") if x.isdigit()]) == 2


@pytest.mark.parametrize("restart", [False, True])
def test_sessions_and_late_rows_are_all_rows(spark, tmp_path, restart):
    """Shuffled files: late rows join, bridge and precede closed sessions, and together they are the sessions of the whole table."""
    pick = random.Random(3)
    rows = [(pick.choice([1, 1, 1, 2, None]), pick.randrange(6000), float(i % 7) if i % 5 else None) for i in range(240)]
    path, shape = str(tmp_path / "in"), "k int, ts timestamp, v double"

    def add(part):
        for i in range(0, len(part), 60):
            spark.createDataFrame(part[i : i + 60], "k int, s long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(path)

    def run():
        monitor.sessions_and_late(monitor.read_files(spark, path, shape, 1), "ts", "v", ("k",), str(tmp_path / "out"), str(tmp_path / "state"), gap_s=40, late_s=2000)

    add(rows[:120] if restart else rows)
    run()
    if restart:
        add(rows[120:])
        run()
    want = []
    for key in (1, 2, None):
        for s, v in sorted(((s, v) for k, s, v in rows if k == key), key=lambda r: r[0]):
            if not want or want[-1][0] != key or s - want[-1][2] > 40:
                want.append([key, s, s, 0, None])
            want[-1][2] = s
            if v is not None:
                want[-1][3:] = [want[-1][3] + 1, (want[-1][4] or 0.0) + v]
    got = monitor.all_sessions(spark, str(tmp_path / "out"), "ts", "v", ("k",), 40).collect()
    assert sorted(([r.k, r.begin_us // 1_000_000, r.end_us // 1_000_000, r.n, r.total] for r in got), key=str) == sorted(want, key=str)
    assert 0 < spark.read.parquet(str(tmp_path / "out/late/*")).count() < 240
    assert 0 < spark.read.parquet(str(tmp_path / "out/closed/*")).count()
    assert len([x for x in os.listdir(tmp_path / "out/open") if x.isdigit()]) == 2


def test_points_written_are_read_back(spark, tmp_path):
    got = points.evaluate(tables.points(spark, ((2.0, 0.0), (0.5, 14.1347), (3.0, -2.5))))
    tables.write_points(got, str(tmp_path / "p"))
    text = spark.read.csv(str(tmp_path / "p"), header=True).select("s")
    text.write.text(str(tmp_path / "n"))
    back = tables.read_numbers(spark, str(tmp_path / "n"))
    assert {(r.s.re, r.s.im) for r in back.collect()} == {(2.0, 0.0), (0.5, 14.1347), (3.0, -2.5)}
    (tmp_path / "odd.txt").write_text("(1+2j) (3) ((4)) (x) NaN")
    assert [(r.token, r.s and (r.s.re, r.s.im)) for r in tables.read_numbers(spark, str(tmp_path / "odd.txt")).collect()] == [("(1+2j)", (1.0, 2.0)), ("(3)", (3.0, 0.0)), ("((4))", None), ("(x)", None), ("NaN", None)]


def test_tokens_with_rejects(spark):
    text = "1,2 abc\n(0.5+14j)\t-j () nan\n\n +Inf 1e3i 0j x)"
    got = tokens.with_tokens(spark.createDataFrame([(1, text), (2, None), (3, " , ")], "i int, t string"), "t").orderBy("line", "field").collect()
    want = [
        (1, 1, "1", "real", 1.0, 0.0, None), (1, 2, "2", "real", 2.0, 0.0, None), (1, 3, "abc", "skipped", None, None, "no number"),
        (2, 1, "(0.5+14j)", "complex", 0.5, 14.0, None), (2, 2, "-j", "complex", 0.0, -1.0, None), (2, 3, "()", "skipped", None, None, "nothing in parentheses"), (2, 4, "nan", "skipped", None, None, "name of a number"),
        (4, 1, "+Inf", "skipped", None, None, "name of a number"), (4, 2, "1e3i", "complex", 0.0, 1000.0, None), (4, 3, "0j", "real", 0.0, 0.0, None), (4, 4, "x)", "skipped", None, None, "no number"),
    ]
    assert [tuple(r)[2:] for r in got] == want
    assert {r.i for r in got} == {1}
    with pytest.raises(Exception, match="from text"):
        tokens.with_tokens(spark.range(1), "id").collect()
