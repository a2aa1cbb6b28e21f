"""Sources, sinks, logs and the live monitor."""

import logging
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from serion.functions import classify
from serion.operators import points, series
from serion.sources import config, logs, metrics, tables
from serion.streaming import monitor


def _reading(*values):
    return [SimpleNamespace(current=v) for v in values]


@pytest.mark.parametrize(
    ("groups", "want"),
    [
        ({}, None),
        ({"coretemp": _reading(40.0, 60.0), "acpitz": _reading(99.0)}, 50.0),
        ({"coretemp": _reading(0.0, None, -5.0), "zenpower": _reading(30.0), "k10temp": _reading(41.0)}, 41.0),
        ({"nvme": _reading(70.0)}, None),
    ],
)
def test_first_group_with_positive_readings(groups, want):
    assert metrics.from_groups(groups) == want


def test_report_and_zones():
    assert metrics.from_report("fan1: 900 RPM\nCore 0:        +47.5°C  (high = +80.0°C)\nTdie: +1.0°C") == 47.5
    assert metrics.from_report("CPU Temperature: 51°C") == 51.0
    assert metrics.from_report("Package id 0: +44.0°C") is None
    assert metrics.from_zones(["42000\n", "odd", "", "61500"]) == 61.5
    assert metrics.from_zones([]) is None


def test_readers_are_tried_in_order():
    def fails():
        raise FileNotFoundError

    known = (lambda: "x", lambda x: 12.0)
    assert metrics.temperature(((fails, metrics.from_report), (lambda: [], metrics.from_zones), known)) == 12.0
    assert metrics.temperature(((lambda: _Odd(), metrics.from_groups), (fails, str))) is None


class _Odd(dict):
    def get(self, *_):
        raise ValueError


def test_samples_are_kept_until_committed():
    stream = metrics._Stream()
    rows, end = stream.read(stream.initialOffset())
    first = list(rows)
    assert end == {"n": 1} and list(stream.readBetweenOffsets({"n": 0}, end)) == first
    stream.commit(end)
    assert stream.kept == {}


def test_metrics_stream(spark, tmp_path):
    spark.dataSource.register(metrics.MetricsSource)
    seen = []
    query = spark.readStream.format("system_metrics").load().writeStream.foreachBatch(lambda df, k: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(60):
            if len(seen) >= 2 or query.awaitTermination(1):
                break
    finally:
        query.stop()
    assert len(seen) >= 2 and all(0 <= r.cpu_pct <= 100 and r.ram_used_gb > 0 for r in seen)
    assert seen[0].elapsed_s <= seen[1].elapsed_s


_LOG = """Starting at now
=== Sat Nov 28 03:28:00 UTC 2026 ===
--- htop snapshot ---
load 1.0
--- iostat ---
sda 1 2
--- sensors ---
  temp1_input: 47.500
  temp2_input: 51.000
--- nvidia-smi ---
37 %, 1024 MiB, 61

=== Sat Nov 28 03:28:30 UTC 2026 ===
--- htop snapshot ---
--- iostat ---

=== Sat Nov 28 03:29:00 UTC 2026 ===
--- sensors ---
temp1_input: -3
"""


def test_sampler_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(_LOG)
    (tmp_path / "b.log").write_text("")
    want = [("Sat Nov 28 03:28:00 UTC 2026", [47.5, 51.0], 37.0, 1024.0, 61.0), ("Sat Nov 28 03:28:30 UTC 2026", [], None, None, None), ("Sat Nov 28 03:29:00 UTC 2026", [-3.0], None, None, None)]
    assert sorted(map(tuple, logs.snapshots(logs.read_sampler_log(spark, str(tmp_path))).collect())) == want
    got = []
    stream = logs.snapshots(logs.read_sampler_log(spark, str(tmp_path), stream=True))
    monitor.run_to_end(stream, "append", lambda df, k: got.extend(map(tuple, df.collect())), f"file://{tmp_path}/state")
    assert sorted(got) == want


def test_run_logger(tmp_path, capsys):
    path = str(tmp_path / "run.log")
    log = logs.run_logger(path, "serion.test", max_bytes=400)
    log.debug("only in the file")
    log.info("in both")
    assert "only in the file" in open(path, encoding="utf-8").read()
    assert "in both" in capsys.readouterr().err
    old = f"{path}.1"
    for k in range(8):
        log.info("line %d %s", k, "x" * 100)
    assert os.path.exists(old)
    os.utime(old, (0, 0))
    for k in range(4):
        log.info("more %d %s", k, "x" * 100)
    assert all(os.path.getmtime(tmp_path / x) > 1000 for x in os.listdir(tmp_path))
    assert len(logs.run_logger(path, "serion.test").handlers) == 2
    logging.getLogger("serion.test").handlers.clear()


def _sample_files(spark, path, rows, files):
    for k in range(files):
        spark.createDataFrame(rows[k::files], "elapsed_s double, temp_c double, cpu_pct double").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 4])
def test_live_dashboard(spark, tmp_path, files):
    rows = [(float(k), None if k % 7 == 0 else 60.0 + k % 40, float(k % 90)) for k in range(60)]
    _sample_files(spark, str(tmp_path / "in"), rows, files)
    shown = []

    def show(parts, k):
        shown.append((parts["current"].first(), parts["stats"].first(), parts["histogram"].collect()))

    stream = monitor.read_files(spark, str(tmp_path / "in"), "elapsed_s double, temp_c double, cpu_pct double", 1)
    monitor.live_dashboard(stream, show, f"{tmp_path}/state", f"{tmp_path}/kept", rows=20, bins=5)
    kept = [r for r in rows if r[1] is not None][-20:]
    now, stats, histogram = shown[-1]
    assert len(shown) == files
    assert (now.elapsed_s, now.temp_c) == kept[-1][:2]
    assert (stats.least, stats.largest) == (min(r[1] for r in kept), max(r[1] for r in kept))
    assert sum(r.n for r in histogram) == 20


def test_dashboard_of_too_few_samples(spark, tmp_path):
    _sample_files(spark, str(tmp_path / "in"), [(0.0, None, 1.0), (1.0, 50.0, 1.0)], 1)
    shown = []
    stream = monitor.read_files(spark, str(tmp_path / "in"), "elapsed_s double, temp_c double, cpu_pct double", 1)
    monitor.live_dashboard(stream, lambda *a: shown.append(a), f"{tmp_path}/state", f"{tmp_path}/kept")
    assert shown == []


def test_zero_files(spark, tmp_path):
    zeros = spark.range(1, 31).select(F.col("id").alias("n"), (F.col("id") * 1.5).alias("t"), F.lit(20.0).alias("t_max"), F.lit("x").alias("method"), F.lit(15).alias("precision"), F.lit("20260101_000000").alias("run_ts"))
    for fmt in ("csv", "parquet"):
        tables.write_zeros(zeros, f"{tmp_path}/{fmt}", fmt)
    back = tables.read_zeros(spark, f"{tmp_path}/csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, spark.read.parquet(f"{tmp_path}/parquet").collect()))
    tables.write_numbered(zeros, f"{tmp_path}/numbered")
    text = "".join(open(x).read() for x in sorted((tmp_path / "numbered").glob("part-*")))
    assert text.splitlines()[:2] == ["zero_num,imag", "1,1.5"] and len(text.splitlines()) == 21
    assert [r.t for r in tables.read_zeros(spark, f"{tmp_path}/numbered").orderBy("n").collect()] == [1.5 * k for k in range(1, 21)]


def test_reference_file_and_comparison(spark, tmp_path):
    fetched = []

    def fetch(path):
        fetched.append(path)
        with open(path, "w") as f:
            f.write("gamma,other\n1.5,x\n3.25,y\n")

    def broken(path):
        raise OSError

    path = str(tmp_path / "ref.csv")
    assert tables.read_reference(spark, path, broken).count() == 0
    ref = tables.read_reference(spark, path, fetch)
    assert fetched == [path] and [r.t_ref for r in ref.collect()] == [1.5, 3.25]
    tables.read_reference(spark, path, fetch)
    assert len(fetched) == 1
    zeros = spark.createDataFrame([(1, 1.5), (2, 3.0), (3, 4.5)], "n long, t double")
    found = series.compared(zeros, series.ranked(ref, "t_ref"), "t", "t_ref")
    assert tables.write_if_any(found, str(tmp_path / "cmp"))
    rows = spark.read.csv(str(tmp_path / "cmp"), header=True, inferSchema=True).orderBy("n").collect()
    assert [(r.n, r.abs_err, round(r.rel_err_pct, 6)) for r in rows] == [(1, 0.0, 0.0), (2, 0.25, 7.692308)]


def test_overlaid_settings(spark):
    got = {r.k: (r.v, r.number) for r in config.overlaid(spark, {"tol": "1e-9", "T_max": 500, "odd": 1, "step": None}).collect()}
    assert set(got) == set(config.defaults())
    assert got["tol"] == ("1e-9", 1e-9) and got["T_max"] == ("500", 500.0) and got["step"] == ("0.1", 0.1) and got["save_csv"] == ("True", None)
    assert {r.k: r.v for r in config.overlaid(spark, {}).collect()} == {k: str(v) for k, v in config.defaults().items()}


def test_triggers_and_tiers(spark):
    df = spark.createDataFrame([(99.97,), (100.0,), (100.04,), (100.5,), (150.0,), (None,)], "t double")
    got = [tuple(r) for r in df.select(classify.periodic(F.col("t"), 0.05), classify.within_unit(F.col("t")), classify.within_unit(F.col("t"), 50)).collect()]
    assert got == [(False, False, False), (True, True, True), (True, True, True), (False, True, True), (False, False, True), (None, None, None)]
    tiers = spark.createDataFrame([(1e-9,), (1e-8,), (1e-5,), (1e-4,), (1.0,)], "e double").select(classify.error_tier(F.col("e")).alias("x")).collect()
    assert [r.x for r in tiers] == ["ok", "warn", "warn", "fail", "fail"]


def test_point_run(spark):
    got = points.evaluate(tables.points(spark, (*tables.TEST_POINTS, (1.0, 0.0))))
    total = points.run_totals(got).first()
    assert (total.n_points, total.n_ok, total.n_failed) == (7, 6, 1) and total.seconds >= 0
    failed = points.on_axis(got).where("x = 1").first()
    assert failed.modulus is None
    assert points.run_totals(got.limit(0)).first().seconds == 0.0
