import datetime
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from serion.functions import kernel, parse
from serion.operators import points, scan, series
from serion.plans import registry, series_queries, zero_queries
from serion.sources import config, prompts, tables
from serion.streaming import monitor


@pytest.fixture
def tiny_chunks(monkeypatch):
    monkeypatch.setattr(series, "CHUNK_ROWS", 7)


def test_order_across_chunks(spark, tiny_chunks):
    df = spark.range(100).select(F.pmod(F.col("id") * 37, F.lit(101)).alias("k"), F.col("id").alias("v"))
    rows = sorted(df.collect())
    got = {r.k: (r.prev_v, r.n) for r in series.ranked(series.previous(df, "k", ["v"]), "k").collect()}
    assert got == {r.k: (rows[i - 1].v if i else None, i + 1) for i, r in enumerate(rows)}


def _walk(rows):
    """Rows (key, order, tie, value) of each key in order, in plain Python; nulls first."""
    out = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0)):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("chunk", [7, 40, 10**6])
def test_keyed_series_across_chunks(spark, monkeypatch, chunk):
    """A hot key, many small ones, a null key, ties, null values and null order values."""
    monkeypatch.setattr(series, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(3)
    rows = [(None if k == 9 else int(k), int(rng.integers(0, 90)) if rng.random() < 0.97 else None, int(i), float(rng.integers(0, 50)) if rng.random() < 0.8 else None) for i, k in enumerate(rng.choice([0, 0, 0, 0, 1, 2, 3, 9], 300))]
    df = spark.createDataFrame(rows, "key long, o long, tie long, v double")
    by_key = _walk(rows)
    want = {}
    for each in by_key.values():
        carried = None
        for i, r in enumerate(each):
            carried = r[3] if r[3] is not None else carried
            ring = [x[3] for x in each[max(0, i - 4) : i + 1] if x[3] is not None]
            clip = [x[3] for x in each if r[1] - 10 <= x[1] <= r[1] and x[3] is not None]
            want[r[2]] = (each[i - 1][3] if i else None, each[i - 1][2] if i else None, i + 1, carried, len(ring), min(ring, default=None), max(ring, default=None), len(clip), round(sum(clip) / len(clip), 9) if clip else None)
    keys, then = ("key",), ("tie",)
    parts = [
        {r.tie: (r.prev_v, r.prev_tie) for r in series.previous(df, "o", ["v", "tie"], keys, then=then).collect()},
        {r.tie: (r.n,) for r in series.ranked(df, "o", keys=keys, then=then).collect()},
        {r.tie: (r.c,) for r in series.carried_forward(df, "o", "v", keys, "c", then).collect()},
        {r.tie: (r.n, r.least, r.largest) for r in series.ring_stats(df, "o", "v", keys, 5, then).collect()},
        {r.tie: (r.n, r.mean if r.mean is None else round(r.mean, 9)) for r in series.clipped_stats(df, "o", "v", keys, 10).collect()},
    ]
    assert all(set(p) == set(want) for p in parts)
    assert {t: sum((p[t] for p in parts), ()) for t in want} == want
    assert series.previous(df, "o", ["v"], keys).columns == [*df.columns, "prev_v"]


def test_borders_are_found_by_halving(spark):
    borders = [1, 4, 9, 16, 25, 36, 49]
    for n in (0, 1, 2, 3, 6, 7):
        got = spark.range(-2, 60).select("id", (series._below(borders[:n], F.col("id")) if n else F.lit(0)).alias("k")).collect()
        assert all(r.k == sum(b <= r.id for b in borders[:n]) for r in got)


@pytest.mark.parametrize("rows", [[], [(None, 1.0)], [(1.0, 5.0)]])
def test_series_without_pairs(spark, rows):
    df = spark.createDataFrame(rows, "k double, v double")
    assert series.gaps(df, "k").count() == 0
    assert series.sign_changes(df, "k", "v").count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-300, 1e300, 3e-9])
@pytest.mark.parametrize("cells", [4, 4096])
def test_histogram_in_one_pass_is_the_one_in_two(spark, monkeypatch, cells, scale):
    """Ranges that grow from batch to batch, edges that part cells, offsets, ties, values that are none."""
    monkeypatch.setattr(series, "CELLS", cells)
    pick = np.random.default_rng(cells)
    for values in (pick.normal(0, 1, 300) ** 3 * scale, pick.integers(-3, 9, 200) * scale, 5e3 * scale + pick.random(50) * scale, np.full(3, scale)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        want = [tuple(r) for r in series.histogram(df, "v", 7).orderBy("bin").collect()]
        odd = df.union(spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "v double"))
        assert [tuple(r) for r in series.histogram_once(odd, "v", 7).orderBy("bin").collect()] == want
    assert series.histogram_once(df.limit(0), "v", 7).collect() == []


def test_cells_double_as_the_range_grows():
    a = series._Cells.of(np.arange(10.0))
    for top in (1e3, 1e9, -1e12):
        a = a.with_(series._Cells.of(np.array([top])))
        assert len(a.i) <= series.CELLS + 1 and (np.diff(a.i) > 0).all()
        assert (np.floor(np.ldexp(a.least, -a.k)) == a.i).all() and (np.floor(np.ldexp(a.largest, -a.k)) == a.i).all()
    assert a.n.sum() == 13 and (a.least[0], a.largest[-1]) == (-1e12, 1e9)


def test_histogram_is_numpys(spark):
    values = np.random.default_rng(1).normal(size=500).round(3)
    got = series.histogram(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v", 40).orderBy("bin").collect()
    assert [r.n for r in got] == np.histogram(values, 40)[0].tolist()
    assert series.histogram(spark.createDataFrame([], "v double"), "v", 5).count() == 0
    assert [r.n for r in series.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 2).orderBy("bin").collect()] == [2, 0]


def test_unmatched_is_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-50, 50, 200).round(2).tolist(), rng.uniform(-50, 50, 60).round(2).tolist()
    got = series.unmatched(spark.createDataFrame([(x,) for x in a], "a double"), spark.createDataFrame([(x,) for x in b] + [(None,)], "b double"), "a", "b", 0.5)
    assert sorted(r.a for r in got.collect()) == sorted(x for x in a if not any(abs(x - y) < 0.5 for y in b))


def test_strict_sign_change_and_zero(spark):
    df = spark.createDataFrame([(1.0, -1.0), (2.0, 0.0), (3.0, 1.0), (4.0, -1.0)], "t double, z double")
    assert [r.t for r in series.sign_changes(df, "t", "z").collect()] == [4.0]
    assert sorted(r.t for r in series.sign_changes(df, "t", "z", zero_hits=True).collect()) == [2.0, 4.0]


def test_zeros(spark, monkeypatch):
    zeros = [r.t for r in scan.zero_table(spark, 500.0, run_ts="x").orderBy("n").collect()]
    assert len(zeros) == 269
    assert np.allclose(zeros[:10], tables.FIRST_ZEROS, atol=1e-12)
    gaps = np.diff(zeros)
    assert np.isclose(gaps.min(), 0.4364052411394823, atol=1e-9) and np.isclose(gaps.mean(), 1.8076345421192235, atol=1e-9)
    monkeypatch.setattr(scan, "BLOCK_TERMS", 99_999)
    assert scan.candidates(spark, 500.0).rdd.getNumPartitions() > 5
    assert np.allclose([r.t for r in scan.accepted(scan.candidates(spark, 500.0)).orderBy("t").collect()], zeros, rtol=1e-13, atol=0)
    assert scan.rejected(scan.candidates(spark, 100.0), 0.0).count() == 29
    with pytest.raises(ValueError):
        scan.grid(spark, 19.0)


def test_bits(spark):
    got = scan.bit_string(scan.gap_bits(scan.zero_table(spark, 80.0, run_ts="x"), 50)).first()
    assert got.bits == "01010100010000010000000000010000000000000101010001"
    assert abs(got.fraction - 0.3291168250143528) < 1e-15


def test_asymptotic_signs():
    t = np.concatenate([np.arange(10, 400, 0.05), np.arange(5000, 5060, 0.01), np.arange(9990, 10_000, 0.005)])
    z, fast = kernel.hardy_z(t), kernel.hardy_z_signs(t)
    assert (np.sign(z) == np.sign(fast)).all()
    assert (np.abs(z - fast) <= 0.127 * t**-0.75 + 1e-9).all()


def test_zeta_against_more_terms(monkeypatch):
    s = np.array([0.5 + 14.1347j, 0.5 + 500j, 0.5 + 9999.3j, 2, 0.5, 1.5 + 3j, 0.75 - 70j])
    n = 60_000
    k = np.arange(1, n)
    want = [np.exp(-x * np.log(k)).sum() + n ** (1 - x) / (x - 1) + n**-x / 2 + x * n ** (-x - 1) / 12 - x * (x + 1) * (x + 2) * n ** (-x - 3) / 720 for x in s]
    assert np.allclose(kernel.zeta(s), want, atol=2e-10)
    assert np.allclose(kernel._coefficients(4), [1 / 12, -1 / 720, 1 / 30240, -1 / 1209600], rtol=1e-13)


def test_kernel():
    assert np.allclose(kernel.zeta(np.array([2, 4])).real, [np.pi**2 / 6, np.pi**4 / 90])
    assert np.isnan(kernel.illinois(np.cos, np.array([0.0]), np.array([0.1]))[0])
    assert np.isclose(kernel.bisect(np.cos, np.array([1.0]), np.array([2.0]))[0], np.pi / 2)
    # the second one starts at a flat place and leaves its bracket; the third has no root
    roots = kernel.newton(lambda x: np.where(x < 3, np.cos(x), np.arctan(50 * (x - 10.9))), np.array([1.0, 10.0, 2.0]), np.array([2.0, 11.0, 2.5]))
    assert np.allclose(roots[:2], [np.pi / 2, 10.9]) and np.isnan(roots[2])


@pytest.mark.parametrize(
    ("token", "want"),
    [("1", (1, 0)), ("-2.5e1", (-25, 0)), ("0.5-3i", (0.5, -3)), ("0.5+14j", (0.5, 14)), ("3j", (0, 3)), ("-j", (0, -1)), ("1+i", (1, 1)), ("inf", None), ("nan", None), ("abc", None), ("", None), ("1e", None)],
)
def test_tokens(spark, token, want):
    r = spark.createDataFrame([(token,)], "t string").select(parse.parse_number(F.col("t")).alias("s")).first().s
    assert (None if r is None else (r.re, r.im)) == want


def test_points_with_errors(spark):
    got = {(r.s.re if r.s else None): r for r in points.evaluate(tables.points(spark, ((1.0, 0.0), (2.0, 0.0), (None, 0.0), (-2.0, 0.0)))).collect()}
    assert not got[1.0].ok and "pole" in got[1.0].error and got[1.0].zeta_s is None
    assert got[2.0].ok and got[2.0].error is None
    assert not got[None].ok
    assert abs(got[-2.0].zeta_s.re) < 1e-12


def test_sources(spark, tmp_path):
    assert tables.read_numbers(spark, str(tmp_path / "none")).count() == 10
    (tmp_path / "n.txt").write_text("1,2 abc\n0.5+14j\n\ninf")
    rows = tables.read_numbers(spark, str(tmp_path / "n.txt")).collect()
    assert sum(r.s is not None for r in rows) == 3 and len(rows) == 5
    assert tables.seed_numbers(spark, str(tmp_path / "seed")).where("s IS NOT NULL").count() == 10
    (tmp_path / "z.csv").write_text("n,partie_imaginaire,T_MAX,methode,precision_dps,calcule_le\n1,14.1,20.0,x,50,20260101_000000\n")
    assert tables.read_zeros(spark, str(tmp_path / "z.csv")).columns == ["n", "t", "t_max", "method", "precision", "run_ts"]
    assert tables.read_reference(spark, str(tmp_path / "missing.csv")).count() == 0
    assert tables.run_dir("a/", 500.4, "s") == "a/T500_s"
    assert not tables.write_if_any(spark.createDataFrame([], "a int"), str(tmp_path / "e"))
    zeros = spark.range(1, 251).select(F.col("id").alias("n"), F.col("id").cast("double").alias("t"))
    tables.write_snapshots(zeros, str(tmp_path / "snap"), "a")
    assert tables.read_snapshots(spark, str(tmp_path / "snap")).count() == 200
    tables.write_points(points.evaluate(tables.points(spark, ((1.0, 0.0), (2.0, 0.0)))), str(tmp_path / "points"))
    assert {r.zeta_s for r in spark.read.csv(str(tmp_path / "points"), header=True).collect()} == {"NaN", "(1.6449340668+0.0000000000j)"}


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("tol: 1e-12\nT_max: 500\nunknown: 1\n")
    got = config.load(str(p))
    assert got.tol == 1e-12 and got.T_max == 500.0 and got.step == 0.1
    assert config.load(str(tmp_path / "new.yaml"), create=True) == config.load(str(tmp_path / "new.yaml"))
    assert config.created(str(p)) == {"tol": "1e-12", "T_max": 500, "unknown": 1}
    assert config.created(str(tmp_path / "own.yaml")) == config.defaults()


def test_prompts(spark):
    def client(p):
        if p == "bad":
            raise RuntimeError("no")
        return p.upper()

    got = {r.prompt: (r.answer, r.error) for r in prompts.answer(spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string"), client).collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: no"), None: (None, "no prompt")}


def test_metrics_source(spark):
    from serion.sources.metrics import MetricsSource

    spark.dataSource.register(MetricsSource)
    assert spark.read.format("system_metrics").option("samples", "2").load().count() == 2


def test_ring_buffer_over_batches(spark, tmp_path):
    data = [(k % 3, float(k), float(k * k % 17)) for k in range(60)]
    for k in range(3):
        spark.createDataFrame(data[k * 20 : k * 20 + 20], "g long, o double, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = monitor.ring_buffers(monitor.read_files(spark, str(tmp_path / "in"), "g long, o double, v double", 1), "g", "o", "v", rows=5)
    last = {}
    monitor.run_to_end(stream, "update", lambda df, k: last.update({r.key: r for r in df.collect()}), str(tmp_path / "state"))
    for g in range(3):
        kept = [v for a, _, v in data if a == g][-5:]
        assert (last[g].n, last[g].least, last[g].largest) == (5, min(kept), max(kept))


@pytest.mark.parametrize("files", [1, 4, 20])
def test_stream_of_shuffled_files_counts_every_row(spark, tmp_path, files):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=7 * k), float(k * k % 17) if k % 5 else None) for k in range(180)]
    np.random.default_rng(files).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], "ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        for f in (tmp_path / "events.parquet").glob("part-*"):
            if f.stat().st_mtime > 1000:  # not yet dated
                os.utime(f, (100 + k, 100 + k))
    got = _sorted_rows(series_queries.stream_tumbling_30s(spark, str(tmp_path)))
    assert got == _sorted_rows(series_queries.tumbling_30s(spark, str(tmp_path)))
    assert sum(n for _, n, _ in got) == sum(v is not None for _, v in rows)


def _sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_the_whole_zero_table_comes_back(spark):
    rows = zero_queries.zeros_table(spark, "").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 10_143))
    assert all(a.t < b.t for a, b in zip(rows, rows[1:], strict=False)) and rows[-1].t < 10_000
    assert [r.t for r in rows[:10]] == pytest.approx(tables.FIRST_ZEROS, abs=1e-9)
    assert sum(r.t <= 1000 for r in rows) == 649


def test_half_of_total_between_events_of_one_time(spark, tmp_path):
    """Copies of an event at one time, an event that ends on the half, a first event beyond it and rows without a user, against the SQL."""
    day = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    users = {1: [(0, 0.25), (5, 0.5), (5, 0.5), (5, 0.5), (9, 0.25)], 2: [(0, 0.25), (7, 0.75), (90, 0.5), (91, 0.5)], 3: [(0, 9.0), (4, 1.0)], None: [(0, 1.0), (10, 4.0)]}
    users |= {4: [(k * 1000.5, 0.1) for k in range(10)], 5: [(k * 10.25, 0.7) for k in range(41)]}
    rows = [(u, day(s), v) for u, each in users.items() for s, v in each]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, user_id long, ts timestamp_ntz, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT user_id, half_s, ok FROM ({registry.ORACLES['half_of_total']})").fetchall()
    got = [tuple(r) for r in series_queries.half_of_total(spark, str(tmp_path)).select("user_id", "half_s", "ok").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 6
