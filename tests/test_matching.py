"""Frames of many rows, borders over ties, as-of joins, pairing, sessions, distances and overlaps against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from serion.operators import matching, roots, series


@pytest.fixture(params=[10, 1_000_000], ids=["many chunks", "one chunk"])
def chunks(request, monkeypatch):
    monkeypatch.setattr(series, "CHUNK_ROWS", request.param)


def _rows(seed, n=400, keys=(0, 0, 0, 1, None), top=900):
    pick = random.Random(seed)
    return [(pick.choice(keys), pick.choice([pick.randrange(top), 7 * pick.randrange(top // 7)]), pick.choice([None, float("nan"), pick.gauss(0, 9), 1.5])) for _ in range(n)]


def _sorted(rows):
    return sorted((tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("span", [0, 3, 450, 5000])
def test_frames(spark, chunks, span):
    """Frames of no chunk, of one, of half of them (some twenty, when chunks hold ten rows) and of all."""
    rows = [(i, *r) for i, r in enumerate(_rows(span))]
    want = []
    for i, k, s, _ in rows:
        v = [x for _, a, b, x in rows if a == k and s - span <= b <= s and x is not None and x == x]
        want.append((i, len(v), min(v, default=None), max(v, default=None), sum(v) if v else None, sum(v) / len(v) if v else None))
    df = spark.createDataFrame([*rows, (-1, 0, None, 1.0)], "i int, k int, s int, v double")
    got = series.clipped_stats(df, "s", "v", ("k",), span)
    assert _sorted(got.select("i", "n", "least", "largest", "total", "mean").collect()) == _sorted(want)


def test_frames_over_fifty_chunks(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK_ROWS", 10)
    rows = [(s, float(s % 17)) for s in range(1000)]
    got = {r.s: r for r in series.clipped_stats(spark.createDataFrame(rows, "s long, v double"), "s", "v", (), 520).collect()}
    for s, _ in rows[::37]:
        v = [x for t, x in rows if s - 520 <= t <= s]
        assert (got[s].n, got[s].least, got[s].largest, got[s].total) == (len(v), min(v), max(v), sum(v))


def test_borders_over_ties(spark, monkeypatch):
    """An order value of most rows is cut, too, and ranks, lags, rings and carried values stay right."""
    monkeypatch.setattr(series, "CHUNK_ROWS", 20)
    pick = random.Random(1)
    rows = [(1, 5 if i % 4 else pick.randrange(10), i, None if i % 3 else float(i)) for i in pick.sample(range(300), 300)]
    df = spark.createDataFrame(rows, "k int, o int, i int, v double")
    cut = series._cut(df, "o", ("k",), ("i",))
    assert cut.rows.groupBy("_serion_chunk").count().agg({"count": "max"}).first()[0] < 80
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [r.i for r in series.ranked(df, "o", keys=("k",), then=("i",)).orderBy("n").collect()] == [r[2] for r in order]
    before = {r.i: r.prev_i for r in series.previous(df, "o", ["i"], ("k",), then=("i",)).collect()}
    assert [before[r[2]] for r in order] == [None, *[r[2] for r in order[:-1]]]
    held, want = {r.i: r.c for r in series.carried_forward(df, "o", "v", ("k",), "c", ("i",)).collect()}, None
    ring = {r.i: (r.n, r.total) for r in series.ring_stats(df, "o", "i", ("k",), rows=9).collect()}
    for p, (_, _, i, v) in enumerate(order):
        want = v if v is not None else want
        assert held[i] == want
        last = [r[2] for r in order[max(0, p - 8) : p + 1]]
        assert ring[i] == (len(last), sum(last))


def test_taken_names_are_refused(spark):
    with pytest.raises(ValueError, match="reserved"):
        series.ranked(spark.createDataFrame([(1, 2)], "o int, _serion_chunk int"), "o")


@pytest.mark.parametrize(("strict", "tolerance"), [(False, None), (True, None), (False, 4), (True, 0)])
def test_as_of(spark, chunks, strict, tolerance):
    left = [(i, k, s) for i, (k, s, _) in enumerate(_rows(2, 150))] + [(-1, 0, None)]
    right = [(k, s, v) for k, s, v in _rows(3, 80) if v is None or v == v] + [(0, None, 9.0)]
    want = []
    for i, k, s in left:
        near = [(t, v is not None, v or 0.0, v) for a, t, v in right if a == k and s is not None and t is not None and (t < s or t == s and not strict)]
        t, *_, v = max(near, default=(None, None))
        if t is not None and tolerance is not None and s - t > tolerance:
            t = v = None
        want.append((i, k, s, t, v))
    got = matching.as_of(spark.createDataFrame(left, "i int, k int, s int"), spark.createDataFrame(right, "k int, t int, v double"), "s", "t", ("v",), ("k",), tolerance=tolerance, strict=strict)
    assert got.columns == ["i", "k", "s", "t", "v"]
    assert _sorted(got.collect()) == _sorted(want)


def test_sessions_longer_than_chunks(spark, chunks):
    rows = _rows(4, 300, top=2000)
    want = []
    for k in {r[0] for r in rows}:
        begin = last = None
        for s in sorted(r[1] for r in rows if r[0] == k):
            begin = s if last is None or s - last > 6 else begin
            last = s
            want.append((k, s, begin))
    got = matching.sessions(spark.createDataFrame([(k, s) for k, s, _ in rows], "k int, s int"), "s", 6, ("k",))
    assert _sorted(got.select("k", "s", "session").collect()) == _sorted(want)


def _pairs(left, right, tolerance):
    a, b, out = sorted(x for x in left if x is not None), sorted(x for x in right if x is not None), []
    while a and b:
        if abs(a[0] - b[0]) < tolerance:
            out.append(("pair", a.pop(0), b.pop(0)))
        elif a[0] < b[0]:
            out.append(("missing", a.pop(0), None))
        else:
            out.append(("extra", None, b.pop(0)))
    out += [("missing", x, None) for x in a] + [("extra", None, x) for x in b]
    return out + [("missing", None, None)] * left.count(None) + [("extra", None, None)] * right.count(None)


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one(spark, chunks, seed):
    pick = random.Random(seed)
    left, right = ([pick.choice([round(pick.uniform(0, 300), 2), float(pick.randrange(20)), 50.0, None]) for _ in range(120)] for _ in range(2))
    df = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} double")
    got = matching.matched(df(left, "t"), df(right, "r"), "t", "r", 1.5)
    assert _sorted(got.collect()) == _sorted(_pairs(left, right, 1.5))
    assert matching.matched(df([], "t"), df([1.0], "r"), "t", "r", 1.5).collect() == [("extra", None, 1.0)]


@pytest.mark.parametrize("tolerance", [1e-3, 3.0, 70.0, float("inf"), 0.0])
def test_one_to_one_over_chunks(spark, monkeypatch, tolerance):
    """Tolerances of no chunk, of some and of all, values of very many copies; what is not finite stays alone, as in the SQL."""
    monkeypatch.setattr(series, "CHUNK_ROWS", 20)
    monkeypatch.setattr(matching, "COPIES", 7)
    pick = random.Random(9)
    left, right = ([pick.choice([pick.gauss(0, 40), pick.gauss(90, 1), float(pick.randrange(9)), 50.0, -0.5, None]) for _ in range(300)] for _ in range(2))
    odd = [float("inf"), float("inf"), float("-inf"), float("nan")]
    want = _pairs(left, right, tolerance) + [("missing", v, None) for v in odd] + [("extra", None, v) for v in odd]
    df = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} double")
    got = matching.matched(df(left + odd, "t"), df(right + odd, "r"), "t", "r", tolerance)
    assert str(_sorted(got.collect())) == str(_sorted(want))  # NaN equals nothing


def test_one_to_one_without_any_gap(spark, monkeypatch):
    """All neighbours are near, so nothing parts the series: yet no chunk has many rows, and no task most of the result."""
    monkeypatch.setattr(series, "CHUNK_ROWS", 64)
    pick = random.Random(1)
    left, right = ([pick.uniform(0, 100) for _ in range(800)] for _ in range(2))
    df = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} double")
    plain = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in plain}
    try:
        for name, x in plain.items():
            spark.conf.set(name, x)
        got = matching.matched(df(left, "t"), df(right, "r"), "t", "r", 5.0)
        rows = got.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, x in before.items():
            spark.conf.set(name, x)
    assert _sorted(tuple(r)[:3] for r in rows) == _sorted(_pairs(left, right, 5.0))
    assert max(Counter(r.task for r in rows).values()) < len(rows) / 2
    parts = spark.read.parquet(*got.inputFiles()).groupBy("_part").count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) <= 2 * 64


def test_pair_distances(spark, chunks):
    rows, edges = [(k, s) for k, s, _ in _rows(5, 250)], [0, 1, 5, 60, 200]
    want = Counter()
    for i, (k, s) in enumerate(rows):
        for a, t in rows[:i]:
            if a == k and abs(s - t) < edges[-1]:
                want[k, next(b for b in range(1, len(edges)) if abs(s - t) < edges[b])] += 1
    got = matching.pair_distances(spark.createDataFrame(rows, "k int, s int"), "s", edges, ("k",))
    assert {(r.k, r.bin): r.n for r in got.collect()} == want
    with pytest.raises(ValueError, match="rise"):
        matching.pair_distances(got, "n", [1, 1])


def test_pair_distances_beyond_many_chunks(spark, monkeypatch):
    """The last edge spans fifty chunks and more; a row is copied once per edge at most, and tiny edges find no pair."""
    monkeypatch.setattr(series, "CHUNK_ROWS", 10)
    values, edges = [random.Random(8).choice([x / 4, 50.0]) for x in range(1000)], [0.0, 1e-300, 0.25, 40.0, 190.0]
    want = Counter(next((b for b in range(1, len(edges)) if abs(x - y) < edges[b]), 0) for i, x in enumerate(values) for y in values[:i])
    got = matching.pair_distances(spark.createDataFrame([(v,) for v in values], "v double"), "v", edges)
    assert {r.bin: r.n for r in got.collect()} == {k: n for k, n in want.items() if k}
    none = matching.pair_distances(spark.createDataFrame([], "k int, v double"), "v", edges, ("k",))
    assert none.columns == ["k", "bin", "n"] and not none.collect()


@pytest.mark.parametrize("gap", [0, 3])
def test_merged_spans(spark, chunks, gap):
    """Intervals inside others, touching ones, equal ones and one over most chunks."""
    pick = random.Random(gap)
    rows = [(pick.choice([0, 0, 0, 1, None]), a, a + pick.choice([0, 0, 2, 5, -1]), 1) for a in (pick.randrange(1500) for _ in range(250))]
    rows += [(0, 700, 1100, 1), (0, 700, 1100, 1), (1, None, 4, 1), (1, 4, None, 1)]
    want = []
    for k in (0, 1, None):
        mine = sorted((a, b) for x, a, b, _ in rows if x == k and None not in (a, b) and a <= b)
        for a, b in mine:
            if want and want[-1][0] == k and a - want[-1][2] <= gap:
                want[-1] = (k, want[-1][1], max(want[-1][2], b), want[-1][3] + 1)
            else:
                want.append((k, a, b, 1))
    df = spark.createDataFrame(rows, "k int, a int, b int, n int")
    assert _sorted(matching.merged_spans(df, "a", "b", gap, ("k",), ("n",)).collect()) == _sorted(want)
    assert matching.merged_spans(df.limit(0), "a", "b").collect() == []


def test_merged_spans_of_every_row(spark, chunks):
    """Nulls and ends before starts are rows like others, which a walk in order meets; one key has no end at all."""
    pick = random.Random(9)
    rows = [(pick.choice([0, 0, None]), a, None if pick.random() < 0.1 else a + pick.choice([0, 2, -1, -6]), 1) for a in (pick.randrange(900) for _ in range(250))]
    rows += [(0, None, None, 1), (0, None, 950, 1), (0, -9, None, 1), (0, -9, None, 1), *[(2, a, None, 1) for a in (5, 5, None, None)]]
    want = []
    for k in (0, 2, None):
        reach, mine = None, sorted(((a, b) for x, a, b, _ in rows if x == k), key=lambda r: [y for x in r for y in (x is None, x or 0)])
        for at, (a, b) in enumerate(mine):
            if at and reach is not None and (a is None or a - reach <= 3):
                ends = [x for x in (want[-1][2], b) if x is not None]
                want[-1] = (k, want[-1][1], max(ends, default=None), want[-1][3] + 1)
            else:
                want.append((k, a, b, 1))
            reach = b if reach is None or b is not None and b > reach else reach
    df = spark.createDataFrame(rows, "k int, a int, b int, n int")
    assert _sorted(matching.merged_spans(df, "a", "b", 3, ("k",), ("n",), every=True).collect()) == _sorted(want)
    assert matching.merged_spans(df.limit(0), "a", "b", every=True).collect() == []


def test_overlaps(spark):
    """One interval is a thousand times as long as most."""
    pick = random.Random(6)

    def spans(n):
        out = [(i, pick.choice([0, 1, None]), pick.uniform(-50, 500)) for i in range(n)]
        return [(i, k, a, a + pick.choice([0.0, pick.random(), 4.0, -1.0, 1000.0 if i == 3 else 2.0])) for i, k, a in out] + [(-1, 0, None, 1.0)]

    left, right = spans(150), spans(150)
    want = [(i, j) for i, k, a, b in left for j, m, c, d in right if k == m and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b]
    got = matching.overlaps(spark.createDataFrame(left, "i int, k int, a double, b double"), spark.createDataFrame(right, "j int, k int, c double, d double"), "a", "b", "c", "d", ("k",))
    assert got.columns == ["i", "k", "a", "b", "j", "c", "d"]
    assert _sorted(got.select("i", "j").collect()) == _sorted(want)
    none = spark.createDataFrame([], "j int, k int, c double, d double")
    assert matching.overlaps(spark.createDataFrame(left, "i int, k int, a double, b double"), none, "a", "b", "c", "d", ("k",)).collect() == []


def test_running_totals(spark, chunks):
    rows = [(i, k, s, None if v is None or v != v else v) for i, (k, s, v) in enumerate(_rows(7, 200))]
    want = []
    for k in {r[1] for r in rows}:
        total = None
        for i, _, _, v in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            total = total if v is None else (total or 0.0) + v
            want.append((i, total))
    got = series.running_totals(spark.createDataFrame(rows, "i int, k int, s int, v double"), "s", "v", "c", ("k",), ("i",))
    assert _sorted(got.select("i", "c").collect()) == _sorted(want)


def test_roots_of_rows(spark):
    """A line, a cubic, a root at an end, and rows that cannot be solved."""
    rows = [(1, [-3.0, 2.0], 0.0, 5.0), (2, [-8.0, 0.0, 0.0, 1.0], 1.0, 9.0), (3, [0.0, 1.0], 4.0, 6.0), (4, [1.0], 0.0, 1.0), (5, None, 0.0, 1.0), (6, [1.0, None], 0.0, 1.0), (7, [], 0.0, 1.0), (8, [-1.0, 1.0], None, 2.0), (9, [float("nan")], 0.0, 1.0)]
    got = {r.i: r for r in roots.row_roots(spark.createDataFrame(rows, "i int, c array<double>, a double, b double"), "c", "a", "b").collect()}
    assert {i: round(got[i].root, 12) for i in (1, 2, 3)} == {1: 1.5, 2: 3.0, 3: 4.0}
    assert all(got[i].ok and got[i].residual < 1e-9 and got[i].error is None for i in (1, 2, 3))
    assert "sign" in got[4].error
    assert all(got[i].root is None and not got[i].ok and "no function" in got[i].error for i in (5, 6, 7, 8, 9))


def test_unmatched_with_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK_ROWS", 64)
    left = [(i, v) for i, v in enumerate([5.0] * 200 + [7.5] * 100 + [None, 1.0, 2.4, 9.9, 30.0])]
    right = [1.2, 7.4, None, 11.8, 11.8]
    want = [i for i, v in left if v is None or not any(r is not None and abs(v - r) < 2 for r in right)]
    got = series.unmatched(spark.createDataFrame(left, "i int, v double"), spark.createDataFrame([(r,) for r in right], "r double"), "v", "r", 2.0)
    assert sorted(r.i for r in got.collect()) == want


def _shuffled(spark):
    """Records that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.length())}


def test_overlaps_copy_only_rows_that_can_meet(spark):
    """Rows of keys that the other side has not are left out; the others go to no level that is nobody's own there."""
    left = spark.range(3000).selectExpr("id % 300 AS k", "id AS x", "id AS a", "id + pow(2, id % 10) AS b")
    right = spark.createDataFrame([(5, 1, 0, 3000), (None, 2, 0, 1)], "k long, y long, c long, d long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        assert matching.overlaps(left, right, "a", "b", "c", "d", ("k",)).count() == 10
        moved = sum(n for s, n in _shuffled(spark).items() if s not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved < 500
    none = matching.overlaps(left, right.where("false"), "a", "b", "c", "d", ("k",))
    assert none.columns == ["k", "x", "a", "b", "y", "c", "d"] and none.count() == 0


def test_overlaps_send_only_few_copies(spark, monkeypatch):
    """Files of few rows are not sent to all tasks if these make many copies."""
    left = spark.createDataFrame([(i, i % 3, i, i + 2 ** (i % 9)) for i in range(60)], "x int, k int, a long, b long")
    right = spark.createDataFrame([(i, i % 4, i, i + 2 ** (i % 8)) for i in range(60)], "y int, k int, c long, d long")
    want = [(r.x, q.y) for r in left.collect() for q in right.collect() if r.k == q.k and r.a <= q.d and q.c <= r.b]
    for most, sent in ((5000, True), (50, False)):
        monkeypatch.setattr(matching, "BROADCAST_COPIES", most, raising=False)
        for one, other, names in ((left, right, ("a", "b", "c", "d")), (right, left.where("x < 40"), ("c", "d", "a", "b"))):
            got = matching.overlaps(one, other, *names, ("k",))
            assert ("SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()) == sent
            assert _sorted(got.select("x", "y").collect()) == _sorted([w for w in want if one is left or w[0] < 40])


def test_frames_hold_few_rows_in_python(spark, monkeypatch):
    """A frame operator cuts series that other operators leave whole, by the rows that it may hold in Python."""
    monkeypatch.setattr(series, "FRAME_ROWS", 50)
    cuts, cut = [], series._cut
    monkeypatch.setattr(series, "_cut", lambda *a, **k: cuts.append(cut(*a, **k)) or cuts[-1])
    df = spark.range(1000).selectExpr("id % 2 AS k", "id * 7 % 1000 AS o", "cast(id % 13 AS double) AS v")
    rows = df.collect()
    for keys in ((), ("k",)):
        got = {(r.k, r.o): (r.n, r.total) for r in series.clipped_stats(df, "o", "v", keys, 300).collect()}
        frame = lambda r, keys=keys: [x.v for x in rows if r.o - 300 <= x.o <= r.o and (not keys or x.k == r.k)]
        assert got == {(r.k, r.o): (len(frame(r)), sum(frame(r))) for r in rows}
        assert max(r["count"] for r in cuts[-1].rows.groupBy(*keys, "_serion_chunk").count().collect()) <= 60
