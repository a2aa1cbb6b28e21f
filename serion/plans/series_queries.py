"""Series operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serion.functions import classify, parse
from serion.operators import matching, roots, series
from serion.plans.registry import query, table
from serion.sources import logs, runs, tokens
from serion.sources.storage import Scratch
from serion.streaming import monitor

_SECONDS = "unix_micros(cast(ts as timestamp))"
_US = "epoch_us(ts)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the time as microseconds."""
    return table(spark, sf_dir, "events").withColumn("us", F.expr(_SECONDS))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gaps(_events(spark, sf_dir), "us", ("user_id",), "gap_us")


_GAPS_SQL = f"SELECT * FROM (SELECT event_id, user_id, {_US} AS us, {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts) AS gap_us FROM events) WHERE gap_us IS NOT NULL"
_ALL_GAPS_SQL = f"SELECT * FROM (SELECT {_US} AS us, {_US} - lag({_US}) OVER (ORDER BY ts) AS gap_us FROM events) WHERE gap_us IS NOT NULL"


@query(f"SELECT event_id, user_id, gap_us FROM ({_GAPS_SQL})")
def event_gaps(spark, sf_dir):
    """First differences per user."""
    return _gaps(spark, sf_dir).select("event_id", "user_id", "gap_us")


@query(f"SELECT us, gap_us FROM ({_ALL_GAPS_SQL})")
def global_gaps(spark, sf_dir):
    """First differences of the whole series, without one sort of it all."""
    return series.gaps(_events(spark, sf_dir), "us", (), "gap_us").select("us", "gap_us")


def _histogram_sql(source: str, value: str, bins: int, extra: str = "") -> str:
    return f"""
WITH v AS ({source}), s AS (SELECT min({value}) AS lo, max({value}) AS hi, (max({value}) - min({value}))::DOUBLE / {bins} AS w FROM v),
c AS (SELECT (CASE WHEN w > 0 THEN least(floor(({value} - lo) / w)::INT, {bins - 1}) ELSE 0 END) + 1 AS bin, count(*) AS n FROM v, s GROUP BY 1),
e AS (SELECT b.bin::INT AS bin, lo + (b.bin - 1) * w AS l, lo + b.bin * w AS r FROM range(1, {bins + 1}) b(bin), s)
SELECT bin, round(l, 3) AS "left", round(r, 3) AS "right", coalesce(n, 0)::BIGINT AS n{extra} FROM e LEFT JOIN c USING (bin)"""


@query(_histogram_sql(f"SELECT gap_us FROM ({_GAPS_SQL})", "gap_us", 40))
def gap_histogram(spark, sf_dir):
    """Equal-width histogram of the gaps, empty bins listed."""
    return _rounded(series.histogram_once(_gaps(spark, sf_dir), "gap_us", 40))


def _rounded(h: DataFrame) -> DataFrame:
    return h.withColumn("left", F.round("left", 3)).withColumn("right", F.round("right", 3))


@query(f"SELECT count(*) AS n_gaps, min(gap_us) AS least, max(gap_us) AS largest, round(avg(gap_us), 3) AS mean FROM ({_GAPS_SQL})")
def gap_summary(spark, sf_dir):
    """Count, extremes and mean of the gaps."""
    return _gaps(spark, sf_dir).agg(F.count("*").alias("n_gaps"), F.min("gap_us").alias("least"), F.max("gap_us").alias("largest"), F.round(F.avg("gap_us"), 3).alias("mean"))


@query(f"SELECT user_id, n::BIGINT AS n, gap_us FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n, gap_us FROM ({_GAPS_SQL})) WHERE n >= 2")
def rank_gap_series(spark, sf_dir):
    """Gap against rank, the first gap of each user dropped."""
    return series.ranked(_gaps(spark, sf_dir), "us", keys=("user_id",)).where("n >= 2").select("user_id", "n", "gap_us")


@query("""
WITH m AS (SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1),
d AS (SELECT event_id, user_id, ts, value - mean AS d FROM events JOIN m USING (user_id)),
p AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY ts) AS p, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM d)
SELECT user_id, e AS prev_event_id, event_id FROM p WHERE p * d < 0""")
def mean_crossings(spark, sf_dir):
    """Sign changes of value - mean, per user."""
    e = _events(spark, sf_dir)
    mean = e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    d = e.join(mean, "user_id").withColumn("d", F.col("value") - F.col("mean"))
    got = series.previous(d, "us", ["d", "event_id"], ("user_id",))
    return got.where(F.col("prev_d") * F.col("d") < 0).select("user_id", "prev_event_id", "event_id")


_RING = "OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, count(value) {_RING} AS n, min(value) {_RING} AS least, max(value) {_RING} AS largest, (sum(value::DECIMAL(12,2)) {_RING})::DOUBLE / count(value) {_RING} AS mean FROM events")
def ring_buffer_stats(spark, sf_dir):
    """Statistics of the last 300 rows of each kind of event."""
    e = _events(spark, sf_dir).withColumn("cents", F.col("value").cast("decimal(12,2)"))  # exact sums
    got = series.ring_stats(e, "us", "cents", ("event_type",))
    return got.select("event_id", "n", F.col("least").cast("double").alias("least"), F.col("largest").cast("double").alias("largest"), (F.col("total").cast("double") / F.col("n")).alias("mean"))


@query("""
SELECT event_id, count(value) OVER w AS n, round(avg(value) OVER w, 6) AS mean, min(value) OVER w AS least, max(value) OVER w AS largest FROM (SELECT *, (epoch_us(ts) // 1000000) AS s FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)""")
def clip_300s(spark, sf_dir):
    """Statistics of the last 300 seconds of each user."""
    e = _events(spark, sf_dir).withColumn("s", F.floor(F.col("us") / 1000000))
    return series.clipped_stats(e, "s", "value", ("user_id",)).select("event_id", "n", F.round("mean", 6).alias("mean"), "least", "largest")


@query("""
SELECT event_id, count(value) OVER w AS n, round(avg(value) OVER w, 6) AS mean, min(value) OVER w AS least, max(value) OVER w AS largest FROM (SELECT *, (epoch_us(ts) // 60000000) AS m FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY m RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)""")
def clip_300_minutes(spark, sf_dir):
    """Statistics of the last 300 minutes of each kind of event: frames of many rows."""
    e = _events(spark, sf_dir).withColumn("m", F.floor(F.col("us") / 60000000))
    return series.clipped_stats(e, "m", "value", ("event_type",)).select("event_id", "n", F.round("mean", 6).alias("mean"), "least", "largest")


@query("""
SELECT event_id, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 75 THEN 'warn' ELSE 'normal' END AS temp_class,
  CASE WHEN value > 80 THEN 'danger' WHEN value > 50 THEN 'warm' ELSE 'normal' END AS cpu_class FROM events""")
def threshold_class(spark, sf_dir):
    """Classes of a value as temperature and as load."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", classify.temperature_class(v).alias("temp_class"), classify.load_class(v).alias("cpu_class"))


@query("""
WITH k AS (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 1),
e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = (SELECT event_type FROM k) THEN NULL ELSE value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM e""")
def locf_errors(spark, sf_dir):
    """Rows of one kind count as failed readings and take the last good value."""
    e = _events(spark, sf_dir)
    bad = F.broadcast(e.agg(F.min("event_type").alias("bad")))  # one row
    v = e.join(bad).withColumn("v", F.when(F.col("event_type") != F.col("bad"), F.col("value")))
    return series.carried_forward(v, "us", "v", ("user_id",), "carried").select("event_id", "carried")


@query("SELECT (n // 100)::BIGINT AS snapshot, n::BIGINT AS n, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey FROM orders) WHERE n % 100 = 0")
def snapshots_100(spark, sf_dir):
    """Every hundredth row in order, with the number of rows so far."""
    return series.snapshots(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT o_orderpriority, n, o_orderkey FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n, o_orderkey FROM orders) WHERE n % 100 = 0")
def every_hundredth(spark, sf_dir):
    """Emission of every hundredth row of each series."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return series.ranked(o, "o_orderkey", keys=("o_orderpriority",)).where("n % 100 = 0")


def _two_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("t"))
    return left, table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("t_ref"))


def _two_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left, right = _two_values(spark, sf_dir)
    return series.ranked(left, "o_orderkey"), series.ranked(right, "l_orderkey")


_TWO_SQL = """
WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey, o_totalprice AS t FROM orders),
b AS (SELECT row_number() OVER (ORDER BY l_orderkey) AS n, l_orderkey, t_ref FROM (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS t_ref FROM lineitem GROUP BY 1))"""


@query(_TWO_SQL + " SELECT n::BIGINT AS n, t, t_ref, round(abs(t - t_ref), 6) AS abs_err, round(abs(t - t_ref) / abs(t_ref) * 100, 6) AS rel_err_pct FROM a JOIN b USING (n)")
def series_compare(spark, sf_dir):
    """Positional pairing of two series with absolute and relative errors."""
    got = series.compared(*_two_series(spark, sf_dir), "t", "t_ref")
    return got.select("n", "t", "t_ref", F.round("abs_err", 6).alias("abs_err"), F.round("rel_err_pct", 6).alias("rel_err_pct"))


@query(_TWO_SQL + " SELECT round(avg(abs(t - t_ref)), 4) AS mean_abs_err, count(*) AS n FROM a JOIN b USING (n)")
def mean_deviation(spark, sf_dir):
    """Mean absolute deviation of two paired series."""
    got = series.compared(*_two_series(spark, sf_dir), "t", "t_ref")
    return got.agg(F.round(F.avg("abs_err"), 4).alias("mean_abs_err"), F.count("*").alias("n"))


@query(_TWO_SQL + " SELECT o_orderkey, t FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE t_ref > t - 5 AND t_ref < t + 5)")
def missing_detector(spark, sf_dir):
    """Values of one series that the other has nowhere within the tolerance."""
    left, right = _two_series(spark, sf_dir)
    return series.unmatched(left, right, "t", "t_ref", 5.0).select("o_orderkey", "t")


@query("SELECT epoch_us(time_bucket(INTERVAL '30 seconds', ts)) AS start_us, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def tumbling_30s(spark, sf_dir):
    """Tumbling windows of 30 seconds of event time."""
    return monitor.tumbling(table(spark, sf_dir, "events"), "ts", "value").select(F.unix_micros("start").alias("start_us"), "n", F.round("mean", 6).alias("mean"))


@query("SELECT epoch_us(time_bucket(INTERVAL '30 seconds', ts)) AS start_us, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_tumbling_30s(spark, sf_dir):
    """The same windows by Structured Streaming over all there is now; the last state of each window."""
    scratch = Scratch(spark, "streams")
    out = scratch.folder("out")
    stream = monitor.tumbling(monitor.read_files(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema), "ts", "value")
    monitor.run_to_end(stream, "update", lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(out), scratch.folder("state"))
    scratch.drop("state")
    got = spark.read.parquet(out).groupBy("start").agg(F.max(F.struct("batch", "n", "mean")).alias("x"))
    return got.select(F.unix_micros("start").alias("start_us"), "x.n", F.round("x.mean", 6).alias("mean"))


@query("SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS largest, round(sum(value), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events) WHERE r <= 300 GROUP BY 1")
def stream_ring_buffer(spark, sf_dir):
    """The last 300 rows of each kind of event kept as bounded state of a stream; the last state."""
    scratch = Scratch(spark, "streams")
    out = scratch.folder("out")
    source = monitor.read_files(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    source = source.withColumn("us", F.expr(_SECONDS))
    stream = monitor.ring_buffers(source, "event_type", "us", "value")
    monitor.run_to_end(stream, "update", lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(out), scratch.folder("state"))
    scratch.drop("state")
    got = spark.read.parquet(out).groupBy("key").agg(F.max(F.struct("batch", "n", "least", "largest", "mean")).alias("x"))
    return got.select(F.col("key").alias("event_type"), "x.n", "x.least", "x.largest", F.round(F.col("x.mean") * F.col("x.n"), 2).alias("total"))


@query("""SELECT event_id, CASE WHEN e < 1e-8 THEN 'ok' WHEN e < 1e-4 THEN 'warn' ELSE 'fail' END AS status FROM (SELECT event_id, value / pow(10.0, event_id % 13) AS e FROM events)""")
def error_tiers(spark, sf_dir):
    """Errors of many sizes by tier."""
    error = F.col("value") / F.pow(F.lit(10.0), F.col("event_id") % 13)
    return table(spark, sf_dir, "events").select("event_id", classify.error_tier(error).alias("status"))


_SAMPLES_SQL = "SELECT epoch_us(ts) / 1e6 AS elapsed_s, CASE WHEN event_type <> 'view' THEN value END AS temp_c, value AS cpu_pct FROM events"


def _samples(events: DataFrame) -> DataFrame:
    """Events as samples of a monitor; one kind has no temperature."""
    return events.select((F.expr(_SECONDS) / 1e6).alias("elapsed_s"), F.when(F.col("event_type") != "view", F.col("value")).alias("temp_c"), F.col("value").alias("cpu_pct"))


@query(f"SELECT min(temp_c) AS least, max(temp_c) AS largest, round(avg(temp_c), 6) AS mean, count(*) FILTER (WHERE temp_c IS NULL) AS dropped FROM ({_SAMPLES_SQL})")
def dashboard_stats(spark, sf_dir):
    """Statistics of all samples that have a temperature, and how many have none."""
    samples = _samples(table(spark, sf_dir, "events"))
    dropped = samples.agg(F.count_if(F.col("temp_c").isNull()).alias("dropped"))  # one row
    return monitor.dashboard(samples)["stats"].withColumn("mean", F.round("mean", 6)).join(dropped)


@query(_histogram_sql(f"SELECT temp_c FROM ({_SAMPLES_SQL}) WHERE temp_c IS NOT NULL ORDER BY elapsed_s DESC LIMIT 300", "temp_c", 20, ", CASE WHEN l >= 90 THEN 'critical' WHEN l >= 75 THEN 'warn' ELSE 'normal' END AS class"))
def stream_dashboard(spark, sf_dir):
    """The histogram that the live dashboard shows after the last refresh of a stream."""
    scratch = Scratch(spark, "streams")
    source = monitor.read_files(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    out = scratch.folder("shown")
    shown = lambda parts, k: parts["histogram"].write.mode("overwrite").parquet(out)
    monitor.live_dashboard(_samples(source), shown, scratch.folder("state"), scratch.folder("kept"))
    scratch.drop("state", "kept")
    return _rounded(spark.read.parquet(out))


@query("""SELECT event_id, strftime(ts, '%a %b %d %H:%M:%S') AS taken_at, value AS first_c, round(value + 1.5, 2) AS hottest_c, CASE WHEN event_id % 3 > 0 THEN 2::BIGINT ELSE 0 END AS n_sensors,
  CASE WHEN event_id % 2 = 0 THEN (user_id % 100)::DOUBLE END AS gpu_pct, CASE WHEN event_id % 2 = 0 THEN user_id::DOUBLE END AS gpu_mb, CASE WHEN event_id % 2 = 0 THEN 61.0::DOUBLE END AS gpu_c
FROM events WHERE event_id % 3 > 0
UNION ALL SELECT event_id, strftime(ts, '%a %b %d %H:%M:%S'), NULL, NULL, 0, CASE WHEN event_id % 2 = 0 THEN (user_id % 100)::DOUBLE END, CASE WHEN event_id % 2 = 0 THEN user_id::DOUBLE END, CASE WHEN event_id % 2 = 0 THEN 61.0::DOUBLE END FROM events WHERE event_id % 3 = 0""")
def sampler_snapshots(spark, sf_dir):
    """Snapshots of the external sampler's text log, made of events and read back; some lack a section."""
    e = table(spark, sf_dir, "events")
    text = lambda c: c.cast("string")
    time = F.date_format(F.col("ts").cast("timestamp"), "EEE MMM dd HH:mm:ss")
    sensors = F.concat(F.lit("--- sensors ---\n  temp1_input: "), text(F.col("value")), F.lit("\n  temp2_input: "), text(F.round(F.col("value") + 1.5, 2)), F.lit("\n"))
    card = F.concat(F.lit("--- nvidia-smi ---\n"), text(F.col("user_id") % 100), F.lit(" %, "), text(F.col("user_id")), F.lit(" MiB, 61\n"))
    block = F.concat(time, F.lit(" ===\n--- iostat ---\nsda 1.0 2.0\n"), F.when(F.col("event_id") % 3 > 0, sensors).otherwise(""), F.when(F.col("event_id") % 2 == 0, card).otherwise(""))
    got = logs.snapshots(e.select("event_id", block.alias("block")), keep=("event_id",))
    first, hottest = F.get("temps", F.lit(0)), F.array_max("temps")
    return got.select("event_id", "taken_at", first.alias("first_c"), hottest.alias("hottest_c"), F.size("temps").cast("long").alias("n_sensors"), "gpu_pct", "gpu_mb", "gpu_c")


_TOKEN = "CASE event_id % 6 WHEN 0 THEN value::VARCHAR || ',' || user_id::VARCHAR || 'j' WHEN 1 THEN value::VARCHAR || '-' || user_id::VARCHAR || 'i' WHEN 2 THEN 'inf abc' WHEN 3 THEN '-' || value::VARCHAR || '+j' WHEN 4 THEN '1e' || (user_id % 5)::VARCHAR || '  nan' ELSE '' END"
_NUM = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


@query(rf"""
WITH l AS (SELECT event_id, {_TOKEN} AS line FROM events),
t AS (SELECT event_id, unnest(list_filter(string_split_regex(translate(line, ',', ' '), '\s+'), lambda x: x <> '')) AS token FROM l),
p AS (SELECT event_id, token, regexp_matches(token, '^[+-]?{_NUM}$') AS is_real,
  regexp_matches(token, '^([+-]?{_NUM})?[+-]?({_NUM})?[ij]$') AS is_complex,
  regexp_extract(token, '^([+-]?{_NUM})([+-])', 1) AS re, regexp_extract(token, '([+-]?({_NUM})?)[ij]$', 1) AS im FROM t)
SELECT event_id, token, CASE WHEN is_real THEN token::DOUBLE WHEN is_complex THEN coalesce(TRY_CAST(re AS DOUBLE), 0.0) END AS re,
  CASE WHEN is_real THEN 0.0 WHEN is_complex THEN CASE im WHEN '' THEN 1.0 WHEN '+' THEN 1.0 WHEN '-' THEN -1.0 ELSE TRY_CAST(im AS DOUBLE) END END AS im,
  CASE WHEN is_complex AND NOT regexp_matches(im, '^[+-]?0+$') THEN 'complex' WHEN is_real OR is_complex THEN 'real' ELSE 'skipped' END AS kind FROM p""")
def parse_numbers(spark, sf_dir):
    """Free-form lines made of event values, split and typed: real, complex or skipped."""
    v, u = F.col("value").cast("string"), F.col("user_id").cast("string")
    line = F.when(F.col("event_id") % 6 == 0, F.concat(v, F.lit(","), u, F.lit("j"))).when(F.col("event_id") % 6 == 1, F.concat(v, F.lit("-"), u, F.lit("i"))).when(F.col("event_id") % 6 == 2, "inf abc")
    line = line.when(F.col("event_id") % 6 == 3, F.concat(F.lit("-"), v, F.lit("+j"))).when(F.col("event_id") % 6 == 4, F.concat(F.lit("1e"), (F.col("user_id") % 5).cast("string"), F.lit("  nan"))).otherwise("")
    t = table(spark, sf_dir, "events").select("event_id", F.explode(parse.tokens(line)).alias("token"))
    s = parse.parse_number(F.col("token"))
    return t.withColumn("s", s).select("event_id", "token", F.col("s.re").alias("re"), F.col("s.im").alias("im"), parse.number_kind(F.col("s")).alias("kind"))


@query("""
WITH s AS (SELECT n_name, s_suppkey % 3 AS g, s_acctbal AS v, s_acctbal::DECIMAL(12,2) AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT n_name, (sum(d) FILTER (WHERE g = 0 AND v > 0))::DOUBLE / count(*) FILTER (WHERE g = 0 AND v > 0) AS a,
  (sum(d) FILTER (WHERE g = 1 AND v > 0))::DOUBLE / count(*) FILTER (WHERE g = 1 AND v > 0) AS b, max(v / 1000) FILTER (WHERE g = 2) AS c FROM s GROUP BY 1)
SELECT n_name, coalesce(a, b, CASE WHEN c > 0 THEN c END) AS sensor FROM m""")
def priority_sensor(spark, sf_dir):
    """Per place: mean of the positive readings of the first group that has any, else of the second, else the scaled maximum."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    group, v = F.col("s_suppkey") % 3, F.col("s_acctbal")

    def mean(k: int):
        there = (group == k) & (v > 0)
        return F.sum(F.when(there, v.cast("decimal(12,2)"))).cast("double") / F.nullif(F.count_if(there), F.lit(0))

    means = s.groupBy("n_name").agg(mean(0).alias("a"), mean(1).alias("b"), F.max(F.when(group == 2, classify.degrees(v))).alias("c"))
    return means.select("n_name", classify.first_present(F.col("a"), F.col("b"), F.col("c")).alias("sensor"))


@query("SELECT event_id, round(value / 1e9, 15) AS gb, round(value / 1000, 6) AS degrees, round(90 - value / 100 * 360, 6) AS angle FROM events")
def unit_scaling(spark, sf_dir):
    """Unit scaling and the gauge's angle."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(classify.gigabytes(v), 15).alias("gb"), F.round(classify.degrees(v), 6).alias("degrees"), F.round(classify.gauge_angle(v), 6).alias("angle"))


@query(_histogram_sql("SELECT value FROM events", "value", 20, ", CASE WHEN l >= 90 THEN 'critical' WHEN l >= 75 THEN 'warn' ELSE 'normal' END AS class"))
def temperature_histogram(spark, sf_dir):
    """Histogram of 20 bins, each with the class of its left edge."""
    e = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("elapsed_s"), F.col("value").alias("temp_c"), F.col("value").alias("cpu_pct"))
    return _rounded(monitor.dashboard(e)["histogram"])


@query("SELECT event_id AS elapsed_s, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 75 THEN 'warn' ELSE 'normal' END AS temp_class, CASE WHEN value > 80 THEN 'danger' WHEN value > 50 THEN 'warm' ELSE 'normal' END AS cpu_class, round(90 - value / 100 * 360, 6) AS angle FROM events ORDER BY event_id DESC LIMIT 1")
def dashboard_current(spark, sf_dir):
    """What a refresh shows as current."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("elapsed_s"), F.col("value").alias("temp_c"), F.col("value").alias("cpu_pct"))
    return monitor.dashboard(e)["current"].select("elapsed_s", "temp_class", "cpu_class", F.round("angle", 6).alias("angle"))


@query("SELECT event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 60e6::DOUBLE AS minutes FROM events")
def elapsed_minutes(spark, sf_dir):
    """Minutes since the first event of the user."""
    e = _events(spark, sf_dir)
    first = e.groupBy("user_id").agg(F.min("us").alias("first"))
    return e.join(first, "user_id").select("event_id", ((F.col("us") - F.col("first")) / 60e6).alias("minutes"))


@query("SELECT user_id, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event, count(*) AS n FROM events GROUP BY 1")
def first_and_last(spark, sf_dir):
    """First and last element of each series."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def first_twenty(spark, sf_dir):
    """The first twenty rows in order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20)


@query("SELECT event_id, 'Core ' || (event_id % 8)::VARCHAR || ':  +' || value::VARCHAR || '°C  (high = +80.0°C)' AS line, value AS degrees FROM events")
def sensor_lines(spark, sf_dir):
    """Degrees parsed from the lines of a sensor report."""
    line = F.concat(F.lit("Core "), (F.col("event_id") % 8).cast("string"), F.lit(":  +"), F.col("value").cast("string"), F.lit("°C  (high = +80.0°C)"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line")).withColumn("degrees", parse.sensor_value(F.col("line")))


@query("SELECT event_id, printf('%.3f', value) AS fixed, printf('zeros_T%.0f_%s.csv', value + 0.123, strftime(ts, '%Y%m%d_%H%M%S')) AS file, printf('(%.10f%s%.10fj)', value, CASE WHEN user_id % 2 = 0 AND user_id > 0 THEN '-' ELSE '+' END, user_id::DOUBLE) AS complex FROM events")
def formatted_numbers(spark, sf_dir):
    """Fixed formats, file names with a compact time, complex numbers as text."""
    im = F.when(F.col("user_id") % 2 == 0, -F.col("user_id").cast("double")).otherwise(F.col("user_id").cast("double"))
    s = F.struct(F.col("value").alias("re"), im.alias("im"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss")
    return table(spark, sf_dir, "events").select("event_id", F.format_string("%.3f", "value").alias("fixed"), parse.file_name("zeros", F.col("value") + 0.123, stamp, "csv").alias("file"), parse.complex_text(s).alias("complex"))


@query("SELECT event_id, (floor(value)::BIGINT % 100 = 0 AND abs(value - round_even(value, 0)) < 0.05) AS due, floor(value)::BIGINT % 100 = 0 AS due_in_unit, floor(value)::BIGINT % 50 = 0 AS due_at_50 FROM events")
def periodic_trigger(spark, sf_dir):
    """Whether a row is due for the periodic report, in its present and its two earlier forms."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", classify.periodic(v, 0.05).alias("due"), classify.within_unit(v).alias("due_in_unit"), classify.within_unit(v, 50).alias("due_at_50"))


@query("""
SELECT event_id, count(value) OVER w AS n, min(value) OVER w AS least, max(value) OVER w AS largest, round(sum(value) OVER w, 2) AS total FROM (SELECT *, (epoch_us(ts) // 1000000) AS s FROM events)
WINDOW w AS (ORDER BY s RANGE BETWEEN 432000 PRECEDING AND CURRENT ROW)""")
def clip_five_days(spark, sf_dir):
    """Statistics of the last five days over all events: each frame holds a sixth of the table."""
    e = _events(spark, sf_dir).withColumn("s", F.floor(F.col("us") / 1000000))
    return series.clipped_stats(e, "s", "value", (), 432_000).select("event_id", "n", "least", "largest", F.round("total", 2).alias("total"))


_DAYS_SQL = "SELECT o_custkey AS user_id, epoch_us(o_orderdate + INTERVAL '10 years') // 1000000 AS paid_s, max(o_totalprice) AS price FROM orders GROUP BY 1, 2"


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest order of each customer and day, ten years later: into the time of the events."""
    o = table(spark, sf_dir, "orders").withColumn("paid_s", F.expr("unix_seconds(cast(o_orderdate + interval '10' year as timestamp))"))
    return o.groupBy(F.col("o_custkey").alias("user_id"), "paid_s").agg(F.max("o_totalprice").alias("price"))


@query(f"""
WITH p AS ({_DAYS_SQL}), e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events)
SELECT e.event_id, p.paid_s, p.price FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.s >= p.paid_s""")
def asof_last_order(spark, sf_dir):
    """Each event with the last order of its user until then."""
    e = _events(spark, sf_dir).select("event_id", "user_id", F.floor(F.col("us") / 1000000).alias("s"))
    return matching.as_of(e, _paid(spark, sf_dir), "s", "paid_s", ("price",), ("user_id",)).select("event_id", "paid_s", "price")


@query("""
WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM events), v AS (SELECT s, event_id AS view_id, value AS seen FROM e WHERE event_type = 'view'),
r AS (SELECT s AS view_s, max({'id': view_id, 'seen': seen}) AS m FROM v GROUP BY 1),
j AS (SELECT e.event_id, e.s, r.view_s, r.m.id AS view_id, r.m.seen AS seen FROM e ASOF LEFT JOIN r ON e.s > r.view_s)
SELECT event_id, CASE WHEN s - view_s <= 900 THEN view_s END AS view_s, CASE WHEN s - view_s <= 900 THEN view_id END AS view_id, CASE WHEN s - view_s <= 900 THEN seen END AS seen FROM j""")
def asof_recent_view(spark, sf_dir):
    """Each event with the last view strictly before it, of whatever user, no more than 900 seconds back."""
    e = _events(spark, sf_dir).withColumn("s", F.floor(F.col("us") / 1000000))
    views = e.where("event_type = 'view'").select(F.col("s").alias("view_s"), F.col("event_id").alias("view_id"), F.col("value").alias("seen"))
    return matching.as_of(e.select("event_id", "s"), views, "s", "view_s", ("view_id", "seen"), tolerance=900, strict=True).select("event_id", "view_s", "view_id", "seen")


_SESSIONS_SQL = """
WITH g AS (SELECT *, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 28800000000, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM g)"""


@query(_SESSIONS_SQL + " SELECT user_id, min(us) AS begin_us, max(us) AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def user_sessions(spark, sf_dir):
    """Sessions of each user: events no more than eight hours apart."""
    e = matching.sessions(_events(spark, sf_dir), "us", 28_800_000_000, ("user_id",), "begin_us", ("event_id",))
    return e.groupBy("user_id", "begin_us").agg(F.max("us").alias("end_us"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(_SESSIONS_SQL + " SELECT user_id, min(us) AS begin_us, max(us) AS end_us, count(value) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def stream_sessions_and_late(spark, sf_dir):
    """The same sessions from a stream that closes them a day late and keeps the rows that come after that."""
    scratch = Scratch(spark, "streams")
    source = monitor.read_files(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    out = scratch.folder("sessions")
    monitor.sessions_and_late(source, "ts", "value", ("user_id",), out, scratch.folder("state"), gap_s=28_800, late_s=86_400)
    scratch.drop("state")
    return monitor.all_sessions(spark, out, "ts", "value", ("user_id",), gap_s=28_800).withColumn("total", F.round("total", 4))


_WAY_SQL = "SELECT l_suppkey, epoch_us(l_shipdate) // 86400000000 AS d1, epoch_us(l_shipdate) // 86400000000 + l_quantity::BIGINT % 5 AS d2 FROM lineitem"


@query(f"""
WITH s AS ({_WAY_SQL}), b AS (SELECT *, max(d2) OVER (PARTITION BY l_suppkey ORDER BY d1, d2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, sum((before IS NULL OR d1 - before > 1)::INT) OVER (PARTITION BY l_suppkey ORDER BY d1, d2 ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT l_suppkey, min(d1) AS d1, max(d2) AS d2, count(*) AS lines FROM g GROUP BY l_suppkey, k""")
def busy_spans(spark, sf_dir):
    """Days without a break in which a supplier has lines on their way (each for nought to four days); lines without a day or a quantity count, too."""
    shipped = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", shipped.alias("d1"), (shipped + F.rint("l_quantity").cast("long") % 5).alias("d2"), F.lit(1).alias("lines"))
    return matching.merged_spans(lines, "d1", "d2", 1, ("l_suppkey",), ("lines",), every=True)


_PAIR_SQL = """
, v AS (SELECT t AS v, 0 AS side FROM a UNION ALL SELECT t_ref, 1 FROM b),
g AS (SELECT v, side, row_number() OVER o AS r, coalesce(v - lag(v) OVER o >= 5, true) AS opens FROM v WINDOW o AS (ORDER BY v, side)),
u AS (SELECT v, side, sum(opens::INT) OVER (ORDER BY r) AS run, r FROM g),
w AS MATERIALIZED (SELECT run, side, v, row_number() OVER (PARTITION BY run, side ORDER BY r) AS k FROM u),
l AS MATERIALIZED (SELECT run, v, k FROM w WHERE side = 0), m AS MATERIALIZED (SELECT run, v, k FROM w WHERE side = 1)"""


@query(_TWO_SQL.replace("WITH a", "WITH RECURSIVE a") + _PAIR_SQL + """,
s AS (SELECT DISTINCT run, 1 AS i, 1 AS j, ''::VARCHAR AS kind, NULL::DOUBLE AS t, NULL::DOUBLE AS t_ref FROM u
  UNION ALL SELECT s.run, i + (x.kind <> 'extra')::INT, j + (x.kind <> 'missing')::INT, x.kind, CASE WHEN x.kind <> 'extra' THEN l.v END, CASE WHEN x.kind <> 'missing' THEN m.v END
  FROM s LEFT JOIN l ON l.run = s.run AND l.k = i LEFT JOIN m ON m.run = s.run AND m.k = j,
    LATERAL (SELECT CASE WHEN m.v IS NULL OR l.v <= m.v - 5 THEN 'missing' WHEN l.v IS NULL OR m.v <= l.v - 5 THEN 'extra' ELSE 'pair' END AS kind) x WHERE l.v IS NOT NULL OR m.v IS NOT NULL)
SELECT kind, t, t_ref FROM s WHERE kind <> ''""")
def matched_one_to_one(spark, sf_dir):
    """Order prices and sums of their lines paired one to one within 5, in order, and what either side has alone."""
    left, right = _two_values(spark, sf_dir)
    return matching.matched(left, right, "t", "t_ref", 5.0)


_EDGES = [0, 1, 10, 60, 300, 900, 3600]


@query(f"""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS s FROM events),
p AS (SELECT a.event_type, abs(a.s - b.s) AS d FROM e a JOIN e b ON a.event_type = b.event_type AND a.event_id < b.event_id AND abs(a.s - b.s) < {_EDGES[-1]})
SELECT event_type, bin, count(*) AS n FROM (SELECT event_type, (CASE {" ".join(f"WHEN d < {e} THEN {k}" for k, e in enumerate(_EDGES[1:], 1))} END)::INT AS bin FROM p) GROUP BY ALL""")
def pair_correlation(spark, sf_dir):
    """Distances of all pairs of events of a kind that lie less than an hour apart, in bins."""
    e = _events(spark, sf_dir).withColumn("s", F.floor(F.col("us") / 1000000))
    return matching.pair_distances(e, "s", [float(x) for x in _EDGES], ("event_type",))


_SPANS_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey, epoch_us(o_orderdate) // 86400000000 AS d1, greatest(epoch_us(l_shipdate), epoch_us(o_orderdate)) // 86400000000 AS d2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""
WITH s AS ({_SPANS_SQL}), u AS (SELECT user_id % 10 + 1 AS l_suppkey, event_id, epoch_us(ts - INTERVAL '26 years') // 86400000000 AS e1, epoch_us(ts - INTERVAL '26 years') // 86400000000 + floor(value)::BIGINT % 3 + CASE WHEN event_id % 1000 = 0 THEN 1000 ELSE 0 END AS e2 FROM events)
SELECT l_orderkey, l_linenumber, event_id FROM s JOIN u ON s.l_suppkey = u.l_suppkey AND s.d1 <= u.e2 AND u.e1 <= s.d2""")
def overlapping_spans(spark, sf_dir):
    """Lines of orders on their way while a campaign of their supplier runs; one campaign in a thousand is very long."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("cast(floor(unix_micros(cast(o_orderdate as timestamp)) / 86400000000) as bigint)").alias("d1"))
    lines = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = F.expr("cast(floor(unix_micros(cast(l_shipdate as timestamp)) / 86400000000) as bigint)")
    lines = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "d1", F.greatest(shipped, F.col("d1")).alias("d2"))
    e = table(spark, sf_dir, "events")
    first = F.expr("cast(floor(unix_micros(cast(ts - interval '26' year as timestamp)) / 86400000000) as bigint)")
    runs = F.floor("value") % 3 + F.when(F.col("event_id") % 1000 == 0, 1000).otherwise(0)
    e = e.select((F.col("user_id") % 10 + 1).alias("l_suppkey"), "event_id", first.alias("e1"), (first + runs).alias("e2"))
    return matching.overlaps(lines, e, "d1", "d2", "e1", "e2", ("l_suppkey",)).select("l_orderkey", "l_linenumber", "event_id")


@query("SELECT epoch_us(time_bucket(INTERVAL '30 seconds', ts)) AS start_us, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_windows_and_late(spark, sf_dir):
    """Windows of 30 seconds from a stream that closes them after a minute and keeps the rows that come later."""
    scratch = Scratch(spark, "streams")
    source = monitor.read_files(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    out = scratch.folder("windows")
    monitor.windows_and_late(source, "ts", "value", out, scratch.folder("state"))
    scratch.drop("state")
    return monitor.all_windows(spark, out, "ts", "value").select("start_us", "n", F.round("total", 4).alias("total"))


_HALF = "(SELECT count(*) // 2 FROM orders)"


@query(f"""
WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_totalprice FROM orders),
s AS (SELECT (n - 1) // 100 AS snapshot, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM o GROUP BY 1)
SELECT snapshot, rows, total, CASE WHEN (snapshot + 1) * 100 <= {_HALF} THEN 'run-1' ELSE 'run-2' END AS run FROM s WHERE rows = 100""")
def orders_through_runs(spark, sf_dir):
    """Whole snapshots of a hundred orders, published by two runs; the second sees all rows and adds what the first had not."""
    scratch = Scratch(spark, "runs")
    path = scratch.folder("published")
    ranked = scratch.save("ranked", series.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey"))
    half = ranked.agg(F.floor(F.count("*") / 2).alias("half"))  # one row
    runs.publish_snapshots(ranked.join(F.broadcast(half)).where("n <= half").drop("half"), path, "run-1")
    runs.publish_snapshots(ranked, path, "run-2")
    scratch.drop("ranked")
    return runs.read_runs(spark, path).groupBy("snapshot", "run").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, value, event_id FROM events),
r AS (SELECT *, sum(value) OVER w AS c, sum(value) OVER (PARTITION BY user_id) / 2 AS half, lag(s) OVER w AS s0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
x AS (SELECT * FROM r WHERE c - value < half AND half <= c)
SELECT user_id, round(s0 + (half - (c - value)) / value * (s - s0), 3) AS half_s, s0 IS NOT NULL AS ok FROM x""")
def half_of_total(spark, sf_dir):
    """When each user's running total crosses half of it, growing evenly between events; a user whose first event crosses it has no bracket."""
    e = _events(spark, sf_dir).select("user_id", (F.col("us") / 1e6).alias("s"), "value", "event_id")
    curve = series.running_totals(e, "s", "value", "c", ("user_id",), ("event_id",))
    # half of this very curve's end: another order of summing rounds otherwise and may miss it
    half = curve.groupBy(F.col("user_id").alias("of")).agg((F.max_by("c", F.struct("s", "event_id")) / 2).alias("half"))
    curve = series.previous(curve, "s", ["s", "c"], ("user_id",), then=("event_id",)).join(half, F.col("user_id").eqNullSafe(F.col("of")))
    before = F.coalesce("prev_c", F.lit(0.0))
    at = curve.where((before < F.col("half")) & (F.col("half") <= F.col("c")) & (F.abs("c") < float("inf")))
    # by the share of the way from event to event, which may be of one time; rounding never puts the line's end below nought
    need = F.col("half") - before
    line = F.array(-need, F.greatest("value", need)).alias("line")
    share = at.select("user_id", "prev_s", "s", line, F.when(F.col("prev_s").isNotNull(), 0.0).alias("low"), F.lit(1.0).alias("high"))
    got = roots.row_roots(share, "line", "low", "high")
    return got.select("user_id", F.round(F.col("prev_s") + F.col("root") * (F.col("s") - F.col("prev_s")), 3).alias("half_s"), "ok")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def running_totals(spark, sf_dir):
    """Running total of each kind of event."""
    return series.running_totals(_events(spark, sf_dir), "us", "value", "running", ("event_type",), ("event_id",)).select("event_id", F.round("running", 4).alias("running"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
t AS (SELECT doc_id, line, unnest(regexp_extract_all(said, '[^ \t\r\f\x0B,]+')) AS token FROM l),
b AS (SELECT doc_id, line, token, CASE WHEN regexp_matches(token, '^\(.*\)$') THEN token[2:-2] ELSE token END AS bare FROM t),
k AS (SELECT doc_id, line, CASE WHEN regexp_full_match(bare, '[+-]?{_NUM}') THEN 'number' WHEN regexp_full_match(bare, '([+-]?{_NUM})?[+-]?({_NUM})?[ij]') THEN 'imaginary'
  WHEN bare = '' THEN 'nothing in parentheses' WHEN regexp_full_match(bare, '[+-]?(?i:inf|infinity|nan)') THEN 'name of a number' ELSE 'no number' END AS k, bare FROM b)
SELECT doc_id, count(*) AS n_tokens, max(line)::INT AS last_line, count(*) FILTER (WHERE k = 'number') AS n_plain, count(*) FILTER (WHERE k = 'imaginary') AS n_imaginary,
  count(*) FILTER (WHERE k = 'no number') AS n_words, count(*) FILTER (WHERE k = 'name of a number') AS n_names, coalesce(max(TRY_CAST(bare AS DOUBLE)) FILTER (WHERE k = 'number'), 0.0) AS largest FROM k GROUP BY 1""")
def document_numbers(spark, sf_dir):
    """Tokens of every document by type, and the largest of its plain numbers."""
    t = tokens.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    plain = F.col("kind").isin("real", "complex") & ~F.col("token").rlike(r"[ij]\)?$")
    imaginary = F.col("kind").isin("real", "complex") & F.col("token").rlike(r"[ij]\)?$")
    counts = [F.count("*").alias("n_tokens"), F.max("line").alias("last_line"), F.count_if(plain).alias("n_plain"), F.count_if(imaginary).alias("n_imaginary")]
    counts += [F.count_if(F.col("reason") == "no number").alias("n_words"), F.count_if(F.col("reason") == "name of a number").alias("n_names")]
    return t.groupBy("doc_id").agg(*counts, F.coalesce(F.max(F.when(plain, F.col("re"))), F.lit(0.0)).alias("largest"))
