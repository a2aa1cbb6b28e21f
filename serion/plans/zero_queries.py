"""Zeros, special functions and everything that is generated or literal."""

from __future__ import annotations

from pyspark.sql import functions as F

from serion.functions import classify, special
from serion.operators import points, scan, series
from serion.plans.registry import query, table
from serion.sources import config, tables

T_MAX, STEP, RUN = 100.0, 0.05, "20260101_000000"
TERMS = int(3 * T_MAX)
#: Height of the configured run (10142 zeros).
PRODUCTION_T_MAX = 10_000.0


#: Phases of the detectors in DuckDB's words; the last one gives the imaginary part of zeta.
_PHASES = {"hardy_z": "({t} / 2 * ln({t} / (2 * pi())) - {t} / 2 - pi() / 8 + 1 / (48 * {t}) + 7 / (5760 * {t} ** 3) + 31 / (80640 * {t} ** 5))", "real_zeta": "0.0", "imaginary": "(-pi() / 2)"}


def _z_of(t: str, detector: str, terms: int) -> str:
    """The detector at t by Euler-Maclaurin summation."""
    p, n = _PHASES[detector].format(t=t), f"{terms}.0::DOUBLE"
    e = f"({p} - {t} * ln({n}))"
    return f"""(list_sum(list_transform(range(1, {terms}), lambda n: cos({p} - {t} * ln(n::DOUBLE)) / sqrt(n::DOUBLE))) + sqrt({n}) * ({t} * sin({e}) - 0.5 * cos({e})) / ({t} * {t} + 0.25)
  + 0.5 * cos({e}) / sqrt({n}) + (0.5 * cos({e}) - {t} * sin({e})) / (12 * ({n}) ** 1.5) - ((1.875 - 4.5 * {t} * {t}) * cos({e}) - (5.75 * {t} - {t} ** 3) * sin({e})) / (720 * ({n}) ** 3.5))"""


def _z_sql(detector: str = "hardy_z", step: float = STEP, t_max: float = T_MAX) -> str:
    """Grid values z (k, t, z) and brackets r (n, low, high), in DuckDB's words."""
    n, terms = round((t_max - scan.ORIGIN) / step), int(3 * t_max)
    return f"""
z AS (SELECT k, t, {_z_of("t", detector, terms)} AS z FROM (SELECT range AS k, 10.0::DOUBLE + range * {step}::DOUBLE AS t FROM range({n + 1}))),
b AS (SELECT *, lag(t) OVER (ORDER BY k) AS pt, lag(z) OVER (ORDER BY k) AS pz FROM z),
r AS (SELECT row_number() OVER (ORDER BY t) AS n, pt AS low, t AS high FROM b WHERE pz * z < 0 OR z = 0)"""


def _zeros_sql(detector: str = "hardy_z", step: float = STEP, terms: int = 3000, rounds: int = 45) -> str:
    """The same, and zeros f (n, t) by halving every bracket."""
    c = _z_of("((a + b) / 2)", detector, terms)
    return f"""RECURSIVE {_z_sql(detector, step)},
h AS (SELECT n, low AS a, high AS b, {_z_of("low", detector, terms)} AS fa, 0 AS k FROM r
  UNION ALL SELECT n, CASE WHEN fa * fc > 0 THEN c ELSE a END, CASE WHEN fa * fc > 0 THEN b ELSE c END, CASE WHEN fa * fc > 0 THEN fc ELSE fa END, k + 1
  FROM (SELECT *, (a + b) / 2 AS c, {c} AS fc FROM h WHERE k < {rounds})),
f AS (SELECT n::BIGINT AS n, (a + b) / 2 AS t FROM h WHERE k = {rounds})"""


@query(f"WITH {_z_sql()} SELECT n::BIGINT AS n, round(low, 3) AS low, round(high, 3) AS high FROM r")
def hardy_z_brackets(spark, sf_dir):
    """Sign changes of Hardy's Z up to 100, with native expressions."""
    return scan.brackets(spark, T_MAX, STEP).select("n", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query(f"WITH {_z_sql()} SELECT k::BIGINT AS k, round(t, 3) AS t, round(z, 6) AS z FROM z")
def hardy_z_values(spark, sf_dir):
    """Hardy's Z on the grid."""
    return scan.grid(spark, T_MAX, STEP).select("k", F.round("t", 3).alias("t"), F.round(special.hardy_z(F.col("t"), TERMS), 6).alias("z"))


@query(f"WITH {_z_sql('real_zeta', 0.1)} SELECT n::BIGINT AS n, round(low, 3) AS low, round(high, 3) AS high FROM r")
def real_part_brackets(spark, sf_dir):
    """Sign changes of the unrotated detector: more crossings than zeros."""
    return scan.brackets(spark, T_MAX, 0.1, "real_zeta").select("n", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


_EST = f"{T_MAX} / (2 * pi()) * ln({T_MAX} / (2 * pi() * exp(1.0)))"


@query(f"WITH {_z_sql()} SELECT count(*) AS n_zeros, trunc({_EST})::BIGINT AS expected, round({_EST} + 0.875, 6) AS expected_corrected FROM r")
def zero_count_vs_estimate(spark, sf_dir):
    """Zeros found against the counting formula, without and with its next term."""
    t = F.lit(T_MAX)
    return scan.brackets(spark, T_MAX, STEP).agg(F.count("*").alias("n_zeros")).select("n_zeros", special.zero_estimate(t).cast("long").alias("expected"), F.round(special.zero_estimate(t, 0.875), 6).alias("expected_corrected"))


_TEN = ", ".join(f"({k}, {t!r}::DOUBLE)" for k, t in enumerate(tables.FIRST_ZEROS, 1))


@query(f"WITH {_zeros_sql()} SELECT n, t_ref, CASE WHEN abs(t - t_ref) < 1e-8 THEN 'ok' WHEN abs(t - t_ref) < 1e-4 THEN 'warn' ELSE 'fail' END AS status FROM f JOIN (VALUES {_TEN}) v(n, t_ref) USING (n)")
def first_zeros_check(spark, sf_dir):
    """The refined zeros against the ten known ones."""
    zeros = scan.zero_table(spark, 60.0, STEP, run_ts=RUN)
    got = series.compared(zeros, F.broadcast(tables.first_zeros(spark)), "t", "t_ref")
    return got.select("n", "t_ref", classify.error_tier(F.col("abs_err")).alias("status"))


@query(f"WITH {_zeros_sql()} SELECT n, round(t, 8) AS t, {T_MAX}::DOUBLE AS t_max, 'Hardy Z + Illinois' AS method, 15 AS precision, '{RUN}' AS run_ts FROM f")
def zeros_refined(spark, sf_dir):
    """The final table up to 100, refined in lock-step."""
    return scan.zero_table(spark, T_MAX, STEP, run_ts=RUN).withColumn("t", F.round("t", 8))


@query(f"WITH {_zeros_sql()} SELECT n, round(t, 8) AS t FROM f")
def newton_scan(spark, sf_dir):
    """Zeros refined by Newton's method, by halving where it leaves the bracket."""
    return series.ranked(scan.accepted(scan.candidates(spark, T_MAX, STEP, refiner="newton")), "t").select("n", F.round("t", 8).alias("t"))


@query()
def zeros_table(spark, sf_dir):
    """The whole final table at the height of the configured run."""
    return scan.zero_table(spark, PRODUCTION_T_MAX, STEP, run_ts=RUN)


@query(f"""
WITH g AS (SELECT k, t, sqrt(t / (2 * pi())) AS a, floor(sqrt(t / (2 * pi())))::INT AS m, {_PHASES["hardy_z"].format(t="t")} AS p
  FROM (SELECT range AS k, 10.0::DOUBLE + range * {STEP}::DOUBLE AS t FROM range({round((PRODUCTION_T_MAX - scan.ORIGIN) / STEP) + 1}))),
z AS (SELECT k, t, 2 * list_sum(list_transform(range(1, m + 1), lambda n: cos(p - t * ln(n::DOUBLE)) / sqrt(n::DOUBLE)))
  + (CASE WHEN m % 2 = 1 THEN 1 ELSE -1 END) * cos(2 * pi() * ((a - m) ** 2 - (a - m) - 1.0 / 16)) / cos(2 * pi() * (a - m)) / sqrt(a) AS z FROM g),
b AS (SELECT t, z, lag(t) OVER (ORDER BY k) AS pt, lag(z) OVER (ORDER BY k) AS pz FROM z)
SELECT floor((pt + t) / 1000)::BIGINT AS block, count(*) AS n FROM b WHERE pz * z < 0 GROUP BY 1""")
def zeros_by_block(spark, sf_dir):
    """Zeros of the whole production run, counted by blocks of 500."""
    return zeros_table(spark, sf_dir).groupBy(F.floor(F.col("t") / 500).alias("block")).agg(F.count("*").alias("n"))


@query(f"WITH {_zeros_sql()} SELECT count(*) AS n_zeros, round(min(t), 8) AS first_t, round(max(t), 8) AS last_t, round(count(*) / {T_MAX}, 6) AS rate, trunc({_EST})::BIGINT AS expected, round({_EST} + 0.875, 6) AS expected_corrected FROM f")
def run_summary(spark, sf_dir):
    """Count, first and last zero, rate and expected counts of a run."""
    got = scan.run_summary(scan.zero_table(spark, T_MAX, STEP, run_ts=RUN), T_MAX)
    return got.select("n_zeros", F.round("first_t", 8).alias("first_t"), F.round("last_t", 8).alias("last_t"), F.round("rate", 6).alias("rate"), "expected", F.round("expected_corrected", 6).alias("expected_corrected"))


#: Zeros of the unrotated detector with their residuals.
_LEGACY_SQL = f"""{_zeros_sql("real_zeta", 0.1)},
x AS (SELECT t, sqrt({_z_of("t", "real_zeta", 3000)} ** 2 + {_z_of("t", "imaginary", 3000)} ** 2) AS residual FROM f)"""


@query(f"WITH {_LEGACY_SQL} SELECT count(*) FILTER (WHERE residual < 1e-9) AS accepted, count(*) FILTER (WHERE NOT residual < 1e-9) AS rejected FROM x")
def residual_split(spark, sf_dir):
    """Refined sign changes of the unrotated detector by residual; rejects are kept as rows, not lost."""
    found = scan.candidates(spark, T_MAX, 0.1, "real_zeta", "bisect")
    counts = [part(found, 1e-9).agg(F.count("*").alias(name)) for part, name in ((scan.accepted, "accepted"), (scan.rejected, "rejected"))]
    return counts[0].join(counts[1])  # one row each


@query(f"WITH {_LEGACY_SQL} SELECT row_number() OVER (ORDER BY t) AS n, round(t, 7) AS t FROM x WHERE residual < 1e-9")
def legacy_scan(spark, sf_dir):
    """Zeros by the unrotated detector and halving: its other sign changes are no zeros and are rejected."""
    return series.ranked(scan.accepted(scan.candidates(spark, T_MAX, 0.1, "real_zeta", "bisect"), 1e-9), "t").select("n", F.round("t", 7).alias("t"))


@query(f"WITH {_z_sql(t_max=1000.0)} SELECT count(*) AS n_zeros, round(1000 / (2 * pi()) * ln(1000 / (2 * pi() * exp(1.0))) + 0.875, 6) AS expected_corrected FROM r")
def zeros_to_1000(spark, sf_dir):
    """All zeros up to 1000."""
    zeros = scan.accepted(scan.candidates(spark, 1000.0, STEP))
    return zeros.agg(F.count("*").alias("n_zeros")).select("n_zeros", F.round(special.zero_estimate(F.lit(1000.0), 0.875), 6).alias("expected_corrected"))


@query(f"""WITH {_zeros_sql()},
g AS (SELECT list(t ORDER BY n) AS g FROM f WHERE n <= 20), i AS (SELECT range AS i, ((range // 2) % 20 + 1) % 20 + 1 AS nx, (range // 2) % 20 + 1 AS own FROM range(50)),
bits AS (SELECT i, CASE WHEN (CASE WHEN i % 2 = 0 THEN 1 / ln(g[nx]) ELSE (g[nx] - g[own]) / ln(g[nx]) END) > 1 THEN 1 ELSE 0 END AS bit FROM i, g)
SELECT string_agg(bit::VARCHAR, '' ORDER BY i) AS bits, sum(CASE WHEN i < 32 THEN bit * pow(2.0, -(i + 1)) ELSE 0 END) AS fraction FROM bits""")
def gap_bits(spark, sf_dir):
    """Bits from the gaps of the first twenty zeros, and their first 32 as a fraction."""
    return scan.bit_string(scan.gap_bits(scan.zero_table(spark, 80.0, STEP, run_ts=RUN), 50))


@query(f"WITH {_zeros_sql()} SELECT n, round(t, 8) AS t FROM f WHERE n <= 20")
def first_twenty_zeros(spark, sf_dir):
    """The n-th zero for n = 1 .. 20."""
    return scan.zero_table(spark, 80.0, STEP, run_ts=RUN).orderBy("t").limit(20).select("n", F.round("t", 8).alias("t"))


@query("SELECT round(pi(), 12) AS pi, round(0.5772156649015329, 9)::DOUBLE AS euler_gamma, round(exp(1.0), 12) AS e, 120::BIGINT AS factorial_5, 120.0::DOUBLE AS gamma_6, round(-0.5772156649015329, 9)::DOUBLE AS psi_1, round(-1.9635100260214235, 9)::DOUBLE AS psi_half, round(0.42278433509846713, 9)::DOUBLE AS psi_2, round(pi() / 6, 9) AS xi_2, round(pi() / 6, 9) AS xi_minus_1, round(sqrt(pi()), 9) AS gamma_half, round(-2 * sqrt(pi()), 9) AS gamma_minus_half")
def gamma_identities(spark, sf_dir):
    """Factorial, Gamma, digamma and the symmetry of the completed function."""
    v = lambda x: F.lit(float(x))
    r = lambda c, d=9: F.round(c, d)
    return spark.range(1).select(
        r(F.pi(), 12).alias("pi"), r(-special.digamma(v(1))).alias("euler_gamma"), r(F.e(), 12).alias("e"), F.factorial(F.lit(5)).alias("factorial_5"), r(special.gamma(v(6)), 8).alias("gamma_6"),
        r(special.digamma(v(1))).alias("psi_1"), r(special.digamma(v(0.5))).alias("psi_half"), r(special.digamma(v(2))).alias("psi_2"),
        r(special.xi(v(2))).alias("xi_2"), r(special.xi(v(-1))).alias("xi_minus_1"), r(special.gamma(v(0.5))).alias("gamma_half"), r(special.gamma(v(-0.5))).alias("gamma_minus_half"),
    )


def _zeta_sql(values, terms: int = 1000) -> str:
    """zeta (s_re, s_im, zeta_re, zeta_im) of some points by Euler-Maclaurin summation; nulls at the pole."""
    rows, n = ", ".join(f"({re}::DOUBLE, {im}::DOUBLE)" for re, im in values), f"{terms}.0::DOUBLE"
    return f"""
points AS (SELECT col0 AS s_re, col1 AS s_im FROM (VALUES {rows})),
e AS (SELECT *, ({n}) ** -s_re * cos(s_im * ln({n})) AS er, -(({n}) ** -s_re) * sin(s_im * ln({n})) AS ei, nullif((s_re - 1) ** 2 + s_im ** 2, 0) AS d,
  list_sum(list_transform(range(1, {terms}), lambda k: (k::DOUBLE) ** -s_re * cos(s_im * ln(k::DOUBLE)))) AS sr,
  -list_sum(list_transform(range(1, {terms}), lambda k: (k::DOUBLE) ** -s_re * sin(s_im * ln(k::DOUBLE)))) AS si,
  s_re ** 2 - s_im ** 2 + s_re AS qr, 2 * s_re * s_im + s_im AS qi FROM points),
p AS (SELECT *, qr * (s_re + 2) - qi * s_im AS pr, qr * s_im + qi * (s_re + 2) AS pi FROM e),
zeta AS (SELECT s_re, s_im,
  sr + {n} * (er * (s_re - 1) + ei * s_im) / d + er / 2 + (s_re * er - s_im * ei) / (12 * {n}) - (pr * er - pi * ei) / (720 * ({n}) ** 3) AS zeta_re,
  si + {n} * (ei * (s_re - 1) - er * s_im) / d + ei / 2 + (s_re * ei + s_im * er) / (12 * {n}) - (pr * ei + pi * er) / (720 * ({n}) ** 3) AS zeta_im FROM p)"""


_POINTS = (*tables.TEST_POINTS, (-1.0, 0.0), (1.0, 0.0))


@query(f"WITH {_zeta_sql(_POINTS)} SELECT s_re, s_im, round(zeta_re, 8) AS zeta_re, round(zeta_im, 8) + 0.0 AS zeta_im, zeta_re IS NOT NULL AS ok, CASE WHEN zeta_re IS NULL THEN 'pole at s = 1' END AS error FROM zeta")
def point_evaluation(spark, sf_dir):
    """zeta at the test points, at -1 and at the pole: an error row does not stop the others."""
    got = points.evaluate(tables.points(spark, _POINTS))
    return got.select(F.col("s.re").alias("s_re"), F.col("s.im").alias("s_im"), F.round("zeta_s.re", 8).alias("zeta_re"), (F.round("zeta_s.im", 8) + 0.0).alias("zeta_im"), "ok", "error")


@query(f"WITH {_zeta_sql(_POINTS)} SELECT count(*) AS n_points, count(zeta_re) AS n_ok, count(*) - count(zeta_re) AS n_failed FROM zeta")
def point_totals(spark, sf_dir):
    """Points, successes and failures of a run; the seconds spent, which differ from run to run, are left out."""
    return points.run_totals(points.evaluate(tables.points(spark, _POINTS))).drop("seconds")


@query("SELECT round(0.5 * ln(pi() / ((exp(pi() * 14.1347) + exp(-pi() * 14.1347)) / 2)), 9) AS log_modulus, round(pi() / ((exp(pi() * 14.1347) + exp(-pi() * 14.1347)) / 2) * 1e18, 6) AS square_e18")
def complex_gamma(spark, sf_dir):
    """Gamma at 1/2 + 14.1347 i: ln of the modulus, and the square of the modulus, pi / cosh(pi t)."""
    got = points.log_gammas(tables.points(spark, (tables.TEST_POINTS[5],)))
    square = F.col("gamma.re") * F.col("gamma.re") + F.col("gamma.im") * F.col("gamma.im")
    return got.select(F.round("log_gamma.re", 9).alias("log_modulus"), F.round(square * 1e18, 6).alias("square_e18"))


@query(f"WITH {_zeta_sql(tables.FALLBACK_POINTS, 2)} SELECT s_re AS re, s_im AS im, CASE WHEN s_im <> 0 THEN 'complex' ELSE 'real' END AS kind FROM points")
def category_split(spark, sf_dir):
    """Points by category."""
    from serion.functions import parse

    s = F.col("s")
    return tables.points(spark, tables.FALLBACK_POINTS).select(s["re"].alias("re"), s["im"].alias("im"), parse.number_kind(s).alias("kind"))


_PLANE = (*tables.FALLBACK_POINTS, (1.0, 0.0), (2.0, 3.0), (0.5, -14.0))


@query(f"WITH {_zeta_sql(_PLANE)} SELECT CASE WHEN s_im > 0 THEN 'above' ELSE 'on axis' END AS part, s_re, s_im, round(sqrt(zeta_re ** 2 + zeta_im ** 2), 8) AS modulus FROM zeta WHERE s_im >= 0 AND zeta_re IS NOT NULL")
def half_plane(spark, sf_dir):
    """Curve data: the modulus at successful points above and on the real axis."""
    got = points.evaluate(tables.points(spark, _PLANE)).where("ok")
    above = points.upper_half(got).select(F.lit("above").alias("part"), F.col("s.re").alias("s_re"), F.col("s.im").alias("s_im"), "modulus")
    axis = points.on_axis(got).select(F.lit("on axis").alias("part"), F.col("x").alias("s_re"), F.lit(0.0).alias("s_im"), "modulus")
    return above.union(axis).withColumn("modulus", F.round("modulus", 8))


_GIVEN = {"tol": "1e-12", "max_iter": 200, "save_csv": False, "T_max": 500}
_rows = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in d.items())


@query(f"""WITH own(k, v) AS (VALUES {_rows(config.defaults())}), given(k, v) AS (VALUES {_rows(_GIVEN)})
SELECT k, coalesce(given.v, own.v) AS v, TRY_CAST(coalesce(given.v, own.v) AS DOUBLE) AS number FROM own LEFT JOIN given USING (k)""")
def config_overlay(spark, sf_dir):
    """Given values over the defaults; a number given as text is a number."""
    return config.overlaid(spark, _GIVEN)


@query("SELECT a::INT AS angle, m::INT AS modulus, round(m * cos(radians(a)), 9) AS x, round(-m * sin(radians(a)), 9) + 0.0 AS y, round(m, 9)::DOUBLE AS rx, true AS ry_is_zero FROM (SELECT range AS a FROM range(-165, 166, 15)), (SELECT range AS m FROM range(25, 91, 13))")
def phase_rotation(spark, sf_dir):
    """Rotation by the opposite phase lays every vector on the real axis."""
    grid = spark.range(23).select((F.col("id") * 15 - 165).cast("int").alias("angle"), F.explode(F.sequence(F.lit(25), F.lit(90), F.lit(13))).alias("modulus"))
    x, y, rx, ry = classify.rotated(F.col("modulus").cast("double"), F.col("angle"))
    return grid.select("angle", "modulus", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(rx, 9).alias("rx"), (F.abs(ry) < 1e-9).alias("ry_is_zero"))


@query(f"""WITH {_zeros_sql()}
SELECT floor(t)::BIGINT AS cell, round(t, 6) AS t, count(event_id) AS n_events, round(min(value), 6) AS least FROM f LEFT JOIN events ON floor(value) = floor(t) WHERE n <= 20 GROUP BY 1, 2""")
def zeros_and_events(spark, sf_dir):
    """Events whose value falls into the unit cell of a zero: the flagship, over a table."""
    zeros = scan.zero_table(spark, 80.0, STEP, run_ts=RUN).where("n <= 20").select(F.floor("t").alias("cell"), F.round("t", 6).alias("t"))
    cells = table(spark, sf_dir, "events").groupBy(F.floor("value").alias("cell")).agg(F.count("event_id").alias("n_events"), F.min("value").alias("least"))
    return zeros.join(cells, "cell", "left").select("cell", "t", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.round("least", 6).alias("least"))


