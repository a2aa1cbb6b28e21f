"""Zeros of the zeta function on the critical line: grid, detection, refinement, acceptance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serion.functions import kernel, special
from serion.operators import series

ORIGIN = 10.0
#: Terms that one task evaluates in expectation (see _cost).
BLOCK_TERMS = 2_000_000
#: Evaluations that refine one zero.
REFINEMENTS = 12
RESIDUAL = 1e-10

Function = Callable[[np.ndarray], np.ndarray]
#: What is evaluated on the grid, and what is refined.
DETECTORS: dict[str, tuple[Function, Function]] = {"hardy_z": (kernel.hardy_z_signs, kernel.hardy_z), "real_zeta": (kernel.real_zeta, kernel.real_zeta)}
REFINERS = {"illinois": kernel.illinois, "bisect": kernel.bisect, "newton": kernel.newton}


def check_height(t_max: float) -> float:
    if t_max < 20:
        raise ValueError("t_max must be 20 or more")
    return float(t_max)


def grid(spark: SparkSession, t_max: float, step: float = 0.05) -> DataFrame:
    """(k, t): t = 10 + k * step up to t_max, in closed form, so any partitioning gives the same points."""
    n = round((check_height(t_max) - ORIGIN) / step)
    return spark.range(n + 1).select(F.col("id").alias("k"), (ORIGIN + F.col("id") * F.lit(step)).alias("t"))


def brackets(spark: SparkSession, t_max: float, step: float = 0.05, detector: str = "hardy_z") -> DataFrame:
    """(n, low, high) of all sign changes, with native expressions only."""
    z = special.hardy_z(F.col("t"), int(3 * t_max)) if detector == "hardy_z" else special.real_zeta(F.col("t"), int(3 * t_max))
    found = series.sign_changes(grid(spark, t_max, step).withColumn("z", z), "t", "z", zero_hits=True)
    found = found.select(F.coalesce("prev_t", "t").alias("low"), F.col("t").alias("high"))
    return series.ranked(found, "high").select("n", "low", "high")


def _cost(t: np.ndarray, step: float, detector: str) -> np.ndarray:
    """Terms per unit of height: of the grid points, and of refining the log(t / 2 pi) / 2 pi zeros."""
    exact = t / 3 + 60
    of_point = np.sqrt(t) + 60 if detector == "hardy_z" else exact
    return of_point / step + REFINEMENTS * exact * np.log(np.maximum(t, 10) / (2 * np.pi)) / (2 * np.pi)


def candidates(spark: SparkSession, t_max: float, step: float = 0.05, detector: str = "hardy_z", refiner: str = "illinois") -> DataFrame:
    """(t, residual) of all refined sign changes; failed refinements have null t.

    The grid is split into blocks of equal cost; each evaluates one point more than
    it owns, so no order over the whole grid is needed.
    """
    n = round((check_height(t_max) - ORIGIN) / step)
    # borders at equal parts of the cost, which grows steadily with the height
    heights = np.linspace(ORIGIN, ORIGIN + n * step, 4097)
    cost = np.concatenate([[0.0], np.cumsum(_cost(heights[1:], step, detector) * np.diff(heights))])
    blocks = max(1, round(cost[-1] / BLOCK_TERMS))
    borders = np.interp(np.linspace(0, cost[-1], blocks + 1), cost, heights)
    first = np.clip(np.round((borders - ORIGIN) / step), 0, n).astype(int).tolist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (on_grid, f), refine = DETECTORS[detector], REFINERS[refiner]
        for b in batches:
            for k in b.column(0).to_pylist():
                t = ORIGIN + step * np.arange(first[k], first[k + 1] + 1)
                z = on_grid(t)
                at = np.flatnonzero(z[1:] * z[:-1] < 0)
                root = np.concatenate([refine(f, t[at], t[at + 1]), t[:-1][z[:-1] == 0]])
                yield pa.RecordBatch.from_arrays([pa.array(root, from_pandas=True), pa.array(kernel.residual(root))], ["t", "residual"])

    return spark.range(0, blocks, 1, blocks).mapInArrow(task, "t double, residual double")


def accepted(found: DataFrame, limit: float = RESIDUAL) -> DataFrame:
    return found.where(F.col("t").isNotNull() & (F.col("residual") < limit))


def rejected(found: DataFrame, limit: float = RESIDUAL) -> DataFrame:
    """Refinements that failed or whose residual is too large."""
    return found.where(F.col("t").isNull() | ~(F.col("residual") < limit))


def zero_table(spark: SparkSession, t_max: float, step: float = 0.05, *, run_ts: str, method: str = "Hardy Z + Illinois", precision: int = 15) -> DataFrame:
    """(n, t, t_max, method, precision, run_ts): the final table."""
    zeros = series.ranked(accepted(candidates(spark, t_max, step)), "t")
    return zeros.select("n", "t", F.lit(float(t_max)).alias("t_max"), F.lit(method).alias("method"), F.lit(precision).alias("precision"), F.lit(run_ts).alias("run_ts"))


def run_summary(zeros: DataFrame, t_max: float) -> DataFrame:
    """One row: count, first, last, zeros per unit, expected count without and with the 7/8 term."""
    t = F.lit(float(t_max))
    return zeros.agg(F.count("t").alias("n_zeros"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).select("*", (F.col("n_zeros") / t).alias("rate"), special.zero_estimate(t).cast("long").alias("expected"), special.zero_estimate(t, 0.875).alias("expected_corrected"))


def gap_bits(zeros: DataFrame, length: int, period: int = 20) -> DataFrame:
    """(i, bit) for i < length from the first ``period`` zeros (n, t).

    With n = (i // 2) % period + 1 (1-based, the neighbour wraps): x is 1 / ln of
    the n-th neighbour for even i, and (neighbour - own) / ln(neighbour) for odd i;
    the bit is x > 1. A fixed sequence that repeats, not a random generator.
    """
    spark = zeros.sparkSession
    few = F.broadcast(zeros.where(F.col("n") <= period).select("n", "t"))  # ``period`` rows
    i = spark.range(length).withColumnRenamed("id", "i").withColumn("own_n", (F.floor(F.col("i") / 2) % period + 1).cast("long"))
    i = i.withColumn("next_n", (F.col("own_n") % period + 1).cast("long"))
    own = few.select(F.col("n").alias("own_n"), F.col("t").alias("own"))
    ahead = few.select(F.col("n").alias("next_n"), F.col("t").alias("ahead"))
    x = F.when(F.col("i") % 2 == 0, 1 / F.log("ahead")).otherwise((F.col("ahead") - F.col("own")) / F.log("ahead"))
    return i.join(own, "own_n").join(ahead, "next_n").select("i", (x > 1).cast("int").alias("bit"))


def bit_string(bits: DataFrame, first: int = 32) -> DataFrame:
    """One row: the bits as text, and the first ones as a binary fraction."""
    fraction = F.sum(F.when(F.col("i") < first, F.col("bit") * F.pow(F.lit(2.0), -(F.col("i") + 1))).otherwise(0.0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "bit"))), lambda x: x["bit"].cast("string")), "")
    return bits.agg(text.alias("bits"), fraction.alias("fraction"))
