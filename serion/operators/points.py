"""Evaluation of zeta at given points: one result or one error per row, never an aborted batch."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serion.functions import kernel

_POINT = pa.struct([("re", pa.float64()), ("im", pa.float64())])


def _zeta_anywhere(s: np.ndarray) -> np.ndarray:
    out = np.empty(len(s), complex)
    right = s.real >= 0.5
    out[right] = kernel.zeta(s[right])
    m = 1 - s[~right]
    # functional equation, with the reflected point in the right half-plane
    out[~right] = 2 * np.exp(-m * np.log(2 * np.pi) + kernel.log_gamma(m)) * np.cos(np.pi * m / 2) * kernel.zeta(m)
    return out


def evaluate(points: DataFrame, s_col: str = "s") -> DataFrame:
    """(s, zeta_s, ok, error, seconds) per row of struct<re, im> points; a pole or a null point is an error row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            re, im = (b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
            s = re + 1j * im
            began = time.perf_counter()
            fine = np.isfinite(s) & (s != 1)
            value = np.full(len(s), np.nan, complex)
            value[fine] = _zeta_anywhere(s[fine])
            took = (time.perf_counter() - began) / max(len(s), 1)
            fine &= np.isfinite(value)
            error = np.where(fine, None, np.where(s == 1, "pole at s = 1", "no finite point or value"))
            whole = lambda x, ok: pa.StructArray.from_arrays([pa.array(x.real), pa.array(x.imag)], fields=list(_POINT), mask=pa.array(~ok))
            yield pa.RecordBatch.from_arrays([whole(s, np.isfinite(s)), whole(value, fine), pa.array(fine), pa.array(error, pa.string()), pa.array(np.full(len(s), took))], ["s", "zeta_s", "ok", "error", "seconds"])

    shape = "struct<re:double,im:double>"
    return points.select(F.col(s_col)["re"].alias("re"), F.col(s_col)["im"].alias("im")).mapInArrow(task, f"s {shape}, zeta_s {shape}, ok boolean, error string, seconds double")


def log_gammas(points: DataFrame, s_col: str = "s") -> DataFrame:
    """(s, log_gamma, gamma) per row of points with a positive real part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(0).to_numpy(zero_copy_only=False) + 1j * b.column(1).to_numpy(zero_copy_only=False)
            logs = kernel.log_gamma(s)
            both = lambda x: pa.StructArray.from_arrays([pa.array(x.real), pa.array(x.imag)], fields=list(_POINT))
            yield pa.RecordBatch.from_arrays([both(s), both(logs), both(np.exp(logs))], ["s", "log_gamma", "gamma"])

    shape = "struct<re:double,im:double>"
    return points.select(F.col(s_col)["re"].alias("re"), F.col(s_col)["im"].alias("im")).mapInArrow(task, f"s {shape}, log_gamma {shape}, gamma {shape}")


def upper_half(results: DataFrame) -> DataFrame:
    """Points above the real axis with the modulus of their value (null where it failed)."""
    return results.where(F.col("s.im") > 0).select("s", F.hypot("zeta_s.re", "zeta_s.im").alias("modulus"))


def on_axis(results: DataFrame) -> DataFrame:
    return results.where(F.col("s.im") == 0).select(F.col("s.re").alias("x"), F.hypot("zeta_s.re", "zeta_s.im").alias("modulus"))


def run_totals(results: DataFrame) -> DataFrame:
    """One row: points, successes, failures, seconds spent on all."""
    return results.agg(F.count("*").alias("n_points"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
