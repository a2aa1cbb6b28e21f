"""Roots of a function of its own in every row, refined in lock-step inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serion.functions import kernel


def row_roots(df: DataFrame, coefficients: str, low: str, high: str) -> DataFrame:
    """df with root, residual, ok and error of each row's polynomial in its bracket [low, high].

    coefficients: an array, the constant first, of powers of (x - low). A row that cannot
    be solved comes back as an error row: something is null or not finite, there are no
    coefficients, or the ends have one sign. All rows of a batch are refined at once; rows
    are done one by one.
    """
    names = df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = [names.index(c) for c in (coefficients, low, high)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x if x is not None and len(x) and None not in x else None for x in b.column(at[0]).to_pylist()]
            a, z = (b.column(k).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for k in at[1:])
            c = np.zeros((b.num_rows, max((len(x) for x in lists if x), default=1)))
            for k, x in enumerate(lists):
                c[k, : len(x or ())] = x or ()
            known = np.array([x is not None for x in lists], bool) & np.isfinite(a) & np.isfinite(z) & np.isfinite(c).all(1)
            live = np.flatnonzero(known)

            def value(x: np.ndarray, rows: np.ndarray, c=c, a=a, live=live) -> np.ndarray:
                mine, out = live[rows], np.zeros(len(x))
                for k in range(c.shape[1] - 1, -1, -1):
                    out = out * (x - a[mine]) + c[mine, k]
                return out

            root = np.full(b.num_rows, np.nan)
            root[live] = kernel.illinois_rows(value, a[live], z[live])
            ok = np.isfinite(root)
            residual = np.full(b.num_rows, np.nan)
            residual[ok] = np.abs(value(root[live][ok[live]], np.flatnonzero(ok[live])))
            error = np.where(ok, None, np.where(known, "no change of sign in the bracket", "no function or no bracket"))
            more = [pa.array(root, mask=~ok), pa.array(residual, mask=~ok), pa.array(ok), pa.array(error.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, "root", "residual", "ok", "error"])

    return df.select(*[F.col(c) for c in names]).mapInArrow(task, f"{kinds}, root double, residual double, ok boolean, error string")
