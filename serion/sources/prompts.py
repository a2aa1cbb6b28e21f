"""Prompts answered by an injected client, row by row, in Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer(prompts: DataFrame, client: Callable[[str], str], *, prompt_col: str = "prompt") -> DataFrame:
    """(prompt, answer, error) per row; an exception of the client becomes the row's error. A null prompt is not sent."""

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, "no prompt"
        try:
            return client(prompt), None
        except Exception as e:  # noqa: BLE001  any failure belongs to its row
            return None, f"{type(e).__name__}: {e}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["prompt", "answer", "error"])

    return prompts.select(F.col(prompt_col).alias("prompt")).mapInArrow(task, "prompt string, answer string, error string")
