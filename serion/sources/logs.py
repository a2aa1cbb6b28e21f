"""Logs: the application's own, and the text log of the external sampler."""

from __future__ import annotations

import logging
import os
import time
from logging.handlers import RotatingFileHandler

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a log file and days that closed ones are kept (fixed values).
LOG_BYTES, LOG_DAYS = 100_000_000, 30


class _Handler(RotatingFileHandler):
    """Starts a new file at LOG_BYTES and deletes closed ones after LOG_DAYS."""

    def doRollover(self) -> None:
        super().doRollover()
        oldest = time.time() - LOG_DAYS * 86400
        for k in range(1, self.backupCount + 1):
            path = f"{self.baseFilename}.{k}"
            if os.path.exists(path) and os.path.getmtime(path) < oldest:
                os.remove(path)


def run_logger(path: str, name: str = "serion", max_bytes: int = LOG_BYTES) -> logging.Logger:
    """The driver's logger: everything into rotating files, INFO and above on the console."""
    log = logging.getLogger(name)
    log.setLevel(logging.DEBUG)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    files, console = _Handler(path, maxBytes=max_bytes, backupCount=20, encoding="utf-8"), logging.StreamHandler()
    console.setLevel(logging.INFO)
    for handler in (files, console):
        handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
        log.addHandler(handler)
    return log


def read_sampler_log(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """(block) per snapshot of the sampler's log: the text between two time lines ``=== time ===``.

    As a stream, each file is read once, so a log is handed over when it is closed.
    """
    reader = spark.readStream if stream else spark.read
    return reader.option("lineSep", "\n=== ").text(path).select(F.regexp_replace("value", r"^=== ", "").alias("block")).where(F.col("block").contains(" ===\n"))


def _section(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"(?s)--- {name} ---\n(.*?)(?=\n--- |\z)", 1)


def snapshots(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, taken_at, temps, gpu_pct, gpu_mb, gpu_c) per snapshot: its time as text, all readings of its sensors, the first graphics card.

    Sections that are missing or hold no number give an empty list and nulls.
    """
    b = F.col("block")
    temps = F.transform(F.regexp_extract_all(_section(b, "sensors"), F.lit(r"temp[0-9]+_input:\s*(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.cast("double"))
    card = F.regexp_extract(_section(b, "nvidia-smi"), r"^([^\n]*)", 1)
    number = lambda k: F.regexp_extract(F.get(F.split(card, ","), F.lit(k)), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return blocks.select(*keep, F.regexp_extract(b, r"^(.*?) ===", 1).alias("taken_at"), temps.alias("temps"), number(0).alias("gpu_pct"), number(1).alias("gpu_mb"), number(2).alias("gpu_c"))
