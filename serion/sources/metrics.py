"""System metrics as a Spark data source (batch and streaming)."""

from __future__ import annotations

import glob
import re
import subprocess
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Sensor groups in order of priority, labels of the processor's line, and the thermal zones' files (fixed values).
PRIORITY = ("coretemp", "acpitz", "k10temp", "cpu_thermal", "zenpower")
LABELS = ("Core 0", "CPU Temperature", "Tdie")
ZONES = "/sys/class/thermal/thermal_zone*/temp"
SCHEMA = "elapsed_s double, temp_c double, cpu_pct double, ram_used_gb double, ram_pct double"


def from_groups(groups: dict[str, list]) -> float | None:
    """Mean of the positive readings of the first sensor group that has any."""
    positive = ([x.current for x in groups.get(name, []) if x.current and x.current > 0] for name in PRIORITY)
    found = next(filter(None, positive), None)
    return sum(found) / len(found) if found else None


def from_report(report: str) -> float | None:
    """Degrees of the first line of a sensor report that tells the processor's."""
    line = next((x for x in report.splitlines() if any(label in x for label in LABELS)), "")
    number = re.search(r":\s*\+?(-?[0-9]+(?:\.[0-9]+)?)", line)
    return float(number[1]) if number else None


def from_zones(texts: list[str]) -> float | None:
    """The hottest of some thermal zones, which tell thousandths of a degree."""
    known = [int(t) / 1000 for t in texts if re.fullmatch(r"\s*-?[0-9]+\s*", t)]
    return max(known, default=None)


def _groups() -> dict[str, list]:
    import psutil

    return getattr(psutil, "sensors_temperatures", dict)()


def _report() -> str:
    return subprocess.run(["sensors"], capture_output=True, text=True, check=True, timeout=10).stdout


def _zones() -> list[str]:
    out = []
    for path in sorted(glob.glob(ZONES)):
        try:
            with open(path, encoding="ascii") as f:
                out.append(f.read())
        except OSError:  # a zone that cannot be read is left out
            continue
    return out


#: What is read, and how it is understood, in order of priority.
READERS: tuple[tuple[Callable, Callable], ...] = ((_groups, from_groups), (_report, from_report), (_zones, from_zones))


def temperature(readers: tuple[tuple[Callable, Callable], ...] = READERS) -> float | None:
    """The first reading that any of the readers has; one that fails counts as without."""
    for read, understand in readers:
        try:
            found = understand(read())
        except (OSError, ValueError, subprocess.SubprocessError):
            continue
        if found is not None:
            return found
    return None


def sample(began: float) -> tuple:
    import psutil

    memory = psutil.virtual_memory()
    return (time.time() - began, temperature(), psutil.cpu_percent(interval=0.1), memory.used / 1e9, memory.percent)


class _Batch(DataSourceReader):
    def __init__(self, n: int):
        self.n = n

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        began = time.time()
        for _ in range(self.n):
            yield sample(began)


class _Stream(SimpleDataSourceStreamReader):
    """One sample per micro-batch. Samples are kept until they are committed, so a batch that is run again
    within the application gets the same ones; after a restart, samples that were not committed are drawn anew."""

    def __init__(self) -> None:
        self.began = time.time()
        self.kept: dict[int, tuple] = {}

    def _sample(self, n: int) -> tuple:
        if n not in self.kept:
            self.kept[n] = sample(self.began)
        return self.kept[n]

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter([self._sample(start["n"])]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self._sample(n) for n in range(start["n"], end["n"])])

    def commit(self, end: dict) -> None:
        self.kept = {n: x for n, x in self.kept.items() if n >= end["n"]}


class MetricsSource(DataSource):
    """``spark.dataSource.register(MetricsSource)``, then format "system_metrics"; option samples for batch reads."""

    @classmethod
    def name(cls) -> str:
        return "system_metrics"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(int(self.options.get("samples", "1")))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream()
