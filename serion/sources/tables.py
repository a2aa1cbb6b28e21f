"""Schemas, readers and writers of zero tables, number files, point results and snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serion.functions import parse
from serion.sources import runs

ZERO_SCHEMA = "n long, t double, t_max double, method string, precision int, run_ts string"
#: Column names of earlier layouts and ours (fixed values).
RENAMED = {"partie_imaginaire": "t", "imaginary_part": "t", "imag": "t", "zero_num": "n", "T_MAX": "t_max", "methode": "method", "algorithm": "method", "precision_dps": "precision", "calcule_le": "run_ts", "computed_at": "saved_at", "sauvegarde_le": "saved_at"}
#: The first ten zeros (fixed values).
FIRST_ZEROS = (14.134725141734695, 21.022039638771556, 25.01085758014569, 30.424876125859512, 32.93506158773919, 37.586178158825675, 40.9187190121475, 43.327073280915, 48.00515088116716, 49.7738324776723)
#: Points that are evaluated where no file is given (fixed values).
TEST_POINTS = ((2.0, 0.0), (3.0, 0.0), (4.0, 0.0), (0.5, 0.0), (1.5, 0.0), (0.5, 14.1347))
FALLBACK_POINTS = ((0.5, 14.0), (0.5, 21.0), (0.5, 25.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0), (0.5, 0.0), (1.5, 0.0), (2.5, 0.0), (3.5, 0.0))


def first_zeros(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FIRST_ZEROS, 1)), "n long, t_ref double")


def points(spark: SparkSession, values=TEST_POINTS) -> DataFrame:
    return spark.createDataFrame([(tuple(v),) for v in values], "s struct<re:double,im:double>")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_zeros(spark: SparkSession, path: str) -> DataFrame:
    """A zero table in any of the layouts, under our column names."""
    df = spark.read.csv(path, header=True)
    kinds = {"n": "long", "t": "double", "t_max": "double", "precision": "int", "saved_at": "timestamp"}
    names = [(c, RENAMED.get(c, c)) for c in df.columns]
    return df.select(*[F.col(a).cast(kinds.get(b, "string")).alias(b) for a, b in names])


def read_reference(spark: SparkSession, path: str, fetch: Callable[[str], None] | None = None) -> DataFrame:
    """(t_ref) from the first column of a CSV file; a missing file is fetched if a hook is given, else empty."""
    if not _exists(spark, path) and fetch is not None:
        try:
            fetch(path)
        except OSError:
            pass
    if not _exists(spark, path):
        return spark.createDataFrame([], "t_ref double")
    df = spark.read.csv(path, header=True)
    return df.select(F.col(df.columns[0]).cast("double").alias("t_ref"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(token, s) of a free-form number file, s null for what is no number; a missing file gives the fallback points."""
    if not _exists(spark, path):
        return points(spark, FALLBACK_POINTS).select(parse.complex_text(F.col("s")).alias("token"), "s")
    text = spark.read.text(path)
    tokens = text.select(F.explode(parse.tokens(F.col("value"))).alias("token"))
    return tokens.select("token", parse.parse_number(F.col("token")).alias("s"))


def seed_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Writes the sample number file if there is none, then reads it."""
    if not _exists(spark, path):
        lines = [(f"{a}+{b}j" if b else f"{a}",) for a, b in FALLBACK_POINTS]
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    return read_numbers(spark, path)


def run_dir(base: str, t_max: float, run_ts: str) -> str:
    """Folder of one run; run_ts (yyyyMMdd_HHmmss) is taken once."""
    return f"{base.rstrip('/')}/T{t_max:.0f}_{run_ts}"


def write_zeros(zeros: DataFrame, path: str, fmt: str = "parquet") -> None:
    out = zeros.write.mode("overwrite")
    out.csv(path, header=True) if fmt == "csv" else out.format(fmt).save(path)


def write_points(results: DataFrame, path: str) -> None:
    """Point results with complex numbers as text and NaN for a missing value."""
    text = results.select(parse.complex_text(F.col("s")).alias("s"), parse.complex_text(F.col("zeta_s")).alias("zeta_s"), "seconds", "ok", "error")
    text.write.mode("overwrite").csv(path, header=True, nullValue="NaN")


def write_numbered(zeros: DataFrame, path: str, first: int = 20) -> None:
    """(zero_num, imag) of the first zeros as one CSV file."""
    rows = zeros.orderBy("n").limit(first).select(F.col("n").alias("zero_num"), F.col("t").alias("imag"))
    rows.coalesce(1).sortWithinPartitions("zero_num").write.mode("overwrite").csv(path, header=True)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Writes a CSV unless df is empty."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True)
    return True


def write_snapshots(zeros: DataFrame, path: str, run: str, every: int = 100) -> None:
    """Adds the full hundreds that earlier runs have not published; read_snapshots reads them all."""
    runs.publish_snapshots(zeros, path, run, every)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return runs.read_runs(spark, path)
