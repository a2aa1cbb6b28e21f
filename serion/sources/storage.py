"""Tables that cut lineage, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a session on one machine (tests) has none, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="serion-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables of one run under the shared folder.

    A run drops what no later job reads. What its result still reads is deleted
    when the application ends. (Paths are deleted through the JVM's file system
    API, so this needs a classic session, not Spark Connect.)
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/serion/{name}-{uuid.uuid4().hex}"
        self._names: set[str] = set()

    def _path(self, *names: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *names]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def folder(self, name: str) -> str:
        """The path of a table or folder that goes like the others."""
        if not self._names:
            files, path = self._path()
            files.deleteOnExit(path)
        self._names.add(name)
        return f"{self.base}/{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df and reads it back: later jobs start from the files."""
        df.write.mode("overwrite").parquet(self.folder(name))
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def save_bucketed(self, name: str, df: DataFrame, by: str) -> DataFrame:
        """Like save, with rows of one value of ``by`` in one bucket: joins on it move only the other side.

        Four buckets to each shuffle partition that Spark has now, so few values of ``by`` meet. The catalog entry that the writer
        asks for is dropped at once; the files stay.
        """
        entry = f"serion_{uuid.uuid4().hex}"
        buckets = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("path", self.folder(name)).bucketBy(buckets, by).saveAsTable(entry)
        out = self.spark.table(entry)
        self.spark.sql(f"DROP TABLE {entry}")
        return out

    def drop(self, *names: str) -> None:
        """Deletes tables that no later job reads."""
        for name in names:
            files, path = self._path(name)
            files.delete(path, True)
            self._names.discard(name)

    def drop_others(self, *kept: str) -> None:
        """Deletes all tables but these."""
        self.drop(*sorted(self._names - set(kept)))
