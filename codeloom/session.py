"""Session helper and the place for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "codeloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on: UTC, adaptive execution and Arrow transfer."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ship(b.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once per application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        fd, path = tempfile.mkstemp(prefix="codeloom-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        spark.sparkContext.addPyFile(path)
        atexit.register(lambda: os.path.exists(path) and os.remove(path))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where none is set and all runs on this machine, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Written intermediate tables of one operator call.

    ``put`` writes a DataFrame as Parquet into the shared folder and reads it back. That cuts the lineage, survives the
    loss of executors, and gives later stages exact sizes. Tables that only a later table needed are dropped with
    ``drop``; those that the result reads stay until the session ends. With ``tidy`` the shuffle files of a table are
    removed once it is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark).rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _at_end(spark, self.root)

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        before = self.spark.conf.get(_CLEANUP) if self.tidy else None
        try:
            if self.tidy:
                self.spark.conf.set(_CLEANUP, "true")
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._codeloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if p := getattr(t, "_codeloom_path", None):
                _delete(self.spark, p)

    def drop_part(self, table: DataFrame, part: str) -> None:
        if p := getattr(table, "_codeloom_path", None):
            _delete(self.spark, f"{p}/{part}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_end(spark: SparkSession, path: str) -> None:
    """The file system removes the folder when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
