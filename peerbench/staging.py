"""Writing intermediate tables to the shared folder, so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Lets the shuffle files of a query go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folder: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a cluster session
    without it is an error, because a machine-local folder would not outlive an executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_folder
    _local_folder = _local_folder or tempfile.TemporaryDirectory(prefix="peerbench-", ignore_cleanup_errors=True)
    return _local_folder.name


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back.

    Unlike ``persist`` the copy survives lost executors, is columnar (later readers prune and
    push down), and its true size is known to the optimizer when it picks join strategies.
    """
    return _written(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def stage_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """``stage`` of the union of ``parts``, which are written one after the other, so that the shuffle files of only one
    of them are on disk at a time."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schemas = [_written(part, f"{path}/{i}").schema for i, part in enumerate(parts)]
    return spark.read.schema(schemas[0]).parquet(*[f"{path}/{i}" for i in range(len(schemas))])


def _written(df: DataFrame, path: str) -> DataFrame:
    """The shuffle files behind the table go once it is written: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        # for such tables the first level is as small as the usual third, and faster
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for the tables of one iteration, which lets those go that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(f"{self.folder}/{len(self.paths)}-{name}")
        return _written(df, self.paths[-1])

    def keep_last(self, n: int) -> None:
        """Delete all but the last ``n`` tables; the caller reads no older one."""
        old, self.paths[:-n] = self.paths[:-n], [""] * len(self.paths[:-n])
        for path in filter(None, old):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
