"""Work folders that driver and executors share, tables written to them, and atomic publishing of a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder of this machine, in local mode alone: elsewhere executors would not see it, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def new_folder(spark: SparkSession, kind: str = "work") -> str:
    """A path of a new folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tidelog-{kind}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written to a new work folder and read again, so that what depends on how rows lie, such as row numbers of partitions, stays."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions published in a folder, ascending; none where there is no such folder."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def publish(spark: SparkSession, path: str, write, number: int | None = None, keep: int = 2) -> int:
    """Publish a version: write(folder) fills a folder beside the versions, which is then renamed in one step; the number published, by default the next one.

    A reader sees the version before until the rename, and a crash at any point leaves it whole. Of the versions the last `keep` stay. A number that is already there is replaced,
    which a batch that runs again after a failure does with equal content.
    """
    there = versions(spark, path)
    number = number if number is not None else (there[-1] + 1 if there else 0)
    temporary = f"{path}/_new-{uuid.uuid4().hex}"
    write(temporary)
    fs, old = file_system(spark, f"{path}/v{number}")
    if fs.exists(old):
        fs.delete(old, True)
    if not fs.rename(file_system(spark, temporary)[1], old):
        raise OSError(f"{temporary} can't be renamed to v{number}")
    for n in [n for n in there if n != number][: max(0, len([n for n in there if n != number]) + 1 - keep)]:
        fs.delete(file_system(spark, f"{path}/v{n}")[1], True)
    return number
