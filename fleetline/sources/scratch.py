"""Tables that a job keeps for its own later steps, in the folder the cluster shares."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and Spark is local (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fleetline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def stamp_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the files at or below ``paths``: their places, lengths and times of change."""
    told = []
    for path in paths:
        fs, place = _file_system(spark, path)
        files = fs.listFiles(place, True)
        while files.hasNext():
            f = files.next()
            told.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:32]


def scratch_exists(df: DataFrame) -> bool:
    """Whether the files that a kept table was read from are still there."""
    files = df.inputFiles()
    if not files:
        return True
    fs, place = _file_system(df.sparkSession, files[0])
    return fs.exists(place)


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Remove tables of the shared folder that a finished job no longer needs; anything outside it is refused."""
    own = shared_dir(spark).split("://")[-1].removeprefix("file:")
    for path in paths:
        if not path.split("://")[-1].removeprefix("file:").startswith(f"{own}/"):
            raise ValueError(f"{path} isn't in the shared folder")
        fs, place = _file_system(spark, path)
        fs.delete(place, True)


def keep(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet, partitioned by ``by``, and read it back.

    Whatever reads it several times shares one computation and scans only the columns and
    partitions it needs; a lost executor costs its tasks.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
