"""Written intermediate tables in the folder that the session's ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset and the master is local, a folder of our own:
    executors on other machines could not read that."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master} it must name a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomlake-"))
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove_all(spark: SparkSession, pattern: str) -> None:
    """Removes what matches a pattern of the file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or ():
        remove(spark, f.getPath().toString())


def moved_file(spark: SparkSession, folder: str, to: str) -> bool:
    """Whether there is a folder with a data file, which then has the name ``to``; the folder goes."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(make(folder)):
        return False
    files = [f.getPath() for f in fs.listStatus(make(folder)) if f.getPath().getName().startswith("part-")]
    if len(files) != 1:
        raise ValueError(f"{folder} has {len(files)} files, not one")
    done = fs.rename(files[0], make(to))
    fs.delete(make(folder), True)
    return done


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The same rows, read back from a table of their own: the lineage ends there and its size is known."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and nothing reads any more; others stay."""
    for t in tables:
        if path := t.__dict__.pop("written_path", None):
            remove(t.sparkSession, path)
