"""Writing an intermediate result once, where several branches of a plan read it."""

import contextlib
import os
import re
import uuid

FILE_ROWS = 5_000_000

#: Spark's own removal of shuffle files at the end of a query; without it they stay until the
#: driver's garbage happens to be collected.
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Files of several folders that a task may write side by side; without it Spark sorts by folder.
SIDE_BY_SIDE = "spark.sql.maxConcurrentOutputFileWriters"

_folders = []


def staging_folder(spark):
    """The folder for written tables that the session states.

    `spark.checkpoint.dir`, or where that is unset the place of Spark's own tables,
    `spark.sql.warehouse.dir`. On a cluster both are shared by all executors; Spark's own
    default for the latter, a folder beside the driver, is taken in local mode only.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir", None)
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        if not local and (not shared or shared.removeprefix("file:") == f"{os.getcwd()}/spark-warehouse"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return shared.rstrip("/")


def staging_path(spark, label):
    """A new path in the staging folder."""
    folder = _folders[-1] if _folders else staging_folder(spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def temporary_tables(spark):
    """Tables written inside are deleted at the end; by then results must be written elsewhere.

    Contexts may be nested; each deletes its own folder only.
    """
    folder = staging_path(spark, "temporary")
    _folders.append(folder)
    try:
        yield folder
    finally:
        _folders.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def files_version(spark, paths):
    """What tells one state of some folders of Parquet files from another: names, times and sizes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(paths))
    return frozenset(map(tuple, files.select("path", "modificationTime", "length").collect()))


@contextlib.contextmanager
def _settings(spark, values):
    """Session settings that hold inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def staged(df, label, by=(), path=None, folders=0):
    """`df` written to the staging folder as parquet, and the table read back.

    Lineage ends at the written table, so a lost executor re-reads files instead
    of re-running joins, and each reader takes only the columns it needs. Files of
    bounded size keep later scans spread; `by` names columns that split the table
    into folders, of which a task fills up to `folders` without a sort; `path` is one
    of `staging_path`, by default a new one. The shuffle files of the write go as it ends.
    """
    spark = df.sparkSession
    path = path or staging_path(spark, label)
    with _settings(spark, {SHUFFLES_REMOVED: "true"} | ({SIDE_BY_SIDE: str(folders)} if folders else {})):
        df.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_alone(spark, label, build):
    """What `build()` returns, staged; the tables staged on the way to it are deleted."""
    path = staging_path(spark, label)
    with temporary_tables(spark):
        return staged(build(), label, path=path)
