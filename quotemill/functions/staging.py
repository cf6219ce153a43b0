"""Written intermediates.

A small aggregate that feeds several branches is written once and read back: the branches then plan
over a short, exactly sized scan, and a lost executor costs a re-read instead of a recompute. The
folder is the one the session names in ``spark.checkpoint.dir``. Where none is named, a private folder
is made only if driver and executors are one process (``local[...]``); on a cluster that is an error,
as each executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get(_SETTING, None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share (master {master})")
        named = tempfile.mkdtemp(prefix="quotemill-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage", **options: object) -> DataFrame:
    """Write ``df`` once, with the writer's ``options``, and continue from the written table."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``staged`` table that is no longer read."""
    spark = df.sparkSession
    root = shared_folder(spark).removeprefix("file:")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if root.lstrip("/") in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
