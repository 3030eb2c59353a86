"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, in local mode only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-folio-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again."""
    path = f"{shared_dir(df.sparkSession)}/folio/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tasks(spark: SparkSession, n: int) -> Iterator[None]:
    """Shuffles of what is written within are dealt over n partitions."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes with the name, size or time of any file below the paths."""
    conf = spark._jsc.hadoopConfiguration()
    seen = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(conf).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def kept(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What build gives for the files below the paths, stored under their fingerprint: built by the first that asks, read by all others.

    It is written beside its place and renamed, so nobody reads half of it; of two builders at once the first to finish stays.
    """
    where = f"{shared_dir(spark)}/folio/kept/{name}-{fingerprint(spark, paths)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        aside = f"{where}-{uuid.uuid4().hex}"
        build().write.parquet(aside)
        if store.exists(path) or not store.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), path):
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    return spark.read.parquet(where)
