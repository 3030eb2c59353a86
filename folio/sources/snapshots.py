"""Published snapshots of documents: compressed JSON by part, of which only those that changed are written, and a numbered manifest that says what is current.

A snapshot is a manifest: for each part the folder that holds it and a digest of its documents. Publishing names the version
that it follows; the next version's file can be created once, so of two publishers from one version one is refused, and readers see
the old snapshot or the new one. Files of earlier versions stay as they are for those who read them.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import digest
from folio.sources.stored import stored


class Stale(Exception):
    """Something else was published since the expected version."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The version that is current, 0 before the first."""
    where, store = _at(spark, f"{path}/current")
    return max((int(s.getPath().getName()) for s in store.listStatus(where)), default=0) if store.exists(where) else 0


def _attempt(spark: SparkSession, path: str, number: int) -> str:
    """The folder that a version's publisher wrote to."""
    return spark.read.text(f"{path}/current/{number}").first()[0]


def manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    """part, written (the folder that holds it) and checksum of a snapshot."""
    schema = "part string, written string, checksum string"
    return spark.read.schema(schema).parquet(f"{path}/manifests/{_attempt(spark, path, number)}") if number else spark.createDataFrame([], schema)


def checksums(docs: DataFrame) -> DataFrame:
    """part and checksum: a digest of the part's documents in order of id."""
    return digest.listed(docs, ["part"], ["id", "body"], F.to_json(F.struct("id", "body")), name="checksum")


def publish(docs: DataFrame, path: str, expected: int) -> int:
    """Publishes docs (part, id and body as text; ids unique within a part) after version expected, which has to be current; returns the new version.

    Parts whose checksum is that of the snapshot before are not written; without a change nothing is published.
    """
    spark = docs.sparkSession
    if version(spark, path) != expected:
        raise Stale(f"version {expected} is not current")
    number = expected + 1
    attempt = f"{number}-{uuid.uuid4().hex}"  # a folder of its own: what a refused publisher has written is read by none
    before, now = manifest(spark, path, expected), stored(checksums(docs), "checksums")
    known = before.select("part", "written", F.col("checksum").alias("_before"))
    same = F.col("_before") == F.col("checksum")
    rows = stored(now.join(known, "part", "left").select("part", F.when(same, F.col("written")).otherwise(attempt).alias("written"), "checksum"), "manifest")
    changed = rows.filter(F.col("written") == attempt)
    if not changed.head(1) and rows.count() == before.count():
        return expected
    own = docs.select("part", "id", "body").join(changed.select("part"), "part", "left_semi")
    own.repartitionByRange("part", "id").write.partitionBy("part").option("compression", "gzip").json(f"{path}/data/{attempt}")
    rows.write.parquet(f"{path}/manifests/{attempt}")
    _create(spark, path, number, attempt)
    return number


def _create(spark: SparkSession, path: str, number: int, attempt: str) -> None:
    """Makes version number current, unless there is one already."""
    where, store = _at(spark, f"{path}/current/{number}")
    try:
        out = store.create(where, False)
    except Py4JJavaError as taken:
        if "exist" in str(taken.java_exception).lower():
            raise Stale(f"version {number} was published meanwhile") from taken
        raise
    out.write(bytearray(attempt.encode()))
    out.close()


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """part, id and body of a snapshot, the current one unless a number is given; only the folders that it names are read."""
    number = version(spark, path) if number is None else number
    rows = manifest(spark, path, number)
    folders = [r.written for r in rows.select("written").distinct().collect()]  # one for each version at most
    schema = "part string, id string, body string"
    out = spark.createDataFrame([], schema)
    for folder in sorted(folders):
        parts = rows.filter(F.col("written") == folder).select("part")
        data = spark.read.schema("id string, body string, part string").option("basePath", f"{path}/data/{folder}").json(f"{path}/data/{folder}")
        out = out.unionByName(data.join(parts, "part", "left_semi").select("part", "id", "body"))
    return out
