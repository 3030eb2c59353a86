"""A kept index of neighbouring character pairs with their places, for phrases of any language.

A generation of postings (gram, doc, places) lies in folders by the gram's first character, sorted, so a search
reads only the folders and row groups of its own grams, and no text. A text's last character is a gram by itself. Changed documents
come as a further generation; which generation of a document counts is in a small table beside it, written last, so a
generation that was not finished is not seen.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 64
_POSTINGS = "doc long, gram string, places array<int>"


#: Postings after which a batch is given on; those of one text stay together.
ROWS = 65_536


def _postings(batches, limit: int = ROWS):
    """The grams of each text with their places, in code points from 0. A task holds the postings of one text beyond limit at most, whatever the batches' size."""
    docs, grams, places, sizes, n = [], [], [], [], 0

    def batch() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(grams, pa.string()), lists], names=["doc", "gram", "places"])

    for b in batches:
        own_docs, own_texts = b.column("doc"), b.column("text")
        for at in range(b.num_rows):
            text = own_texts[at].as_py()
            if not text:
                continue
            points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
            keys = (points << 21) | np.append(points[1:] + 1, 0)  # 0: nothing follows
            order = np.argsort(keys, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            own = keys[order][edges]
            pairs = np.stack([own >> 21, np.maximum((own & 0x1FFFFF) - 1, 0)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
            told = [pairs[i : i + 2] for i in range(0, len(pairs), 2)]
            for i in np.flatnonzero((own & 0x1FFFFF) == 0):
                told[i] = told[i][0]
            docs.append(np.full(len(own), own_docs[at].as_py(), np.int64))
            grams += told
            places.append(order.astype(np.int32))
            sizes.append(np.diff(np.append(edges, len(order))))
            n += len(order)
            if n >= limit:  # places, of which each posting has one at least
                yield batch()
                docs, grams, places, sizes, n = [], [], [], [], 0
    if docs:
        yield batch()


def _folder(gram: Column) -> Column:
    return F.pmod(F.hash(F.left(gram, F.lit(1))), F.lit(FOLDERS))


def add(docs: DataFrame, path: str, *, doc: str, text: str, gone: DataFrame | None = None) -> None:
    """Adds a generation to the index at path, new or not: docs (rows of doc, unique, and text) as they are now; gone: ids (doc) that are no more."""
    spark = docs.sparkSession
    generation = _last(spark, path) + 1
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL")
    # a frequent gram is many rows of one folder: ranges split it
    found = rows.mapInArrow(_postings, _POSTINGS).withColumn("folder", _folder(F.col("gram")))
    found.repartitionByRange("folder", "gram", "doc").sortWithinPartitions("folder", "gram", "doc").write.partitionBy("folder").mode("overwrite").parquet(f"{path}/postings/generation={generation}")
    known = rows.select("doc", F.lit(True).alias("live"))
    if gone is not None:
        known = known.unionByName(gone.select(F.col("doc").cast("long").alias("doc"), F.lit(False).alias("live")))
    aside = f"{path}/aside-{uuid.uuid4().hex}"
    known.write.parquet(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop(f"{path}/documents"))
    if not store.rename(hadoop(aside), hadoop(f"{path}/documents/generation={generation}")):
        raise RuntimeError(f"generation {generation} could not be added")


def _last(spark: SparkSession, path: str) -> int:
    """The number of the last finished generation, -1 without any."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/documents")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return -1
    return max((int(s.getPath().getName().removeprefix("generation=")) for s in store.listStatus(where)), default=-1)


def generations(spark: SparkSession, path: str) -> int:
    """How many finished generations the index at path has."""
    return _last(spark, path) + 1


def search(spark: SparkSession, path: str, term: str) -> DataFrame:
    """doc and places (ascending, from 0) of each live document of the index that holds term, one character at least."""
    if not term:
        raise ValueError("a term has one character at least")
    last = _last(spark, path)
    if last < 0:
        return spark.createDataFrame([], "doc long, places array<int>")
    # every second pair and the last one cover the term; a single character is the beginning of its grams
    offsets = sorted({*range(0, len(term) - 1, 2), max(0, len(term) - 2)})
    grams: dict[str, list[int]] = {}
    for o in offsets:
        grams.setdefault(term[o : o + 2], []).append(o)
    postings = spark.read.schema(f"{_POSTINGS}, generation int, folder int").parquet(f"{path}/postings").filter(F.col("generation") <= last)
    firsts = sorted({g[0] for g in grams})
    folders = [r[0] for r in spark.createDataFrame([(c,) for c in firsts], "c string").select(_folder(F.col("c"))).distinct().collect()]
    wanted = F.col("gram").isin(*grams) if len(term) > 1 else F.startswith("gram", F.lit(term))
    hits = postings.filter(F.col("folder").isin(*folders) & wanted)
    where = F.lit(None).cast("array<int>")
    for gram, own in grams.items():
        where = F.when(F.col("gram") == gram, F.array(*map(F.lit, own))).otherwise(where)
    where = where if len(term) > 1 else F.array(F.lit(0))
    starts = hits.select("doc", "generation", "places", F.explode(where).alias("offset")).select("doc", "generation", F.transform("places", lambda p: p - F.col("offset")).alias("starts"))
    if len(term) == 1:
        both = starts.groupBy("doc", "generation").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("places"))
    else:
        met = starts.groupBy("doc", "generation").agg(F.collect_list("starts").alias("all")).filter(F.size("all") == len(offsets))
        # the places of one document
        common = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        both = met.select("doc", "generation", F.array_sort(common).alias("places")).filter(F.size("places") > 0)
    known = spark.read.schema("doc long, live boolean, generation int").parquet(f"{path}/documents").filter(F.col("generation") <= last)
    known = known.join(both.select("doc"), "doc", "left_semi").groupBy("doc").agg(F.max(F.struct("generation", "live")).alias("now"))
    live = known.filter("now.live").select("doc", F.col("now.generation").alias("generation"))
    return both.join(live, ["doc", "generation"]).select("doc", "places")
