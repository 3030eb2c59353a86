"""Sharding by extendible hashing, in DataFrame operations only.

Each row has a string of hash bits: of its key, and, once these are used up, of its text. A directory
indexed by the first bits leads to shards; a shard over the byte limit is split on its next bit, all
others stay. Bits are looked at in rounds of STEP: a round sums the bytes of the rows in oversized
cells by their next STEP bits (at most 2**STEP cells for each, partially summed before the shuffle)
and finds the shortest prefixes that fit. So a round adds directory entries for oversized buckets
alone, and rounds grow with the logarithm of the data. A key that holds any share of the rows splits
on bits of the document.

Defined cases: a null text has 0 bytes; a null key or doc_id hashes as an empty string; a row over
the limit is a shard of its own; rows that agree in all bits (repeated rows) fill numbered pages of one
bucket; an empty table gives an empty result; further columns are left alone, whatever their names; a text of any
length is only measured and hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import met, numbered, written

STEP = 12
ID_BITS = 60
TEXT_BITS = 60
LIMIT = 8 << 20
#: Rows of a salted part that are numbered in one task, about, where all of a bucket's rows are alike.
SALT_ROWS = 1_000_000


def hash_bits(c: Column) -> Column:
    """60 bits of MD5 as a string of 0 and 1; a null counts as an empty string."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 2), 60, "0")


def assign_shards(docs: DataFrame, *, limit: int = LIMIT, id_bits: int = ID_BITS, text_bits: int = TEXT_BITS, step: int = STEP, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, shard (its hash prefix; root is an empty string), page, depth, n_bytes and the shard's bytes and rows; behind them the carried columns of docs."""
    bits = F.substring(hash_bits(F.col("doc_id")), 1, id_bits)
    rows = docs.select("doc_id", "text", *carried).select("doc_id", *carried, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), bits.alias("bits"), F.substring(hash_bits(F.col("text")), 1, text_bits).alias("more"))
    rows = written(rows.select("doc_id", *carried, "n_bytes", F.concat("bits", "more").alias("bits")), "shard-rows")
    total, depth, open_rows, leaves = id_bits + text_bits, 0, rows, []
    while True:
        upto = min(depth + step, total)
        cells = open_rows.groupBy(F.substring("bits", 1, upto).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        at = F.explode(F.sequence(F.lit(depth), F.lit(upto))).alias("depth")
        sums = cells.select("cell", "b", "n", at).groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fit = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == total)
        ranked = sums.filter(fit).select("depth", "shard", "shard_bytes", "shard_rows")
        # the directory of this round: each cell leads to its shortest prefix that fits, or to none yet
        ways = cells.select("cell", at, F.lit(1).alias("_")).withColumn("shard", F.expr("substring(cell, 1, depth)"))
        found = ways.join(ranked, ["depth", "shard"], "left").groupBy("cell").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "shard", "shard_bytes", "shard_rows"))).alias("leaf"))
        directory = written(found.join(cells.select("cell", F.col("n").alias("m")), "cell"), "shard-directory")
        # a cell may hold any share of the rows, such as those of one key or of none
        here = met(open_rows.withColumn("cell", F.substring("bits", 1, upto)), directory, ["cell"], open_rows.count())
        here = written(here.drop("cell", "m"), "shard-round")
        leaves.append(here.filter("leaf is not null").select("doc_id", *carried, "n_bytes", "bits", "leaf.*"))
        if upto == total or not directory.filter("leaf is null").head(1):
            break
        open_rows = here.filter("leaf is null").select("doc_id", *carried, "n_bytes", "bits")
        depth = upto
    placed = leaves[0]
    for more in leaves[1:]:
        placed = placed.unionByName(more)
    paged = F.col("depth") == total
    if upto == total and directory.filter((F.col("leaf.depth") == total) & (F.col("leaf.shard_bytes") > limit) & (F.col("leaf.shard_rows") > 1)).head(1):
        over = paged & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
        placed = placed.filter(~over).withColumn("page", F.lit(0).cast("long")).unionByName(_pages(placed.filter(over), limit, carried))
    else:
        placed = placed.withColumn("page", F.lit(0).cast("long"))
    return placed.select("doc_id", "shard", "page", F.col("depth").cast("int").alias("depth"), "n_bytes", "shard_bytes", "shard_rows", *carried)


def _pages(rows: DataFrame, limit: int, carried: tuple[str, ...]) -> DataFrame:
    """Rows alike in all bits, dealt over pages that fit the limit; rows of one size, so a count decides.

    Ordinals come in two steps, within salted parts and then by the parts' counts, so no task holds a whole bucket.
    """
    # written first, so that the numbers stay what they are
    rows = written(rows.withColumn("salt", F.monotonically_increasing_id()), "shard-overflow")
    salts = max(256, rows.count() // SALT_ROWS)
    rows = rows.withColumn("salt", F.pmod("salt", F.lit(salts)))
    keys = ["shard", "n_bytes"]
    parts = rows.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("doc_id", *carried))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    out = rows.withColumn("inside", inside).join(parts, [*keys, "salt"])
    page = F.floor((F.col("before") + F.col("inside") - 1) / per_page)
    # sizes differ only where texts with equal bits differ; each size has pages of its own
    out = out.withColumn("page", F.col("n_bytes") * F.lit(1 << 32) + page)
    whole = out.groupBy("shard", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return out.drop("shard_bytes", "shard_rows").join(whole, ["shard", "page"]).select("doc_id", *carried, "n_bytes", "bits", "depth", "shard", "shard_bytes", "shard_rows", "page")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes docs under path, a folder for each shard and page; the folder's name has the prefix behind a letter.

    Each row is written once, whatever its doc_id: rows get numbers, written first so that they stay what they are.
    """
    rows, name = numbered(docs)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-docs")
    keyed = rows.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text"), "row")
    places = assign_shards(keyed, **options, carried=("row",)).select("row", F.concat(F.lit("s"), "shard", F.lit("_"), "page").alias("folder"))
    folder = "_shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    placed = rows.join(places, "row").drop("row").withColumnRenamed("folder", folder).repartition(folder)
    placed.withColumnsRenamed({c: n for n, c in name.items()}).write.partitionBy(folder).parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL for the same rows; for documents with ids of their own."""
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), levels AS (
  SELECT doc_id, n_bytes, d::INT AS depth, h >> (60 - d) AS p FROM rows, range(0, 31) t(d)
), sized AS (
  SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM levels GROUP BY depth, p
), fit AS (
  SELECT l.doc_id, l.n_bytes, l.depth, l.p, s.shard_bytes, s.shard_rows,
         row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS rn
  FROM levels l JOIN sized s USING (depth, p) WHERE s.shard_bytes <= {limit} OR s.shard_rows = 1
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(p), 60, '0'), depth) END AS shard, 0::BIGINT AS page, depth,
       n_bytes, shard_bytes, shard_rows
FROM fit WHERE rn = 1"""
