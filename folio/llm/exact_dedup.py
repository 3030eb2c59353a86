"""Exact deduplication by Grace hashing.

Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]. Each task first
removes what is equal within its own input, so a group that holds a third of all rows leaves one
row per input partition; Spark then deals the rest out by digest (the first level of partitions),
and each task removes what is equal among them. A task holds texts in an open-addressing table that
compares complete contents; texts that do not fit its bound go to spill files by other bits of the
digest, and each file is treated in the same way, as deep as needed. Spill files are anonymous files
of one task attempt: a lost executor's tasks start anew from the shuffle.

Decisions go back to the rows by a join on the digest. Groups of HOT_ROWS rows, and of a ten-thousandth of all
rows, and more are few (ten thousand at most), so they are broadcast and their rows take no part in the shuffle.

Defined cases: null and empty text are equal; a null doc_id counts as larger than any other; rows
that repeat both doc_id and text count in group_size and share the decision (kept_documents keeps
one of them); an empty table gives an empty result; further columns are left alone, whatever their names; a text
larger than the table's bound is held by itself.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folio.llm.shared import numbered, partitions, renamed, written

WHITE = b" \t\n\v\f\r"
TABLE_BYTES = 64 << 20
FAN_OUT = 16
#: Rows of a group from which on its rows are told by a broadcast.
HOT_ROWS = 10_000
_LAST = (1 << 63) - 1


def _sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


class ContentTable:
    """Open addressing with linear probing; a slot leads to an entry [digest, content, -length, doc, best rows, rows]."""

    def __init__(self, clashes: set[bytes]) -> None:
        self.mask, self.entries, self.bytes, self.clashes = (1 << 10) - 1, [], 0, clashes
        self.slots = [-1] * (self.mask + 1)

    def place(self, digest: bytes, content: bytes) -> tuple[int, list | None]:
        """The slot where the content is or would go, and its entry."""
        slots, entries, mask = self.slots, self.entries, self.mask
        at = int.from_bytes(digest[:8], "little") & mask
        while (i := slots[at]) >= 0:
            entry = entries[i]
            if entry[0] == digest:
                if entry[1] == content:
                    return at, entry
                self.clashes.add(digest)
            at = (at + 1) & mask
        return at, None

    def add(self, at: int, entry: list) -> None:
        self.slots[at] = len(self.entries)
        self.entries.append(entry)
        self.bytes += len(entry[1]) + 300
        if len(self.entries) * 3 > self.mask * 2:
            self.mask = self.mask * 4 + 3
            self.slots = [-1] * (self.mask + 1)
            for i, x in enumerate(self.entries):
                at = int.from_bytes(x[0][:8], "little") & self.mask
                while self.slots[at] >= 0:
                    at = (at + 1) & self.mask
                self.slots[at] = i


def merge(entry: list, length: int, doc: int, best: int, rows: int) -> None:
    """Adds rows of equal content to an entry; the longest original, then the smallest doc stays."""
    entry[5] += rows
    if (length, doc) == (entry[2], entry[3]):
        entry[4] += best
    elif (length, doc) < (entry[2], entry[3]):
        entry[2:5] = [length, doc, best]


def grace(records: Iterator[list], limit: int = TABLE_BYTES, level: int = 0, clashes: set[bytes] | None = None) -> Iterator[list]:
    """One entry for each content of the records [digest, content, -length, doc, best rows, rows], in about limit bytes.

    clashes gets each digest that two contents share, before the second of them is given out.
    """
    clashes = set() if clashes is None else clashes
    table, files = ContentTable(clashes), {}
    for record in records:
        at, entry = table.place(record[0], record[1])
        if entry is not None:
            merge(entry, *record[2:])
        elif not table.entries or table.bytes + len(record[1]) <= limit:
            table.add(at, record)
        else:
            part = hashlib.blake2b(record[0], digest_size=1, salt=level.to_bytes(8, "little")).digest()[0] % FAN_OUT
            if part not in files:
                files[part] = tempfile.TemporaryFile()
            pickle.dump(record, files[part], protocol=5)
    yield from table.entries
    del table
    for file in files.values():
        file.seek(0)
        yield from grace(_spilled(file), limit, level + 1, clashes)
        file.close()


def _spilled(file) -> Iterator[list]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


_REP = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("neg_length", pa.int64()), ("doc", pa.int64()), ("best_rows", pa.int64()), ("rows", pa.int64())])
_GROUP = "digest binary, variant int, content binary, neg_length long, doc long, best_rows long, rows long"


def _batches(rows: Iterator[list], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[1] or b"")
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _texts(batch: pa.RecordBatch, text: str = "text") -> Iterator[str]:
    for x in batch.column(text):
        yield x.as_py() or ""


def groups_of(docs: DataFrame, *, digest: Callable[[bytes], bytes] = _sha256, limit: int = TABLE_BYTES) -> DataFrame:
    """One row for each content: digest, the row that stays (doc, null if it has no id), rows; written to the shared folder.

    variant numbers contents that share a digest; from the second on, content holds what tells them apart.
    """

    def local(batches):
        def records():
            for b in batches:
                for doc, text in zip(b.column("doc_id").to_pylist(), _texts(b)):
                    content = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
                    yield [digest(content), content, -len(text), _LAST if doc is None else doc, 1, 1]

        return _batches(grace(records(), limit), _REP)

    out = pa.schema([("digest", pa.binary()), ("variant", pa.int32()), *list(_REP)[1:]])

    def across(batches):
        def records():
            for b in batches:
                for i in range(b.num_rows):
                    yield [c[i].as_py() for c in b.columns]

        clashes: set[bytes] = set()
        seen: dict[bytes, int] = {}  # of those digests alone that contents share
        held: list[list] = []
        for x in grace(records(), limit, clashes=clashes):
            n = 0
            if x[0] in clashes:
                n = seen[x[0]] = seen.get(x[0], -1) + 1
            held.append([x[0], n, x[1] if n else None, x[2], x[3], x[4], x[5]])
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)

    spark = docs.sparkSession
    reps = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(local, "digest binary, content binary, neg_length long, doc long, best_rows long, rows long")
    found = reps.repartition(partitions(spark), "digest").mapInArrow(across, _GROUP)
    return written(found.withColumn("doc", F.when(F.col("doc") != _LAST, F.col("doc"))), "exact-groups")


def _placed(rows: DataFrame, doc: Column, groups: DataFrame, hot_rows: int, drop: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """rows (with digest and content) and, of groups of more than one row, keep_id, group_size, best_rows (else null).

    drop(keep_id, best_rows) says which rows of the groups that are broadcast can go before the shuffle.
    """
    facts = [F.col("doc").alias("keep_id"), F.col("rows").alias("group_size"), "best_rows"]
    clash = groups.filter("variant > 0")
    some = bool(clash.head(1))
    all_rows = groups.agg(F.sum("rows")).first()[0] or 0
    many = groups.filter("rows > 1")
    plain = rows
    if some:  # two contents with one digest: the contents decide
        shared = clash.select("digest").distinct()
        plain, many = rows.join(shared, "digest", "left_anti"), many.join(shared, "digest", "left_anti")
    most = max(hot_rows, all_rows // 10_000)
    hot = many.filter(F.col("rows") >= most).select("digest", *facts).toDF("hot", "hot_keep", "hot_size", "hot_best")
    told = plain.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")  # ten thousand rows at most
    if drop is not None:
        told = told.filter(F.col("hot").isNull() | ~drop(F.col("hot_keep"), F.col("hot_best")))
    # rows that are told by now are spread, over keys that no digest equals
    told = told.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("told "), F.xxhash64(doc).cast("string")).cast("binary")))
    # one plan at every size: groups grow with the rows
    out = told.join(many.filter(F.col("rows") < most).select(F.col("digest").alias("key"), *facts).hint("merge"), "key", "left")
    one = [F.coalesce(f"hot_{h}", c).alias(c) for h, c in (("keep", "keep_id"), ("size", "group_size"), ("best", "best_rows"))]
    out = out.select(*plain.columns, *one)
    if not some:
        return out
    apart = rows.join(shared, "digest")
    others = clash.select(F.col("digest").alias("d"), F.col("content").alias("c"), *facts)
    first = groups.filter("variant = 0").join(shared, "digest").select("digest", *facts)
    second = apart.join(others, (F.col("digest") == F.col("d")) & (F.col("content") == F.col("c"))).drop("d", "c")
    none = apart.join(others.select("d", "c"), (F.col("digest") == F.col("d")) & (F.col("content") == F.col("c")), "left_anti")
    return out.unionByName(second.select(out.columns)).unionByName(none.join(first, "digest").select(out.columns))


def _tagged(docs: DataFrame, text: str, digest: Callable[[bytes], bytes], contents: bool) -> DataFrame:
    """docs with digest and, if asked for, content."""
    schema = StructType([*docs.schema.fields, StructField("digest", BinaryType()), StructField("content", BinaryType())])

    def f(batches):
        for b in batches:
            found = [x.encode("utf-8", "surrogatepass").translate(None, WHITE) for x in _texts(b, text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(digest, found), pa.binary()), pa.array(found if contents else [None] * len(found), pa.binary())], names=[*b.schema.names, "digest", "content"])

    return docs.mapInArrow(f, schema)


def exact_dedup(docs: DataFrame, *, digest: Callable[[bytes], bytes] = _sha256, limit: int = TABLE_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest for each row of docs (columns doc_id and text are used)."""
    groups = groups_of(docs, digest=digest, limit=limit)
    clash = bool(groups.filter("variant > 0").head(1))
    rows = _tagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", digest, clash).drop("text")
    found = _placed(rows, F.col("doc_id"), groups, hot_rows)
    alone = F.col("group_size").isNull()
    found = found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "digest")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def kept_documents(docs: DataFrame, *, digest: Callable[[bytes], bytes] = _sha256, limit: int = TABLE_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs that stay, all columns; of each group of equal texts one row, also where rows repeat."""
    groups = groups_of(docs, digest=digest, limit=limit)
    clash = bool(groups.filter("variant > 0").head(1))
    rows, name = numbered(docs)
    doc = F.col(name["doc_id"]).cast("long")

    def gone(keep_id: Column, best_rows: Column) -> Column:
        return best_rows.isNotNull() & ~doc.eqNullSafe(keep_id)

    stay = _placed(_tagged(rows, name["text"], digest, clash), doc, groups, hot_rows, gone).filter(~gone(F.col("keep_id"), F.col("best_rows")))
    if groups.filter("best_rows > 1").head(1):  # rows that repeat both doc_id and text
        tied = F.coalesce(F.col("best_rows") > 1, F.lit(False))
        stay = stay.filter(~tied).unionByName(stay.filter(tied).dropDuplicates(["digest", "content", name["doc_id"]]))
    return renamed(stay, docs)
