"""Token-id output: documents as ids of a public tokenizer, in rANS blocks, in ascending doc_id order.

Three jobs: (1) tokenise each text once, keep its ids (zstd, 2 or 4 bytes each) in the shared folder
and count every id of the corpus; (2) deal the documents out by ranges of doc_id and write each range
as one file of blocks, coded with the one table of all counts; (3) read blocks back, any block on any
machine. A folder of token files stands alone: `table` holds the frequencies and their checksum, `blocks`
runs of rows (file, block, ...) with a binary block each (see rans). A block's parts, from checkpoint to
checkpoint, can be dealt out and decoded apart (token_ids with spread).
Documents may span blocks; a task holds a block and the ids of one document, and while it tokenises
a step of texts (about STEP_BYTES; a longer text is a step of its own) with some ten bytes for each byte of text.

Defined cases: a null or empty text has the end id alone; a null doc_id comes first; rows with the
same doc_id follow each other in the order of a hash of their ids; an empty table gives no blocks; further columns are left
alone, whatever their names.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.rans import Block, Table, crc32_combine, decode_section, encode
from folio.llm.shared import STEP_BYTES, Memory, Texts, coded, is_space, lowered, partitions, shared_dir, steps, written

END = 1
BLOCK_TOKENS = 1 << 18
#: Pieces that a worker remembers, about.
REMEMBERED = 400_000
#: Words of lower-case letters of Latin-1, in UTF-8: the tokenizer's normaliser leaves them as they are and its splitting takes them whole.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = True  # not |, which special tokens hold behind letters

_tokenizers: dict = {}


class Tokenizer:
    """Encodes with the tokenizers library; pieces between white space are encoded once and remembered.

    Fits tokenizers whose splitting never crosses white space and drops it, parts letters from marks behind them, ends each
    word's last token in </w> and takes no notice of case, as word_bpe_49k.json does. New plain words are encoded many at a time,
    in one text, and told apart by the tokens that end words.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.size = self.library.get_vocab_size()
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self.pieces = Memory(self._pieces, REMEMBERED)

    @classmethod
    def at(cls, path: str) -> Tokenizer:
        """One for each worker process."""
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def _each(self, texts: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]

    def _pieces(self, new: list[bytes]) -> list[bytes]:
        """Plain words, many in one text, and whatever else stands between white space or before marks."""
        plain = [i for i, x in enumerate(new) if _PLAIN(x)]
        out: list = [None] * len(new)
        for a in range(0, len(plain), 2000):
            some = plain[a : a + 2000]
            ids = np.array(self.library.encode_batch_fast([b" ".join([new[i] for i in some]).decode()], add_special_tokens=False)[0].ids, self.type)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some):
                raw, at, size = ids.tobytes(), 0, self.type.itemsize
                for i, end in zip(some, (last * size).tolist()):
                    out[i] = raw[at:end]
                    at = end
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._each([new[i] for i in rest])):
            out[i] = x
        return out

    def encoded(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text's begin (one more entry)."""
        data, starts = texts
        inside = ~is_space(data)
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = inside[1:] & ~inside[:-1]
        # marks behind a letter are split off by the tokenizer as well
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        edge[1:-1] |= letter[:-1] & _MARK[data[1:]]
        edge[starts] = True
        begin = np.flatnonzero(edge[:-1])  # of a piece, or of white space that starts a text
        held = np.concatenate([[0], np.cumsum(inside)])
        if not (data == 0x7C).any():  # without special tokens, which are told by their letters' case
            data = lowered(data)
        raw, at = coded(data[inside], np.append(held[begin], held[-1]), self.pieces)
        ids, size = raw.view(self.type), self.type.itemsize
        ends = at[np.searchsorted(begin, starts)] // size
        return np.insert(ids, ends[1:], END), ends + np.arange(len(ends))


_IDS = "doc_id long, n long, ids binary, counts boolean"
_BLOCK = "file int, block int, first_token long, n_tokens long, doc_ids array<long>, payload binary"


def tokenised(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, Table]:
    """The ids of each document (zstd) in a written table, and the table of all ids' frequencies."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.bool_())])

    def f(batches: Iterator[pa.RecordBatch]):
        t = Tokenizer.at(tokenizer)
        press, counts = zstandard.ZstdCompressor(1), np.zeros(t.size, np.int64)
        for batch, texts in steps(batches, most=2 * STEP_BYTES):
            ids, at = t.encoded(texts)
            counts += np.bincount(ids, minlength=t.size)
            raw = memoryview(ids.tobytes())
            packed = [press.compress(raw[x:y]) for x, y in zip((at * t.type.itemsize).tolist(), (at[1:] * t.type.itemsize).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(packed, pa.binary()), pa.array([False] * len(packed))], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([t.size], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary()), pa.array([True])], schema=schema)

    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, _IDS), "token-ids", "none")

    def counted(batches):
        for b in batches:
            for x in b.column("ids"):
                c = np.frombuffer(zlib.decompress(x.as_py()), np.int64)
                s = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(c[s])], names=["s", "c"])

    # as many rows as the vocabulary has entries at most
    total = rows.filter("counts").select("ids").mapInArrow(counted, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(Tokenizer.at(tokenizer).size, np.int64)
    counts[total["s"].to_numpy(np.int64)] = total["c"].to_numpy(np.int64)
    return rows.filter("not counts").drop("counts"), Table.of_counts(counts)


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, *, block_tokens: int = BLOCK_TOKENS, files: int | None = None) -> str:
    """Writes a folder of token files (a new one in the shared folder unless path names one) and returns its path.

    Blocks of all documents, in files of ascending doc_id ranges, and the frequency table they share.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/folio/token-files-{uuid.uuid4().hex}"
    rows, table = tokenised(docs, tokenizer)
    spark.createDataFrame([(table.scale, table.crc, table.packed())], "scale int, crc long, frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    kind = Tokenizer.at(tokenizer).type
    schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])

    def f(batches):
        file, open_press = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        held, index, names, size, block, place, ordinal = [], [], [], 0, 0, 0, 0

        def close():
            ids = np.concatenate(held).astype(np.uint32)
            row = [[file], [block], [place], [len(ids)], [names], [encode(ids, np.array(index, np.int64), table)]]
            return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(open_press.decompress(raw.as_py()), kind)
                while True:
                    piece, ids = ids[: block_tokens - size], ids[block_tokens - size :]
                    held.append(piece)
                    index.append((ordinal, len(piece)))
                    names.append(doc)
                    size += len(piece)
                    if size == block_tokens:
                        yield close()
                        place += size
                        held, index, names, size, block = [], [], [], 0, block + 1
                    if not len(ids):
                        break
                ordinal += 1
        if held:
            yield close()

    n = files or partitions(docs.sparkSession)
    tie = F.xxhash64("ids")
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    dealt.mapInArrow(f, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def opened_files(spark: SparkSession, path: str) -> tuple[DataFrame, Table]:
    """The blocks of a folder of token files and their frequency table."""
    row = spark.read.parquet(f"{path}/table").first()
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks"), Table.unpacked(row.frequencies, row.scale, row.crc)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files."""
    blocks, table = opened_files(spark, path)
    pieces = written(_pieces(blocks, table), "token-pieces")
    # one row for each file
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    whole = pieces.filter("whole")
    parts = pieces.filter("not whole").groupBy("file", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("p"))
    spanning = parts.mapInArrow(_joined, "file int, doc_id long, start long, n long, crc long")
    found = whole.select("file", "doc_id", "start", "n", "crc").unionByName(spanning)
    return found.join(files, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The CRC of each document's pieces p, of which there are as many as blocks that it spans."""
    for b in batches:
        out = []
        for parts in b.column("p").to_pylist():
            crc = 0
            for x in parts:
                crc = crc32_combine(crc, x["crc"], 4 * x["n"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("doc_id"), b.column("start"), b.column("n"), pa.array(out, pa.int64())], names=["file", "doc_id", "start", "n", "crc"])


def _pieces(blocks: DataFrame, table: Table) -> DataFrame:
    schema = pa.schema([("file", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_())])

    def f(batches):
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b.column("payload")[i].as_py(), table)
                ids = block.ids().astype("<u4")
                n = block.index[:, 1]
                start = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(ids[start[j] : start[j + 1]]) for j in range(len(n))]
                whole = np.zeros(len(n), bool)  # the first and the last piece may go on in other blocks
                whole[1:-1] = True
                docs = b.column("doc_ids")[i].values
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b.column("file")[i].as_py(), np.int32)), pa.array(block.index[:, 0]), docs, pa.array(start[:-1] + b.column("first_token")[i].as_py()), pa.array(n), pa.array(crc, pa.int64()), pa.array(whole)], schema=schema)

    # no repartition: blocks are read where they lie
    return blocks.select("file", "first_token", "doc_ids", "payload").mapInArrow(f, "file int, ordinal long, doc_id long, start long, n long, crc long, whole boolean")


def token_ids(spark: SparkSession, path: str, *, spread: int | None = None) -> DataFrame:
    """The general reader: doc_id, file, start (within its file) and ids of each document's pieces.

    A piece ends with its document or its block; with spread, blocks are cut at their checkpoints, the parts are
    dealt over that many tasks and decoded apart, and a piece ends with its part.
    """
    blocks, table = opened_files(spark, path)
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
    cut = pa.schema([("file", pa.int32()), ("start", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("part", pa.binary())])

    def row(file: int, start: int, docs: list, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        at = np.concatenate([[0], np.cumsum(sizes)])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.full(len(docs), file, np.int32)), pa.array(start + at[:-1]), lists], schema=schema)

    def whole(batches):
        for b in batches:
            for r in b.to_pylist():
                block = Block(r["payload"], table)
                yield row(r["file"], r["first_token"], r["doc_ids"], block.index[:, 1], block.ids())

    def parted(batches):
        for b in batches:
            for r in b.to_pylist():
                block = Block(r["payload"], table)
                ends = np.cumsum(block.index[:, 1])
                for mark in range(len(block.offsets)):
                    first = mark * block.every * block.lanes
                    last = min(block.n, first + block.every * block.lanes)
                    some = np.arange(np.searchsorted(ends, first, "right"), np.searchsorted(ends, last - 1, "right") + 1)
                    sizes = np.minimum(ends[some], last) - np.maximum(ends[some] - block.index[some, 1], first)
                    values = [[r["file"]], [r["first_token"] + first], [[r["doc_ids"][i] for i in some]], [sizes.tolist()], [block.section(mark)]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, cut)], schema=cut)

    def decoded(batches):
        for b in batches:
            for r in b.to_pylist():
                yield row(r["file"], r["start"], r["docs"], np.array(r["sizes"]), decode_section(r["part"], table))

    out = "doc_id long, file int, start long, ids array<int>"
    chosen = blocks.select("file", "first_token", "doc_ids", "payload")
    if spread is None:
        return chosen.mapInArrow(whole, out)
    return chosen.mapInArrow(parted, "file int, start long, docs array<long>, sizes array<long>, part binary").repartition(spread).mapInArrow(decoded, out)
