"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file: the normaliser (a space becomes the mark; a mark before a text that is not
empty, if the model says so; all else is copied), the pieces as arcs over their characters, and the byte
fallback (a character without a piece has an arc of its UTF-8 bytes). A piece's weight is its negated score.
In a model made by merging a score is the negated rank of the merge, and a sequence of pieces is the encoding
of its text just when each two neighbours are the encoding of theirs. So a state of the transducer is the
piece that led to it, and it has arcs for those pieces alone that may follow; in a unigram model every piece may.
Each part of a text is composed with that machine, place by place, and the path of least total weight
(tropical semiring: weights add along a path, the least of several is taken) is the encoding.

Paths part between two characters that are neighbours in no piece, as before marks; each distinct part of a
text (most are words) is composed once and remembered.

A model with another normaliser (a table of rewriting rules, white space taken away or left unmarked),
with user-defined pieces, or of another kind raises ValueError: it would be encoded wrongly.

Defined cases: null and empty texts have no pieces; a null doc_id stays null; a mark in a text decodes as a
space, as in the library; repeated rows are each encoded; an empty table gives an empty result; further
columns are left alone, whatever their names. Memory is a few times the size of a step of texts (about STEP_BYTES); a longer text is a step of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import STEP_BYTES, Memory, Texts, coded, steps

MARK = "▁"
#: Parts of texts that a worker remembers, about; pairs of pieces: four times as many.
REMEMBERED = 400_000

#: Ranks above this are shared by pieces.
SHARED = 1e8
UNIGRAM, BPE = 1, 2

_machines: dict = {}


class Spec(NamedTuple):
    """What a model file says besides its pieces."""

    kind: int
    rules: bytes
    prefix: bool
    trims: bool
    marks: bool


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message in the protocol-buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


def spec_of(path: str) -> Spec:
    """Read from the trainer's (2) and the normaliser's (3) part of a model file; unset fields have the format's defaults."""
    with open(path, "rb") as f:
        parts = [(n, v) for n, v in _fields(f.read()) if n in (2, 3)]
    trainer = dict(x for n, v in parts if n == 2 for x in _fields(v))
    normaliser = dict(x for n, v in parts if n == 3 for x in _fields(v))
    return Spec(trainer.get(3, UNIGRAM), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))


class Transducer:
    """Compiled from a model file: normaliser, weighted pieces, byte fallback, and which pieces may follow each other."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.spec = spec = spec_of(path)
        if spec.kind not in (UNIGRAM, BPE) or spec.rules or spec.trims or not spec.marks:
            raise ValueError("the model's kind or normaliser is not supported")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(model.id_to_piece(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
        self.bytes = {int(p[3:5], 16): i for p, i in kinds if model.is_byte(i)}
        self.pieces = {p: i for p, i in kinds if not model.is_byte(i)}
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a model without byte fallback, or with a mark behind another character")
        self.weight = {p: -model.get_score(i) for p, i in self.pieces.items()}
        self.starts = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.longest = max(map(len, self.pieces))
        self.follows: dict[str, dict[str, bool]] = defaultdict(dict)
        self.pairs = 0
        self.edges: dict[tuple[str, int], list | None] = {}
        self.memory = Memory(lambda new: [self.ids_of(x.decode("utf-8", "replace").replace(" ", MARK)) for x in new], REMEMBERED)
        out = [b""] * model.get_piece_size()
        for p, i in self.pieces.items():
            out[i] = p.replace(MARK, " ").encode()
        for x, i in self.bytes.items():
            out[i] = bytes([x])
        # behind them the same pieces at the start of a text, where the first mark goes
        self.text_of = out + [x[1:] if x[:1] == b" " and spec.prefix else x for x in out]
        self.texts = pa.array(self.text_of, pa.large_binary())
        # bytes that are neighbours in some piece, or within a character
        self.joins = np.zeros((256, 256), bool)
        self.joins[:, 0x80:0xC0] = True
        for x in out:
            self.joins[list(x[:-1]), list(x[1:])] = True

    @classmethod
    def at(cls, path: str) -> Transducer:
        """One for each worker process."""
        if path not in _machines:
            _machines[path] = cls(path)
        return _machines[path]

    def merged(self, text: str) -> list[str]:
        """Characters joined, least weight first, then leftmost: what two neighbours are held against."""
        parts, weight = list(text), self.weight
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                w = weight.get(parts[i] + parts[i + 1])
                if w is not None and (best is None or w < best):
                    best, at = w, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose joining makes the piece; None if its characters do not end up as the piece."""
        parts, weight = list(piece), self.weight
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                w = weight.get(parts[i] + parts[i + 1])
                if w is not None and (best is None or w < best):
                    best, at = w, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def edge(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """What stood at the piece's left (0) or right (1) edge, latest first, and the rank of the joining that made it.

        None where ranks do not rise with time, as for runs of marks that share one score.
        """
        key = (piece, side)
        if key not in self.edges:
            out: list | None = []
            now, last = piece, float("inf")
            while len(now) > 1:
                parts, rank = self.halves(now), self.weight[now]
                if parts is None or rank >= last or rank > SHARED:
                    out = None
                    break
                out.append((now, rank))
                now, last = parts[side], rank
            if out is not None:
                out.append((now, -1.0))
            self.edges[key] = out
        return self.edges[key]

    def may_follow(self, first: str, second: str) -> bool:
        """Whether there is an arc for second from the state that first led to; first may be empty."""
        if self.pairs >= REMEMBERED * 4:
            self.follows.clear()
            self.pairs = 0
        self.pairs += 1
        found = self.follows[first][second] = self.spec.kind == UNIGRAM or self._apart(first, second)
        return found

    def _apart(self, first: str, second: str) -> bool:
        """Whether the characters of both, joined by rank, end up as the two."""
        if not first:
            return len(second) == 1 or self.merged(second) == [second]
        left, right = self.edge(first, 1), self.edge(second, 0)
        if left is None or right is None:
            return self.merged(first + second) == [first, second]
        # back in time: what meets at the border must not have joined before either side changed
        weight, i, j, limit = self.weight, 0, 0, float("inf")
        while True:
            (a, made_a), (b, made_b) = left[i], right[j]
            w = weight.get(a + b)
            if w is not None and w < limit:
                return False
            if made_a > made_b:
                limit, i = made_a, i + 1
            elif made_b < 0:
                return True
            else:  # of equal ranks the leftmost joins first
                limit, j = made_b + 1, j + 1

    def arcs(self, part: str, a: int) -> list[tuple[str, float]]:
        """Pieces that start at a, and their weights."""
        out, weights, starts = [], self.weight, self.starts
        for b in range(a + 1, min(len(part), a + self.longest) + 1):
            piece = part[a:b]
            weight = weights.get(piece)
            if weight is not None:
                out.append((piece, weight))
            elif piece not in starts:
                break
        return out

    def shortest(self, part: str) -> list[str]:
        """The pieces on the path of least weight over a part, all of whose characters have pieces.

        The composition's states are a place and the piece that led there; each keeps the least weight of the paths
        to it and the piece before. All arcs lead onwards, so one pass over the places relaxes every arc once.
        """
        n, follows, may_follow = len(part), self.follows, self.may_follow
        states: list[dict] = [{} for _ in range(n + 1)]
        states[0][""] = (0.0, "")
        for at, here in enumerate(states[:n]):
            arcs = self.arcs(part, at) if here else ()
            for last, (before, _) in here.items():
                known = follows[last]
                for piece, weight in arcs:
                    fits = known.get(piece)
                    if may_follow(last, piece) if fits is None else fits:
                        to = states[at + len(piece)]
                        if piece not in to or before + weight < to[piece][0]:
                            to[piece] = (before + weight, last)
        if not states[n]:
            raise ValueError("no path: the pieces are not those of a vocabulary made by merging")
        piece = min(states[n], key=lambda p: states[n][p][0])
        path, at = [], n
        while at:
            path.append(piece)
            at, piece = at - len(piece), states[at][piece][1]
        return path[::-1]

    def ids_of(self, part: str) -> bytes:
        """Ids of a part, 4 bytes each; byte fallback where a character has no piece."""
        pieces = self.pieces
        if all(c in pieces for c in part):
            return np.array([pieces[p] for p in self.shortest(part)], "<u4").tobytes()
        out: list[int] = []
        run = ""
        for c in [*part, ""]:
            if c and c in pieces:
                run += c
                continue
            if run:
                out += [pieces[p] for p in self.shortest(run)]
                run = ""
            out += [self.bytes[x] for x in c.encode("utf-8", "replace")]
        return np.array(out, "<u4").tobytes()

    def encoded(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, 4 bytes each, and where each text's begin (one more entry); a space stands for the mark."""
        data, starts = texts
        if self.spec.prefix:
            some = starts[:-1] < starts[1:]
            data = np.insert(data, starts[:-1][some], 32)
            starts = starts + np.concatenate([[0], np.cumsum(some)])
        first = np.ones(len(data) + 1, bool)
        first[1:-1] = ~self.joins[data[:-1], data[1:]]
        first[starts] = True
        edges = np.flatnonzero(first) if len(data) else np.zeros(1, np.int64)
        ids, at = coded(data, edges, self.memory)
        return ids, at[np.searchsorted(edges, starts)]

    def decoded(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Texts of lists of ids: pieces' characters joined, marks as spaces, the first one off; bytes that are no UTF-8 become replacement characters."""
        ids = ids.astype(np.int64)
        some = starts[:-1] < starts[1:]
        ids[starts[:-1][some]] += len(self.text_of) // 2
        found = self.texts.take(pa.array(ids))
        edges = np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1)[starts]
        out = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges)), found.buffers()[2]])
        try:
            return out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, n_pieces and ids (binary, 4 bytes each, little-endian) of each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_pieces", pa.int64()), ("ids", pa.binary())])

    def f(batches):
        machine = Transducer.at(model)
        for batch in batches:
            given = batch.column("text").cast(pa.large_string())
            marked = given.fill_null("")
            if pc.any(pc.match_substring(marked, MARK)).as_py():  # a mark counts as a space
                marked = pc.replace_substring(marked, MARK, " ")
            whole = pa.RecordBatch.from_arrays([batch.column("doc_id"), given, marked], names=["doc_id", "given", "text"])
            for b, texts in steps(iter([whole]), most=2 * STEP_BYTES):
                ids, at = machine.encoded(texts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("given").cast(pa.string()), pa.array(np.diff(at) // 4), _binary(ids, at)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, "doc_id long, text string, n_pieces long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (with ids) and the column decoded; null ids count as none."""
    schema = encoded.select("*", F.lit("").alias("decoded")).schema

    def f(batches):
        machine = Transducer.at(model)
        for b, (raw, starts) in steps(batches, "ids"):
            yield pa.RecordBatch.from_arrays([*b.columns, machine.decoded(np.ascontiguousarray(raw).view("<u4"), starts // 4)], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(f, schema)
