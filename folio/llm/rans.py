"""A static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

All blocks share one frequency table (sum 2**SCALE). Token i of a block belongs to lane i mod lanes;
each lane has a 64-bit state that gives out 32-bit words, and a step codes one token of every lane.
A block notes the lanes' states and the place among the words every so many steps, so parts of a
block can be decoded at the same time, and ends in checksums.

A block's bytes: HEADER (magic, version, scale, lanes, tokens, steps between checkpoints, checkpoints,
words, length of the index, CRC-32 of the table, CRC-32 of all that follows), the index (zlib: ordinal
and tokens of each document's piece), the word offsets (u4) and states (u8) of the checkpoints, the words (u4).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LANES = 1024
CHECKPOINT = 128
MAGIC = b"FRNS"
HEADER = struct.Struct("<4sHHIIIIIIII")
SECTION = struct.Struct("<IIII")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Frequencies that sum to 2**scale; a symbol that occurs has 1 at least."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE) -> None:
        self.freq, self.scale = freq.astype(np.uint32), scale
        self.cum = np.zeros(len(freq), np.uint64)
        self.cum[1:] = np.cumsum(freq.astype(np.uint64))[:-1]
        self.wide = freq.astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._symbols = None

    @classmethod
    def of_counts(cls, counts: np.ndarray, scale: int = SCALE) -> Table:
        """Counts over the whole corpus, scaled; what rounding leaves over or takes goes to the most frequent symbols."""
        counts = counts.astype(np.float64)
        if not counts.sum():
            counts = np.ones_like(counts)
        present = counts > 0
        freq = np.zeros(len(counts), np.int64)
        freq[present] = np.maximum(1, np.floor(counts[present] / counts.sum() * (1 << scale))).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        left = (1 << scale) - int(freq.sum())
        while left:
            if left > 0:
                freq[order[0]] += left
                break
            for s in order:  # take from the largest, each keeps half at least
                take = min(-left, int(freq[s]) // 2)
                freq[s] -= take
                left += take
                if not left:
                    break
        return cls(freq, scale)

    @property
    def symbols(self) -> np.ndarray:
        """Symbol of each slot."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        return self._symbols

    def packed(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def unpacked(cls, raw: bytes, scale: int, crc: int) -> Table:
        """A table that was written; its checksum is held against it."""
        out = cls(np.frombuffer(zlib.decompress(raw), "<u4"), scale)
        if out.crc != crc:
            raise ValueError("the frequency table's checksum does not match")
        return out

    def __getstate__(self):
        return self.freq, self.scale

    def __setstate__(self, state) -> None:
        self.__init__(*state)


def encode(ids: np.ndarray, index: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """One block of the ids; index: pairs (ordinal of the document in its file, its tokens in this block)."""
    n = len(ids)
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    freq, cum = table.wide[ids], table.cum[ids]
    scale = np.uint64(table.scale)
    room = np.uint64(31 - table.scale + 32)
    out, marks = [], []
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * lanes : (t + 1) * lanes], cum[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << room)
        out.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        q, r = np.divmod(x, f)
        state[: len(f)] = (q << scale) + r + c
        if t % every == 0:
            marks.append((t, state.copy()))
    out.reverse()
    marks.reverse()
    sizes = np.concatenate([[0], np.cumsum([len(w) for w in out])]).astype(np.uint32)
    words = np.concatenate(out) if out else np.zeros(0, np.uint32)
    packed = zlib.compress(np.ascontiguousarray(index, "<i8").tobytes(), 1)
    body = packed + np.array([sizes[t] for t, _ in marks], "<u4").tobytes() + b"".join(s.astype("<u8").tobytes() for _, s in marks) + words.astype("<u4").tobytes()
    return HEADER.pack(MAGIC, 1, table.scale, lanes, n, every, len(marks), len(words), len(packed), table.crc, zlib.crc32(body)) + body


class Block:
    """A block opened for reading; its checksums are held against the table and the bytes."""

    def __init__(self, raw: bytes, table: Table) -> None:
        magic, version, scale, self.lanes, self.n, self.every, marks, words, packed, table_crc, crc = HEADER.unpack_from(raw)
        body = memoryview(raw)[HEADER.size :]
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of this format")
        if table_crc != table.crc or scale != table.scale:
            raise ValueError("the block was made with another frequency table")
        if zlib.crc32(body) != crc:
            raise ValueError("a block's checksum does not match")
        self.table = table
        self.index = np.frombuffer(zlib.decompress(body[:packed]), "<i8").reshape(-1, 2)
        at = packed + 4 * marks
        self.offsets = np.frombuffer(body[packed:at], "<u4")
        self.states = np.frombuffer(body[at : at + 8 * self.lanes * marks], "<u8").reshape(marks, self.lanes)
        at += 8 * self.lanes * marks
        self.words = np.frombuffer(body[at : at + 4 * words], "<u4")

    def _bounds(self, mark: int) -> tuple[int, int]:
        """How many tokens a part has, and where its words end."""
        n = min(self.n - mark * self.every * self.lanes, self.every * self.lanes)
        return n, int(self.offsets[mark + 1]) if mark + 1 < len(self.offsets) else len(self.words)

    def part(self, mark: int) -> np.ndarray:
        """The ids from one checkpoint to the next; needs nothing of the other parts."""
        n, end = self._bounds(mark)
        return _decoded(self.states[mark], self.words[int(self.offsets[mark]) : end], n, self.table)

    def section(self, mark: int) -> bytes:
        """A part by itself, with a checksum of its own, to be decoded elsewhere by decode_section."""
        n, end = self._bounds(mark)
        body = self.states[mark].astype("<u8").tobytes() + self.words[int(self.offsets[mark]) : end].tobytes()
        return SECTION.pack(self.lanes, n, self.table.crc, zlib.crc32(body)) + body

    def ids(self) -> np.ndarray:
        return np.concatenate([self.part(i) for i in range(len(self.offsets))]) if self.n else np.zeros(0, np.uint32)


def _decoded(states: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    out, lanes = np.empty(n, np.uint32), len(states)
    state, at = states.astype(np.uint64), 0
    symbols, freq, cum = table.symbols, table.wide, table.cum
    scale, mask = np.uint64(table.scale), np.uint64((1 << table.scale) - 1)
    for a in range(0, n, lanes):
        x = state[: min(lanes, n - a)]
        slot = x & mask
        s = symbols[slot]
        out[a : a + len(x)] = s
        x = freq[s] * (x >> scale) + slot - cum[s]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _WORD) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    return out


def decode_section(raw: bytes, table: Table) -> np.ndarray:
    """The ids of a block's part; its checksum and the table's are held against the bytes."""
    lanes, n, table_crc, crc = SECTION.unpack_from(raw)
    body = memoryview(raw)[SECTION.size :]
    if table_crc != table.crc:
        raise ValueError("the part was made with another frequency table")
    if zlib.crc32(body) != crc:
        raise ValueError("a part's checksum does not match")
    return _decoded(np.frombuffer(body[: 8 * lanes], "<u8"), np.frombuffer(body[8 * lanes :], "<u4"), n, table)


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings joined, from those of each and the second's length."""

    def times(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    if not length:
        return first
    power = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit appended
    for _ in range(3):  # one zero byte
        power = [times(power, row) for row in power]
    while length:
        if length & 1:
            first = times(power, first)
        length >>= 1
        if length:
            power = [times(power, row) for row in power]
    return first ^ second
