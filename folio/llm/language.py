"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word (a run of letters, lower
case, with a word-start mark) has as probability the sum over all its segmentations into
pieces, worked out by a forward algorithm; a text has the product over its words. Characters without a
piece count as their UTF-8 bytes. Probabilities are learnt by expectation maximisation over the counted
words of a bounded sample of training rows (TRAIN_ROWS of each language, by a hash), from a start that is
the same for all languages; a task sends sums by language and piece, so what reaches the driver is bounded
by vocabulary times languages. Words of any length are learnt from, with sums of logarithms.

Defined cases: a null text or one without a letter is `und` with score 0; rows without lang are not
trained on; without any training rows every text is `und`; equal likelihoods go to the language that
comes first in order; repeated rows count as often as they occur in training; an empty table gives an
empty result; further columns are left alone, whatever their names; a null doc_id is scored like others; a text
longer than a step (STEP_BYTES) is a step of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import hashes_between, prefix_sums, steps, written

FOLDS = 5
#: Rows of each language that a model is fitted to, about, at most.
TRAIN_ROWS = 2_000
#: Languages that are scored at a time: more take several passes over a word.
LANGS_AT_ONCE = 200
#: Rows of the table of languages up to which it is broadcast.
BROADCAST_LANGS = 10_000
ROUNDS = 2
SMOOTHING = 0.1
UNKNOWN = "und"
MARK = "▁"
#: Words whose scores a worker remembers.
REMEMBERED = 300_000

_letters = re.compile(r"[^\W\d_]+").findall
_lattices: dict = {}


class Arcs(NamedTuple):
    """Arcs of many words, in order of group: those with the same first character's place and the same length.

    word, start and end (places in the word) and the pieces: more than one, of bytes, only where spell has them.
    """

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    edges: np.ndarray
    spell: dict[int, list[int]]


class Lattice:
    """Pieces of a vocabulary file, found by hashes of characters."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        kinds = [(model.id_to_piece(i), i) for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i))]
        self.bytes = {int(p[3:5], 16): i for p, i in kinds if model.is_byte(i)}
        pieces = {p: i for p, i in kinds if not model.is_byte(i)}
        self.longest = max(map(len, pieces))
        heads = list({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        found = self._hashes(heads)
        order = np.argsort(found)
        self.heads, self.piece_of = found[order], np.array([pieces.get(h, -1) for h in heads])[order]

    @staticmethod
    def _hashes(texts: list[str]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        return hashes_between(prefix_sums(_characters(texts)), ends - sizes, ends)

    @classmethod
    def at(cls, path: str) -> Lattice:
        if path not in _lattices:
            _lattices[path] = cls(path)
        return _lattices[path]

    def arcs(self, words: list[str]) -> Arcs:
        """All pieces that lie in the words; a character without one has its UTF-8 bytes."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        chars = _characters(words)
        sums = prefix_sums(chars)
        word = np.repeat(np.arange(len(words)), sizes)
        stop = np.repeat(ends, sizes)
        at, parts = np.arange(len(chars)), []
        for n in range(1, self.longest + 1):
            at = at[at + n <= stop[at]]
            if not len(at):
                break
            h = hashes_between(sums, at, at + n)
            i = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
            known = self.heads[i] == h
            if n == 1:
                lone = at[~known | (self.piece_of[i] < 0)]
            at, i = at[known], i[known]
            whole = self.piece_of[i] >= 0
            parts.append((at[whole], np.full(int(whole.sum()), n), self.piece_of[i[whole]]))
        parts.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1)))
        at, n, piece = (np.concatenate(x) for x in zip(*parts))
        start = at - (ends - sizes)[word[at]]
        order = np.lexsort((n, start))
        at, n, piece, start = at[order], n[order], piece[order], start[order]
        key = start * (self.longest + 1) + n
        spell = {k: [self.bytes[x] for x in chr(chars[at[k]]).encode("utf-8", "replace")] for k in np.flatnonzero(piece < 0).tolist()}
        return Arcs(word[at], start, start + n, piece, np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)), spell)


def _characters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _weights(arcs: Arcs, table: np.ndarray) -> np.ndarray:
    """Probability of each arc's pieces in each language."""
    out = table[np.maximum(arcs.piece, 0)]
    for k, pieces in arcs.spell.items():
        out[k] = table[pieces].prod(axis=0)
    return out


def chunks(words: list[str], most: int = 120_000) -> Iterator[list[int]]:
    """Numbers of words of like length, at most about most characters with padding at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    held: list[int] = []
    for i in order:
        if held and (len(held) + 1) * (len(words[i]) + 1) > most:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


class Model(NamedTuple):
    """langs in order; table: a row of probabilities for each piece, a column for each language."""

    langs: list[str]
    table: np.ndarray
    path: str

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Of marked words, a row for each: log of the sum over all segmentations, for each language."""
        lattice, out = Lattice.at(self.path), np.zeros((len(words), len(self.langs)))
        for own in chunks(words):
            some = [words[i] for i in own]
            arcs = lattice.arcs(some)
            for a in range(0, len(self.langs), LANGS_AT_ONCE):
                part = slice(a, a + LANGS_AT_ONCE)
                out[own, part] = _summed(arcs, _weights(arcs, self.table[:, part]), np.array([len(w) for w in some]))
        return out


def _summed(arcs: Arcs, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each word and language, log of the forward sum over the arcs."""
    forward = np.zeros((len(sizes), sizes.max() + 1, weight.shape[1]))
    forward[:, 0] = 1
    scale, done = np.zeros(len(sizes)), 0
    for x, y in zip(arcs.edges, arcs.edges[1:]):
        a, e = arcs.start[x], arcs.end[x]
        if a >= done + 8:  # keep numbers in range
            done = a
            top = np.maximum(forward[:, a:].max(axis=(1, 2)), 1e-250)
            live = sizes > a
            forward[live, a:] /= top[live, None, None]
            scale[live] += np.log(top[live])
        w = arcs.word[x:y]
        forward[w, e] += forward[w, a] * weight[x:y]
    return np.log(np.maximum(forward[np.arange(len(sizes)), sizes], 1e-300)) + scale[:, None]


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _letters(text.lower())


def start_table(path: str) -> np.ndarray:
    """The same for each language: falls with a piece's number, as public vocabularies are in order of frequency."""
    size = Lattice.at(path).size
    p = 1 / (np.arange(size) + 100.0)
    return (p / p.sum())[:, None]


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Rows that are not trained on: CRC-32 of the key as text leaves no remainder."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_rows(docs: DataFrame, rows: int) -> DataFrame:
    """lang and text of about rows rows of each language at most, chosen by a hash of id and text."""
    some = docs.filter("lang is not null and text is not null").select(F.xxhash64("doc_id", "text").alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    shares = written(some.groupBy("lang").agg((rows / F.count(F.lit(1))).alias("share")), "language-shares")
    if shares.count() <= BROADCAST_LANGS:  # texts stay where they lie
        shares = F.broadcast(shares)
    return some.join(shares, "lang").filter((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < F.col("share")).drop("h", "share")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n over the rows of docs (lang and text not null); each task counts before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def f(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                counts.update([(lang, w) for w in words_of(text.as_py())])
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.mapInArrow(f, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _shares(words: list[str], n: np.ndarray, table: np.ndarray, lattice: Lattice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces and their expected counts, for words of one language with probabilities table (a column)."""
    for own in chunks(words):
        some = [words[i] for i in own]
        arcs = lattice.arcs(some)
        weight = np.log(np.maximum(_weights(arcs, table)[:, 0], 1e-300))
        for k, pieces in arcs.spell.items():
            weight[k] = np.log(np.maximum(table[pieces, 0], 1e-300)).sum()
        sizes = np.array([len(w) for w in some])
        forward, backward = (np.full((len(some), sizes.max() + 1), -np.inf) for _ in range(2))
        forward[:, 0] = 0
        backward[np.arange(len(some)), sizes] = 0
        groups = list(zip(arcs.edges, arcs.edges[1:]))
        for x, y in groups:  # a word has one arc at most in each group
            w, a, e = arcs.word[x:y], arcs.start[x], arcs.end[x]
            forward[w, e] = np.logaddexp(forward[w, e], forward[w, a] + weight[x:y])
        for x, y in reversed(groups):
            w, a, e = arcs.word[x:y], arcs.start[x], arcs.end[x]
            backward[w, a] = np.logaddexp(backward[w, a], backward[w, e] + weight[x:y])
        w = arcs.word
        share = n[own][w] * np.exp(forward[w, arcs.start] + weight + backward[w, arcs.end] - forward[w, sizes[w]])
        spelt = np.array(list(arcs.spell), np.int64)
        plain = np.ones(len(w), bool)
        plain[spelt] = False
        yield arcs.piece[plain], share[plain]
        for k, pieces in arcs.spell.items():
            yield np.array(pieces), np.full(len(pieces), share[k])


def _expected(counts: DataFrame, langs: list[str], table: np.ndarray, path: str) -> np.ndarray:
    """Expected counts of each piece in each language, by forward and backward sums over the counted words."""
    schema = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])

    def f(batches):
        lattice, total = Lattice.at(path), np.zeros((len(langs), table.shape[0]))
        for b in batches:
            names, words, n = np.array(b.column("lang").to_pylist(), object), np.array([MARK + w for w in b.column("word").to_pylist()], object), b.column("n").to_numpy()
            for i, lang in enumerate(langs):
                own = np.flatnonzero(names == lang)
                if len(own):
                    column = table[:, [i if table.shape[1] > 1 else 0]]
                    for piece, share in _shares(words[own].tolist(), n[own].astype(float), column, lattice):
                        total[i] += np.bincount(piece, share, table.shape[0])
        lang, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[lang, piece])], schema=schema)

    # a row for each language and piece
    found = counts.mapInArrow(f, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((table.shape[0], len(langs)))
    out[found["piece"], found["lang"]] = found["n"]
    return out


def train(docs: DataFrame, vocabulary: str, *, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model | None:
    """Learns from rows of docs with a text and a lang, about rows of each language at most."""
    counts = written(word_counts(training_rows(docs, rows)), "language-words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    table = start = start_table(vocabulary)
    for _ in range(rounds):
        n = _expected(counts, langs, table, vocabulary)
        table = n + smoothing * start * table.shape[0]
        table = table / table.sum(axis=0)
    return Model(langs, table, vocabulary)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (posterior of that language, all equally likely before) of each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def f(batches):
        known: dict[str, int] = {}
        scores = np.zeros((0, len(model.langs) if model else 0))
        for batch in batches:
            for b, _ in steps(iter([batch])):
                texts = [words_of(t) if t and model is not None and any(map(str.isalpha, t)) else [] for t in b.column("text").to_pylist()]
                new = list(set().union(*texts).difference(known))
                if len(known) + len(new) > REMEMBERED:
                    known, new, scores = {}, list(set().union(*texts)), scores[:0]
                if new:
                    scores = np.concatenate([scores, model.log_likelihoods([MARK + w for w in new])])
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                n = np.array([len(t) for t in texts])
                names, best = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                some = np.flatnonzero(n)
                if len(some):
                    rows = scores[np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))]
                    total = np.add.reduceat(rows, (np.cumsum(n) - n)[some], axis=0)
                    p = np.exp(total - total.max(axis=1)[:, None])
                    p /= p.sum(axis=1)[:, None]
                    names[some] = np.array(model.langs, object)[p.argmax(axis=1)]
                    best[some] = p.max(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(best)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, "doc_id long, lang_pred string, score double")
