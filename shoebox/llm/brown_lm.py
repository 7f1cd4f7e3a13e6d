"""Language-model scores by a class-based n-gram model with Brown-style classes.

Every distinct training word, whatever its frequency, is clustered by exchange. First classes come from hashed neighbours:
one pass over the corpus counts each word's neighbours to the left and right by their signature, and sweeps over the
vocabulary move each word to the class under which its neighbours are likeliest. Then exchanges work on the classes
themselves: blocks of documents send each word's neighbours by class to the word's owner, which moves it to the class where
the class-bigram likelihood gains most, its own occurrences taken out of the class that it is in. One half of the words
moves at a time; the moves return to the blocks, where class bigrams are counted anew, and an exchange that does not raise
the likelihood is undone. A text's probability is the product of class transitions and word emissions, interpolated with the
additive unigram model; the weight is the one under which the training words, each left out in turn, are likeliest.

Words meet their counts and classes in the exchange of `blocks`. The driver holds only matrices of classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import held_out, materialise, text_of

CLASSES, SIGNATURES, SWEEPS = 64, 64, 4
#: Exchanges of classes; in each of them one of so many parts of every owner's words moves, given the classes of all others.
EXCHANGES, TURNS = 2, 2
#: Additive constant of the unigram model; pseudo-count of a class's own frequency in transitions; weights of the class model to choose from.
ADD, PRIOR, WEIGHTS = 0.1, 5.0, (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98)
#: Bytes of text whose words a task counts before it sends them.
PIECE = 8 << 20
_F = 2 * (SIGNATURES + 1)
_G = 2 * (CLASSES + 1)
UNKNOWN = CLASSES + 1  # CLASSES itself is the class of the end


def units(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    return B.blank_separated([t.lower() for t in texts])


def _neighbours(words: pa.Array, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys word * _F + feature and their counts; features are left signatures, then right ones."""
    own = ((B.hashes(words) >> np.uint64(32)) % np.uint64(SIGNATURES)).astype(np.int64)[codes]
    left, right = np.full(len(codes), SIGNATURES), np.full(len(codes), SIGNATURES)
    left[1:], right[:-1] = own[:-1], own[1:]
    ends = np.cumsum(sizes[sizes > 0])
    left[ends[:-1]] = SIGNATURES
    right[ends - 1] = SIGNATURES
    return np.unique(np.concatenate([codes.astype(np.int64) * _F + left, codes.astype(np.int64) * _F + SIGNATURES + 1 + right]), return_counts=True)


def _count(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """part, words, arrays: for each owner the distinct words of a piece of the corpus, their counts and neighbours."""

    def piece(texts: list[bytes]) -> pa.RecordBatch:
        words, codes, sizes = B.coded(texts, units)
        counts = np.bincount(codes, minlength=len(words))
        keys, n = _neighbours(words, codes, sizes) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        part = B.owners(words, parts)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(words), np.int64)
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        rank[order] = np.arange(len(words)) - bounds[part[order]]
        word = keys // _F
        by = np.argsort(part[word], kind="stable")
        keys, n = (rank[word] * _F + keys % _F)[by], n[by]
        at = np.searchsorted(part[word][by], np.arange(parts + 1))
        rows = []
        for p in range(parts):
            own = order[bounds[p] : bounds[p + 1]]
            if len(own):
                k = keys[at[p] : at[p + 1]]
                rows.append((p, B.pack_strings(words.take(pa.array(own))), B.pack_arrays(counts[own].astype(np.uint32), np.diff(k, prepend=0).astype(np.uint32), n[at[p] : at[p + 1]].astype(np.uint32))))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "words", "arrays"])

    held, size = [], 0
    for batch in batches:
        for t in batch.column(0):
            held.append(t.as_py())
            size += len(held[-1])
            if size >= PIECE:
                yield piece(held)
                held, size = [], 0
    if held:
        yield piece(held)


def _gather(table: pa.Table) -> pa.Table:
    """One row for each owner: its words, their counts and neighbours over the whole corpus."""
    lists = [B.unpack_strings(w.as_py()) for w in table.column("words")]
    seen, ids = B.numbered(pa.concat_arrays(lists))
    word, counts, keys, n = np.split(ids, np.cumsum([len(x) for x in lists])[:-1]), [], [], []
    for own, a in zip(word, table.column("arrays"), strict=True):
        c, k, m = B.unpack_arrays(a.as_py())
        k = np.cumsum(k, dtype=np.int64)
        counts.append(c)
        keys.append(own[k // _F] * _F + k % _F)
        n.append(m)
    total = np.bincount(np.concatenate(word), np.concatenate(counts), len(seen)).astype(np.uint64)
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, np.concatenate(n)).astype(np.uint64)
    return pa.table({"part": table.column("part")[:1], "n_words": pa.array([len(seen)], pa.int64()), "n_tokens": pa.array([int(total.sum())], pa.int64()), "words": pa.array([B.pack_strings(seen)], pa.binary()), "arrays": pa.array([B.pack_arrays(total, np.diff(keys, prepend=0).astype(np.uint32), n)], pa.binary())})


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """part, n_words, n_tokens, words, arrays: the distinct words of docs by owner, with counts and neighbours."""
    parts = B.part_count(docs, text)
    pieces = docs.select(text_of(text).cast("binary").alias("text")).mapInArrow(lambda it: _count(it, parts), "part int, words binary, arrays binary")
    return materialise(pieces.groupBy("part").applyInArrow(_gather, "part int, n_words bigint, n_tokens bigint, words binary, arrays binary"))


def _scores(keys: np.ndarray, n: np.ndarray, words: int, log: np.ndarray) -> np.ndarray:
    """How likely each word's neighbours are under each class: words x classes. log: classes x features."""
    word, feature = keys // log.shape[1], keys % log.shape[1]
    score = np.zeros((words, log.shape[0]), np.float32)
    table = np.ascontiguousarray(log.T.astype(np.float32))
    cuts = [*np.searchsorted(word, np.arange(0, words, 4096)).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            own = word[a:b]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            score[own[starts]] = np.add.reduceat(table[feature[a:b]] * n[a:b, None].astype(np.float32), starts, axis=0)
    return score


def _classify(keys: np.ndarray, n: np.ndarray, words: int, log: np.ndarray) -> np.ndarray:
    """The class of each word under which its neighbours are likeliest (ties: the lowest)."""
    return _scores(keys, n, words, log).argmax(1).astype(np.uint8)


def contexts(pairs: np.ndarray) -> np.ndarray:
    """Class bigrams (with END, without UNKNOWN) as each class's left and right neighbours: classes x _G."""
    pairs = pairs[: CLASSES + 1, : CLASSES + 1]
    return np.concatenate([pairs[:, :CLASSES].T, pairs[:CLASSES]], axis=1)


def objective(pairs: np.ndarray) -> float:
    """The part of the class-bigram log likelihood that classes change: sum N(a, b) log N(a, b) - sum N(a) log N(a), of either side."""
    log = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return log(pairs) - log(pairs.sum(0)) - log(pairs.sum(1))


def moved(keys: np.ndarray, n: np.ndarray, classes: np.ndarray, pairs: np.ndarray, may: np.ndarray) -> np.ndarray:
    """The classes after each word that may move went where its likelihood gains most (ties: it stays, or the lowest class).

    keys: sorted word * _G + feature, features being the classes of left neighbours, then of right ones; n: their counts.
    """
    half, matrix = CLASSES + 1, contexts(pairs)
    word, feature = keys // _G, keys % _G
    score = _scores(keys, n, len(classes), _log(matrix, half))
    side = feature // half
    own = classes[word].astype(np.int64)
    total = np.bincount(word, n * (side == 0), len(classes))  # a word has as many left neighbours as right ones
    of = np.stack([matrix[:, :half].sum(1), matrix[:, half:].sum(1)])
    left = np.log((matrix[own, feature] - n + 0.5) / (of[side, own] - total[word] + 0.5 * half))
    rows = np.arange(len(classes))
    score[rows, classes] = np.bincount(word, n * left, len(classes))
    best = score.argmax(1)
    return np.where(may & (score[rows, best] > score[rows, classes]), best, classes).astype(np.uint8)


def _log(matrix: np.ndarray, half: int = SIGNATURES + 1) -> np.ndarray:
    """Smoothed log probabilities of left and of right features for each class."""
    out = np.zeros(matrix.shape)
    for s in (slice(0, half), slice(half, 2 * half)):
        m = matrix[:, s] + 0.5
        out[:, s] = np.log(m / m.sum(1, keepdims=True))
    return out


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts, keys, n = B.unpack_arrays(row["arrays"])
    return counts, np.cumsum(keys, dtype=np.int64), n.astype(np.float64)


def exchange_classes(vocab: DataFrame, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The classes' neighbour counts after the sweeps: a matrix of classes x features.

    The first classes are the most frequent words. Each sweep is one pass over the vocabulary, whose sums are a matrix.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, (counts, keys, n) = B.unpack_strings(row["words"]), _opened(row)
                best = np.lexsort((np.arange(len(words)), -counts.astype(np.int64)))[:classes]
                out = [(words[i].as_py(), int(counts[i]), B.pack_arrays(keys[a:b] % _F, n[a:b])) for i in best.tolist() for a, b in [np.searchsorted(keys, [i * _F, (i + 1) * _F]).tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["word", "n", "arrays"])

    matrix = np.zeros((classes, _F))
    for k, row in enumerate(vocab.mapInArrow(frequent, "word binary, n bigint, arrays binary").orderBy(F.desc("n"), "word").limit(classes).collect()):
        feature, n = B.unpack_arrays(bytes(row["arrays"]))
        matrix[k, feature] = n
    for _ in range(sweeps):
        log = _log(matrix)

        def sweep(batches: Iterator[pa.RecordBatch], log: np.ndarray = log) -> Iterator[pa.RecordBatch]:
            total = np.zeros(classes * _F)
            for batch in batches:
                for row in batch.to_pylist():
                    counts, keys, n = _opened(row)
                    own = _classify(keys, n, len(counts), log).astype(np.int64)
                    total += np.bincount(own[keys // _F] * _F + keys % _F, n, len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

        matrix = np.zeros(classes * _F)
        for cell, n in vocab.mapInArrow(sweep, "cell bigint, n double").groupBy("cell").agg(F.sum("n")).collect():  # at most classes x features
            matrix[cell] = n
        matrix = matrix.reshape(classes, _F)
    return matrix


def classed(vocab: DataFrame, matrix: np.ndarray) -> DataFrame:
    """part, words, arrays (counts, classes): every word of the vocabulary in its class."""
    log = _log(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts, keys, n = _opened(row)
                arrays = B.pack_arrays(counts, _classify(keys, n, len(counts), log))
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["words"]], pa.binary()), pa.array([arrays], pa.binary())], ["part", "words", "arrays"])

    return materialise(vocab.mapInArrow(run, "part int, words binary, arrays binary"))


def _look_up(words: pa.Array, rows: pa.Table):
    """For each asked word: its count (0: unknown), its class and its number among its owner's words."""
    opened = [B.unpack_arrays(a.as_py()) for a in rows.column("arrays")]
    _, codes = B.numbered(pa.concat_arrays([*[B.unpack_strings(w.as_py()) for w in rows.column("words")], words]))
    known = len(codes) - len(words)
    counts, classes = np.zeros(len(codes), np.uint64), np.full(len(codes), UNKNOWN, np.uint8)
    if known:  # an owner's words are distinct, so they are numbered first and in order
        counts[:known], classes[:known] = np.concatenate([a[0] for a in opened]), np.concatenate([a[1] for a in opened])
    at = codes[known:]
    return lambda asked: (counts[at[asked]], classes[at[asked]], np.where(counts[at[asked]] > 0, at[asked], 0).astype(np.uint32))


class Coded:
    """A block's documents as numbers. Local words are numbered by their owners, and there by the number that the owner has for them."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.arrays = B.unpack_arrays(row["arrays"])
        self.ids, self.known, learn, sizes, self.codes, self.counts, self.classes, ranks, self.parts, self.cuts = self.arrays
        self.ranks = np.cumsum(ranks, dtype=np.int64)
        self.learn, self.sizes = learn.astype(bool), sizes + 1  # each text is followed by its end
        self.ends = np.cumsum(self.sizes) - 1
        self.word = np.ones(int(self.sizes.sum()), bool)
        self.word[self.ends] = False
        #: For all texts end to end: counts (0 at an end), classes, the class before, and whether the model learns from it.
        self.n, self.kind = np.zeros(len(self.word), np.int64), np.full(len(self.word), CLASSES, np.int64)
        self.n[self.word], self.kind[self.word] = self.counts[self.codes].astype(np.int64), self.classes[self.codes]
        self.before = np.empty_like(self.kind)
        self.before[1:], self.before[:1] = self.kind[:-1], CLASSES  # what stands before a text is an end
        self.learned = np.repeat(self.learn, self.sizes)

    def features(self) -> list[tuple[int, int, bytes]]:
        """part, block and for each owner: its words' numbers, and how often each has which class to its left and right."""
        own = np.flatnonzero(self.word & self.learned)
        at = np.zeros(len(self.word), np.int64)
        at[self.word] = self.codes
        keys, n = np.unique(np.concatenate([at[own] * _G + self.before[own], at[own] * _G + CLASSES + 1 + self.kind[own + 1]]), return_counts=True)
        out = []
        for part, a, b in zip(self.parts.tolist(), [0, *self.cuts.tolist()], self.cuts.tolist(), strict=False):
            i, j = np.searchsorted(keys, [a * _G, b * _G])
            if i < j:
                out.append((part, self.block, B.pack_arrays(np.diff(self.ranks[a:b], prepend=0).astype(np.uint32), np.diff(keys[i:j] - a * _G, prepend=0).astype(np.uint32), n[i:j].astype(np.uint32))))
        return out


_CODED = "block int, arrays binary"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[Coded]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Coded(row)


def _cells(df: DataFrame, run: Callable, size: int) -> np.ndarray:
    """The sums over all tasks of what run(batches) yields: an array of `size` numbers, bounded by the classes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _coded(batches):
            total += run(x)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(size)
    for cell, m in df.mapInArrow(sums, "cell bigint, n double").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = m
    return out


def class_bigrams(coded: DataFrame) -> np.ndarray:
    k = CLASSES + 2
    return _cells(coded, lambda x: np.bincount((x.before * k + x.kind)[x.learned], minlength=k * k), k * k).reshape(k, k)


def exchanged(coded: DataFrame, learned: DataFrame, pairs: np.ndarray, turn: int, turns: int) -> tuple[DataFrame, DataFrame]:
    """coded and the owners' classes after one exchange: each word whose turn it is went where it gains most, given all classes as they were."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _coded(batches):
            rows = x.features()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "block", "arrays"])

    def own(table: pa.Table, rows: pa.Table) -> pa.Table:
        """Each block's words' new classes; under block -1 those of all of the part's words."""
        opened = [B.unpack_arrays(a.as_py()) for a in table.column("arrays")]
        if not opened or not rows.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "classes": pa.array([], pa.binary())})
        classes = B.unpack_arrays(rows.column("arrays")[0].as_py())[1]
        found = [(np.cumsum(ranks, dtype=np.int64), np.cumsum(k, dtype=np.int64), n) for ranks, k, n in opened]
        keys, inverse = np.unique(np.concatenate([ranks[k // _G] * _G + k % _G for ranks, k, _ in found]), return_inverse=True)
        may = np.arange(len(classes)) % turns == turn
        new = moved(keys, np.bincount(inverse, np.concatenate([n for _, _, n in found])), classes, pairs, may)
        part = table.column("part")[0].as_py()
        blocks = [*table.column("block").to_pylist(), -1]
        told = [*(B.pack_arrays(new[ranks]) for ranks, _, _ in found), B.pack_arrays(new)]
        return B.released(pa.table({"block": pa.array(blocks, pa.int32()), "part": pa.array([part] * len(blocks), pa.int32()), "classes": pa.array(told, pa.binary())}))

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        arrays = B.unpack_arrays(row["arrays"])
        classes, parts, cuts = arrays[6].copy(), arrays[8].tolist(), arrays[9].tolist()
        bounds = {p: (a, b) for p, a, b in zip(parts, [0, *cuts], cuts, strict=False)}
        for part, told in zip(right.column("part").to_pylist(), right.column("classes").to_pylist(), strict=True):
            a, b = bounds[part]
            classes[a:b] = np.where(arrays[5][a:b] > 0, B.unpack_arrays(told)[0], UNKNOWN)
        return pa.table({"block": left.column("block"), "arrays": pa.array([B.pack_arrays(*arrays[:6], classes, *arrays[7:])], pa.binary())})

    asked = coded.mapInArrow(send, "part int, block int, arrays binary")
    told = materialise(asked.groupBy("part").cogroup(learned.select("part", "arrays").groupBy("part")).applyInArrow(own, "block int, part int, classes binary"))
    again = coded.groupBy("block").cogroup(told.where("block >= 0").groupBy("block")).applyInArrow(take, _CODED)
    vocabulary = told.where("block < 0").select("part", "classes")
    return materialise(again), vocabulary


@dataclass(frozen=True)
class Model:
    """Class bigrams of the training documents and what else probabilities need."""

    pairs: np.ndarray
    tokens: int
    words: int
    documents: int
    weight: float = 0.0

    def base(self, count: np.ndarray, out: int = 0) -> np.ndarray:
        """The unigram model; out: 1 leaves the token itself out."""
        total = self.tokens + ADD * (self.words + 1)
        return ADD / total + count / total if not out else (np.maximum(count - 1, 0) + ADD) / max(ADD, total - 1)

    def classes(self, before: np.ndarray, kind: np.ndarray, count: np.ndarray, out: int = 0) -> np.ndarray:
        """Class transition times word emission."""
        of = self.pairs.sum(0)  # a class's tokens
        frequency = of / max(1.0, of.sum())
        step = (self.pairs[before, kind] - out + PRIOR * frequency[kind]) / (self.pairs.sum(1)[before] - out + PRIOR)
        step = np.where(before == UNKNOWN, frequency[kind], step)
        return np.maximum(step, 0) * np.maximum(count - out, 0) / np.maximum(1.0, of[kind] - out)


def fit(rows: DataFrame, modulus: int, remainder: int, exchanges: int = EXCHANGES) -> tuple[DataFrame, Model, list[float]]:
    """The documents in numbers, the model, and the likelihoods before and after each exchange. rows: doc_id, text, held_out."""
    train = rows.where(~F.col("held_out"))
    vocab = vocabulary(train)
    n_docs = train.count()
    v, n = vocab.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    v, n = (v or 0) + (n_docs > 0), (n or 0) + n_docs
    learned = classed(vocab, exchange_classes(vocab))
    parts = B.part_count(train)

    def finish(block, ids, texts, words, codes, sizes, place, arrays) -> pa.Table:
        counts, classes, ranks = (np.concatenate([a[k] for a in arrays]) for k in range(3)) if arrays else (np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        _, groups = B.by_owner(words, parts)
        order = np.lexsort((ranks, np.repeat(np.arange(len(groups)), [b - a for _, a, b in groups])))  # by owner and number there: numbers that follow each other take little room
        counts, classes, ranks = counts[order], classes[order], np.diff(ranks[order].astype(np.int64), prepend=0)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        known = np.array([i is not None for i in ids], np.uint8)
        learn = np.array([i is None or zlib.crc32(str(i).encode()) % modulus != remainder for i in ids], np.uint8)
        value = B.pack_arrays(np.array([i or 0 for i in ids], np.int64), known, learn, sizes, number[place[codes]].astype(np.uint32), counts, classes, ranks.astype(np.int32), np.array([p for p, _, _ in groups], np.int32), np.array([b for _, _, b in groups], np.int64))
        return pa.table({"block": pa.array([block], pa.int32()), "arrays": pa.array([value], pa.binary())})

    coded = materialise(B.exchange(B.blocks_of(rows), parts, units, _look_up, finish, _CODED, learned))
    pairs = class_bigrams(coded)
    reached = [objective(pairs)]
    for k in range(exchanges if n_docs else 0):
        again, told = exchanged(coded, learned, pairs, k % TURNS, TURNS)
        now = class_bigrams(again)
        if objective(now) > reached[-1]:
            coded, pairs = again, now
            if k + 1 < exchanges:  # the next exchange needs the owners' classes
                learned = _reclassed(learned, told)
        reached.append(max(reached[-1], objective(now)))
    model = Model(pairs, n, v, n_docs)

    def likelihoods(x: Coded) -> np.ndarray:
        x.n[x.ends] = n_docs
        at = x.learned
        base, classes = model.base(x.n[at], 1), model.classes(x.before[at], x.kind[at], x.n[at], 1)
        return np.array([np.log(w * classes + (1 - w) * base).sum() for w in WEIGHTS]) if n > 1 else np.zeros(len(WEIGHTS))

    weight = WEIGHTS[int(np.argmax(_cells(coded, likelihoods, len(WEIGHTS))))]
    return coded, replace(model, weight=weight), reached


def _reclassed(learned: DataFrame, told: DataFrame) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left
        counts, _ = B.unpack_arrays(left.column("arrays")[0].as_py())
        return pa.table({"part": left.column("part"), "words": left.column("words"), "arrays": pa.array([B.pack_arrays(counts, B.unpack_arrays(right.column("classes")[0].as_py())[0])], pa.binary())})

    return materialise(learned.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, "part int, words binary, arrays binary"))


def score(docs: DataFrame, modulus: int = 10, remainder: int = 0, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Rows whose crc32(doc_id as text) leaves `remainder` by `modulus` are held out; the model learns from the others, rows
    with a null id included. Null texts count as empty and have one token, the end. A text may have any length that a Spark
    string has. Repeated rows count and are scored each; other columns are ignored; an empty table gives an empty result.
    Without training rows every word is unknown and both scores are those of the uniform additive model.
    """
    rows = docs.select("doc_id", text_of(text).alias("text"), held_out(modulus, remainder).alias("held_out"))
    coded, model, _ = fit(rows, modulus, remainder)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _coded(batches):
            x.n[x.ends] = model.documents
            base = model.base(x.n)
            both = model.weight * model.classes(x.before, x.kind, x.n) + (1 - model.weight) * base
            starts = x.ends - x.sizes + 1
            add = lambda y: np.add.reduceat(y, starts) if len(starts) else y  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.ids, mask=x.known == 0), pa.array(~x.learn), pa.array(x.sizes), pa.array(add((x.n > 0).astype(np.int64))), pa.array(np.full(len(x.ids), model.tokens, np.int64)), pa.array(add(np.log10(base))), pa.array(add(np.log10(both)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return coded.mapInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
