"""Language-model scoring with a hidden Markov model over word classes.

A word's class is the word itself if it makes up at least ``OWN_SHARE`` of the training tokens (so there are at
most 1 / OWN_SHARE such classes), else one of ``BUCKETS`` classes by its ending. States emit classes, classes
emit words by their smoothed training counts. Words are counted over all documents; the FREQUENT most frequent
ones are sent to the tasks with their counts, and occurrences of all others are joined with the counts by word.
Baum-Welch passes over all training documents add expected counts of whole texts up across partitions by class;
the scaled forward recursion gives each whole document's exact log-probability.

Texts are handled in pieces side by side: the product of a piece's steps (a states by states matrix) carries the
forward vector into the next piece and the backward vector into the one before, so that the pieces' expected counts
and likelihoods are exactly those of the whole text, while memory is bounded by pieces.

Defined cases: a null text is the empty text, whose only token is its end; a null doc_id hashes as the
empty text; repeated rows count as often as they are there; other columns are ignored; an empty table
gives an empty result; without training documents all counts are 0.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import Workspace, batch_rows, remainder

STATES, PASSES = 8, 3
OWN_SHARE, BUCKETS = 1e-4, 1024
#: At most so many words are sent to the tasks with their counts.
FREQUENT = 200_000
#: Documents of the sample (of at most FIRST_WORDS words each) on which the first guess of the states is made; full passes over all training documents follow.
FIRST_ROWS, FIRST_WORDS, FIRST_PASSES = 1000, 20_000, 12
#: Words of a piece, words of the pieces that are handled side by side, and entries of a task's counts before they are passed on.
PIECE, SIDE_BY_SIDE, CACHE = 1024, 500_000, 400_000
#: Steps after which a product of steps is scaled; probabilities of so many steps are far from the least double.
SCALED = 16
ALPHA = 0.1


def planes(x: np.ndarray) -> bytes:
    """16-bit numbers as their low and high bytes, each together, which compress well."""
    return x.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def split(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or "").encode().lower().split()  # bytes: ASCII white space and A-Z only


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, n): occurrences in training documents, and in all; ``docs`` holds held_out and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def flush(held: bool) -> pa.RecordBatch:
            own = found[held]
            n = pa.array(list(own.values()), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(np.zeros(len(own), np.int64)) if held else n, n], ["word", "c", "n"])
            own.clear()
            return out

        for b in batches:
            for held, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found[held].update(split(text))
            for held in (False, True):
                if len(found[held]) > CACHE:
                    yield flush(held)
        yield flush(False)
        yield flush(True)

    return docs.select("held_out", "text").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


class Model:
    """Start, transition and emission probabilities: pi[k], a[k, l], b[class, k]; the last class is the end of a text."""

    def __init__(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.pi, self.a, self.b = pi, a, b

    @staticmethod
    def from_counts(pi: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> Model:
        """Smoothed with one start and transition, and with one emission spread by the classes' shares."""
        pi, a, b = pi + 1, a + 1, b + share[:, None]
        return Model(pi / pi.sum(), a / a.sum(1, keepdims=True), b / b.sum(0, keepdims=True))


class Batch:
    """Pieces of class sequences by time: at step t the first width[t] of them, longest first, go on."""

    def __init__(self, pieces: list[np.ndarray]):
        lengths = np.array([len(s) for s in pieces])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        time = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.zeros(0, int)
        self.classes = np.concatenate([pieces[i] for i in self.order])[np.argsort(time, kind="stable")].astype(np.int64) if len(time) else time
        self.width = np.bincount(time) if len(time) else time
        self.at = np.concatenate([[0], np.cumsum(self.width)]).astype(np.int64)
        self.last = self.at[lengths - 1] + np.arange(len(lengths))

    def transfer(self, m: Model, first: np.ndarray) -> np.ndarray:
        """Of each piece the product of its steps (transition, then emission), scaled; a first piece has no transition into it."""
        e, k, first = m.b[self.classes], len(m.pi), first[self.order]
        out = np.where(first[:, None, None], np.eye(k), m.a[None])
        at = self.at.tolist()
        for t, n in enumerate(self.width.tolist()):
            x = out[:n]
            if t:
                x = (x.reshape(-1, k) @ m.a).reshape(n, k, k)
            np.multiply(x, e[at[t] : at[t + 1], None, :], out=out[:n])
            if t % SCALED == SCALED - 1:
                out[:n] /= out[:n].max((1, 2))[:, None, None]
        out /= out.max((1, 2))[:, None, None]
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def forward(self, m: Model, start: np.ndarray, keep: bool = False) -> tuple:
        """Log10-likelihood of each piece, given its distribution of states before it emits; with ``keep`` also alphas, emissions and scales by time."""
        e = m.b[self.classes]
        total, alpha, one = np.zeros(len(self.order)), start[self.order], np.ones(len(m.pi))
        if keep:
            alphas, scales = np.empty_like(e), np.empty(len(e))
        at = self.at.tolist()
        for t, n in enumerate(self.width.tolist()):
            alpha = (alpha[:n] @ m.a if t else alpha) * e[at[t] : at[t + 1]]
            scale = alpha @ one
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
            if keep:
                alphas[at[t] : at[t + 1]], scales[at[t] : at[t + 1]] = alpha, scale
        out = np.empty_like(total)
        out[self.order] = total
        return (out, alphas, e, scales) if keep else (out,)

    def expected(self, m: Model, enter: Enter) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, transitions and emissions, and the log10-likelihood."""
        total, alphas, e, scales = self.forward(m, enter.start, keep=True)
        at, width = self.at.tolist(), self.width.tolist()
        first, came, end = enter.first[self.order], enter.came[self.order], enter.end[self.order]
        end = end / (alphas[self.last] * end).sum(1, keepdims=True)
        gamma, moves = np.empty_like(alphas), np.zeros_like(m.a)
        beta = end[: width[-1]]
        for t in range(len(width) - 1, -1, -1):
            own = slice(at[t], at[t + 1])
            gamma[own] = alphas[own] * beta
            x = e[own] * beta / scales[own, None]
            if t:
                moves += alphas[at[t - 1] : at[t - 1] + width[t]].T @ x
                beta = end[: width[t - 1]].copy()
                beta[: width[t]] = x @ m.a.T
            else:
                moves += came[~first].T @ x[~first]
        emitted = np.stack([np.bincount(self.classes, gamma[:, k], len(m.b)) for k in range(len(m.pi))], 1)
        return gamma[: width[0]][first].sum(0), m.a * moves, emitted, float(total.sum())


@dataclass
class Enter:
    """What whole texts bring to their pieces: whether a piece is its text's first, the states before its first emission and (came) before the transition into it, and the backward vector at its end."""

    first: np.ndarray
    start: np.ndarray
    came: np.ndarray
    end: np.ndarray

    def part(self, a: int, b: int) -> Enter:
        return Enter(self.first[a:b], self.start[a:b], self.came[a:b], self.end[a:b])


def in_pieces(sequences: list[np.ndarray], m: Model, size: int | None = None) -> tuple[list[np.ndarray], np.ndarray, Enter]:
    """The pieces of the sequences, the sequence of each, and what they bring to each: a piece's product of steps passes vectors on over it."""
    size = size or PIECE
    pieces = [s[i : i + size] for s in sequences for i in range(0, len(s), size)]
    counts = np.array([-(-len(s) // size) for s in sequences])
    whose = np.repeat(np.arange(len(sequences)), counts)
    first = np.ones(len(pieces), bool)
    first[1:] = whose[1:] != whose[:-1]
    enter = Enter(first, np.tile(m.pi, (len(pieces), 1)), np.zeros((len(pieces), len(m.pi))), np.ones((len(pieces), len(m.pi))))
    long = np.flatnonzero(counts[whose] > 1)
    step = max(1, SIDE_BY_SIDE // size)
    over = np.empty((len(pieces), len(m.pi), len(m.pi)))
    for i in range(0, len(long), step):
        some = long[i : i + step]
        over[some] = Batch([pieces[j] for j in some]).transfer(m, first[some])
    for j in long:
        if not first[j]:
            x = (m.pi if first[j - 1] else enter.came[j - 1]) @ over[j - 1]
            enter.came[j] = x / x.sum()
            enter.start[j] = enter.came[j] @ m.a
    for j in long[::-1]:
        if not first[j]:
            x = over[j] @ enter.end[j]
            enter.end[j - 1] = x / x.sum()
    return pieces, whose, enter


def expected(sequences: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of whole sequences, and their log10-likelihood."""
    pieces, _, enter = in_pieces(sequences, m)
    sums = [np.zeros_like(m.pi), np.zeros_like(m.a), np.zeros_like(m.b), 0.0]
    step = max(1, SIDE_BY_SIDE // PIECE)
    for i in range(0, len(pieces), step):
        sums = [a + b for a, b in zip(sums, Batch(pieces[i : i + step]).expected(m, enter.part(i, i + step)), strict=True)]
    return tuple(sums)


def likelihood(sequences: list[np.ndarray], m: Model) -> np.ndarray:
    """Log10-likelihood of each whole sequence by the scaled forward recursion."""
    pieces, whose, enter = in_pieces(sequences, m)
    step = max(1, SIDE_BY_SIDE // PIECE)
    each = [Batch(pieces[i : i + step]).forward(m, enter.start[i : i + step])[0] for i in range(0, len(pieces), step)]
    return np.bincount(whose, np.concatenate(each), len(sequences)) if each else np.zeros(len(sequences))


def batches_of(sequences: Iterator[np.ndarray], words: int) -> Iterator[list[np.ndarray]]:
    own, n = [], 0
    for s in sequences:
        own.append(s)
        n += len(s)
        if n >= words:
            yield own
            own, n = [], 0
    if own:
        yield own


def first_guess(sequences: list[np.ndarray], share: np.ndarray, states: int = STATES, passes: int = FIRST_PASSES) -> Model:
    """Baum-Welch on a few sequences, from classes' shares disturbed by a fixed seed."""
    rng = np.random.default_rng(7)
    b = (share[:, None] + 1e-12) * rng.gamma(1.0, 1.0, (len(share), states))
    a = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    m = Model(np.full(states, 1 / states), a / a.sum(1, keepdims=True), b / b.sum(0, keepdims=True))
    if not sequences:
        return m
    for _ in range(passes):
        pi, a, b, _ = expected(sequences, m)
        m = Model.from_counts(pi, a, b, share)
    return m


def train_pass(coded: DataFrame, m: Model, share: np.ndarray) -> Model:
    """One Baum-Welch pass: each task adds up expected counts, which are summed by class across tasks."""
    spark, states, n = coded.sparkSession, len(m.pi), len(m.b)
    sent = spark.sparkContext.broadcast(m)  # at most 1 / OWN_SHARE + BUCKETS + 1 classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, a, b, any_ = np.zeros(states), np.zeros((states, states)), np.zeros((n, states)), False
        sequences = (from_planes(x.as_py()) for batch in batches for x in batch.column(0))
        for own in batches_of(sequences, SIDE_BY_SIDE):
            x = expected(own, sent.value)
            pi, a, b, any_ = pi + x[0], a + x[1], b + x[2], True
        if any_:
            used = np.flatnonzero(b.sum(1) > 0)
            table = np.concatenate([b[used], a, pi[None]])
            keys = np.concatenate([used, n + np.arange(states + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(table[:, k]) for k in range(states))], ["key", *(f"s{k}" for k in range(states))])

    columns = [f"s{k}" for k in range(states)]
    got = coded.where("not held_out").select("classes").mapInArrow(run, "key int, " + ", ".join(f"{c} double" for c in columns))
    table = np.zeros((n + states + 1, states))
    for r in got.groupBy("key").agg(*(F.sum(c).alias(c) for c in columns)).collect():  # one row a class at most
        table[r[0]] = r[1:]
    return Model.from_counts(table[-1], table[n : n + states], table[:n], share)


@dataclass
class Words:
    """What the corpus says about words: counts of the frequent ones, own classes, and each class's training tokens and kinds of words."""

    frequent: dict[bytes, int]
    c: np.ndarray
    own: dict[bytes, int]
    mass: np.ndarray
    kinds: np.ndarray
    ends: int
    total: int
    distinct: int

    def __post_init__(self):
        self.classes = len(self.own) + BUCKETS + 1
        self.share = (self.mass + ALPHA) / (self.mass + ALPHA).sum()
        self.within = np.log10(self.mass + ALPHA * (self.kinds + 1))
        self.floor = math.log10(self.total + ALPHA * (self.distinct + 1))

    def of(self, word: bytes) -> int:
        return self.own.get(word, len(self.own) + bucket(word))


def learn_words(counts: DataFrame, ends: int, frequent: int = FREQUENT) -> Words:
    """From (word, c, n); only tables of bounded size are collected."""
    spark = counts.sparkSession
    total, distinct = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = (total or 0) + ends, (distinct or 0) + (ends > 0)
    own = sorted(bytes(r[0]) for r in counts.where(F.col("c") >= max(1.0, OWN_SHARE * total)).select("word").collect())  # at most 1 / OWN_SHARE words
    own = {w: k for k, w in enumerate(own)}
    eighth = F.floor(F.log2("n") * 8)
    room, least = frequent, None
    for r in counts.groupBy(eighth.alias("at")).count().orderBy(F.desc("at")).collect():  # eighths of octaves of counts, from the top while there is room
        if r[1] > room:
            break
        room, least = room - r[1], r[0]
    rows = counts.where(eighth >= least).select("word", "c").collect() if least is not None else []  # at most `frequent` words
    named = spark.createDataFrame(list(own.items()), "word binary, own int")
    ending = F.pmod(F.crc32(F.substring(F.col("word"), -2, 2)), F.lit(BUCKETS)).cast("int") + len(own)
    classed = counts.where("c > 0").join(F.broadcast(named), "word", "left").groupBy(F.coalesce("own", ending).alias("class")).agg(F.sum("c"), F.count("*"))
    mass, kinds = np.zeros(len(own) + BUCKETS + 1), np.zeros(len(own) + BUCKETS + 1)
    for r in classed.collect():  # one row a class at most
        mass[r[0]], kinds[r[0]] = r[1], r[2]
    mass[-1] = ends
    return Words({bytes(r[0]): k for k, r in enumerate(rows)}, np.array([r[1] for r in rows], np.int64), own, mass, kinds, ends, total, distinct)


_LOOKED_UP: dict[str, tuple] = {}


def looked_up(name: str, sent) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words sent, and of the frequent ones (then a rare one) logarithm, being known, and class; made once in a worker, whatever the number of its tasks."""
    if name not in _LOOKED_UP:
        _LOOKED_UP.clear()
        v = sent.value
        _LOOKED_UP[name] = v, np.append(np.log10(v.c + ALPHA), 0.0), np.append(v.c > 0, False), np.array([*map(v.of, v.frequent), 0], np.int64)
    return _LOOKED_UP[name]


_CODED = "doc_id long, held_out boolean, n_words long, known long, log double, less double, classes binary, rare array<binary>"


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """Documents as classes; what frequent words add to the scores, and the rare words, whose counts are to be joined."""
    sent = docs.sparkSession.sparkContext.broadcast(words)  # at most FREQUENT and 1 / OWN_SHARE words
    name, names = uuid.uuid4().hex, [c.split()[0] for c in _CODED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, log, known, klass = looked_up(name, sent)
        get = v.frequent.get
        for b in batches:
            rows = []
            for text in b.column("text"):
                own = split(text)
                x = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                k, seldom = klass[x], np.flatnonzero(x < 0).tolist()
                rare = [own[i] for i in seldom]
                k[seldom] = [v.of(w) for w in rare]
                rows.append((len(own), int(known[x].sum()), float(log[x].sum()), float(v.within[k].sum()), planes(np.append(k, v.classes - 1)), rare))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _CODED)


def prepare(docs: DataFrame, ws: Workspace, frequent: int = FREQUENT) -> tuple[Words, DataFrame, DataFrame]:
    """What is known of words, the coded documents (with _row), and the counts (word, c) of training words."""
    batch_rows(docs.sparkSession, 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    counts = ws.save(count_words(docs), "counts")
    words = learn_words(counts, docs.where("not held_out").count(), frequent)
    coded = ws.save(encode(docs, words).withColumn("_row", F.monotonically_increasing_id()), "coded")
    return words, coded, counts.where("c > 0").select("word", "c")


def train(coded: DataFrame, words: Words, states: int = STATES, passes: int = PASSES) -> Model:
    """First guess on a bounded sample, then Baum-Welch passes over all training documents."""
    rank = F.xxhash64("doc_id")
    some = coded.where(f"not held_out and n_words < {FIRST_WORDS}")
    hashes = [r[0] for r in some.select(rank.alias("h")).orderBy("h").limit(FIRST_ROWS).collect()]
    first = some.where(rank <= hashes[-1]).select(rank.alias("h"), "classes").orderBy("h", "classes").limit(FIRST_ROWS).collect() if hashes else []
    m = first_guess([from_planes(r[1]) for r in first], words.share, states)
    for _ in range(passes):
        m = train_pass(coded, m, words.share)
    return m


def score(docs: DataFrame, states: int = STATES, passes: int = PASSES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole document."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    words, coded, counts = prepare(docs, ws, frequent)
    m = train(coded, words, states, passes)
    sent = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequences = (from_planes(x.as_py()) for x in b.column(1))
            each = [likelihood(s, sent.value) for s in batches_of(sequences, SIDE_BY_SIDE)]
            if each:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(each))], ["_row", "likely"])

    batch_rows(spark, 5000)
    likely = ws.save(coded.select("_row", "classes").mapInArrow(run, "_row long, likely double"), "likely")
    rare = coded.select("_row", F.explode("rare").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("times"))
    found = rare.join(counts, "word").groupBy("_row").agg(F.sum("times").alias("there"), F.sum(F.col("times") * F.log10(F.col("c") + ALPHA)).alias("gain"))
    rows = coded.select("_row", "doc_id", "held_out", "n_words", "known", "log", "less", F.size("rare").alias("rare"))
    rows = rows.join(likely, "_row").join(found, "_row", "left")
    there = F.coalesce("there", F.lit(0))
    logs = F.col("log") + F.coalesce("gain", F.lit(0.0)) + (F.col("rare") - there) * F.log10(F.lit(ALPHA))
    base = logs + F.lit(math.log10(words.ends + ALPHA)) - F.lit(words.floor) * (F.col("n_words") + 1)
    known = F.col("known") + there + int(words.ends > 0)
    return rows.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("likely") + logs - F.col("less")).alias("score"))


def op10(docs: DataFrame) -> DataFrame:
    return score(docs).withColumn("score", F.round("score", 6))
