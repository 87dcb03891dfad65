"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

Training counts in how many toxic and clean labelled texts a word, and the stems of six and four letters,
occur; where all occurrences stand behind a few words only (copies of one text), the number of such
contexts counts instead. Log-odds under an informative Dirichlet prior, whose mean is the corpus-wide
rate, keep the terms that are significantly toxic. Scoring adds log-odds of such terms and a constant
loss for each other word; one linear scan (Ruzzo and Tompa's) finds all maximal segments. A segment of
score S in a text of n words is expected K n exp(-lambda S) times by chance (Karlin and Altschul);
the excess of -log of that over zero, summed over segments, is mapped to a probability by logistic
regression on the same training texts.

Defined cases: a null or empty text has no segments and the score of such texts; repeated rows and ties
score alike; labels that are null count as absent, repeated labels of one doc_id as their maximum;
with no usable label every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import Workspace, batch_rows, remainder

#: At most so many labelled rows are trained on, those with the least hash of doc_id.
TRAIN_ROWS = 20_000
#: Weight of the Dirichlet prior in texts, least z of a toxic term, assumed share of toxic words in a passage.
PRIOR, LEAST_Z, DENSITY = 10.0, 4.0, 0.3
LOSS = math.log(1 - DENSITY)
STEMS = (6, 4)
WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Log-odds of words and stems, the four-letter heads of all of them, lambda, K, and the logistic curve."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    at: float = -30.0

    def __post_init__(self):
        self.heads = {t[: STEMS[-1]] for t in [*self.terms, *self.stems]}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Places and log-odds of toxic terms; a word right after itself is no new evidence."""
        heads, found, n = self.heads, [], STEMS[-1]
        for i in [i for i, w in enumerate(words) if w[:n] in heads]:
            if i and words[i] == words[i - 1]:
                continue
            s = self.terms.get(words[i])
            for k in STEMS:
                s = self.stems.get(words[i][:k]) if s is None else s
            if s is not None:
                found.append((i, s))
        return found

    def excess(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """Sum over segments of -log of the number expected by chance, where that is under one."""
        return sum(max(0.0, self.lam * s - math.log(self.k * max(n, 1))) for _, _, s in segments)

    def probability(self, excess: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * excess + self.at))))

    def score(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Probability, words, and segments (first word, word after the last, score)."""
        words = WORD.findall((text or "").lower())
        segments = maximal_segments(self.hits(words))
        return self.probability(self.excess(len(words), segments)), len(words), segments


def maximal_segments(hits: list[tuple[int, float]], loss: float = LOSS) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that scores ``loss`` (negative) except at the hits (positive).

    Each candidate keeps the sum before it and at its end; a new hit joins the nearest earlier candidate with a
    smaller sum before it if that doesn't end higher (Ruzzo and Tompa, 1999). Linear in the hits: each candidate
    knows the nearest earlier one with a smaller sum before it, so that the search jumps over those between, which
    no later search needs; where there is none, all candidates so far are closed.
    """
    done: list[tuple[int, int, float]] = []
    out: list[tuple[int, int, float, float, int]] = []  # first place, place after the last, sum before, sum at the end, nearest with a smaller sum before
    total, at = 0.0, 0
    for place, s in hits:
        total += loss * (place - at)
        first, after, low, high = place, place + 1, total, total + s
        total, at = total + s, place + 1
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0:
                done += [(a, b, e - l) for a, b, l, e, _ in out]
                out = [(first, after, low, high, -1)]
                break
            if out[j][3] >= high:
                out.append((first, after, low, high, j))
                break
            first, _, low, _, before = out[j]
            del out[j:]
            j = before
    return done + [(a, b, e - l) for a, b, l, e, _ in out]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word and stem: toxic and clean texts, bit sets of the words before it, and of the words of a stem."""
    found: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        columns = [pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in range(5))]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean", "toxic_after", "clean_after", "forms"])

    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = WORD.findall((text or "").lower())
            own: dict[str, list[int]] = {}
            before = ""
            for w in words:
                bit = 1 << zlib.crc32(before.encode()) % 63
                form = 1 << zlib.crc32(w.encode()) % 63
                for key in (w, *(f"{w[:k]}*" for k in STEMS if len(w) > k)):
                    x = own.get(key)
                    if x is None:
                        own[key] = [bit, form]
                    else:
                        x[0] |= bit
                        x[1] |= form
                before = w
            for key, (bits, forms) in own.items():
                x = found.get(key)
                if x is None:
                    x = found[key] = [0, 0, 0, 0, 0]
                x[0 if label else 1] += 1
                x[2 if label else 3] |= bits
                if label:
                    x[4] |= forms
        if len(found) > 300_000:
            yield flush()
    yield flush()


def _seen(texts: int, bits: int) -> float:
    """Texts, or contexts where these are clearly fewer: linear counting with 63 bits."""
    zero = 63 - bin(bits).count("1")
    return texts if zero < 8 else min(texts, 63 * math.log(63 / zero))


def _signed_root(y1: float, y0: float, n1: int, n0: int) -> float:
    """Root of the likelihood ratio of a term's rates in toxic and clean texts against one rate for both: like a z, but sound for few texts."""
    all_ = y1 + y0
    g = sum(y * math.log(y / (all_ * n / (n1 + n0))) for y, n in ((y1, n1), (y0, n0)) if y > 0)
    return math.sqrt(max(0.0, 2 * g))


def train(docs: DataFrame, labels: DataFrame, use=None, rows: int = TRAIN_ROWS) -> Model:
    """Learns from (doc_id, text) and (doc_id, toxic); ``use`` is a condition on doc_id for the rows to learn from."""
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    ws = Workspace(spark)
    labels = labels.where("doc_id is not null and toxic is not null").where(use if use is not None else F.lit(True))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").selectExpr("text", "cast(toxic as int) toxic")  # at most `rows` labels
    sample = ws.save(sample, "sample")
    n1, n0 = (sample.where(c).count() for c in ("toxic <> 0", "toxic = 0"))
    if not n1 or not n0:
        ws.drop()
        return Model()
    counts = sample.mapInArrow(_counts, "term string, toxic long, clean long, toxic_after long, clean_after long, forms long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *(F.expr(f"bit_or({c})").alias(c) for c in ("toxic_after", "clean_after", "forms")))
    terms, stems = {}, {}
    for r in counts.where("toxic >= 3").collect():  # terms of at most `rows` texts
        y1, y0 = _seen(r.toxic, r.toxic_after), _seen(r.clean, r.clean_after)
        prior = PRIOR * (y1 + y0) / (n1 + n0)
        a, b = y1 + prior, y0 + prior
        odds = math.log(a / max(n1 + PRIOR - a, 0.5)) - math.log(b / max(n0 + PRIOR - b, 0.5))
        if y1 < 3 or odds <= 0.7 or _signed_root(y1, y0, n1, n0) < LEAST_Z:
            continue
        if not r.term.endswith("*"):
            terms[r.term] = odds + LOSS
        elif bin(r.forms).count("1") >= 3:
            stems[r.term[:-1]] = odds + LOSS
    model = Model({t: s for t, s in terms.items() if s > 0}, {t: s for t, s in stems.items() if s > 0})
    return _calibrated(model, sample, ws)


def _calibrated(model: Model, sample: DataFrame, ws: Workspace) -> Model:
    """Fits lambda and K on the clean texts, then the logistic curve on all; the sample is of bounded size."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall((text or "").lower())
                hits = sent.value.hits(words)
                rows.append((label, len(words), [s for _, s in hits], [s for _, _, s in maximal_segments(hits)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["toxic", "n", "hits", "segments"])

    rows = sample.mapInArrow(run, "toxic int, n long, hits array<double>, segments array<double>").collect()
    ws.drop()
    clean = [r for r in rows if not r.toxic]
    n = sum(r.n for r in clean) + 1
    scores = np.array([s for r in clean for s in r.hits] + [s for s in [*model.terms.values(), *model.stems.values()]])
    weight = np.array([1.0] * sum(len(r.hits) for r in clean) + [0.5] * (len(model.terms) + len(model.stems))) / n  # half a chance occurrence of each term
    if not len(scores):
        return model
    low, high = 1e-3, 20.0
    for _ in range(60):  # the positive root of E[exp(lambda s)] = 1
        lam = (low + high) / 2
        with np.errstate(over="ignore"):
            above = (weight * np.exp(lam * scores)).sum() + max(0.0, 1 - weight.sum()) * math.exp(lam * LOSS) > 1
        low, high = (low, lam) if above else (lam, high)
    segments = np.sort([s for r in clean for s in r.segments]) if any(r.segments for r in clean) else np.zeros(0)
    u = float(segments[len(segments) // 2]) if len(segments) else float(scores.min())
    model.lam, model.k = low, ((segments >= u).sum() + 0.5) / n * math.exp(low * u)
    x = np.array([model.excess(r.n, [(0, 0, s) for s in r.segments]) for r in rows])
    y = np.array([float(r.toxic != 0) for r in rows])
    scale = max(x.std(), 1e-9)
    design, w = np.stack([np.minimum(x / scale, 10), np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):  # Newton's method, with a small ridge as the classes may be separable
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
    model.slope, model.at = max(0.0, w[0] / scale), float(w[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_words, n_segments, best_segment of each whole text."""
    batch_rows(docs.sparkSession, 1000)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # terms of at most TRAIN_ROWS texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sent.value.score(t) for t in b.column(1).to_pylist()]
            best = [max((s for _, _, s in r[2]), default=0.0) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array(best, pa.float64())], ["doc_id", "score", "n_words", "n_segments", "best_segment"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, n_words long, n_segments long, best_segment double")


def passages(docs: DataFrame, model: Model, most_expected: float = 0.01) -> DataFrame:
    """Every segment expected less than ``most_expected`` times by chance: doc_id, span in characters, score, expected."""
    batch_rows(docs.sparkSession, 1000)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or ""
                segments = m.score(t)[2]
                spans = [w.span() for w in WORD.finditer(t)] if segments else []
                for a, z, s in segments:
                    e = m.k * len(spans) * math.exp(-m.lam * s)
                    if e < most_expected and z <= len(spans):
                        rows.append((i, spans[a][0], spans[z - 1][1], s, e))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "start", "end", "score", "expected"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, score double, expected double")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores all texts with what the labels outside the held-out fifth teach."""
    model = train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_words", "n_segments", "best_segment")
