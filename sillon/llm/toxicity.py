"""Toxicity by class-conditional Kneser-Ney models of characters in words.

Each word is a sequence of characters between borders. A toxic and an ordinary model give every character a probability
after the characters before it; both discount their own counts and back off to the same shared counts of all labelled
text, themselves smoothed by Kneser-Ney continuation counts of ever shorter contexts. Where a class has no evidence of
its own the shared part decides and the two agree, so rare expressions say nothing, while inflections of a toxic word
share its evidence.

A document is described by its length-normalised log-likelihood difference (toxic minus ordinary, per character), by
the same difference of its strongest expressions, and by its length. A logistic regression, fitted on labelled rows
that the counts leave out, turns these into a score.

Corpus counts cover all labelled training rows: words are counted by class where they are read, and only sums are
shuffled. The model keeps every n-gram, however rare, so what workers receive grows with the distinct n-grams of the
labelled text. Workers hold them as sorted arrays of 64-bit hashes, some 60 bytes each, and score the distinct words
of a block of texts together. The calibration uses at most about ``CALIBRATION_DOCS`` rows of each class.

Cases: a null or empty text has no words and gets the score of an empty text, which the calibration gives; without
training rows of both classes every score is 0; rows without a label are scored but not learned from; repeated rows get
equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bounded_batches, kept, small_or_plain, texts_of
from .pretokens import Cache

ORDER = 6
DISCOUNT = 0.75
#: Labelled rows of each class, at most a quarter of all, that calibrate the score and are left out of the counts.
CALIBRATION_DOCS = 3000
#: Distinct entries that a counting task holds before it hands them on.
FLUSH = 200_000
#: Entries of a scorer's cache of words.
CACHED = 300_000
#: Characters of texts, and words of them, that are scored together.
CHUNK_CHARS, CHUNK_WORDS = 1 << 20, 20_000
#: Longest word that is modelled as one; longer ones are cut into such pieces.
WORD_CHARS = 40
BORDER = "\x00"

_words = re.compile(r"[^\W\d_]{1,%d}" % WORD_CHARS).findall


def ngrams(word: str) -> list[str]:
    """For each character of a word, and its end, the characters before it (as many as the model heeds) and itself."""
    line = f"{BORDER}{word}{BORDER}"
    return [line[max(0, i + 1 - ORDER) : i + 1] for i in range(1, len(line))]


def _flushed(items, names: tuple[str, ...], types: tuple[pa.DataType, ...]):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items, strict=True), types, strict=True)], list(names))


def word_counts(labelled: DataFrame, text: str, toxic: str) -> DataFrame:
    """Columns w, ordinary, toxic: occurrences of each word in labelled text by class."""
    bounded_batches(labelled.sparkSession)
    names, types = ("w", "ordinary", "toxic"), (pa.string(), pa.int64(), pa.int64())

    def rows(counts):
        return [(w, counts[0].get(w, 0), counts[1].get(w, 0)) for w in counts[0].keys() | counts[1].keys()]

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for x, label in zip(texts_of(batch, "x"), batch.column("t").to_pylist(), strict=True):
                counts[label].update(_words(x.lower()))
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield _flushed(rows(counts), names, types)
                counts = (Counter(), Counter())
        if counts[0] or counts[1]:
            yield _flushed(rows(counts), names, types)

    read = labelled.select(F.col(text).alias("x"), F.col(toxic).cast("int").alias("t")).mapInArrow(run, "w string, ordinary long, toxic long")
    return read.groupBy("w").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def ngram_counts(words: DataFrame) -> DataFrame:
    """Columns g, ordinary, toxic: occurrences of each n-gram by class."""
    names, types = ("g", "ordinary", "toxic"), (pa.string(), pa.int64(), pa.int64())

    def run(batches):
        a: Counter = Counter()
        b: Counter = Counter()
        for batch in batches:
            for w, x, y in zip(*(batch.column(c).to_pylist() for c in ("w", "ordinary", "toxic")), strict=True):
                for g in ngrams(w):
                    a[g] += x
                    if y:
                        b[g] += y
            if len(a) > FLUSH:
                yield _flushed([(g, n, b[g]) for g, n in a.items()], names, types)
                a.clear()
                b.clear()
        if a:
            yield _flushed([(g, n, b[g]) for g, n in a.items()], names, types)

    return words.mapInArrow(run, "g string, ordinary long, toxic long").groupBy("g").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


@dataclass
class Counts:
    """N-grams by class as plain arrays, of which workers make a ``Scorer``."""

    grams: str
    ordinary: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Counts:
        return cls("\n".join(rows.column("g").to_pylist()), *(rows.column(c).to_numpy() for c in ("ordinary", "toxic")))


@dataclass
class Model:
    """The broadcast counts, None where there was nothing to learn from, and the calibration."""

    counts: Broadcast | None = None
    weights: tuple[float, ...] = ()
    name: str = ""


#: Multipliers of an n-gram's hash by a character's place from the end.
_PLACES = np.random.RandomState(20240301).randint(0, 1 << 63, ORDER, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _hash(chars: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams of one length, given as rows of code points from the last to the first."""
    out = np.zeros(len(chars), dtype=np.uint64)
    for k in range(chars.shape[1]):
        out += (chars[:, k].astype(np.uint64) + np.uint64(1)) * _PLACES[k]
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Level:
    """N-grams of one length, sorted by hash: occurrences by class and the shared probability of the last character;
    and their contexts: sums and different characters after them, by class and shared."""

    def __init__(self, chars: np.ndarray, shared: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, below: Level | None, lowest: float):
        keys = _hash(chars)
        order = np.argsort(keys)
        self.keys, chars, shared, self.ordinary, self.toxic = (v[order] for v in (keys, chars, shared, ordinary, toxic))
        self.contexts, of = np.unique(_hash(chars[:, 1:]), return_inverse=True)
        sums = [self.ordinary, self.ordinary > 0, self.toxic, self.toxic > 0, shared, np.ones(len(of))]
        self.stats = [np.bincount(of, weights=v, minlength=len(self.contexts)) for v in sums]
        lower = below.probability[_find(below.keys, _hash(chars[:, :-1]))[0]] if below else lowest
        self.probability = (np.maximum(shared - DISCOUNT, 0) + DISCOUNT * self.stats[5][of] * lower) / self.stats[4][of]


class Scorer:
    """Counts ready to score texts."""

    def __init__(self, counts: Counts):
        points = _points(counts.grams + "\n") if counts.grams else np.zeros(0, dtype=np.uint32)
        ends = np.flatnonzero(points == 10)
        lengths = np.diff(ends, prepend=-1) - 1
        # what has nothing before it, words' beginnings and the longest n-grams, counts as often as it occurs; others
        # count by the different characters before them
        parts = []
        above = np.zeros((0, ORDER + 1), dtype=np.uint32)
        for n in range(ORDER, 0, -1):
            own = np.flatnonzero(lengths == n)
            chars = points[ends[own][:, None] - 1 - np.arange(n)]
            x, y = (np.asarray(v, dtype=np.int64)[own] for v in (counts.ordinary, counts.toxic))
            _, first, continued = np.unique(_hash(above[:, :-1]), return_index=True, return_counts=True)
            none = np.zeros(len(first), dtype=np.int64)
            above = np.concatenate((chars, above[first, :-1]))
            parts.append((above, np.concatenate((x + y, continued)), np.concatenate((x, none)), np.concatenate((y, none))))
        self.lowest = 1 / (len(above) + 1)
        #: N-grams by length, from 1.
        self.levels: list[Level] = []
        for part in reversed(parts):
            self.levels.append(Level(*part, self.levels[-1] if self.levels else None, self.lowest))
        self.words: dict[str, float] = {}
        self._shared = Cache(lambda gram: float(self._probabilities(_points(gram)[::-1][None, :])[0]), entries=CACHED)

    def release(self) -> None:
        """Gives up the tables. The cache's function holds on to the scorer, so it wouldn't go by itself."""
        for table in (self.words, self._shared, self.levels):
            table.clear()

    def _probabilities(self, chars: np.ndarray) -> np.ndarray:
        """Kneser-Ney probabilities of n-grams' last characters after the others, from shared counts."""
        if not chars.shape[1]:
            return np.full(len(chars), self.lowest)
        level = self.levels[chars.shape[1] - 1]
        at, known = _find(level.keys, _hash(chars))
        out = level.probability[at] if len(level.keys) else np.zeros(len(chars))
        new = np.flatnonzero(~known)
        if len(new):
            lower = self._probabilities(chars[new, :-1])
            at, known = _find(level.contexts, _hash(chars[new, 1:]))
            if len(level.contexts):
                lower = np.where(known, DISCOUNT * level.stats[5][at] * lower / level.stats[4][at], lower)
            out[new] = lower
        return out

    def _gram_differences(self, chars: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihoods of n-grams' last characters after the others; 0 after an unknown context."""
        level = self.levels[chars.shape[1] - 1]
        out = np.zeros(len(chars))
        context, known = _find(level.contexts, _hash(chars[:, 1:]))
        rows = np.flatnonzero(known)
        if not len(rows):
            return out
        chars, context = chars[rows], context[rows]
        n0, k0, n1, k1 = (v[context] for v in level.stats[:4])
        at, known = _find(level.keys, _hash(chars))
        shared = self._probabilities(chars)
        logs = []
        for counts, n, k in ((level.ordinary, n0, k0), (level.toxic, n1, k1)):
            c = np.where(known, counts[at], 0)
            logs.append(np.log(np.where(n > 0, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * k * shared) / np.maximum(n, 1), shared)))
        out[rows] = logs[1] - logs[0]
        return out

    def differences(self, words: list[str]) -> list[float]:
        """Toxic minus ordinary log-likelihood of each word; every distinct n-gram is looked up once."""
        points = _points(BORDER + BORDER.join(words) + BORDER)  # neighbours share a border
        borders = np.flatnonzero(points == 0)
        lengths = np.diff(borders)
        place = np.arange(1, len(points)) - np.repeat(borders[:-1], lengths)
        values = np.zeros(len(points) - 1)
        for n in range(2, ORDER + 1):
            here = np.flatnonzero(place == n - 1) if n < ORDER else np.flatnonzero(place >= n - 1)
            chars = points[here[:, None] + 1 - np.arange(n)]
            _, first, of = np.unique(_hash(chars), return_index=True, return_inverse=True)
            values[here] = self._gram_differences(chars[first])[of]
        return np.add.reduceat(values, borders[:-1]).tolist()

    def difference(self, word: str) -> float:
        """Toxic minus ordinary log-likelihood of a word."""
        return self.differences([word])[0]

    def _learn(self, lists: list[list[str]]) -> None:
        """Works out what ``words`` lacks of some lists of words."""
        held = self.words
        new = {w for words in lists for w in words if w not in held}
        if len(held) + len(new) > CACHED:
            held.clear()
            new = {w for words in lists for w in words}
        new = list(new)
        for i in range(0, len(new), CHUNK_WORDS):
            part = new[i : i + CHUNK_WORDS]
            held.update(zip(part, self.differences(part), strict=True))

    def features(self, texts: list[str]) -> list[tuple[float, float, float, float]]:
        """For each text: strongest expression, mean of the three strongest, difference a character, log of the number of words."""
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (not size or size + len(texts[to]) <= CHUNK_CHARS):
                size += len(texts[to])
                to += 1
            lists = [_words(x.lower()) for x in texts[at:to]]
            self._learn(lists)
            out += map(self._features, lists)
            at = to
        return out

    def _features(self, words: list[str]) -> tuple[float, float, float, float]:
        if not words:
            return 0.0, 0.0, 0.0, 0.0
        d = list(map(self.words.__getitem__, words))
        top = sorted(set(zip(d, words, strict=True)), reverse=True)[:3] if max(d) > 0 else [(max(d), "")]
        return min(top[0][0], 30.0), min(sum(x for x, _ in top) / 3, 30.0), max(-5.0, min(5.0, sum(d) / (sum(map(len, words)) + len(words)))), math.log1p(len(words))

    def scores(self, texts: list[str], weights: tuple[float, ...]) -> list[float]:
        z = [weights[0] + sum(a * b for a, b in zip(weights[1:], f, strict=True)) for f in self.features(texts)]
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, v)))) for v in z]


def _scorer(shared: Broadcast, name: str) -> Scorer:
    """The scorer of broadcast counts that bear a name."""
    return kept(("toxicity", name), lambda: Scorer(shared.value))


def calibrate(features: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a slight penalty, by Newton steps on scaled features; the classes count as they occur."""
    scale = np.array([5.0, 5.0, 1.0, 3.0])
    x = np.column_stack((np.ones(len(features)), features / scale))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (labels - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return (float(w[0]), *map(float, w[1:] / scale))


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", toxic: str = "toxic") -> Model:
    """Learns from the labelled rows of ``docs`` for which ``learn`` (a condition on ``key``) holds."""
    spark = docs.sparkSession
    marks = labels.filter(F.col(toxic).isin(0, 1) & learn).groupBy(F.col(key).alias("k")).agg(F.max(F.col(toxic).cast("int")).alias("t"))
    sizes = {r.t: r.n for r in marks.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    share = F.create_map(*[F.lit(v) for t, n in sizes.items() for v in (t, min(0.25, CALIBRATION_DOCS / n))])
    marks = marks.withColumn("held", F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / F.lit(1 << 20) < share[F.col("t")])
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("x")).join(small_or_plain(marks), "k")
    counts = Counts.of(ngram_counts(word_counts(known.filter(~F.col("held")), "x", "t")).toArrow())
    shared, name = spark.sparkContext.broadcast(counts), uuid.uuid4().hex

    def run(batch, scorer):
        return {"f": list(map(list, scorer.features(texts_of(batch, "x"))))}

    rows = add_columns(known.filter("held").select("x", "t"), run, "f array<double>", lambda: _scorer(shared, name)).select("f", "t").collect()
    if len({r.t for r in rows}) < 2:  # too few rows for a fit: an expression e^6 times likelier in toxic text decides
        return Model(shared, (-6.0, 1.0, 0.0, 0.0, 0.0), name)
    return Model(shared, calibrate(np.array([r.f for r in rows]), np.array([r.t for r in rows], dtype=float)), name)


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with columns score and predicted, by names that begin with ``prefix``; they replace clashing ones."""
    shared, weights, name = model.counts, model.weights, model.name

    def run(batch, scorer):
        texts = texts_of(batch, text)
        scores = scorer.scores(texts, weights) if scorer else [0.0] * len(texts)
        return {f"{prefix}score": scores, f"{prefix}predicted": [int(s >= 0.5) for s in scores]}

    return add_columns(docs, run, f"{prefix}score double, {prefix}predicted int", lambda: _scorer(shared, name) if shared else None)
