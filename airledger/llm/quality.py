"""Quality: heuristic labellers, a label model fitted by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, gathered, map_texts, sample

#: Bound of the sample that the scorer is fitted on; label statistics are of all documents.
TRAIN_DOCS = 6_000
BUCKETS = 1 << 14
#: What expectation-maximisation begins with: the share of good documents, what a labeller votes (poor, unsure, good) on
#: poor and on good ones, and for how many documents of either this counts beside the corpus's own counts.
GOOD, PRIOR, PRIOR_DOCS = 0.85, ((0.3, 0.3, 0.4), (0.01, 0.09, 0.9)), 50
#: The vote of a labeller that a text gives nothing to judge by.
SILENT = 2


@dataclass
class Style:
    """Counts of a text that the labellers judge."""

    words: int
    letters: int
    chars: int
    upper: int
    symbols: int
    distinct: int
    most: int
    runs: int
    bars: int
    stops: int
    marks: int


_STOPS = frozenset(
    form.encode()
    for w in "the and of to in is was for on it with as at by from der die und den von zu das mit de la le et les des en un une que el los se las por con".split()
    for form in (w, w.capitalize(), w.upper(), w + ",", w + ".", w.capitalize() + ",", w.capitalize() + ".")
)
#: Upper-case letters as A, others as a, digits as 0.
_SHAPE = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_DROP_LETTERS = bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80))
_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_SYMBOL = bytes(b for b in range(256) if chr(b) not in "#$%&*<>{}[]\\^~=_|@" or b >= 0x80)


def style(text: bytes) -> tuple[Style, dict]:
    """Style counts of a text in UTF-8, and how many of its words have each shape."""
    tokens = text.split()
    counts = Counter(tokens)
    most = max(counts.values(), default=0)
    by_shape = Counter(text.translate(_SHAPE).split())
    runs = sum(map(eq, tokens, islice(tokens, 1, None)))
    stops = sum(counts[w] for w in counts.keys() & _STOPS)
    return Style(len(tokens), len(text.translate(None, _DROP_LETTERS)), len(text), len(text.translate(None, _UPPER)), len(text.translate(None, _SYMBOL)), len(counts), most, runs, text.count(b" | "), stops, text.count(b"!!")), by_shape


def _shape(shape: bytes) -> tuple[int, ...]:
    """Buckets of a word's shape: of its pattern, length and symbols."""
    s = re.sub(rb"(.)\1+", rb"\1+", shape[:64])[:24]
    names = [b"s=" + s, b"n=%d" % (min(len(shape), 20) // 4)] + [b"c=%c" % c for c in sorted(set(s)) if not chr(c).isalnum()]
    return tuple(zlib.crc32(x) % BUCKETS for x in names)


def _vote(poor: bool, good: bool, judged: bool) -> int:
    return SILENT if not judged else -1 if poor else 1 if good else 0


#: name -> vote: 1 for good, -1 for poor, 0 between them, SILENT for texts too short to judge. They overlap on purpose.
LABELLERS = {
    "few_symbols": lambda s: _vote(s.symbols > 0.06 * s.chars, s.symbols < 0.005 * s.chars, s.chars > 0),
    "no_tables": lambda s: _vote(s.bars > 0.15 * s.words, s.bars == 0, s.words > 5),
    "lower_case": lambda s: _vote(s.upper > 0.4 * s.letters, s.upper < 0.15 * s.letters, s.letters > 20),
    "varied": lambda s: _vote(s.most > 0.25 * s.words, s.most < 0.12 * s.words and s.distinct > 0.15 * s.words, s.words > 30),
    "distinct_words": lambda s: _vote(s.distinct < 0.08 * s.words, s.distinct > 0.15 * s.words, s.words > 60),
    "no_runs": lambda s: _vote(s.runs > 0.1 * s.words, s.runs < 0.02 * s.words, s.words > 20),
    "function_words": lambda s: _vote(s.stops < 0.05 * s.words, s.stops > 0.12 * s.words, s.words > 40),
    "calm": lambda s: _vote(s.marks > 3 and s.marks > 0.05 * s.words, s.marks == 0, s.words > 0),
    "mostly_letters": lambda s: _vote(s.letters < 0.6 * s.chars, s.letters > 0.75 * s.chars, s.words > 5),
    "has_words": lambda s: _vote(s.letters == 0, False, s.letters == 0),
}


def votes(s: Style) -> list[int]:
    """Every labeller's vote on a text."""
    return [f(s) for f in LABELLERS.values()]


@dataclass
class LabelModel:
    """The share of good documents, and how each labeller votes (poor, unsure, good) on poor and on good ones.

    An unsure vote is evidence too; a silent labeller is none.
    """

    good: float
    rates: np.ndarray = field(repr=False)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that documents with these votes are good."""
        if not len(patterns):
            return np.zeros(0)
        weight = np.log(self.rates[1]) - np.log(self.rates[0])
        odds = np.log(self.good / (1 - self.good)) + np.einsum("pmv,mv->p", _cast(patterns), weight)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def _cast(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(np.float64)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Labellers' accuracies by expectation-maximisation over vote patterns and how many documents have each.

    Accuracies and the share of good documents are free: PRIOR counts as PRIOR_DOCS documents, which a corpus of some
    hundreds overrules. The start, by which good is told from poor, is that any vote for poor is likely right. Without
    documents the model is the prior.
    """
    prior = np.array(PRIOR)[:, None, :]
    m = patterns.shape[1] if patterns.ndim == 2 and len(patterns) else len(LABELLERS)
    model = LabelModel(GOOD, np.repeat(prior, m, axis=1))
    if not len(patterns):
        return model
    cast, q = _cast(patterns), np.where((patterns == -1).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        seen = np.stack([np.einsum("p,pmv->mv", w, cast) for w in (counts * (1 - q), counts * q)]) + PRIOR_DOCS * prior
        model.rates = seen / seen.sum(axis=2, keepdims=True)
        model.good = float((counts @ q + PRIOR_DOCS * GOOD) / (counts.sum() + PRIOR_DOCS))
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


def vote_table(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds votes (array of int) of each whole text."""
    return map_texts(docs, lambda: lambda texts: {"votes": [votes(style(t)[0]) for t in texts]}, "votes array<int>", keep=keep, as_bytes=True)


def label_model(docs: DataFrame) -> LabelModel:
    """The label model of all docs: their vote patterns are counted, at most 4 to the number of labellers."""
    rows = vote_table(docs.select("doc_id", "text")).groupBy("votes").count().collect()
    patterns = np.array([r["votes"] for r in rows], np.int64).reshape(-1, len(LABELLERS))
    return fit_label_model(patterns, np.array([r["count"] for r in rows], np.float64))


_REPEAT = [zlib.crc32(f"repeat={i}".encode()) % BUCKETS for i in range(12)]
_FRESH = [zlib.crc32(f"distinct={i}".encode()) % BUCKETS for i in range(11)]
_BIAS = zlib.crc32(b"bias") % BUCKETS


def features(s: Style, by_shape: dict, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: shares of word shapes, and how much it repeats itself."""
    counts: dict[int, float] = {_BIAS: 1.0}
    if s.words:
        for shape, c in by_shape.items():
            for b in known[shape]:
                counts[b] = counts.get(b, 0.0) + c / s.words
        counts[_REPEAT[min(5, int(s.runs / s.words * 20))]] = 1.0
        counts[_FRESH[min(9, int(s.distinct / s.words * 20)) if s.words > 60 else 10]] = 1.0
        counts[_REPEAT[6 + (min(5, int(s.most / s.words * 10)) if s.words > 20 else 0)]] = 1.0
    return np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))


def fit_scorer(made: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 200, rate: float = 0.3, penalty: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer fitted on posterior labels of documents, each (buckets, values)."""
    w = np.zeros(BUCKETS)
    if not made:
        return w
    rows = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
    columns, values = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    moment = np.full(BUCKETS, 1e-8)
    for _ in range(steps):
        z = np.bincount(rows, w[columns] * values, minlength=len(made))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(made)
        g = np.bincount(columns, d[rows] * values, minlength=BUCKETS) + penalty * w
        moment += g * g
        w -= rate * g / np.sqrt(moment)
    return w


@dataclass
class Scorer:
    """What scores documents: the label model it was trained by, and the weights."""

    labels: LabelModel
    weights: np.ndarray


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Scorer:
    """The label model of all docs, and a scorer fitted on the posterior labels of at most train_docs of them.

    Executors make votes and features of whole texts; null texts count as empty. An empty table gives the prior and a
    scorer without weights.
    """
    model = label_model(docs)

    def make():
        known = Known(_shape)

        def kernel(texts: list[bytes]) -> dict:
            styles = [style(t) for t in texts]
            made = [features(*s, known) for s in styles]
            return {"votes": [votes(s) for s, _ in styles], "at": [at.tobytes() for at, _ in made], "x": [x.tobytes() for _, x in made]}

        return kernel

    taken = sample(docs.select("doc_id", "text"), train_docs)
    rows = gathered(map_texts(taken, make, "votes array<int>, at binary, x binary", keep=("__h",), as_bytes=True), train_docs)
    target = model.posterior(np.array([r["votes"] for r in rows], np.int64).reshape(-1, len(LABELLERS)))
    return Scorer(model, fit_scorer([(np.frombuffer(r["at"], np.int64), np.frombuffer(r["x"], np.float64)) for r in rows], target))


def score(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds votes, posterior (the label model's), score (the linear scorer's) and predicted (1, good, from 0.5).

    Whole texts are scored; null texts count as empty, for which a labeller votes poor. Repeated rows are each returned;
    an empty table gives an empty one; columns that aren't kept may have any names, kept ones may not be called votes,
    posterior, score or predicted.
    """
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        fitted, known = held.value, Known(_shape)

        def kernel(texts: list[bytes]) -> dict:
            styles = [style(t) for t in texts]
            v = [votes(s) for s, _ in styles]
            z = np.array([(fitted.weights[at] * x).sum() for at, x in (features(*s, known) for s in styles)])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return {"votes": v, "posterior": fitted.labels.posterior(np.array(v, np.int64)), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return kernel

    return map_texts(docs, make, "votes array<int>, posterior double, score double, predicted int", keep=keep, as_bytes=True)
