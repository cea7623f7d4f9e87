"""Toxicity: a linear classifier on hashed words, regularised by counterfactuals with swapped identity terms."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Known, map_texts
from .decontaminate import words

#: Bounds of the sample that the classifier is fitted on: labelled rows, distinct words that one of them teaches
#: (chosen by hash), and sentences of it that are changed.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_PAIRS = 4_000, 4_000, 4
BUCKETS = 1 << 18
#: Share of labelled documents beyond which a feature is too common to be evidence.
MOST_COMMON = 0.3
#: Identity terms of four languages, by groups within which one is exchanged for another. Fixed values.
IDENTITY = tuple(
    tuple(line.split())
    for line in """
women men
woman man
girls boys
girl boy
female male
gay straight lesbian bisexual transgender
gays lesbians
black white asian latino arab
muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists
immigrant citizen refugee foreigner
immigrants citizens refugees foreigners
old young
deaf blind disabled
frauen männer
frau mann
schwule lesben
schwul lesbisch
muslime christen juden
muslimische christliche jüdische
einwanderer flüchtlinge ausländer
behinderte blinde gehörlose
femmes hommes
femme homme
homosexuels lesbiennes
musulmans chrétiens juifs
musulman chrétien juif
musulmane chrétienne juive
immigrés réfugiés étrangers
handicapés aveugles sourds
mujeres hombres
mujer hombre
gays lesbianas
musulmanes cristianos judíos
musulmán cristiano judío
musulmana cristiana judía
inmigrantes refugiados extranjeros
discapacitados ciegos sordos
""".strip().splitlines()
)
#: Terms that mostly mean something else: they count only next to one of the nouns. Fixed values.
AMBIGUOUS = frozenset("old young black white straight blind deaf female male".split())
NOUNS = frozenset("people person persons man men woman women girl girls boy boys community communities folks guy guys child children student students".split())
_GROUP = {t.encode(): g for g, terms in enumerate(IDENTITY) for t in terms}
_AMBIGUOUS, _NOUNS = frozenset(t.encode() for t in AMBIGUOUS), frozenset(t.encode() for t in NOUNS)


def word_features(word: bytes) -> list[int]:
    """Buckets of a word: itself and its beginnings of 4 and 6 letters. Identity terms have only themselves."""
    out = [zlib.crc32(word) % BUCKETS]
    if word not in _GROUP:
        text = word.decode("utf-8", "replace")
        out += [zlib.crc32(f"<{text[:n]}".encode()) % BUCKETS for n in (4, 6) if len(text) >= n]
    return out


def identity_places(tokens: list[bytes]) -> list[int]:
    """Where identity terms are among words; an ambiguous one must stand next to a noun for people."""
    return [i for i, w in enumerate(tokens) if w in _GROUP and (w not in _AMBIGUOUS or any(x in _NOUNS for x in tokens[max(0, i - 1) : i + 2] if x is not w))]


def other_term(word: bytes, turn: int) -> bytes:
    """Another term of a word's group."""
    terms = IDENTITY[_GROUP[word]]
    at = terms.index(word.decode())
    return terms[(at + 1 + turn % (len(terms) - 1)) % len(terms)].encode()


_SENTENCE = re.compile(rb"[^.!?\n]+")


def counterfactuals(text: bytes, most: int = TRAIN_PAIRS) -> list[tuple[list[bytes], list[bytes]]]:
    """(words that go, words that come) when a sentence of a text changes only whom it speaks of; four or so of a text.

    Each occurrence of an identity term is exchanged for another of its group, alone; a word goes only if it occurs
    nowhere else. A text without terms is changed too: a sentence that is chosen by hash mentions a group, and then
    another of the same kind instead, so every labelled text has counterfactuals.
    """
    seed = zlib.crc32(text)
    tokens = words(text)
    out = []
    places = identity_places(tokens)
    counts = {w: tokens.count(w) for w in {tokens[i] for i in places[:64]}}
    for k in sorted(places[:64], key=lambda i: zlib.crc32(b"%d-%d" % (seed, i)))[:most]:
        other = other_term(tokens[k], seed >> 4)
        out.append(([tokens[k]] if counts[tokens[k]] == 1 else [], [other] if other not in tokens else []))
    if not out and (sentences := _SENTENCE.findall(text)):
        present = set(words(sentences[seed % len(sentences)])) | set(tokens)
        terms = IDENTITY[(seed >> 8) % len(IDENTITY)]
        first = terms[(seed >> 16) % len(terms)].encode()
        second = other_term(first, seed >> 20)
        out.append(([], [first] if first not in present else []))
        out.append(([first], [second]))
    return [(a, b) for a, b in out if a or b]


@dataclass
class Classifier:
    """score = sigmoid(bias + the sum of a document's distinct words' weights, a word's being that of its features).

    pairs: how many pairs of a text and its counterfactual the fit has compared.
    """

    weights: np.ndarray
    bias: float
    pairs: int = 0


@dataclass
class Examples:
    """Labelled texts as hashed features, a feature of n distinct words of a text n times; changes by signed features.

    changes: (number of the text, features, +1 for those that come and -1 for those that go) of each counterfactual.
    """

    features: list[np.ndarray] = field(default_factory=list)
    toxic: list[int] = field(default_factory=list)
    changes: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, text: bytes, toxic: int) -> None:
        """Takes one labelled text."""
        self.take(*example(text, Known(word_features)), toxic)

    def take(self, features: np.ndarray, changes: list[np.ndarray], toxic: int) -> None:
        """Takes what example() has made of a labelled text."""
        for c in changes:
            self.changes.append((len(self.toxic), np.abs(c) - 1, np.sign(c)))
        self.features.append(features)
        self.toxic.append(toxic)


def example(text: bytes, known: Known, most_words: int = TRAIN_WORDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features of a text's distinct words, and those of its counterfactuals, 1 added and negative for words that go."""
    distinct = set(words(text))
    if len(distinct) > most_words:
        distinct = set(sorted(distinct, key=lambda w: (zlib.crc32(w), w))[:most_words])
    features = np.array([b for w in distinct for b in known[w]], np.int32)
    signed = [np.array([s * (1 + b) for s, own in ((-1, gone), (1, come)) for w in own for b in word_features(w)], np.int32) for gone, come in counterfactuals(text)]
    return np.sort(features), signed


def fit(examples: Examples, steps: int = 150, rate: float = 0.3, penalty: float = 1.5e-3, pairing: float = 1.0, settled: float = 1e-4) -> Classifier:
    """Logistic regression with an L1 penalty, plus `pairing` times the mean squared change of the logit over all pairs.

    The change is that between a labelled text and its counterfactual, so that identity terms themselves are no
    evidence. Weights move by scaled proximal gradient steps until a round moves none by more than `settled`; both
    classes weigh the same.
    """
    y = np.array(examples.toxic, np.float64)
    model = Classifier(np.zeros(BUCKETS), -3.0)
    if not len(y) or y.min() == y.max():
        model.bias = -3.0 if not len(y) or y.max() < 1 else 3.0
        return model
    flat = np.concatenate(examples.features)
    owner = np.repeat(np.arange(len(y)), [len(f) for f in examples.features])
    first = np.ones(len(flat), bool)  # features of a text are sorted
    first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    present = np.bincount(flat[first], minlength=BUCKETS)
    wanted = (present >= 3) & (present <= MOST_COMMON * len(y))
    changed = np.concatenate([c[1] for c in examples.changes]) if examples.changes else np.zeros(0, np.int64)
    wanted[changed] = True
    used = np.flatnonzero(wanted)
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    inside = place[flat] >= 0
    rows, columns = owner[inside], place[flat[inside]]
    pair = np.repeat(np.arange(len(examples.changes)), [len(c[1]) for c in examples.changes]) if examples.changes else changed
    pair_columns = place[changed]
    sign = np.concatenate([c[2] for c in examples.changes]).astype(np.float64) if examples.changes else np.zeros(0)
    model.pairs = len(examples.changes)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b, moment, b_moment = np.zeros(len(used)), -2.0, np.full(len(used), 1e-4), 1e-4  # a text without evidence is clean

    def gradient(at: np.ndarray, r: np.ndarray, to: np.ndarray, c: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, float]:
        z = np.bincount(r, w[at], minlength=len(y)) + b
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(at, d[r], minlength=len(used)).astype(np.float64)
        if model.pairs:
            change = np.bincount(c, sign * w[to], minlength=model.pairs)
            g += np.bincount(to, 2 * pairing / model.pairs * change[c] * sign, minlength=len(used))
        return g, float(d.sum())

    every = (columns, rows, pair_columns, pair, sign)
    active = np.ones(len(used), bool)
    for turn in range(6):
        # After a few steps over all features, those with a weight are moved on alone; what the end then shows to be
        # needed beside them joins, so that the result is that of all features.
        own, own_pair = active[columns], active[pair_columns]
        part = (columns[own], rows[own], pair_columns[own_pair], pair[own_pair], sign[own_pair]) if turn else every
        for _ in range(steps if turn else 12):
            g, gb = gradient(*part)
            g[~active] = 0
            moment += g * g
            step = rate / np.sqrt(moment)
            new = w - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
            b_moment += gb * gb
            b_step = rate * gb / np.sqrt(b_moment)
            b -= b_step
            moved = max(float(np.abs(new - w).max(initial=0)), abs(b_step))
            w = new
            if moved < settled:
                break
        full, _ = gradient(*every)
        needed = (w != 0) | (np.abs(full) > 1.05 * penalty)
        if turn and not (needed & ~active).any():
            break
        active = needed
    model.weights[used] = w
    model.bias = float(b)
    return model


def learn(docs: DataFrame, labels: DataFrame, where: Column | None = None, train_docs: int = TRAIN_DOCS, pairing: float = 1.0) -> Classifier:
    """A classifier fitted on at most train_docs labelled rows of docs that meet `where`; both classes are drawn from.

    Executors make the features and the counterfactuals of whole texts. Labels with null or other values, and texts that
    are null, are left out; a doc_id that is labelled twice counts as its larger label, and of rows that share a doc_id
    the one whose text has the least hash teaches. Without labels of both classes everything scores alike.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = (marked if where is None else marked.where(where)).withColumn("__h", F.xxhash64("doc_id", F.lit(train_docs)))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    chosen = {}
    if counts:
        most = {1: train_docs // 3, 0: train_docs - train_docs // 3}
        near = {k: int(min(1.0, 1.2 * (most[k] + 20) / n) * 2**53) for k, n in counts.items()}
        keep = F.lit(False)
        for k, bound in near.items():
            keep = keep | ((F.col("toxic") == k) & (F.shiftrightunsigned("__h", 11) <= bound))
        for r in sorted(marked.where(keep).collect(), key=lambda r: (r["__h"], r["doc_id"])):
            if most[r["toxic"]] > 0:
                most[r["toxic"]] -= 1
                chosen[r["doc_id"]] = r["toxic"]
    examples = Examples()
    if chosen:

        def make():
            known = Known(word_features, 100_000)

            def kernel(texts: list[bytes]) -> dict:
                made = [example(t, known) for t in texts]
                return {"features": [f.tobytes() for f, _ in made], "changes": [[c.tolist() for c in cs] for _, cs in made]}

            return kernel

        wanted = docs.sparkSession.createDataFrame(list(chosen.items()), "id long, toxic int")
        # The bound of the sample bounds what is broadcast.
        texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(wanted), "id")
        rows = map_texts(texts, make, "features binary, changes array<array<int>>", keep=("id", "toxic"), as_bytes=True).collect()
        seen = set()
        for r in sorted(rows, key=lambda r: (r["id"], zlib.crc32(r["features"]))):
            if r["id"] not in seen:
                seen.add(r["id"])
                examples.take(np.frombuffer(r["features"], np.int32), [np.array(c, np.int64) for c in r["changes"]], r["toxic"])
    return fit(examples, pairing=pairing)


def score(docs: DataFrame, model: Classifier, keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5) to docs; only the whole text is an input.

    Null texts count as empty, and score what a text without evidence does; repeated rows are each returned; an empty
    table gives an empty one; columns that aren't kept may have any names, kept ones may not be called score or
    predicted.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def make():
        weights, bias = held.value

        known = Known(lambda word: float(weights[word_features(word)].sum()), 300_000)
        get = known.__getitem__

        def one(text: bytes) -> float:
            z = bias + sum(map(get, set(words(text))))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        def kernel(texts: list[bytes]) -> dict:
            made = [one(t) for t in texts]
            return {"score": made, "predicted": [int(s >= 0.5) for s in made]}

        return kernel

    return map_texts(docs, make, "score double, predicted int", keep=keep, as_bytes=True)
