"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, gathered, map_texts, sample, together

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the sample that the field is fitted on: documents that are looked at, those with a finding among them that
#: are used, and the variables of one of them, a stretch that begins at a place chosen by hash.
LOOKED_AT, TRAIN_DOCS, TRAIN_VARIABLES = 30_000, 1_500, 400
#: An added token needs this belief in one kind.
CERTAIN = 0.5

# Patterns fixed by the contract; @ and digit runs are found first, which gives the same leftmost matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches that meet their kind's test, sorted; end is exclusive."""
    good: list[tuple[int, int, str]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            good.append((start, end, "email"))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            good.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            good.append((*m.span(), "card"))
    if "+" in text:
        good += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    good.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return good


_MARKED = re.compile("[0-9@]")
#: A group of neighbouring digit runs, with what stands between the parts of a number in any notation.
_RUN = re.compile("[0-9]+")
_GROUP = re.compile(r"[0-9]++(?:[\x20().\-/]{1,3}[0-9]++)*+")
_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*")
#: What follows a name where an address is spelled out.
_SPELLED_HOST = re.compile(r"\s*[\[({<]?\s*(?:\bat\b|@)\s*[\])}>]?\s*[A-Za-z0-9-]+(?:(?:\.|\s*[\[({]\s*(?:\.|dot)\s*[\])}]\s*|\s+dot\s+)[A-Za-z0-9-]+)+", re.IGNORECASE)
#: Digits that two notations of a number must share at their ends, and the most that a number has with a prefix.
LEAST_SHARED, MOST_DIGITS = 7, 23


@dataclass
class Graph:
    """A document's variables: its findings, and what may say them again, each in its whole length.

    The latter are groups of neighbouring digit runs and names of addresses with what is spelled after them. chain joins
    neighbours, skip joins distant repeated or similar ones. known has the label of a finding, else 0.
    """

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    known: list[int]


BUCKETS = 4_096


def _shape(form: str) -> str:
    return re.sub(r"(.+?)\1+", r"\1+", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "0", form)))) if len(form) < 200 else "long"


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def _name(local: str) -> str:
    """An address's name without marks, or nothing if it is too short or looks like any word."""
    plain = re.sub("[._%+-]", "", local.lower())
    return f"@{plain}" if len(plain) >= 5 and (plain != local.lower() or re.search("[0-9]", plain)) else ""


def _digits(form: str) -> str:
    return re.sub("[^0-9]", "", form)


class _Told:
    """What a document's findings can be told again by: numbers by their digits, hosts by their parts, names."""

    def __init__(self, text: str, base: list[tuple[int, int, str]]):
        self.whole: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        self.parts: dict[tuple[str, ...], int] = {}
        self.names: dict[str, int] = {}
        for i, (a, b, kind) in enumerate(base):
            form = text[a:b]
            if kind == "email":
                if key := _name(form.split("@")[0]):
                    self.names[key] = i
            elif kind == "ip":
                self.parts[tuple(form.split("."))] = i
            else:
                digits = _digits(form).lstrip("0")
                self.whole[digits] = i
                for k in range(len(digits) - LEAST_SHARED + 1):
                    self.ends[digits[k:]] = i
        self.lengths = sorted({len(d) for d in self.whole})

    def number(self, digits: str) -> int | None:
        """The finding that has these digits, or ends in them, or that they end in; zeros before them don't count."""
        own = digits.lstrip("0")
        if len(own) < LEAST_SHARED:
            return None
        if own in self.ends:
            return self.ends[own]
        return next((self.whole[own[-n:]] for n in self.lengths if n < len(own) and own[-n:] in self.whole), None)

    def groups(self, text: str, start: int, end: int) -> list[tuple[int, int, int | None]]:
        """(start, end, finding or None) of a group of digit runs: those runs in a row that tell a finding, as many as do,
        or else the group as it is."""
        runs, out, i = [m.span() for m in _RUN.finditer(text, start, end)], [], 0
        while i < len(runs):
            digits, best = "", None
            for j in range(i, len(runs) if self.whole else min(i + 4, len(runs))):
                digits += text[runs[j][0] : runs[j][1]]
                if len(digits) > MOST_DIGITS:
                    break
                found = self.number(digits) if self.whole else None
                if found is None and j == i + 3:
                    found = self.parts.get(tuple(text[x:y] for x, y in runs[i : j + 1]))
                if found is not None:
                    best = (j, found)
            if best is None:
                i += 1
                continue
            out.append((runs[i][0], runs[best[0]][1], best[1]))
            i = best[0] + 1
        return out or [(start, end, None)]


def graph(text: str, base: list[tuple[int, int, str]]) -> Graph:
    """Variables of a text with these base spans, chain edges between neighbours, and skip edges.

    A finding is one variable. Numbers are compared by all their digits in whatever notation: equal, or one the end of
    the other with LEAST_SHARED digits or more, zeros before them aside; so a short number that is a part of a finding
    tells nothing. Hosts are compared by their four parts, addresses by their names without marks. A variable that tells
    a finding is linked to it and to the last variable before it that tells the same, so n of them have 2n edges at most.
    """
    told = _Told(text, base)
    made = [(a, b, KINDS.index(k) + 1, i) for i, (a, b, k) in enumerate(base)]
    starts, reach, most = [x[0] for x in base], [], 0
    for _, b, _ in base:
        most = max(most, b)
        reach.append(most)
    free = lambda a, b: not (k := bisect_left(starts, b)) or reach[k - 1] <= a
    end = 0
    if told.names:
        for m in _WORD.finditer(text):
            word = m[0].rstrip("._%+-")
            if m.start() < end or not (key := _name(word)) or not free(m.start(), m.start() + len(word)):
                continue
            # A word like a name that tells no finding is a variable too: a field sees that the form alone means nothing.
            end, found = m.start() + len(word), told.names.get(key, -1)
            host = _SPELLED_HOST.match(text, end)
            if host and free(m.start(), host.end()):
                end = host.end()
            if word[0].isalpha() or found >= 0:
                made.append((m.start(), end, 0, found))
    names = sorted(x[:2] for x in made[len(base) :])
    for m in _GROUP.finditer(text):
        for a, b, found in told.groups(text, *m.span()):
            if found is None and len(_digits(text[a:b])) < LEAST_SHARED:  # too short to tell anything in any notation
                continue
            a -= a > 0 and text[a - 1] in "(+"
            k = bisect_left(names, (b, 0))
            if free(a, b) and not (k and names[k - 1][1] > a):
                made.append((a, b, 0, -1 if found is None else found))
    made.sort()
    spans = [x[:2] for x in made]
    features, chain, skip, last = [], [], [], {}
    first = {found: i for i, (_, _, known, found) in reversed(list(enumerate(made))) if known}
    for i, (a, b, known, found) in enumerate(made):
        form = text[a:b]
        shape, word = _shape(form), re.search(r"(\w+)\W*\Z", text[max(0, a - 24) : a])
        names_ = ["bias", f"base={KINDS[known - 1] if known else 'none'}", f"s={shape}", f"n={min(sum(c.isdigit() for c in form), 24)}", f"at={'@' in form}", f"alpha={form[:1].isalpha()}", f"w={word[1].lower() if word else ''}"]
        features.append([_bucket(x) for x in names_])
        if i and 0 <= a - spans[i - 1][1] <= 12:
            chain.append((i - 1, i))
        if found >= 0:
            skip += [tuple(sorted((j, i))) for j in {first[found], last.get(found, first[found])} if j != i]
            last[found] = i
    return Graph(spans, features, chain, list(dict.fromkeys(skip)), [x[2] for x in made])


@dataclass
class Field:
    """Weights: of features by label, of labels of neighbours, and of labels over skip edges. Label 0 is none."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def without_skips(self) -> Field:
        """The same field with skip edges of no weight."""
        return Field(self.unary, self.chain, np.zeros_like(self.skip))


def empty_field() -> Field:
    """A field that knows only that most tokens are no personal data."""
    n = len(KINDS) + 1
    unary = np.zeros((BUCKETS, n))
    unary[_bucket("bias"), 0] = 5.0
    return Field(unary, np.zeros((n, n)), np.zeros((n, n)))


def _broken(found: str, kind: str, r: random.Random) -> str:
    """A finding in a notation that its pattern doesn't match."""
    digits = _digits(found)
    if kind == "email":
        local, _, domain = found.partition("@")
        return r.choice((local, f"{local} (at) {domain}", f"{local} at {domain}"))
    if kind == "phone":
        own = digits[r.choice((0, 0, 1, 2)) :]
        return r.choice((own, f"00{digits}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"{own[:4]} {own[4:]}"))
    if kind == "ip":
        return found.replace(".", r.choice(("-", "(.)")))
    return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _other(found: str, r: random.Random) -> str:
    """Text of the same shape that says something else."""
    return "".join(r.choice("0123456789") if c.isdigit() else r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in found)


def training_text(text: str, seed: int, most: int = 6) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int, int]]]:
    """A text with findings repeated far from where they are: its base spans, and (start, end, label) of what was added.

    Of `most` findings, chosen by the seed, each comes again in a notation that no pattern matches, labelled as what it
    is, between words of the text; twice as many look the same and say something else, and some are no more than a part
    of it. So shape alone says nothing of them, and a field has to learn that labels agree over skip edges.
    """
    r = random.Random(seed)
    base = base_spans(text)
    words = text.split() or ["."]
    parts, marks, at = [text], [], len(text)

    def add(piece: str, label: int) -> None:
        nonlocal at
        before = f" {r.choice(words)} {r.choice(words)} said "
        parts.extend((before, piece, " ,"))
        marks.append((at + len(before), at + len(before) + len(piece), label))
        at += len(before) + len(piece) + 2

    for s, e, kind in r.sample(base, min(most, len(base))):
        found = text[s:e]
        add(_broken(found, kind, r), KINDS.index(kind) + 1)
        for _ in range(2):
            add(_other(_broken(found, kind, r), r), 0)
        if kind == "email":
            add(found.partition("@")[2], 0)
        elif len(digits := _digits(found)) > 4:
            cut = r.randrange(len(digits) - 3)
            add(digits[cut : cut + r.randint(2, 4)], 0)
    parts.append(" .")
    whole = "".join(parts)
    return whole, base_spans(whole), marks


def labels_of(g: Graph, base: list[tuple[int, int, str]], marks: list[tuple[int, int, int]]) -> list[int]:
    """The label of each variable: a finding's kind, what it was added as, else 0."""
    starts = [m[0] for m in marks]
    out = []
    for (a, b), known in zip(g.spans, g.known, strict=True):
        k = bisect_left(starts, b) - 1
        out.append(known or (marks[k][2] if k >= 0 and marks[k][1] > a else 0))
    return out


@dataclass
class Examples:
    """Labelled variables of many documents: rows of features, labels, and edges (from, to, 0 chain or 1 skip)."""

    features: np.ndarray
    labels: np.ndarray
    edges: np.ndarray


def examples_of(text: str, most: int = TRAIN_VARIABLES) -> Examples | None:
    """What a text teaches; of more than `most` variables, a stretch of so many before its end or from a hashed place."""
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    whole, base, marks = training_text(text, seed)
    if not base:
        return None
    g = graph(whole, base)
    y = labels_of(g, base, marks)
    n = len(y)
    first = 0 if n <= most else (seed >> 8) % (n - most + 1)
    inside = lambda i: first <= i < first + most
    edges = [(a - first, b - first, k) for own, k in ((g.chain, 0), (g.skip, 1)) for a, b in own if inside(a) and inside(b)]
    keep = slice(first, first + most)
    return Examples(np.array(g.features[keep], np.int32), np.array(y[keep], np.int8), np.array(edges, np.int32).reshape(-1, 3))


def joined(parts: list[Examples]) -> Examples:
    """Examples of many documents as one."""
    width = len(parts[0].features[0]) if parts else 0
    at = np.cumsum([0, *(len(p.labels) for p in parts)])
    edges = [p.edges + np.array([a, a, 0], np.int32) for p, a in zip(parts, at, strict=False)]
    empty = np.zeros((0, 3), np.int32)
    return Examples(np.concatenate([p.features for p in parts]) if parts else np.zeros((0, width), np.int32), np.concatenate([p.labels for p in parts]) if parts else np.zeros(0, np.int8), np.concatenate(edges) if parts else empty)


def fit(examples: Examples, steps: int = 400, rate: float = 1.0, penalty: float = 1e-5) -> Field:
    """Weights by gradient ascent on the pseudo-likelihood: each label given its neighbours' labels over both edges."""
    n = len(KINDS) + 1
    x, y, e = examples.features, examples.labels.astype(np.int64), examples.edges
    if not len(y) or not y.any():
        return empty_field()
    target = np.zeros((len(y), n))
    target[np.arange(len(y)), y] = 1
    u, c, s = np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros((n, n))
    ch, sk = e[e[:, 2] == 0], e[e[:, 2] == 1]
    moment = [np.full_like(w, 1e-6) for w in (u, c, s)]
    count = lambda to, value, rows: np.stack([np.bincount(to, value[:, j], minlength=rows) for j in range(n)], axis=1)
    for _ in range(steps):
        score = u[x].sum(axis=1)
        for edges, table in ((ch, c), (sk, s)):
            score += count(edges[:, 1], table[y[edges[:, 0]]], len(y)) + count(edges[:, 0], table.T[y[edges[:, 1]]], len(y))
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = target - p
        gu = count(x.ravel(), np.repeat(d, x.shape[1], axis=0), BUCKETS)
        gc, gs = (count(y[q[:, 0]], d[q[:, 1]], n) + count(y[q[:, 1]], d[q[:, 0]], n).T for q in (ch, sk))
        for w, gr, m in zip((u, c, s), (gu, gc, gs), moment, strict=True):
            gr = gr / len(y) - penalty * w
            m += gr * gr
            w += rate * gr / np.sqrt(m)
    return Field(u, c, (s + s.T) / 2)


def beliefs(g: Graph, f: Field, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of each variable by loopy sum-product message passing over chain and skip edges.

    What a pattern has found is evidence: those labels are held, and tell others.
    """
    n = len(KINDS) + 1
    local = f.unary[np.array(g.features)].sum(axis=1)
    known = np.flatnonzero(g.known)
    local[known] = -40.0
    local[known, np.array(g.known)[known]] = 0.0
    edges = [(a, b, f.chain) for a, b in g.chain] + [(a, b, f.skip) for a, b in g.skip]
    if not edges:
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    a, b = np.array([q[0] for q in edges]), np.array([q[1] for q in edges])
    psi = np.exp(np.clip(np.array([q[2] for q in edges]), -20, 20))
    down, up = np.zeros((len(edges), n)), np.zeros((len(edges), n))  # log messages to b, to a
    for _ in range(rounds):
        total = local.copy()
        np.add.at(total, b, down)
        np.add.at(total, a, up)
        new = []
        for source, back, table in ((total[a] - up, down, psi), (total[b] - down, up, psi.transpose(0, 2, 1))):
            w = np.exp(source - source.max(axis=1, keepdims=True))
            m = np.log(np.einsum("ei,eij->ej", w, table) + 1e-300)
            m -= np.logaddexp.reduce(m, axis=1)[:, None]
            new.append(damping * back + (1 - damping) * m)
        down, up = new
    total = local.copy()
    np.add.at(total, b, down)
    np.add.at(total, a, up)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(text: str, f: Field, certain: float = CERTAIN) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: base ones and those that the field adds where no base span is."""
    if not _MARKED.search(text):
        return [], []
    good = base_spans(text)
    if not good:  # without evidence there is nothing for labels to agree with
        return good, good
    g = graph(text, good)
    if len(g.spans) == len(good):
        return good, good
    p = beliefs(g, f)
    label = p.argmax(axis=1)
    sure = (label > 0) & (p[np.arange(len(label)), label] >= certain) & (np.array(g.known) == 0)
    added = [(*g.spans[i], KINDS[label[i] - 1]) for i in np.flatnonzero(sure).tolist()]
    return good, sorted(good + added, key=lambda s: (s[0], KINDS.index(s[2])))


def learn(docs: DataFrame, looked_at: int = LOOKED_AT, train_docs: int = TRAIN_DOCS) -> Field:
    """A field fitted on documents with a finding among a bounded sample of docs, which executors search whole.

    Labels are the patterns' own, and those of findings that training_text repeats. Null and empty texts teach nothing;
    without findings the field is the empty one.
    """

    def kernel(texts: list[str]) -> dict:
        made = [examples_of(t) if _MARKED.search(t) else None for t in texts]
        parts = {k: [None if m is None else getattr(m, k).tobytes() for m in made] for k in ("features", "labels", "edges")}
        return parts

    looked = sample(docs.select("doc_id", "text"), looked_at)
    rows = gathered(map_texts(looked, lambda: kernel, "features binary, labels binary, edges binary", keep=("__h",)).where("labels IS NOT NULL"), train_docs)
    parts = [Examples(np.frombuffer(r["features"], np.int32).reshape(len(r["labels"]), -1), np.frombuffer(r["labels"], np.int8), np.frombuffer(r["edges"], np.int32).reshape(-1, 3)) for r in rows]
    return fit(joined(parts))


_SPANS = "base array<struct<start: long, end: long, kind: string>>, spans array<struct<start: long, end: long, kind: string>>"


def find_pii(docs: DataFrame, field_: Field, keep: tuple[str, ...] | list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Adds base and spans to docs: personal data by the patterns, and with what the field adds; sorted by start.

    Offsets count code points and ends are exclusive. Whole texts are searched, however long; each is one graph, so
    labels agree across a document. Null and empty texts have no spans; repeated rows are each returned; an empty table
    gives an empty one; columns that aren't kept may have any names, kept ones may not be called base or spans.
    """
    held = docs.sparkSession.sparkContext.broadcast(field_)

    def make():
        f = held.value
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

        def kernel(texts: list[str]) -> dict:
            both = [find(t, f) for t in texts]
            return {"base": [as_rows(x[0]) for x in both], "spans": [as_rows(x[1]) for x in both]}

        return kernel

    return map_texts(docs, make, _SPANS, text=text, keep=keep)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field_: Field) -> DataFrame:
    """docs with personal data in text masked and n_chars set anew where the text changed.

    All rows and columns are kept, whatever the columns are called; null and empty texts stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(field_)

    def make():
        f = held.value
        return lambda texts: {"__masked": [mask(t, s) if (s := find(t, f)[1]) else None for t in texts]}

    kept = [f"d_{c}" for c in docs.columns]
    masked = map_texts(apart(docs), make, "__masked string", keep=kept)
    changed = F.col("__masked").isNotNull()
    masked = masked.withColumn("d_text", F.coalesce("__masked", "d_text"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("d_n_chars", F.when(changed, F.length("__masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d_n_chars")))
    return together(masked, docs)
