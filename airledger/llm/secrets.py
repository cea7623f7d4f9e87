"""Secret scans: exact patterns, and a character convolutional network over every other candidate with its context."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _chunks, map_texts, row_hash, ship

KINDS = ("assign", "access", "hex", "other")
#: One text in so many, by hash, is held out: it calibrates the network and sets its threshold; all others teach it.
HELD_OUT = 4
#: Rounds of training, and characters that are enough for passing over all texts once. Smaller tables are passed over 2,
#: 4 or 8 times; a round takes all of them, or one slice of the larger ones.
ROUNDS, ENOUGH = 8, 32_000_000
#: Characters that one task trains on in a round, and that it holds at once unless a single text is longer.
TASK_CHARS, HELD_CHARS = 4_000_000, 2_000_000
#: Share of labelled findings of the calibration part that the threshold must keep.
RECALL = 0.98

# Patterns fixed by the contract, after cheap tests that a match needs to pass.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_ONLY = bytes(b"x"[0] if chr(b) in "0123456789abcdef" else b" "[0] for b in range(256))


def findings(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the patterns' matches, sorted; end is exclusive."""
    out: list[tuple[int, int, str, int]] = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access", m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_ONLY):
        out += [(*m.span(), "hex", m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, sorted; end is exclusive."""
    return [x[:3] for x in findings(text)]


# Symbols of characters. 0 is what lies beyond a text.
SPACE, DIGIT, QUOTE, NAMED, FOREIGN = 1, 2, 13, (14, 15), 24
_OTHER = {"_": 16, "-": 17, ".": 18, "/": 19, "+": 20, "@": 21, "=": NAMED[0], ":": NAMED[1], '"': QUOTE, "'": QUOTE}
SYMBOLS = 26


def _symbol(ch: str) -> int:
    if ch == "\0":
        return 0
    if ch in _OTHER:
        return _OTHER[ch]
    if not ch.isascii():
        return FOREIGN if ch.isalpha() else 25
    if ch.isdigit():
        return DIGIT
    if ch.islower():
        return 3 if ch <= "f" else 4 + (ord(ch) - ord("g")) // 5
    if ch.isupper():
        return 8 if ch <= "F" else 9 + (ord(ch) - ord("G")) // 5
    return SPACE if ch.isspace() else 22


def symbol_table() -> np.ndarray:
    """Symbols of code points below 0x3000; what lies beyond counts as a letter of another script."""
    return np.array([*(_symbol(chr(c)) for c in range(0x3000)), FOREIGN], np.uint8)


#: Characters of context before and after a candidate, and what a filter sees to either side of its place.
LEFT, RIGHT, REACH = 24, 8, 2
GAP = LEFT + RIGHT + 2 * REACH
EMBED, FILTERS, SPAN = 8, 16, 2 * REACH + 1
#: A candidate has so many characters, or so many after a name with = or :.
LEAST, LEAST_NAMED = 8, 6
_LENGTHS = np.array([6, 8, 12, 16, 20, 24, 32, 40, 64])


def symbols_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, GAP zeros before, between and after them, and where each text begins."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = ("\0" * GAP).join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(codes, len(table) - 1)], GAP + np.concatenate(([0], np.cumsum(lengths + GAP)[:-1])) if len(texts) else np.zeros(0, np.int64)


def candidates(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of every run of characters that could carry a value, in the order of their starts.

    Those characters are ASCII letters and digits and _ - . / +; marks at a run's ends (but _ / + at its end) don't
    count, up to two = after it do. A run needs LEAST characters, or LEAST_NAMED after a name and = or :, quotes and
    blanks between. Runs that touch a letter beyond ASCII are parts of words.
    """
    value = ((symbols >= DIGIT) & (symbols < QUOTE)) | ((symbols >= 16) & (symbols <= 20))
    edge = np.flatnonzero(value[1:] != value[:-1]) + 1
    a, b = edge[0::2].copy(), edge[1::2].copy()
    touching = (symbols[a - 1] == FOREIGN) | (symbols[b] == FOREIGN)
    mark_before, mark_after = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
    mark_before[16:21] = True
    mark_after[[17, 18]] = True
    while (move := (a < b) & mark_before[symbols[a]]).any():
        a[move] += 1
    while (move := (a < b) & mark_after[symbols[b - 1]]).any():
        b[move] -= 1
    at = a - 1
    for _ in range(4):
        at = np.where((symbols[at] == QUOTE) | (symbols[at] == SPACE), at - 1, at)
    named = (symbols[at] == NAMED[0]) | (symbols[at] == NAMED[1])
    keep = ~touching & ((b - a >= LEAST) | (named & (b - a >= LEAST_NAMED)))
    a, b = a[keep], b[keep]
    for _ in range(2):
        b = np.where(symbols[b] == NAMED[0], b + 1, b)
    return a, b


@dataclass
class Network:
    """Embedding, one convolution with ReLU, maxima over context before, candidate and context after, a linear output.

    slope and offset calibrate the output, threshold is what a candidate must reach; figures are those of the held-out
    part. An untrained network (no figures) accepts nothing.
    """

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.1
    figures: dict = field(default_factory=dict)

    @property
    def trained(self) -> bool:
        """Whether it was fitted on findings and other candidates."""
        return bool(self.figures)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What two neighbouring symbols, and the last one, add to the filters: the convolution as indexed reads."""
        by = np.einsum("se,jef->jsf", self.embed, self.kernel.reshape(SPAN, EMBED, FILTERS)).astype(np.float32)
        pairs = [(by[j][:, None, :] + by[j + 1][None, :, :]).reshape(-1, FILTERS) for j in (0, 2)]
        return np.stack(pairs), by[4] + self.shift

    def filters(self, symbols: np.ndarray, a: int, b: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Filters at places a to b (exclusive) of symbols, which reach REACH further to either side."""
        s = symbols[a - REACH : b + REACH].astype(np.int32)
        two = s[:-1] * SYMBOLS + s[1:]
        n = b - a
        made = tables[0][0].take(two[:n], axis=0)
        made += tables[0][1].take(two[2 : n + 2], axis=0)
        made += tables[1].take(s[4 : n + 4], axis=0)
        return np.maximum(made, 0, out=made)

    def logits(self, symbols: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """Uncalibrated scores of candidates, whole: filters are computed once for all candidates of a block."""
        tables = self.tables()
        pooled = np.zeros((len(a), 3, FILTERS), np.float32)
        i = 0
        long = np.flatnonzero(b - a > block)  # very long candidates go piece by piece
        while i < len(a):
            if b[i] - a[i] > block:
                k = i + 1
                parts = [(int(a[i]) - LEFT, int(a[i])), (int(a[i]), int(b[i])), (int(b[i]), int(b[i]) + RIGHT)]
                for j, (lo, hi) in enumerate(parts):
                    for p in range(lo, hi, block):
                        np.maximum(pooled[i, j], self.filters(symbols, p, min(p + block, hi), tables).max(axis=0), out=pooled[i, j])
            else:
                k = min([int(np.searchsorted(a, a[i] + block)), *long[np.searchsorted(long, i) :][:1].tolist()])
                first = int(a[i]) - LEFT
                made = self.filters(symbols, first, int(b[i:k].max()) + RIGHT + 1, tables)
                for j, (lo, hi) in enumerate(((a[i:k] - LEFT, a[i:k]), (a[i:k], b[i:k]), (b[i:k], b[i:k] + RIGHT))):
                    pooled[i:k, j] = np.maximum.reduceat(made, np.stack([lo - first, hi - first], axis=1).ravel(), axis=0)[::2]
            i = k
        return self._linear(pooled.reshape(len(a), -1), b - a)

    def _linear(self, pooled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = 3 * FILTERS
        return pooled @ self.out[:n] + self.out[n + np.searchsorted(_LENGTHS, lengths, side="right")] + self.bias

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of uncalibrated scores."""
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def new_network(seed: int = 7) -> Network:
    """An untrained network, which accepts nothing."""
    r = np.random.default_rng(seed)
    f32 = np.float32
    embed = r.normal(0, 0.5, (SYMBOLS, EMBED)).astype(f32)
    embed[0] = 0
    return Network(embed, r.normal(0, 0.25, (SPAN * EMBED, FILTERS)).astype(f32), np.zeros(FILTERS, f32), r.normal(0, 0.2, 3 * FILTERS + len(_LENGTHS) + 1).astype(f32))


#: Characters of a candidate that a training window has room for; longer ones give as many windows as they need.
BODY = 64
WIDTH = REACH + LEFT + BODY + RIGHT + REACH
#: Windows of each label in a training step, and of plain candidates without and with a digit or a mark.
STEP, STEP_PLAIN, STEP_ODD = 8, 256, 64
#: Scores are counted by steps of this size.
BIN = 1 / 64


class Pooled:
    """Maxima of the filters over the three parts of training windows, with what the gradient needs."""

    def __init__(self, net: Network, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None):
        tables = net.tables() if tables is None else tables
        size = x[:, WIDTH]
        w = LEFT + int(size.max()) + RIGHT
        used = np.arange(w) < (LEFT + size + RIGHT)[:, None]
        s = x[:, : w + SPAN - 1]
        self.symbols = [s[:, j : j + w][used] for j in range(SPAN)]
        self.made = tables[0][0].take(self.symbols[0] * SYMBOLS + self.symbols[1], axis=0)
        self.made += tables[0][1].take(self.symbols[2] * SYMBOLS + self.symbols[3], axis=0)
        self.made += tables[1].take(self.symbols[4], axis=0)
        self.lengths = np.stack([np.full_like(size, LEFT), size, np.full_like(size, RIGHT)], axis=1).ravel()
        starts = np.cumsum(self.lengths) - self.lengths
        self.highest = np.maximum.reduceat(self.made, starts, axis=0)
        self.top = np.maximum(self.highest, 0)
        self.logits = net._linear(self.top.reshape(len(x), -1), x[:, WIDTH + 1])

    def gradient(self, net: Network, x: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        """Of all parameters, from the logits' gradients d; equal maxima share theirs."""
        n = 3 * FILTERS
        g_out = np.zeros_like(net.out)
        g_out[:n] = self.top.reshape(len(x), n).T @ d
        np.add.at(g_out, n + np.searchsorted(_LENGTHS, x[:, WIDTH + 1], side="right"), d)
        g_top = (d[:, None] * net.out[None, :n]).ravel()
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        # Maxima that ReLU cuts off have no gradient.
        wanted = np.where(self.highest > 0, self.highest, np.float32(np.inf))
        at = np.flatnonzero(self.made == np.repeat(wanted, self.lengths, axis=0))
        place, of = at // FILTERS, at % FILTERS
        cell = owner[place] * FILTERS + of
        own = g_top[cell] / np.bincount(cell, minlength=len(g_top))[cell]
        by = [np.bincount(s[place] * FILTERS + of, own, SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS) for s in self.symbols]
        kernels = net.kernel.reshape(SPAN, EMBED, FILTERS)
        g_embed = sum(g @ k.T for g, k in zip(by, kernels, strict=True))
        g_embed[0] = 0  # what lies beyond a text stays nothing
        return {"embed": g_embed, "kernel": np.concatenate([net.embed.T @ g for g in by]), "shift": np.bincount(of, own, FILTERS), "out": g_out}


PARAMETERS = ("embed", "kernel", "shift", "out")


class Fit:
    """Adam on a network; its whole state is one vector, so that what several tasks have learned can be averaged."""

    def __init__(self, net: Network, rate: float = 0.01, state: np.ndarray | None = None):
        self.net, self.rate, self.step = net, rate, 0
        self.m = {p: np.zeros(getattr(net, p).shape) for p in PARAMETERS}
        self.v = {p: np.zeros(getattr(net, p).shape) for p in PARAMETERS}
        if state is not None:
            self.step, net.bias, at = int(state[0]), float(state[1]), 2
            for p in PARAMETERS:
                shape, n = getattr(net, p).shape, getattr(net, p).size
                own, self.m[p], self.v[p] = state[at : at + 3 * n].reshape(3, *shape).copy()
                setattr(net, p, own.astype(np.float32))
                at += 3 * n

    def state(self) -> np.ndarray:
        """Steps, bias, and the other parameters with their moments."""
        return np.concatenate([[self.step, self.net.bias], *[np.ravel(a) for p in PARAMETERS for a in (getattr(self.net, p), self.m[p], self.v[p])]]).astype(np.float64)

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step on windows, of which 1 in y are secrets."""
        net = self.net
        pooled = Pooled(net, x)
        d = ((1 / (1 + np.exp(-np.clip(pooled.logits, -30, 30))) - y) * weight).astype(np.float32)
        grads = pooled.gradient(net, x, d)
        self.step += 1
        for p in PARAMETERS:
            g = grads[p] + 1e-4 * getattr(net, p)
            m = self.m[p] = 0.9 * self.m[p] + 0.1 * g
            v = self.v[p] = 0.999 * self.v[p] + 0.001 * g * g
            setattr(net, p, (getattr(net, p) - self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32))
        net.bias -= self.rate * float(d.sum())


def calibrate(net: Network, z: np.ndarray, kinds: np.ndarray, counts: np.ndarray, recall: float = RECALL) -> None:
    """Sets the logistic curve and the threshold by scores of held-out windows, and how many there are of each.

    The threshold is the highest that keeps `recall` of the secrets of every kind that has twenty or more, and of all.
    """
    order = np.argsort(z, kind="stable")
    z, kinds, counts = z[order], kinds[order], counts[order].astype(np.float64)
    t = (kinds > 0).astype(np.float64)
    yes, no = float(counts[t == 1].sum()), float(counts[t == 0].sum())
    smooth = np.where(t == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    a, b, even = 1.0, 0.0, np.where(t == 1, 0.5 / yes, 0.5 / no) * counts
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = (p - smooth) * even
        a -= 0.2 * float((g * z).sum())
        b -= 0.2 * float(g.sum())
    net.slope, net.offset = max(a, 1e-3), b
    p = net.calibrated(z)

    def kept(rows: np.ndarray) -> float:
        below = np.cumsum(counts[rows])
        return float(p[rows][np.searchsorted(below, np.floor((1 - recall) * below[-1]), side="right")])

    often = [k for k in np.unique(kinds[t == 1]) if counts[kinds == k].sum() >= 20]
    net.threshold = min(kept(t == 1), *(kept(kinds == k) for k in often), 1.0)
    share = lambda rows: (float(counts[rows & (p >= net.threshold)].sum() / counts[rows].sum()), int(counts[rows].sum()))
    net.figures = {"recall": share(t == 1)[0], "false_positives": share(t == 0)[0], "by_kind": {LABELS[int(k)]: share(kinds == k) for k in np.unique(kinds)}}


def train(x: np.ndarray, kinds: np.ndarray, documents: np.ndarray | None = None, epochs: int = 8, rate: float = 0.01, recall: float = RECALL, seed: int = 7) -> Network:
    """A network fitted by Adam on labelled windows of three quarters of the documents, calibrated on the others'.

    kinds: of each window, over 0 for a secret (see LABELS). documents: whose window it is (each its own by default), so
    that nothing of a held-out document, in whatever form, is trained on. Without both labels in either part the network
    stays untrained. This is for windows in memory; learn() takes those of a table.
    """
    net = new_network(seed)
    r = np.random.default_rng(seed)
    y = (kinds > 0).astype(np.float32)
    own_documents = np.arange(len(y)) if documents is None else documents
    each = r.permutation(np.unique(own_documents))
    out = np.isin(own_documents, each[: len(each) // HELD_OUT])
    held, own = r.permutation(np.flatnonzero(out)), r.permutation(np.flatnonzero(~out))
    if len(held) < 4 or not len(own) or any(y[part].min() == y[part].max() for part in (held, own)):
        return net
    weight = np.where(y == 1, 0.5 / (y[own] == 1).sum(), 0.5 / (y[own] == 0).sum()) * len(own)
    fit = Fit(net, rate)
    for _ in range(epochs):
        r.shuffle(own)
        for i in range(0, len(own), 128):
            at = own[i : i + 128]
            fit.learn(x[at], y[at], weight[at] / len(at))
    z = np.concatenate([Pooled(net, x[held[i : i + 256]]).logits for i in range(0, len(held), 256)])
    calibrate(net, z, kinds[held], np.ones(len(held)), recall)
    net.figures |= {"findings": int((y == 1).sum()), "others": int((y == 0).sum())}
    return net


#: What a training window is: a secret if over 0.
LABELS = {1: "finding", 2: "letters", 3: "upper hex", 4: "base64", 5: "base32", 6: "prefixed", 7: "named", 0: "other", -1: "capitals", -2: "number", -3: "joined"}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_WORD = re.compile(r"[^\W\d_]{2,32}")
_NAMES = ("client_key", "auth", "bearer", "credential", "private_key", "access", "sas", "signature")


def planted_key(kind: int, r: random.Random) -> str:
    """A random secret of a kind, with the name before it if it has one."""
    of = lambda letters, n: "".join(r.choices(letters, k=n))
    n = r.randrange(16, 49)
    if kind == 2:
        return of(_LETTERS, n)
    if kind == 3:
        return of("0123456789ABCDEF", n)
    if kind == 4:
        return of(_LETTERS + "+/", n) + "=" * r.randrange(3)
    if kind == 5:
        return of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", n)
    if kind == 6:
        return of("abcdefghijklmnopqrstuvwxyz", r.randrange(2, 5)) + r.choice("_-") + of(_LETTERS, n)
    return f"{r.choice(_NAMES)}{r.choice((' = ', '=', ': ', ' '))}{of(_LETTERS, r.randrange(12, 33))}"


def planted_other(kind: int, text: str, r: random.Random) -> str:
    """Something of a kind that is no secret, though it has capitals, digits or marks; its words are of the text."""

    def some(least: int, most: int) -> list[str]:
        out = []
        for _ in range(r.randrange(least, most)):
            start = text.rfind(" ", 0, r.randrange(len(text))) + 1
            out.append((_WORD.search(text, start, start + 200) or _WORD.search(text))[0])
        return out

    number = lambda: str(r.randrange(10 ** r.randrange(2, 7)))
    form = r.randrange(4)
    if kind == -1:
        return r.choice(("_", "-", "")).join(some(1, 4)).upper() if form % 2 else "".join(r.choices(_LETTERS[:26], k=r.randrange(8, 25)))
    if kind == -2:
        return r.choice(("-", "/", ".", "", "_")).join(number() for _ in range(r.randrange(2, 6)))
    if form == 0:
        return "".join(w.capitalize() for w in some(2, 5))
    if form == 1:
        return f"{some(1, 2)[0].upper()}-{number()}"
    joined = r.choice("_-/.").join(some(2, 5))
    return joined if form == 2 else f"{joined}{r.choice(('-', '_', ''))}{number()}"


def planted(text: str) -> list[tuple[int, str, int, str]]:
    """(kind, text before, where the planted thing ends, all of it) of one thing of each kind, between words of text."""
    if not _WORD.search(text):
        return []
    r, out = random.Random(zlib.crc32(text.encode("utf-8", "replace"))), []
    for kind in LABELS:
        if kind > 1 or kind < 0:
            place = text.find(" ", r.randrange(len(text)))
            before, after = (text[max(0, place - 2 * LEFT) : place + 1], text[place : place + 2 * RIGHT]) if place >= 0 else ("", "")
            said = planted_key(kind, r) if kind > 0 else planted_other(kind, text, r)
            out.append((kind, before, len(before) + len(said), before + said + after))
    return out


@dataclass
class Examples:
    """Every training window of some texts: where it is in their symbols, what it is (LABELS), and whose.

    odd: whether its candidate has a digit or a mark. blank: whether the context counts as nothing.
    """

    symbols: np.ndarray
    first: np.ndarray
    last: np.ndarray
    whole: np.ndarray
    kinds: np.ndarray
    odd: np.ndarray
    blank: np.ndarray

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Windows: context before, the candidate or its part, context after; then lengths of the part and of all."""
        a, size, place = self.first[at], self.last[at] - self.first[at], np.arange(WIDTH)
        low = np.where(self.blank[at], REACH + LEFT, 0)
        high = REACH + LEFT + size + np.where(self.blank[at], 0, RIGHT + REACH)
        inside = (place >= low[:, None]) & (place < high[:, None])
        x = np.zeros((len(a), WIDTH + 2), np.int32)
        x[:, :WIDTH] = self.symbols.take(a[:, None] + (place - LEFT - REACH), mode="clip") * inside
        x[:, WIDTH], x[:, WIDTH + 1] = size, self.whole[at]
        return x


def examples(texts: list[str], table: np.ndarray) -> Examples:
    """All training windows of whole texts.

    Every finding and every other candidate gives one (or, beyond BODY characters, one for each part); a finding is given
    as it is, and with the context blanked. Between words of a text stand random keys of each kind of secret, and things
    of each kind that is none: keys of every alphabet stand in the prose that other candidates stand in, so context alone
    tells nothing.
    """
    placed = [p for t in texts for p in planted(t)]
    symbols, starts = symbols_of([*texts, *[p[3] for p in placed]], table)
    a, b = candidates(symbols)
    kinds, odd = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    if len(a):
        odd = np.add.reduceat((symbols == DIGIT) | ((symbols >= 16) & (symbols <= 20)), np.stack([a, b], axis=1).ravel())[::2] > 0
    name, use = np.zeros(len(a), bool), np.ones(len(a), bool)
    found = np.array([(o + s, o + e, o + v) for t, o in zip(texts, starts.tolist(), strict=False) for s, e, _, v in findings(t)], np.int64).reshape(-1, 3)
    end = np.searchsorted(a, found[:, 1])
    for of, begin in ((name, found[:, 0]), (kinds, found[:, 2])):
        for i, k in zip(np.searchsorted(b, begin, side="right").tolist(), end.tolist(), strict=True):
            of[i:k] = 1
    use &= ~name | (kinds == 1)  # a finding's name is neither
    if placed:
        n = len(texts)
        tail = int(np.searchsorted(a, starts[n]))
        use[tail:] = False
        owner = np.searchsorted(starts[n:], a[tail:], side="right") - 1
        ends = starts[n:][owner] + np.array([p[2] for p in placed])[owner]
        hit = np.flatnonzero((b[tail:] > ends - 4) & (a[tail:] < ends) & (b[tail:] - a[tail:] < 4 * BODY))
        whose, first = np.unique(owner[hit], return_index=True)
        use[tail + hit[first]] = True
        kinds[tail + hit[first]] = np.array([p[0] for p in placed])[whose]
    at = np.flatnonzero(use)
    at = np.concatenate([at, at[kinds[at] == 1]])
    blank = np.arange(len(at)) >= use.sum()
    parts = -(-(b[at] - a[at]) // BODY)
    of = np.repeat(np.arange(len(at)), parts)
    first = a[at][of] + BODY * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    return Examples(symbols, first, np.minimum(first + BODY, b[at][of]), (b - a)[at][of], kinds[at][of], odd[at][of], blank[of])


def labelled(text: str, table: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """All training windows of a whole text, and what each is (LABELS)."""
    made = examples([text], table)
    return list(made.rows(np.arange(len(made.kinds)))), made.kinds.tolist()


def learn_from(fit: Fit, made: Examples, seed: int) -> None:
    """Takes every window of made at least once, in steps in which both labels weigh the same.

    A step has so many windows of each label (STEP) and of plain candidates (STEP_PLAIN, STEP_ODD), so the rare ones come
    again until the last of the most frequent has been taken.
    """
    r = np.random.default_rng(seed)
    plain = made.kinds == 0
    groups = [(plain & ~made.odd, STEP_PLAIN), (plain & made.odd, STEP_ODD), *[(made.kinds == k, STEP) for k in LABELS if k]]
    lots = [(r.permutation(own), n) for of, n in groups if len(own := np.flatnonzero(of))]
    steps = max((-(-len(own) // n) for own, n in lots), default=0)
    dealt = [np.resize(own, (steps, n)) if len(own) * 2 > n else np.tile(own, (steps, 1)) for own, n in lots]
    for i in range(steps):
        at = np.concatenate([d[i] for d in dealt])
        y = (made.kinds[at] > 0).astype(np.float32)
        yes = max(1.0, float(y.sum()))
        fit.learn(made.rows(at), y, np.where(y == 1, 0.5 / yes, 0.5 / max(1.0, len(y) - float(y.sum()))))


def _held(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[Examples]:
    for batch in batches:
        texts = batch.column(0)
        for a, b in _chunks(pc.binary_length(texts).to_pylist(), HELD_CHARS):
            yield examples(texts.slice(a, b - a).to_pylist(), table)


def learn(docs: DataFrame) -> Network:
    """A network fitted on every labelled candidate of every text of docs, which executors take from whole texts.

    One text in HELD_OUT, by hash, is held out, so that equal texts are on one side. The others teach, in ROUNDS: tasks
    take as many characters each, go on from what the round before has made, and what they learn is averaged by their
    windows. In large tables a round takes its own slice of the texts, so all are passed over once; smaller ones are
    passed over again. All held-out windows are scored, and counted by label and score, for calibration and threshold.
    The result doesn't depend on how rows lie. Null texts give nothing; without findings, or without other candidates,
    the network is untrained.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where("text IS NOT NULL").select("text", row_hash(7).alias("__h"), (F.pmod(F.xxhash64("text", F.lit(7)), F.lit(HELD_OUT)) == 0).alias("__out"))
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    net = new_network()
    if not chars:
        return net
    passes = next(p for p in (1, 2, 4, ROUNDS) if p * chars >= ENOUGH or p == ROUNDS)
    slices = ROUNDS // passes
    tasks = -(-chars // (slices * TASK_CHARS))
    state, counts = Fit(net).state(), np.zeros(len(LABELS), np.int64)
    labels = list(LABELS)
    for turn in range(ROUNDS):
        now = texts.where(~F.col("__out") & (F.pmod(F.col("__h"), F.lit(slices)) == turn % slices))
        now = now.repartition(tasks, F.hash("__h")).sortWithinPartitions("__h", F.xxhash64("text")).select("text")
        held, rate = spark.sparkContext.broadcast(state), 0.01 * (1 - turn / ROUNDS)

        def teach(batches, held=held, rate=rate, turn=turn):
            fit, table, seen = Fit(new_network(), rate, held.value), symbol_table(), np.zeros(len(LABELS), np.int64)
            for made in _held(batches, table):
                learn_from(fit, made, turn)
                seen += [int((made.kinds == k).sum()) for k in labels]
            if seen.sum():
                yield pa.RecordBatch.from_pydict({"state": pa.array([fit.state().tobytes()]), "seen": pa.array([seen.tolist()], pa.list_(pa.int64()))})

        made = now.mapInArrow(teach, "state binary, seen array<long>").collect()
        if made:
            weights = np.array([sum(x["seen"]) for x in made], np.float64)
            state = weights @ np.stack([np.frombuffer(x["state"]) for x in made]) / weights.sum()
        if turn < slices:
            counts += np.array([x["seen"] for x in made], np.int64).reshape(-1, len(labels)).sum(axis=0)
    net = Fit(net, state=state).net
    held = spark.sparkContext.broadcast(net)

    def judge(batches):
        net, table = held.value, symbol_table()
        tables = net.tables()
        for made in _held(batches, table):
            z = [Pooled(net, made.rows(np.arange(i, min(i + 1024, len(made.kinds)))), tables).logits for i in range(0, len(made.kinds), 1024)]
            if z:
                both, n = np.unique(np.stack([made.kinds, np.floor(np.concatenate(z) / BIN).astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_pydict({"kind": both[0], "score": both[1], "n": n})

    scored = texts.where("__out").select("text").mapInArrow(judge, "kind long, score long, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).orderBy("kind", "score").collect()
    kinds, z, n = (np.array([x[c] for x in scored], np.int64) for c in ("kind", "score", "n"))
    taught = dict(zip(labels, counts.tolist(), strict=False))
    yes, no = (sum(v for k, v in taught.items() if (k > 0) == of) for of in (True, False))
    if not (taught[1] or (kinds == 1).any()) or not (yes and no and (kinds > 0).any() and (kinds <= 0).any()):
        return new_network()
    calibrate(net, z * BIN, kinds, n)
    net.figures |= {"findings": yes + int(n[kinds > 0].sum()), "others": no + int(n[kinds <= 0].sum()), "taught": {LABELS[k]: v for k, v in taught.items()}}
    return net


_SPANS = "base array<struct<start: long, end: long, kind: string>>, spans array<struct<start: long, end: long, kind: string>>"


def scan(texts: list[str], net: Network, table: np.ndarray) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans: base ones and candidates apart from them that the network accepts."""
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if net.trained and texts:
        symbols, starts = symbols_of(texts, table)
        a, b = candidates(symbols)
        taken = [(s + o, e + o) for marks, o in zip(base, starts.tolist(), strict=True) for s, e, _ in marks]
        if taken and len(a):
            lo = np.array([t[0] for t in taken])
            reach = np.maximum.accumulate([t[1] for t in taken])
            before = np.searchsorted(lo, b)  # base spans that begin before the candidate ends
            free = (before == 0) | (reach[np.maximum(before, 1) - 1] <= a)
            a, b = a[free], b[free]
        if len(a):
            good = np.flatnonzero(net.calibrated(net.logits(symbols, a, b)) >= net.threshold)
            owner = np.searchsorted(starts, a[good], side="right") - 1
            for i, k in zip(owner.tolist(), good.tolist(), strict=True):
                added[i].append((int(a[k] - starts[i]), int(b[k] - starts[i]), "other"))
    return [(b, sorted([*b, *x], key=lambda s: (s[0], KINDS.index(s[2])))) for b, x in zip(base, added, strict=True)]


def find_secrets(docs: DataFrame, net: Network, keep: tuple[str, ...] | list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Adds base and spans to docs: secrets by the patterns, and with every candidate that the network accepts.

    Added spans are of kind `other` and never overlap base ones. Offsets count code points, ends are exclusive. Whole
    texts are scanned and every candidate is scored over its whole length, however long. Null and empty texts have no
    spans; repeated rows are each returned; an empty table gives an empty one; columns that aren't kept may have any
    names, kept ones may not be called base or spans.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net, table = held.value, symbol_table()
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

        def kernel(texts: list[str]) -> dict:
            both = scan(texts, net, table)
            return {"base": [as_rows(b) for b, _ in both], "spans": [as_rows(s) for _, s in both]}

        return kernel

    return map_texts(docs, make, _SPANS, text=text, keep=keep)
