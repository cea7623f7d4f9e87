"""Language identification by cross-parsing: phrases that suffix automata of labelled text need for a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, map_texts, together

#: Characters of each language that its automaton is made of at most, documents per language that they are taken from,
#: and symbols that a language needs to be told by (or half of what the best-documented one has, where that is less).
TRAIN_CHARS, TRAIN_DOCS, LEAST_SYMBOLS = 16_000, 256, 1_000
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point, a blank for what is no letter."""
    table = np.full(0x110000, 0x20, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            table[cp] = ord(ch.lower()[0])
    return table


@dataclass
class Model:
    """letters: as letter_table. symbols: of each byte of UTF-8 (0 a blank, 1 a byte that no language has).

    bases, table: the automata, which all come from texts of `length` symbols. table[base of a state + symbol] is twice
    the next state's base, plus 1 if a phrase ended, so that matching many documents is an indexed read for each symbol.
    """

    languages: list[str]
    letters: np.ndarray
    symbols: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    length: int


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts exactly the substrings of text; state 0 is its root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def to_letters(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of a text's letters in lower case; each run of anything else is one blank."""
    made = letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(made), bool)
    keep[1:] = (made[1:] != 0x20) | (made[:-1] != 0x20)
    return made[keep]


def to_bytes(letters: np.ndarray) -> np.ndarray:
    """UTF-8 of code points: a letter beyond ASCII is several symbols, so no alphabet is too large to be told apart."""
    return np.frombuffer(letters.tobytes().decode("utf-32-le").encode(), np.uint8)


def train(texts: dict[str, list[str]], train_chars: int = TRAIN_CHARS, least_symbols: int = LEAST_SYMBOLS) -> Model:
    """A model from texts of each language, of which the first train_chars characters are used in turn from each text.

    A longer training text has longer matches for anything, so all automata are made of equally long ones: as long as
    that of the language with least text, languages with less than least_symbols (or half the longest) left out.
    """
    letters, parsed = letter_table(), {}
    for name, own in sorted(texts.items()):
        share, joined = max(1, train_chars // max(1, len(own))), []
        for t in own:
            joined.append(t[:share])
        left = train_chars - sum(map(len, joined))
        for t in own:  # what short texts leave goes to longer ones
            if left <= 0:
                break
            if more := t[share : share + left]:
                joined.append(more)
                left -= len(more)
        parsed[name] = to_bytes(to_letters(" ".join(joined)[: train_chars + len(own)], letters))
    parsed = {k: v for k, v in parsed.items() if (v != 0x20).any()}
    enough = min(least_symbols, max(map(len, parsed.values()), default=0) // 2)
    parsed = {k: v for k, v in parsed.items() if len(v) >= enough}
    length = min(map(len, parsed.values()), default=0)
    used = sorted({b for v in parsed.values() for b in v[:length].tolist()} - {0x20})
    symbols = np.ones(256, np.uint8)
    symbols[0x20] = 0
    symbols[used] = np.arange(2, len(used) + 2)
    width = len(used) + 2
    tables, roots, base = [], [], 0
    for v in parsed.values():
        moves = suffix_automaton(symbols[v[:length]].tolist())
        root = np.full(width, base, np.int64)
        for c, to in moves[0].items():
            root[c] = base + to * width
        own = np.tile(2 * root + 1, (len(moves), 1))  # where no move is, a phrase ends and the symbol begins the next
        for state, by in enumerate(moves):
            for c, to in by.items():
                own[state, c] = 2 * (base + to * width)
        tables.append(own.astype(np.int32).ravel())
        roots.append(base)
        base += len(moves) * width
    return Model(list(parsed), letters, symbols, np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(roots, np.int32), length)


#: Symbols of each text that are laid side by side at once, and matches side by side below which they are made singly.
STEPS, FEW = 1024, 64


def phrases(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases that each whole text (symbols) needs in each language (texts x languages).

    Texts are matched side by side, a symbol of each at a time; when few are left, which are the longest, they go on
    singly from the states they are in. No phrase is cut.
    """
    n, langs = len(texts), len(model.languages)
    order = sorted(range(n), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    state = np.repeat(model.roots[:, None], n, axis=1)
    count = np.zeros((langs, n), np.int64)
    at, active = 0, n
    while active * langs > FEW:
        last = min(at + STEPS, int(sizes[0]))
        grid = np.zeros((last - at, active), np.int32)
        for k in range(active):
            part = texts[order[k]][at:last]
            grid[: len(part), k] = part
        alive = np.searchsorted(-sizes[:active], -np.arange(at, last), side="left")
        for t in range(last - at):
            k = alive[t]
            to = model.table.take(state[:, :k] + grid[t, :k])
            count[:, :k] += to & 1
            state[:, :k] = to >> 1
        at, active = last, int(np.searchsorted(-sizes, -last, side="left"))
    moves = memoryview(model.table)
    for k in range(active):
        rest = texts[order[k]][at:].tolist()
        for lang in range(langs):
            now, ended = int(state[lang, k]), 0
            for symbol in rest:
                to = moves[now + symbol]
                ended += to & 1
                now = to >> 1
            count[lang, k] += ended
    out = np.zeros((n, langs), np.int64)
    out[order] = count.T + 1  # the phrase that the end of a text ends
    return out


def _kernel(model: Model):
    bits = np.log2(max(2, model.length))

    def kernel(texts: list[str]) -> dict:
        lang, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        owner, own, letters = [], [], []
        for i, t in enumerate(texts):
            s = to_letters(t, model.letters)
            if n := int(np.count_nonzero(s != 0x20)):
                owner.append(i)
                letters.append(n)
                own.append(model.symbols[to_bytes(s)])
        if owner and model.languages:
            cost = phrases(own, model)
            best = cost.argmin(axis=1)
            for k, i in enumerate(owner):
                least = cost[k, best[k]]
                others = np.delete(cost[k], best[k])
                lang[i] = model.languages[best[k]]
                score[i] = 1 - least / others.min() if len(others) else 1.0
                rate[i] = least * bits / letters[k]
        return {"lang_pred": lang, "score": score, "bits_per_letter": rate}

    return kernel


def learn(docs: DataFrame, where: Column | None = None, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """A model from the text and lang of docs that meet `where`; rows with null text, lang or doc_id teach nothing.

    The sample is bounded: for each language at most train_docs documents, one for each part of a hash of doc_id, and
    of them train_chars characters. Languages are found by reading all rows' lang; each part's least hash is a grouped
    minimum, so a language with most rows is no hot group. Of rows that share a doc_id the greatest text counts.
    """
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows if where is None else rows.where(where)
    h = F.xxhash64("doc_id")
    least = rows.select("lang", h.alias("h")).groupBy("lang", F.pmod("h", F.lit(train_docs)).alias("part")).agg(F.min("h").alias("h"))
    chosen = sorted({r["h"] for r in least.select("h").collect()})
    texts: dict[str, dict[int, str]] = {}
    if chosen:
        # No more of a text than the sample could use leaves the executors.
        sample = rows.where(h.isin(chosen)).groupBy("lang", h.alias("h")).agg(F.max(F.substring("text", 1, train_chars)).alias("text"))
        for r in sample.toLocalIterator():
            texts.setdefault(r["lang"], {})[r["h"]] = r["text"]
    return train({k: [own[h] for h in sorted(own)] for k, own in texts.items()}, train_chars)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] | list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Adds lang_pred, score and bits_per_letter to docs: only the text is an input.

    A whole text is parsed into the longest phrases that occur in a language's training text, over its letters with each
    run of other characters as one. The language with the fewest phrases wins (the first by name among equals); as all
    training texts are equally long, phrases weigh the same in each. score is 1 less the ratio of the best to the second
    best. Null texts, and texts without a letter, are `und` with score 0; so is everything if nothing could be learned.
    Repeated rows are each returned; an empty table gives an empty one; columns that aren't kept may have any names,
    kept ones may not be called as the results are.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: _kernel(held.value), "lang_pred string, score double, bits_per_letter double", text=text, keep=keep)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents in one of the model's languages, all columns kept; null texts and texts without any letter go."""
    found = identify(apart(docs), model, keep=[f"d_{c}" for c in docs.columns])
    return together(found.where(F.col("lang_pred") != UNKNOWN), docs)
