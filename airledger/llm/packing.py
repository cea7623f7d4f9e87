"""Sequence packing by lexical retrieval: BM25 neighbours of a seed document fill its window."""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, map_texts, ship, stored

WINDOW = 2048
END_ID = 1
#: Documents of a shard of the index and tokens of it, at which the next one begins, and tasks that shards are dealt to
#: at most (a task takes one after the other).
SHARD_DOCS, SHARD_TOKENS, MOST_TASKS = 1024, 16_000_000, 20_000
K1, B = 1.2, 0.75


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizer that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts as little-endian 16-bit numbers: those of the tokenizer, with repeated parts kept.

    The tokenizer drops white space, lower-cases, and splits letters, single digits and other characters from one
    another, each part being encoded alone. So texts of plain Latin characters are split here and each part is encoded
    once. The merges of words are run by tiktoken, which does the same ones several times faster: the vocabulary marks a
    word's last letter, for which an upper-case one stands there. Other texts and parts, words that merge to nothing
    known, and all texts if the first ones come out differently, go to the tokenizer itself.
    """

    _PLAIN = re.compile(r"[\x20-\x26\x28-\x7E\n\t\rÀ-ÖØ-öø-ÿ]*+")
    #: Prose: words, and stops that stand alone.
    _PROSE, _STOPS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ\x20\n.,]*+"), ("..", ",,", ".,", ",.")
    _PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
    _LETTERS = re.compile(r"[a-zß-öø-þ]+")

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("token ids need more than 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What stands for a letter at a word's end; ß has no upper-case letter of as many bytes.
        self.ends = {chr(c): chr(c).upper() for c in (*range(0x61, 0x7B), *range(0xE0, 0xFF)) if c != 0xF7} | {"ß": "×"}
        self.words = self._words()
        self.parts = Known(self._part, most)
        self.checked = 0

    def _words(self):
        import tiktoken

        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        # The last byte of each letter, and that of what stands for it at a word's end.
        last = {a.encode()[-1:]: b.encode()[-1:] for a, b in self.ends.items()}
        letters = {b for a in self.ends for b in a.encode()}
        ranks = {}
        for token, i in self.tokenizer.get_vocab().items():
            raw = bytes(b for b in (shown.get(ch, 0) for ch in token.removesuffix("</w>")))
            if raw and all(b in letters for b in raw):
                if not token.endswith("</w>"):
                    ranks[raw] = i
                elif raw[-1:] in last:
                    ranks[raw[:-1] + last[raw[-1:]]] = i
        return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={}) if b"a" in ranks else None

    def _tokenizer_ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def _part(self, part: str) -> bytes:
        if self.words and self._LETTERS.fullmatch(part):
            ids = self.words.encode_ordinary(part[:-1] + self.ends[part[-1]])
            return struct.pack(f"<{len(ids)}H", *ids)
        return self._tokenizer_ids(part)

    def __call__(self, text: str) -> bytes:
        if self._PROSE.fullmatch(text) and not any(s in text for s in self._STOPS):
            parts = text.lower().replace(".", " . ").replace(",", " , ").split()
        elif self._PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            parts = self._PARTS.findall(text.lower())
        else:
            return self._tokenizer_ids(text)
        ids = b"".join(map(self.parts.__getitem__, parts))
        if self.checked < 20:
            self.checked += 1
            if ids != (right := self._tokenizer_ids(text)):
                self.words = None
                self.parts = Known(self._part)
                self._PLAIN = self._PROSE = re.compile(r"(?!)")
                return right
        return ids


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an array and how often each occurs."""
    own = np.sort(ids)
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[at], np.diff(np.append(at, len(own)))


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ids (binary, little-endian 16-bit), and counts: token ids of each whole text, then end_id.

    Null texts count as empty. counts is null but for a row now and then, which has those of a run of rows: for each
    token the documents that have it, then how many rows and tokens there are (32-bit), so that statistics of all texts
    need no second reading of their ids. Repeated rows are each returned; an empty table gives an empty one; columns that
    aren't kept may have any names.
    """
    path = path or tokenizer_path()

    def make():
        encode, end = Encoder(path), struct.pack("<H", end_id)

        def kernel(texts: list[str]) -> dict:
            ids, df = [encode(t) + end for t in texts], np.zeros(65_538, np.uint32)
            for own in ids:
                seen = np.zeros(65_536, bool)
                seen[np.frombuffer(own, np.uint16)] = True
                df[:65_536] += seen
            df[65_536:] = len(ids), sum(map(len, ids)) // 2
            at = np.flatnonzero(df)
            return {"ids": ids, "counts": [np.stack([at, df[at]]).astype(np.uint32).tobytes(), *[None] * (len(ids) - 1)] if ids else []}

        return kernel

    return map_texts(docs, make, "ids binary, counts binary", keep=keep)


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that have each token, documents, and tokens of all documents, of a table with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65_538, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                at, n = np.frombuffer(counts, np.uint32).reshape(2, -1)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    counted = tokens.select("counts").where("counts IS NOT NULL").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(65_538, np.float64)
    for r in counted:
        total[r["token"]] = r["n"]
    return total[:65_536], int(total[65_536]), int(total[65_537])


#: Tokens that a document is placed by, and documents for each shard that say where shards begin.
PLACED_BY, SAMPLED = 3, 20


def place(ids: bytes, idf: np.ndarray, mean: float) -> tuple[bytes, int]:
    """A lexical key by which documents that share what is typical of them come to lie together, and a hash of the ids.

    The key is the document's tokens of the greatest BM25 weight, the best first, each as its number. The hash puts
    copies next to each other among very many alike.
    """
    import xxhash

    own = np.frombuffer(ids, np.uint16)
    terms, tf = distinct(own)
    weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
    few = np.argpartition(-weight, PLACED_BY)[:PLACED_BY] if len(terms) > PLACED_BY else np.arange(len(terms))
    best = terms[few[np.lexsort((terms[few], -weight[few]))]]
    return best.astype(">u2").tobytes(), xxhash.xxh64_intdigest(ids) >> 1


def with_place(tokens: DataFrame, idf: np.ndarray, mean: float, bounds: list | None = None) -> DataFrame:
    """Adds place and hash, and part: how many of the sorted bounds (place, hash, doc_id) are not beyond a row."""
    held = tokens.sparkSession.sparkContext.broadcast((idf, mean, bounds or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, bounds = held.value
        for batch in batches:
            placed = [place(ids, idf, mean) for ids in batch.column(1).to_pylist()]
            # Null ids come first, as they do where rows are sorted.
            keys = [(p, h, -(2**63) if doc is None else doc) for (p, h), doc in zip(placed, batch.column(0).to_pylist(), strict=True)]
            parts = [bisect_right(bounds, k) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int64()), pa.array(parts, pa.int32())], names=["doc_id", "ids", "place", "hash", "part"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, place binary, hash long, part int")


class Index:
    """A BM25 inverted index of a shard's documents, with idf and mean length of the whole corpus.

    A token that one document in 16 or more has is a column of a dense matrix; the others have postings lists.
    """

    BLOCK = 256

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        pairs, tf = distinct(np.repeat(np.arange(n, dtype=np.uint32) << 16, sizes) | np.concatenate(docs))
        token, owner = (pairs & 0xFFFF).astype(np.int64), (pairs >> 16).astype(np.int64)
        weight = (idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / mean))).astype(np.float32)
        common = np.flatnonzero(np.bincount(token, minlength=65_536) * 16 >= max(n, 64))
        self.column = np.full(65_536, -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = self.column[token] >= 0
        self.dense = np.zeros((len(common), n), np.float32)
        self.dense[self.column[token[dense]], owner[dense]] = weight[dense]
        self.of = np.split(token, np.searchsorted(owner, np.arange(1, n)))
        order = np.argsort(token[~dense], kind="stable")
        self.owner, self.weight = owner[~dense][order], weight[~dense][order]
        self.bounds = np.searchsorted(token[~dense][order], np.arange(65_537))
        self.n = n

    def scores(self, seeds: list[int]) -> np.ndarray:
        """BM25 scores (seeds x documents) for the seeds' distinct tokens."""
        row, token = np.repeat(np.arange(len(seeds)), [len(self.of[s]) for s in seeds]), np.concatenate([self.of[s] for s in seeds])
        column = self.column[token]
        asked = np.zeros((len(seeds), len(self.dense)), np.float32)
        asked[row[column >= 0], column[column >= 0]] = 1
        out = asked @ self.dense
        row, token = row[column < 0], token[column < 0]
        first, count = self.bounds[token], self.bounds[token + 1] - self.bounds[token]
        if total := int(count.sum()):
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)
            out += np.bincount(np.repeat(row * self.n, count) + self.owner[at], self.weight[at], minlength=out.size).reshape(out.shape).astype(np.float32)
        return out


class Neighbours:
    """Unused documents of an index for a seed, best first."""

    def __init__(self, index: Index):
        n = index.n
        self.unused, self.scores = np.ones(n, bool), np.empty((n, n), np.float32)
        for a in range(0, n, index.BLOCK):
            self.scores[a : a + index.BLOCK] = index.scores(list(range(a, min(n, a + index.BLOCK))))

    def of(self, seed: int) -> Iterator[int]:
        """Unused documents, best first, ties by place."""
        own, listed, left = self.scores[seed], 8, np.flatnonzero(self.unused)
        while len(left):
            place = np.argpartition(-own[left], listed - 1)[:listed] if len(left) > listed else np.arange(len(left))
            few, left = left[place], np.delete(left, place)
            for i in few[np.lexsort((few, -own[few]))].tolist():
                if self.unused[i]:
                    yield i
            listed *= 4


def fill(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold all ids of a shard's documents, which are cut freely.

    A seed is what is left of a document that was cut, or else the first unused one. Its sequence takes the best of the
    shard's unused documents, over and over, and cuts one that doesn't fit. Only the last sequences are short: what is
    left is dealt to lengths that are powers of two, so there is no padding.
    """
    near = Neighbours(Index(docs, idf, mean))
    out: list[list[tuple[int, int, int]]] = []
    own: list[tuple[int, int, int]] = []
    room, following = window, 0

    def put(doc: int) -> None:
        nonlocal own, room
        near.unused[doc] = False
        start, n = 0, len(docs[doc])
        while start < n:
            length = min(n - start, room)
            own.append((doc, start, length))
            start, room = start + length, room - length
            if not room:
                out.append(own)
                own, room = [], window

    while True:
        if own:  # what is left of the last document is the seed of the sequence that it begins
            for doc in near.of(own[0][0]):
                full = len(out)
                put(doc)
                if len(out) > full:
                    break
            else:
                break
        else:
            while following < len(docs) and not near.unused[following]:
                following += 1
            if following == len(docs):
                break
            put(following)
    left = sum(p[2] for p in own)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part: list[tuple[int, int, int]] = []
        while room:
            doc, start, length = own.pop(0)
            take = min(length, room)
            part.append((doc, start, take))
            room -= take
            if take < length:
                own.insert(0, (doc, start + take, length - take))
        out.append(part)
    return out


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all docs (doc_id, text), packed into sequences of `window` token ids.

    Returns doc_id, start, length, ids (the piece's, as little-endian 32-bit numbers), doc_tokens, sequence_id and offset;
    a sequence is its pieces' ids by offset. Null texts are packed as the end id alone; null and repeated doc_ids are
    packed row by row; an empty table gives an empty one; other columns may have any names.

    The index is sharded: documents are sorted by a lexical key (with_place) over the whole table and every shard_docs in
    that order, or fewer with shard_tokens tokens, are one BM25 inverted index with the corpus's idf. A seed takes its
    best unused neighbours of its shard, so the work for a document is the same at every size of the table. Each shard
    ends in at most a few short sequences, whose lengths are powers of two, so there is no padding.

    Token ids are written once to the shared folder and dealt out once, by ranges of the key with the row's hash and id,
    so that copies of one document, however many, are spread. The driver holds the tokens' document frequencies and a
    bounded sample of keys.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = stored(tokenize(rows, path, end_id), "tokens")
    df, n, total = document_frequencies(tokens)
    if not n:
        return spark.createDataFrame([], _PIECES)
    mean = max(1.0, total / n)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shards = max(-(-n // shard_docs), -(-total // shard_tokens))
    parts = min(MOST_TASKS, shards)
    # Where parts begin: a sample of rows by their hash, whose keys alone come to the driver.
    chosen = F.shiftrightunsigned(F.xxhash64("doc_id", "ids"), 11) <= int(min(1.0, SAMPLED * parts / n) * 2**53)
    keys = sorted((bytes(r["place"]), r["hash"], -(2**63) if r["doc_id"] is None else r["doc_id"]) for r in with_place(tokens.where(chosen), idf, mean).select("place", "hash", "doc_id").collect()) if parts > 1 else []
    bounds = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    placed = with_place(tokens, idf, mean, bounds)
    dealt = placed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "place", "hash", "doc_id").select("doc_id", "ids")
    held = spark.sparkContext.broadcast((idf, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf, mean = held.value
        number = TaskContext.get().partitionId() << 33
        names: list = []
        own: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            columns: tuple[list, ...] = ([], [], [], [], [], [], [])
            for sequence in fill(own, idf, mean, window):
                offset = 0
                for doc, start, length in sequence:
                    for column, value in zip(columns, (names[doc], start, length, own[doc][start : start + length].astype("<u4").tobytes(), len(own[doc]), number, offset), strict=True):
                        column.append(value)
                    offset += length
                number += 1
            names.clear()
            own.clear()
            kinds = [pa.binary() if i == 3 else pa.int64() for i in range(7)]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _PIECES.split(", ")])
            for a in range(0, made.num_rows, 4096):
                yield made.slice(a, 4096)

        held_tokens = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(doc)
                own.append(np.frombuffer(ids.as_py(), np.uint16))
                held_tokens += len(own[-1])
                if len(own) == shard_docs or held_tokens >= shard_tokens:
                    yield from flush()
                    held_tokens = 0
        if own:
            yield from flush()

    return dealt.mapInArrow(run, _PIECES)
