"""Benchmark decontamination by winnowed word k-grams, with hits extended to every shared span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Known, map_texts, ship, stored

WINDOW = 13
GRAM = 5
#: Bits of the filter of benchmark fingerprints that every task holds: 32 for each fingerprint, and so many at most.
#: Beyond that the filter lets more through, which the joins then reject.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27

_SEPARATORS = bytes(b if chr(b).isdigit() or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in (bytes(range(256)).lower()))


def words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, runs of 0-9, a-z and anything beyond ASCII."""
    return text.translate(_SEPARATORS).split()


def word_hashes(tokens: list[bytes], known: Known) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def new_words() -> Known:
    """Hashes of words, kept for those that come again."""
    import xxhash

    return Known(xxhash.xxh64_intdigest)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; none if there are fewer."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of each run of w hashes, all of equal least ones; none if there are fewer than w."""
    n = len(hashes) - w + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least, size = hashes, 1
    while size < w:  # the least of twice as many, then of w
        step = min(size, w - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    chosen = np.zeros(len(hashes), bool)
    for j in range(w):
        chosen[j : j + n] |= hashes[j : j + n] == least
    return np.flatnonzero(chosen)


def _window_hash(tokens: list[bytes]) -> tuple[int, int]:
    """128 bits that name a run of words, as two longs."""
    import xxhash

    digest = xxhash.xxh3_128_digest(b" ".join(tokens))
    return tuple(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))


_BENCH = "name string, n int, a long, b long, print long"


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """name, n, a, b and print for each distinct window of each item.

    A window is `window` words, or all words of an item that has fewer (n says how many); a, b are the 128 bits of its
    words' hash. print is its fingerprint: the least of its k-grams' hashes, which winnowing picks in any text where the
    window occurs; a short item's is the hash of all its words.
    """
    ship(benchmark.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = new_words()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = words(text.as_py())
                n = min(window, len(tokens))
                if not n:
                    continue
                k = gram if n == window else n
                own = grams(word_hashes(tokens, known), k)
                made = {_window_hash(tokens[at : at + n]): own[at : at + n - k + 1].min() for at in range(len(tokens) - n + 1)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(made)), pa.array([n] * len(made), pa.int32()), pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64()), pa.array(np.array(list(made.values()), np.uint64).view(np.int64))],
                    names=["name", "n", "a", "b", "print"],
                )

    return items.mapInArrow(run, _BENCH)


def filter_of(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of all fingerprints of windows, and the lengths of windows that occur.

    Executors set the bits of their fingerprints; what reaches the driver is one filter for each of a few parts.
    """
    lengths, total = [], 0
    for r in windows.groupBy("n").agg(F.count("*").alias("count")).collect():
        lengths.append(r["n"])
        total += r["count"]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, 32 * total - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in windows.select("print").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out, sorted(lengths)


_FOUND = "n_words long, starts array<int>, sizes array<int>, a array<long>, b array<long>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """Adds n_words, spans (word offsets of hit runs) and items (sorted names of items with occurring windows) to docs.

    A window is `window` consecutive words of an item (an item of fewer is one window); a document word inside any
    occurrence of a window is hit. Any shared run of `window` words has a k-gram that winnowing picks in both texts. So
    a document's winnowed k-grams that pass a filter of the benchmark's extend to the windows around them, and only
    those windows (as 128-bit hashes) are joined to the items': what is dealt out follows the hits, not the corpus or
    the benchmark, and a window that very many documents share is a row of each, which the join can split.

    Null texts have no words; null item ids read as `null`; items that share an id count once; repeated rows are each
    returned; either table may be empty; columns that aren't kept may have any names, kept ones may not be called
    n_words, spans or items.
    """
    keep = list(keep)
    if clash := sorted({"n_words", "spans", "items"} & set(keep)):
        raise ValueError(f"columns to keep have the names of results: {', '.join(clash)}")
    windows = stored(item_windows(benchmark, window, gram), "windows")
    bits, lengths = filter_of(windows)
    held = docs.sparkSession.sparkContext.broadcast((bits, lengths))

    def make():
        bits, lengths = held.value
        known, last = new_words(), np.uint64(8 * len(bits) - 1)

        def passes(hashes: np.ndarray) -> np.ndarray:
            at = hashes & last
            return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1

        def kernel(texts: list[bytes]) -> dict:
            out: dict = {"n_words": [], "starts": [], "sizes": [], "a": [], "b": []}
            for t in texts:
                tokens = words(t)
                n = len(tokens)
                found: list[tuple[int, int]] = []
                hashes = word_hashes(tokens, known) if lengths else None
                for size in lengths:
                    if n < size:
                        continue
                    if size < window:
                        found += [(int(p), size) for p in np.flatnonzero(passes(grams(hashes, size)))]
                        continue
                    own, reach = grams(hashes, gram), window - gram + 1
                    at = winnow(own, reach)
                    at = at[passes(own[at])]
                    if len(at):  # a window that occurs begins at most window - k words before one of its fingerprints
                        around = np.zeros(n - window + 2, np.int64)
                        np.add.at(around, np.maximum(at - reach + 1, 0), 1)
                        np.add.at(around, np.minimum(at, n - window) + 1, -1)
                        found += [(int(p), window) for p in np.flatnonzero(np.cumsum(around[:-1]))]
                named = [_window_hash(tokens[p : p + size]) for p, size in found]
                out["n_words"].append(n)
                out["starts"].append([p for p, _ in found])
                out["sizes"].append([size for _, size in found])
                out["a"].append([x for x, _ in named])
                out["b"].append([x for _, x in named])
            return out

        return kernel

    source = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in keep], F.col("text"))
    marked = map_texts(source, make, _FOUND, keep=[f"k_{c}" for c in keep], as_bytes=True)
    rows = stored(marked.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
    zipped = F.arrays_zip("starts", "sizes", "a", "b")
    occurring = rows.where(F.size("starts") > 0).select("__row", F.explode(zipped).alias("w")).select("__row", F.col("w.starts").alias("start"), F.col("w.sizes").alias("n"), "w.a", "w.b")
    # Windows with equal items are one class, named by a digest of those items: documents meet classes, not windows' items.
    digest = lambda c: F.struct(F.count("*").alias("size"), *[F.bit_xor(F.xxhash64(c, F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)])
    named = windows.select("n", "a", "b", "name").distinct()
    classes = named.groupBy("n", "a", "b").agg(digest("name").alias("class"))
    hits = stored(occurring.join(classes, ["n", "a", "b"]), "hits")
    # Hit windows of a document, in order, are one run as long as each begins before what came before it has ended.
    order = Window.partitionBy("__row").orderBy("start", "n")
    ends = hits.select("__row", "start", "n", (F.col("start") + F.col("n")).alias("end"))
    fresh = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = ends.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("__row", "run").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    spans = runs.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # Documents with equal classes have equal items, which are gathered once, from a window of each class.
    met = hits.select("__row", "class").distinct()
    kinds = met.groupBy("__row").agg(digest("class").alias("kind"))
    seen = met.join(kinds.groupBy("kind").agg(F.min("__row").alias("__row")), "__row").select("kind", "class")
    names = classes.groupBy("class").agg(F.min(F.struct("n", "a", "b")).alias("w")).select("class", "w.*").join(named, ["n", "a", "b"]).select("class", "name")
    listed = seen.join(names, "class").groupBy("kind").agg(F.array_sort(F.collect_set("name")).alias("items"))
    items = kinds.join(listed, "kind").select("__row", "items")
    none = "cast(array() AS array<struct<start: bigint, end: bigint>>)"
    out = rows.select("__row", *[f"k_{c}" for c in keep], "n_words").join(spans.join(items, "__row"), "__row", "left")
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "n_words", F.coalesce("spans", F.expr(none)).alias("spans"), F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"))


def judged(found: DataFrame, one_in: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: some word is hit, and at least one in `one_in` words is."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all rows and columns of them kept; null and empty texts are clean.

    Equal texts are judged alike, so rows are told by two 64-bit hashes of their text: texts are read twice and never
    dealt out, unless very many are contaminated.
    """
    marks = [F.xxhash64("text", F.lit(seed)).alias(f"__{seed}") for seed in (1, 2)]
    found = judged(contamination(docs.where("text IS NOT NULL").select("text", *marks), benchmark, keep=["__1", "__2"]))
    bad = stored(found.where("contaminated").select("__1", "__2").distinct(), "contaminated")
    return docs.withColumns({f"__{seed}": F.xxhash64("text", F.lit(seed)) for seed in (1, 2)}).join(bad, ["__1", "__2"], "left_anti").select(*docs.columns)
