"""SpotSigs document fingerprints: chains of content words that follow common-word anchors, compared by Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Known, map_texts, ship, stored
from .components import connected_components
from .decontaminate import words

#: Common words of English, German, French and Spanish that begin a signature. Fixed values.
ANCHORS = (
    "a an and are as at be by for from had has have he in is it of on or that the this to was were which with "
    "auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "au avec ce dans de du elle en est et il la le les ne pas par plus pour que qui sur un une "
    "al como con del el las lo los más no para por se su una y"
).split()
#: Signatures that a text needs to be linked by them.
LEAST_SIGNATURES = 10
#: Content words of a signature's chain; rows of a range of doc_ids, and ranges at most, beyond which they get longer.
CHAIN, RANGE_ROWS, MOST_RANGES = 2, 2_000, 20_000


def hashed(text_words: list[bytes], known: Known) -> np.ndarray:
    """The sorted distinct signatures (32-bit hashes) of a text's words; known is word_hashes()."""
    import xxhash

    n = len(text_words)
    if not n:
        return np.zeros(1, np.uint32)
    h = np.fromiter(map(known.__getitem__, text_words), np.uint64, n)
    anchor = (h & np.uint64(1)).astype(bool)
    content = h[~anchor]
    at = np.flatnonzero(anchor)
    first = at - np.arange(len(at))  # content words before the anchor
    whole = first + CHAIN <= len(content)
    at, first = at[whole], first[whole]
    if not len(at):
        return np.array([xxhash.xxh32_intdigest(b" ".join(text_words))], np.uint32)
    mixed = h[at]
    for j in range(CHAIN):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + content[first + j]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def word_hashes() -> Known:
    """Hashes of words, the lowest bit set for anchors."""
    import xxhash

    anchors = frozenset(w.encode() for w in ANCHORS)
    return Known(lambda w: (xxhash.xxh64_intdigest(w) & ~1) | (w in anchors))


def signatures(text: bytes, known: Known | None = None):
    """The sorted distinct signatures (32-bit hashes) of a text in UTF-8.

    A signature is an anchor and the next CHAIN words that are no anchors. A text without a whole signature has one of
    all its words, and a text without words the signature 0, so that only equal word sequences agree there.
    """
    return hashed(words(text), word_hashes() if known is None else known)


def encode(signatures_: np.ndarray) -> str:
    """A fingerprint: eight lowercase hex digits for each signature, in order."""
    return signatures_.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two sets of signatures; 0 if their sizes alone keep it below `least`."""
    small, large = sorted((len(a), len(b)))
    if small < least * large or not small:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds signatures (array of long) of each whole text; null texts count as empty."""

    def make():
        known = word_hashes()
        return lambda texts: {"signatures": [hashed(words(t), known).astype(np.int64) for t in texts]}

    return map_texts(docs, make, "signatures array<long>", keep=keep, as_bytes=True)


def offers(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Of classes (key, signatures): key, n and shared, the signatures that other classes have too; and what is offered.

    Offered are (s, part, key, n, at), at being s's place in the order from the rarest on: a class's rarest signatures, by counts over all classes, as many as any partner must
    share one of (the prefix filter), so a common signature is no hot key; those that nobody else has take their places
    in it but lead nowhere. Classes are partitioned by set length: bounds of parts grow by 1/least, so a partner's part
    is the same or the next, and a class offers in both.
    """
    flat = classes.select("key", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    counts = flat.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = F.array_sort(F.collect_list(F.struct("df", "s")))
    sets = stored(flat.join(counts, "s").groupBy("key", "n").agg(ranked.alias("r")).select("key", "n", F.col("r.s").alias("shared")), "sets")
    part = F.floor(F.log("n") / F.lit(-float(np.log(least)))) if least < 1 else F.col("n")
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    rare = F.slice("shared", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))
    parts = F.array(part.cast("long"), part.cast("long") + 1) if least < 1 else F.array(part.cast("long"))
    placed = sets.select("key", "n", F.posexplode(rare).alias("at", "s"), parts.alias("parts"), (F.col("n") - F.size("shared")).alias("alone"))
    return sets, placed.select("key", "n", "s", (F.col("alone") + F.col("at")).alias("at"), F.explode("parts").alias("part"))


def _verified(candidates: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b and jaccard of candidates (a, b) with a likeness of `least` or more."""
    one, two = (sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("shared").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    found = candidates.join(one, "a").join(two, "b").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))
    return found.where(F.col("jaccard") >= least)


def _met(left: DataFrame, right: DataFrame, least: float, apart: bool = False) -> DataFrame:
    """Distinct (a, b), a the smaller key, of offers that meet and may have a likeness of `least`.

    Their sizes must allow it; and as they share nothing before the rarest signature that they share, what either has
    from there on must be as much as two sets of these sizes need to share. With apart, only those of different roots.
    """
    x, y = (df.select(F.col("key").alias(f"k{c}"), F.col("n").alias(f"n{c}"), F.col("at").alias(f"a{c}"), F.col("s").alias(f"s{c}"), F.col("part").alias(f"p{c}"), *([F.col("root").alias(f"r{c}")] if apart else [])) for df, c in ((left, 1), (right, 2)))
    on = (F.col("s1") == F.col("s2")) & (F.col("p1") == F.col("p2")) & (F.col("k1") != F.col("k2")) & (F.least("n1", "n2") >= F.lit(least) * F.greatest("n1", "n2") - 1e-9)
    on = on & (F.least(F.col("n1") - F.col("a1"), F.col("n2") - F.col("a2")) >= F.ceil(F.lit(least / (1 + least)) * (F.col("n1") + F.col("n2")) - 1e-9))
    met = x.join(y, on & (F.col("r1") != F.col("r2")) if apart else on)
    return met.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()


def near_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, jaccard) of distinct fingerprints with likeness of `least` or more, and doc_id with its class.

    Equal fingerprints are one class, whose id is its smallest doc_id; key, the fingerprint's hash, tells classes apart
    also where ids are null or repeated. Classes are compared where what they offer meets (offers), and verified by their
    exact Jaccard. All pairs are returned, as many as there are; near_links gives groups without them. Null and empty
    texts share the signature 0; repeated rows are each a member; an empty table gives none.
    """
    sets = fingerprints(docs).select("doc_id", "signatures")
    keyed = sets.select("doc_id", F.xxhash64("signatures").alias("key"), "signatures")
    ids = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    member = keyed.select("doc_id", "key").join(ids, "key").select("doc_id", "class_id", "key")
    of, offered = offers(keyed.select("key", "signatures").dropDuplicates(["key"]), least)
    found = _verified(_met(offered, offered, least), of, least).withColumnsRenamed({"a": "a_key", "b": "b_key"})
    named = lambda c: ids.select(F.col("key").alias(f"{c}_key"), F.col("class_id").alias(c))
    pairs = found.join(named("a"), "a_key").join(named("b"), "b_key").select("a", "b", "jaccard", "a_key", "b_key")
    return pairs, member


#: Meetings that are compared at once; beyond that groups are joined step by step: first so many classes or so of the
#: largest group are compared with those they meet, then, of what isn't joined yet, 2**FINER times as many, up to all.
AT_ONCE, FIRST, FINER = 2_000_000, 32, 6


def near_links(rows: DataFrame, least: float = 0.8, least_signatures: int = LEAST_SIGNATURES, at_once: int = AT_ONCE) -> DataFrame:
    """Edges (u, v) between labels fp of rows (fp, signatures): their components are those of all texts with a likeness
    of `least` or more, without all pairs of a group of near copies.

    Texts with fewer than least_signatures say too little to be linked. Equal sets are one class, linked by its least fp.
    Where classes meet too often to compare all at once, a few, chosen by hash, are compared first. Classes that this has
    joined need not be compared with each other any more: meeting places where all are joined go, elsewhere those that
    aren't joined yet are compared, more at each step and in the end all. So every pair is compared unless it has been
    joined already.
    """
    told = rows.where(F.size("signatures") >= least_signatures).select("fp", "signatures", F.xxhash64("signatures").alias("key"))
    of = stored(told.groupBy("key").agg(F.min("fp").alias("fp")), "classes")
    same = told.select("key", F.col("fp").alias("v")).distinct().join(of, "key").where("fp <> v").select(F.col("fp").alias("u"), "v")
    sets, offered = offers(stored(told.select("key", "signatures").dropDuplicates(["key"]), "signatures"), least)
    offered = stored(offered, "offers")
    sizes = offered.groupBy("s", "part").agg(F.count("*").alias("c")).agg(F.sum(F.expr("c * (c - 1) / 2")).alias("n"), F.max("c").alias("c")).first()
    if (sizes["n"] or 0) <= at_once:
        edges = _verified(_met(offered, offered, least), sets, least).select("a", "b")
    else:
        finest = max(1, int(sizes["c"] // FIRST).bit_length())
        h, left, edges = F.xxhash64("key", F.lit(8)), offered.withColumn("root", F.col("key")), None
        for k in [*range(finest, 0, -FINER), 0]:
            own = stored(_verified(_met(left, left.where(F.pmod(h, F.lit(1 << k)) == 0), least, apart=True), sets, least).select("a", "b"), "links")
            edges = own if edges is None else edges.unionByName(own)
            if k:
                joined = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "key")
                rooted = offered.join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
                apart = rooted.groupBy("s", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s", "part")
                left = stored(rooted.join(apart, ["s", "part"], "left_semi"), "left")
    named = lambda c, to: of.select(F.col("key").alias(c), F.col("fp").alias(to))
    near = edges.join(named("a", "u"), "a").join(named("b", "v"), "b").where("u <> v").select("u", "v")
    return near.unionByName(same)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


def edited_fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses.

    Edited: the last half of the code points (rounded down) replaced by the first as many, or all, of the next
    document's, in descending order of doc_id; after the last comes the first, and a single document follows itself.
    Null texts are empty; null doc_ids come last; rows of one doc_id are ordered by their text's hash; an empty table
    gives an empty one; other columns may have any names.

    Texts are shuffled once, by ranges of doc_id with bounds from a sample of ids; the first row of each range is sent
    to the range before it too, so that every task reads each document's successor from the order it streams through.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.count()
    range_rows = max(range_rows, total // MOST_RANGES)
    ranges = max(1, -(-total // range_rows))
    known = rows.where("doc_id IS NOT NULL").select("doc_id")
    # As Spark's own range partitioner does: bounds from about 20 sampled ids a range.
    share = min(1.0, 20 * ranges / max(1, total))
    sampled = sorted(r[0] for r in known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 11) <= int(share * 2**53)).distinct().collect())
    bounds = np.array(sorted({sampled[i * len(sampled) // ranges] for i in range(1, ranges)}) if sampled else [], np.int64)
    held = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("long")
    def range_of(ids: pa.Array) -> pa.Array:
        # Ranges are numbered in descending order of ids; null ids are in the last one.
        own = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(len(held.value) - np.searchsorted(held.value, own, side="right"), pa.int64())

    placed = rows.select("doc_id", range_of("doc_id").alias("range"))
    heads = {r["range"]: r["first"] for r in placed.groupBy("range").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(heads)
    # A row for each range at most: the id that a range begins with, and the range before it.
    guests = [(heads[r], int(order[i - 1])) for i, r in enumerate(order)]
    guest = spark.createDataFrame(guests, "head long, before long")
    whole = rows.withColumn("range", range_of("doc_id")).join(F.broadcast(guest), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    sent = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))))
    sent = sent.otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guest"))))
    dealt = whole.select("doc_id", "text", F.explode(sent).alias("to")).select("doc_id", "text", F.xxhash64("text").alias("h"), "to.range", "to.guest")
    # As many parts as ranges, so that a part's size stays that of a range or two however large the table is.
    ordered = dealt.repartition(ranges, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.desc("h")).select("doc_id", "text", "range", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        last = None  # the document that waits for its successor
        made: list[tuple] = []

        def finish(text: str, sigs) -> None:
            doc, own, own_sigs = last[0], last[1], last[2]
            half = len(own) // 2
            edited = (own[: len(own) - half] + text[:half]).encode()
            changed = hashed(words(edited), known)
            made.append((doc, len(own), hashlib.sha256(edited).hexdigest(), encode(own_sigs), encode(changed), jaccard(own_sigs, changed), jaccard(own_sigs, sigs), len(own_sigs)))

        def flush() -> pa.RecordBatch:
            names = [f.split()[0] for f in _OUT.split(", ")]
            kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
            columns = [pa.array([m[i] for m in made], kinds[f.split()[1]]) for i, f in enumerate(_OUT.split(", "))]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            held_chars = 0
            for doc, text, number, is_guest in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, number, is_guest = text.as_py(), number.as_py(), is_guest.as_py()
                if is_guest and (last is None or last[3] != number):
                    continue
                sigs = hashed(words(text.encode()), known)
                if last is not None and last[3] == number:
                    finish(text, sigs)
                last = None if is_guest else (doc.as_py(), text, sigs, number)
                held_chars += len(text)
                if held_chars > 4_000_000:
                    yield flush()
                    held_chars = 0
            if made:
                yield flush()

    return ordered.mapInArrow(run, _OUT)
