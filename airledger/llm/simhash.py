"""SimHash near-duplicates: fingerprints of word shingles, linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spotsigs
from .common import map_texts, stored
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
#: Fingerprints that one task makes variants of.
TASK_ROWS = 20_000


def _kernel(width: int, seed: int):
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_digest

    def one(text: bytes) -> int:
        words = text.lower().split()
        if not words:
            return 0
        if len(words) <= width:
            hashes = digest(b" ".join(words), seed)
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[: -width] + 1))
            hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)])
        n, counts = len(hashes) // 8, np.zeros(BITS, np.int64)
        all_bytes = np.frombuffer(hashes, np.uint8).reshape(n, 8)
        for a in range(0, n, 65_536):
            counts += np.unpackbits(all_bytes[a : a + 65_536], axis=1).sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * counts > n)
        return int.from_bytes(bits.tobytes(), "big", signed=True)

    return lambda texts: {"fp": [one(t) for t in texts]}


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds fp (long): the SimHash of each whole text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are `width` words joined by a space with
    repeats counted; fewer words make one shingle. A bit is set if over half the shingles' XXH64 have it. Null texts
    and texts without words have fingerprint 0.
    """
    return map_texts(docs, lambda: _kernel(width, seed), "fp long", keep=keep, as_bytes=True)


def ball_edges(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints `fp` of nodes at 2 or fewer differing bits.

    Every fingerprint emits itself and its 64 variants at distance 1, half the radius. Two fingerprints are within
    distance 2 exactly if they share a variant, and all that share one are within 2 of each other. A variant has at
    most 65 emitters, and the bits flipped name them, so a group is one 64-bit mask and a flag: bit_or gathers it
    without collecting rows. A group of n gives n-1 edges from its least member instead of all pairs; each edge is
    verified by its differing bits. Fingerprints are few bytes and their variants 65 times as many, so they are dealt
    to tasks anew before they are multiplied.
    """
    flips = F.explode(F.sequence(F.lit(0), F.lit(BITS)))
    dealt = nodes.select("fp").repartition(max(1, -(-nodes.count() // TASK_ROWS)), "fp")
    variants = dealt.select("fp", flips.alias("i")).select(
        F.expr("CASE WHEN i < 64 THEN fp ^ shiftleft(1L, i) ELSE fp END").alias("variant"),
        F.expr("CASE WHEN i < 64 THEN shiftleft(1L, i) ELSE 0L END").alias("mask"),
        F.expr("CASE WHEN i < 64 THEN 0L ELSE 1L END").alias("own"),
    )
    groups = variants.groupBy("variant").agg(F.expr("bit_or(mask)").alias("mask"), F.expr("bit_or(own)").alias("own"))
    met = groups.where("bit_count(mask) + own > 1")
    members = met.select(
        F.expr(
            "concat(transform(filter(sequence(0, 63), i -> (shiftrightunsigned(mask, i) & 1) = 1), i -> variant ^ shiftleft(1L, i)),"
            " CASE WHEN own = 1 THEN array(variant) ELSE array() END)"
        ).alias("fps")
    )
    pairs = members.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
    return pairs.where("u <> v AND bit_count(u ^ v) <= 2")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text).

    Rows whose fingerprints differ in 2 or fewer bits are linked, and component_id is the smallest doc_id reachable.
    Distinct fingerprints are compared, so exact copies cost one row each. Null texts count as empty; empty texts link
    like any other. Rows with null doc_id are linked too, but give no component_id (null if a component has no other).
    Repeated rows are each returned; an empty table gives an empty one; other columns may have any names.
    """
    fps = stored(fingerprints(docs), "simhash")
    return _components(fps, lambda nodes: ball_edges(nodes))


def _components(fps: DataFrame, edges_of) -> DataFrame:
    """doc_id, fp and component_id of rows (doc_id, fp), linked by equal fp and by the edges of distinct fps."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = connected_components(edges_of(nodes)).withColumnRenamed("node", "fp")
    rooted = stored(nodes.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    # Written, so that the join below is one of two tables, of which Spark can split a large component's rows.
    components = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = rooted.join(components, "root").select("fp", "component_id")
    return fps.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, fp and component_id as near_duplicates gives, with near copies that differ in more bits linked too.

    Fingerprints are of `width`-word shingles of normalised words (case and punctuation don't count). Beyond 2 bits, which
    only a few changed words in a long text stay within, texts are linked by the exact join of their SpotSigs signature
    sets at a likeness of `least` or more (spotsigs.near_links). Rows are treated as near_duplicates treats them.
    """

    def make():
        known, one = spotsigs.word_hashes(), _kernel(width, SEED)

        def kernel(texts: list[bytes]) -> dict:
            split = [spotsigs.words(t) for t in texts]
            return one([b" ".join(w) for w in split]) | {"signatures": [spotsigs.hashed(w, known).view("int32") for w in split]}

        return kernel

    made = stored(map_texts(docs, make, "fp long, signatures array<int>", as_bytes=True), "copies")
    return _components(made, lambda nodes: ball_edges(nodes).unionByName(spotsigs.near_links(made, least)))


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay when one document of each near-duplicate group does: that with the smallest doc_id.

    found: doc_id and component_id of each row, by default those of near_duplicates. All columns are kept. Rows that
    share a doc_id count as one document, of which one row stays. Rows with null doc_id can't be told apart by id and all
    stay. An empty table stays empty; columns may have any names.
    """
    found = near_duplicates(docs) if found is None else found
    firsts = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__rows"))
    kept = docs.join(firsts.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"))
    once = kept.where("__rows = 1").select(*docs.columns)
    # Repeated ids are an exception: only their rows are grouped, and before they are shuffled.
    row = F.struct(*[F.col(c) for c in docs.columns])
    again = kept.where("__rows > 1").groupBy("__id").agg(F.min_by(row, F.xxhash64("text")).alias("__row")).select("__row.*")
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))
