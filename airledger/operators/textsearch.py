"""Ranked search of licensee names: phrases of folded terms, scored by BM25 over all names."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parameters import marked_letters

K1, B = 1.2, 0.75
#: Letters with marks, and their bases.
MARKED = marked_letters()


def folded(column: Column | str) -> Column:
    """Lower case without diacritics, in the JVM: letters with marks are mapped to their base, other marks cut."""
    own = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(F.translate(own, *MARKED), r"\p{M}+", "")
    return F.lower(F.when(own.rlike(r"[^\x00-\x7F]"), bare).otherwise(own))


def normalised(column: Column | str) -> Column:
    """Folded terms between single blanks, with one before and after: `" t mobile "`."""
    words = F.regexp_replace(folded(column), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _occurrences(names: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in normalised names; its last piece is a prefix unless it is one character."""
    tail = "" if len(phrase[-1]) > 1 else " "
    # A look-ahead consumes nothing, so occurrences that overlap are all counted, in one pass over the text.
    return F.regexp_count(names, F.lit(f"(?<= )(?={' '.join(phrase)}{tail})"))


def rank(df: DataFrame, key: str, name: str, phrases: list[list[str]]) -> DataFrame:
    """key and score of the rows whose name has every phrase; a lower score is a better match.

    score = -sum of idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length)), with idf = ln((N - n + 0.5) /
    (n + 0.5)), at least 1e-6; N, n and the mean are of all rows, not of those that match: they are one scalar
    subquery, a scan beside the one that scores.
    """
    if not phrases:
        raise ValueError("no word to search")
    names = df.select(key, normalised(F.coalesce(F.col(name), F.lit(""))).alias("names"))
    terms = F.when(F.trim("names") == "", 0).otherwise(F.length("names") - F.length(F.replace(F.col("names"), F.lit(" "))) - 1)
    hits = names.select(key, terms.alias("len"), *[_occurrences(F.col("names"), p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    having = [F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(phrases))]
    counts = hits.agg(F.struct(F.count("*").alias("N"), F.avg(F.nullif("len", F.lit(0))).alias("mean"), *having).alias("counts")).scalar()
    return _scored(hits.withColumn("counts", counts).select("*", "counts.*"), key, len(phrases))


def _scored(hits: DataFrame, key: str, phrases: int) -> DataFrame:
    """key and score of hits with every phrase: tf0.., n0.., len, N and mean are their columns."""
    counted = hits.where(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(phrases)]))
    score = F.lit(0.0)
    for i in range(phrases):
        n, tf = F.col(f"n{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("N") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return counted.select(key, (-score).alias("score"))


def postings(df: DataFrame, key: str, name: str) -> DataFrame:
    """term, key, len (terms of the name) and positions of every term of every name, and a row of no term for each name.

    Kept sorted by term, it is an inverted index: a term, or all that begin with something, are neighbouring rows. The
    rows of no term come first and hold what is counted of all names.
    """
    words = F.split(F.trim(normalised(F.coalesce(F.col(name), F.lit("")))), " ")
    own = df.select(key, F.filter(words, lambda w: w != "").alias("words")).select(key, "words", F.size("words").alias("len"))
    each = own.select(key, "len", F.posexplode("words").alias("at", "term")).groupBy("term", key, "len").agg(F.array_sort(F.collect_list("at")).alias("positions"))
    return each.unionByName(own.select(F.lit("").alias("term"), key, "len", F.array().cast("array<int>").alias("positions"))).select("term", key, "len", "positions")


@dataclass
class NameIndex:
    """Postings of names, and what is counted of all of them: names, names with a term, and terms."""

    postings: DataFrame
    names: int
    named: int
    terms: int


def rank_by_index(index: NameIndex, key: str, phrases: list[list[str]]) -> DataFrame:
    """What rank gives, from the postings of the phrases' own terms alone: the filter on term reaches the scan.

    A piece's positions are moved back by its place in its phrase, so where all pieces of a phrase agree, it begins.
    """
    if not phrases:
        raise ValueError("no word to search")
    met = {}
    for i, phrase in enumerate(phrases):
        for j, piece in enumerate(phrase):
            prefix = j == len(phrase) - 1 and len(piece) > 1
            met[i, j] = F.col("term").startswith(piece) if prefix else F.col("term") == piece
    own = index.postings.where(reduce(lambda a, b: a | b, met.values()))
    moved = lambda j: F.transform("positions", lambda p: p - j)
    starts = {(i, j): F.flatten(F.collect_list(F.when(m, moved(j)))).alias(f"at{i}_{j}") for (i, j), m in met.items()}
    hits = own.groupBy(key).agg(F.first("len").alias("len"), *starts.values())
    agreed = [reduce(F.array_intersect, [F.col(f"at{i}_{j}") for j in range(len(p))]) if len(p) > 1 else F.col(f"at{i}_0") for i, p in enumerate(phrases)]
    hits = hits.select(key, "len", *[F.size(a).alias(f"tf{i}") for i, a in enumerate(agreed)])
    having = hits.agg(F.struct(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(phrases))]).alias("counts")).scalar()
    counted = hits.withColumn("counts", having).select("*", "counts.*", F.lit(index.names).alias("N"), F.lit(index.terms / index.named if index.named else None).cast("double").alias("mean"))
    return _scored(counted, key, len(phrases))
