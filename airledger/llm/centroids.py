"""Plain Lloyd clustering of integer vectors: exact in every round, so a result depends on the vectors alone.

Centroids go to all tasks as a broadcast of k x dims integers. A task takes squared differences to one centroid after
another in numpy and returns its own sums by cluster; sums are grouped, so a cluster with most vectors is no hot task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

#: What a component may be at most, either way, for squared distances of 64 components to fit a long.
MOST = 189_812_531


@dataclass(frozen=True)
class Clusters:
    """Final centroids by number, and of each: vectors, and the sum of their squared distances to it."""

    centroids: np.ndarray
    sizes: list[int]
    inertias: list[int]


def quantised(df: DataFrame, dims: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The key and `q`, floor(scale * x) of each component, of vectors with exactly `dims` components.

    Vectors of another length, null ones and those with a null or non-finite component are left out. Where a component
    lies beyond MOST, q is null: distances to it would not fit a long.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    kept = df.where((F.size(v) == dims) & finite)
    return kept.select(F.col(f"`{key}`"), F.when(F.forall(v, lambda x: F.abs(x * F.lit(float(scale))) <= MOST), scaled.cast("array<int>")).alias("q"))


def seeds(vectors: DataFrame, k: int, seed: int, key: str = "vec_id") -> np.ndarray:
    """The k vectors whose keys have the smallest SHA-256 of `seed:key`, in that order; all if there are fewer.

    A null key comes last, and of equal keys the vector that is smaller component by component comes first.
    """
    digest: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256)
    first = vectors.where("q IS NOT NULL").select(digest.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([r.q for r in first], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of x; of equally near ones the lowest number."""
    squared = np.empty((len(x), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        apart = x - c
        squared[:, j] = np.einsum("ij,ij->i", apart, apart)
    at = squared.argmin(1)
    return at, squared[np.arange(len(x)), at]


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, dtype=np.int64) for v in vectors]).reshape(-1, dims) if len(vectors) else np.empty((0, dims), dtype=np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: vectors, their squared distances summed, and their components summed."""
    shared, (k, dims) = vectors.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, n, far, total = shared.value, np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch["q"], dims)
            at, squared = nearest(x, c)
            for j in np.unique(at):
                own = at == j
                n[j] += own.sum()
                far[j] += squared[own].sum()
                total[j] += x[own].sum(0)
        found = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": found, "n": n[found], "far": far[found]} | {f"s{i}": total[found, i] for i in range(dims)})

    names = ["n", "far", *[f"s{i}" for i in range(dims)]]
    parts = vectors.where("q IS NOT NULL").select("q").mapInPandas(run, "cluster int, " + ", ".join(f"{c} long" for c in names))
    rows = parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names]).collect()  # k rows at most
    shared.unpersist()
    return {r["cluster"]: (r["n"], r["far"], [r[f"s{i}"] for i in range(dims)]) for r in rows}


def lloyd(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> Clusters:
    """Centroids after so many rounds, and their clusters by one more assignment.

    A round assigns every vector to the nearest centroid and replaces every non-empty centroid by the floor of its
    vectors' mean, component by component; empty ones stay. vectors is read once for each round and once more: pass a
    stored table. Without centroids there are no clusters.
    """
    centroids = centroids.copy()
    if not len(centroids):
        return Clusters(centroids, [], [])
    for _ in range(rounds):
        for j, (n, _, total) in _sums(vectors, centroids).items():
            centroids[j] = [s // n for s in total]
    last = _sums(vectors, centroids)
    return Clusters(centroids, [last.get(j, (0, 0))[0] for j in range(len(centroids))], [last.get(j, (0, 0))[1] for j in range(len(centroids))])


def centroid_digest(centroid: np.ndarray) -> str:
    """Lowercase hex SHA-256 of a centroid's components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def assigned(vectors: DataFrame, clusters: Clusters, key: str = "vec_id") -> DataFrame:
    """key, cluster int, distance long (squared), cluster_inertia and inertia long, centroid_sha256, one row a vector.

    A vector whose q is null (a component beyond MOST) has null in all but the key and inertia.
    """
    kind, centroids, dims = vectors.schema[key].dataType, clusters.centroids, clusters.centroids.shape[-1]
    total, digests = sum(clusters.inertias), [centroid_digest(c) for c in centroids]
    inertias = np.array(clusters.inertias, dtype=np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, squared = nearest(_matrix(batch["q"], dims), shared.value)
            yield pd.DataFrame({"__key": batch["__key"], "cluster": at, "distance": squared, "cluster_inertia": inertias[at], "inertia": total, "centroid_sha256": [digests[j] for j in at]})

    # The key passes pandas as text: a null among longs would make them doubles.
    as_text = F.col(f"`{key}`").cast("string").alias("__key")
    fields = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    inside = vectors.where("q IS NOT NULL").select(as_text, "q").mapInPandas(run, f"__key string, {fields}") if len(centroids) else vectors.sparkSession.createDataFrame([], f"__key string, {fields}")
    beyond = vectors.where("q IS NULL").select(as_text, *[F.lit(total if n == "inertia" else None).cast(t).alias(n) for n, t in (f.split() for f in fields.split(", "))])
    every = inside.unionByName(beyond)
    return every.select(F.col("__key").cast(kind).alias(key), *[c for c in every.columns if c != "__key"])


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Clusters of the vectors of a table, as `assigned` says.

    Each row with a usable vector (see quantised) gives one row, also where keys repeat or are null; other rows give
    none. With fewer than k vectors each is a centroid at first; an empty table gives no rows. Other columns aren't read.
    """
    ship(df.sparkSession)
    vectors = stored(quantised(df, dims, scale, key, vector), "vectors")
    return assigned(vectors, lloyd(vectors, seeds(vectors, k, seed, key), rounds), key)
