"""Centroid clustering: rounds of exact whole-number assignment, the nearest centroid found by a tournament of bisectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions.cluster import materialize

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
_SAFE = 1 << 27  # components below it keep every product sum of up to 128 dimensions inside 64 bits
_LIMB = 32  # bits of the pieces in which sums of any size leave a task
_LONG = 2**63
_RESULT = (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: 64-bit integers where that is safe, else Python's; scale is a power of two."""
    if not vectors.size or np.abs(vectors).max() * float(scale) < _SAFE:
        return np.floor(vectors * float(scale)).astype(np.int64)

    def one(x: float) -> int:  # from 2^52 on every double is a whole number
        return int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale)

    return np.array([[one(x) for x in row] for row in vectors.tolist()], dtype=object)


class Bisectors:
    """Between centroids a < b lies the plane of equal distance: 2 (b - a) x = |b|^2 - |a|^2.

    On the plane both are equally near and a wins, which has the smaller number.
    """

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        squares = (c * c).sum(axis=1)
        self.exact = (c, 2 * (c[None, :, :] - c[:, None, :]), squares[None, :] - squares[:, None])
        self.small = None
        if c.shape[1] <= 128 and (not c.size or np.abs(c).max() < _SAFE):
            self.small = tuple(z.astype(np.int64) for z in self.exact)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it, per row; k - 1 tests each."""
        if self.small is None or x.dtype == object:
            x, (c, normals, limits) = x.astype(object), self.exact
        else:
            c, normals, limits = self.small
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(c)):
            beyond = (x * normals[winner, j]).sum(axis=1) > limits[winner, j]
            winner[beyond.astype(bool)] = j
        away = x - c[winner]
        return winner, (away * away).sum(axis=1)


def _rows(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    column = batch.column("vector")
    return whole(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1), scale)


def _pieces(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as (limb, part): the sum of part * 2^(32 limb), all parts of its sign."""
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield limb, sign * (value & (1 << _LIMB) - 1)
        value, limb = value >> _LIMB, limb + 1


def _sums_of(bisectors: Bisectors, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vector) to one row per cluster, dimension and limb of a task's sums; dimension ``dims`` counts vectors."""
        k = len(bisectors.exact[0])
        held = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            x = _rows(batch, scale)
            winner, _ = bisectors.nearest(x)
            for c in np.unique(winner).tolist():
                own = x[winner == c]
                held[c, :dims] += own.sum(axis=0).astype(object)
                held[c, dims] += len(own)
        out = [(c, d, limb, part) for c in range(k) for d in range(dims + 1) for limb, part in _pieces(int(held[c, d]))]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x, pa.int32()) for x in columns[:3]], pa.array(columns[3], pa.int64())], ["cluster", "dim", "limb", "part"])

    return run


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after one round: floor of the mean of their vectors, unchanged where they have none.

    Every task sends at most one row per centroid, dimension and limb; the driver gets their sums.
    """
    k, dims = len(centroids), len(centroids[0])
    run = _sums_of(Bisectors(centroids), dims, scale)
    parts = vectors.select("vector").mapInArrow(run, "cluster int, dim int, limb int, part long")
    totals = np.zeros((k, dims + 1), dtype=object)
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part")).collect():
        totals[r["cluster"], r["dim"]] += r["part"] << (_LIMB * r["limb"])
    return [[s // t[dims] for s in t[:dims]] if t[dims] else old for t, old in zip(totals.tolist(), centroids, strict=True)]


def usable(embedding: Column, dims: int) -> Column:
    """Exactly so many components, none null or non-finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(embedding) == dims) & fine, F.lit(False))


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors whose ids hash smallest, in that order; ids that repeat are ordered by vector, a null id counts as empty."""
    ident = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.orderBy(ident, "vector").limit(k).select("vector").collect()
    return whole(np.array([r["vector"] for r in chosen], np.float64), scale).tolist() if chosen else []


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """Centroids of (vec_id, vector) after all rounds; fewer than k if there are fewer vectors, none without any."""
    centroids = first_centroids(vectors, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        new = moved(vectors, centroids, scale)
        if new == centroids:  # later rounds would change nothing
            break
        centroids = new
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of the vectors; a squared distance beyond 64 bits is null."""
    bisectors = Bisectors(centroids)
    schema = vectors.select("vec_id").schema.add("cluster", "integer").add("distance", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            winner, distance = bisectors.nearest(_rows(batch, scale))
            distance = pa.array([d if d < _LONG else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(winner, pa.int32()), distance], schema.names)

    return vectors.select("vec_id", "vector").mapInArrow(run, schema)


def cluster_vectors(
        vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Per usable row of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold a null or non-finite component are left
    out; repeated rows count each. All arithmetic is exact at any magnitude; a distance or sum
    that 64 bits cannot hold is null. Fewer than k usable vectors give as many centroids, none
    an empty result. Equal distances go to the smaller number, empty clusters keep their
    centroid. Other columns are not looked at. The vectors are written once without the unusable
    ones; each round reads them, moves k sums per task, and shuffles nothing else, so copies
    and hot ids make no difference.
    """
    kept = vectors.where(usable(F.col("embedding"), dims)).select("vec_id", F.col("embedding").alias("vector"))
    kept = materialize(kept)
    centroids = fit(kept, k, rounds, seed, scale)
    if not centroids:
        return kept.where(F.lit(False)).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in _RESULT])
    assigned = materialize(assign(kept, centroids, scale))
    found = assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count(F.when(F.col("distance").isNull(), 1)).alias("beyond")).collect()
    totals = {r["cluster"]: None if r["beyond"] else int(r["total"]) for r in found}
    whole_sum = None if None in totals.values() else sum(totals.values())

    def number(value: int | None) -> Column:
        return F.lit(value if value is not None and value < _LONG else None).cast("long")

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "vec_id", "cluster", "distance",
        F.get(F.array(*[number(totals.get(c, 0)) for c in range(len(centroids))]), F.col("cluster")).alias("cluster_inertia"),
        number(whole_sum).alias("inertia"),
        F.get(F.array(*[F.lit(d) for d in digests]), F.col("cluster")).alias("centroid_sha256"))
