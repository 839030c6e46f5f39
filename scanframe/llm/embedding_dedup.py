"""Near-duplicate vectors: int8 tile products with error bounds, exact cosine only where the bound leaves doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.functions.cluster import materialize
from scanframe.llm.common import components, smallest_reachable

TILE = 2048  # vectors per tile
COSINE = 0.98
_EXACT_DIMS = 1024  # int8 products of so many dimensions are whole numbers that float32 holds exactly


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale, length of the quantised vector and length of the error, per unit vector."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def doubtless_below(a: tuple, b: tuple, cosine: float) -> np.ndarray:
    """True for pairs whose cosine is below the limit for certain.

    With u = p + e and v = q + f (quantised part and error), |u.v - p.q| <= |p||f| + |e||q| + |e||f|.
    The codes' product is computed in float32, which holds these whole numbers exactly; a
    slack of 10^-9 covers the rounding of the rest.
    """
    (ca, sa, pa_, ea), (cb, sb, pb, eb) = a, b
    product = np.zeros((len(ca), len(cb)))
    for k in range(0, ca.shape[1], _EXACT_DIMS):
        product += ca[:, k:k + _EXACT_DIMS].astype(np.float32) @ cb[:, k:k + _EXACT_DIMS].astype(np.float32).T
    product *= sa[:, None]
    product *= sb[None, :]
    product += pa_[:, None] * eb[None, :]
    product += ea[:, None] * (pb + eb)[None, :]
    return product < cosine - 1e-9


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of the rows of two tiles, or of one (i < j), with cosine at least the limit."""
    # a power of two changes no digit and keeps squares of very large and very small vectors finite
    def parts(z):
        z = z * np.exp2(-np.floor(np.log2(np.abs(z).max(axis=1))))[:, None]
        return z, quantised(z / np.linalg.norm(z, axis=1)[:, None])

    x, qx = parts(x)
    y, qy = (x, qx) if y is None else parts(y)
    maybe = ~doubtless_below(qx, qy, cosine)
    if y is x:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    sure = np.empty(len(i), bool)
    for k in range(0, len(i), 65536):
        part = slice(k, k + 65536)
        sure[part] = exact_cosine(x[i[part]], y[j[part]]) >= cosine
    return i[sure], j[sure]


def _tile_pair(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        """Rows of one tile or two to (cid, links, to): copies linked with, and a smaller class in the same component."""
        group = group.sort_by("cid")
        cid, weight = group.column("cid").to_numpy(), group.column("copies").to_numpy()
        vectors = group.column("vector").combine_chunks()
        matrix = vectors.flatten().to_numpy().astype(np.float64).reshape(len(cid), -1)
        side = group.column("tile").to_numpy()
        low, high = side.min(), side.max()
        first = np.flatnonzero(side == low)
        if low == high:
            i, j = links(matrix, None, cosine) if group.column("t1")[0] == group.column("t2")[0] else (np.empty(0, int),) * 2
        else:
            second = np.flatnonzero(side == high)
            i, j = links(matrix[first], matrix[second], cosine)
            i, j = first[i], second[j]
        n = np.zeros(len(cid), np.int64)
        np.add.at(n, i, weight[j])
        np.add.at(n, j, weight[i])
        to = cid[smallest_reachable(len(cid), i, j)]
        on = n > 0
        return pa.table({"cid": cid[on], "links": n[on], "to": to[on]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable by links), kept (vec_id = component_id).

    Only vectors of one label are compared; a null label, a null, zero or empty vector, and
    one with a null or non-finite component link with nothing; so do vectors of different
    lengths. Equal vectors of a label form one class and are linked by definition, so copies
    cost nothing. Classes lie in tiles by hash; every pair of tiles of a label is one group of
    at most two tiles. From it come numbers of links and one link per vector into its local
    component, never the pairs themselves. Rows that repeat a vec_id each get a row; a null
    vec_id is kept out of component_id unless its component has no other.
    """
    usable = (
        F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vector", lambda x: x != 0))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable").select("vec_id", "label", "vector", F.xxhash64("vector").alias("hash"))
    # the hash groups by bytes of fixed size; the vector itself settles collisions
    classes = good.groupBy("label", "hash", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")))
    blocks = materialize(classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")))
    placed = classes.select("cid", "copies", "label", "dims", "vector").join(blocks, ["label", "dims"])
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other"))
    found = placed.groupBy("label", "dims", "t1", "t2").applyInArrow(_tile_pair(cosine), "cid long, links long, to long")
    found = materialize(found)
    n_links = materialize(found.groupBy("cid").agg(F.sum("links").alias("links")))
    roots = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("cid"), "root")

    labelled = classes.select("cid", "label", "hash", "vector", "first", "copies").join(n_links, "cid", "left").join(
        roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    labelled = materialize(labelled)
    least = materialize(labelled.groupBy("root").agg(F.min("first").alias("component")))
    known = materialize(labelled.join(least, "root").select(
        "label", "hash", "vector", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked = good.join(known, ["label", "hash", "vector"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
