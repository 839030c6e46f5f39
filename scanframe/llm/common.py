"""Helpers that several operators of this package share."""

from __future__ import annotations

import json

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.functions.cluster import counted, materialize

#: Words are runs of anything but ASCII white space.
WORD_SPACE = r"[\x20\x09-\x0D]+"

#: Largest number of ids that is sent to every task; beyond it the same join runs as a shuffle.
BROADCAST_IDS = 500_000


#: Bytes of text that a task takes up at a time; what it makes of them goes out before the next.
BLOCK_BYTES = 4 << 20


def blocks(batches, texts_of, most=BLOCK_BYTES):
    """Arrow batches cut so that none has more bytes of text than ``most``, unless a single text has."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(texts_of(batch)), 0).to_pylist()
        begin = held = 0
        for k, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the identity of a row: ``key`` (the id, null as 0) and ``mark`` (hash of text and of "id is null").

    All columns of the input move into the struct ``row``, so that extra columns cannot
    clash with the names used here. Rows with equal id and text have the same identity.
    """
    kind = df.schema[id_col].dataType
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.coalesce(F.col(id_col), F.lit(0).cast(kind)).alias("key"),
        F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("mark"),
    )


def replaced(df: DataFrame, **new: Column) -> DataFrame:
    """Rows out of ``row`` again, with some of its fields replaced."""
    names = df.schema["row"].dataType.names
    return df.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in names])


#: Bits of a sieve: 16 MB, whatever the number of ids.
SIEVE_BITS = 1 << 27
_PIECE_BITS = 1 << 15  # what ``bitmap_construct_agg`` holds


def sieved(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` plus ``possible``: false where the keys are surely not among those wanted, true where they may be.

    The keys of ``wanted`` set bits of one table of fixed size, built where they lie and sent to
    every task (at most 4096 pieces of 4 KB). With many more keys than bits nearly all rows are
    possible: then the sieve saves nothing, and an exact join of the possible rows is as right as
    ever. Null keys are possible or not like any other; an empty ``wanted`` makes no row possible.
    """
    place = F.xxhash64(F.lit(11), *[F.col(k).cast("string") for k in keys]).bitwiseAND(F.lit(SIEVE_BITS - 1))
    piece, at = F.shiftright(place, 15).cast("int"), place.bitwiseAND(F.lit(_PIECE_BITS - 1)).cast("int")
    pieces = wanted.select(piece.alias("_piece"), at.alias("_at")).groupBy("_piece").agg(F.bitmap_construct_agg(F.col("_at").cast("long")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.bit_get(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return df.withColumn("_piece", piece).join(F.broadcast(pieces), "_piece", "left").withColumn("possible", hit).drop("_piece", "_bits")


def constant_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver as a literal, without Python on the executors."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are within the bound, else leave the join to the shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def once(rows: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """``keyed`` rows with one row for each of the n identities that occur more than once; the others are left as they lie."""
    if not n:
        return rows
    few = small(repeated, n)
    return rows.join(few, ["key", "mark"], "left_anti").unionByName(
        rows.join(few, ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"]))


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per index the smallest one that the links lead to."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), both long: (node, root), root the smallest node.

    Every round each node hooks to its smallest smaller neighbour, the trees are flattened by
    pointer doubling, and the links are contracted to the roots. Hubs are no problem: their
    links are only counted by a pre-aggregated minimum and joined against written tables with
    one row a node, which the adaptive planner can broadcast or split. Links to itself and
    repeated links do nothing; without links the result is empty.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest, n = counted(pair)
    labels = None
    while n:
        tree = _flattened(materialize(rest.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))))
        if labels is None:
            nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
            labels = nodes.withColumn("root", F.col("node"))
        labels = materialize(_moved(labels, tree, "root"))
        rest, n = counted(_moved(_moved(rest, tree, "a"), tree, "b").where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels if labels is not None else pair.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _moved(df: DataFrame, tree: DataFrame, column: str) -> DataFrame:
    """Replace a column's nodes by their roots in the tree; nodes outside stay."""
    up = tree.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    new = F.coalesce("_root", column).alias(column)
    return df.join(up, F.col(column) == F.col("_node"), "left").select(
        *[new if c == column else F.col(c) for c in df.columns])


def _flattened(tree: DataFrame) -> DataFrame:
    while True:
        up = tree.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        deeper, n = counted(tree.join(up, F.col("root") == F.col("_node")).select("node", F.col("_root").alias("root")))
        if not n:
            return tree
        new = deeper.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        tree = materialize(tree.join(new, F.col("node") == F.col("_node"), "left").select(
            "node", F.coalesce("_root", "root").alias("root")))
