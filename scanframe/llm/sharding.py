"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanframe.functions.cluster import materialize
from scanframe.llm.common import constant_table

SHARDS = 24
NODES = 64  # virtual nodes per shard
_CELL = 51  # places on the ring are 63 bits; their top 12 bits are the cells in which arcs are looked up


def _place(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order; a shard's nodes do not depend on the number of shards."""
    n = spark.range(shards * nodes).select((F.col("id") / nodes).cast("int").alias("shard"), (F.col("id") % nodes).alias("node"))
    placed = n.select(_place(F.lit("node"), F.col("shard"), F.col("node")).alias("place"), "shard").collect()
    return sorted((r["place"], r["shard"]) for r in placed)


def _arc_cells(places: list[int]) -> list[dict]:
    """Arc k holds the keys above node k - 1 up to node k; beyond the last node arc 0 goes on. One row per arc and cell."""
    out = []
    below = [-1, *places]
    spans = [(k, low, high) for k, (low, high) in enumerate(zip(below, places, strict=False))]
    spans.append((0, places[-1], (1 << 63) - 1))
    for arc, low, high in spans:
        out.extend({"cell": c, "arc": arc, "low": low, "high": high} for c in range((low + 1) >> _CELL, (high >> _CELL) + 1))
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: with no slack the even parts, which then are filled exactly."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def fill(counts: list[int], owners: list[int], capacity: list[int]) -> list[dict]:
    """Where the rows of each arc go: segments (arc, low, high, shard, slot), ranks low to high - 1 of the arc.

    The arcs offer their rows to the shard of their own node first; a full shard passes the
    rest on clockwise, node by node, until a shard with room comes. Work is by arc, not by
    row: at most (number of arcs + number of shards) segments come out.
    """
    free, used = list(capacity), [0] * len(capacity)
    start = [0] * len(counts)
    waiting = [k for k, n in enumerate(counts) if n]
    out, hop = [], 0
    while waiting:
        if hop > len(owners):
            raise ValueError("the shards cannot hold all rows")
        still = []
        for arc in waiting:
            shard = owners[(arc + hop) % len(owners)]
            n = min(counts[arc] - start[arc], free[shard])
            if n:
                out.append({"arc": arc, "low": start[arc], "high": start[arc] + n, "shard": shard, "slot": used[shard]})
                start[arc] += n
                free[shard] -= n
                used[shard] += n
            if start[arc] < counts[arc]:
                still.append(arc)
        waiting, hop = still, hop + 1
    return out


def assign(keys: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows (key, size, text_crc32); columns of these names only.

    A key hashes to a place on the ring and belongs to the next virtual node clockwise. Only
    the rows' number per arc goes to the driver (shards * nodes numbers, whatever the data);
    the plan made of them goes back as a table of as many rows. A row's rank in its arc comes
    from hash bins of about the square root of the arc's rows, so a hot arc has many tasks.
    Equal rows are counted before that and unfolded at the end.
    """
    spark = keys.sparkSession
    names = keys.columns
    counted = keys.groupBy(*names).agg(F.count("*").alias("copies"))
    placed = ring(spark, shards, nodes)
    cells = constant_table(spark, _arc_cells([p for p, _ in placed]), "cell int, arc int, low bigint, high bigint")
    counted = counted.withColumn("place", _place(F.lit("key"), F.col("key"))).withColumn(
        "cell", F.shiftright("place", _CELL).cast("int"))
    on = (counted["cell"] == cells["cell"]) & (F.col("place") > F.col("low")) & (F.col("place") <= F.col("high"))
    rows = counted.join(F.broadcast(cells), on).select(*names, "copies", "arc", _place(*[F.col(c) for c in names]).alias("order"))
    rows = materialize(rows)

    totals = {r["arc"]: (r["n"], r["d"]) for r in rows.groupBy("arc").agg(
        F.sum("copies").alias("n"), F.count("*").alias("d")).collect()}
    counts = [totals.get(k, (0, 0))[0] for k in range(len(placed))]
    segments = fill(counts, [s for _, s in placed], capacities(sum(counts), shards, slack))
    bins = constant_table(
        spark, [{"arc": a, "bins": max(1, round(d ** 0.5))} for a, (_, d) in totals.items()], "arc int, bins int")
    parts = constant_table(spark, segments, "arc int, low bigint, high bigint, shard int, slot bigint")

    rows = rows.join(F.broadcast(bins), "arc").withColumn("bin", (F.col("order") / 2.0 ** 63 * F.col("bins")).cast("int"))
    sums = rows.groupBy("arc", "bin").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("arc").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("arc", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("arc", "bin").orderBy("order", *names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(sums, ["arc", "bin"])
    first = F.col("before") + F.col("inside")
    ranked = ranked.select(*names, "arc", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("rank"))
    where = (ranked["arc"] == parts["arc"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(parts), where).select(
        *names, "shard", (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("rows"), shard, slot (gapless from 0), grown_shard (null under this law).

    The bound is the even share, so the numbers of rows of any two shards differ by one at
    most; keys that find their shard full go on clockwise. Equal texts have equal text_crc32
    but are placed by their own doc_id. Null text has 8 bytes and the check sum of the empty
    text; null doc_ids share a place on the ring and overflow like any hot key; equal rows each
    get a slot; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = docs.select(
        F.col("doc_id").alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(keys, shards).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
