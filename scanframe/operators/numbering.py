"""Running numbers inside groups of any size, without sending a group to one task."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions.cluster import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Number rows 1, 2, ... per group in the given order.

    Rows are range-partitioned over group and order, so a large group spreads over many
    tasks; each row then adds its place in its partition to the size of the group in
    earlier partitions. The sorted rows are written first: bounds, places and sizes must
    come from the same split.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()))
    table = table.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn(
        "_place", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = (  # at most one row per group and partition
        table.groupBy(*group, "_part").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0))))
    t, h = table.alias("t"), heads.alias("h")
    same = F.col("t._part") == F.col("h._part")
    for g in group:
        same = same & F.col(f"t.{g}").eqNullSafe(F.col(f"h.{g}"))
    number = F.col("h._before") + F.col("t._place") - F.col("h._first") + 1
    return t.join(h, same).select(*[F.col(f"t.{c}") for c in df.columns], number.alias(name))


def running_totals(df: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """Add the sum of ``value`` (long, not null) over all earlier rows in the given order.

    Rows are range-partitioned; a task adds up its own rows as they pass, and the sums of the
    earlier parts, one row a part, are added afterwards. The rows are written in between, as
    sums and parts must come from the same split. Rows that are equal in the order follow each
    other in any order, each with its own place.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = df.select("*", F.lit(0).cast("long").alias(name)).schema

    def run(batches):
        total = 0
        for batch in batches:
            values = batch.column(value)
            upto = pc.add(pc.cumulative_sum(values), total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.subtract(upto, values)], schema.names)
            total = upto[-1].as_py() if len(upto) else total

    table = materialize(ranged.mapInArrow(run, schema).withColumn("_part", F.spark_partition_id()))
    ends = table.groupBy("_part").agg(F.max(F.col(name) + F.col(value)).alias("_sum"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select("_part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    return table.join(earlier, "_part").select(*df.columns, (F.col(name) + F.col("_before")).alias(name))
