"""Control flow facts and two opt-in checks on them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanframe import rules as R
from scanframe.functions.cluster import materialize
from scanframe.operators import syntax
from scanframe.operators.flow import with_file_id


def control_nodes(facts: DataFrame) -> DataFrame:
    """if / while / for / try statements per file."""
    return facts.where("kind = 'control'").groupBy("path", "name").agg(F.count("*").alias("n"))


def _sink_calls(facts: DataFrame) -> DataFrame:
    sink = reduce(or_, [F.contains("qual", F.lit(s)) for s in R.SINKS])
    return facts.where((F.col("kind") == "call") & sink)


def numbered_facts(files: DataFrame) -> DataFrame:
    """Facts of the two checks with a row identity per file, written once for both sides of a join."""
    facts = syntax.fact_rows(with_file_id(files), ["file_id", "path"])
    return materialize(facts.where("kind in ('call', 'stop', 'guarded')").select(
        "file_id", "path", "seq", "kind", "line", "end_line", "qual", "blocks"))


def unreachable_sinks(facts: DataFrame) -> DataFrame:
    """Sink calls in a statement after return / raise / break / continue of the same block."""
    stops = (
        facts.where("kind = 'stop'").select("file_id", F.element_at("blocks", -1).alias("b"))
        .groupBy("file_id", F.col("b.block").alias("block")).agg(F.min("b.pos").alias("stop_pos")))
    calls = _sink_calls(facts).select("file_id", "path", "seq", "line", "qual", F.inline("blocks"))
    return (
        calls.join(stops, ["file_id", "block"]).where("pos > stop_pos")
        .select("file_id", "path", "seq", "line", "qual").distinct())


def unguarded_sinks(facts: DataFrame) -> DataFrame:
    """Sink calls on a line that no try body covers.

    A running maximum over try bodies that started at or above the line replaces the range
    join, so nothing is paired up.
    """
    bodies = facts.where("kind = 'guarded'").select(
        "file_id", "path", "line", F.lit(0).alias("is_call"), F.col("end_line").alias("reach"), F.lit(0).alias("seq"),
        F.lit(None).cast("string").alias("qual"))
    calls = _sink_calls(facts).select(
        "file_id", "path", "line", F.lit(1).alias("is_call"), F.lit(None).cast("int").alias("reach"), "seq", "qual")
    w = Window.partitionBy("file_id").orderBy("line", "is_call").rowsBetween(Window.unboundedPreceding, 0)
    covered = bodies.unionByName(calls).withColumn("reach", F.max("reach").over(w))
    return covered.where("is_call = 1 and (reach is null or reach < line)").select("file_id", "path", "seq", "line", "qual")
