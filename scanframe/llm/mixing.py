"""Mixing sources to target weights: random order per source, distributed prefix sums, a cut at the exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions.cluster import counted, materialize
from scanframe.llm.common import WORD_SPACE, replaced, small
from scanframe.operators.numbering import number_rows

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
EPOCHS = 3  # a target stops at so many times its source's size
_BINS = 4096  # ranges of the order key per source; the cut is then looked for inside one of them


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    parts = F.split(text, WORD_SPACE)
    ends = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    count = F.when(F.size(parts) == 1, 1 - (F.element_at(parts, 1) == "").cast("int")).otherwise(F.size(parts) - ends)
    return F.when(text.isNull(), 0).otherwise(count).cast("long")


def _ordered(docs: DataFrame, seed: int) -> DataFrame:
    """``row``, its source, size, and place in the random order: ``place`` (62 bits, uniform), ``bin`` (its top bits)."""
    text, ident = F.col("row")["text"], F.col("row")["doc_id"]
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident, text), 2)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row")["source"].alias("source"), n_words(text).alias("size"), place.alias("place"))
    return rows.withColumn("bin", F.shiftright("place", 50).cast("int"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to the same plus ``target``: shares by weight, at most ``epochs`` sizes, excess reshared.

    The level t with sum(min(weight * t, epochs * size)) = sum(size) is found by resharing: the
    sources at their limit keep it, the rest divides by weight, until none is above. Each round
    is one aggregation; there are at most as many as sources that reach the limit.
    """
    known = number_rows(sources.where("source is not null"), [], ["source"], "place")
    n_known = sources.where("source is not null").count()
    null = sources.where("source is null").withColumn("place", F.lit(n_known + 1).cast("long"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int"))
    placed = materialize(known.unionByName(null).withColumn("weight", weight))
    limit = F.col("source_size") * float(epochs)
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, at_limit = 0.0, -1
    while True:
        full = F.col("weight") * level > limit if at_limit >= 0 else F.lit(False)
        x = placed.agg(
            F.sum(F.when(full, limit)).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n")).first()
        if x["n"] == at_limit or not x["open"]:
            break
        at_limit, level = x["n"], (total - (x["spent"] or 0.0)) / x["open"]
    return placed.select(
        "source", "source_size", F.least(F.col("weight") * level, limit).alias("target"))


def plan(rows: DataFrame) -> tuple[DataFrame, int]:
    """Per source its target, whole epochs and the cut: rows before ``cut`` count once more, those at it in part.

    Sums per source and bin are pre-aggregated; only the bin with the cut is looked at by row,
    so no task holds more of a source than a bin. ``cut_rest`` of ``cut_size`` words at the cut
    are taken. Also returns the number of sources.
    """
    bins = materialize(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    goal = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")))
    empty = F.col("source_size") == 0
    goal = goal.withColumn("epochs", F.when(empty, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
    goal = goal.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    goal, n = counted(goal)
    same = F.col("b.source").eqNullSafe(F.col("g.source"))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = bins.withColumn("until", F.sum("words").over(up))
    hit = sums.alias("b").join(small(goal, n).alias("g"), same).where(
        (F.col("until") > F.col("rest")) & (F.col("until") - F.col("words") <= F.col("rest")))
    hit = materialize(hit.select("b.source", "bin", (F.col("rest") - F.col("until") + F.col("words")).alias("inside")))
    at = (F.col("r.source").eqNullSafe(F.col("h.source"))) & (F.col("r.bin") == F.col("h.bin"))
    inner = rows.select("source", "bin", "place", "size").alias("r").join(small(hit, n).alias("h"), at)
    inner = inner.groupBy("r.source", "r.bin", "place", "inside").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("until", F.sum("words").over(up)).where(
        (F.col("until") > F.col("inside")) & (F.col("until") - F.col("words") <= F.col("inside")))
    cut = materialize(inner.select(
        "source", F.col("place").alias("cut"), F.col("words").alias("cut_size"),
        (F.col("inside") - F.col("until") + F.col("words")).alias("cut_rest")))
    joined = small(goal, n).alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
    return materialize(joined.select(
        F.col("g.source").alias("of"), "source_size", "target", "epochs", "cut", "cut_size", "cut_rest")), n


def taken(rows: DataFrame, goal: DataFrame, n: int) -> DataFrame:
    """Rows with their source's plan and ``part``, the words of the last, partial epoch."""
    joined = rows.join(small(goal, n), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    part = (
        F.when(F.col("cut").isNull(), F.lit(0).cast("long")).when(F.col("place") < F.col("cut"), F.col("size"))
        .when(F.col("place") == F.col("cut"), F.floor(F.col("cut_rest") * F.col("size") / F.col("cut_size")))
        .otherwise(F.lit(0).cast("long")))
    return joined.withColumn("part", part)


def mix_report(docs: DataFrame, seed: int = 3) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    Sources in order of code points, null last, weigh 5, 2, 1, repeating. A document's place
    in its source's random order is a hash of doc_id and text, so reruns agree. Whole epochs
    count every document; the last one is cut at the exact budget, where the document under
    the cut gives its first words. Rows equal in doc_id and text share a place and what is
    taken there in proportion. Null and empty texts have size 0 and give nothing; an empty
    table gives none.
    """
    rows = materialize(_ordered(docs.select("doc_id", "source", "text"), seed).select(
        F.struct(F.col("row")["doc_id"].alias("doc_id")).alias("row"), "source", "size", "place", "bin"))
    goal, n = plan(rows)
    return taken(rows, goal, n).select(
        F.col("row")["doc_id"].alias("doc_id"), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, seed: int = 3) -> DataFrame:
    """The mix itself, in the columns of the documents: a row per repeat of each document taken.

    A document under a cut comes once more with its first words only; ``n_chars`` follows.
    Documents of which nothing is taken go; so do null, empty and blank texts. The texts are
    not shuffled: every row is decided by its source's plan alone.
    """
    ordered = _ordered(docs, seed)
    goal, n = plan(materialize(ordered.select("source", "size", "place", "bin")))
    rows = taken(ordered, goal, n).where("size > 0")
    text = F.col("row")["text"]
    repeats = F.array_repeat(F.col("size"), F.col("epochs").cast("int"))
    repeats = F.when(F.col("part") > 0, F.concat(repeats, F.array("part"))).otherwise(repeats)
    rows = rows.withColumn("words", F.explode(repeats))
    rows = rows.withColumn("new", F.when(F.col("words") == F.col("size"), text).otherwise(first_words(text, F.col("words"))))
    values = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(
            F.col("words") == F.col("size"), F.col("row")["n_chars"]).otherwise(F.length("new").cast("long"))
    return replaced(rows, **values)
