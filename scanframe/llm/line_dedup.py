"""Line deduplication: repeated windows of three lines, found globally, later occurrences removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.functions.cluster import materialize
from scanframe.llm.common import keyed, replaced

WINDOW = 3


def line_windows(rows: DataFrame) -> DataFrame:
    """Every window of three consecutive lines: (key, mark, pos, h1, h2).

    Two independent 64-bit hashes stand for the lines of a window; one alone would collide at
    10^12 lines. Windows of blank lines only are no windows.
    """
    lines = rows.select("key", "mark", F.split(F.col("row")["text"], "\n").alias("lines"))
    lines = lines.where(F.size("lines") >= WINDOW)

    def hashed(i):
        a, b, c = (F.get(F.col("lines"), i + k) for k in range(WINDOW))
        return F.struct(
            i.cast("int").alias("pos"), F.xxhash64(a, b, c).alias("h1"),
            F.xxhash64(F.lit(7), c, b, a).alias("h2"), (F.trim(F.concat(a, b, c)) == "").alias("blank"))

    starts = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    out = lines.select("key", "mark", F.explode(F.transform(starts, hashed)).alias("w")).select("key", "mark", "w.*")
    return out.where("not blank").drop("blank")


def covered_lines(windows: DataFrame) -> DataFrame:
    """Positions covered by later occurrences of repeated windows: (key, mark, covered).

    The first occurrence in order of document and position stays. Counting is pre-aggregated
    per task; the occurrences of a very common window meet only in a join against one row,
    whose large side the adaptive planner can split.
    """
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("key", "mark", "pos")).alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1").select("h1", "h2", "first"))
    later = windows.join(first, ["h1", "h2"]).where(F.struct("key", "mark", "pos") != F.col("first"))
    return later.groupBy("key", "mark").agg(F.collect_set("pos").alias("starts")).select(
        "key", "mark",
        F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(WINDOW)])))).alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with the lines covered by later occurrences removed from ``text``; ``n_chars`` follows.

    Lines are the parts between newlines and compare exactly. Of a window of three consecutive
    lines that occurs more than once anywhere, the first occurrence (by doc_id, null as 0, then
    place) stays; every line under a later one goes. Overlaps merge. Every distinct line keeps
    an occurrence, as what replaces a removed line always comes earlier. Defined cases: null text
    stays null; texts of fewer than three lines have no window and stay as they are; a text all
    of whose lines go becomes empty, its row stays; rows equal in doc_id and text are one
    document and get the same result; all other columns, whatever their names, pass through.
    """
    marked = _marked(docs)
    values = {"text": F.col("left_text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(
            F.col("covered").isNull(), F.col("row")["n_chars"]).otherwise(F.length("left_text").cast("long"))
    return replaced(marked, **values)


def _marked(docs: DataFrame) -> DataFrame:
    """``row``, ``covered`` (null: nothing goes) and ``left_text``; linear in the lines of a text."""
    rows = keyed(docs)
    removed = covered_lines(materialize(line_windows(rows)))
    marked = rows.join(removed, ["key", "mark"], "left")
    text = F.col("row")["text"]
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return marked.withColumn("left_text", F.when(F.col("covered").isNull(), text).otherwise(left))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text without the removed lines, n_lines before, n_removed."""
    text = F.col("row")["text"]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    return _marked(docs.select("doc_id", "text")).select(
        F.col("row")["doc_id"].alias("doc_id"), F.col("left_text").alias("text"), n_lines.alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"))
