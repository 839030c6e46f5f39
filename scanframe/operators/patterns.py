"""Literal and regular expression scans as array columns over one file row.

Each ``*_hits`` function returns an array of HIT structs, so that any set of finders can be
concatenated and exploded in one pass over the files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scanframe.functions import regex, text
from scanframe.functions.cluster import materialize
from scanframe.functions.grams import GRAM, Sieve, pieces
from scanframe.functions.rows import let, unnest
from scanframe.operators.prepare import Candidates, with_lines, with_text
from scanframe.rules import Rule, owasp_rules, rule_rows, rules_frame

HIT = "finder string, rule_id string, type string, line_number int, code_snippet string"


def hit(finder: str, rule_id: Column, kind: Column, line: Column, snippet: Column) -> Column:
    return F.struct(
        F.lit(finder).alias("finder"), rule_id.alias("rule_id"), kind.alias("type"),
        line.cast("int").alias("line_number"), snippet.alias("code_snippet"))


def line_hits() -> Column:
    """Needles per line; needs ``_needles`` and ``_lines``. One hit per (line, rule)."""

    def in_file(needles: Column) -> Column:
        def on_line(line: Column, i: Column) -> Column:
            found = let(F.lower(line), lambda low: F.filter(needles, lambda r: F.contains(low, r["needle"])))
            return F.transform(found, lambda r: hit("line", r["rule_id"], r["literal"], i + 1, text.strip(line)))

        return F.when(F.size(needles) > 0, F.flatten(F.transform(F.col("_lines"), on_line)))

    return let(F.col("_needles"), in_file)


def literal_hits(found: Column) -> Column:
    """At most one hit per (file, rule), reported at line 1."""
    return F.transform(
        found,
        lambda r: hit("literal", r["rule_id"], r["literal"], F.lit(1), r["literal"]))


def spans(groups: Column) -> Column:
    """Array of (rule_id, matched, start, end, line) over all matching rules."""
    return F.flatten(F.transform(groups, lambda g: F.transform(
        regex.positions(g["texts"], g["gaps"]),
        lambda p: F.struct(g["rule_id"].alias("rule_id"), p["matched"].alias("matched"), p["start"].alias("start"),
                           p["end"].alias("end"), p["line"].alias("line")))))


def regex_hits(span_array: Column) -> Column:
    return F.transform(span_array, lambda s: hit("regex", s["rule_id"], s["matched"], s["line"], s["matched"]))


# --- the same scans as DataFrame operators ---------------------------------------------


def scan_lines(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Line literal scan of a files table."""
    rules = rule_rows("basic") if rules is None else rules
    may = Candidates(rules)
    df = may.search(with_lines(with_text(files))).withColumn("_needles", may.literals(rules))
    return unnest(df, ["path", "project"], line_hits(), "rule_id")


def match_literals(df: DataFrame, text_col: str = "content", rules: list[Rule] | None = None) -> DataFrame:
    """Content literal scan; keeps the input columns other than the text."""
    rules = owasp_rules(kind="literal") if rules is None else rules
    keep = [c for c in df.columns if c != text_col]
    if not rules:
        return df.where(F.lit(False)).select(*keep, F.lit("").alias("rule_id"), F.lit("").alias("matched"))
    may = Candidates(rules)
    return unnest(may.search(with_text(df, text_col)), keep, may.literals(rules), "rule_id").select(
        *keep, "rule_id", F.col("literal").alias("matched"))


def match_regexes(df: DataFrame, text_col: str = "content", rules: list[Rule] | None = None) -> DataFrame:
    """Content regular expression scan: every match with its text, offsets and line."""
    rules = owasp_rules(kind="regex") if rules is None else rules
    keep = [c for c in df.columns if c != text_col]
    if not rules:
        return df.where(F.lit(False)).select(
            *keep, F.lit("").alias("rule_id"), F.lit("").alias("matched"), F.lit(0).alias("match_start"),
            F.lit(0).alias("match_end"), F.lit(0).alias("line_start"))
    may = Candidates(rules)
    groups = unnest(may.search(with_text(df, text_col)), keep, may.match_groups(rules), "rule_id")
    return unnest(groups, [*keep, "rule_id"], regex.positions(F.col("texts"), F.col("gaps")), "line").select(
        *keep, "rule_id", "matched", F.col("start").alias("match_start"), F.col("end").alias("match_end"),
        F.col("line").alias("line_start"))


def scan_text(
    df: DataFrame, text_col: str, name_col: str | None = None, category: str | None = None,
    rules: list[Rule] | None = None,
) -> DataFrame:
    """Scan any text column: literal and regex matches with rule details and a name.

    A missing name reads 'unknown'; literal matches have no offsets. ``category`` limits the
    rules before anything is planned, an unknown category gives no rows.
    """
    rules = owasp_rules(category) if rules is None else [r for r in rules if category in (None, r.category)]
    name = F.coalesce(F.col(name_col).cast("string"), F.lit("unknown")) if name_col else F.lit("unknown")
    src = df.select(name.alias("filename"), F.col(text_col).alias("content"))
    literal = [r for r in rules if r.kind == "literal"]
    regexes = [r for r in rules if r.kind == "regex"]
    may = Candidates(rules)
    src = may.search(with_text(src))
    empty = "array<struct<rule_id:string,matched:string,start:int,end:int,line:int>>"
    parts = [F.from_json(F.lit("[]"), empty)]
    if literal:
        parts.append(F.transform(
            may.literals(literal),
            lambda r: F.struct(r["rule_id"].alias("rule_id"), r["literal"].alias("matched"),
                               F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
                               F.lit(None).cast("int").alias("line"))))
    if regexes:
        parts.append(spans(may.match_groups(regexes)))
    found = unnest(src, ["filename"], F.concat(*parts), "rule_id")
    about = rules_frame(df.sparkSession, rules).select(
        "rule_id", "category", "subcategory", "severity", "description", "remediation", "cwe_ids")
    return found.join(F.broadcast(about), "rule_id").select(
        "filename", "rule_id", "category", "subcategory", F.col("matched").alias("pattern"), "severity",
        "description", "remediation", "cwe_ids", F.col("line").alias("line_start"),
        F.col("start").alias("match_start"), F.col("end").alias("match_end"))


FOUND_ROWS = 200_000  # that a task holds before it hands them on
TESTED = 10_000  # patterns that meet a text at a time
SALTS = 64  # parts over which rules that match every text are spread


def _sieve(hashed: DataFrame, column: str, per_hash: int, least: int, most: int) -> Sieve:
    """The hashes of a column as bits, about ``per_hash`` for each within 2^least to 2^most.

    Bits are put together by tasks; the driver gets words of 64 bits, at most 2^(most - 6).
    Beyond that size more of what is no member passes, and is dropped by the join that follows.
    """
    n = hashed.agg(F.approx_count_distinct(column)).first()[0]
    power = min(max((n * per_hash).bit_length(), least), most)
    slot = F.shiftrightunsigned(column, 64 - power)
    words = hashed.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - power}) & 63 as int))")).alias("word"))
    return Sieve(power, {r["at"]: r["word"] for r in words.collect()})


def _counted_in(sieve: Sieve, lengths: list[int]):
    """Texts to (slot, n): in how many texts of the task a piece of that slot occurs."""

    def run(batches):
        n = np.zeros(len(sieve.bits) * 64, np.int64)
        for batch in batches:
            for t in batch.column("_low"):
                n[np.unique(sieve.slots(sieve.of(t.as_py() or "", lengths)))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    return run


def _joined(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["_text_id", "_anchor"])


def _found_in(sieve: Sieve, lengths: list[int]):
    """Texts to (_text_id, _anchor) of the pieces that pass."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for i, t in zip(batch.column("_text_id").to_pylist(), batch.column("_low"), strict=True):
                h = sieve.of(t.as_py() or "", lengths)
                held.append((np.full(len(h), i, np.int64), h))
                n += len(h)
                if n >= FOUND_ROWS:
                    yield _joined(held)
                    held, n = [], 0
        if n:
            yield _joined(held)

    return run


def _tested(joined: StructType):
    """(path, _low, tested) to (path, rule_id, pattern) of the patterns that the text holds."""
    paths = to_arrow_schema(joined).field("path").type

    def run(batches):
        for batch in batches:
            for path, text, tested in zip(*(batch.column(c) for c in ("path", "_low", "tested")), strict=True):
                rules, body = tested.values, text.as_py()
                hits = [i for i, needle in enumerate(rules.field("needle").to_pylist()) if needle in body]
                if hits:
                    rules = rules.take(pa.array(hits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()] * len(hits), paths), rules.field("rule_id"), rules.field("pattern")], ["path", "rule_id", "pattern"])

    return run


def match_rule_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Content literal scan with a rule table of any size supplied by the user (rule_id, pattern, ...).

    Every pattern is looked up by its rarest piece of six letters (shorter patterns by
    themselves). A first pass over the texts counts in how many of them the pieces of the rules
    occur, in slots that a task adds up before it sends them; a second one lets only pieces
    through that are anchors. Ids of texts meet rules where an anchor occurs; a text then gets
    what it is to be tested for, some thousand patterns at a time. Counts only choose the anchor, so that slots with several pieces
    cannot change the result. Patterns that are empty match every text, null ones none.
    """
    texts = materialize(with_text(files).select("path", "_low").withColumn("_text_id", F.monotonically_increasing_id()))
    wanted = rules.where("kind = 'literal' and pattern is not null").select("rule_id", "pattern", F.lower("pattern").alias("_needle"))
    everywhere = _match_everything(texts, wanted.where("_needle = ''"))
    wanted = wanted.where("_needle <> ''").withColumn("_rule", F.monotonically_increasing_id())
    wanted = materialize(wanted.withColumn("_pieces", F.arrow_udf(pieces, "array<bigint>")(F.col("_needle"))))
    lengths = sorted(r[0] for r in wanted.select(F.least(F.length("_needle"), F.lit(GRAM))).distinct().collect())  # 1 to GRAM
    if not lengths:
        return everywhere
    of_rules = wanted.select("_rule", F.explode("_pieces").alias("_piece"))
    known = _sieve(of_rules, "_piece", 8, 16, 22)
    seen = texts.select("_low").mapInArrow(_counted_in(known, lengths), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counted = of_rules.withColumn("slot", F.shiftrightunsigned("_piece", int(known.shift))).join(seen, "slot", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_piece"))
    # a pattern one of whose pieces was never seen cannot match
    anchors = materialize(counted.groupBy("_rule").agg(rarest.alias("r")).where("r.n > 0").select("_rule", F.col("r._piece").alias("_anchor")))
    if anchors.isEmpty():
        return everywhere
    passing = _sieve(anchors, "_anchor", 32, 18, 24)
    grams = texts.select("_text_id", "_low").mapInArrow(_found_in(passing, lengths), "_text_id long, _anchor long")
    share = F.ceil(F.lit(wanted.count()) / F.lit(TESTED)).cast("int")
    rule = F.struct(F.col("_needle").alias("needle"), "rule_id", "pattern")
    anchored = anchors.join(wanted, "_rule").select("_anchor", F.pmod(F.xxhash64("_rule"), share).alias("_share"), rule.alias("_tested"))
    maybe = grams.join(anchored, "_anchor").groupBy("_text_id", "_share").agg(F.collect_list("_tested").alias("tested"))
    joined = texts.join(maybe, "_text_id").select("path", "_low", "tested")
    found = joined.mapInArrow(_tested(joined.schema), joined.select("path", F.explode("tested").alias("t")).select("path", "t.rule_id", "t.pattern").schema)
    return found.unionByName(everywhere)


def _match_everything(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every text with every rule, in parts by text."""
    spread = rules.select("rule_id", "pattern", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return texts.select("path", F.pmod(F.xxhash64("_text_id"), F.lit(SALTS)).cast("int").alias("_salt")).join(spread, "_salt").select(
        "path", "rule_id", "pattern")


def statistics(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """Texts scanned (clean ones too) and matches found."""
    n_files = texts.agg(F.count("*").alias("files_scanned"))
    n_found = matches.agg(F.count("*").alias("vulnerabilities_found"))
    return n_files.crossJoin(n_found)  # one row each
