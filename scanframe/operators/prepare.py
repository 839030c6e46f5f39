"""Working columns shared by all finders, each computed once per file row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions import regex, text
from scanframe.functions.needles import prefilter
from scanframe.functions.pyfacts import python_facts
from scanframe.rules import Rule

# Working columns: _text, _low (lower case), _may (rules that can hit), _needles (line rules
# that can hit), _lines, _facts.


def with_text(files: DataFrame, column: str = "content") -> DataFrame:
    body = text.unix_newlines(F.coalesce(F.col(column), F.lit("")))
    return files.withColumn("_text", body).withColumn("_low", F.lower("_text"))


def with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("_lines", text.lines(F.col("_text")))


class Candidates:
    """The rules of one pass, with one search of each text for the strings they depend on."""

    def __init__(self, rules: list[Rule]):
        literals = [r for r in rules if r.kind == "literal"]
        self.strings = list(dict.fromkeys(r.pattern.lower() for r in literals))
        self.regexes = [r for r in rules if r.kind == "regex"]

    def search(self, files: DataFrame, where: Column | None = None) -> DataFrame:
        """Add ``_may``; texts outside the condition ``where`` are not looked at."""
        low = F.col("_low") if where is None else F.when(where, F.col("_low"))
        return files.withColumn("_may", prefilter(low, self.strings, [r.needs for r in self.regexes]))

    def literals(self, rules: list[Rule]) -> Column:
        """Literal rules whose needle occurs: array of (rule_id, needle, literal)."""
        place = {s: i for i, s in enumerate(self.strings)}
        rows = [
            {"rule_id": r.rule_id, "needle": r.pattern.lower(), "literal": r.pattern, "place": place[r.pattern.lower()]}
            for r in rules
        ]
        table = F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,needle:string,literal:string,place:int>>")
        return F.filter(table, lambda r: F.array_contains(F.col("_may.literals"), r["place"]))

    def match_groups(self, rules: list[Rule], only: str = "true") -> Column:
        """Expressions that match, with their matches; ``only`` is an extra SQL condition."""
        wanted = {r.rule_id for r in rules}
        chosen = [(i, r) for i, r in enumerate(self.regexes) if r.rule_id in wanted]
        mine = ", ".join(str(i) for i, _ in chosen)
        places = f"CASE WHEN {only} THEN array_intersect(_may.regexes, array({mine})) ELSE array() END"
        return F.expr(regex.match_groups(places, chosen))


def strict(files: DataFrame) -> str:
    """SQL condition under which syntax analysis looks at a file: its bytes were valid UTF-8."""
    return "is_utf8" if "is_utf8" in files.columns else "true"


def with_facts(files: DataFrame, where: str = "true") -> DataFrame:
    condition = f"lang = 'py' AND {strict(files)} AND {where}"
    return files.withColumn("_facts", python_facts(F.expr(f"CASE WHEN {condition} THEN _text END")))
