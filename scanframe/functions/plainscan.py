"""All finders over an ASCII text in one go, in Arrow batches.

Among ASCII characters the expressions of the catalogue and lower case mean the same in Python
and in column expressions (``functions/regex.py``); other texts are left to those. Hits and flow
facts are those of ``operators/patterns.py``, ``operators/syntax.py`` and ``operators/flow.py``,
without what a combined scan does not show (scores, names of methods, arguments).
"""

from __future__ import annotations

import gc
import itertools
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scanframe import rules as R
from scanframe.functions.needles import searcher
from scanframe.functions.pyfacts import placeless_facts
from scanframe.functions.text import SPACES

HITS = "array<struct<finder:string,rule_id:string,type:string,line_number:int,code_snippet:string>>"
FLOW = "array<struct<seq:int,line:int,role:string,context:string,targets:array<string>,arg_names:array<string>,vars:array<string>>>"
_STRINGS = pa.list_(pa.string())
_HIT = {"finder": pa.string(), "rule_id": pa.string(), "type": pa.string(), "line_number": pa.int32(), "code_snippet": pa.string()}
_FLOW = {"seq": pa.int32(), "line": pa.int32(), "role": pa.string(), "context": pa.string(), "targets": _STRINGS, "arg_names": _STRINGS, "vars": _STRINGS}


def _lines(text: str) -> list[str]:
    return (text[:-1] if text.endswith("\n") else text).split("\n")


def _shown(lines: list[str], line: int, before: int) -> str:
    """The first two of the lines from ``before`` lines above to as many below."""
    first = max(line - before, 1)
    return " ".join(lines[first - 1:min(first + 1, line + before)])


def _mentions(value: str, names: list[str]) -> bool:
    return any(n in value for n in names)


def syntax_hits(facts: list[dict], lines: list[str], shown: frozenset) -> Iterator[tuple]:
    """Hits of ``syntax.python_details`` whose node type is among the shown ones."""
    for f in facts:
        kind, name, found = f["kind"], f.get("name"), None
        if kind == "func":
            found = "InsecureDesign" if name.startswith("_") and not name.startswith("__") else None
        elif kind == "call":
            if name in R.CODE_CALLS:
                found = "CodeInjection"
            elif name in R.SHELL_CALLS and "shell" in f["true_flags"]:
                found = "CommandInjection"
        elif kind == "import":
            found = "InsecureDeserialization" if name in R.OBJECT_MODULES else None
        elif kind == "assign" and f["value"] == "str":
            for target in f["targets"]:
                if "HardcodedCredentials" in shown and _mentions(target.lower(), R.SECRET_NAMES):
                    yield "py_syntax", "syntax.HardcodedCredentials", "HardcodedCredentials", f["line"], _shown(lines, f["line"], 1)
        if found in shown:
            yield "py_syntax", f"syntax.{found}", found, f["line"], _shown(lines, f["line"], 1)


def flow_rows(facts: list[dict], lines: list[str], names: str) -> Iterator[tuple]:
    """Rows of ``flow.flow_facts``."""
    for f in facts:
        assigns = f["kind"] == "assign" and f["value"] == "call"
        if not assigns and f["kind"] != "call":
            continue
        context = f["qual"] if names == "qualified" else f["name"]
        tested = f"{context}(" if names == "qualified" else context
        if not assigns:
            if not (any(a["name"] is not None for a in f["args"]) and _mentions(tested, R.SINKS)):
                continue
            role = "sink"
        else:
            role = "user_input" if _mentions(tested, R.TAINT_SOURCES) else "sanitized" if _mentions(tested, R.SANITIZERS) else "assignment"
        used = [v for a in f["args"] for v in a["vars"]]
        if role == "assignment":
            if not used:
                continue
            context = lines[f["line"] - 1].strip(SPACES) if f["line"] <= len(lines) else ""
        yield f["seq"], f["line"], role, context, f.get("targets", []), [a["name"] for a in f["args"]], used


# What a text with a syntax hit holds in its own spelling.
_SYNTAX = re.compile(r"\b(?:" + "|".join({re.escape(n.split(".")[0]) for n in [*R.CODE_CALLS, *R.SHELL_CALLS, *R.OBJECT_MODULES]}) + r")\b")
_SECRET = re.compile("(?:" + "|".join(R.SECRET_NAMES) + r")\w*(?:[\s)\\]|#[^\n]*\n)*=(?!=)", re.I)
_PRIVATE = re.compile(r"\b_[^_\W]|\b_\b")
_SOURCES, _SINKS = ([[piece for piece in re.split(r"[.()]", name) if piece] for name in names] for names in (R.TAINT_SOURCES, R.SINKS))


def may_have_syntax_hits(text: str) -> bool:
    """False only for a text without any syntax hit: names stand in a text as they are in its tree."""
    return _SYNTAX.search(text) is not None or _SECRET.search(text) is not None or ("def" in text and _PRIVATE.search(text) is not None)


def may_have_flows(text: str) -> bool:
    """False only for a text without any untrusted input or without any sink, which has no flow finding."""
    return all(any(all(piece in text for piece in pieces) for pieces in names) for names in (_SOURCES, _SINKS))


# What lower case would change the meaning of: escapes, named groups, ranges of which one end is a capital.
_CASED = re.compile(r"\\[A-Z0-9xuN]|\(\?P|[A-Z]-[\[-~]|[^A-Z\[]-[A-Z]")


def for_lower_case(pattern: str, flags: str) -> re.Pattern:
    """An expression that finds in a lower-case ASCII text what a case-blind one finds in the text itself.

    It looks for fixed letters, which is far cheaper. Expressions that lower case would change stay case-blind.
    """
    free = "i" in flags and pattern.isascii() and not _CASED.search(pattern)
    return re.compile(pattern.lower() if free else pattern, (0 if free or "i" not in flags else re.I) | (re.S if "s" in flags else 0))


def with_needle(low: str, needle: str, n_lines: int) -> Iterator[int]:
    """Numbers from 0 of the lines that hold a needle."""
    if not needle:
        yield from range(n_lines)
    at = low.find(needle) if needle and "\n" not in needle else -1
    line = begin = 0
    while at >= 0:
        line += low.count("\n", begin, at)
        yield line
        begin = low.find("\n", at)
        at = low.find(needle, begin) if begin >= 0 else -1


def rule_hits(lined: list, literal: list, regexes: list, java: list):
    """Function from (text, lines, whether the Java rules apply) to the hits of the rules of one pass."""
    strings = list(dict.fromkeys(r.pattern.lower() for r in [*lined, *literal]))
    every = [*regexes, *java]
    search = searcher(strings, [r.needs for r in every])
    compiled = [(for_lower_case(r.pattern, r.flags), "i" in r.flags) for r in every]
    needles = {i: [r for r in lined if r.pattern.lower() == s] for i, s in enumerate(strings)}
    wholes = {i: [r for r in literal if r.pattern.lower() == s] for i, s in enumerate(strings)}
    of_java = len(regexes)

    def hits(text: str, lines: list[str], is_java: bool) -> Iterator[tuple]:
        low = text.lower()
        found, possible = search(low)
        for i in found:
            for r in wholes[i]:
                yield "literal", r.rule_id, r.pattern, 1, r.pattern
            if needles[i]:
                for n in with_needle(low, strings[i], len(lines)):
                    for r in needles[i]:
                        yield "line", r.rule_id, r.pattern, n + 1, lines[n].strip(SPACES)
        for i in possible:
            if i >= of_java and not is_java:
                continue
            rule, at, line = every[i], 0, 1
            expression, blind = compiled[i]
            for m in expression.finditer(low if blind else text):
                begin, end = m.span()
                line += text.count("\n", at, begin)
                at = begin
                if i < of_java:
                    matched = text[begin:end]
                    yield "regex", rule.rule_id, matched, line, matched
                else:
                    yield "java_regex", f"syntax.{rule.subcategory}", rule.subcategory, line, _shown(lines, line, 2)

    return hits


def _lists(rows: list[list[tuple]], types: dict) -> pa.ListArray:
    columns = list(zip(*itertools.chain.from_iterable(rows), strict=True)) or [[] for _ in types]
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))
    return pa.ListArray.from_arrays(pa.array(itertools.accumulate(map(len, rows), initial=0), pa.int32()), structs)


def scanned(
    text: Column, is_py: Column, is_java: Column, lined: list, literal: list, regexes: list, java: list, shown: list[str], flow: str | None,
) -> Column:
    """Struct (plain, hits, flow) per text; ``plain`` is false, and nothing found, for what goes beyond ASCII.

    ``shown`` are the node types of syntax hits, ``flow`` says which names flow facts are made with, if any. A text is
    parsed where it may have either; one without untrusted input or without a sink has no flow facts, as it has no flow findings.
    """
    kinds = frozenset(shown)
    if flow not in (None, "short", "qualified"):
        raise ValueError("names must be 'short' or 'qualified'")

    @F.arrow_udf(f"plain boolean, hits {HITS}, flow {FLOW}")
    def scan(texts: pa.Array, pys: pa.Array, javas: pa.Array) -> pa.Array:
        find = rule_hits(lined, literal, regexes, java)
        plain, hits, flows = [], [], []
        collects = gc.isenabled()
        gc.disable()  # as in ``pyfacts.python_facts``
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                for t, py, jv in zip(texts.to_pylist(), pys.to_pylist(), javas.to_pylist(), strict=True):
                    plain.append(t.isascii())
                    found, rows = [], []
                    if plain[-1]:
                        lines = _lines(t)
                        found.extend(find(t, lines, bool(jv)))
                        flows_too = flow and may_have_flows(t)
                        if py and (flows_too or kinds and may_have_syntax_hits(t)):
                            facts = placeless_facts(t)
                            found.extend(syntax_hits(facts, lines, kinds))
                            if flows_too:
                                rows.extend(flow_rows(facts, lines, flow))
                    hits.append(found)
                    flows.append(rows)
        finally:
            if collects:
                gc.enable()
        return pa.StructArray.from_arrays([pa.array(plain, pa.bool_()), _lists(hits, _HIT), _lists(flows, _FLOW)], ["plain", "hits", "flow"])

    return scan(text, is_py, is_java)
