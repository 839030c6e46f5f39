"""Regular expressions on whole texts: dialect and match positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanframe.functions.rows import let
from scanframe.functions.text import newlines

# \s and \w as explicit classes, so that they cover the same characters everywhere.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
WORD = r"[\p{L}\p{N}_]"
ASCII_SPACE, ASCII_WORD = r"[\t-\r\x1C-\x20]", "[A-Za-z0-9_]"  # the same among ASCII characters, far cheaper to test
MARK, END = "\x01", "\x02"  # around a match; texts that contain them themselves take the slower way
BLOCK = 128  # matches per block of the two-level running sum


def dialect(pattern: str, flags: str = "i", plain: bool = False) -> str:
    """Rule expression -> java.util.regex: '.' stops at \\n only, case folding is Unicode.

    ``plain`` gives one that finds the same in ASCII texts only, unless the expression itself goes beyond ASCII.
    """
    plain = plain and pattern.isascii() and not re.search(r"\\[uxpPN0c]", pattern)
    fold = "" if "i" not in flags else "i" if plain else "iu"
    prefix = "(?d" + fold + ("s" if "s" in flags else "") + ")"
    space, word = (ASCII_SPACE, ASCII_WORD) if plain else (SPACE, WORD)
    return prefix + pattern.replace(r"\s", space).replace(r"\w", word)


# Expressions over many rules are SQL text: one call per plan instead of dozens per rule.


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_place(rules, value) -> str:
    """Search by halves for the place ``k`` of a rule; patterns stay constants, so each is compiled once."""
    if len(rules) == 1:
        return value(rules[0][1])
    half = len(rules) // 2
    return f"CASE WHEN k < {rules[half][0]} THEN {_by_place(rules[:half], value)} ELSE {_by_place(rules[half:], value)} END"


def match_groups(places: str, rules: list) -> str:
    """Rules that match ``_text``: array of (rule_id, texts, gaps).

    ``places`` is an array of the places to try and ``rules`` lists (place, rule) by place. ``gaps``
    holds length and newline count of the text before each match and after the last one.

    A text is gone through once by each expression, which puts marks around its matches; texts
    with such characters of their own are gone through twice.
    """
    known = dict(rules)
    ids = "element_at(array(" + ", ".join(f"'{known[i].rule_id}'" if i in known else "''" for i in range(max(known) + 1)) + "), k + 1)"

    def of(call):
        return _by_place(rules, lambda r: call(sql_string(dialect(r.pattern, r.flags))))

    def marked(r):
        calls = [f"regexp_replace(_text, {sql_string(dialect(r.pattern, r.flags, plain))}, '{MARK}$0{END}')" for plain in (True, False)]
        return calls[0] if calls[0] == calls[1] else f"CASE WHEN kind = 0 THEN {calls[0]} ELSE {calls[1]} END"

    nl = "length(g) - length(replace(g, '\\n', ''))"
    gap = f"named_struct('len', length(g), 'nl', {nl})"
    fast = (
        f"transform(filter(transform(places, k -> named_struct('rule_id', {ids}, 'marked', {_by_place(rules, marked)})), "
        f"h -> contains(h.marked, '{MARK}')), h -> element_at(transform(array(split(h.marked, '{MARK}', -1)), p -> named_struct("
        f"'rule_id', h.rule_id, 'texts', transform(slice(p, 2, size(p) - 1), g -> substring_index(g, '{END}', 1)), "
        f"'gaps', transform(transform(p, g -> substring_index(g, '{END}', -1)), g -> {gap}))), 1))")
    texts, parted = of(lambda p: f"regexp_extract_all(_text, {p}, 0)"), of(lambda p: f"split(_text, {p}, -1)")
    # split() compiles its pattern for every row; replacing matches by a mark does not
    once = of(lambda p: f"regexp_replace(_text, {p}, '{MARK}')")
    parts = f"CASE WHEN contains(_text, '{MARK}') THEN {parted} ELSE split({once}, '{MARK}', -1) END"
    slow = (
        f"transform(filter(transform(places, k -> named_struct('k', k, 'rule_id', {ids}, 'texts', {texts})), h -> size(h.texts) > 0), "
        f"h -> named_struct('rule_id', h.rule_id, 'texts', h.texts, "
        f"'gaps', transform(element_at(transform(array(h.k), k -> {parts}), 1), g -> {gap})))")
    kind = f"CASE WHEN contains(_text, '{MARK}') OR contains(_text, '{END}') THEN 2 WHEN octet_length(_text) = length(_text) THEN 0 ELSE 1 END"
    either = f"CASE WHEN kind = 2 THEN {slow} ELSE {fast} END"
    bound = f"element_at(transform(array({kind}), kind -> {either}), 1)"
    return f"element_at(transform(array({places}), places -> CASE WHEN size(places) > 0 THEN {bound} ELSE array() END), 1)"


def _add(acc: Column, piece: Column) -> Column:
    return F.struct((acc["len"] + piece["len"]).alias("len"), (acc["nl"] + piece["nl"]).alias("nl"))


def _sum(pieces: Column) -> Column:
    return F.aggregate(pieces, F.expr("named_struct('len', 0, 'nl', 0)"), _add)


def positions(texts: Column, gaps: Column) -> Column:
    """Zip match texts with the gaps before them into (matched, start, end, line).

    Offsets count code points from 0, lines count from 1. Running sums are kept per block
    of matches, so that a text with very many matches stays far from quadratic cost.
    """
    pieces = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(texts)),
        texts,
        lambda g, m: F.struct(
            m.alias("matched"), g["len"].alias("gap_len"), g["nl"].alias("gap_nl"),
            (g["len"] + F.length(m)).alias("len"), (g["nl"] + newlines(m)).alias("nl")),
    )

    def from_pieces(p: Column) -> Column:
        n_blocks = F.ceil(F.size(p) / F.lit(BLOCK)).cast("int")
        block_sums = F.transform(
            F.sequence(F.lit(0), n_blocks - 1), lambda b: _sum(F.slice(p, b * BLOCK + 1, F.lit(BLOCK))))

        def from_sums(sums: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: _sum(F.slice(sums, F.lit(1), b)))

            def from_before(off: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    b = F.floor(i / F.lit(BLOCK)).cast("int")
                    inside = _sum(F.slice(p, b * BLOCK + 1, i - b * BLOCK))

                    def span(head: Column) -> Column:
                        o = F.get(off, b)
                        start = o["len"] + head["len"] + x["gap_len"]
                        return F.struct(
                            x["matched"].alias("matched"),
                            start.alias("start"),
                            (o["len"] + head["len"] + x["len"]).alias("end"),
                            (o["nl"] + head["nl"] + x["gap_nl"] + 1).alias("line"),
                        )

                    return let(inside, span)

                return F.transform(p, one)

            return let(before, from_before)

        return let(block_sums, from_sums)

    def only(p: Column) -> Column:
        x = F.get(p, F.lit(0))
        return F.array(F.struct(
            x["matched"].alias("matched"), x["gap_len"].alias("start"), x["len"].alias("end"), (x["gap_nl"] + 1).alias("line")))

    return let(pieces, lambda p: F.when(F.size(p) == 1, only(p)).otherwise(from_pieces(p)))
