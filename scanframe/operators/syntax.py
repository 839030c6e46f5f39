"""Python and Java syntax findings as array columns over one file row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe import rules as R
from scanframe.functions import regex
from scanframe.functions.rows import let, unnest
from scanframe.operators import prepare
from scanframe.operators.patterns import hit, spans


def around(lines: Column, line: Column, before: int, after: int) -> Column:
    """Lines ``line - before .. line + after`` of the file, clipped at both ends."""
    first = F.greatest(line - before, F.lit(1))
    return F.slice(lines, first, line + after - first + 1)


def _detail(kind: str, fn, cls, variables, chain, score, context, line) -> Column:
    strings = "array<string>"
    return F.struct(
        F.lit(kind).alias("node_type"), fn.cast("string").alias("function_name"), cls.cast("string").alias("class_name"),
        F.coalesce(variables, F.array()).cast(strings).alias("variables_used"),
        F.coalesce(chain, F.array()).cast(strings).alias("call_chain"),
        F.lit(score).cast("int").alias("complexity_score"), context.alias("context_lines"),
        line.cast("int").alias("line_number"))


def _plain_args(f: Column) -> Column:
    return F.filter(F.transform(f["args"], lambda a: a["name"]), lambda n: n.isNotNull())




def python_details(sql_formatting: bool = False) -> Column:
    """Findings from ``_facts``. ``sql_formatting`` adds the opt-in check of ``%`` in SQL calls."""
    return let(F.col("_lines"), lambda lines: _python_details(lines, sql_formatting))


def _python_details(lines: Column, sql_formatting: bool) -> Column:
    facts = F.col("_facts")
    none = F.array().cast("array<string>")

    def _py_detail(f: Column, kind: str, variables: Column) -> Column:
        context = around(lines, f["line"], 1, 1)
        return _detail(kind, f["fn"], f["cls"], variables, f["chain"], R.PY_SCORES[kind], context, f["line"])

    def pick(condition, make):
        return F.transform(F.filter(facts, condition), make)

    secret_target = lambda t: reduce(or_, [F.contains(F.lower(t), F.lit(n)) for n in R.SECRET_NAMES])
    parts = [
        pick(lambda f: (f["kind"] == "func") & F.startswith(f["name"], F.lit("_")) & ~F.startswith(f["name"], F.lit("__")),
             lambda f: _py_detail(f, "InsecureDesign", none)),
        pick(lambda f: (f["kind"] == "call") & f["name"].isin(R.CODE_CALLS),
             lambda f: _py_detail(f, "CodeInjection", _plain_args(f))),
        pick(lambda f: (f["kind"] == "call") & f["name"].isin(R.SHELL_CALLS) & F.array_contains(f["true_flags"], "shell"),
             lambda f: _py_detail(f, "CommandInjection", _plain_args(f))),
        pick(lambda f: (f["kind"] == "import") & f["name"].isin(R.OBJECT_MODULES),
             lambda f: _py_detail(f, "InsecureDeserialization", F.array(f["name"]))),
        F.flatten(pick(
            lambda f: (f["kind"] == "assign") & (f["value"] == "str"),
            lambda f: F.transform(F.filter(f["targets"], secret_target),
                                  lambda t: _py_detail(f, "HardcodedCredentials", F.array(t))))),
    ]
    if sql_formatting:
        attr = lambda f: F.substring_index(f["name"], ".", -1)
        hot = lambda f: F.filter(f["args"], lambda a: a["percent"])
        parts.append(pick(
            lambda f: (f["kind"] == "call") & attr(f).isin(R.SQL_CALLS) & F.contains(f["qual"], F.lit("."))
            & (F.size(hot(f)) > 0),
            lambda f: _detail("SQLInjection", attr(f), F.lit(None), F.get(hot(f), F.lit(0))["vars"], F.array(attr(f)),
                              R.PY_SCORES["SQLInjection"], around(lines, f["line"], 2, 2), f["line"])))
    return F.concat(*parts)


# --- Java ------------------------------------------------------------------------------

_JAVA = R.rule_rows("java")


def _plain(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def _names(lines: Column, needle: str, pattern: str, group: int) -> Column:
    """The capture of each line, empty where there is none; ``needle`` is in every line that has one."""
    take = lambda s, plain: F.regexp_extract(s, regex.dialect(pattern, "", plain), group)
    return F.transform(lines, lambda s: F.when(~F.contains(s, F.lit(needle)), "").when(_plain(s), take(s, True)).otherwise(take(s, False)))


def _nearest(names: Column, line: Column, depth: int) -> Column:
    """First name at or above ``line`` among ``depth`` lines; line 1 is never looked at."""
    first = F.greatest(line - (depth - 1), F.lit(2))
    window = F.slice(names, first, F.greatest(line - first + 1, F.lit(0)))
    return F.try_element_at(F.filter(window, lambda name: name != ""), F.lit(-1))


def java_variables(matched: Column) -> Column:
    """Identifiers of the matched text in order, without six keywords."""
    names = lambda edge: F.regexp_extract_all(
        matched, F.lit(f"(?<!{edge})[a-zA-Z_][a-zA-Z0-9_]*(?!{edge})"), F.lit(0))
    found = F.when(_plain(matched), names(regex.ASCII_WORD)).otherwise(names(regex.WORD))
    return F.filter(found, lambda n: ~n.isin(R.JAVA_KEYWORDS))


def java_details(span_array: Column) -> Column:
    """Java findings from spans of the Java rules; needs ``_lines``.

    Names of methods and classes are taken once from each line of a file with findings.
    """
    node_type = F.create_map(*[F.lit(x) for r in _JAVA for x in (r.rule_id, r.subcategory)])
    score = F.create_map(*[F.lit(x) for kv in R.JAVA_SCORES.items() for x in kv])
    none = F.array().cast("array<string>")

    def one(s: Column, lines: Column, methods: Column, classes: Column) -> Column:
        kind = F.try_element_at(node_type, s["rule_id"])
        return F.struct(
            kind.alias("node_type"),
            _nearest(methods, s["line"], 19).alias("function_name"),
            _nearest(classes, s["line"], 49).alias("class_name"),
            java_variables(s["matched"]).alias("variables_used"),
            none.alias("call_chain"),
            F.coalesce(F.try_element_at(score, kind), F.lit(R.DEFAULT_SCORE)).cast("int").alias("complexity_score"),
            around(lines, s["line"], 2, 2).alias("context_lines"),
            s["line"].cast("int").alias("line_number"))

    def of_file(found: Column, lines: Column) -> Column:
        methods, classes = _names(lines, "(", R.JAVA_METHOD, 2), _names(lines, "class", R.JAVA_CLASS, 1)
        details = let(methods, lambda m: let(classes, lambda c: F.transform(found, lambda s: one(s, lines, m, c))))
        return F.when(F.size(found) > 0, details).otherwise(F.transform(found, lambda s: one(s, lines, none, none)))

    return let(F.col("_lines"), lambda lines: let(span_array, lambda found: of_file(found, lines)))


def detail_hits(finder: str, details: Column, prefix: str = "syntax.") -> Column:
    """Syntax details -> hits; snippet = first two context lines."""
    return F.transform(details, lambda d: hit(
        finder, F.concat(F.lit(prefix), d["node_type"]), d["node_type"], d["line_number"],
        F.array_join(F.slice(d["context_lines"], 1, 2), " ")))


# --- DataFrame operators ----------------------------------------------------------------


def python_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("lang") == "py")


def fact_rows(files: DataFrame, keep=("path", "project")) -> DataFrame:
    """The fact table: one row per relevant syntax node of each Python file."""
    df = prepare.with_facts(prepare.with_text(python_files(files)))
    return unnest(df, list(keep), F.col("_facts"), "kind")


def scan_python(files: DataFrame, sql_formatting: bool = False) -> DataFrame:
    df = prepare.with_lines(prepare.with_facts(prepare.with_text(python_files(files))))
    return unnest(df, ["path", "project"], python_details(sql_formatting), "node_type")


def scan_java(files: DataFrame) -> DataFrame:
    df = prepare.with_text(files.where(F.col("lang") == "java"))
    may = prepare.Candidates(_JAVA)
    found = java_details(spans(may.match_groups(_JAVA, prepare.strict(files))))
    return unnest(may.search(prepare.with_lines(df)), ["path", "project"], found, "node_type")


def scan_syntax(files: DataFrame) -> DataFrame:
    """Both languages in one pass; files of any other language give nothing."""
    df = prepare.with_lines(prepare.with_facts(prepare.with_text(files.where(F.col("lang").isin("py", "java")))))
    may = prepare.Candidates(_JAVA)
    java = java_details(spans(may.match_groups(_JAVA, f"lang = 'java' AND {prepare.strict(files)}")))
    return unnest(may.search(df), ["path", "project"], F.concat(python_details(), java), "node_type")
