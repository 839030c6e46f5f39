"""The registered queries as SQL over the given tables, for a second engine to check.

Written independently of the operators: plain joins over lines, matches found by splitting,
and closed forms (which snippet gives which finding) for the syntax and flow analysis.
"""

from __future__ import annotations

from itertools import pairwise

from scanframe import rules as R
from scanframe.functions.text import SPACES
from scanframe.operators import reports
from scanframe.plans import corpus

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The ten expressions with a look-ahead: the part before it, and what must not follow.
_AHEAD = {
    "A01-authz.rx1": (r"(?!\s*\([^)]*authorize)", r"(?i)^\s*\([^)]*authorize"),
    "A01-authz.rx2": (r"(?!\s*\([^)]*login_required)", r"(?i)^\s*\([^)]*login_required"),
    "A01-authz.rx3": (r"(?!.*@login_required)", r"(?is)^.*@login_required"),
    "A02-cipher.rx2": (r"(?!cription|crypt)", r"(?i)^(cription|crypt)"),
    "A02-cipher.rx3": (r"(?!graphy)", r"(?i)^graphy"),
    "A07-login.rx1": (r"(?![\$\{])", None),
    "A08-objects.rx2": (r"(?!Loader=yaml\.SafeLoader)", None),
    "A09-logging.rx1": (r"(?!.*log)", r"(?i)^[^\n]*log"),
    "A09-logging.rx2": (r"(?!.*audit)", r"(?i)^[^\n]*audit"),
    "A09-logging.rx3": (r"(?!.*log)", r"(?i)^[^\n]*log"),
}


def _q(s: str) -> str:
    if "\n" in s or "\t" in s:
        raise ValueError("control character in SQL text")
    return "'" + s.replace("'", "''") + "'"


def _re(pattern: str, flags: str = "") -> str:
    prefix = "(?" + ("i" if "i" in flags else "") + ("s" if "s" in flags else "-s") + ")"
    return _q(prefix + pattern.replace(r"\s", _SPACE).replace(r"\w", r"[\pL\pN_]"))


def _strip(expr: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in SPACES)
    return f"trim({expr}, {chars})"


# --- shared table expressions -------------------------------------------------------------
_RAW = corpus.files_sql("list_transform(range(1, {n} + 1), lambda i: {body})", "array_to_string({array}, chr(10))")
RAW_FILES = f"raw_files AS ({_RAW})"
FILES = (
    f"{RAW_FILES}, files AS (SELECT path, project, lang, ts, replace(content, chr(13) || chr(10), chr(10)) AS content "
    "FROM raw_files)")
DOCS = "files AS (SELECT doc_id AS path, text AS content FROM documents)"
TEXTS = f"{FILES}, texts AS (SELECT path, content FROM files UNION ALL SELECT concat('doc:', doc_id), text FROM documents)"
_N_LINES = (
    "(length({0}) - length(replace({0}, chr(10), '')) + "
    "CASE WHEN {0} <> '' AND right({0}, 1) <> chr(10) THEN 1 ELSE 0 END)")


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _literal_rules(name: str, rules: list[R.Rule]) -> str:
    return _values(name, "rule_id, literal", [(r.rule_id, r.pattern) for r in rules if r.kind == "literal"])


def _rule_table(rules: list[R.Rule], name: str = "rule_table") -> str:
    rows = [(r.rule_id, r.ruleset, r.category, r.subcategory, r.kind, r.pattern, r.severity, r.description, r.remediation,
             ",".join(map(str, r.cwe_ids))) for r in rules]
    return _values(name, "rule_id, ruleset, category, subcategory, kind, pattern, severity, description, remediation, cwe", rows)


def _literals(name: str, rules: list[R.Rule], src: str = "files") -> str:
    return (
        f"{_literal_rules(name + '_rules', rules)}, {name} AS (SELECT s.path, r.rule_id, r.literal AS matched "
        f"FROM {src} s JOIN {name}_rules r ON contains(lower(s.content), lower(r.literal)))")


def _line_hits(rules: list[R.Rule], src: str = "files") -> str:
    return (
        f"{_literal_rules('line_rules', rules)}, "
        f"src_lines AS (SELECT path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM {src}), "
        "all_lines AS (SELECT path, line_no, string_split(content, chr(10))[line_no] AS line FROM src_lines), "
        f"line_hits AS (SELECT l.path, r.rule_id, r.literal AS type, CAST(l.line_no AS INTEGER) AS line_number, "
        f"{_strip('l.line')} AS code_snippet FROM all_lines l JOIN line_rules r ON contains(lower(l.line), lower(r.literal)))")


def _regexes(name: str, rules: list[R.Rule], src: str = "files") -> str:
    """Matches with text, offsets and line, by zipping matches with the gaps between them."""
    parts = []
    for r in rules:
        if r.kind != "regex":
            continue
        ahead, bad = _AHEAD.get(r.rule_id, ("", None))
        base = r.pattern.replace(ahead, "") if ahead else r.pattern
        p = _re(base, r.flags)
        parts.append(
            f"SELECT path, content, {_q(r.rule_id)} AS rule_id, {_re_plain(bad) if bad else 'NULL'} AS bad, "
            f"regexp_extract_all(content, {p}) AS ms, string_split_regex(content, {p}) AS gs "
            f"FROM {src} WHERE regexp_matches(content, {p})")
    union = " UNION ALL ".join(parts)
    return (
        f"{name}_raw AS ({union}), "
        f"{name}_at AS (SELECT path, content, rule_id, bad, ms[i] AS matched, "
        "CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) "
        "+ coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) AS INTEGER) AS match_start "
        f"FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_raw) u), "
        f"{name} AS (SELECT path, rule_id, matched, match_start, match_start + CAST(length(matched) AS INTEGER) AS match_end, "
        "CAST(1 + length(left(content, match_start)) - length(replace(left(content, match_start), chr(10), '')) AS INTEGER) AS line_start "
        f"FROM {name}_at WHERE bad IS NULL OR NOT regexp_matches(substring(content, match_start + length(matched) + 1), bad))")


def _re_plain(pattern: str) -> str:
    return _q(pattern.replace(r"\s", _SPACE))


def _scan(rules: list[R.Rule], src: str = "files") -> str:
    """Literal and regex matches with rule details."""
    parts, ctes = [], [_rule_table(rules)]
    if any(r.kind == "literal" for r in rules):
        ctes.append(_literals("lits", rules, src))
        parts.append("SELECT path, rule_id, matched, CAST(NULL AS INTEGER) AS line_start, "
                     "CAST(NULL AS INTEGER) AS match_start, CAST(NULL AS INTEGER) AS match_end FROM lits")
    if any(r.kind == "regex" for r in rules):
        ctes.append(_regexes("rxs", rules, src))
        parts.append("SELECT path, rule_id, matched, line_start, match_start, match_end FROM rxs")
    ctes.append(
        "hits AS (SELECT h.path AS filename, h.rule_id, t.category, t.subcategory, h.matched AS pattern, t.severity, "
        f"h.line_start, h.match_start, h.match_end FROM ({' UNION ALL '.join(parts)}) h JOIN rule_table t USING (rule_id))")
    return ", ".join(ctes)


_NAMED = "files AS (SELECT CAST({name} AS VARCHAR) AS path, {text} AS content FROM {table})"
_SCAN_OUT = ("SELECT filename, rule_id, category, subcategory, pattern, severity, line_start, match_start, match_end "
             "FROM hits")


# --- closed forms over the snippets ---------------------------------------------------------
def _line_case() -> str:
    def case(snippets):
        many = " ".join(f"WHEN {i} THEN {s.count(chr(10)) + 1}" for i, s in enumerate(snippets) if "\n" in s)
        return f"CASE ix {many} ELSE 1 END" if many else "1"

    return f"CASE WHEN lang = 'java' THEN {case(corpus.JAVA_SNIPPETS)} ELSE {case(corpus.PYTHON_SNIPPETS)} END"


SNIPS = (
    f"base AS ({corpus.BASE_SQL}), "
    "placed AS (SELECT *, unnest(range(1, n + 1)) AS i FROM base), "
    f"indexed AS (SELECT *, {corpus.PATH_SQL} AS path, {corpus.INDEX_SQL} AS ix, {corpus.NUMBER_SQL} AS p FROM placed), "
    f"sized AS (SELECT *, {_line_case()} AS nl FROM indexed), "
    "snip AS (SELECT *, 1 + coalesce(sum(nl) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_line "
    "FROM sized), py AS (SELECT * FROM snip WHERE lang = 'py')")


def _t(template: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if template is None else corpus.template_sql(template) if template else "''"


# Calls per Python snippet: (snippet, line, name, qualified, function, class, chain, argument names)
_CALLS = [
    (2, 0, "hashlib.md5", "hashlib.md5", None, None, "hashlib.md5", "b{i}"),
    (3, 0, "cur.execute", "cur.execute", None, None, "cur.execute", "k{i}"),
    (4, 0, "os.system", "os.system", None, None, "os.system", "d{i}"),
    (8, 0, "pickle.loads", "pickle.loads", None, None, "pickle.loads", "raw{i}"),
    (9, 0, "yaml.load", "yaml.load", None, None, "yaml.load", "s{i}"),
    (10, 0, "subprocess.run", "subprocess.run", None, None, "subprocess.run", "c{i}"),
    (11, 0, "eval", "eval", None, None, "eval", "e{i}"),
    (12, 0, "app.run", "app.run", None, None, "app.run", ""),
    (13, 1, "compile", "compile", "_helper{i}", None, "compile", "src{i}"),
    (14, 2, "requests.get", "requests.get", "get", "C{i}", "requests.get", "base,user_input"),
    (15, 1, "exec", "exec", None, None, "exec", "z{i}"),
    (16, 0, "get", "request.args.get", None, None, "get", ""),
    (16, 1, "run_query", "run_query", None, None, "run_query", "u{i}"),
    (17, 0, "get", "request.args.get", None, None, "get", ""),
    (17, 1, "html.escape", "html.escape", None, None, "html.escape", "u{i}"),
    (17, 2, "run_query", "run_query", None, None, "run_query", "v{i}"),
    (18, 0, "request.GET", "request.GET", None, None, "request.GET", ""),
    (18, 1, "build_query", "build_query", None, None, "build_query", "u{i}"),
    (18, 2, "cursor.execute", "cursor.execute", None, None, "cursor.execute", "w{i}"),
    (20, 1, "login", "login", None, None, "login", "u{i}"),
    (21, 1, "print", "print", None, None, "print", "password"),
    (23, 0, "print", "print", None, None, "print", ""),
    (25, 0, "app.route", "app.route", "page{i}", None, "app.route", ""),
    (26, 0, "findById", "findById", None, None, "findById", ""),
    (29, 0, "db.execute", "db.execute", None, None, "db.execute", "k{i}"),
    (30, 0, "cursor.execute", "cursor.execute", None, None, "cursor.execute", "k{i}"),
    (39, 0, "pickle.loads", "pickle.loads", None, None, "pickle.loads", "user_input"),
    (41, 0, "eval", "eval", None, None, "eval", "j{i}"),
    (41, 0, "json.loads", "json.loads", None, None, "eval>json.loads", "j{i}"),
    (44, 0, "axios.get", "axios.get", None, None, "axios.get", "base,path"),
    (45, 3, "os.popen", "os.popen", None, None, "os.popen", "r{i}"),
    (46, 1, "ValueError", "ValueError", "f{i}", None, "ValueError", "n"),
    (46, 2, "eval", "eval", "f{i}", None, "eval", "n"),
    (47, 0, "input", "input", None, None, "input", ""),
    (47, 1, "os.system", "os.system", None, None, "os.system", "c{i}"),
    (48, 0, "request.GET", "request.GET", None, None, "request.GET", ""),
    *[(48, k, "step", "step", None, None, "step", f"{v}{{i}}") for k, v in enumerate("abcdef", 1)],
    (48, 7, "os.popen", "os.popen", None, None, "os.popen", "g{i}"),
    (49, 1, "input", "input", None, None, "input", ""),
    (49, 2, "eval", "eval", None, None, "eval", "t{i}"),
]
# Facts other than calls: (snippet, kind, how many)
_OTHER_FACTS = [
    (0, "assign", 1), (2, "assign", 1), (5, "assign", 1), (6, "assign", 1), (7, "import", 1), (8, "assign", 1),
    (9, "assign", 1), (11, "assign", 1), (13, "func", 1), (13, "stop", 1), (14, "class", 1), (14, "func", 1),
    (14, "stop", 1), (15, "async_func", 1), (16, "assign", 1), (17, "assign", 2), (18, "assign", 2), (19, "assign", 1),
    (20, "control", 1), (20, "guarded", 1), (21, "control", 1), (25, "func", 1), (25, "stop", 1), (27, "assign", 1),
    (31, "assign", 1), (33, "assign", 1), (38, "control", 1), (45, "control", 2), (45, "stop", 1), (46, "func", 1),
    (46, "stop", 1), (47, "assign", 1), (48, "assign", 7), (49, "assign", 1), (49, "control", 1), (49, "guarded", 1),
]
_CONTROL = [(20, "try"), (21, "if"), (38, "if"), (45, "for"), (45, "while"), (49, "try")]
# Bodies of try statements: (snippet, first line, last line)
_GUARDED = [(20, 1, 1), (49, 1, 2)]
# Syntax findings: (snippet, line, type, function, class, variables, chain, score)
_SYNTAX = [
    (5, 0, "HardcodedCredentials", None, None, "password", "", 7),
    (6, 0, "HardcodedCredentials", None, None, "api_token_{i}", "", 7),
    (33, 0, "HardcodedCredentials", None, None, "token", "", 7),
    (7, 0, "InsecureDeserialization", None, None, "pickle", "", 6),
    (10, 0, "CommandInjection", None, None, "c{i}", "subprocess.run", 8),
    (11, 0, "CodeInjection", None, None, "e{i}", "eval", 9),
    (13, 0, "InsecureDesign", "_helper{i}", None, "", "", 3),
    (13, 1, "CodeInjection", "_helper{i}", None, "src{i}", "compile", 9),
    (15, 1, "CodeInjection", None, None, "z{i}", "exec", 9),
    (41, 0, "CodeInjection", None, None, "", "eval", 9),
    (46, 2, "CodeInjection", "f{i}", None, "n", "eval", 9),
    (49, 2, "CodeInjection", None, None, "t{i}", "eval", 9),
]
_SQL_FORMAT = [
    (3, 0, "SQLInjection", "execute", None, "k{i}", "execute", 8),
    (30, 0, "SQLInjection", "execute", None, "k{i}", "execute", 8),
]
# Flow nodes with qualified names: (snippet, line, variable, role, tainted, context, operations)
_NODES = [
    (2, 0, "h{i}", "assignment", 0, "h{i} = hashlib.md5(b{i})", ""),
    (8, 0, "obj{i}", "assignment", 0, "obj{i} = pickle.loads(raw{i})", ""),
    (9, 0, "cfg{i}", "assignment", 0, "cfg{i} = yaml.load(s{i})", ""),
    (11, 0, "val{i}", "assignment", 0, "val{i} = eval(e{i})", ""),
    (16, 0, "u{i}", "user_input", 1, "request.args.get", ""),
    (16, 1, "sink_u{i}", "sink", 0, "run_query", "sink_usage"),
    (17, 0, "u{i}", "user_input", 1, "request.args.get", ""),
    (17, 1, "v{i}", "sanitized", 0, "html.escape", "sanitization"),
    (17, 2, "sink_v{i}", "sink", 0, "run_query", "sink_usage"),
    (18, 0, "u{i}", "user_input", 1, "request.GET", ""),
    (18, 1, "w{i}", "assignment", 1, "w{i} = build_query(u{i})", "assignment"),
    (18, 1, "sink_u{i}", "sink", 0, "build_query", "sink_usage"),
    (18, 2, "sink_w{i}", "sink", 0, "cursor.execute", "sink_usage"),
    (47, 0, "c{i}", "user_input", 1, "input", ""),
    (47, 1, "sink_c{i}", "sink", 0, "os.system", "sink_usage"),
    (48, 0, "a{i}", "user_input", 1, "request.GET", ""),
    *[(48, k, f"{v}{{i}}", "assignment", 1, f"{v}{{i}} = step({u}{{i}})", "assignment") for k, (u, v) in enumerate(pairwise("abcdefg"), 1)],
    (48, 7, "sink_g{i}", "sink", 0, "os.popen", "sink_usage"),
    (49, 1, "t{i}", "user_input", 1, "input", ""),
    (49, 2, "sink_t{i}", "sink", 0, "eval", "sink_usage"),
]
_EDGES = [
    (16, "u{i}", 0, "sink_u{i}", 1, "sink_usage"), (17, "u{i}", 0, "v{i}", 1, "sanitization"),
    (17, "v{i}", 1, "sink_v{i}", 2, "sink_usage"), (18, "u{i}", 0, "w{i}", 1, "assignment"),
    (18, "u{i}", 0, "sink_u{i}", 1, "sink_usage"), (18, "w{i}", 1, "sink_w{i}", 2, "sink_usage"),
    (47, "c{i}", 0, "sink_c{i}", 1, "sink_usage"), (49, "t{i}", 1, "sink_t{i}", 2, "sink_usage"),
    *[(48, f"{u}{{i}}", k, f"{v}{{i}}", k + 1, "assignment") for k, (u, v) in enumerate(pairwise("abcdefg"))],
    (48, "g{i}", 6, "sink_g{i}", 7, "sink_usage"),
]
# Flow findings: (snippet, source line, sink line, source role, source context, sink context, length)
_PATHS = [
    (16, 0, 1, "user_input", "request.args.get", "run_query", 2),
    (18, 0, 1, "user_input", "request.GET", "w{i} = build_query(u{i})", 2),
    (18, 0, 1, "user_input", "request.GET", "build_query", 2),
    (18, 0, 2, "user_input", "request.GET", "cursor.execute", 3),
    (18, 1, 1, "assignment", "w{i} = build_query(u{i})", "w{i} = build_query(u{i})", 1),
    (18, 1, 2, "assignment", "w{i} = build_query(u{i})", "cursor.execute", 2),
    (47, 0, 1, "user_input", "input", "os.system", 2),
    (48, 0, 7, "user_input", "request.GET", "os.popen", 8),
    *[(48, k, 7, "assignment", f"{v}{{i}} = step({u}{{i}})", "os.popen", 8 - k) for k, (u, v) in enumerate(pairwise("abcdefg"), 1)],
    (49, 1, 2, "user_input", "input", "eval", 2),
]
# Per-file counts with short names: (snippet, nodes, edges, tainted, findings)
_SHORT = [(2, 1, 0, 0, 0), (8, 1, 0, 0, 0), (9, 1, 0, 0, 0), (11, 1, 0, 0, 0), (17, 2, 1, 0, 0), (18, 4, 3, 2, 5), (48, 8, 7, 7, 7)]


def _rows(name: str, columns: list[str], rows: list[list[str]]) -> str:
    """One SELECT over the Python snippets per closed-form row: first value is the snippet."""
    selects = [
        "SELECT path, project, i, " + ", ".join(f"{v} AS {c}" for c, v in zip(columns, r[1:], strict=True)) + f" FROM py WHERE ix = {r[0]}"
        for r in rows
    ]
    return f"{name} AS ({' UNION ALL '.join(selects)})"


def _line(offset: int) -> str:
    return f"CAST(start_line + {offset} AS INTEGER)"


CALLS = _rows("calls", ["line", "name", "qual", "fn", "cls", "chain", "names"], [
    [r[0], _line(r[1]), _q(r[2]), _q(r[3]), _t(r[4]), _t(r[5]), _q(r[6]), _t(r[7])] for r in _CALLS])
FACTS = _rows("other_facts", ["kind", "n"], [[ix, _q(k), n] for ix, k, n in _OTHER_FACTS])
SYNTAX = _rows(
    "syn", ["line_number", "node_type", "function_name", "class_name", "variables", "chain", "complexity_score"],
    [[r[0], _line(r[1]), _q(r[2]), _t(r[3]), _t(r[4]), _t(r[5]), _q(r[6]), r[7]] for r in _SYNTAX + _SQL_FORMAT])
NODES = _rows("nodes", ["line", "variable", "role", "tainted", "context", "operations"], [
    [r[0], _line(r[1]), _t(r[2]), _q(r[3]), r[4], _t(r[5]), _q(r[6])] for r in _NODES])
EDGES = _rows("edges", ["from_variable", "from_line", "to_variable", "to_line", "operation"], [
    [r[0], _t(r[1]), _line(r[2]), _t(r[3]), _line(r[4]), _q(r[5])] for r in _EDGES])
_CONFIDENCE = {1: 0.9, 2: 0.8, 3: 0.7}
PATHS = _rows(
    "paths", ["source_line", "sink_line", "source_type", "source_context", "sink_context", "path_length"],
    [[r[0], _line(r[1]), _line(r[2]), _q(r[3]), _t(r[4]), _t(r[5]), r[6]] for r in _PATHS])
_CONF_SQL = "greatest(CAST(0.3 AS DOUBLE), CAST(1.0 AS DOUBLE) - path_length * CAST(0.1 AS DOUBLE))"
_FLOW_TYPE = (  # by the sink's context
    "CASE WHEN regexp_matches(lower(sink_context), 'execute|query|sql') THEN 'SQL Injection' "
    "WHEN regexp_matches(lower(sink_context), 'exec|system|subprocess') THEN 'Command Injection' "
    "WHEN regexp_matches(lower(sink_context), 'eval|compile') THEN 'Code Injection' ELSE 'Unknown' END")
_FLOW_RISK = f"CASE WHEN {_FLOW_TYPE} <> 'Unknown' THEN 'Critical' WHEN path_length > 5 THEN 'Medium' ELSE 'High' END"
_FLOW_TEXT = f"concat('Untrusted value from ', source_type, ' reaches a ', lower({_FLOW_TYPE}), ' sink')"

# Java matches joined with their surroundings.
_JAVA_RULES = R.rule_rows("java")
JAVA = (
    f"{FILES}, java AS (SELECT * FROM files WHERE lang = 'java'), {_regexes('jm', _JAVA_RULES, 'java')}, "
    "jl AS (SELECT path, line_no, string_split(content, chr(10))[line_no] AS line, "
    f"{_N_LINES.format('content')} AS n_lines FROM "
    "(SELECT path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM java) z), "
    "jn AS (SELECT row_number() OVER () AS m, * FROM jm), "
    "jt AS (SELECT jn.*, split_part(rule_id, '.', 2) AS node_type FROM jn), "
    f"jmethod AS (SELECT m, arg_max(regexp_extract(line, {_re(R.JAVA_METHOD)}, 2), line_no) AS function_name FROM jt JOIN jl "
    f"ON jl.path = jt.path AND line_no BETWEEN greatest(line_start - 18, 2) AND line_start WHERE regexp_matches(line, {_re(R.JAVA_METHOD)}) GROUP BY m), "
    f"jclass AS (SELECT m, arg_max(regexp_extract(line, {_re(R.JAVA_CLASS)}, 1), line_no) AS class_name FROM jt JOIN jl "
    f"ON jl.path = jt.path AND line_no BETWEEN greatest(line_start - 48, 2) AND line_start WHERE regexp_matches(line, {_re(R.JAVA_CLASS)}) GROUP BY m), "
    "jcontext AS (SELECT m, string_agg(line, chr(10) ORDER BY line_no) AS context, "
    "string_agg(CASE WHEN rn <= 2 THEN line END, ' ' ORDER BY line_no) AS snippet FROM "
    "(SELECT m, line, line_no, row_number() OVER (PARTITION BY m ORDER BY line_no) AS rn FROM jt JOIN jl "
    "ON jl.path = jt.path AND line_no BETWEEN line_start - 2 AND line_start + 2 AND line_no <= n_lines) q GROUP BY m)")
_JAVA_SCORE = "CASE node_type WHEN 'SQLInjection' THEN 9 WHEN 'CommandInjection' THEN 8 WHEN 'XSS' THEN 7 WHEN 'PathTraversal' THEN 6 ELSE 5 END"

# Context of Python findings: the line before, the line, the line after (two each for SQL formatting).
_PY_CONTEXT = (
    f"{FILES}, {SNIPS}, {SYNTAX}, sn AS (SELECT row_number() OVER () AS m, * FROM syn), "
    "pl AS (SELECT path, line_no, string_split(content, chr(10))[line_no] AS line, "
    f"{_N_LINES.format('content')} AS n_lines FROM "
    "(SELECT path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM files WHERE lang = 'py') z), "
    "pc AS (SELECT sn.m, pl.line, pl.line_no, row_number() OVER (PARTITION BY sn.m ORDER BY line_no) AS rn "
    "FROM sn JOIN pl ON pl.path = sn.path AND line_no <= n_lines AND "
    "abs(line_no - line_number) <= CASE WHEN node_type = 'SQLInjection' THEN 2 ELSE 1 END), "
    "pctx AS (SELECT m, string_agg(line, chr(10) ORDER BY line_no) AS context, "
    "string_agg(CASE WHEN rn <= 2 THEN line END, ' ' ORDER BY line_no) AS snippet FROM pc GROUP BY m)")

# --- all findings of the combined scan ---------------------------------------------------------
_SCANNED = "scanned AS (SELECT * FROM files WHERE lang IN ('py', 'java'))"
_ALL_RULES = R.rule_rows()


def _category_case(column: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.SYNTAX_CATEGORY.items())
    return f"CASE {column} {whens} ELSE 'A04_Insecure_Design' END"


def _syntax_select(finder: str, score: str, path: str, line: str, snippet: str, source: str) -> str:
    return (
        f"SELECT {_q(finder)} AS finder, node_type AS type, CASE WHEN {score} > 7 THEN 'High' ELSE 'Medium' END AS severity, "
        f"{path} AS file_path, {line} AS line_number, concat('Syntax check reported ', node_type) AS description, "
        f"{_category_case('node_type')} AS owasp_category, concat('Look at how ', node_type, ' arises here') AS recommendation, "
        f"{snippet} AS code_snippet, CAST(NULL AS DOUBLE) AS confidence FROM {source}")


def _finding(finder: str, line: str, snippet: str, source: str, kind: str) -> str:
    return (
        f"SELECT {_q(finder)} AS finder, {kind} AS type, t.severity, h.path AS file_path, {line} AS line_number, t.description, "
        f"t.category AS owasp_category, t.remediation AS recommendation, {snippet} AS code_snippet, "
        f"CAST(NULL AS DOUBLE) AS confidence FROM {source} h JOIN rule_table t USING (rule_id)")


_JAVA_ONLY = JAVA[len(FILES) + 2:]
_PY_ONLY = _PY_CONTEXT[len(FILES) + 2:]
FINDINGS = ", ".join([
    FILES, _SCANNED, _rule_table(_ALL_RULES), _line_hits(R.rule_rows("basic"), "scanned"),
    _literals("lits", R.owasp_rules(), "scanned"), _regexes("rxs", R.owasp_rules(), "scanned"), _JAVA_ONLY, _PY_ONLY, PATHS,
    "found AS (" + " UNION ALL ".join([
        _finding("line", "h.line_number", "h.code_snippet", "line_hits", "h.type"),
        _finding("literal", "1", "h.matched", "lits", "h.matched"),
        _finding("regex", "h.line_start", "h.matched", "rxs", "h.matched"),
        _syntax_select("py_syntax", "complexity_score", "path", "line_number", "snippet",
                       "(SELECT * FROM sn WHERE node_type <> 'SQLInjection') s JOIN pctx USING (m)"),
        _syntax_select("java_regex", _JAVA_SCORE, "path", "line_start", "snippet", "jt JOIN jcontext USING (m)"),
        f"SELECT 'flow' AS finder, {_FLOW_TYPE} AS type, {_FLOW_RISK} AS severity, path AS file_path, source_line AS line_number, "
        f"{_FLOW_TEXT} AS description, 'A03_Injection' AS owasp_category, {_q(R.FLOW_ADVICE)} AS recommendation, "
        f"source_context AS code_snippet, {_CONF_SQL} AS confidence FROM paths",
    ]) + ")",
    "findings AS (SELECT concat('scan_', split_part(file_path, '/', 1)) AS scan_id, * FROM found)",
    "scans AS (SELECT concat('scan_', project) AS scan_id, project, concat('/src/', project) AS project_path, max(ts) AS ts, "
    "count(*) FILTER (WHERE lang IN ('py', 'java')) AS total_files, "
    f"CAST(sum(CASE WHEN lang IN ('py', 'java') THEN {_N_LINES.format('content')} ELSE 0 END) AS BIGINT) AS lines_analyzed FROM files GROUP BY project)",
])
_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {c}" for s, c in reports.SEVERITY_COLUMNS.items())
_SEV = list(reports.SEVERITY_COLUMNS.values())
TOTALS = (
    f"counts AS (SELECT scan_id, count(*) AS total_vulnerabilities, {_COUNTS} FROM findings GROUP BY scan_id), "
    "totals AS (SELECT s.*, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["total_vulnerabilities", *_SEV])
    + " FROM scans s LEFT JOIN counts USING (scan_id)), "
    "cats AS (SELECT scan_id, owasp_category AS category, count(*) AS n, count(*) FILTER (WHERE severity = 'Critical') AS c "
    "FROM findings GROUP BY 1, 2), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, category) AS rank FROM cats)")
EVENTS = (
    f"findings AS ({corpus.EVENT_FINDINGS_SQL}), "
    "scans AS (SELECT scan_id, project, min(ts) AS ts, count(*) AS total_files, concat('/u/', project) AS project_path "
    "FROM findings GROUP BY scan_id, project)")
_GRID = _values("grid", "category", [(c,) for c in R.CATEGORIES])
_RISK = ("CASE WHEN critical_count > 0 THEN 'CRITICAL' WHEN high_count > 5 THEN 'HIGH' WHEN high_count > 0 THEN 'MEDIUM' "
         "ELSE 'LOW' END")
_COMPLIANCE = (
    f"{_GRID}, compliance AS (SELECT s.scan_id, g.category, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS compliant, "
    "coalesce(c.n, 0) AS issues_found, coalesce(c.c, 0) AS critical_issues FROM scans s CROSS JOIN grid g "
    "LEFT JOIN cats c ON c.scan_id = s.scan_id AND c.category = g.category)")


def _advice(sep: str, limit: bool = False, bullet: str = "") -> str:
    a = reports
    lists = (
        f"list_concat(CASE WHEN critical_count > 0 THEN [{_q(a.ADVICE_CRITICAL)}] ELSE [] END, "
        f"CASE WHEN high_count > 5 THEN [{_q(a.ADVICE_HIGH)}] ELSE [] END, "
        f"CASE WHEN total_vulnerabilities > 20 THEN [{_q(a.ADVICE_TOTAL[0])}, {_q(a.ADVICE_TOTAL[1])}] ELSE [] END, "
        f"CASE WHEN r.n > 3 AND contains(r.category, 'Injection') THEN [{_q(a.ADVICE_CATEGORY['Injection'])}] "
        f"WHEN r.n > 3 AND contains(r.category, 'Access_Control') THEN [{_q(a.ADVICE_CATEGORY['Access_Control'])}] "
        f"WHEN r.n > 3 AND contains(r.category, 'Cryptographic') THEN [{_q(a.ADVICE_CATEGORY['Cryptographic'])}] ELSE [] END, "
        f"[{_q(a.ADVICE_ALWAYS[0])}, {_q(a.ADVICE_ALWAYS[1])}])")
    items = f"({lists})[1:5]" if limit else lists
    if bullet:
        items = f"list_transform({items}, lambda x: concat({_q(bullet)}, x))"
    return f"array_to_string({items}, {sep})"


_WITH_TOP = "totals t LEFT JOIN ranked r ON r.scan_id = t.scan_id AND r.rank = 1"
_STATUS_TEXT = (
    "status AS (SELECT scan_id, string_agg(concat(category, ': ', CASE compliant WHEN 1 THEN '✓ Compliant' "
    "ELSE '✗ Non-Compliant' END), chr(10) ORDER BY category) AS text FROM compliance GROUP BY scan_id)")
_FIRST = (
    "firsts AS (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY file_path, line_number, type, finder, "
    "owasp_category, code_snippet, recommendation) AS INTEGER) AS n FROM findings)")
_FLOW_COLUMNS = f"{SNIPS}, {NODES}"


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    code = f"WITH {FILES} "
    q["src2_files_with_syntax"] = (
        f"WITH {JAVA}, {SNIPS}, {SYNTAX} SELECT path, count(*) AS n FROM (SELECT path FROM syn WHERE node_type <> 'SQLInjection' "
        "UNION ALL SELECT path FROM jt) z GROUP BY path")
    q["src3_python_files"] = code + "SELECT project, count(*) AS n_files FROM files WHERE lang = 'py' GROUP BY project"
    q["src4_scan_files"] = code + (
        f"SELECT project, count(*) AS n_files, CAST(sum({_N_LINES.format('content')}) AS BIGINT) AS n_lines "
        "FROM files WHERE lang IN ('py', 'java') GROUP BY project")
    owasp = _scan(R.owasp_rules())
    q["src6_scan_documents"] = f"WITH {_NAMED.format(name='doc_id', text='text', table='documents')}, {owasp} {_SCAN_OUT}"
    q["src6_scan_pages"] = f"WITH {_NAMED.format(name='url', text='html', table='pages')}, {owasp} {_SCAN_OUT}"
    name = "coalesce(CASE WHEN role <> 'user' THEN CAST(conv_id AS VARCHAR) END, 'unknown')"
    q["src6_scan_conversations"] = f"WITH {_NAMED.format(name=name, text='text', table='conversations')}, {owasp} {_SCAN_OUT}"
    q["src7_archive_members"] = (
        "SELECT concat('z', CAST(page_id AS VARCHAR), '.zip!', m.member) AS path, m.lang, m.problem, "
        "CAST(length(CASE m.member WHEN 'src/page.py' THEN html WHEN '__init__.java' THEN '' END) AS INTEGER) AS n_chars, "
        "md5(CASE m.member WHEN 'src/page.py' THEN html WHEN '__init__.java' THEN '' END) AS content_md5 FROM pages "
        "CROSS JOIN (VALUES ('src/page.py', 'py', NULL), ('__init__.java', 'java', NULL), "
        "('src/bad.py', 'py', 'damaged archive member')) m(member, lang, problem)")
    q["src8_allowed_extension"] = code + (
        "SELECT path, CASE WHEN lang <> 'other' OR path LIKE '%.zip' THEN 1 ELSE 0 END AS uploadable, "
        "CASE WHEN lang <> 'other' AND path NOT LIKE '%.zip' AND path = lower(path) THEN 1 ELSE 0 END AS scannable FROM "
        "(SELECT path, lang FROM files UNION ALL "
        "SELECT concat(upper(path), CASE WHEN lang = 'py' THEN '.zip' ELSE '' END), lang FROM files) z")
    ascii_only = "regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')"
    latin = "regexp_replace(text, '[^\\x00-\\x{ff}]', '?', 'g')"
    latin_ascii = ascii_only.replace("text", latin, 1)
    q["src9_tolerant_decode"] = (
        f"SELECT doc_id AS name, CAST(length({latin_ascii}) AS INTEGER) AS n_chars, md5({latin_ascii}) AS content_md5 FROM documents")
    q["src10_strict_decode"] = f"SELECT doc_id AS name FROM documents WHERE {latin} = {latin_ascii}"
    q["src11_newlines"] = code + (
        "SELECT f.path, CAST(length(r.content) AS INTEGER) AS n_raw, CAST(length(f.content) AS INTEGER) AS n_chars, "
        f"CAST({_N_LINES.format('f.content')} AS INTEGER) AS n_lines FROM files f JOIN raw_files r USING (path)")
    q["src13_history_append"] = (
        f"WITH {EVENTS} SELECT project, count(*) AS n_scans, CAST(sum(total_files) AS BIGINT) AS total_files FROM scans GROUP BY project")

    one, two = (
        f"scanned_{run} AS (SELECT concat('{run}_', project) AS scan_id, project FROM (SELECT DISTINCT project FROM files)), "
        f"counted_{run} AS (SELECT concat('{run}_', split_part(file_path, '/', 1)) AS scan_id, count(*) AS n, "
        f"count(*) FILTER (WHERE severity = 'Critical') AS c FROM findings WHERE finder IN ({finders}) GROUP BY 1), "
        f"scans_{run} AS (SELECT s.scan_id, s.project, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM scanned_{run} s "
        f"LEFT JOIN counted_{run} USING (scan_id))"
        for run, finders in (("one", "'line', 'literal', 'regex', 'py_syntax', 'java_regex'"), ("two", "'line', 'literal', 'regex'")))
    q["src13_two_scans_of_one_tree"] = f"WITH {FINDINGS}, {one}, {two} " + (
        "SELECT scan_id, n AS total_vulnerabilities, c AS critical_count, CAST(NULL AS BIGINT) AS vulnerability_change FROM scans_one "
        "UNION ALL SELECT t.scan_id, t.n, t.c, t.n - o.n FROM scans_two t JOIN scans_one o USING (project)")
    hidden = (
        "tree AS (SELECT concat('.', list_last(string_split(f.path, '/'))) AS name, f.project, f.lang, f.content, r.content AS raw "
        "FROM files f JOIN raw_files r USING (path) WHERE f.lang <> 'other')")
    q["src1_source_tree"] = f"WITH {FILES}, {hidden} " + (
        "SELECT name, lang, CAST(strlen(raw) <= 2000 AS INTEGER) AS is_utf8, CASE WHEN strlen(raw) > 2000 THEN 'too large' END AS problem, "
        "CAST(CASE WHEN strlen(raw) <= 2000 THEN length(content) END AS INTEGER) AS n_chars, "
        "CASE WHEN strlen(raw) <= 2000 THEN md5(content) END AS content_md5 FROM tree")
    q["src5_single_file"] = f"WITH {FILES}, {hidden} SELECT name, md5(content) AS content_md5 FROM tree ORDER BY concat(project, '/', name) LIMIT 1"

    q["src12_unreadable"] = f"WITH {FILES}, {hidden} " + (
        "SELECT CASE WHEN regexp_matches(name, '7\\.[a-z]+$') THEN 'unreadable' END AS problem, count(*) AS n, "
        "count(*) FILTER (WHERE NOT regexp_matches(name, '7\\.[a-z]+$')) AS with_content FROM tree GROUP BY 1")

    # rules and patterns
    q["pat1_line_rules"] = (
        f"WITH {FILES}, {_rule_table(R.rule_rows('basic'))}, {_line_hits(R.rule_rows('basic'))} "
        "SELECT t.rule_id, t.category, t.severity, t.pattern, count(h.path) AS n FROM rule_table t "
        "LEFT JOIN line_hits h USING (rule_id) GROUP BY ALL")
    docs = f"WITH {TEXTS}, {_scan(R.owasp_rules(), 'texts')} "
    q["pat2_content_rules"] = docs + (
        "SELECT t.rule_id, t.category, t.subcategory, t.kind, t.pattern, t.severity, t.cwe, count(h.filename) AS n "
        "FROM rule_table t LEFT JOIN hits h USING (rule_id) GROUP BY ALL")
    rx = f"WITH {TEXTS}, {_scan(R.owasp_rules(kind='regex'), 'texts')} "
    q["pat3_regexes_per_category"] = rx + (
        "SELECT t.category, string_agg(t.rule_id, ',' ORDER BY t.rule_id) AS rules, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n FROM rule_table t "
        "LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id) h USING (rule_id) GROUP BY t.category")
    a02 = R.owasp_rules("A02_Cryptographic_Failures")
    q["pat4_rules_of_category"] = (
        f"WITH {TEXTS}, {_scan(a02, 'texts')} "
        "SELECT t.rule_id, t.kind, t.pattern, count(h.filename) AS n FROM rule_table t LEFT JOIN hits h USING (rule_id) GROUP BY ALL")
    q["pat5_line_literals"] = (
        f"WITH {FILES}, {_line_hits(R.rule_rows('basic'))} SELECT path, rule_id, type, line_number, code_snippet FROM line_hits")
    q["pat5_line_literals_documents"] = (
        f"WITH {_NAMED.format(name='doc_id', text='text', table='documents')}, {_line_hits(R.rule_rows('basic'))} "
        "SELECT path, rule_id, type, line_number, code_snippet FROM line_hits")
    q["pat6_content_literals"] = f"WITH {DOCS}, {_literals('lits', R.owasp_rules())} SELECT path AS name, rule_id, matched FROM lits"
    out = "rule_id, matched, match_start, match_end, line_start"
    q["pat7_content_regexes"] = f"WITH {DOCS}, {_regexes('rxs', R.owasp_rules())} SELECT path AS name, {out} FROM rxs"
    q["pat7_code_regexes"] = f"WITH {FILES}, {_regexes('rxs', R.owasp_rules())} SELECT path, {out} FROM rxs"
    q["pat8_category_filter"] = (
        f"WITH {TEXTS}, {_scan(R.owasp_rules('A04_Insecure_Design'), 'texts')} "
        "SELECT filename, category, count(*) AS n FROM hits GROUP BY ALL")
    q["pat9_match_lines"] = (
        f"WITH {FILES}, {_regexes('rxs', R.owasp_rules())} SELECT path, line_start, count(*) AS n FROM rxs GROUP BY ALL")
    name = "coalesce(CASE WHEN turn > 0 THEN role END, 'unknown')"
    q["pat10_names"] = (
        f"WITH {_NAMED.format(name=name, text='text', table='conversations')}, {owasp} SELECT filename, count(*) AS n FROM hits GROUP BY filename")
    q["pat11_statistics"] = docs + (
        "SELECT (SELECT count(*) FROM texts) AS files_scanned, (SELECT count(*) FROM hits) AS vulnerabilities_found")
    q["pat12_coverage"] = docs.rstrip() + f", {_GRID} " + (
        "SELECT g.category, CASE WHEN g.category IN (SELECT category FROM rule_table) THEN 1 ELSE 0 END AS covered, "
        "count(h.filename) AS n FROM grid g LEFT JOIN hits h ON h.category = g.category GROUP BY g.category")

    # Java
    q["jav1_java_matches"] = f"WITH {JAVA} SELECT path, {out} FROM jm"
    j = f"WITH {JAVA} SELECT path, line_start AS line_number, node_type, "
    q["jav2_enclosing_method"] = j + "function_name FROM jt LEFT JOIN jmethod USING (m)"
    q["jav3_enclosing_class"] = j + "class_name FROM jt LEFT JOIN jclass USING (m)"
    q["jav4_variables"] = j + (
        "array_to_string(list_filter(regexp_extract_all(matched, '\\b[a-zA-Z_][a-zA-Z0-9_]*\\b'), lambda v: v NOT IN "
        "('new', 'public', 'private', 'protected', 'static', 'final')), ',') AS variables FROM jt")
    q["jav5_score"] = j + f"CAST({_JAVA_SCORE} AS INTEGER) AS complexity_score FROM jt"
    q["jav6_context"] = j + "context FROM jt JOIN jcontext USING (m)"

    # Python syntax
    s = f"WITH {SNIPS}, {CALLS}"
    q["syn1_facts"] = (
        f"{s}, {FACTS} SELECT path, kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT path, kind, n FROM other_facts UNION ALL "
        "SELECT path, 'call', 1 FROM calls) z GROUP BY path, kind")
    q["syn2_scopes"] = s + " SELECT path, line, qual, fn, cls FROM calls"
    for key, kind in [("syn3_private_functions", "InsecureDesign"), ("syn4_code_calls", "CodeInjection"),
                      ("syn5_shell_calls", "CommandInjection"), ("syn6_object_imports", "InsecureDeserialization"),
                      ("syn7_secrets", "HardcodedCredentials"), ("syn8_sql_formatting", "SQLInjection")]:
        q[key] = (
            f"WITH {SNIPS}, {SYNTAX} SELECT path, line_number, node_type, function_name, class_name, "
            f"CAST(complexity_score AS INTEGER) AS complexity_score, variables, chain FROM syn WHERE node_type = '{kind}'")
    q["syn9_call_names"] = s + " SELECT name, qual, count(*) AS n FROM calls GROUP BY name, qual"
    q["syn10_call_chains"] = s + " SELECT path, line, chain FROM calls WHERE contains(chain, '>')"
    q["syn11_argument_names"] = s + " SELECT path, line, qual, names FROM calls WHERE names <> ''"
    q["syn12_context"] = f"WITH {_PY_CONTEXT} SELECT path, line_number, node_type, context FROM sn JOIN pctx USING (m)"
    q["syn13_both_languages"] = (
        f"WITH {JAVA}, {SNIPS}, {SYNTAX} SELECT path, node_type, count(*) AS n FROM (SELECT path, node_type FROM syn "
        "WHERE node_type <> 'SQLInjection' UNION ALL SELECT path, node_type FROM jt) z GROUP BY path, node_type")
    extra = R.rule_rows("py_extra")
    q["syn14_extra_rules"] = (
        f"WITH {FILES}, {_literals('lits', extra)}, {_regexes('rxs', extra)} SELECT rule_id, count(*) AS n FROM "
        "(SELECT rule_id FROM lits UNION ALL SELECT rule_id FROM rxs) z GROUP BY rule_id")

    # flow
    flow_type = "CASE WHEN tainted = 1 THEN 'tainted' WHEN role = 'sanitized' THEN 'sanitized' ELSE 'unknown' END"
    q["flw1_nodes"] = (
        f"WITH {_FLOW_COLUMNS}, numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY i, line, "
        "CASE WHEN role = 'sink' THEN 1 ELSE 0 END) AS INTEGER) AS node_no FROM nodes) "
        f"SELECT node_no, {flow_type} AS flow_type, role AS source_type, count(*) AS n FROM numbered GROUP BY ALL")
    q["flw2_edges"] = f"WITH {SNIPS}, {EDGES} SELECT operation, count(*) AS n FROM edges GROUP BY operation"
    q["flw3_tainted_nodes"] = (
        f"WITH {_FLOW_COLUMNS} SELECT path, variable, line, {flow_type} AS flow_type, context FROM nodes WHERE role = 'user_input'")
    q["flw4_sanitized_nodes"] = (
        f"WITH {_FLOW_COLUMNS} SELECT path, variable, line, {flow_type} AS flow_type, context, operations FROM nodes WHERE role = 'sanitized'")
    q["flw5_assignment_nodes"] = (
        f"WITH {_FLOW_COLUMNS} SELECT path, variable, line, context, operations FROM nodes WHERE role = 'assignment'")
    q["flw6_bindings"] = (
        f"WITH {SNIPS}, {EDGES} SELECT path, from_variable, from_line, to_variable, to_line, operation FROM edges")
    q["flw7_sink_nodes"] = f"WITH {_FLOW_COLUMNS} SELECT path, variable, line, context FROM nodes WHERE role = 'sink'"
    q["flw8_taint_closure"] = f"WITH {_FLOW_COLUMNS} SELECT path, variable, line FROM nodes WHERE tainted = 1"
    p = f"WITH {SNIPS}, {PATHS}"
    q["flw9_paths"] = p + (
        " SELECT path, source_line, sink_line, source_context, sink_context, CAST(path_length AS INTEGER) AS path_length FROM paths")
    q["flw10_sanitized_filter"] = (
        f"{p}, {NODES} SELECT path, count(*) AS n FROM paths WHERE path IN (SELECT path FROM nodes WHERE role = 'sanitized') GROUP BY path")
    q["flw11_14_classified"] = p + (
        f" SELECT {_FLOW_TYPE} AS vuln_type, {_FLOW_RISK} AS risk_level, {_CONF_SQL} AS confidence, {_FLOW_TEXT} AS description, "
        "count(*) AS n FROM paths GROUP BY ALL")
    per_file = (
        "SELECT f.path, coalesce(n, 0) AS total_flow_nodes, coalesce(e, 0) AS total_flow_edges, coalesce(t, 0) AS tainted_sources, "
        "coalesce(v, 0) AS vulnerabilities_found FROM (SELECT DISTINCT path FROM py) f ")
    q["flw15_file_statistics"] = (
        f"{p}, {NODES}, {EDGES} {per_file}"
        "LEFT JOIN (SELECT path, count(*) AS n, CAST(sum(tainted) AS BIGINT) AS t FROM nodes GROUP BY path) a ON a.path = f.path "
        "LEFT JOIN (SELECT path, count(*) AS e FROM edges GROUP BY path) b ON b.path = f.path "
        "LEFT JOIN (SELECT path, count(*) AS v FROM paths GROUP BY path) c ON c.path = f.path")
    short = _rows("short", ["n", "e", "t", "v"], [list(r) for r in _SHORT])
    q["flw15_file_statistics_short"] = (
        f"WITH {SNIPS}, {short} {per_file}LEFT JOIN (SELECT path, CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS e, "
        "CAST(sum(t) AS BIGINT) AS t, CAST(sum(v) AS BIGINT) AS v FROM short GROUP BY path) a ON a.path = f.path")
    q["flw16_totals"] = p + (
        " SELECT (SELECT count(DISTINCT path) FROM py) AS files_analyzed, count(*) AS total_vulnerabilities, "
        f"CAST(0 AS BIGINT) AS total_control_issues, count(*) FILTER ({_FLOW_RISK} = 'Critical') AS critical_vulnerabilities FROM paths")
    control_rows = _rows("ctl", ["name"], [[ix, _q(k)] for ix, k in _CONTROL])
    q["flw17_control_nodes"] = f"WITH {SNIPS}, {control_rows} SELECT path, name, count(*) AS n FROM ctl GROUP BY path, name"
    q["flw18_unreachable"] = s + " SELECT path, line, qual FROM calls WHERE (qual = 'os.popen' AND names LIKE 'r%') OR (qual = 'eval' AND fn LIKE 'f%')"
    sinks = " OR ".join(f"contains(qual, {_q(x)})" for x in R.SINKS)
    guarded = _rows("guarded", ["first", "last"], [[ix, _line(a), _line(b)] for ix, a, b in _GUARDED])
    q["flw19_unguarded"] = f"{s}, {guarded}" + (
        f" SELECT path, line, qual FROM calls WHERE ({sinks}) AND NOT EXISTS "
        "(SELECT 1 FROM guarded g WHERE g.path = calls.path AND calls.line BETWEEN g.first AND g.last)")

    # combined scan
    f = f"WITH {FINDINGS} "
    q["uni1_combined_scan"] = f + (
        "SELECT scan_id, finder, severity, count(*) AS n, count(DISTINCT owasp_category) AS categories FROM findings GROUP BY ALL")
    cols = "scan_id, finder, type, severity, file_path, line_number, description, owasp_category, recommendation, code_snippet"
    q["uni2_line_findings"] = f + f"SELECT {cols} FROM findings WHERE finder = 'line'"
    q["uni3_match_findings"] = f + f"SELECT {cols} FROM findings WHERE finder IN ('literal', 'regex')"
    q["uni4_syntax_findings"] = f + f"SELECT {cols} FROM findings WHERE finder IN ('py_syntax', 'java_regex')"
    q["uni5_syntax_categories"] = f + (
        "SELECT type, owasp_category, severity, count(*) AS n FROM findings WHERE finder IN ('py_syntax', 'java_regex') GROUP BY ALL")
    q["uni6_flow_findings"] = f + f"SELECT {cols}, confidence FROM findings WHERE finder = 'flow'"
    q["uni7_options"] = f + (
        "SELECT scan_id, finder, count(*) AS n FROM findings WHERE finder IN ('line', 'literal', 'regex') GROUP BY ALL")
    q["uni8_scan_rows"] = f + (
        "SELECT scan_id, project_path, strftime(ts, '%Y-%m-%d') AS day, total_files, lines_analyzed, "
        "CAST(85.0 AS DOUBLE) AS coverage_percentage, CAST(0.85 AS DOUBLE) AS confidence_score FROM scans")

    # aggregates
    ft = f"WITH {FINDINGS}, {TOTALS}"
    et = f"WITH {EVENTS}, {TOTALS}"
    q["agg1_severities"] = ft + f" SELECT scan_id, {', '.join(_SEV)} FROM totals"
    q["agg2_summary"] = ft + f" SELECT scan_id, total_vulnerabilities, {', '.join(_SEV)} FROM counts"
    q["agg3_by_category"] = ft + " SELECT scan_id, category, n FROM cats"
    q["agg4_by_file"] = f + "SELECT scan_id, file_path, count(*) AS n FROM findings GROUP BY ALL"
    q["agg5_metrics"] = f + (
        "SELECT scan_id, total_files, lines_analyzed, CAST(0.0 AS DOUBLE) AS scan_duration, CAST(85.0 AS DOUBLE) AS coverage_percentage, "
        "CAST(0.1 AS DOUBLE) AS false_positive_rate, CAST(0.85 AS DOUBLE) AS confidence_score FROM scans")
    q["agg6_project_name"] = f + "SELECT scan_id, project AS project_name FROM scans"
    q["agg7_risk_level"] = ft + f" SELECT scan_id, {_RISK} AS risk_level FROM totals"
    q["agg7_risk_level_events"] = et + f" SELECT scan_id, {_RISK} AS risk_level FROM totals"
    q["agg8_top_categories"] = ft + " SELECT scan_id, category, n, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3"
    q["agg9_compliance"] = f"{et}, {_COMPLIANCE} SELECT scan_id, category, compliant, issues_found, critical_issues FROM compliance"
    q["agg10_compliance_text"] = f"{ft}, {_COMPLIANCE}, {_STATUS_TEXT} SELECT scan_id, text FROM status"
    q["agg11_recommendations"] = et + f" SELECT t.scan_id, {_advice(_q('|'))} AS recommendations FROM {_WITH_TOP}"
    bullets = _advice("chr(10)", True, "• ")
    q["agg12_recommendation_text"] = ft + f" SELECT t.scan_id, {bullets} AS text FROM {_WITH_TOP}"
    q["agg13_chart_series"] = ft + (
        " SELECT scan_id, 'category' AS chart, category AS label, n FROM cats" + "".join(
            f" UNION ALL SELECT scan_id, 'severity', '{s}', {c} FROM totals" for s, c in reports.SEVERITY_COLUMNS.items()))
    q["agg14_first_findings"] = f"{f.rstrip()}, {_FIRST} " + (
        "SELECT scan_id, n, owasp_category AS title, severity, file_path, line_number, code_snippet, recommendation FROM firsts WHERE n <= 20")
    q["agg15_trend"] = et + (
        ", lagged AS (SELECT *, lag(total_vulnerabilities) OVER w AS pt, lag(critical_count) OVER w AS pc FROM totals "
        "WINDOW w AS (PARTITION BY project ORDER BY ts, scan_id)) "
        "SELECT project, scan_id, total_vulnerabilities - pt AS vulnerability_change, critical_count - pc AS critical_change, "
        "round(CASE WHEN pt = 0 THEN 0.0 ELSE CAST(pt - total_vulnerabilities AS DOUBLE) / pt * 100.0 END, 6) AS improvement_rate "
        "FROM lagged WHERE pt IS NOT NULL")
    q["agg16_history"] = et + (
        " SELECT scan_id, project AS project_name, total_vulnerabilities, critical_count, high_count, total_files AS files_scanned FROM totals")
    q["agg17_find_scan"] = f + "SELECT scan_id, total_files, lines_analyzed FROM scans WHERE scan_id = 'scan_proj_7'"
    q["agg18_statistics"] = et + (
        " SELECT (SELECT count(*) FROM scans) AS total_scans, (SELECT count(*) FROM findings) AS total_vulnerabilities, "
        "round(CAST((SELECT count(*) FROM findings) AS DOUBLE) / (SELECT count(*) FROM scans), 2) AS avg_vulnerabilities_per_scan, "
        "(SELECT owasp_category FROM findings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_vulnerability")
    q["agg18_distribution"] = et + " SELECT owasp_category AS category, count(*) AS n FROM findings GROUP BY 1"
    q["agg19_cards"] = ft + (
        " SELECT scan_id, total_vulnerabilities, critical_count, high_count, total_files AS files_scanned FROM totals")

    # outputs
    q["snk1_scan_json"] = ft + (
        " SELECT scan_id, 'scan' AS record, CAST(1 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS line_sum, critical_count AS critical FROM totals "
        "UNION ALL SELECT scan_id, 'finding', count(*), CAST(sum(line_number) AS BIGINT), NULL FROM findings GROUP BY scan_id")
    q["snk2_report_json"] = ft + (
        " SELECT t.scan_id, strftime(t.ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, t.project AS project_name, t.total_vulnerabilities AS total, "
        "(SELECT n FROM cats c WHERE c.scan_id = t.scan_id AND c.category = 'A03_Injection') AS injection, t.total_files AS files_scanned, "
        "coalesce((SELECT n FROM cats c WHERE c.scan_id = t.scan_id AND c.category = 'A06_Vulnerable_Components'), 0) AS components FROM totals t")
    q["snk2_trend_data"] = et + (
        " SELECT scan_id, CAST(nullif(row_number() OVER w - 1, 0) AS BIGINT) AS earlier_scans, "
        "lag(total_vulnerabilities, 1) OVER w - lag(total_vulnerabilities, 2) OVER w AS last_change FROM totals "
        "WINDOW w AS (PARTITION BY project ORDER BY ts, scan_id)")
    q["snk5_written_reports"] = f"{ft}, {_FIRST}, {_GRID} " + (
        "SELECT 'findings' AS dataset, scan_id, count(*) AS n FROM findings GROUP BY scan_id "
        "UNION ALL SELECT 'by_file', scan_id, count(DISTINCT file_path) FROM findings GROUP BY scan_id "
        "UNION ALL SELECT 'first', scan_id, count(*) FROM firsts WHERE n <= 20 GROUP BY scan_id "
        "UNION ALL SELECT 'charts', scan_id, 4 + (SELECT count(*) FROM cats c WHERE c.scan_id = t.scan_id) FROM totals t "
        "UNION ALL SELECT 'reports', scan_id, 1 FROM totals UNION ALL SELECT 'executive', scan_id, 1 FROM totals")
    q["snk3_console_lines"] = f"{f.rstrip()}, {_FIRST} " + (
        "SELECT scan_id, CAST(n AS BIGINT) AS n, concat(n, '. ', owasp_category, ' - ', severity, chr(10), '   File: ', file_path, ':', line_number, "
        "chr(10), '   Description: ', description, chr(10), '   Code: ', code_snippet, chr(10), '   Recommendation: ', recommendation) AS text FROM firsts")
    top = ("tops AS (SELECT scan_id, string_agg(concat('- ', category, ': ', n, ' issues'), chr(10) ORDER BY rank) AS top "
           "FROM ranked WHERE rank <= 3 GROUP BY scan_id)")
    nl = "chr(10)"
    q["snk4_executive_summary"] = f"{ft}, {_COMPLIANCE}, {_STATUS_TEXT}, {top} " + (
        f"SELECT t.scan_id, concat('SECURITY SCAN - EXECUTIVE SUMMARY', {nl}, {nl}, 'Project: ', t.project, {nl}, "
        f"'Scan Date: ', strftime(t.ts, '%Y-%m-%d'), {nl}, 'Scan ID: ', t.scan_id, {nl}, {nl}, "
        f"'Overall Security Risk: ', {_RISK}, {nl}, 'Files Analyzed: ', t.total_files, {nl}, "
        f"'Total Vulnerabilities: ', t.total_vulnerabilities, {nl}, 'Critical Issues: ', t.critical_count, {nl}, "
        f"'High Risk Issues: ', t.high_count, {nl}, {nl}, 'Top Vulnerability Categories:', {nl}, top, {nl}, {nl}, "
        f"'Recommendations:', {nl}, {bullets}, {nl}, {nl}, 'Compliance:', {nl}, text, {nl}, {nl}, 'Next steps:', {nl}, "
        f"{f', {nl}, '.join(map(_q, reports.NEXT_STEPS))}) AS summary "
        f"FROM {_WITH_TOP} JOIN status s ON s.scan_id = t.scan_id JOIN tops o ON o.scan_id = t.scan_id")
    q["snk6_gate"] = et + " SELECT scan_id, CASE WHEN critical_count > 0 THEN 1 ELSE 0 END AS failed FROM totals"

    # settings
    q["cfg1_file_selection"] = f"WITH {FILES} " + (
        "SELECT f.project, count(*) AS n_files, count(*) FILTER (WHERE strlen(r.content) > 300) AS skipped "
        "FROM files f JOIN raw_files r USING (path) WHERE f.lang = 'py' GROUP BY 1")
    q["cfg2_flow_limits"] = p + (
        f" SELECT concat('scan_', project) AS scan_id, {_CONF_SQL} AS confidence, count(*) AS n FROM paths "
        f"WHERE path_length <= 2 AND {_CONF_SQL} >= 0.85 GROUP BY ALL")
    set_rules = R.configure(R.owasp_rules(), {"A02_Cryptographic_Failures"}, {"A04_Insecure_Design": "Low"})
    q["cfg3_rule_settings"] = (
        f"WITH {TEXTS}, {_scan(set_rules, 'texts')} "
        "SELECT category, severity, count(*) AS n FROM hits GROUP BY ALL")
    q["cfg4_user_rules"] = (
        f"WITH {DOCS}, {_literal_rules('built', R.owasp_rules())}, own AS (SELECT concat('user.', r_regionkey) AS rule_id, "
        "substring(r_name, 1, 3) AS literal FROM region), table_rules AS (SELECT * FROM built UNION ALL SELECT * FROM own) "
        "SELECT rule_id, count(*) AS n FROM files JOIN table_rules ON contains(lower(content), lower(literal)) GROUP BY rule_id")
    q["cfg5_report_limits"] = f"{f.rstrip()}, {_FIRST} SELECT scan_id, n, owasp_category AS title, '' AS code_snippet FROM firsts WHERE n <= 7"

    # streams
    q["str1_continuous_scan"] = q["src6_scan_documents"]
    q["str2_severity_windows"] = (
        f"WITH {EVENTS}, days AS (SELECT CAST(ts AS DATE) AS d, severity, count(*) AS n FROM findings GROUP BY ALL) "
        "SELECT strftime(d, '%Y-%m-%d') AS day, severity, n FROM days")
    q["str3_without_redelivery"] = "SELECT DISTINCT concat('f', user_id) AS path, concat(event_type, ' = 1') AS content FROM events"
    return q


ORACLES = _sql()
