"""The combined scan does each part of its work once, with the results of the plainer ways."""

import random
import re

import pytest

from scanframe import rules as R
from scanframe.functions import plainscan, pyfacts, regex
from scanframe.operators import flow, patterns, syntax
from scanframe.plans import corpus, scan

TEXTS = [
    "", "x = 1", "MD5 md5 and sha1\nsha-1", "hashlib.MD5(a)\n\nhashlib.sha1(b) MD5", "debug = True\ndebug=1",
    "de\u017f DE\u017f md5", "caf\u00e9 md5 \u00a0debug\u00a0=\u00a0True", "\x01 md5 \x02 sha1", "\x02md5\x02\nmd5", "login(a)\nlogin", "md5" * 300]


def test_matches_lie_where_a_plain_search_finds_them(spark):
    rules = [r for r in R.owasp_rules(kind="regex") if not {"u", "s"} & set(r.flags)]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    found = {}
    for r in patterns.match_regexes(docs, rules=rules).collect():
        found.setdefault((r.id, r.rule_id), []).append((r.matched, r.match_start, r.match_end, r.line_start))
    want = {}
    for i, t in enumerate(TEXTS):
        for rule in rules:
            hits = [(m[0], m.start(), m.end(), t.count("\n", 0, m.start()) + 1) for m in re.finditer(rule.pattern, t, re.I)]
            if hits:
                want[i, rule.rule_id] = sorted(hits)
    assert {k: sorted(v) for k, v in found.items()} == want and len(want) > 10


def test_a_text_is_gone_through_once_by_each_expression():
    rules = list(enumerate(R.owasp_rules(kind="regex")))
    sql = regex.match_groups("_may.regexes", rules)
    assert "CASE k WHEN" not in sql and "$0" in sql
    depth = max(len(re.findall("k < ", branch)) for branch in sql.split("regexp_extract_all")[:1])
    assert depth < 2 * len(rules)


@pytest.mark.parametrize("pattern", [r"\w\s", "a[^b]", "md5"])
def test_the_dialect_for_ascii(pattern):
    assert "\\p" not in regex.dialect(pattern, "i", plain=True) and regex.dialect(pattern, "i", plain=True).startswith("(?di)")
    assert regex.dialect(pattern, "i").startswith("(?diu)")


@pytest.mark.parametrize("pattern", ["\u017f", r"\u017f", r"\x{17f}", r"\p{L}"])
def test_expressions_beyond_ascii_keep_their_folding(pattern):
    assert regex.dialect(pattern, "i", plain=True) == regex.dialect(pattern, "i")


def test_files_are_the_same_and_find_their_snippet_once(spark):
    rows = [(k, c, None) for k in (0, 4, 5, 7, 8, 50, 100, 101, 131, -3, None) for c in (0, 1, 2, 17, 1499, -8, None)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date")
    plain = corpus.files_sql("transform(sequence(1, {n}), i -> {body})", "array_join({array}, chr(10))")
    key = lambda r: tuple(str(v) for v in r)
    ok = orders.where("coalesce(o_orderkey, 1) >= 0")
    want = sorted(map(key, corpus._run(spark, plain, orders=ok).collect()))
    assert sorted(map(key, corpus.files_of(ok).collect())) == want
    assert corpus._spark_snippet_sql().count(" % 50)") == 0 or corpus._spark_snippet_sql().count("i * 11") == 1


def test_flow_findings_join_neither_taint_nor_operations(files):
    stage = flow.flow_stage(files(("p/a.py", "q = request.GET('q')\nr = build_query(q)\ncursor.execute(r)\n")))
    found = flow.analyze(stage).findings
    assert found.count() > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Join") <= 3


def test_names_of_java_lines(files):
    body = "class A {\npublic void go(String s) {\nf = Paths.get(\"/d/\" + s);\n}\nclass B\u00e9 {\nvoid z\u00e9 (int x) {\ng = Paths.get(\"/d/\" + x);\n"
    got = syntax.scan_java(files(("p/A.java", body))).orderBy("line_number").select("line_number", "function_name", "class_name").collect()
    assert [tuple(r) for r in got] == [(3, "go", None), (7, "z\u00e9", "B\u00e9")]


def test_facts_of_unusual_nodes():
    text = "match x:\n  case {'a': 1, **r} if h(): g()\nasync def f[T](a=k()):\n  return [b(c) for c in d() if e(c)]\n"
    assert sorted(f["name"] for f in pyfacts.facts_of(text) if f["kind"] == "call") == ["b", "d", "e", "g", "h", "k"]


ODD = [
    "", "\n", "x = 1\x0c\neval(y)\n", "def _a():\n  return eval(b)\r\n# TODO", "def __a():\n  pass\ndef \\\n_():\n  pass", "password='x'\nkey=secret=\"s\"\n",
    "(api_key # c\n) = 'x'\nKEYS = 's'\na, token = 'xy'", "import pickle, dill\nfrom pickle import x\nimport pickle.a", "(", "eval(\n a,\n b)\n",
    "q = input(a)\nos.system(q)\nw=clean(q)\neval(w)\n", "\t todo \x1c\n FIXME security\x1d", "f = new File(a + b)\ng = Paths.get(c +\n d)\nMD5 md5",
    "a = b = input()\nx = foo(a, b)\neval(x, a)\nx = y = x = query(x)\n", "\n\n\neval(input(z))\n\n", "\x01 md5 \x02 debug=True\n\x02DES", "f().eval(x).exec(y)",
    "subprocess.run(c, shell=True)\nsubprocess . call (c, shell = True)\nsubprocess.Popen(c, shell=False)", "q = request . GET('k')\ncursor.execute(q, 'login')",
    "login(u, 'pw')\nlogin(a) log\nselect 'a' + b\nupdate 'x' + y + z", "public class K {\npublic void go(String s) {\nnew File(s + t); Runtime.getRuntime().exec(s);\n}"]


@pytest.mark.parametrize("names", ["qualified", "short"])
def test_ascii_texts_have_the_findings_of_column_expressions(spark, names):
    """A last line beyond ASCII, which has no finding itself, sends a text the other way."""
    options = scan.ScanOptions(run="r", flow_names=names)
    found = []
    for end in ("\n# e", "\n# é"):
        rows = [(f"p/{i}.{lang}", "p", lang, t + end) for i, t in enumerate(ODD) for lang in ("py", "java")]
        result = scan.scan(spark.createDataFrame(rows, "path string, project string, lang string, content string").repartition(2), options)
        found.append(sorted(str(tuple(r)).replace("é", "e") for r in result.findings.collect()))
        lines = sorted(tuple(r) for r in result.files.select("path", "n_lines").collect())
        found[-1] += lines
    assert found[0] == found[1] and len(found[0]) > 150
    assert {"flow", "java_regex", "line", "literal", "py_syntax", "regex"} <= {f.split("', '")[1] for f in found[0] if isinstance(f, str)}


def test_scan_settings_hold_for_ascii_texts(files):
    df = files(("p/a.py", "password = 'admin'\neval(x)  # TODO\n"), ("p/A.java", "f = new File(a + b); // MD5\n"))
    kinds = lambda **o: {r.finder for r in scan.scan(df, scan.ScanOptions(**o)).findings.collect()}
    assert kinds() == {"line", "literal", "regex", "py_syntax", "java_regex"}
    assert kinds(enable_ast_analysis=False) == {"line", "literal", "regex"}
    assert kinds(enable_flow_analysis=False) == {"line", "literal", "regex", "py_syntax", "java_regex"}
    with pytest.raises(ValueError, match="names"):
        scan.scan(df, scan.ScanOptions(flow_names="long"))


@pytest.mark.parametrize("text", ODD)
def test_a_text_that_is_not_parsed_has_nothing_to_find(text):
    facts, lines = pyfacts.placeless_facts(text), plainscan._lines(text)
    placed = [{k: v for k, v in f.items() if k not in ("fn", "cls", "chain", "blocks", "end_line")} for f in pyfacts.facts_of(text)]
    assert [{k: v for k, v in f.items() if k != "end_line"} for f in facts] == placed
    if list(plainscan.syntax_hits(facts, lines, frozenset(R.PY_SCORES))):
        assert plainscan.may_have_syntax_hits(text)
    if any(row[2] == "user_input" for row in plainscan.flow_rows(facts, lines, "qualified")):
        assert plainscan.may_have_flows(text)


@pytest.mark.parametrize("text", ["", "a", "a\n", "\na\n\nba a\nA", "b\na", "aa\naa"])
@pytest.mark.parametrize("needle", ["", "a", "aa", "\n"])
def test_lines_with_a_needle(text, needle):
    lines = plainscan._lines(text)
    assert list(plainscan.with_needle(text, needle, len(lines))) == [n for n, line in enumerate(lines) if needle in line]


def test_flow_findings_need_no_shuffle_and_are_the_links_that_start(files):
    rng = random.Random(3)
    kinds = ["{a} = input({b})", "{a} = {b} = f({b}, {c})", "os.system({a}, {b})", "{a} = clean({b}, {c})", "{a} = query({b})", "cursor.execute({a}, x, {a})",
             "{a} = {a} = step({a} + {b}, {c})", "{a} = 'x'", "{a} = filter()"]
    texts = ["\n".join(rng.choice(kinds).format(a=rng.choice("uvw"), b=rng.choice("uvw"), c=rng.choice("uvw")) for _ in range(15)) for _ in range(60)]
    for longest in (None, 2):
        graph = flow.analyze_files(files(*((f"p/{i}.py", t) for i, t in enumerate(texts))), max_path_length=longest)
        assert not re.search("Exchange|Join|Window", graph.findings._jdf.queryExecution().executedPlan().toString())
        keys = ["file_id", "src", "dst"]
        got = sorted(tuple(r) for r in graph.findings.select(*keys, "path_length", "source_line", "source_context", "sink_line", "sink_context").collect())
        nodes = graph.nodes.select("file_id", "node", "line", "context")
        sources = nodes.withColumnsRenamed({"node": "src", "line": "source_line", "context": "source_context"})
        sinks = nodes.withColumnsRenamed({"node": "dst", "line": "sink_line", "context": "sink_context"})
        links = graph.links.where("starts").join(sources, ["file_id", "src"]).join(sinks, ["file_id", "dst"])
        want = sorted(tuple(r) for r in links.select(*keys, "length", "source_line", "source_context", "sink_line", "sink_context").collect())
        assert got == want and len(want) > 50


def test_expressions_for_lower_case_find_the_same():
    text = "\n".join([*ODD, *TEXTS]).encode("ascii", "ignore").decode() + " Q S _ ^ SHA-1 Ab12 AB"
    cheap = 0
    patterns_ = [(r.pattern, r.flags) for r in R.owasp_rules(kind="regex") + R.rule_rows("java")]
    for pattern, flags in [*patterns_, (r"\S+ \D", "i"), ("[A-z]+", "i"), ("[!-Z]+", "i"), (r"(?P<Ab>B)", "i"), (r"\x41b", "i"), ("[A-Z]b", ""), ("[^A-Z]b", "i"), (r"(a)\1", "i")]:
        blind = re.compile(pattern, (re.I if "i" in flags else 0) | (re.S if "s" in flags else 0))
        quick = plainscan.for_lower_case(pattern, flags)
        cheap += not quick.flags & re.I
        assert [m.span() for m in quick.finditer(text.lower() if "i" in flags else text)] == [m.span() for m in blind.finditer(text)], pattern
    assert cheap >= len(patterns_)
