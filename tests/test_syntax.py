from scanframe.operators import control, syntax

PY = '''import pickle, os
class Box:
    @deco(eval(x))
    def _open(self, key):
        api_key = "s3"; a.token = "t"; (k, key2) = "ab"
        self.KEY = secret = "z"
        return subprocess.run(cmd, shell=True)
async def run():
    def inner(): exec(compile(src, "f", "exec"))
    db().execute("a %s" % name, other)
'''
JAVA = '''class First { void m(String s) {
public class Shop {
    public void open(String s) {
        new File("/d/" + s);
    }
    Runtime.getRuntime().exec(s);
}
'''


def rows(df, *cols):
    found = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*cols).collect()]
    return sorted(found, key=str)


def test_python_details(files):
    got = rows(syntax.scan_python(files(("p/a.py", PY), ("p/a.java", PY))),
               "node_type", "function_name", "class_name", "variables_used", "call_chain", "line_number")
    assert set(got) == {
        ("InsecureDeserialization", None, None, ("pickle",), (), 1),
        ("InsecureDesign", "_open", "Box", (), (), 4),
        ("CodeInjection", "_open", "Box", ("x",), ("deco", "eval"), 3),
        ("HardcodedCredentials", "_open", "Box", ("api_key",), (), 5),
        ("HardcodedCredentials", "_open", "Box", ("secret",), (), 6),
        ("CommandInjection", "_open", "Box", ("cmd",), ("subprocess.run",), 7),
        ("CodeInjection", "inner", None, (), ("exec",), 9),
        ("CodeInjection", "inner", None, ("src",), ("exec", "compile"), 9),
    }
    assert len(got) == 8


def test_sql_formatting_is_opt_in(files):
    df = files(("p/a.py", PY))
    extra = syntax.scan_python(df, sql_formatting=True).where("node_type = 'SQLInjection'")
    assert rows(extra, "function_name", "variables_used", "call_chain", "line_number") == [("execute", ("name",), ("execute",), 10)]
    assert len(extra.first().context_lines) == 3


def test_context_is_clipped(files):
    got = syntax.scan_python(files(("p/a.py", "eval(a)\n"), ("p/b.py", "x = 1\neval(a)"))).orderBy("path").collect()
    assert [r.context_lines for r in got] == [["eval(a)"], ["x = 1", "eval(a)"]]


def test_unparsable_and_empty(files):
    df = files(("p/a.py", "f(\neval(x)"), ("p/b.py", ""), ("p/c.py", "a\x00b"))
    assert syntax.scan_python(df).count() == 0
    assert rows(syntax.fact_rows(df), "path", "kind") == [("p/a.py", "parse_error"), ("p/c.py", "parse_error")]


def test_java_details(files):
    got = rows(syntax.scan_java(files(("p/A.java", JAVA))), "node_type", "function_name", "class_name", "complexity_score",
               "line_number", "variables_used")
    # the word before a bracket counts as a method, here on the matched line and two lines above
    assert got == [
        ("CommandInjection", "File", "Shop", 8, 6, ("Runtime", "getRuntime", "exec")),
        ("PathTraversal", "File", "Shop", 6, 4, ("File", "d")),
    ]


def test_java_look_back_is_bounded(files):
    def source(gap):
        return "// top\nclass Far {\nint meth(int a) {\n" + "\n" * gap + "Runtime.getRuntime().exec(s);"

    def names(gap):
        r = syntax.scan_java(files(("p/A.java", source(gap)))).first()
        return r.function_name, r.class_name

    assert names(17) == ("meth", "Far")
    assert names(18) == (None, "Far")
    assert names(46) == (None, "Far")
    assert names(47) == (None, None)


def test_first_line_is_never_looked_at(files):
    r = syntax.scan_java(files(("p/A.java", "class A { int f(int a) { Runtime.getRuntime().exec(s);"))).first()
    assert (r.function_name, r.class_name) == (None, None)


def test_control_checks(files):
    body = ("def f(n):\n    return n\n    eval(n)\n"
            "try:\n    exec(a)\nexcept E:\n    os.system(b)\n"
            "while a:\n    break\n    if b:\n        eval(c)\n")
    df = files(("p/a.py", body), ("p/a.py", "eval(z)"))
    facts = control.numbered_facts(df)
    assert sorted(r.line for r in control.unreachable_sinks(facts).collect()) == [3, 11]
    assert sorted(r.line for r in control.unguarded_sinks(facts).collect()) == [1, 3, 7, 11]
    assert rows(control.control_nodes(syntax.fact_rows(df)), "name", "n") == [("if", 1), ("try", 1), ("while", 1)]
