import random
import re

from pyspark.sql import functions as F

from scanframe import rules as R
from scanframe.functions import regex, text
from scanframe.operators import patterns
from scanframe.plans import corpus

WORDS = [
    "password", "pwd", "= ", "'admin'", '"x"', "login", "log", "(", ")", "\n", " ", "\t", "DES", "description", "3DES",
    "decrypt", "md5", "SHA-1", "SELECT", "where", "id = $", "{x}", "+", "execute", "cursor.execute", "%s", "f'", "def get",
    "():", "@login_required", "@app.route", "@GetMapping", "authorize", "yaml.load", "Loader=yaml.SafeLoader", "https://",
    "TODO", "security", "token", "eval", "json.loads", "from Crypto", "graphy", "é", "ß", "\U0001F600", "ſ", "İ", "ı", "K",
    "\u00a0", "\u2003", "key", "print", "debug", "=", "True", "user_input", "requests.get", "pickle.loads", "shell", "audit",
    "@PreAuthorize", "failed", "success", "\x1c", "\x01", "flask==0.", "²", "Runtime.getRuntime().exec", "axios.get",
]


def expected(pattern, flags, content):
    rx = re.compile(pattern, (re.I if "i" in flags else 0) | (re.S if "s" in flags else 0))
    return [(m.group(), m.start(), m.end(), content[: m.start()].count("\n") + 1) for m in rx.finditer(content)]


def test_matches_equal_python(spark):
    rnd = random.Random(7)
    words = WORDS + [s.replace("{i}", "1").replace("{p}", "2") for s in corpus.PYTHON_SNIPPETS + corpus.JAVA_SNIPPETS]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["md5 " * 700 + "\nSHA1", "", "\n\n"]
    rules = [r for r in R.rule_rows("owasp", "java") if r.kind == "regex"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, content string")
    got = {tuple(r) for r in patterns.match_regexes(df, rules=rules).select(
        "name", "rule_id", "matched", "match_start", "match_end", "line_start").collect()}
    want = {
        (str(i), r.rule_id, *m) for i, t in enumerate(texts) for r in rules for m in expected(r.pattern, r.flags, t)
    }
    assert len(want) > 2000
    assert {w[1] for w in want} >= {r.rule_id for r in rules if r.ruleset == "owasp"}
    assert got == want


def test_positions_across_blocks(spark):
    n = 3 * regex.BLOCK + 5
    body = "\n".join(f"{'x' * (i % 4)}md5" for i in range(n))
    df = spark.createDataFrame([("a", body)], "name string, content string")
    rule = [r for r in R.owasp_rules() if r.rule_id == "A02-hash.rx1"]
    got = [tuple(r) for r in patterns.match_regexes(df, rules=rule).orderBy("match_start").select(
        "matched", "match_start", "match_end", "line_start").collect()]
    assert got == expected(rule[0].pattern, "i", body)


def test_rule_counts():
    assert [len(R.rule_rows(s)) for s in ("basic", "owasp", "java")] == [17, 140, 13]
    assert (len(R.owasp_rules(kind="literal")), len(R.owasp_rules(kind="regex"))) == (99, 41)
    assert {r.category for r in R.owasp_rules()} == set(R.CATEGORIES)
    assert R.owasp_rules("none") == []
    assert len({r.rule_id for r in R.rule_rows(extra=False)}) == len(R.rule_rows())


def test_line_scan(files):
    found = patterns.scan_lines(files(("p/a.py", "\u2003app.run(DEBUG=True)  \r\nx\r# todo MD5"))).select(
        "line_number", "type", "code_snippet").collect()
    assert sorted(map(tuple, found)) == [
        (1, "DEBUG=true", "app.run(DEBUG=True)"), (1, "debug=True", "app.run(DEBUG=True)"),
        (3, "MD5", "# todo MD5"), (3, "TODO", "# todo MD5")]


def test_scan_text_names_and_categories(spark):
    df = spark.createDataFrame([(None, "DES"), ("n", "clean"), (None, None)], "name string, body string")
    rows = patterns.scan_text(df, "body", "name").collect()
    assert {r.filename for r in rows} == {"unknown"}
    assert {r.line_start for r in rows} == {None, 1}
    assert patterns.scan_text(df, "body", "name", "nothing").count() == 0
    only = patterns.scan_text(df, "body", category="A02_Cryptographic_Failures").select("category").distinct().collect()
    assert [r[0] for r in only] == ["A02_Cryptographic_Failures"]
    stats = patterns.statistics(df, patterns.scan_text(df, "body", "name")).first()
    assert tuple(stats) == (3, len(rows))


def test_user_rules(files, spark):
    words = ["Foo", "bar", "zip", "", "b", "ÉCL", "a bar F", "no such thing", None]
    table = spark.createDataFrame([(f"u{i}", "literal", w) for i, w in enumerate(words)] + [("x", "regex", "foo")],
                                  "rule_id string, kind string, pattern string")
    texts = {"p/a.py": "FOO", "p/b.py": "a bar foo", "p/c.py": "", "p/d.py": "éclat"}
    want = {(p, f"u{i}") for p, t in texts.items() for i, w in enumerate(words) if w is not None and w.lower() in t.lower()}
    df = files(*texts.items())
    assert {(r.path, r.rule_id) for r in patterns.match_rule_table(df, table).collect()} == want
    plan = patterns.match_rule_table(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_very_many_user_rules(files, spark):
    rng = random.Random(3)
    letters = "abcdef "
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
    texts = {f"p/{k}.py": "".join(rng.choice(letters) for _ in range(200)) for k in range(20)}
    table = spark.createDataFrame([(f"u{i}", "literal", w) for i, w in enumerate(words)], "rule_id string, kind string, pattern string")
    want = {(p, f"u{i}") for p, t in texts.items() for i, w in enumerate(words) if w in t}
    got = patterns.match_rule_table(files(*texts.items()), table).select("path", "rule_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_rules_hang_on_their_rarest_piece(files, spark, monkeypatch):
    """Patterns that begin with what every text holds are looked up by what few hold."""
    rng = random.Random(9)
    texts = {f"p/{k}.py": " " * 40 + "".join(rng.choice("abcdef") for _ in range(60)) for k in range(200)}
    for k in range(0, 200, 20):
        texts[f"p/{k}.py"] += "      xyz" + str(k)
    words = [f"      XYZ{k}" for k in range(0, 200, 10)] + ["      q", " \U0001F600x", "a", "é" * 5]
    table = spark.createDataFrame([(f"u{i}", "literal", w) for i, w in enumerate(words)], "rule_id string, kind string, pattern string")
    monkeypatch.setattr(patterns, "TESTED", 7)
    met = []
    sieve = patterns._sieve
    monkeypatch.setattr(patterns, "_sieve", lambda df, column, *a: met.append(df) or sieve(df, column, *a))
    got = {(r.path, r.rule_id) for r in patterns.match_rule_table(files(*texts.items()), table).collect()}
    assert got == {(p, f"u{i}") for p, t in texts.items() for i, w in enumerate(words) if w.lower() in t}
    from scanframe.functions.grams import hashes

    anchors = {r._anchor for r in met[1].collect()}
    assert int(hashes("      ", 6)[0]) not in anchors and len(anchors) <= len(words)


def test_pieces_and_sieve():
    import numpy as np

    from scanframe.functions import grams

    text = "añ\U0001F600 abcabc\ud800"
    assert grams.GRAM == 6 and len(grams.hashes(text, 4)) == len(text) - 3 and len(grams.hashes("ab", 4)) == len(grams.hashes("", 1)) == 0
    assert grams.hashes("xabcd", 4)[1] == grams.hashes("abcde", 4)[0] != grams.hashes("abdc", 4)[0]
    assert grams.hashes("a", 1)[0] != grams.hashes("a\0\0\0", 4)[0]
    h = np.unique(grams.hashes("".join(map(chr, range(100, 900))), 3))
    power = 14
    words = {}
    for x in h.view(np.uint64).tolist():
        slot = x >> (64 - power)
        words[slot >> 6] = words.get(slot >> 6, 0) | 1 << (slot & 63)
    sieve = grams.Sieve(power, words)
    assert (sieve.passing(h) == h).all()
    others = grams.hashes("".join(map(chr, range(5000, 9000))), 3)
    assert len(sieve.passing(others)) < 0.15 * len(others)


def test_settings():
    rules = R.configure(R.owasp_rules(), {"A10_SSRF"}, {"A03_Injection": "Low"})
    assert "A10_SSRF" not in {r.category for r in rules}
    assert {r.severity for r in rules if r.category == "A03_Injection"} == {"Low"}


def test_lines_and_counts(spark):
    rows = [("",), ("a",), ("a\n",), ("a\n\nb",), ("\n",)]
    df = spark.createDataFrame(rows, "t string").select(
        text.line_count(F.col("t")).alias("n"), text.lines(F.col("t")).alias("l"))
    assert [r.n for r in df.collect()] == [0, 1, 1, 3, 1]
    assert df.collect()[2].l == ["a"]


def test_decoding(spark):
    raw = [(b"\xff\xfe\x00\x01\x02\x03",), ("é\r\nx".encode(),), (b"ok\xc3",)]
    df = spark.createDataFrame(raw, "b binary").select(text.tolerant_text(F.col("b")).alias("t"), text.strict_ok(F.col("b")).alias("ok"))
    assert [tuple(r) for r in df.collect()] == [("\x00\x01\x02\x03", False), ("é\nx", True), ("ok", False)]


def test_no_repeated_scan_in_plan(files):
    plan = patterns.scan_text(files(("a", "b")), "content", "path")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
