import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scanframe.operators import history, reports
from scanframe.plans import output, scan, store
from scanframe.sources import tree

APP = 'import pickle\npassword = "admin"\nos.system("ls " + d)\n# TODO debug=True\n'


@pytest.fixture()
def folder(tmp_path):
    for name, data in {
        "app.py": APP.encode(), "pkg/__init__.py": b"", "pkg/.h.py": b"eval(x)", "_d/q.py": b"x = 1", "A.java": b"MD5",
        "B.JAVA": b"MD5", "notes.txt": b"MD5", "bin.py": b"\xff\xfe\x00\x01\x02\x03", "bad.py": b"f(\neval(x)",
    }.items():
        target = tmp_path / "proj" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return str(tmp_path / "proj")


def names(df, folder):
    return sorted(os.path.relpath(r.path, folder) for r in df.collect())


WANTED = ["A.java", "_d/q.py", "app.py", "bad.py", "bin.py", "pkg/.h.py", "pkg/__init__.py"]


def test_tree_lists_hidden_and_empty_files(spark, folder):
    df = tree.read_tree(spark, folder)
    assert names(df, folder) == WANTED
    assert {r.project for r in df.collect()} == {"proj"}
    assert [r.is_utf8 for r in df.where("path like '%bin.py'").collect()] == [False]


def test_every_folder_is_listed_once(spark, folder, tmp_path, monkeypatch):
    big = tmp_path / "proj" / "big"
    big.mkdir()
    for k in range(300):
        (big / f"f{k}.py").write_text("x")
    os.symlink(str(big), str(tmp_path / "proj" / "again"))
    fs, start = tree._store(folder)
    asked = []
    listing = tree._entries

    def walk(at):
        asked.append(at)
        for path, kind, _ in list(listing(fs, at, tree.SUFFIXES)):
            if kind == "folder":
                walk(path)

    walk(start)
    assert len(asked) == len(set(asked)) == 4  # the link is not followed
    monkeypatch.setattr(tree, "PART_FILES", 50)
    listed = tree.list_tree(spark, folder)
    assert listed.count() == len(WANTED) + 300
    read = tree.read_files(listed, folder)
    assert read.rdd.getNumPartitions() >= 6
    assert read.where("content is not null").count() == len(WANTED) + 300


def test_single_file_missing_and_size(spark, folder):
    assert names(tree.read_tree(spark, folder + "/notes.txt"), folder) == ["notes.txt"]
    with pytest.raises(FileNotFoundError, match="missing"):
        tree.read_tree(spark, folder + "/missing")
    limited = {os.path.relpath(r.path, folder): r for r in tree.read_tree(spark, folder, max_file_bytes=20).collect()}
    assert sorted(limited) == WANTED
    assert {n: r.problem for n, r in limited.items() if r.problem} == {"app.py": "too large"}
    assert limited["app.py"].content is None
    uri = tree.read_tree(spark, "file://" + folder)
    assert names(uri, folder) == WANTED


def test_what_cannot_be_read_stays_as_a_row(spark, folder):
    listed = tree.list_tree(spark, folder)
    os.remove(folder + "/app.py")
    rows = {os.path.relpath(r.path, folder): r for r in tree.read_files(listed, folder).collect()}
    assert sorted(rows) == WANTED and rows["app.py"].content is None and rows["app.py"].problem == "unreadable"
    fs, _ = tree._store(folder)
    assert list(tree._entries(fs, folder + "/gone", (".py",))) == [(folder + "/gone", "unreadable folder", 0)]
    files = tree.decode_files(tree.read_files(listed, folder), "proj")
    options = scan.ScanOptions(run="r", root="/x", max_file_bytes=5)
    result = scan.scan(files, options)
    row = scan.scan_rows(files.selectExpr("project", "timestamp'2024-05-06 07:08:09' AS ts"), result.files, options, 1.5).first()
    assert (row.total_files, row.scan_duration, row.project_path) == (7, 1.5, "/x/proj")
    assert row.skipped_files == result.files.where("problem is not null").count() == 3


def test_scan_of_a_tree(spark, folder, tmp_path):
    files = tree.read_tree(spark, folder)
    options = scan.ScanOptions(run="scan")
    result = scan.scan(files, options)
    assert result.files.count() == len(WANTED)
    kinds = {(r.finder, r.type, os.path.basename(r.file_path)) for r in result.findings.collect()}
    assert ("line", "MD5", "A.java") in kinds
    assert ("line", "eval(", "bad.py") in kinds  # does not parse, literals still match
    assert ("py_syntax", "CodeInjection", ".h.py") in kinds
    assert not [k for k in kinds if k[0] == "py_syntax" and k[2] == "bad.py"]
    scans = scan.scan_rows(files.selectExpr("project", "timestamp'2024-05-06 07:08:09' AS ts"), result.files, options)
    assert (scans.first().scan_id, scans.first().total_files) == ("scan_proj", 7)
    written = output.write_report(scans, result.findings, str(tmp_path / "out"), ["json", "executive", "pdf"])
    assert sorted(written) == ["executive", "json"]
    assert "Scan Date: 2024-05-06" in "\n".join(r.value for r in spark.read.text(written["executive"]).collect())
    assert spark.read.json(written["json"] + "/vulnerabilities").count() == result.findings.count()
    assert sorted(output.write_report(scans, result.findings, str(tmp_path / "all"))) == ["executive", "html", "json"]
    output.export_json(scans, result.findings, str(tmp_path / "export"))
    assert spark.read.text(str(tmp_path / "export")).count() == result.findings.count() + 1
    output.write_console(result.findings, str(tmp_path / "console"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "console") + "/scan_id=scan_proj").collect())
    assert text.startswith("1. ")
    assert f"\n{result.findings.count()}. " in text


def test_invalid_bytes_silence_syntax_only(spark):
    from scanframe.operators import flow, syntax

    raw = spark.createDataFrame(
        [("p/a.py", b"eval(x)\xff"), ("p/A.java", b"new File(a + b)\xff"), ("p/b.py", b"eval(x)")], "path string, content binary")
    files = tree.decode_files(raw, "p")
    assert [r.path for r in syntax.scan_syntax(files).collect()] == ["p/b.py"]
    assert syntax.scan_java(files).count() == 0
    assert sorted(r.file_path for r in scan.scan(files).findings.where("finder = 'line'").collect()) == ["p/a.py", "p/b.py"]
    assert flow.totals(flow.analyze_files(files)).first().files_analyzed == 2


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/x.py", "eval(a)")
        z.writestr("a/bad_sum.py", "damaged")
        z.writestr("a/_y.java", "")
        z.writestr("a/readme.md", "no")
        z.writestr("a/bad_stream.py", "squeezed " * 50, zipfile.ZIP_DEFLATED)
        z.writestr("a/secret.py", "hidden")
        z.writestr("a/z.py", "last")
    data = bytearray(buffer.getvalue())
    data[data.index(b"damaged")] ^= 1
    at = data.index(b"a/bad_stream.py") + len("a/bad_stream.py")
    data[at:at + 4] = b"\xff\xff\xff\xff"
    at = data.rindex(b"a/secret.py") - 46 + 8  # the flags in the directory say: encrypted
    data[at] |= 1
    df = spark.createDataFrame([("ok.zip", bytes(data)), ("bad.zip", b"nope")], "path string, content binary")
    rows = {r.path: (r.content, r.problem) for r in tree.expand_archives(df).collect()}
    damaged = (None, "damaged archive member")
    assert rows == {
        "ok.zip!a/x.py": (b"eval(a)", None), "ok.zip!a/_y.java": (b"", None), "ok.zip!a/bad_sum.py": damaged,
        "ok.zip!a/bad_stream.py": damaged, "ok.zip!a/secret.py": damaged, "ok.zip!a/z.py": (b"last", None), "bad.zip": damaged}
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "ok.zip").write_bytes(bytes(data))
    (tmp_path / "up" / "q.py").write_text("x = 1")
    found = tree.read_tree(spark, str(tmp_path / "up"), archives=True)
    assert found.count() == 7 and found.where("problem is null").count() == 4


def test_members_of_archives_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    top = tmp_path / "up"
    top.mkdir()
    content = {}
    with zipfile.ZipFile(top / "big.zip", "w") as z:
        for k in range(60):
            name = f"m{k:02}.py"
            content[f"big.zip!{name}"] = bytes(rng.choices(b"abc\n", k=rng.choice([0, 10, 4000, 30_000])))
            z.writestr(name, content[f"big.zip!{name}"], rng.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]))
        z.writestr("bomb.py", b" " * 3_000_000, zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(top / "none.zip", "w"):
        pass
    lie = bytearray((top / "big.zip").read_bytes())
    at = lie.rindex(b"bomb.py") - 46 + 24  # its size in the directory
    assert int.from_bytes(lie[at:at + 4], "little") == 3_000_000
    lie[at:at + 4] = (17).to_bytes(4, "little")
    (top / "lie.zip").write_bytes(bytes(lie))
    (top / "cut.zip").write_bytes(bytes(lie[:-30]))
    (top / "a.py").write_bytes(b"x = 1")
    asked = []
    deal = tree.deal
    monkeypatch.setattr(tree, "PART_BYTES", 100_000)
    monkeypatch.setattr(tree, "deal", lambda listed, limit=None: asked.append(deal(listed, limit)) or asked[-1])
    rows = {os.path.relpath(r.path, top): r for r in tree.read_tree(spark, str(top), max_file_bytes=100_000, archives=True).collect()}
    want = {**content, **{k.replace("big", "lie"): v for k, v in content.items()}, "a.py": b"x = 1"}
    assert {k: r.content.encode() for k, r in rows.items() if r.problem is None} == want
    problems = {k: r.problem for k, r in rows.items() if r.problem}
    assert problems == {"big.zip!bomb.py": "too large", "lie.zip!bomb.py": "damaged archive member", "cut.zip": "damaged archive member"}
    dealt, parts = asked[-1]  # the members
    assert parts > 8 and dealt.where("archive like '%big.zip'").select("part").distinct().count() > 4


def test_a_member_is_unpacked_no_further_than_its_limit():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("bomb.py", b" " * 50_000_000, zipfile.ZIP_DEFLATED)
    (r,) = tree._directory(buffer, "z", (".py",))
    assert tree._member(buffer, r, 1000) == (None, "too large")
    assert tree._member(buffer, {**r, "at": 5}, 1000) == (None, "damaged archive member")


def test_two_scans_of_one_project_stay_apart(spark, files, tmp_path):
    df = files(("p/a.py", APP), ("p/b.py", "x = 1")).drop("ts")
    folder = str(tmp_path / "history")
    ids = set()
    for _ in range(2):
        scans, findings = scan.write_scan(df, folder, scan.ScanOptions(enable_flow_analysis=False))
        row = scans.first()
        ids.add(row.scan_id)
        assert scans.count() == 1 and row.total_files == 2 and row.scan_duration > 0
    n = findings.count()
    scans, findings, counted = (store.read(spark, folder, t) for t in ("scans", "findings", "counts"))
    assert len(ids) == 2 and findings.count() == 2 * n
    totals = reports.severity_summary_of(scans.select("scan_id", "project", "ts"), findings)
    assert {r.total_vulnerabilities for r in totals.collect()} == {n}
    assert [r.vulnerability_change for r in history.trend(totals).collect()] == [0]
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(history.summaries(scans, counted), reports.severity_summary_of(scans, findings))
    assert same(history.history_of(scans, counted), history.history(scans, findings))
    assert same(history.distribution_of(counted), history.distribution(findings))
    assert same(history.overall_of(scans, counted), history.overall_statistics(scans, findings))


def test_a_scan_that_fails_on_its_way_can_be_repeated(files, spark, tmp_path, monkeypatch):
    df = files(("p/a.py", APP), ("q/b.py", "x = 1")).drop("ts")
    folder = str(tmp_path / "store")
    options = scan.ScanOptions(run="nightly", enable_flow_analysis=False)
    put = store.put
    for fails_at in ("findings", "counts", "scans", "commit"):
        def broken(rows, at, table, attempt, fails_at=fails_at):
            if table == fails_at:
                raise OSError("lost")
            return put(rows, at, table, attempt)

        with monkeypatch.context() as m:
            m.setattr(store, "put", broken)
            if fails_at == "commit":
                m.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                scan.write_scan(df, folder, options)
        assert all(store.read(spark, folder, t).isEmpty() for t in store.TABLES)
    first = scan.write_scan(df, folder, options)
    n = [t.count() for t in first]
    assert n[0] == 2 and n[1] > 0
    again = scan.write_scan(df, folder, options)
    assert [t.count() for t in again] == n and [store.read(spark, folder, t).count() for t in ("scans", "findings")] == n
    row = store.manifest(spark, folder).first()
    assert (row.run, row.n_scans, row.n_findings) == ("nightly", *n)
    # two attempts at the same time: the first that was committed counts
    late = store.new_attempt()
    for t, rows in zip(("scans", "findings"), first, strict=True):
        put(rows.limit(1), folder, t, late)
    store.commit(spark, folder, "nightly", late)
    assert store.manifest(spark, folder).count() == 1 and [store.read(spark, folder, t).count() for t in ("scans", "findings")] == n


def test_a_look_up_opens_the_files_of_one_run(files, spark, tmp_path):
    folder = str(tmp_path / "store")
    scans, findings = scan.write_scan(files(("p/a.py", APP)).drop("ts"), folder, scan.ScanOptions(run="r", enable_flow_analysis=False))
    for k in range(30):
        attempt = store.new_attempt()
        for t, rows in (("scans", scans), ("findings", findings)):
            store.put(rows.withColumn("scan_id", F.lit(f"r{k}_p")).coalesce(1), folder, t, attempt)
        store.commit(spark, folder, f"r{k}", attempt)
    for t, n in (("scans", 1), ("findings", findings.count())):
        found = store.find(spark, folder, "r7_p", t)
        assert found.count() == n and {r.scan_id for r in found.collect()} == {"r7_p"}
        assert len({os.path.dirname(f) for f in found.inputFiles()}) == 1
        assert store.find(spark, folder, "r99_p", t).isEmpty()
    assert store.read(spark, folder, "scans").count() == 31 and store.read(spark, folder, "scans", []).isEmpty()
    assert store.manifest(spark, str(tmp_path / "nothing")).isEmpty()


def test_settings_of_a_scan(files):
    df = files(("p/a.py", APP), ("p/b.java", "new File(a + b)"), ("p/c.py", "u = request.GET('q')\nquery(u)"))
    kinds = lambda **o: {r.finder for r in scan.scan(df, scan.ScanOptions(**o)).findings.collect()}
    assert kinds() == {"line", "literal", "regex", "py_syntax", "java_regex", "flow"}
    assert kinds(enable_flow_analysis=False) == {"line", "literal", "regex", "py_syntax", "java_regex"}
    assert kinds(enable_ast_analysis=False, enable_flow_analysis=False) == {"line", "literal", "regex"}
    low = scan.scan(df, scan.ScanOptions(severity_overrides={"A07_Auth_Failures": "Low"}, include_snippets=False)).findings
    assert {r.severity for r in low.where("owasp_category = 'A07_Auth_Failures'").collect()} == {"Low"}
    assert {r.code_snippet for r in low.collect()} == {""}
    off = scan.scan(df, scan.ScanOptions(disabled_categories={"A03_Injection"})).findings
    assert off.where("owasp_category = 'A03_Injection'").count() == 0
    found = scan.scan(df).findings
    for k in (3, 2000):
        assert reports.first_findings(found, k).count() == min(k, found.count())


def test_scan_without_flow_needs_no_shuffle(files):
    r = scan.scan(files(("p/a.py", APP)), scan.ScanOptions(enable_flow_analysis=False)).findings
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert plan.count("ArrowEvalPython") == 1  # one pass through Python for needles and syntax


def test_files_are_dealt_by_bytes(spark, monkeypatch):
    rng = random.Random(6)
    tables = {
        "four large of forty": [400_000 if k % 10 == 3 else 9 for k in range(40)],
        "one of half the bytes": [10_000_000 if k == 17 else 100_000 for k in range(100)],
        "mixed": [int(rng.paretovariate(0.9) * 1000) for _ in range(3000)],
        "empty files": [0] * 50, "one file": [5], "none": []}
    for bytes_per_part in (tree.PART_BYTES, 300_000):
        monkeypatch.setattr(tree, "PART_BYTES", bytes_per_part)
        cost = bytes_per_part // tree.PART_FILES
        for name, sizes in tables.items():
            rows = [(f"d/{k:04}.py", "file", s) for k, s in enumerate(sizes)] + ([("d/gone", "unreadable folder", 0)] if sizes else [])
            listed = spark.createDataFrame(rows, tree._LISTED).repartition(3)
            dealt, parts = tree.deal(listed)
            got = dealt.repartitionById(parts, "part").select("path", "size", "part", F.spark_partition_id().alias("task")).collect()
            assert sorted(r.path for r in got) == sorted(r[0] for r in rows) and all(r.task == r.part < parts for r in got), name
            tasks = {}
            for r in got:
                tasks.setdefault(r.task, []).append(r.size + cost)
            total = sum(s + cost for _, _, s in rows)
            shares = max(1, -(-total // bytes_per_part), min(len(rows), 4))
            assert parts <= 3 * shares, name
            assert all(sum(t) <= 1.5 * -(-total // shares) + 1 or len(t) == 1 for t in tasks.values()), name


def test_running_totals(spark):
    from scanframe.operators.numbering import running_totals

    rows = [(k % 700, k) for k in range(2000)]
    got = running_totals(spark.createDataFrame(rows, "key long, n long").repartition(5), ["key", "n"], "n").collect()
    total = 0
    want = []
    for key, n in sorted(rows):
        want.append((key, n, total))
        total += n
    assert sorted(tuple(r) for r in got) == want
    assert running_totals(spark.createDataFrame([], "key long, n long"), ["key"], "n").count() == 0
