import random

from pyspark.sql import functions as F

from scanframe.operators import history, reports
from scanframe.operators.numbering import number_rows
from scanframe.schemas import FINDINGS, SCANS
from scanframe.streaming import continuous


def finding(scan_id, category, severity, path="p/a.py", line=1, kind="t"):
    return (scan_id, "line", kind, severity, path, line, "d", category, "r", "code", None)


def tables(spark, scans, findings):
    rows = [(s, "p", f"/x/{s}", *[None] * (len(SCANS) - 3)) for s in scans]
    return spark.createDataFrame(rows, SCANS), spark.createDataFrame(findings, FINDINGS)


def test_empty_scan_and_defaults(spark):
    scans, findings = tables(spark, ["clean"], [])
    r = reports.scan_report(scans, findings).first()
    assert (r.total_vulnerabilities, r.risk_level, r.by_category, r.top_categories) == (0, "LOW", {}, [])
    assert (r.total_files, r.coverage_percentage, r.false_positive_rate, r.confidence_score) == (0, 85.0, 0.1, 0.85)
    assert r.recommendations == reports.ADVICE_ALWAYS
    assert all(c.compliant for c in r.compliance_status) and len(r.compliance_status) == 10
    assert tuple(history.overall_statistics(scans, findings).first()) == (1, 0, 0.0, "None")
    assert history.overall_statistics(scans.limit(0), findings).first().avg_vulnerabilities_per_scan == 0.0
    assert [r.failed for r in reports.gate(scans, findings).collect()] == [False]
    assert "Top Vulnerability Categories:" in reports.executive_summary(reports.scan_report(scans, findings)).first().summary


def test_risk_and_advice(spark):
    many = [finding("crit", "A03_Injection", "Critical", line=i) for i in range(21)]
    high = [finding("high", "A01_Broken_Access_Control", "High", line=i) for i in range(6)]
    some = [finding("some", "A02_Cryptographic_Failures", "High"), finding("some", "A05_x", "Low")]
    scans, findings = tables(spark, ["crit", "high", "some"], many + high + some)
    r = {x.scan_id: x for x in reports.scan_report(scans, findings).collect()}
    assert [r[s].risk_level for s in ("crit", "high", "some")] == ["CRITICAL", "HIGH", "MEDIUM"]
    assert r["crit"].recommendations == [
        reports.ADVICE_CRITICAL, *reports.ADVICE_TOTAL, reports.ADVICE_CATEGORY["Injection"], *reports.ADVICE_ALWAYS]
    assert r["high"].recommendations == [
        reports.ADVICE_HIGH, reports.ADVICE_CATEGORY["Access_Control"], *reports.ADVICE_ALWAYS]
    assert r["some"].recommendations == reports.ADVICE_ALWAYS
    assert [c.category for c in r["some"].top_categories] == ["A02_Cryptographic_Failures", "A05_x"]


def test_numbering_equals_sorting(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 20 + ["a", "b", None]), rnd.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {(r.g, r.n): (r.v, r.i) for r in number_rows(df, ["g"], ["v", "i"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, (v, i) in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == g), 1):
            want[g, n] = (v, i)
    assert got == want


def test_trend(spark):
    rows = [("p", f"s{i}", f"2024-01-0{i + 1}", t, c) for i, (t, c) in enumerate([(0, 0), (10, 2), (5, 3)])] + [("q", "only", "2024-01-01", 3, 1)]
    df = spark.createDataFrame(rows, "project string, scan_id string, ts string, total_vulnerabilities long, critical_count long")
    got = [tuple(r)[3:] for r in history.trend(df).orderBy("scan_id").collect()]
    assert got == [(10, 2, 0.0), (-5, 1, 50.0)]
    assert [r.scan_id for r in history.trend_before(df, "s2").collect()] == ["s1"]


def test_first_findings_keep_few_rows_per_task(spark):
    _, findings = tables(spark, [], [finding("s", "A", "Low", line=i) for i in range(100)])
    first = reports.first_findings(findings, 5)
    assert [r.line_number for r in first.orderBy("n").collect()] == [0, 1, 2, 3, 4]
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_find_scan(spark):
    scans, _ = tables(spark, ["a", "b"], [])
    assert history.find_scan(scans, "b").count() == 1
    assert history.find_scan(scans, "z").count() == 0


def test_history_append(spark, tmp_path):
    scans, _ = tables(spark, ["a"], [])
    for _ in range(2):
        history.append_scans(scans, str(tmp_path / "h"))
    assert spark.read.schema(scans.schema).parquet(str(tmp_path / "h")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from scanframe.operators import patterns

    src = spark.createDataFrame([(f"f{i}", "password = 'admin'\nDES " * i) for i in range(6)], "name string, content string")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = continuous.scan_stream(continuous.read_stream(spark, str(tmp_path / "in"), src.schema), "content", "name")
    continuous.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    batch = patterns.scan_text(src, "content", "name")
    assert batch.count() > 0
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_redelivery(spark, tmp_path):
    src = spark.createDataFrame([("2024-01-01", "a", "x"), ("2024-01-01", "a", "x"), ("2024-01-01", "a", "y")], "t string, path string, content string")
    src = src.select(F.to_timestamp("t").alias("ts"), "path", "content")
    src.write.parquet(str(tmp_path / "in"))
    stream = continuous.without_redelivery(continuous.read_stream(spark, str(tmp_path / "in"), src.schema))
    continuous.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() == 2


def test_late_rows_are_counted_over_all_batches(spark, tmp_path):
    """More batches than Spark remembers: every one after the first brings rows that are too late."""
    for k in range(9):
        days = [f"2024-01-{20 + k}", *["2024-01-01"] * (3 if k else 0)]
        rows = spark.createDataFrame([(d, "Low") for d in days], "t string, severity string").coalesce(1)
        rows.select(F.to_timestamp("t").alias("ts"), "severity").write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(key, "100")
    spark.conf.set(key, "3")
    try:
        late = continuous.run_updates(continuous.severity_windows(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.set(key, before)
    assert late >= 7  # one group of a batch is dropped as a whole, after its rows were added up
