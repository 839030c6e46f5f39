"""Aggregates and report datasets over the findings table, one group per scan.

Findings are aggregated once to (scan, category); everything that describes a scan is then
computed from at most a few dozen category rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.operators.numbering import number_rows
from scanframe.rules import CATEGORIES

SEVERITY_COLUMNS = {"Critical": "critical_count", "High": "high_count", "Medium": "medium_count", "Low": "low_count"}

# --- fixed values: thresholds and report defaults --------------------------------------
HIGH_LIMIT, TOTAL_LIMIT, TOP_LIMIT = 5, 20, 3
DEFAULTS = {
    "total_files": 0, "lines_analyzed": 0, "scan_duration": 0.0, "coverage_percentage": 85.0,
    "false_positive_rate": 0.1, "confidence_score": 0.85,
}

ADVICE_CRITICAL = "Fix every Critical finding before anything else"
ADVICE_HIGH = "Run security checks automatically on every build"
ADVICE_TOTAL = ["Plan a full security review of the code", "Train the developers in secure coding"]
ADVICE_CATEGORY = {
    "Injection": "Validate input and bind statement parameters",
    "Access_Control": "Tighten the authorization checks",
    "Cryptographic": "Replace outdated cryptographic algorithms",
}
NEXT_STEPS = [
    "1. Fix what is Critical or High without delay", "2. Review code for security before it is merged",
    "3. Let every build run a security scan", "4. Teach the developers secure coding"]
ADVICE_ALWAYS = ["Repeat security assessments on a schedule", "Monitor and log security events"]
NO_ADVICE = "There is nothing to recommend."


def category_of() -> Column:
    return F.coalesce("owasp_category", "type", F.lit("Unknown"))


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(c) for s, c in SEVERITY_COLUMNS.items()]


def severity_summary(findings: DataFrame) -> DataFrame:
    """Four fixed severities and the total per scan."""
    return findings.groupBy("scan_id").agg(F.count("*").alias("total_vulnerabilities"), *_severity_counts())


def severity_summary_of(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """The same for every scan, zeros where nothing was found."""
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ["total_vulnerabilities", *SEVERITY_COLUMNS.values()]]
    return scans.join(severity_summary(findings), "scan_id", "left").select(*scans.columns, *zeros)


def count_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", category_of().alias("category")).agg(F.count("*").alias("n"))


def count_by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", F.coalesce("file_path", F.lit("unknown")).alias("file_path")).agg(
        F.count("*").alias("n"))


def files_with_findings(findings: DataFrame) -> DataFrame:
    """Files with at least one syntax finding, with counts (clean files do not appear)."""
    return findings.groupBy("path").agg(F.count("*").alias("n"))


def metrics(scans: DataFrame) -> DataFrame:
    """Scan metrics with their defaults filled in."""
    return scans.select(
        "scan_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])


def project_name(path: Column) -> Column:
    return F.substring_index(F.coalesce(path, F.lit("Unknown Project")), "/", -1)


def risk_level() -> Column:
    return (
        F.when(F.col("critical_count") > 0, "CRITICAL")
        .when(F.col("high_count") > HIGH_LIMIT, "HIGH")
        .when(F.col("high_count") > 0, "MEDIUM")
        .otherwise("LOW"))


def top_categories(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k largest categories per scan; ties by name."""
    w = Window.partitionBy("scan_id").orderBy(F.desc("n"), "category")
    return count_by_category(findings).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def compliance(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Ten categories per scan: compliant, issues found, critical issues."""
    counts = findings.groupBy("scan_id", F.col("owasp_category").alias("category")).agg(
        F.count("*").alias("issues_found"), F.count_if(F.col("severity") == "Critical").alias("critical_issues"))
    grid = scans.select("scan_id", F.explode(F.lit(CATEGORIES)).alias("category"))
    n, c = F.coalesce("issues_found", F.lit(0)), F.coalesce("critical_issues", F.lit(0))
    return grid.join(counts, ["scan_id", "category"], "left").select(
        "scan_id", "category", (n == 0).alias("compliant"), n.alias("issues_found"), c.alias("critical_issues"))


def recommendations() -> Column:
    """Advice list from the counts and the largest category of a scan row."""
    only_if = lambda cond, *texts: F.when(cond, F.lit(list(texts))).otherwise(F.array().cast("array<string>"))
    by_category = F.lit(None).cast("string")
    for part, advice in reversed(ADVICE_CATEGORY.items()):
        by_category = F.when(F.contains("top_category", F.lit(part)), advice).otherwise(by_category)
    return F.concat(
        only_if(F.col("critical_count") > 0, ADVICE_CRITICAL),
        only_if(F.col("high_count") > HIGH_LIMIT, ADVICE_HIGH),
        only_if(F.col("total_vulnerabilities") > TOTAL_LIMIT, *ADVICE_TOTAL),
        F.when((F.col("top_count") > TOP_LIMIT) & by_category.isNotNull(), F.array(by_category)).otherwise(
            F.array().cast("array<string>")),
        F.lit(ADVICE_ALWAYS))


def scan_report(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per scan: counts, categories, compliance, risk, top categories, advice, metrics."""
    small = findings.groupBy("scan_id", category_of().alias("category")).agg(
        F.count("*").alias("n"), *_severity_counts())
    sums = [F.sum(c).alias(c) for c in SEVERITY_COLUMNS.values()]
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("neg"), "category", "n", "critical_count")))
    per_scan = small.groupBy("scan_id").agg(F.sum("n").alias("total_vulnerabilities"), *sums, ranked.alias("_cats"))
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["total_vulnerabilities", *SEVERITY_COLUMNS.values()]}
    nothing = F.array().cast("array<struct<neg:bigint,category:string,n:bigint,critical_count:bigint>>")
    df = scans.join(per_scan, "scan_id", "left").withColumns({**zeros, "_cats": F.coalesce("_cats", nothing)})
    entries = F.transform("_cats", lambda c: F.struct(c["category"], c["n"]))
    lookup = F.map_from_entries(F.transform("_cats", lambda c: F.struct(c["category"], c)))
    status = F.transform(F.lit(CATEGORIES), lambda c: F.struct(
        c.alias("category"),
        F.try_element_at(F.col("_lookup"), c).isNull().alias("compliant"),
        F.coalesce(F.try_element_at(F.col("_lookup"), c)["n"], F.lit(0)).alias("issues_found"),
        F.coalesce(F.try_element_at(F.col("_lookup"), c)["critical_count"], F.lit(0)).alias("critical_issues")))
    df = (
        df.withColumn("_lookup", lookup)
        .withColumn("by_category", F.map_from_entries(entries))
        .withColumn("top_category", F.get("_cats", F.lit(0))["category"])
        .withColumn("top_count", F.coalesce(F.get("_cats", F.lit(0))["n"], F.lit(0)))
        .withColumn("top_categories", F.transform(
            F.slice("_cats", 1, 3), lambda c: F.struct(c["category"].alias("category"), c["n"].alias("n"))))
        .withColumn("compliance_status", status)
        .withColumn("risk_level", risk_level())
        .withColumn("recommendations", recommendations())
        .withColumn("project_name", project_name(F.col("project_path"))))
    fill = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}
    return df.withColumns(fill).withColumn("project_path", F.coalesce("project_path", F.lit(""))).drop("_cats", "_lookup")


def recommendation_lines() -> Column:
    bullets = F.transform(F.slice("recommendations", 1, 5), lambda r: F.concat(F.lit("• "), r))
    return F.when(F.size("recommendations") == 0, NO_ADVICE).otherwise(F.array_join(bullets, "\n"))


def compliance_lines() -> Column:
    mark = lambda s: F.when(s["compliant"], "✓ Compliant").otherwise("✗ Non-Compliant")
    return F.array_join(
        F.transform("compliance_status", lambda s: F.concat(s["category"], F.lit(": "), mark(s))), "\n")


def executive_summary(report: DataFrame) -> DataFrame:
    """Management summary text per scan."""
    top = F.array_join(F.transform(
        "top_categories", lambda c: F.concat(F.lit("- "), c["category"], F.lit(": "), c["n"].cast("string"), F.lit(" issues"))), "\n")
    pair = lambda label, value: F.concat(F.lit(f"{label}: "), value.cast("string"))
    text = F.concat_ws(
        "\n",
        F.lit("SECURITY SCAN - EXECUTIVE SUMMARY"), F.lit(""),
        pair("Project", F.col("project_name")), pair("Scan Date", F.date_format("ts", "yyyy-MM-dd")),
        pair("Scan ID", F.col("scan_id")), F.lit(""),
        pair("Overall Security Risk", F.col("risk_level")), pair("Files Analyzed", F.col("total_files")),
        pair("Total Vulnerabilities", F.col("total_vulnerabilities")),
        pair("Critical Issues", F.col("critical_count")), pair("High Risk Issues", F.col("high_count")), F.lit(""),
        F.lit("Top Vulnerability Categories:"), top, F.lit(""),
        F.lit("Recommendations:"), recommendation_lines(), F.lit(""),
        F.lit("Compliance:"), compliance_lines(), F.lit(""), F.lit("Next steps:"), F.lit("\n".join(NEXT_STEPS)))
    return report.select("scan_id", text.alias("summary"))


def json_report(report: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """Whole report as one JSON text per scan.

    ``trends`` (see ``history.trends_before``) adds what the earlier scans of the project looked
    like; without it, or for a first scan, there is none. Findings and counts by file have no
    bound and are written as JSON lines of their own (``plans.output.write_report``).
    """
    if trends is None:
        report = report.withColumn("trend_data", F.lit(None).cast("struct<scans:bigint>"))
    else:
        report = report.join(trends, "scan_id", "left")
    summary = F.struct(
        "total_vulnerabilities", *SEVERITY_COLUMNS.values(), "by_category", "trend_data")
    metric = F.struct(F.col("total_files").alias("files_scanned"), *[c for c in DEFAULTS if c != "total_files"])
    body = F.struct(
        "scan_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "project_name", "project_path",
        summary.alias("summary"), metric.alias("metrics"), "recommendations", "compliance_status")
    return report.select("scan_id", F.to_json(body).alias("report"))


def scan_json(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scan export: a header line per scan and a line per finding, as JSON text."""
    head = severity_summary_of(scans, findings)
    summary = F.struct(*[F.col(c).alias(s) for s, c in SEVERITY_COLUMNS.items()])
    header = head.select("scan_id", F.lit("scan").alias("record"), F.to_json(F.struct(
        "scan_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "project_path", "total_files",
        summary.alias("summary"))).alias("json"))
    body = findings.select("scan_id", F.lit("finding").alias("record"), F.to_json(F.struct(
        "type", "severity", "file_path", "line_number", "description", "owasp_category", "recommendation",
        "code_snippet", "confidence")).alias("json"))
    return header.unionByName(body)


GROUP_LIMIT = 1000  # Spark's own limit for cutting window groups early
FINDING_ORDER = ["file_path", "line_number", "type", "finder", "owasp_category", "code_snippet", "recommendation"]


def console_lines(findings: DataFrame) -> DataFrame:
    """Numbered text view of all findings of a scan, in file order."""
    numbered = number_rows(findings, ["scan_id"], FINDING_ORDER)
    text = F.concat_ws(
        "\n",
        F.format_string("%d. %s - %s", "n", "owasp_category", "severity"),
        F.format_string("   File: %s:%d", "file_path", "line_number"),
        F.concat(F.lit("   Description: "), F.col("description")),
        F.concat(F.lit("   Code: "), F.col("code_snippet")),
        F.concat(F.lit("   Recommendation: "), F.col("recommendation")))
    return numbered.select("scan_id", "n", text.alias("text"))


def first_findings(findings: DataFrame, k: int = 20) -> DataFrame:
    """The first k findings per scan in file order.

    Up to GROUP_LIMIT each task keeps only k rows per scan before they meet; a longer list is
    numbered across range partitions, so that no task holds all findings of a scan.
    """
    if k > GROUP_LIMIT:
        numbered = number_rows(findings, ["scan_id"], FINDING_ORDER).withColumn("n", F.col("n").cast("int"))
    else:
        w = Window.partitionBy("scan_id").orderBy(*FINDING_ORDER)
        numbered = findings.withColumn("n", F.row_number().over(w))
    return numbered.where(F.col("n") <= k).withColumn("title", category_of())


def chart_series(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Long table for the two charts: severities (all four) and categories."""
    summary = severity_summary_of(scans.select("scan_id"), findings)
    severity = summary.select("scan_id", F.lit("severity").alias("chart"), F.inline(F.array(*[
        F.struct(F.lit(s).alias("label"), F.col(c).alias("n")) for s, c in SEVERITY_COLUMNS.items()])))
    category = count_by_category(findings).select(
        "scan_id", F.lit("category").alias("chart"), F.col("category").alias("label"), "n")
    return severity.unionByName(category)


def gate(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Build gate: failed when the scan has any Critical finding."""
    return severity_summary_of(scans.select("scan_id"), findings).select(
        "scan_id", (F.col("critical_count") > 0).alias("failed"))
