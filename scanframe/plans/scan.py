"""The combined scan: every finder over a files table, one read of the content."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe import rules as R
from scanframe.functions import plainscan, text
from scanframe.functions.cluster import materialize
from scanframe.functions.rows import unnest
from scanframe.operators import flow, patterns, prepare, syntax
from scanframe.plans import store
from scanframe.schemas import FINDING_COLUMNS
from scanframe.sources.tree import TOO_LARGE


def _fresh_run() -> str:
    return f"scan_{uuid.uuid4().hex[:16]}"


@dataclass
class ScanOptions:
    """Settings of a scan; the defaults run every finder with the built-in rules.

    ``run`` names this scan: every set of options gets its own unless one is passed in. The id
    of a project's scan is the run and the project, so scans of the same project stay apart.
    """

    run: str = field(default_factory=_fresh_run)
    root: str = ""  # folder or URI under which the projects lie

    enable_ast_analysis: bool = True
    enable_flow_analysis: bool = True
    flow_names: str = "qualified"  # or 'short'
    max_path_length: int | None = None
    confidence_threshold: float = 0.0
    extensions: tuple = (".py", ".java")
    max_file_bytes: int | None = None
    disabled_categories: set = field(default_factory=set)
    severity_overrides: dict = field(default_factory=dict)
    include_snippets: bool = True

    def rules(self, *rulesets: str) -> list[R.Rule]:
        return R.configure(R.rule_rows(*rulesets), self.disabled_categories, self.severity_overrides)


def select_files(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Files a scan looks at, by suffix (exact case).

    ``problem`` says why a file has no content to scan. Files above the size limit lose their
    content but stay as rows, so that they are counted.
    """
    files = files.where(text.suffix(F.col("path")).isin(*options.extensions))
    problem = F.col("problem") if "problem" in files.columns else F.lit(None).cast("string")
    if options.max_file_bytes is not None:
        problem = F.coalesce(problem, F.when(F.octet_length("content") > options.max_file_bytes, TOO_LARGE))
    return files.withColumn("problem", problem).withColumn("content", F.when(F.col("problem").isNull(), F.col("content")))


def _stage(files: DataFrame, options: ScanOptions) -> DataFrame:
    """One row per file with all hits and the syntax facts that the flow analysis needs.

    ASCII texts are scanned in one go (``plainscan``), the others by column expressions.
    """
    basic, owasp, java = (options.rules(s) for s in ("basic", "owasp", "java"))
    literal = [r for r in owasp if r.kind == "literal"]
    regexes = [r for r in owasp if r.kind == "regex"]
    kinds = [r.subcategory for r in options.rules("syntax")] if options.enable_ast_analysis else []
    names = options.flow_names if options.enable_flow_analysis else None
    may = prepare.Candidates(basic + owasp + java)
    strict = prepare.strict(files)
    df = prepare.with_text(files)
    df = df.withColumn("_plain", plainscan.scanned(
        F.col("_text"), F.expr(f"lang = 'py' AND {strict}"), F.expr(f"lang = 'java' AND {strict}"), basic, literal, regexes,
        [r for r in java if r.subcategory in kinds], kinds, names))
    beyond = "octet_length(_text) <> length(_text)"
    only = lambda column: F.when(F.expr(beyond), column)
    df = may.search(prepare.with_lines(df).withColumn("_lines", only(F.col("_lines"))), F.expr(beyond))
    parts: list[Column] = []
    if basic:
        df = df.withColumn("_needles", only(may.literals(basic)))
        parts.append(F.coalesce(patterns.line_hits(), F.array().cast(f"array<struct<{_HIT}>>")))
    if literal:
        parts.append(patterns.literal_hits(may.literals(literal)))
    if regexes:
        parts.append(patterns.regex_hits(patterns.spans(may.match_groups(regexes))))
    if options.enable_ast_analysis or options.enable_flow_analysis:
        df = prepare.with_facts(df, beyond)
    if options.enable_ast_analysis:
        shown = lambda d: F.array_contains(F.lit(kinds), d["node_type"])
        parts.append(syntax.detail_hits("py_syntax", F.filter(syntax.python_details(), shown)))
        if java:
            found = syntax.java_details(patterns.spans(may.match_groups(java, f"lang = 'java' AND {strict}")))
            parts.append(syntax.detail_hits("java_regex", F.filter(found, shown)))
    hits = F.concat(*parts) if parts else F.array().cast(f"array<struct<{_HIT}>>")
    plain = lambda name, other: F.when(F.col("_plain.plain"), F.col(f"_plain.{name}")).otherwise(other)
    out = df.withColumn("hits", plain("hits", hits)).withColumn("n_lines", text.line_count(F.col("_text")))
    columns = ["path", "project", "lang", "n_lines", "problem", "hits"]
    if options.enable_flow_analysis:
        out = out.withColumn("flow_facts", plain("flow", flow.flow_facts(options.flow_names)))
        columns.append("flow_facts")
    return out.select(*columns)


_HIT = ",".join(part.strip().replace(" ", ":", 1) for part in patterns.HIT.split(","))


def scan_id_of(project: Column, options: ScanOptions) -> Column:
    return F.concat(F.lit(f"{options.run}_"), project)


def hit_findings(stage: DataFrame, options: ScanOptions) -> DataFrame:
    """Explode hits and look up severity, category and advice (catalogue below 200 rows)."""
    about = R.rules_frame(stage.sparkSession, options.rules()).select(
        "rule_id", "severity", F.col("category").alias("owasp_category"), "description",
        F.col("remediation").alias("recommendation"))
    file_columns = [scan_id_of(F.col("project"), options).alias("scan_id"), F.col("path").alias("file_path")]
    hits = unnest(stage, file_columns, F.col("hits"), "rule_id")
    return hits.join(F.broadcast(about), "rule_id").withColumn(
        "confidence", F.lit(None).cast("double")).select(*FINDING_COLUMNS)


def flow_findings(stage: DataFrame, options: ScanOptions) -> DataFrame:
    """Flow findings in the common shape: fixed category, line of the source node."""
    columns = [c for c in ("file_id", "path", "project", "flow_facts") if c in stage.columns]
    found = flow.analyze(stage.where(F.size("flow_facts") > 0).select(*columns), options.max_path_length).findings
    sev = F.col("risk_level")
    override = options.severity_overrides.get("A03_Injection")
    return found.where(F.col("confidence") >= options.confidence_threshold).select(
        scan_id_of(F.col("project"), options).alias("scan_id"), F.lit("flow").alias("finder"), F.col("vuln_type").alias("type"),
        (F.lit(override) if override else sev).alias("severity"), F.col("path").alias("file_path"),
        F.col("source_line").alias("line_number"), "description",
        F.lit("A03_Injection").alias("owasp_category"), F.lit(R.FLOW_ADVICE).alias("recommendation"),
        F.col("source_context").alias("code_snippet"), "confidence")


@dataclass
class ScanResult:
    """``files``: one row per file (path, project, lang, n_lines, problem); ``findings``: all findings."""

    files: DataFrame
    findings: DataFrame


def scan(files: DataFrame, options: ScanOptions | None = None) -> ScanResult:
    """Run all finders over a files table (path, project, lang, content).

    Without flow analysis the result is one lazy pass without any shuffle. With it, the pass
    is written once, so that content is read and parsed a single time for all finders.
    """
    options = options or ScanOptions()
    stage = _stage(select_files(files, options), options)
    if options.enable_flow_analysis:
        stage = materialize(flow.with_file_id(stage))
    findings = hit_findings(stage, options)
    if options.enable_flow_analysis and "A03_Injection" not in options.disabled_categories:
        findings = findings.unionByName(flow_findings(stage, options))
    if not options.include_snippets:
        findings = findings.withColumn("code_snippet", F.lit(""))
    return ScanResult(stage.select("path", "project", "lang", "n_lines", "problem"), findings)


def scan_rows(files: DataFrame, scanned: DataFrame, options: ScanOptions, seconds: float = 0.0) -> DataFrame:
    """One row per scan (project): when, where, how long, how many files and lines, how many files without content.

    ``files`` carries ``ts`` (when a file was scanned); ``scanned`` is ``ScanResult.files``;
    ``seconds`` is what the scan took, known to who wrote its result (see ``write_scan``).
    """
    when = files.groupBy("project").agg(F.max("ts").alias("ts"))
    size = scanned.groupBy("project").agg(
        F.count("*").alias("total_files"), F.sum("n_lines").alias("lines_analyzed"),
        F.count("problem").alias("skipped_files"))
    nothing = F.lit(None).cast("double")
    return when.join(size, "project", "left").select(
        scan_id_of(F.col("project"), options).alias("scan_id"), "project",
        F.concat(F.lit(f"{options.root.rstrip('/')}/"), F.col("project")).alias("project_path"), "ts",
        F.coalesce("total_files", F.lit(0)).alias("total_files"),
        F.coalesce("lines_analyzed", F.lit(0)).alias("lines_analyzed"),
        F.coalesce("skipped_files", F.lit(0)).alias("skipped_files"),
        F.lit(float(seconds)).alias("scan_duration"), F.lit(85.0).alias("coverage_percentage"),
        nothing.alias("false_positive_rate"), F.lit(0.85).alias("confidence_score"))


def write_scan(files: DataFrame, folder: str, options: ScanOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a scan now and commit its findings, counts and scan rows with the time it took to the store below a folder.

    Returns the scan rows and findings of this scan as read back. A run that is committed is not
    repeated: its rows are returned as they are. One that failed on its way can be repeated under
    its name, and nothing of the failed attempt shows.
    """
    from scanframe.operators import history

    options = options or ScanOptions()
    begin, spark = time.time(), files.sparkSession
    if not store.is_committed(spark, folder, options.run):
        attempt = store.new_attempt()
        stamp = F.lit(datetime.fromtimestamp(begin)).cast("timestamp")
        result = scan(files, options)
        found = store.put(materialize(result.findings), folder, "findings", attempt)  # sorting samples its input first
        store.put(history.counts(found), folder, "counts", attempt)
        rows = scan_rows(files.withColumn("ts", stamp), result.files, options, time.time() - begin)
        store.put(rows, folder, "scans", attempt)
        store.commit(spark, folder, options.run, attempt)
    return tuple(store.read(spark, folder, t, [options.run]) for t in ("scans", "findings"))
