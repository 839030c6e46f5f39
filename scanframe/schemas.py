"""Fixed schemas of the tables the engine works with."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("project", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("content", T.StringType()),
])

RULES = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("ruleset", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("subcategory", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("flags", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("severity_rank", T.IntegerType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("remediation", T.StringType(), False),
    T.StructField("refs", T.ArrayType(T.StringType()), False),
    T.StructField("cwe_ids", T.ArrayType(T.IntegerType()), False),
    T.StructField("impact", T.StringType(), False),
])

FINDING_COLUMNS = [
    "scan_id", "finder", "type", "severity", "file_path", "line_number", "description", "owasp_category",
    "recommendation", "code_snippet", "confidence",
]

FINDINGS = T.StructType([
    T.StructField(c, T.IntegerType() if c == "line_number" else T.DoubleType() if c == "confidence" else T.StringType())
    for c in FINDING_COLUMNS
])

# One syntax fact per relevant node of a Python file.
ARG = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("percent", T.BooleanType()),
    T.StructField("vars", T.ArrayType(T.StringType())),
])
FACT = T.StructType([
    T.StructField("seq", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("qual", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("fn", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("chain", T.ArrayType(T.StringType())),
    T.StructField("args", T.ArrayType(ARG)),
    T.StructField("true_flags", T.ArrayType(T.StringType())),
    T.StructField("targets", T.ArrayType(T.StringType())),
    T.StructField("value", T.StringType()),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("pos", T.IntegerType())]))),
])

SCANS = T.StructType([
    T.StructField("scan_id", T.StringType(), False),
    T.StructField("project", T.StringType()),
    T.StructField("project_path", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("total_files", T.LongType()),
    T.StructField("lines_analyzed", T.LongType()),
    T.StructField("skipped_files", T.LongType()),
    T.StructField("scan_duration", T.DoubleType()),
    T.StructField("coverage_percentage", T.DoubleType()),
    T.StructField("false_positive_rate", T.DoubleType()),
    T.StructField("confidence_score", T.DoubleType()),
])

# Findings of a scan per category and severity: what histories and trends are computed from.
COUNTS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("n", T.LongType()),
])
