"""Data flow between definitions and uses of variables, as joins over an event table.

Everything is keyed by ``file_id`` plus a variable or a node, so no single task ever needs
a whole project. A node id is ``seq << 30 | index``: ids grow in source order, edges always
lead to larger ids, so the graph has no cycles.
"""

from __future__ import annotations

from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe import rules as R
from scanframe.functions import routes, text
from scanframe.functions.cluster import materialize
from scanframe.functions.rows import let
from scanframe.operators import prepare

SHIFT = 30


def _mentions(value: Column, names: list[str]) -> Column:
    return reduce(or_, [F.contains(value, F.lit(n)) for n in names])


def _called(f: Column, names: str) -> tuple[Column, Column]:
    """(name tested against the lists, name kept as context) of a call fact."""
    if names == "short":
        return f["name"], f["name"]
    if names == "qualified":
        return F.concat(f["qual"], F.lit("(")), f["qual"]
    raise ValueError("names must be 'short' or 'qualified'")


def flow_facts(names: str = "qualified") -> Column:
    """From ``_facts``: assignments of a call result, and calls of a sink with plain arguments."""

    def wanted(f: Column) -> Column:
        assign = (f["kind"] == "assign") & (f["value"] == "call")
        plain = F.exists(f["args"], lambda a: a["name"].isNotNull())
        return assign | ((f["kind"] == "call") & plain & _mentions(_called(f, names)[0], R.SINKS))

    def keep(f: Column, lines: Column) -> Column:
        tested, context = _called(f, names)
        line_text = text.strip(F.coalesce(F.get(lines, f["line"] - 1), F.lit("")))
        role = (
            F.when(f["kind"] == "call", "sink")
            .when(_mentions(tested, R.TAINT_SOURCES), "user_input")
            .when(_mentions(tested, R.SANITIZERS), "sanitized")
            .otherwise("assignment"))
        return F.struct(
            f["seq"].alias("seq"), f["line"].alias("line"), role.alias("role"),
            F.when(role == "assignment", line_text).otherwise(context).alias("context"),
            F.coalesce(f["targets"], F.array().cast("array<string>")).alias("targets"),
            F.transform(f["args"], lambda a: a["name"]).alias("arg_names"),
            F.flatten(F.transform(f["args"], lambda a: a["vars"])).alias("vars"))

    kept = let(F.col("_lines"), lambda lines: F.transform(
        F.filter(F.col("_facts"), wanted), lambda f: keep(f, lines)))
    return F.filter(
        kept, lambda e: (e["role"] != "assignment") | (F.size(e["vars"]) > 0))


def flow_stage(files: DataFrame, names: str = "qualified") -> DataFrame:
    """Flow facts straight from a files table (Python files only)."""
    df = prepare.with_lines(prepare.with_facts(prepare.with_text(files.where(F.col("lang") == "py"))))
    return df.select("path", "project", flow_facts(names).alias("flow_facts"))


def with_file_id(files: DataFrame) -> DataFrame:
    """Row identity, so that files of equal path or content stay apart. Write the result before use."""
    return files.withColumn("file_id", F.monotonically_increasing_id())


class FlowGraph:
    """What ``analyze`` finds, each table made when it is first asked for.

    ``files``: file_id, path, project: every analysed file, clean ones too.
    ``nodes``: file_id, node, variable, line, flow_type, source_type, context, operations.
    ``edges``: file_id, src, dst, operation.
    ``findings``: one row per tainted node and sink that it reaches uncleaned, with the length of the way.
    ``links``: file_id, src, dst, next, length, starts: the ways, see ``with_routes``.
    """

    def __init__(self, stage: DataFrame, max_length: int | None):
        self.stage, self.max_length = stage, max_length
        self.files = stage.select("file_id", "path", "project")

    @cached_property
    def findings(self) -> DataFrame:
        return _findings(self.stage, self.max_length)

    @cached_property
    def _bound(self) -> DataFrame:
        return materialize(_bind(_events(self.stage)))

    @cached_property
    def _flows(self) -> DataFrame:
        return materialize(_flows(self._bound, self.max_length))

    @cached_property
    def links(self) -> DataFrame:
        return self._flows.where("dst is not null")

    @cached_property
    def edges(self) -> DataFrame:
        return _graph(self._bound)[1].dropDuplicates(["file_id", "src", "dst"])

    @cached_property
    def nodes(self) -> DataFrame:
        nodes, edges = _graph(self._bound)
        tainted = self._flows.where("dst is null").select("file_id", F.col("src").alias("node"))
        operations = edges.groupBy("file_id", F.col("dst").alias("node")).agg(
            F.sort_array(F.collect_list("operation")).alias("operations"))
        return (
            nodes.join(tainted.withColumn("hot", F.lit(True)), ["file_id", "node"], "left")
            .join(operations, ["file_id", "node"], "left")
            .select(
                "file_id", "node", "variable", "line",
                F.when(F.col("hot"), "tainted").when(F.col("role") == "sanitized", "sanitized").otherwise("unknown").alias("flow_type"),
                F.col("role").alias("source_type"), "context",
                F.coalesce("operations", F.array().cast("array<string>")).alias("operations")))


def _node_id(seq, index) -> Column:
    return F.shiftleft(seq.cast("long"), SHIFT) + index.cast("long")


def _events(stage: DataFrame) -> DataFrame:
    """Definitions and uses, ordered by (seq, ix, phase); a use carries the node it feeds."""
    facts = stage.select("file_id", F.inline("flow_facts"))
    assign = facts.where("role <> 'sink'").select("*", F.posexplode("targets").alias("ix", "target"))
    node = _node_id(F.col("seq"), F.col("ix"))
    uses_of = (
        F.when(F.col("role") == "assignment", F.col("vars"))
        .when((F.col("role") == "sanitized") & F.get("arg_names", F.lit(0)).isNotNull(), F.slice("arg_names", 1, 1))
        .otherwise(F.array().cast("array<string>")))
    empty = F.array().cast("array<string>")
    defs = F.array(F.struct(F.col("target").alias("variable"), F.lit(1).alias("phase"), F.lit(False).alias("uses")))
    uses = F.transform(F.coalesce(uses_of, empty), lambda v: F.struct(
        v.alias("variable"), F.lit(0).alias("phase"), F.lit(True).alias("uses")))
    a = assign.select("file_id", "seq", "ix", "line", "role", "context", "target", node.alias("node"),
                      F.inline(F.concat(uses, defs)))
    sinks = facts.where("role = 'sink'").select("*", F.posexplode("arg_names").alias("arg", "variable")).where(
        "variable is not null")
    s = sinks.select(
        "file_id", "seq", F.lit(0).alias("ix"), "line", "role", "context",
        F.concat(F.lit("sink_"), F.col("variable")).alias("target"), _node_id(F.col("seq"), F.col("arg")).alias("node"),
        "variable", F.lit(0).alias("phase"), F.lit(True).alias("uses"))
    return a.unionByName(s)


def _bind(events: DataFrame) -> DataFrame:
    """As-of lookup: the latest earlier definition of the variable, per event."""
    w = (Window.partitionBy("file_id", "variable").orderBy("seq", "ix", "phase")
         .rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("bound", F.last(F.when(~F.col("uses"), F.col("node")), ignorenulls=True).over(w))


OPERATION = {"assignment": "assignment", "sanitized": "sanitization", "sink": "sink_usage"}


def _graph(bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    operation = F.create_map(*[F.lit(x) for kv in OPERATION.items() for x in kv])
    used = bound.where("uses and bound is not null")
    edges = used.select(
        "file_id", F.col("bound").alias("src"), F.col("node").alias("dst"),
        F.try_element_at(operation, F.col("role")).alias("operation"))
    defined = bound.where(~F.col("uses"))
    node_columns = ["file_id", "node", F.col("target").alias("variable"), "line", "role", "context"]
    nodes = defined.select(*node_columns).unionByName(used.where("role = 'sink'").select(*node_columns))
    return nodes, edges


def _flows(bound: DataFrame, max_length: int | None) -> DataFrame:
    """Rows of ``routes.FOUND``: the closure over assignments and the links on shortest clean routes to sinks.

    The graph of a file fits its row, as its facts did, so both come from one grouping by file
    and one pass over arrays, however long the chains are. Files without any untrusted input
    are left out before that. No route is built; links grow with the findings.
    """
    is_node = ~F.col("uses") | ((F.col("role") == "sink") & F.col("bound").isNotNull())
    event = F.struct(
        "node", F.when(F.col("uses"), F.col("bound")).alias("from"),
        (F.col("uses") & (F.col("role") == "assignment")).alias("assigns"),
        (~F.col("uses") & (F.col("role") == "user_input")).alias("source"),
        (is_node & _mentions(F.col("context"), R.SINKS)).alias("sink"),
        (is_node & _mentions(F.col("context"), R.SANITIZERS)).alias("cleans"))
    hot = F.max(~F.col("uses") & (F.col("role") == "user_input"))
    files = bound.groupBy("file_id").agg(hot.alias("hot"), F.collect_list(event.cast(routes.EVENT)).alias("events")).where("hot")
    return files.select("file_id", "events").mapInArrow(routes.flows(max_length), routes.FOUND)


def vulnerability_type(context: Column) -> Column:
    low = F.lower(context)
    return (
        F.when(_mentions(low, ["execute", "query", "sql"]), "SQL Injection")
        .when(_mentions(low, ["exec", "system", "subprocess"]), "Command Injection")
        .when(_mentions(low, ["eval", "compile"]), "Code Injection")
        .otherwise("Unknown"))


def confidence(length: Column) -> Column:
    return F.greatest(F.lit(0.3), F.lit(1.0) - length * F.lit(0.1))


def risk_level(kind: Column, length: Column) -> Column:
    return F.when(kind != "Unknown", "Critical").when(length > 5, "Medium").otherwise("High")


def _findings(stage: DataFrame, max_length: int | None) -> DataFrame:
    """Findings in one pass over the files with untrusted input, each by itself and without a shuffle.

    Binding and routes of a file come from its own row, so nodes, edges and links need not be made.
    """
    hot = stage.where(F.exists("flow_facts", lambda f: f["role"] == "user_input")).select("file_id", "path", "project", "flow_facts")
    pairs = hot.mapInArrow(routes.findings(max_length, SHIFT, R.SINKS, R.SANITIZERS), routes.PAIR)
    kind, size = F.col("vuln_type"), F.col("length")
    return (
        pairs.withColumn("vuln_type", vulnerability_type(F.col("sink_context")))
        .withColumn("risk_level", risk_level(kind, size))
        .withColumn("confidence", confidence(size))
        .withColumn("path_length", size)
        .withColumn("description", F.format_string(R.FLOW_TITLE, F.col("source_type"), F.lower(kind)))
        .select("file_id", "path", "project", "src", "dst", "vuln_type", "risk_level", "confidence", "path_length",
                "source_line", "source_context", "sink_line", "sink_context", "description",
                F.lit(R.FLOW_ADVICE).alias("remediation")))


def analyze(stage: DataFrame, max_path_length: int | None = None) -> FlowGraph:
    """Graph and findings for a table of (path, project, flow_facts), one row per file.

    ``file_id`` must come from a written table (see ``with_file_id``); without one it is
    assigned and written here. Nodes, edges and links are made when they are first asked for.
    """
    if "file_id" not in stage.columns:
        stage = materialize(with_file_id(stage))
    return FlowGraph(stage, max_path_length)


def with_routes(graph: FlowGraph, findings: DataFrame) -> DataFrame:
    """Some of the graph's findings with ``flow_path``, the nodes from source to sink.

    Only the trees of sinks among these findings are put together, and only the routes of the
    findings are followed. Of equally short routes it is the smallest list of nodes.
    """
    keys = ["file_id", "src", "dst"]
    wanted = findings.select(*keys).distinct()
    sinks = wanted.select("file_id", "dst").distinct()
    links = graph.links.select(*keys, "next").join(sinks, ["file_id", "dst"], "left_semi").join(
        wanted.withColumn("wanted", F.lit(True)), keys, "left")
    link = F.struct("src", "next", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    trees = links.groupBy("file_id", "dst").agg(F.collect_list(link).alias("links"))
    routes_of = trees.mapInArrow(routes.unrolled, "file_id long, src long, dst long, route array<long>")
    return findings.join(routes_of.withColumnRenamed("route", "flow_path"), keys)


def analyze_files(files: DataFrame, names: str = "qualified", max_path_length: int | None = None) -> FlowGraph:
    return analyze(flow_stage(files, names), max_path_length)


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """Running node number per file in source order."""
    w = Window.partitionBy("file_id").orderBy("node")
    return nodes.withColumn("node_no", F.row_number().over(w))


def file_statistics(graph: FlowGraph) -> DataFrame:
    """Nodes, edges, tainted nodes and findings per file, zeros for clean files."""
    n = graph.nodes.groupBy("file_id").agg(
        F.count("*").alias("total_flow_nodes"), F.count_if(F.col("flow_type") == "tainted").alias("tainted_sources"))
    e = graph.edges.groupBy("file_id").agg(F.count("*").alias("total_flow_edges"))
    v = graph.findings.groupBy("file_id").agg(F.count("*").alias("vulnerabilities_found"))
    df = graph.files.join(n, "file_id", "left").join(e, "file_id", "left").join(v, "file_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return df.select("file_id", "path", "project", zero("total_flow_nodes"), zero("total_flow_edges"),
                     zero("tainted_sources"), zero("vulnerabilities_found"))


def totals(graph: FlowGraph) -> DataFrame:
    """Whole-tree totals; control issues come from opt-in detectors and are zero by default."""
    files = graph.files.agg(F.count("*").alias("files_analyzed"))
    found = graph.findings.agg(
        F.count("*").alias("total_vulnerabilities"), F.lit(0).cast("long").alias("total_control_issues"),
        F.count_if(F.col("risk_level") == "Critical").alias("critical_vulnerabilities"))
    return files.crossJoin(found)  # one row each
