"""Flow analysis against hand-made cases and a plain sequential walk over random programs."""

import ast
import random

import pytest

from scanframe import rules as R
from scanframe.operators import flow

PAIR = '''def view():
    q = request.args.get("q")
    run_query(q)
    r = request.args.get("r")
    s = html.escape(r)
    run_query(s)
'''


def mentions(name, names):
    return any(n in name for n in names)


def dotted(func):
    if isinstance(func, ast.Name):
        return func.id
    return dotted(func.value) + "." + func.attr


def short(func):
    if isinstance(func, ast.Name):
        return func.id
    return f"{func.value.id}.{func.attr}" if isinstance(func.value, ast.Name) else func.attr


def names_in(e):
    if isinstance(e, ast.Name):
        return [e.id]
    if isinstance(e, ast.BinOp):
        return names_in(e.left) + names_in(e.right)
    if isinstance(e, ast.Call):
        return [n for a in e.args for n in names_in(a)]
    return []


def walk_program(source, mode):
    """Sequential oracle: nodes in order, edges, and all source -> sink findings."""
    lines = source.split("\n")
    nodes, edges, bound = [], set(), {}

    def new(var, line, kind, context):
        nodes.append([var, line, kind, context])
        return len(nodes) - 1

    def visit(node):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call):
            call = node.value
            tested, kept = (short(call.func),) * 2 if mode == "short" else (dotted(call.func) + "(", dotted(call.func))
            for t in node.targets:
                if not isinstance(t, ast.Name):
                    continue
                if mentions(tested, R.TAINT_SOURCES):
                    bound[t.id] = new(t.id, node.lineno, "tainted", kept)
                elif mentions(tested, R.SANITIZERS):
                    n = new(t.id, node.lineno, "sanitized", kept)
                    if call.args and isinstance(call.args[0], ast.Name) and call.args[0].id in bound:
                        edges.add((bound[call.args[0].id], n))
                    bound[t.id] = n
                elif names_in(call):
                    n = new(t.id, node.lineno, "unknown", lines[node.lineno - 1].strip())
                    for v in names_in(call):
                        if v in bound:
                            edges.add((bound[v], n))
                            if nodes[bound[v]][2] == "tainted":
                                nodes[n][2] = "tainted"
                    bound[t.id] = n
        if isinstance(node, ast.Call):
            tested, kept = (short(node.func),) * 2 if mode == "short" else (dotted(node.func) + "(", dotted(node.func))
            if mentions(tested, R.SINKS):
                for a in node.args:
                    if isinstance(a, ast.Name) and a.id in bound:
                        n = new("sink_" + a.id, node.lineno, "unknown", kept)
                        edges.add((bound[a.id], n))
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(ast.parse(source))
    found = []
    for s, n in enumerate(nodes):
        if n[2] != "tainted":
            continue
        best = {s: [s]}
        layer = [s]
        while layer:  # smallest node list among the shortest
            step = {}
            for a in layer:
                for x, y in edges:
                    if x == a and y not in best:
                        step[y] = min(step.get(y, best[a] + [y]), best[a] + [y])
            best.update(step)
            layer = list(step)
        for t, path in best.items():
            if mentions(nodes[t][3], R.SINKS) and not any(mentions(nodes[p][3], R.SANITIZERS) for p in path):
                found.append((n[1], nodes[t][1], len(path), n[3], nodes[t][3]))
    return nodes, edges, found


def random_program(rnd):
    v = lambda: rnd.choice("abcde")
    out = []
    for _ in range(rnd.randint(1, 24)):
        out.append(rnd.choice([
            lambda: f"{v()} = request.args.get('x')", lambda: f"{v()} = request.GET('x')", lambda: f"{v()} = input('x')",
            lambda: f"{v()} = html.escape({v()})", lambda: f"{v()} = clean({v()} + {v()})",
            lambda: f"{v()} = build({v()}, {v()})", lambda: f"{v()} = {v()} = mix({v()} + f({v()}))",
            lambda: f"{v()} = eval({v()})", lambda: f"{v()} = {v()}", lambda: f"cursor.execute({v()}, {v()})",
            lambda: f"os.system({v()})", lambda: f"run_query({v()})", lambda: f"{v()} = step({v()})  # query",
            lambda: f"def g():\n    {v()} = build({v()})\n    subprocess.run({v()}, {v()})", lambda: f"compile(f({v()}), {v()})",
            lambda: f"{v()} = {v()}.filter({v()})", lambda: f"{v()}, {v()} = make({v()})",
        ])())
    return "\n".join(out)


@pytest.mark.parametrize("mode", ["short", "qualified"])
def test_equal_to_sequential_walk(spark, mode):
    rnd = random.Random(11)
    programs = [random_program(rnd) for _ in range(200)] + ["\n".join(f"v{i + 1} = step(v{i})" for i in range(12)).replace(
        "v1 = step(v0)", "v1 = request.GET('x')") + "\nquery(v12)"]
    df = spark.createDataFrame([(f"p/{i}.py", "p", "py", s) for i, s in enumerate(programs)],
                               "path string, project string, lang string, content string")
    graph = flow.analyze_files(df, mode)
    stats = {r.path: (r.total_flow_nodes, r.total_flow_edges, r.tainted_sources, r.vulnerabilities_found)
             for r in flow.file_statistics(graph).collect()}
    got = sorted(tuple(r) for r in graph.findings.select(
        "path", "source_line", "sink_line", "path_length", "source_context", "sink_context").collect())
    want = []
    for i, s in enumerate(programs):
        nodes, edges, found = walk_program(s, mode)
        tainted = sum(n[2] == "tainted" for n in nodes)
        assert stats[f"p/{i}.py"] == (len(nodes), len(edges), tainted, len(found)), s
        want += [(f"p/{i}.py", *f) for f in found]
    assert got == sorted(want)
    assert len(want) > 100


def test_fixture_pair(files):
    for mode, expected in [("short", (2, 1, 0, 0)), ("qualified", (5, 3, 2, 1))]:
        graph = flow.analyze_files(files(("p/a.py", PAIR)), mode)
        r = flow.file_statistics(graph).first()
        assert (r.total_flow_nodes, r.total_flow_edges, r.tainted_sources, r.vulnerabilities_found) == expected
    f = graph.findings.first()
    assert (f.vuln_type, f.risk_level, f.path_length, f.confidence) == ("SQL Injection", "Critical", 2, 0.8)
    assert flow.totals(graph).first().critical_vulnerabilities == 1


def test_same_path_and_content_stay_apart(files):
    graph = flow.analyze_files(files(("p/a.py", PAIR), ("p/a.py", PAIR)))
    assert [r.vulnerabilities_found for r in flow.file_statistics(graph).collect()] == [1, 1]


def test_rebinding_in_own_assignment(files):
    graph = flow.analyze_files(files(("p/a.py", "x = request.GET('a')\nx = eval(x)")))
    edges = graph.edges.orderBy("src", "dst").collect()
    assert [e.operation for e in edges] == ["assignment", "sink_usage"]
    assert edges[0].dst == edges[1].src  # the sink reads the new x


def test_node_is_its_own_sink(files):
    graph = flow.analyze_files(files(("p/a.py", "x = request.GET('a')\ny = build(x)  # query")))
    assert sorted(r.path_length for r in graph.findings.collect()) == [1, 2]


def test_path_limit(files):
    chain = "a = request.GET('q')\nb = f(a)\nc = f(b)\nquery(c)"
    lengths = lambda k: sorted(r.path_length for r in flow.analyze_files(files(("p/a.py", chain)), max_path_length=k).findings.collect())
    assert lengths(None) == [2, 3, 4]
    assert lengths(3) == [2, 3]


def test_no_flow_at_all(files):
    graph = flow.analyze_files(files(("p/a.py", "x = 1")))
    assert tuple(flow.totals(graph).first()) == (1, 0, 0, 0)


@pytest.mark.parametrize("context,kind", [
    ("cursor.execute", "SQL Injection"), ("os.system", "Command Injection"), ("exec", "Command Injection"),
    ("eval", "Code Injection"), ("os.popen", "Unknown")])
def test_types(spark, context, kind):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        flow.vulnerability_type(F.lit(context)).alias("t"),
        flow.risk_level(flow.vulnerability_type(F.lit(context)), F.lit(6)).alias("r"), flow.confidence(F.lit(9)).alias("c")).first()
    assert row.t == kind
    assert row.r == ("Medium" if kind == "Unknown" else "Critical")
    assert row.c == pytest.approx(0.3)


@pytest.mark.parametrize("steps", [10, 500])
def test_long_chains_take_no_rounds(files, steps):
    lines = ["a0 = request.GET('q')", *[f"a{k + 1} = f(a{k})" for k in range(steps)], f"query(a{steps})"]
    graph = flow.analyze_files(files(("p/a.py", "\n".join(lines))))
    assert sorted(r.path_length for r in graph.findings.collect()) == list(range(2, steps + 3))
    assert flow.file_statistics(graph).first().tainted_sources == steps + 1


def test_no_route_towards_dead_ends():
    from scanframe.functions import routes

    def event(node, before=None, **flags):
        return {"node": node, "from": before, "assigns": before is not None, "source": False, "sink": False, "cleans": False, **flags}

    # 1 -> 2 -> 9 (sink), 1 -> 3 -> 9 through a cleaning node, 1 -> 4 -> 5 leads nowhere
    events = [event(1, source=True), event(2, 1), event(3, 1), event(3, cleans=True), event(4, 1), event(5, 4), event(9, 2), event(9, 3), event(9, sink=True)]
    def links(longest):
        found = list(routes.file_flows(events, longest))
        assert [src for src, dst, *_ in found if dst is None] == [1, 2, 3, 4, 5, 9]
        return sorted((src, after, length) for src, dst, after, length, starts in found if starts and dst == 9)

    assert links(None) == [(1, 2, 3), (2, 9, 2), (9, None, 1)]
    assert links(2) == [(2, 9, 2), (9, None, 1)]


def shortest_routes(graph, start, sinks, cleans):
    """All smallest shortest routes from a node, level by level."""
    best, layer = {start: [start]}, [start]
    while layer:
        step = {}
        for a in layer:
            for b in graph.get(a, ()):
                if b not in best:
                    step[b] = min(step.get(b, best[a] + [b]), best[a] + [b])
        best.update(step)
        layer = list(step)
    return [r for t, r in best.items() if t in sinks and not cleans & set(r)]


def test_links_give_the_routes_of_random_graphs(spark):
    from scanframe.functions import routes

    rnd = random.Random(4)
    for _ in range(150):
        n = rnd.randint(2, 14)
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.3}
        flags = {k: {f: rnd.random() < p for f, p in (("source", 0.3), ("sink", 0.3), ("cleans", 0.15))} for k in range(n)}
        assigns = {e: rnd.random() < 0.7 for e in edges}
        none = {"source": False, "sink": False, "cleans": False}
        events = [{"node": k, "from": None, "assigns": False, **flags[k]} for k in range(n)]
        events += [{"node": b, "from": a, "assigns": assigns[a, b], **none} for a, b in edges]
        found = list(routes.file_flows(events, None))
        tainted = [src for src, dst, *_ in found if dst is None]
        links = [x for x in found if x[1] is not None]
        graph = {}
        for a, b in edges:
            graph.setdefault(a, []).append(b)
        sinks, cleans = ({k for k in range(n) if flags[k][f]} for f in ("sink", "cleans"))
        want = sorted(r for s in tainted for r in shortest_routes(graph, s, sinks, cleans))
        after = {(src, dst): to for src, dst, to, *_ in links}
        got = []
        for src, dst, _, length, starts in links:
            if starts:
                route, at = [], src
                while at is not None:
                    route.append(at)
                    at = after[at, dst]
                assert len(route) == length
                got.append(route)
        assert sorted(got) == want


def test_routes_are_followed_where_asked_for(spark, files, monkeypatch):
    from scanframe.functions import routes

    chain = "\n".join(["a0 = request.GET('q')", *[f"a{k + 1} = f(a{k})" for k in range(40)], "query(a40)", "b = request.GET('b')", "query(b)"])
    graph = flow.analyze_files(files(("p/a.py", chain), ("p/b.py", PAIR)))
    for limit in (7, routes.ROUTE_IDS):
        monkeypatch.setattr(routes, "ROUTE_IDS", limit)
        monkeypatch.setattr(routes, "LINK_ROWS", limit)
        rows = flow.with_routes(graph, graph.findings).collect()
        assert len(rows) == graph.findings.count() == 43
        assert all(len(r.flow_path) == r.path_length and (r.flow_path[0], r.flow_path[-1]) == (r.src, r.dst) for r in rows)
        assert all(r.flow_path == sorted(r.flow_path) for r in rows)
    some = flow.with_routes(graph, graph.findings.where("path_length = 42")).collect()
    assert [len(r.flow_path) for r in some] == [42]


def test_work_between_grows_with_the_findings(files):
    """A chain that is used by a sink at its end only: as many links as findings, whatever the routes' length."""
    from scanframe.functions import routes

    for steps in (200, 4000):
        lines = ["a0 = request.GET('q')", *[f"a{k + 1} = f(a{k})" for k in range(steps)], f"query(a{steps})"]
        graph = flow.analyze_files(files(("p/a.py", "\n".join(lines))))
        assert (graph.findings.count(), graph.links.count()) == (steps + 1, steps + 2)  # the sink's own node is not tainted
    none = {"source": False, "sink": True, "cleans": False}
    events = [{"node": 0, "from": None, "assigns": False, **none, "source": True}]
    events += [{"node": k + 1, "from": k, "assigns": True, **none} for k in range(400)]
    n = sum(1 for _, dst, *_ in routes.file_flows(events, None) if dst is not None)  # every step is a sink
    assert n == 401 * 402 // 2
