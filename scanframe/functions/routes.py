"""Taint and shortest routes inside the graph of one file, from arrays in the file's own row.

What leaves the graph are links: for a node and a sink the next node on the way, its length,
and no route. All links to one sink form a tree whose edges lead to the sink, so a route is
followed only where one is asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa

EVENT = "struct<node:bigint,from:bigint,assigns:boolean,source:boolean,sink:boolean,cleans:boolean>"
#: A link; a row without ``dst`` says that node ``src`` is tainted.
FOUND = "file_id bigint, src bigint, dst bigint, next bigint, length int, starts boolean"
_FOUND = pa.schema([
    ("file_id", pa.int64()), ("src", pa.int64()), ("dst", pa.int64()), ("next", pa.int64()), ("length", pa.int32()), ("starts", pa.bool_())])
LINK_ROWS = 100_000  # that a task holds before it hands them on
ROUTE_IDS = 1 << 20  # nodes of routes that a task holds before it hands them on


def _reach(starts: list[int], following: dict[int, list[int]]) -> set[int]:
    seen, todo = set(starts), list(starts)
    while todo:
        for n in following.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def _links_to(sink: int, backwards: dict[int, list[int]], within: set[int], cleans: set[int], longest: int | None):
    """(node, next, length, clean) for all nodes that reach a sink, by rising distance from it.

    Of several next nodes at the same distance the smallest is taken, which makes the route the
    smallest list of nodes among the shortest. A route is clean if no node on it cleans: the
    node does not, and the rest of its route is clean.
    """
    known = {sink: (None, sink not in cleans)}
    level, length = [sink], 1
    while level and (longest is None or length <= longest):
        for node in level:
            after, clean = known[node]
            yield node, after, length, clean
        nearer: dict[int, int] = {}
        for node in level:
            for n in backwards.get(node, ()):
                if n in within and n not in known:
                    nearer[n] = min(node, nearer.get(n, node))
        for n, after in nearer.items():
            known[n] = after, n not in cleans and known[after][1]
        level, length = list(nearer), length + 1


def file_flows(events: list[dict], longest: int | None) -> Iterator[tuple]:
    """(src, dst, next, length, starts): tainted nodes of a file, then the links on routes to a sink without a cleaning node.

    ``starts`` marks links whose node is tainted: each is a finding. Only nodes that untrusted
    data can reach are looked at. The links are as many as the findings, and those of nodes in
    between that are not tainted themselves; one sink is looked at after the other.
    """
    assigned: dict[int, list[int]] = {}
    following: dict[int, list[int]] = {}
    backwards: dict[int, list[int]] = {}
    sources, sinks, cleans = set(), set(), set()
    for e in events:
        if e["from"] is not None:
            following.setdefault(e["from"], []).append(e["node"])
            backwards.setdefault(e["node"], []).append(e["from"])
            if e["assigns"]:
                assigned.setdefault(e["from"], []).append(e["node"])
        for flag, group in (("source", sources), ("sink", sinks), ("cleans", cleans)):
            if e[flag]:
                group.add(e["node"])
    tainted = _reach(list(sources), assigned)
    reached = _reach(list(tainted), following)
    for node in sorted(tainted):
        yield node, None, None, 0, True
    for sink in sorted(sinks & reached):
        for node, after, length, clean in _links_to(sink, backwards, reached, cleans, longest):
            if clean:
                yield node, sink, after, length, node in tainted


def _events_of(column: pa.Array) -> Iterator[list[dict]]:
    """The events of each row as dicts, put together from whole columns."""
    inner = column.flatten()  # without the values below nulls and outside a slice
    names = [field.name for field in inner.type]
    rows = zip(*(values.to_pylist() for values in inner.flatten()), strict=True)
    for n in column.value_lengths().to_pylist():
        yield [dict(zip(names, row, strict=True)) for row in itertools.islice(rows, n or 0)]


def flows(longest: int | None):
    """Task from (file_id, array of EVENT) to rows of FOUND, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

        rows = []
        for batch in batches:
            for file_id, events in zip(batch.column("file_id").to_pylist(), _events_of(batch.column("events")), strict=True):
                for found in file_flows(events, longest):
                    rows.append((file_id, *found))
                    if len(rows) >= LINK_ROWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return run


#: A finding of a file with what its nodes say.
PAIR = ("file_id bigint, path string, project string, src bigint, dst bigint, length int, source_type string, source_line int, source_context string, "
        "sink_line int, sink_context string")
_PAIR = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
PAIR_BYTES = 8 << 20  # of strings of findings that a task holds before it hands them on


def bound_events(facts: list[dict], shift: int, sinks: list[str], cleans: list[str]) -> tuple[list[dict], dict[int, dict]]:
    """EVENTs of a file's flow facts in source order, each use bound to the latest definition before it, and the facts of its nodes."""
    latest: dict[str, int] = {}
    events, nodes = [], {}

    def node_of(fact, node):
        nodes[node] = fact
        return {"sink": any(n in fact["context"] for n in sinks), "cleans": any(n in fact["context"] for n in cleans)}

    for fact in facts:
        first = fact["seq"] << shift
        if fact["role"] == "sink":
            for k, name in enumerate(fact["arg_names"]):
                if name is not None and name in latest:
                    events.append({"node": first + k, "from": latest[name], "assigns": False, "source": False, **node_of(fact, first + k)})
            continue
        used = fact["vars"] if fact["role"] == "assignment" else [n for n in fact["arg_names"][:1] if n is not None] if fact["role"] == "sanitized" else []
        for k, target in enumerate(fact["targets"]):
            for name in used:
                if name in latest:
                    events.append({"node": first + k, "from": latest[name], "assigns": fact["role"] == "assignment", "source": False, "sink": False, "cleans": False})
            events.append({"node": first + k, "from": None, "assigns": False, "source": fact["role"] == "user_input", **node_of(fact, first + k)})
            latest[target] = first + k
    return events, nodes


def findings(longest: int | None, shift: int, sinks: list[str], cleans: list[str]):
    """Task from (file_id, path, project, flow_facts) to rows of PAIR, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PAIR, strict=True)], [c.split()[0] for c in PAIR.split(", ")])

        rows, held = [], 0
        for batch in batches:
            ids, paths, projects = (batch.column(c).to_pylist() for c in ("file_id", "path", "project"))
            for file_id, path, project, facts in zip(ids, paths, projects, _events_of(batch.column("flow_facts")), strict=True):
                events, nodes = bound_events(facts, shift, sinks, cleans)
                for src, dst, _, length, starts in file_flows(events, longest):
                    if dst is None or not starts:
                        continue
                    a, b = nodes[src], nodes[dst]
                    rows.append((file_id, path, project, src, dst, length, a["role"], a["line"], a["context"], b["line"], b["context"]))
                    held += len(path or "") + len(a["context"]) + len(b["context"])
                    if len(rows) >= LINK_ROWS or held >= PAIR_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return run


def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, dst, links to it as structs (src, next, wanted)) to (file_id, src, dst, route) of the wanted ones.

    Routes go on in batches of bounded size, however many a sink has.
    """
    names, rows, held = ["file_id", "src", "dst", "route"], [], 0

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names)

    for batch in batches:
        for file_id, dst, links in zip(*(batch.column(c) for c in ("file_id", "dst", "links")), strict=True):
            links = links.as_py()
            after = {x["src"]: x["next"] for x in links}
            for x in links:
                if x["wanted"]:
                    route, at = [], x["src"]
                    while at is not None:
                        route.append(at)
                        at = after[at]
                    rows.append((file_id.as_py(), x["src"], dst.as_py(), route))
                    held += len(route)
                    if held >= ROUTE_IDS:
                        yield batch_of(rows)
                        rows, held = [], 0
    if rows:
        yield batch_of(rows)
