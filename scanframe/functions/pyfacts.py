"""Python text -> array of syntax facts (the only step that needs a Python parser).

The parser is the one of the standard library. This helper records plain syntax only
(names, scopes, argument shapes, statement positions); what is suspicious is decided
later by column expressions and joins.
"""

from __future__ import annotations

import ast
import gc
import warnings

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scanframe.schemas import FACT

_FACTS = T.ArrayType(FACT)


def _dotted(func: ast.expr) -> str:
    """Dotted name of a call target: ``()`` for calls inside the chain, empty for other starts."""
    parts = []
    while True:
        if isinstance(func, ast.Attribute):
            parts.append(func.attr)
            func = func.value
        elif isinstance(func, ast.Call):
            parts.append("()")
            func = func.func
        else:
            break
    parts.append(func.id if isinstance(func, ast.Name) else "")
    return ".".join(reversed(parts)).replace(".()", "()")


def _short(func: ast.expr) -> str:
    """``f`` or ``a.f``; only the last part when the receiver is not a plain name."""
    if isinstance(func, ast.Name):
        return func.id
    if not isinstance(func, ast.Attribute):
        return "unknown"
    return f"{func.value.id}.{func.attr}" if isinstance(func.value, ast.Name) else func.attr


def _mentioned(expr: ast.expr) -> list[str]:
    """Plain names in an expression, looking through binary operators and call arguments."""
    names, todo = [], [expr]
    while todo:
        e = todo.pop()
        if isinstance(e, ast.Name):
            names.append(e.id)
        elif isinstance(e, ast.BinOp):
            todo += [e.right, e.left]
        elif isinstance(e, ast.Call):
            todo += reversed(e.args)
    return names


def _call_columns(call: ast.Call) -> dict:
    return {
        "name": _short(call.func),
        "qual": _dotted(call.func),
        "args": [
            {
                "name": a.id if isinstance(a, ast.Name) else None,
                "percent": isinstance(a, ast.BinOp) and isinstance(a.op, ast.Mod),
                "vars": _mentioned(a),
            }
            for a in call.args
        ],
        "true_flags": [
            k.arg for k in call.keywords if k.arg and isinstance(k.value, ast.Constant) and k.value.value is True
        ],
    }


def _assignment(node: ast.Assign) -> list[dict]:
    targets = [t.id for t in node.targets if isinstance(t, ast.Name)]
    if not targets:
        return []
    fact = {"kind": "assign", "targets": targets, "value": "other"}
    if isinstance(node.value, ast.Call):
        fact.update(_call_columns(node.value), value="call")
    elif isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
        fact["value"] = "str"
    return [fact]


def _try(node: ast.Try) -> list[dict]:
    body = {"kind": "guarded", "line": node.body[0].lineno, "end_line": node.body[-1].end_lineno}
    return [{"kind": "control", "name": "try"}, body]


# Facts stated by one node, by node type; all other nodes state none.
_FACTS_OF = {
    ast.Call: lambda node: [{"kind": "call", **_call_columns(node)}],
    ast.Assign: _assignment,
    ast.FunctionDef: lambda node: [{"kind": "func", "name": node.name}],
    ast.AsyncFunctionDef: lambda node: [{"kind": "async_func", "name": node.name}],
    ast.ClassDef: lambda node: [{"kind": "class", "name": node.name}],
    ast.Import: lambda node: [{"kind": "import", "name": a.name} for a in node.names],
    ast.If: lambda node: [{"kind": "control", "name": "if"}],
    ast.While: lambda node: [{"kind": "control", "name": "while"}],
    ast.For: lambda node: [{"kind": "control", "name": "for"}],
    ast.Try: _try,
    ast.Return: lambda node: [{"kind": "stop", "name": "return"}],
    ast.Raise: lambda node: [{"kind": "stop", "name": "raise"}],
    ast.Break: lambda node: [{"kind": "stop", "name": "break"}],
    ast.Continue: lambda node: [{"kind": "stop", "name": "continue"}],
}
_PLACED = frozenset((ast.Call, ast.Return, ast.Raise, ast.Break, ast.Continue))  # facts that carry their blocks
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
# Fields that hold names, numbers or leaves, never a node that is or holds a fact.
_PLAIN = frozenset((
    "arg", "attr", "conversion", "ctx", "id", "is_async", "kind", "kwd_attrs", "level", "module", "op", "ops", "rest",
    "simple", "type_comment", "type_ignores"))


class _Kinds(dict):
    """Per node type: whether it is an inner node, whether it is a statement, and its fields that can hold inner nodes."""

    def __missing__(self, kind: type) -> tuple:
        inner = issubclass(kind, ast.AST) and not issubclass(kind, _LEAVES)
        self[kind] = inner, issubclass(kind, ast.stmt), tuple(f for f in kind._fields if f not in _PLAIN) if inner else ()
        return self[kind]


_KINDS = _Kinds()


def facts_of(text: str | None) -> list[dict]:
    """Facts of one file in source order; a single ``parse_error`` fact when it does not parse."""
    if text is None:
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [{"seq": 0, "kind": "parse_error"}]
    out, n_blocks, kinds = [], 0, _KINDS
    # node, enclosing function, class, calls and (block, position) pairs
    todo = [(tree, None, None, (), ())]
    while todo:
        node, fn, cls, chain, blocks = todo.pop()
        kind = type(node)
        if kind is ast.FunctionDef:
            fn = node.name
        elif kind is ast.Call:
            chain += (_short(node.func),)
        stated = _FACTS_OF.get(kind)
        if stated:
            where = {"line": node.lineno, "end_line": node.end_lineno, "fn": fn, "cls": cls, "chain": chain}
            if kind in _PLACED:
                where["blocks"] = [{"block": b, "pos": p} for b, p in blocks]
            for row in stated(node):
                out.append({"seq": len(out), **where, **row})
        if kind is ast.ClassDef:
            cls = node.name
        below = []
        values = node.__dict__
        for name in kinds[kind][2]:
            value = values.get(name)
            if value is None:
                continue
            of = type(value)
            if of is list:
                if not value:
                    continue
                if kinds[type(value[0])][1]:
                    n_blocks += 1
                    below += [(v, fn, cls, chain, (*blocks, (n_blocks, i))) for i, v in enumerate(value)]
                else:
                    below += [(v, fn, cls, chain, blocks) for v in value if kinds[type(v)][0]]
            elif kinds[of][0]:
                below.append((value, fn, cls, chain, blocks))
        below.reverse()
        todo += below
    return out


def placeless_facts(text: str) -> list[dict]:
    """``facts_of`` without what says where in the tree a fact stands: scope, calls around it, blocks, last line."""
    try:
        todo = [ast.parse(text)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [{"seq": 0, "kind": "parse_error"}]
    out, kinds = [], _KINDS
    while todo:
        node = todo.pop()
        kind = type(node)
        stated = _FACTS_OF.get(kind)
        if stated:
            for row in stated(node):
                out.append({"seq": len(out), "line": node.lineno, **row})
        below = []
        values = node.__dict__
        for name in kinds[kind][2]:
            value = values.get(name)
            if value is None:
                continue
            of = type(value)
            if of is list:
                below += [v for v in value if kinds[type(v)][0]]
            elif kinds[of][0]:
                below.append(value)
        below.reverse()
        todo += below
    return out


def python_facts(text: Column) -> Column:
    """Array of syntax facts per text, evaluated in Arrow batches."""
    arrow_type = to_arrow_type(_FACTS)

    @F.arrow_udf(_FACTS)
    def extract(texts: pa.Array) -> pa.Array:
        collects = gc.isenabled()
        gc.disable()  # syntax trees hold no cycles, and a collection walks all facts of the batch
        try:
            with warnings.catch_warnings():  # odd escapes in a scanned file are not our concern
                warnings.simplefilter("ignore")
                return pa.array([facts_of(t) for t in texts.to_pylist()], type=arrow_type)
        finally:
            if collects:
                gc.enable()

    return extract(text)
