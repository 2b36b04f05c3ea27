"""Leaf facts of Python sources: the strings, classes and imports a file holds, one struct per file.

Reading Python syntax is the one thing Spark has no expression for. The function below only lists what stands in a
file; every decision about it (which strings are operations, what a name resolves to, which classes are models) is
made on the listed rows by Spark.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections import deque

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.batches import uncollected

# The function travels with its code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNREADABLE = "Unreadable"
# What an operation or fragment starts with, and the length of the longest such word.
START = re.compile(r"\s*(?:query|mutation|subscription|fragment|\{)", re.IGNORECASE)
SHORT = len("subscription")
# Nodes that hold no others of interest.
LEAVES = (ast.Constant, ast.Name, ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop, ast.alias)
INNER = frozenset(c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST) and not issubclass(c, LEAVES))
# Fields that never hold such nodes, and the others of each node; the nodes that facts are read from.
PLAIN = frozenset(("arg", "asname", "attr", "conversion", "ctx", "id", "kind", "level", "module", "op", "ops", "type_comment", "type_ignores"))
CHILDREN = {c: tuple(field for field in c._fields if field not in PLAIN) for c in INNER}
TELLING = frozenset((ast.Assign, ast.AnnAssign, ast.Return, ast.BinOp, ast.JoinedStr, ast.ImportFrom, ast.ClassDef))

PARTS = "array<struct<kind:string,text:string>>"
FACTS = (
    "struct<error:string,"
    f"strings:array<struct<ctx:string,name:string,owner:string,line:int,first:int,last:int,parts:{PARTS}>>,"
    "bindings:map<string,string>,"
    "classes:array<struct<name:string,bases:array<string>,decorators:array<struct<name:string,attribute:boolean>>,"
    "raw:string,first:int,last:int>>,"
    "imports:array<struct<module:string,name:string,alias:string>>>"
)

_part = pa.struct([("kind", pa.string()), ("text", pa.string())])
_string = pa.struct(
    [("ctx", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("line", pa.int32()),
     ("first", pa.int32()), ("last", pa.int32()), ("parts", pa.list_(_part))]
)
_decorator = pa.struct([("name", pa.string()), ("attribute", pa.bool_())])
_class = pa.struct(
    [("name", pa.string()), ("bases", pa.list_(pa.string())), ("decorators", pa.list_(_decorator)),
     ("raw", pa.string()), ("first", pa.int32()), ("last", pa.int32())]
)
_import = pa.struct([("module", pa.string()), ("name", pa.string()), ("alias", pa.string())])
FACTS_ARROW = pa.struct(
    [("error", pa.string()), ("strings", pa.list_(_string)), ("bindings", pa.map_(pa.string(), pa.string())),
     ("classes", pa.list_(_class)), ("imports", pa.list_(_import))]
)


def _is_text(node) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, str)


def _plain(text: str) -> str:
    """A literal as it can be stored: half of a surrogate pair alone, which no encoding holds, becomes a question mark."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _adds(node) -> bool:
    return isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add)


def _terms(node) -> list:
    """The terms of a sum from left to right, however long it is."""
    waiting, terms = [node], []
    while waiting:
        node = waiting.pop()
        if _adds(node):
            waiting += [node.right, node.left]
        else:
            terms.append(node)
    return terms


def _pieces(node, nested: bool):
    """The pieces of a string that is not a sum; None if it is not a string."""
    if _is_text(node):
        return [{"kind": "text", "text": _plain(node.value)}]
    if isinstance(node, ast.JoinedStr):
        pieces = []
        for value in node.values:
            if _is_text(value):
                pieces.append({"kind": "text", "text": _plain(value.value)})
            elif isinstance(value.value, ast.Name):
                pieces.append({"kind": "slot", "text": value.value.id})
            else:
                pieces.append({"kind": "member" if isinstance(value.value, ast.Attribute) else "other", "text": None})
        return pieces
    if nested and isinstance(node, ast.Name):
        return [{"kind": "name", "text": node.id}]
    return None


def _parts(node):
    """The pieces of a string expression, left to right; None if something in it is not a string."""
    if not _adds(node):
        return _pieces(node, False)
    found = []
    for term in _terms(node):
        pieces = _pieces(term, True)
        if pieces is None:
            return None
        found += pieces
    return found


def _may_be_operation(node) -> bool:
    """Whether a sum can be an operation or hold a name: its first term is no literal, or starts with a letter or brace
    as operations do. All its shorter beginnings share that first term, so the answer holds for them as well."""
    first = _leftmost(node)
    return not _is_text(first) or len(first.value.strip()) < SHORT or START.match(first.value) is not None


def _leftmost(node):
    while isinstance(node, ast.BinOp):
        node = node.left
    return node


def _label(node):
    """Name of a plain, dotted or subscripted expression, and whether it was dotted."""
    if isinstance(node, (ast.Call, ast.Subscript)):
        node = node.func if isinstance(node, ast.Call) else node.value
    if isinstance(node, ast.Name):
        return node.id, False
    if isinstance(node, ast.Attribute):
        return node.attr, True
    return None, False


def list_facts(source: str) -> dict:
    """The facts of one file. Never raises: what is not Python has a ``SyntaxError``, what cannot be read for another
    reason (nested too deeply for the parser, for one) an ``Unreadable`` error, which is no statement about its syntax."""
    nothing = {"strings": [], "bindings": [], "classes": [], "imports": []}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as problem:
        return {"error": _plain(f"SyntaxError: {problem}"), **nothing}
    except Exception as problem:  # noqa: BLE001
        return {"error": _plain(f"{UNREADABLE}: {type(problem).__name__}"), **nothing}
    try:
        return _facts_of(tree, source)
    except Exception as problem:  # noqa: BLE001
        return {"error": _plain(f"{UNREADABLE}: {type(problem).__name__}"), **nothing}


def _walk(tree):
    """The nodes of a tree that facts are read from, level by level in the order of ``ast.walk``."""
    waiting = deque((tree,))
    while waiting:
        node = waiting.popleft()
        kind = node.__class__
        if kind in TELLING:
            yield node
        for field in CHILDREN[kind]:
            value = getattr(node, field, None)
            if value.__class__ is list:
                for item in value:
                    if item.__class__ in INNER:
                        waiting.append(item)
            elif value.__class__ in INNER:
                waiting.append(value)


def _facts_of(tree, source: str) -> dict:
    lines = None
    strings, bindings, classes, imports = [], {}, [], []
    no_operation: set[int] = set()  # sums that begin like one that cannot be an operation

    def note(ctx, value, name=None, owner=None):
        pieces = _parts(value) if value is not None else None
        if pieces is not None:
            strings.append(
                {"ctx": ctx, "name": name, "owner": owner, "line": value.lineno,
                 "first": _leftmost(value).lineno, "last": value.end_lineno, "parts": pieces}
            )

    for node in _walk(tree):
        if isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    note("assign", node.value, target.id)
                    if _is_text(node.value):
                        bindings.setdefault(target.id, _plain(node.value.value))
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            if node.value is not None and _parts(node.value) is not None:
                note("annotated", node.value, node.target.id)
                strings[-1]["line"] = node.lineno
        elif isinstance(node, ast.Return):
            note("return", node.value)
            if isinstance(node.value, ast.Call) and node.value.args and _label(node.value.func) == ("gql", False):
                note("return_gql", node.value.args[0])
        elif isinstance(node, ast.BinOp):
            if id(node) in no_operation:
                continue
            if _may_be_operation(node):
                note("concat", node)
            else:
                while isinstance(node, ast.BinOp):
                    no_operation.add(id(node))
                    node = node.left
        elif isinstance(node, ast.JoinedStr):
            note("fstring", node)
        elif isinstance(node, ast.ImportFrom):
            imports += [{"module": node.module, "name": item.name, "alias": item.asname} for item in node.names]
        elif isinstance(node, ast.ClassDef):
            if lines is None:
                lines = [line.encode() for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", source)]
            body = lines[node.lineno - 1 : node.end_lineno]
            body[-1] = body[-1][: node.end_col_offset]
            body[0] = body[0][node.col_offset :]
            labels = [_label(base)[0] for base in node.bases if not isinstance(base, ast.Call)]
            decorators = [_label(d) for d in node.decorator_list if not isinstance(d, ast.Subscript)]
            classes.append(
                {"name": node.name, "bases": [b for b in labels if b],
                 "decorators": [{"name": n, "attribute": dotted} for n, dotted in decorators if n],
                 "raw": b"".join(body).decode(), "first": node.lineno, "last": node.end_lineno}
            )
            for item in node.body:
                if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
                    if isinstance(item.value, ast.Call) and _label(item.value.func) == ("Field", False):
                        for keyword in item.value.keywords:
                            if keyword.arg == "default" and _is_text(keyword.value):
                                note("field", keyword.value, item.target.id, node.name)
                    else:
                        note("field", item.value, item.target.id, node.name)
                elif isinstance(item, ast.Assign):
                    for target in item.targets:
                        if isinstance(target, ast.Name):
                            note("field", item.value, target.id, node.name)
    return {"error": None, "strings": strings, "bindings": list(bindings.items()), "classes": classes,
            "imports": imports}


def python_facts(source: Column) -> Column:
    """The facts of a Python source as one struct; Arrow batches, one parse per file."""

    @F.arrow_udf(FACTS)
    def read(batch: pa.Array) -> pa.Array:
        with uncollected(), warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _structs([list_facts(text or "") for text in batch.to_pylist()], FACTS_ARROW)

    return read(source)


def _structs(rows: list, kind: pa.StructType) -> pa.Array:
    """Dictionaries as structs, built column by column, which is much quicker than row by row."""
    columns = []
    for field in kind:
        name = field.name
        columns.append(_column([row[name] for row in rows], field.type))
    return pa.StructArray.from_arrays(columns, fields=[*kind])


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """A column; lists of structs never are null."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    offsets, flat = [0], []
    for value in values:
        flat += value
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _structs(flat, kind.value_type))
