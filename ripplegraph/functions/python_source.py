"""Table functions over Python sources. Each takes a source and yields rows; a source that does not parse yields none."""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import schema

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
HTTP_VERBS = {"get", "post", "put", "delete", "patch"}


def parse(content: str | None) -> ast.Module | None:
    """The tree of a source, dedented if it must be; None if it does not parse."""
    for text in (content or "", textwrap.dedent(content or "")):
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError):
            continue
    return None


def names_in(node: ast.AST | None) -> list[str]:
    """E5: names read anywhere in an expression, in source order, each once."""
    found = [n for n in ast.walk(node)] if node is not None else []
    named = [(n.lineno, n.col_offset, n.id) for n in found if isinstance(n, ast.Name)]
    return list(dict.fromkeys(name for _, _, name in sorted(named)))


def target_names(target: ast.expr) -> list[str]:
    """Names that an assignment binds; attributes and items count by their root's name."""
    if isinstance(target, (ast.Tuple, ast.List)):
        return [n for t in target.elts for n in target_names(t)]
    if isinstance(target, ast.Starred):
        return target_names(target.value)
    while isinstance(target, (ast.Attribute, ast.Subscript)):
        target = target.value
    return [target.id] if isinstance(target, ast.Name) else []


def call_name(node: ast.AST) -> str | None:
    """The bare name that a call goes to."""
    if isinstance(node, ast.Await):
        node = node.value
    if not isinstance(node, ast.Call):
        return None
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def constant(node: ast.AST | None):
    return node.value if isinstance(node, ast.Constant) else None


def _route_of(node: ast.AST, prefer_route: bool) -> str | None:
    """The first argument of a decorator that calls an attribute: the last such one or, of several, `.route`."""
    found = [(d.func.attr, d.args[0]) for d in node.decorator_list if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args]
    found = [(attr, a.value if isinstance(a, ast.Constant) else a.id) for attr, a in found if isinstance(a, ast.Name) or isinstance(constant(a), str)]
    if prefer_route and any(attr == "route" for attr, _ in found):
        found = [x for x in found if x[0] == "route"]
    return str(found[-1][1]) if found else None


def methods(content: str | None, compat: bool = False) -> list[tuple[str, int, int, str | None]]:
    """(name, first line, last line, route) in source order.

    A method that contains another ends on the line before it. With compat, async functions are no methods and the last
    decorator's route holds.
    """
    tree = parse(content)
    if tree is None:
        return []
    kinds = (ast.FunctionDef,) if compat else FUNCTIONS
    out: list[list] = []

    def visit(node: ast.AST, outer: list | None) -> None:
        for child in ast.iter_child_nodes(node):
            here = outer
            if isinstance(child, kinds):
                if outer is not None:
                    outer[2] = min(outer[2], child.lineno - 1)
                here = [child.name, child.lineno, child.end_lineno, _route_of(child, not compat)]
                out.append(here)
            visit(child, here)

    visit(tree, None)
    return [tuple(m) for m in sorted(out, key=lambda m: m[1])]


def line_facts(content: str | None, compat: bool = True) -> list[tuple]:
    """(lineno, type, targets, ending, values, function) of assignments, conditions and loops.

    With compat, calls count only where their result is assigned; otherwise every call has a fact of type Call. Of
    several facts on a line the last one stays.
    """
    tree, facts = parse(content), {}
    for node in ast.walk(tree) if tree is not None else ():
        if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and node.value is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            facts[node.lineno] = ("Assign", [n for t in targets for n in target_names(t)], node.end_lineno, names_in(node.value), call_name(node.value))
        elif isinstance(node, ast.If):
            facts[node.lineno] = ("If", [], node.body[-1].end_lineno, names_in(node.test), None)
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            facts[node.lineno] = ("For", target_names(node.target), node.body[-1].end_lineno, names_in(node.iter), None)
    if not compat:
        for node in ast.walk(tree) if tree is not None else ():
            if isinstance(node, ast.Call) and call_name(node) and (node.lineno not in facts or facts[node.lineno][4] is None):
                kind, targets, end, values, _ = facts.get(node.lineno, ("Call", [], node.end_lineno, names_in(node), None))
                facts[node.lineno] = (kind, targets, end, values, call_name(node))
    return [(k, *v) for k, v in sorted(facts.items())]


def definitions(content: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of classes and functions."""
    tree = parse(content)
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.ClassDef, *FUNCTIONS))] if tree else []
    return sorted((("class" if isinstance(n, ast.ClassDef) else "function", n.name, n.lineno, n.end_lineno) for n in found), key=lambda r: r[2])


def routes(content: str | None) -> list[tuple[str, int, int, str, list[str]]]:
    """(function, first line, last line, path, methods) of functions decorated with `.route(path, methods=[..])`."""
    tree, out = parse(content), []
    for node in ast.walk(tree) if tree else ():
        for d in node.decorator_list if isinstance(node, FUNCTIONS) else ():
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr == "route" and d.args and isinstance(constant(d.args[0]), str):
                listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                verbs = [str(constant(e)) for e in listed.elts if constant(e)] if isinstance(listed, (ast.List, ast.Tuple, ast.Set)) else []
                out.append((node.name, node.lineno, node.end_lineno, constant(d.args[0]), verbs))
    return sorted(out, key=lambda r: r[1])


def _walk_scoped(tree: ast.Module) -> Iterator[tuple[ast.AST, ast.AST | None]]:
    """Nodes in source order, each with the innermost function around it."""
    stack: list[tuple[ast.AST, ast.AST | None]] = [(tree, None)]
    while stack:
        node, around = stack.pop()
        yield node, around
        inner = node if isinstance(node, FUNCTIONS) else around
        stack.extend((c, inner) for c in reversed(list(ast.iter_child_nodes(node))))


def _folded(node: ast.AST, known: dict[str, str]) -> str | None:
    """The text of an expression of constants, known variables and `+`; None if something else is in it."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        left, right = _folded(node.left, known), _folded(node.right, known)
        return None if left is None or right is None else left + right
    if isinstance(node, ast.Name):
        return known.get(node.id)
    return constant(node) if isinstance(constant(node), str) else None


def url_assignments(content: str | None) -> list[tuple[str, int, str, str | None]]:
    """(variable, line, url, function or None) of variables that are given a url, also by `+` from other ones."""
    tree, known, out = parse(content), {}, []
    for node, around in _walk_scoped(tree) if tree else ():
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            text = _folded(node.value, known)
            if text and text.startswith(("http://", "https://")):
                known[node.targets[0].id] = text
                out.append((node.targets[0].id, node.lineno, text, around.name if around else None))
    return out


def http_calls(content: str | None) -> list[tuple[str, int, int, int | None, int | None, str]]:
    """(variable, line, column, first and last line of the function around, verb) of calls that are given a variable
    as url: `x.get(var)`, `x.post(url=var)` and the like, and `Request(var)`."""
    tree, out = parse(content), []
    for node, around in _walk_scoped(tree) if tree else ():
        name = call_name(node) if isinstance(node, ast.Call) else None
        if name in HTTP_VERBS and isinstance(node.func, ast.Attribute) or name == "Request":
            given = [a for a in node.args if isinstance(a, ast.Name)] + [k.value for k in node.keywords if isinstance(k.value, ast.Name) and k.arg in ("url", "uri", "endpoint")]
            out += [(a.id, node.lineno, node.col_offset, around.lineno if around else None, around.end_lineno if around else None, name) for a in given]
    return out


def indirect_urls(content: str | None) -> list[tuple[str, int, str, str]]:
    """(variable, line, path, function) of assignments by `+` in a function whose constant has more than two slashes."""
    tree, out = parse(content), []
    for node, around in _walk_scoped(tree) if tree else ():
        if around is not None and isinstance(node, ast.Assign) and isinstance(node.value, ast.BinOp) and isinstance(node.value.op, ast.Add):
            parts = [constant(n) for n in ast.walk(node.value) if isinstance(constant(n), str)]
            out += [(t, node.lineno, p, around.name) for p in parts if p.count("/") > 2 for target in node.targets for t in target_names(target)]
    return out


def variable_usages(content: str | None) -> list[tuple[str, int, str, str | None]]:
    """(variable, line, kind, function) of variables read: in a sum that is assigned (concat), alone (value) or
    deeper (nested) in what is assigned, or as an argument of a call (argument)."""
    tree, out = parse(content), []
    for node, around in _walk_scoped(tree) if tree else ():
        where = around.name if around else None
        if isinstance(node, ast.Assign):
            kind = "value" if isinstance(node.value, ast.Name) else "concat" if isinstance(node.value, ast.BinOp) else "nested"
            out += [(n, node.lineno, kind, where) for n in names_in(node.value)]
        elif isinstance(node, ast.Call):
            out += [(n, node.lineno, "argument", where) for a in [*node.args, *(k.value for k in node.keywords)] for n in names_in(a)]
    return list(dict.fromkeys(out))


def name_loads(content: str | None) -> list[tuple[str, int, int, str, int, int]]:
    """H2: (function, its first and last line, name, line, column) of names read inside functions."""
    tree, out = parse(content), []
    for node, around in _walk_scoped(tree) if tree else ():
        if around is not None and isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            out.append((around.name, around.lineno, around.end_lineno, node.id, node.lineno, node.col_offset))
    return out


def route_in_sum(content: str | None) -> list[tuple[int, str, str | None]]:
    """(line, constant, function) of constants with a slash in sums that are assigned."""
    tree, out = parse(content), []
    for node, around in _walk_scoped(tree) if tree else ():
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.BinOp):
            out += [(node.lineno, constant(n), around.name if around else None) for n in ast.walk(node.value) if isinstance(constant(n), str) and "/" in constant(n)]
    return out


def parse_error(content: str | None) -> list[tuple[str, int | None]]:
    """H6: (message, line) of a source that does not parse."""
    if parse(content) is not None:
        return []
    try:
        ast.parse(content or "")
    except (SyntaxError, ValueError) as error:
        return [(str(error), getattr(error, "lineno", None))]
    return []


def _table_function(function, columns: str, *flags):
    class Rows:
        def eval(self, content: str):
            yield from function(content, *flags)

    Rows.__doc__ = function.__doc__
    Rows.__name__ = function.__name__
    return udtf(Rows, returnType=columns)


#: The table functions by name; those with `compat` follow the narrower rules.
TABLE_FUNCTIONS = {
    "py_methods": _table_function(methods, schema.METHODS),
    "py_methods_compat": _table_function(methods, schema.METHODS, True),
    "py_line_facts": _table_function(line_facts, schema.LINE_FACTS, False),
    "py_line_facts_compat": _table_function(line_facts, schema.LINE_FACTS, True),
    "py_definitions": _table_function(definitions, "kind string, name string, start_line int, end_line int"),
    "py_routes": _table_function(routes, "name string, start_line int, end_line int, route_path string, methods array<string>"),
    "py_url_assignments": _table_function(url_assignments, "var string, line int, url string, function string"),
    "py_http_calls": _table_function(http_calls, "var string, line int, col int, method_begin int, method_end int, verb string"),
    "py_indirect_urls": _table_function(indirect_urls, "var string, line int, url string, function string"),
    "py_variable_usages": _table_function(variable_usages, "var string, line int, kind string, function string"),
    "py_name_loads": _table_function(name_loads, "method string, start_line int, end_line int, name string, line int, col int"),
    "py_route_in_sum": _table_function(route_in_sum, "line int, text string, function string"),
    "py_parse_error": _table_function(parse_error, "message string, line int"),
}


def extract(files: DataFrame, name: str) -> DataFrame:
    """Rows of a table function for each of files(path, content), with the path in front."""
    return files.select("path", "content").lateralJoin(TABLE_FUNCTIONS[name](F.col("content").outer())).drop("content")
