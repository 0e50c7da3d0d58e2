"""Table functions over JavaScript and TypeScript sources, by pattern and bracket matching.

There is no parser for these languages here. What stands in comments and strings is blanked out before brackets are
matched; methods made in other ways than those named below are not seen.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Words that stand before a bracket without being a method's name.
NO_METHOD = set("if for while switch catch function return await typeof new else do with constructor super import".split())
_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_NAMED = re.compile(r"\b(?:async\s+)?function\s*\*?\s*(\w+)\s*\(([^)]*)\)\s*\{|(?:^|[;{}])\s*(?:static\s+)?(?:async\s+)?(\w+)\s*\(([^()]*)\)\s*\{", re.M)
_PROPERTY = re.compile(r"\b(\w+)\s*:\s*async\s*\(([^)]*)\)\s*=>")
_ARROW = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|(\w+))\s*=>\s*(\{)?")
_RETURN = re.compile(r"\breturn\b([^;\n}]*)")

_Q, _NOT_Q = "['\"`]", "[^'\"`]*"
#: How routes are declared: pattern, group of the url, group of the handler. Both orders of path and handler occur.
ROUTES = (
    (re.compile(rf"\b(?:app|router)\.(?:get|post|put|delete|patch)\(\s*{_Q}({_NOT_Q}){_Q}\s*,\s*(?:[\w.]+\s*,\s*)*?([\w.]+)\s*\)"), 1, 2),
    (re.compile(rf"\b(?:route|path):\s*{_Q}({_NOT_Q}){_Q}(?:(?!\b(?:route|path|handler):)[^{{}}])*?\bhandler:\s*{_Q}?([\w.]+)"), 1, 2),
    (re.compile(rf"\bhandler:\s*{_Q}?([\w.]+){_Q}?(?:(?!\b(?:route|path|handler):)[^{{}}])*?\b(?:route|path):\s*{_Q}({_NOT_Q}){_Q}"), 2, 1),
)
_PLACEHOLDER = re.compile(r"^\$\{[^}]*\}")


def quiet(content: str) -> str:
    """The source with comments and strings blanked out, at the same places."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)


def _close(text: str, opening: int) -> int:
    """Where the brace at `opening` is closed, or the text's end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, opening):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text) - 1


def return_type(body: str) -> str:
    """What the returns give, joined by bars; void without any."""
    found = [body[m.start(1) : m.end(1)].strip() for m in _RETURN.finditer(quiet(body))]
    return " | ".join(dict.fromkeys(filter(None, found))) or "void"


def methods(content: str | None) -> list[tuple[str, int | None, int | None, list[str], str]]:
    """(name, first line, last line, parameters, return type) in source order.

    Named functions and methods; `name: async (..) =>` properties, whose range is null; functions that a variable is
    given. Of a property that is also a named function the first stays.
    """
    if not content:
        return []
    text = quiet(content)
    line = lambda at: content.count("\n", 0, at) + 1
    found: dict[tuple, tuple] = {}
    names = set()
    for m in _NAMED.finditer(text):
        name = m[1] or m[3]
        if name not in NO_METHOD:
            end = _close(text, m.end() - 1)
            start = m.start(1) if m[1] else m.start(3)
            found[name, line(start)] = (name, line(start), line(end), _parameters(m[2] if m[1] else m[4]), return_type(content[m.end() : end]))
            names.add(name)
    for m in _ARROW.finditer(text):
        end = _close(text, m.end() - 1) if m[4] else max(text.find("\n", m.end()), m.end())
        body = content[m.end() : end]
        found[m[1], line(m.start(1))] = (m[1], line(m.start(1)), line(end), _parameters(m[2] or m[3] or ""), return_type(body) if m[4] else body.strip().rstrip(";") or "void")
        names.add(m[1])
    for m in _PROPERTY.finditer(text):
        if m[1] not in names:
            names.add(m[1])
            found[m[1], line(m.start(1))] = (m[1], None, None, _parameters(m[2]), "void")
    return [found[k] for k in sorted(found, key=lambda k: k[1])]


def _parameters(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def route_map(content: str | None) -> list[tuple[str, str]]:
    """(handler, url) of declared routes, the url without a placeholder in front; each pair once."""
    out = [(m[h].rpartition(".")[2], _PLACEHOLDER.sub("", m[u])) for pattern, u, h in ROUTES for m in pattern.finditer(content or "")]
    return list(dict.fromkeys(out))


def handler_definitions(content: str | None) -> list[tuple[str, str, int]]:
    """(handler, function, line): where each name that a variable is given ends up, through aliases."""
    text = quiet(content or "")
    defined = {m[0]: m[1] for m in methods(content) if m[1] is not None}
    alias = {m[1]: m[2] for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(\w+)\s*;?\s*$", text, re.M)}
    out = []
    for name in sorted({*alias, *defined}):
        at, seen = name, {name}
        while at not in defined and alias.get(at, name) not in seen:
            seen.add(at := alias[at])
        if at in defined:
            out.append((name, at, defined[at]))
    return out


def near_route_handlers(content: str | None, most: int = 10) -> list[tuple[str, str, int]]:
    """(route, handler, line) of `route:` and `handler:` entries at most so many lines apart, the nearest one."""
    lines = (content or "").split("\n")
    routes = [(k, m[1]) for k, t in enumerate(lines, 1) for m in re.finditer(rf"\b(?:route|path):\s*{_Q}({_NOT_Q}){_Q}", t)]
    handlers = [(k, m[1]) for k, t in enumerate(lines, 1) for m in re.finditer(rf"\bhandler:\s*{_Q}?([\w.]+)", t)]
    out = []
    for k, route in routes:
        near = [(abs(j - k), j, h) for j, h in handlers if abs(j - k) <= most]
        if near:
            out.append((route, min(near)[2], k))
    return out


def static_tail(url: str | None) -> str | None:
    """The last segment of a url that is no placeholder; None if both of the last two are."""
    parts = [p for p in (url or "").split("/") if p]
    fixed = [p for p in parts[-2:] if "$" not in p]
    return fixed[-1] if fixed else None


def _table_function(function, columns: str):
    class Rows:
        def eval(self, content: str):
            yield from function(content)

    Rows.__name__, Rows.__doc__ = function.__name__, function.__doc__
    return udtf(Rows, returnType=columns)


TABLE_FUNCTIONS = {
    "js_methods": _table_function(methods, "name string, start_line int, end_line int, parameters array<string>, return_type string"),
    "js_routes": _table_function(route_map, "handler string, url string"),
    "js_handlers": _table_function(handler_definitions, "handler string, function string, line int"),
    "js_near_handlers": _table_function(near_route_handlers, "route string, handler string, line int"),
}


def extract(files: DataFrame, name: str) -> DataFrame:
    """Rows of a table function for each of files(path, content), with the path in front."""
    return files.select("path", "content").lateralJoin(TABLE_FUNCTIONS[name](F.col("content").outer())).drop("content")


def grep_rows(output: DataFrame, col: str = "value") -> DataFrame:
    """(path, lineno, text) of `file:line:text` rows; other rows are left out."""
    parts = F.split(F.col(col), ":", 3)
    rows = output.where(F.size(parts) == 3).select(parts[0].alias("path"), F.try_to_number(parts[1], F.lit("9999999999")).cast("int").alias("lineno"), parts[2].alias("text"))
    return rows.where("lineno IS NOT NULL")


def definitions_in(rows: DataFrame, name: str) -> DataFrame:
    """F8: rows of grep_rows() that define a name rather than use it."""
    return rows.where(F.col("text").rlike(rf"\b(function\s+{re.escape(name)}\b|(const|let|var)\s+{re.escape(name)}\s*=|{re.escape(name)}\s*:\s*(async\s*)?(\(|function)|^\s*(async\s+)?{re.escape(name)}\s*\([^)]*\)\s*\{{)"))


def without_registry(urls: DataFrame, col: str = "url", hosts: tuple[str, ...] = ("registry.npmjs.org", "registry.yarnpkg.com")) -> DataFrame:
    """urls that are not a package registry's."""
    test = F.lit(False)
    for h in hosts:
        test = test | F.col(col).contains(h)
    return urls.where(~F.coalesce(test, F.lit(False)))
