"""Queries over small inline tables, each with the rows that it must give, worked out by hand from the operator's rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import python_source, script_source, urls
from ..functions.scalars import as_array, ends_with_any, impact_prompt, local_time, nth_line, run_id, strip_punctuation
from ..operators import api, chunks, diff, graph, impact, relational, usage
from ..sources import files, sinks
from ..streaming import incremental
from . import samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'"


def rows_sql(columns: str, *rows: tuple) -> str:
    """SQL for these rows."""
    values = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    return f"SELECT * FROM (VALUES {values}) t({columns})"


def expects(columns: str, *rows: tuple):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, rows_sql(columns, *rows)
        return f

    return add


def joined(column: str, sep: str = ","):
    return F.array_join(column, sep).alias(column)


CLIENT = '''BASE = "http://stock.example.org"

def fetch(item):
    url = BASE + "/v1/items/all"
    plain = url
    deep = [plain]
    return send(plain, to=url)
'''


def _client(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("client.py", CLIENT)], "path string, content string")


def _uses(spark: SparkSession) -> DataFrame:
    python = samples.python_files(spark)
    m, f = python_source.extract(python, "py_methods"), python_source.extract(python, "py_line_facts")
    return usage.local_uses(m, f).unionByName(usage.global_uses(m, f))


def _index(spark: SparkSession) -> DataFrame:
    rows = [("u1", None, "p", 1, "f", False), ("u1", None, "q", 1, None, True), ("u2", None, "p", 2, "f", False), ("u3", None, "p", 7, None, False)]
    return api.url_index(spark.createDataFrame(rows, "url string, var string, path string, line int, method string, is_definition boolean"))


# ---- sources and what is read from them ------------------------------------------------------------------------------


@expects("path, var, line, url, function", ("client.py", "url", 4, "/v1/items/all", "fetch"))
def py_indirect_urls(spark, sf_dir):
    """E13."""
    return python_source.extract(_client(spark), "py_indirect_urls")


@expects("path, line, text, function", ("client.py", 4, "/v1/items/all", "fetch"))
def py_routes_in_sums(spark, sf_dir):
    """E14."""
    return python_source.extract(_client(spark), "py_route_in_sum")


@expects("path, var, line, kind, function", *(("client.py", var, line, kind, "fetch") for var, line, kind in (("BASE", 4, "concat"), ("url", 5, "value"), ("plain", 6, "nested"), ("plain", 7, "argument"), ("url", 7, "argument"))))
def py_variable_usages(spark, sf_dir):
    """E16."""
    return python_source.extract(_client(spark), "py_variable_usages")


@expects("method, start_line, end_line, name, line", *(("fetch", 3, 7, name, line) for name, line in (("BASE", 4), ("url", 5), ("plain", 6), ("send", 7), ("plain", 7), ("url", 7))))
def py_name_loads(spark, sf_dir):
    """H2, E7, X6."""
    return python_source.extract(_client(spark), "py_name_loads").select("method", "start_line", "end_line", "name", "line")


@expects("path, name, start_line, end_line", ("stock.py", "Stock", 3, 9), ("stock.py", "price", 4, 9), ("stock.py", "items", 12, 13))
def py_definitions(spark, sf_dir):
    """E8."""
    return python_source.extract(samples.python_files(spark).where("path = 'stock.py'"), "py_definitions").select("path", "name", "start_line", "end_line")


@expects("path, lineno, url", ("shop.js", 2, "http://orders.example.org/v1/orders"), ("shop.js", 10, "/shop/list"), ("shop.js", 12, "/shop/pay"), ("shop.js", 13, "/shop/all"))
def js_urls(spark, sf_dir):
    """Urls, and paths from their slash on."""
    return urls.script_urls(samples.script_files(spark))


@expects("path, handler, url", ("shop.js", "list", "/shop/list"), ("shop.js", "list", "/shop/all"), ("shop.js", "pay", "/shop/pay"))
def js_routes(spark, sf_dir):
    """E21."""
    return script_source.extract(samples.script_files(spark), "js_routes")


@expects("path, handler, function, line", ("shop.js", "handler", "pay", 5), ("shop.js", "list", "list", 1), ("shop.js", "pay", "pay", 5))
def js_handlers(spark, sf_dir):
    """E22."""
    return script_source.extract(samples.script_files(spark), "js_handlers")


@expects("path, handler, line", ("shop.js", "pay", 12), ("shop.js", "list", 13))
def js_near_handlers(spark, sf_dir):
    """E23."""
    return script_source.extract(samples.script_files(spark), "js_near_handlers").select("path", "handler", "line")


@expects("path, lineno", ("a.js", 3))
def grep_definitions(spark, sf_dir):
    """Of a search tool's rows those that define the name."""
    out = spark.createDataFrame([("a.js:3:function pay(x) {",), ("b.js:9:  pay(1);",), ("b.js:x:pay = 1",), ("noise",)], "value string")
    return script_source.definitions_in(script_source.grep_rows(out), "pay").select("path", "lineno")


@expects("url", ("http://a.example.org/b",))
def urls_without_registry(spark, sf_dir):
    """F17."""
    return script_source.without_registry(spark.createDataFrame([("https://registry.npmjs.org/x",), ("http://a.example.org/b",)], "url string"))


@expects("kind, name, line", ("package", "numpy", 1), ("package", "np", 1), ("package", "re", 1), ("method", "it's", 90))
def symbols_of_replies(spark, sf_dir):
    """Lists in replies, quotes of either kind; the first chunk's line stays, what is no list gives nothing."""
    rows = [("p", 0, 1, "package", "Here: ['numpy as np', 're']"), ("p", 1, 50, "package", "['re']"), ("p", 1, 50, "method", "nothing"), ("p", 2, 90, "method", '["it\'s"]')]
    return chunks.symbols_of_replies(spark.createDataFrame(rows, "path string, chunk int, first_line int, kind string, reply string")).select("kind", "name", "line")


@expects("name, path", ("a.py", "b/a.py"), ("z.py", None))
def files_by_basename(spark, sf_dir):
    """S6."""
    return files.find_by_basename(spark.createDataFrame([("x/a.py",), ("b/a.py",)], "path string"), spark.createDataFrame([("a.py",), ("z.py",)], "name string"))


@expects("path, snippet", ("orders.py", "def tax(amount):|    rate = amount * 2|    return rate"))
def source_snippets(spark, sf_dir):
    """H3, F7."""
    wanted = spark.createDataFrame([("orders.py", 7, 9)], "path string, first int, last int")
    return files.snippets(wanted, files.lines(samples.python_files(spark))).select("path", joined("snippet", "|"))


@expects("source, path, v", ("b.json", "p", 2), ("a.json", "q", 3))
def merged_summaries(spark, sf_dir):
    """S9."""
    return files.merged_summaries(spark.createDataFrame([("a.json", "p", 1), ("b.json", "p", 2), ("a.json", "q", 3)], "source string, path string, v int"))


@expects("repository", ("/r/x",))
def git_repositories(spark, sf_dir):
    """H5."""
    return files.git_repositories(spark.createDataFrame([("/r/x/.git/config",), ("/r/x/.git",), ("/r/y/z.py",)], "path string"))


@expects("path, kind, keyed", ("a.xlsx", "XL", "./a.xlsx"), ("./b.docx", "DOC", "./b.docx"), ("c.txt", None, "./c.txt"))
def plan_kinds(spark, sf_dir):
    """S15, F5."""
    return spark.createDataFrame([("a.xlsx",), ("./b.docx",), ("c.txt",)], "path string").select("path", files.plan_kind().alias("kind"), files.keyed_path().alias("keyed"))


@expects("file, key", ("a.py", "w/a.py"), ("zz.py", "NA"))
def changed_file_match(spark, sf_dir):
    """F4."""
    return diff.changed_file_match(spark.createDataFrame([("a.py",), ("zz.py",)], "file string"), spark.createDataFrame([("x/a.py",), ("w/a.py",)], "key string"))


@expects("recipient, subject, body", ("a@example.com", "Impact of changes in f.py", "g.py\nh.py"), ("b@example.com", "Impact of changes in f.py", "g.py"))
def notification_texts(spark, sf_dir):
    """S24."""
    return sinks.notifications(spark.createDataFrame([("a@example.com, b@example.com", "f.py", "g.py"), ("a@example.com", "f.py", "h.py")], "owner string, file string, impacted string"))


# ---- services ----------------------------------------------------------------------------------------------------------


@expects("path, name, local_api_call, inter_service_api_call", ("p", "f", "u1", "u2"), ("p", "g", "", ""))
def classified_calls(spark, sf_dir):
    """u1 is defined by a file here, u2 by none."""
    found = api.classified_calls(_index(spark), spark.createDataFrame([("p", "f"), ("p", "g")], "path string, name string"))
    return found.select("path", "name", joined("local_api_call"), joined("inter_service_api_call"))


@expects("path, urls", ("p", "u3"), ("q", "u1"))
def file_level_calls(spark, sf_dir):
    """U10, J8."""
    return api.file_level_calls(_index(spark)).select("path", joined("urls"))


@expects("path, name, global_uses", ("p", "f", "a,b"), ("p", "g", ""))
def merged_uses(spark, sf_dir):
    """Each use once, and none of methods that are not there."""
    schema = "path string, name string, global_uses array<string>"
    return api.merged_api(spark.createDataFrame([("p", "f", ["a"]), ("p", "g", [])], schema), spark.createDataFrame([("p", "f", ["b", "a"]), ("p", "z", ["c"])], schema)).select("path", "name", joined("global_uses"))


@expects("def_path, route_path, path, var, line", ("d.py", "/v1/items", "c.py", "U", 4))
def contract_uses(spark, sf_dir):
    """J6."""
    named = spark.createDataFrame([("c.py", "U", "http://h/v1/items"), ("c.py", "W", "http://h/v1/other")], "path string, var string, url string")
    return api.contract_uses(spark.createDataFrame([("d.py", "/v1/items")], "def_path string, route_path string"), named, spark.createDataFrame([("c.py", "U", 4), ("c.py", "W", 5)], "path string, var string, line int"))


@expects("use_path, use_method, certain", ("k.py", "g", True))
def changed_service_uses(spark, sf_dir):
    """Calls of another code base, in files that changed; url and query of the call as they are."""
    schema = "base string, path string, method string, urls array<string>"
    d = spark.createDataFrame([("S", "a.py", "f", ["/v1/x"])], schema)
    c = spark.createDataFrame([("T", "c.py", "g", ["http://h/v1/x"]), ("T", "k.py", "g", ["http://h/api/v1/x?k=1"]), ("S", "k.py", "z", ["/v1/x"])], schema)
    return api.inter_service_uses(d, c, spark.createDataFrame([("k.py",)], "file string")).select("use_path", "use_method", "certain")


# ---- uses and the graph ------------------------------------------------------------------------------------------------


@expects("def_path, def_name, n, uses", ("orders.py", "tax", 3, "orders.py:create,orders.py:later,stock.py:price"))
def grouped_uses(spark, sf_dir):
    """F6, A1."""
    found = usage.grouped_uses(_uses(spark), files.lines(samples.python_files(spark)))
    return found.select("def_path", "def_name", F.size("uses").alias("n"), F.array_join(F.transform("uses", lambda u: F.concat_ws(":", u["file_path"], u["method_nm"])), ",").alias("uses"))


@expects("def_path, name, use_path, lineno", ("orders.py", "tax", "stock.py", 6))
def word_calls(spark, sf_dir):
    """`tax(base)` has as many arguments as the method; the file's own calls do not count."""
    names = spark.createDataFrame([("orders.py", "tax", 1), ("orders.py", "price", 9)], "path string, name string, arity int")
    return usage.word_uses(names, files.lines(samples.python_files(spark)))


@expects("name, kind, path, method, lineno, usage_type", ("requests", "package", "orders.py", "create", 14, "local"), ("xequests", "package", "orders.py", "create", 14, "local"))
def similar_symbol_uses(spark, sf_dir):
    """Whole words, and words that are 85 % alike whatever their first letter."""
    python = samples.python_files(spark)
    m, text = python_source.extract(python, "py_methods"), files.lines(python)
    symbol = lambda name: spark.createDataFrame([("orders.py", "package", name)], "path string, kind string, name string")
    found = usage.symbol_uses(symbol("requests"), m, text).unionByName(usage.symbol_uses(symbol("xequests"), m, text, 85))
    return found.select("name", "kind", "path", "method", "lineno", "usage_type")


@expects("path, name, line", ("orders.py", "tax", 7), ("orders.py", "zzz", 21))
def reported_lines(spark, sf_dir):
    """The first line with the name, or the last return."""
    return usage.reported_lines(spark.createDataFrame([("orders.py", "tax"), ("orders.py", "zzz")], "path string, name string"), files.lines(samples.python_files(spark)))


def _edge_uses(spark: SparkSession) -> DataFrame:
    rows = [("p", "f", "q", "g", "global", "s1", 1), ("p", "f", "q", "g", "local", "s2", 9), ("p", "f", "q", "h", "local", "s3", 1)]
    return spark.createDataFrame(rows, "def_path string, def_name string, use_path string, use_method string, usage_type string, snippet string, ord int")


@expects("src, dst, usage_type, snippet", ("p::f", "q::g", "global_uses", "s1"), ("p::f", "q::g", "local_uses", "s2"), ("p::f", "q::h", "local_uses", "s3"))
def parallel_edges(spark, sf_dir):
    """Edges that differ in type or snippet."""
    return graph.multi_edges(_edge_uses(spark)).select("src", "dst", "usage_type", "snippet")


@expects("src, dst, usage_type", ("p::f", "q::g", "global"))
def attached_edges(spark, sf_dir):
    """A global use outranks a local one, and both ends must be there."""
    nodes = spark.createDataFrame([("p::f",), ("q::g",)], "id string")
    return graph.attached_edges(graph.build_edges(_edge_uses(spark)), nodes).select("src", "dst", "usage_type")


@expects("method_nm, target, source_node, target_node", ("f", "g", "1", "3"))
def visual_links(spark, sf_dir):
    """J13."""
    links = spark.createDataFrame([("f", "g"), ("f", "none")], "method_nm string, target string")
    return graph.visual_links(links, spark.createDataFrame([("f", "2"), ("f", "1"), ("g", "3")], "method_nm string, node_id string"))


# ---- impact ------------------------------------------------------------------------------------------------------------


@expects("k, begin, last_line", (1, 11, 22), (2, 10, 40), (3, 35, 40))
def review_ranges(spark, sf_dir):
    """A window of lines, a short window, and a change without one that lies far from the method's start."""
    rows = [(1, 10, 10, 40, 2, 12), (2, 10, 10, 40, 2, 4), (3, 35, 10, 40, None, None)]
    found = impact.review_ranges(spark.createDataFrame(rows, "k int, new_start int, method_begin int, method_end int, first int, last int"))
    return found.select("k", "begin", F.col("end").alias("last_line"))


@expects("change_id, first, last", (1, 1, 9), (2, 3, 7), (3, -1, -1))
def influence_spans(spark, sf_dir):
    """From the first assignment of a changed name to the last read of what it flows into."""
    facts = [("p", "f", 1, ["a"], ["x"]), ("p", "f", 3, ["b"], ["a"]), ("p", "f", 7, ["c"], ["b"]), ("p", "f", 9, ["d"], ["a"])]
    spans = impact.target_spans(spark.createDataFrame(facts, "path string, method string, lineno int, targets array<string>, values array<string>"))
    changes = [(1, "p", "f", ["a"]), (2, "p", "f", ["b"]), (3, "p", "f", ["zz"])]
    return impact.sphere_of_influence(spark.createDataFrame(changes, "change_id int, path string, method string, targets array<string>"), spans).select("change_id", "first", "last").fillna(-1)


def _wanted(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    m = spark.createDataFrame([("x/a.py", "f", 3, 9), ("b/a.py", "f", 1, 2)], "path string, name string, start_line int, end_line int")
    return spark.createDataFrame([("a.py", "f", "needle"), ("a.py", "g", "needle")], "basename string, method string, needle string"), m


@expects("method, path, start_line, end_line", ("f", "b/a.py", 1, 2), ("g", None, -1, -1))
def found_ranges(spark, sf_dir):
    """J16."""
    return impact.find_ranges(*_wanted(spark)).select("method", "path", "start_line", "end_line").fillna(-1)


@expects("method, path, lineno", ("f", "x/a.py", 4), ("g", None, -1))
def entry_points(spark, sf_dir):
    """The first line inside the method that contains the needle."""
    source = spark.createDataFrame([("x/a.py", 4, "a needle"), ("x/a.py", 6, "needle"), ("b/a.py", 5, "needle")], "path string, lineno int, text string")
    return impact.entry_points(*_wanted(spark), source).select("method", "path", "lineno").fillna(-1)


@expects("file, impacted_files, last_method, last_end_point", ("f", "g1,g2", "m2", "/e2"))
def change_report(spark, sf_dir):
    """Only files with a global use are reported."""
    uses = [("f", "global", "g1", "m1", "/e1", 1), ("f", "global", "g2", "m2", "/e2", 2), ("h", "local", "g3", "m3", "/e3", 3)]
    summary = spark.createDataFrame(uses, "file string, usage_type string, impacted_file string, impacted_method string, api_end_point string, ord int")
    return impact.change_report(spark.createDataFrame([("f",), ("h",)], "file string"), summary).select("file", joined("impacted_files"), "last_method", "last_end_point")


@expects("k, impacts", (1, "a b"), (2, None))
def impacts_per_change(spark, sf_dir):
    """A9."""
    found = impact.impacts_per_change(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "b"), (1, "a")], "k int, x string"), ["k"])
    return found.select("k", F.array_join(F.transform("impacts", lambda i: i["x"]), " ").alias("impacts"))


@expects("key, results", ("k", "a,b"))
def plan_results(spark, sf_dir):
    """A13."""
    return impact.plan_results(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, ord int, result string")).select("key", joined("results"))


@expects("node_id, ln_no, criticality", ("f::m", 1, 2))
def visual_nodes(spark, sf_dir):
    """changes without a context are no nodes."""
    rows = [("f", "m", ["o"], ["n"], 1, "ctx", 2, "t"), ("f", "k", ["o"], ["n"], 1, None, None, None)]
    changes = spark.createDataFrame(rows, "file string, method string, old_code array<string>, new_code array<string>, new_start int, method_context string, criticality int, impact_analysis string")
    return impact.viz_nodes(changes).select("node_id", "ln_no", "criticality")


@expects("prompt, criticality", ("Method:\nctx\n\nBefore the change:\no\n\nAfter the change:\nn\n", 0))
def scored_changes(spark, sf_dir):
    """X11, S25, ST6: the prompt, and the score of the stand-in for a model."""
    one = spark.createDataFrame([("ctx", ["n\n"], ["o\n"])], "method_context string, new_code array<string>, old_code array<string>")
    scored = impact.score(one, impact.changed_name_scorer)
    return scored.select(impact_prompt(F.col("method_context"), F.col("new_code"), F.col("old_code")).alias("prompt"), "criticality")


@expects("path, chunk, first_line, last_line, n_tokens", ("d/s", 0, 1, 1, 16), ("d/s", 1, 2, 2, 16))
def plan_chunks(spark, sf_dir):
    """Twelve words are 16.8 tokens, so that two rows do not fit into 20; values of few words go."""
    words = " ".join(["word"] * 12)
    rows = spark.createDataFrame([("d", "s", 1, ["short", words]), ("d", "s", 2, [words]), ("d", "t", 1, ["no"])], "doc string, section string, line_num int, row_values array<string>")
    return chunks.pack_plan(chunks.plan_texts(rows), limit=20)


# ---- increments and scalars ----------------------------------------------------------------------------------------------


@expects("run_id", (3,))
def newest_run(spark, sf_dir):
    """O5, ST4, S23."""
    runs = spark.createDataFrame([(1, "success", 1), (2, "failed", 4), (3, "success", 3)], "run_id int, status string, created int")
    return incremental.new_runs(runs, 1).select("run_id")


@expects("path, mtime", ("a", 1), ("b", 2), ("c", 1))
def delta_scan(spark, sf_dir):
    """ST3: what changed is scanned again, what is new is added."""
    schema = "path string, mtime int"
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], schema), spark.createDataFrame([("b", 2), ("c", 1), ("a", 1)], schema)
    return incremental.delta_scan(new, old, old, lambda f: f)[0]


@expects("ends, bare, at_time, id_length, listed, none, second, beyond", (True, "`x", "1970-01-01 00:00:00", 36, "a", 0, "cd", "NA"))
def small_scalars(spark, sf_dir):
    """X3, X4, X17, X20, X21, H8."""
    one = spark.createDataFrame([("a.py", "[`'x',]", "a", "ab\n cd")], "path string, name string, v string, t string")
    return one.select(
        ends_with_any("path", [".js", ".py"]).alias("ends"), strip_punctuation("name").alias("bare"), local_time(F.lit(0)).alias("at_time"), F.length(run_id()).alias("id_length"),
        F.array_join(as_array("v"), ",").alias("listed"), F.size(as_array(F.lit(None).cast("string"))).alias("none"), nth_line("t", 2).alias("second"), nth_line("t", 9).alias("beyond"),
    )


@expects("id, city, first_tag, double_age", (1, "x", "t", 6), (2, None, None, 8))
def projected_fields(spark, sf_dir):
    """A field renamed, one of a nested object, the first of a list, a computed one."""
    rows = [(1, ("x",), ["t", "u"], 3), (2, None, [], 4)]
    return relational.projected(spark.createDataFrame(rows, "k int, place struct<city:string>, tags array<string>, age int"), {"id": "k", "city": "place.city", "first_tag": "tags.0", "double_age": F.col("age") * 2})
