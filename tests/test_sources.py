"""Table functions over sources, and readers and writers of files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import python_source, script_source, urls
from ripplegraph.plans import samples
from ripplegraph.sources import files as sources
from ripplegraph.sources import sinks

SRC = '''import requests

@app.route("/a", methods=["GET", "POST"])
@cache.memo("x")
def outer(x):
    a, (b, c) = x, f(x)
    def inner(y):
        return y
    for k in a:
        if b and c:
            z = g(k)
    return z

async def late():
    h(1)
'''


def test_methods():
    assert python_source.methods(SRC) == [("outer", 5, 6, "/a"), ("inner", 7, 8, None), ("late", 14, 15, None)]
    assert python_source.methods(SRC, compat=True)[0] == ("outer", 5, 6, "x")
    assert [m[0] for m in python_source.methods(SRC, compat=True)] == ["outer", "inner"]
    assert python_source.methods("def f(:") == python_source.methods(None) == []
    assert python_source.methods("    def f():\n        pass") == [("f", 1, 2, None)]


def test_line_facts():
    facts = {r[0]: r[1:] for r in python_source.line_facts(SRC)}
    assert facts[6] == ("Assign", ["a", "b", "c"], 6, ["x", "f"], None)
    assert facts[9] == ("For", ["k"], 11, ["a"], None) and facts[10] == ("If", [], 11, ["b", "c"], None)
    assert facts[11] == ("Assign", ["z"], 11, ["g", "k"], "g") and 15 not in facts
    assert {r[0]: r for r in python_source.line_facts(SRC, compat=False)}[15][5] == "h"


def test_other_python_rows():
    assert python_source.routes(SRC) == [("outer", 5, 12, "/a", ["GET", "POST"])]
    assert python_source.definitions("class A:\n    def f(self):\n        pass\n") == [("class", "A", 1, 3), ("function", "f", 2, 3)]
    url = 'B = "http://h"\nU = B + "/p"\ndef f():\n    r = requests.get(U)\n    q = requests.post(url=B)\n    Request(U)\n    json.dumps(q)\n'
    assert python_source.url_assignments(url) == [("B", 1, "http://h", None), ("U", 2, "http://h/p", None)]
    assert [(r[0], r[1], r[3], r[5]) for r in python_source.http_calls(url)] == [("U", 4, 3, "get"), ("B", 5, 3, "post"), ("U", 6, 3, "Request")]
    assert python_source.indirect_urls('def f():\n    u = host + "/a/b/c"\nv = host + "/a/b/c"\n') == [("u", 2, "/a/b/c", "f")]
    assert ("U", 4, "argument", "f") in python_source.variable_usages(url) and ("B", 2, "concat", None) in python_source.variable_usages(url)
    assert ("f", 3, 7, "U", 4, 21) in python_source.name_loads(url)
    assert python_source.route_in_sum('def f():\n    u = host + "/a"\n') == [(2, "/a", "f")]
    assert python_source.parse_error("def f(:")[0][1] == 1 and python_source.parse_error("x = 1") == []


def test_script_rows():
    rows = {r[0]: r for r in script_source.methods(samples.SHOP)}
    assert rows["list"][1:3] == (1, 4) and rows["list"][3] == ["req", "res"] and rows["list"][4] == "fetch(url)"
    assert rows["pay"][1:] == (5, 8, ["order", "total"], "total | 0") and "if" not in rows
    assert script_source.methods("x = { go: async (a, b) => { } }") == [("go", None, None, ["a", "b"], "void")]
    assert script_source.methods("function a() { return '}' } // }\nfunction b() {}") == [("a", 1, 1, [], "'}'"), ("b", 2, 2, [], "void")]
    assert set(script_source.route_map(samples.SHOP)) == {("list", "/shop/list"), ("pay", "/shop/pay"), ("list", "/shop/all")}
    assert ("handler", "pay", 5) in script_source.handler_definitions(samples.SHOP)
    assert script_source.near_route_handlers("route: '/a',\n\nhandler: 'h'") == [("/a", "h", 1)]
    assert script_source.static_tail("/a/${x}") == "a" and script_source.static_tail("/${x}/${y}") is None
    assert script_source.methods(None) == []


def test_table_functions_in_spark(spark):
    files = samples.python_files(spark)
    for name in python_source.TABLE_FUNCTIONS:
        assert python_source.extract(files, name).columns[0] == "path"
    assert python_source.extract(files, "py_methods").where("path = 'orders.py'").count() == 3
    assert [r.path for r in python_source.extract(files, "py_parse_error").collect()] == ["broken.py"]
    assert script_source.extract(samples.script_files(spark), "js_methods").count() == 2
    rows = script_source.grep_rows(spark.createDataFrame([("a.js:3:function go() {",), ("b.js:4: go()",), ("junk",)], "value string"))
    assert rows.count() == 2 and [r.path for r in script_source.definitions_in(rows, "go").collect()] == ["a.js"]
    found = spark.createDataFrame([("https://registry.npmjs.org/x",), ("http://h/x",), (None,)], "url string")
    assert script_source.without_registry(found).count() == 2


def test_urls(spark):
    text = 'a = "http://h.example.org/x", {"MY_URL": "https://k.example.org/y"} os.environ["SOME_HOST"] (http://z.example.org/q).'
    rows = {(r.kind, r["var"], r.url) for r in urls.scan_urls(spark.createDataFrame([("p", text)], "path string, content string")).collect()}
    assert ("literal", None, "http://h.example.org/x") in rows and ("literal", None, "http://z.example.org/q") in rows
    assert ("config", "MY_URL", "https://k.example.org/y") in rows and ("env", "SOME_HOST", None) in rows
    got = {(r.path, r.key, r.url) for r in urls.config_urls(samples.code_base(spark)).collect()}
    assert ("config.json", "LAST", "http://b.example.org/y") in got and ("config.json", "list", "https://a.example.org/x") in got and ("config.yml", "others", "https://c.example.org/z") in got and len(got) == 5
    bad = spark.createDataFrame([("x.json", "{"), ("x.yml", "a: [")], "path string, content string")
    assert urls.config_urls(bad).count() == 0
    leaves = {(r.key, r.value) for r in urls.variant_leaves(spark.createDataFrame([(samples.CONFIG,)], "j string"), "j", 5).collect()}
    assert ("ITEMS_URL", "http://stock.example.org/v1/items") in leaves and ("LAST", "http://b.example.org/y") in leaves
    script = urls.script_urls(samples.script_files(spark)).collect()
    assert (2, "http://orders.example.org/v1/orders") in {(r.lineno, r.url) for r in script}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("one\ntwo\n")
    (tmp_path / "y.js").write_text("let a")
    (tmp_path / "n.txt").write_text("no")
    all_files = sources.scan_files(spark, str(tmp_path))
    assert {(r.lang, r.path.rsplit("/", 1)[1]) for r in all_files.collect()} == {("python", "x.py"), ("javascript", "y.js"), ("other", "n.txt")}
    py = sources.scan_files(spark, str(tmp_path), [".py"], "svc")
    assert [(r.service, r.content) for r in py.collect()] == [("svc", "one\ntwo\n")]
    assert sources.scan_files(spark, str(tmp_path), [".py", ".js"]).count() == 2
    assert [r.lineno for r in sources.lines(py).orderBy("lineno").collect()] == [1, 2, 3]
    wanted = py.select("path", F.lit(1).alias("first"), F.lit(2).alias("last"))
    assert sources.snippets(wanted, sources.lines(py)).first().snippet == ["one", "two"]
    named = sources.find_by_basename(all_files, spark.createDataFrame([("x.py",), ("none",)], "name string"))
    assert {r.name: r.path is None for r in named.collect()} == {"x.py": False, "none": True}
    words = sources.search_words(sources.lines(all_files), spark.createDataFrame([("two",), ("a",)], "name string"), exclude_dir="/a/")
    assert [r.name for r in words.collect()] == ["a"]
    manifest = spark.createDataFrame([("/r/one/.git/config",), ("/r/two/x",)], "path string")
    assert [r.repository for r in sources.git_repositories(manifest).collect()] == ["/r/one"]
    (tmp_path / "d.diff").write_text(samples.DIFF)
    assert sources.diff_lines(spark, str(tmp_path / "d.diff")).count() == len(samples.DIFF.split("\n"))


def test_summaries(spark, tmp_path):
    doc = '{"%s": {"method_details_": [{"method_name": "%s", "api_end_points": ["/x"], "range_start": 1, "range_end": 2}]}}'
    (tmp_path / "a.json").write_text(doc % ("p.py", "old"))
    (tmp_path / "b.json").write_text(doc % ("p.py", "new"))
    rows = sources.read_summaries(spark, str(tmp_path))
    assert rows.count() == 2
    m = sources.methods_of(sources.merged_summaries(rows)).collect()
    assert [(r.path, r.method_name, r.api_end_points) for r in m] == [("p.py", "new", ["/x"])]
    sinks.write_summaries(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_plans(spark):
    body = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Row one</w:t></w:r></w:p>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>{body}</w:body></w:document>")
    df = spark.createDataFrame([("p.docx", bytearray(data.getvalue())), ("bad.docx", bytearray(b"x"))], "path string, bytes binary")
    assert [(r.section, r.text) for r in sources.read_plan_documents(df).collect()] == [("Head", "Row one")]
    kinds = df.select("path", sources.plan_kind().alias("k"))
    assert {r.k for r in kinds.collect()} == {"DOC"}


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a::f", "f")], "id string, name string")
    edges = spark.createDataFrame([("a::f", "b::g", "global")], "src string, dst string, usage_type string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = sinks.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 1 and e.where("usage_type = 'global'").count() == 1
    for run in ("r1", "r2"):
        sinks.write_visualization(nodes, edges, str(tmp_path / "v"), run)
    assert sinks.read_visualization(spark, str(tmp_path / "v"), "r1")[0].count() == 1
    sinks.write_impact_reports(spark.createDataFrame([("a/x.py", "b/y.py/g", 3), ("a/x.py", "c", None)], "file string, impacted_method string, criticality int"), str(tmp_path / "i"))
    assert {r.criticality for r in spark.read.option("inferSchema", False).json(str(tmp_path / "i")).select(F.col("criticality").cast("string")).collect()} == {"3", "NA"}
    mails = sinks.notifications(spark.createDataFrame([("x@h, y@h", "f.py", "g"), ("x@h", "f.py", "h")], "owner string, file string, impacted string"))
    assert {(r.recipient, r.body) for r in mails.collect()} == {("x@h", "g\nh"), ("y@h", "g")}


def test_imports_need_no_session():
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=sources.__file__.rsplit("/ripplegraph/", 1)[0]).returncode == 0


@pytest.mark.parametrize("name", sorted(python_source.TABLE_FUNCTIONS))
def test_empty_sources(spark, name):
    rows = spark.createDataFrame([("a", None), ("b", "")], "path string, content string")
    assert python_source.extract(rows, name).count() == 0


def test_workbooks_are_read_without_a_reader(spark):
    import io
    import zipfile

    from ripplegraph.sources import files

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Plan" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>step</t></si><si><r><t>two </t></r><r><t>parts</t></r></si></sst>')
        cells = '<row r="1"><c t="s"><v>0</v></c><c><v>7</v></c></row><row r="3"><c t="s"><v>1</v></c><c/><c t="inlineStr"><is><t>own</t></is></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    df = spark.createDataFrame([("a.xlsx", bytearray(out.getvalue()))], "path string, bytes binary")
    assert [tuple(r) for r in files.read_plan_tables(df).collect()] == [("a.xlsx", "Plan", 1, "step\t7"), ("a.xlsx", "Plan", 3, "two parts\town")]
