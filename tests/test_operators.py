"""Operators on rows worked out by hand, or against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import scalars
from ripplegraph.operators import api, chunks, components, diff, graph, impact, relational, usage
from ripplegraph.plans import catalog, samples
from ripplegraph.streaming import incremental


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_hunks(spark):
    got = {(r.file, r.old_start): r for r in diff.parse_hunks(samples.diff(spark)).collect()}
    assert set(got) == {("orders.py", 7), ("orders.py", 20), ("stock.py", 5)}
    first = got["orders.py", 7]
    assert (first.old_length, first.new_start, first.new_length) == (3, 7, 4)
    assert first.old_code == ["    rate = amount * 2\n"] and first.new_code == ["    rate = amount * 3\n", "    rate += 1\n"]
    assert got["orders.py", 20].old_length == 1 and got["orders.py", 20].new_code == ["    due = tax(order) --1\n"]
    assert got["stock.py", 5].old_code == ["        base = item * 3\n"]
    narrow = {(r.file, r.old_start) for r in diff.parse_hunks(samples.diff(spark), compat=True).collect()}
    assert narrow == {("orders.py", 7), ("stock.py", 5)}
    assert diff.parse_hunks(samples.diff(spark).limit(0)).count() == 0


def test_attribution_is_the_last_match(spark):
    rng = random.Random(1)
    methods = [(f"f{rng.randint(0, 3)}.py", f"m{k}", a := rng.randint(1, 60), a + rng.randint(0, 20)) for k in range(40)] + [("f0.py", "none", None, None)]
    hunks = [(f"f{rng.randint(0, 3)}.py", rng.randint(1, 80), rng.randint(1, 80)) for _ in range(60)]
    m = spark.createDataFrame(methods, "path string, name string, start_line int, end_line int")
    h = spark.createDataFrame(hunks, "file string, old_start int, new_start int")

    def around(path, line):
        hit = [(s, e, n) for p, n, s, e in methods if p == path and s is not None and s <= line <= e]
        return max(hit)[2] if hit else None

    got = rows(diff.attribute_hunks(h, m), "file", "old_start", "new_start", "old_method", "new_method")
    assert [r[:3] for r in got] == sorted(hunks, key=repr)
    best = {(p, line): max((s, e) for q, _, s, e in methods if q == p and s is not None and s <= line <= e) for p, a, b in hunks for line in (a, b) if around(p, line)}
    span = {n: (s, e) for _, n, s, e in methods}
    for p, a, b, x, y in got:
        assert (x is None) == (around(p, a) is None) and (x is None or span[x] == best[p, a])
        assert (y is None) == (around(p, b) is None) and (y is None or span[y] == best[p, b])


def test_changed_file_match(spark):
    f = spark.createDataFrame([("a.py",), ("z.py",)], "file string")
    k = spark.createDataFrame([("src/a.py",), ("old/a.py",)], "key string")
    assert rows(diff.changed_file_match(f, k), "file", "key") == [("a.py", "old/a.py"), ("z.py", "NA")]


def test_uses(spark):
    m = spark.createDataFrame([("a.py", "f", 1, 5), ("a.py", "g", 6, 12), ("b.py", "h", 1, 9)], "path string, name string, start_line int, end_line int")
    facts = spark.createDataFrame([("a.py", 8, "f"), ("b.py", 3, "f"), ("b.py", 20, "f"), ("b.py", 4, "x")], "path string, lineno int, function string")
    assert rows(usage.local_uses(m, facts), "def_name", "use_path", "use_line", "use_method") == [("f", "a.py", 8, "g")]
    assert rows(usage.global_uses(m, facts), "def_name", "use_path", "use_line", "use_method") == [("f", "b.py", 20, None), ("f", "b.py", 3, "h")]
    lines = spark.createDataFrame([("b.py", k, f" line {k} ") for k in range(1, 25)], "path string, lineno int, text string")
    uses = usage.grouped_uses(usage.global_uses(m, facts), lines).first().uses
    assert {(u.method_nm, tuple(u.usage), u.method_defn) for u in uses} == {("NA", ("line 20",), None), ("h", ("line 3",), "line 1")}
    edge = spark.createDataFrame([("a.py", 1), ("a.py", 5)], "path string, lineno int")
    assert rows(usage.enclosing_methods(edge, m), "lineno", "method") == [(1, None), (5, None)]
    assert rows(usage.enclosing_methods(edge, m, strict=False), "lineno", "method") == [(1, "f"), (5, "f")]


def test_words_and_symbols(spark):
    names = spark.createDataFrame([("a.js", "go", 2)], "path string, name string, arity int")
    lines = spark.createDataFrame([("b.js", 1, "go(1)"), ("b.js", 2, "go()"), ("b.js", 3, "cargo(1, 2)"), ("a.js", 4, "go(1, 2)")], "path string, lineno int, text string")
    assert rows(usage.word_uses(names, lines), "use_path", "lineno") == [("b.js", 1)]
    m = spark.createDataFrame([("b.js", "user", 1, 9)], "path string, name string, start_line int, end_line int")
    s = spark.createDataFrame([("a.js", "method", "cargo"), ("b.js", "method", "go")], "path string, kind string, name string")
    assert rows(usage.symbol_uses(s, m, lines), "name", "lineno", "usage_type") == [("cargo", 3, "global"), ("go", 1, "local"), ("go", 2, "local")]
    near = spark.createDataFrame([("a.js", "method", "cargos")], "path string, kind string, name string")
    assert rows(usage.symbol_uses(near, m, lines, 90), "name", "lineno") == [("cargos", 3)]
    starts = spark.createDataFrame([("p", "a", 1), ("p", "b", 5), ("p", "c", 5)], "path string, name string, start_line int")
    assert rows(usage.method_ends(starts, spark.createDataFrame([("p", 9)], "path string, n_lines int")), "name", "end_line") == [("a", 4), ("b", 9)]
    src = spark.createDataFrame([("p", 1, "x = 1"), ("p", 2, "return y")], "path string, lineno int, text string")
    wanted = spark.createDataFrame([("p", "x"), ("p", "q")], "path string, name string")
    assert rows(usage.reported_lines(wanted, src), "name", "line") == [("q", 2), ("x", 1)]


def plain_match(call, definition):
    shorter, longer = (call, definition) if len(call) < len(definition) else (definition, call)
    s = shorter.split("/")
    primary = len(s) >= 2 and s[-1] != "" and "/".join(s[-2:]) in longer
    return primary, call.split("/")[-1] == definition.split("/")[-1] != ""


def test_url_match(spark):
    rng = random.Random(2)
    url = lambda: "/".join(rng.choice(["", "a", "b", "ab", "v1"]) for _ in range(rng.randint(1, 4)))
    pairs = [(url(), url()) for _ in range(300)]
    df = spark.createDataFrame(pairs, "c string, d string").select("c", "d", scalars.url_match("c", "d").alias("m"))
    for r in df.collect():
        assert (r.m.primary, r.m.secondary) == plain_match(r.c, r.d)


@pytest.mark.parametrize("compat", [False, True])
def test_match_urls(spark, compat):
    rng = random.Random(3)
    url = lambda: "/".join(rng.choice(["a", "b", "ab", "v1", "x", ""]) for _ in range(rng.randint(1, 4)))
    d, c = ([(k, rng.choice("ST"), url()) for k in range(40)] for _ in range(2))
    got = rows(api.match_urls(spark.createDataFrame(d, "def_id int, def_base string, def_url string"), spark.createDataFrame(c, "call_id int, call_base string, call_url string"), compat), "def_id", "call_id", "primary")

    def primary(call, definition):
        p = plain_match(call, definition)[0]
        if p and not compat:
            shorter, longer = (call, definition) if len(call) < len(definition) else (definition, call)
            s, w = shorter.split("/"), longer.split("/")
            p = any(w[k : k + 2] == s[-2:] for k in range(len(w) - 1))
        return p

    loose = lambda call, definition: primary(call, definition) or plain_match(call, definition)[1]
    want = {(i, j) for i, a, u in d for j, b, v in c if a != b and loose(v, u)}
    assert {g[:2] for g in got} == want
    sure = {(i, j) for i, _, u in d for j, _, v in c if primary(v, u)}
    assert {g[:2] for g in got if g[2]} >= sure & want


def test_api(spark):
    d = spark.createDataFrame([("S", "a.py", "f", ["/v1/x"])], "base string, path string, method string, urls array<string>")
    c = spark.createDataFrame([("T", "c.py", "g", ["http://h/v1/x", "q/x"]), ("T", "k.py", "g", ["http://h/v1/x"]), ("S", "c.py", "z", ["/v1/x"])], "base string, path string, method string, urls array<string>")
    assert rows(api.inter_service_uses(d, c), "use_path", "use_method", "certain") == [("c.py", "g", True), ("k.py", "g", True)]
    assert rows(api.inter_service_uses(d, c, spark.createDataFrame([("k.py",)], "file string")), "use_path") == [("k.py",)]
    a = spark.createDataFrame([("p", "u", 1, "one"), ("p", "u", 5, "two"), ("q", "u", 1, "other")], "path string, var string, line int, url string")
    calls = spark.createDataFrame([("p", "u", 3), ("p", "u", 9), ("p", "u", 1)], "path string, var string, line int")
    assert rows(api.url_usages(a, calls), "call_line", "url") == [(3, "one"), (9, "two")]
    idx = api.url_index(spark.createDataFrame([("u1", None, "p", 1, "f", False), ("u1", None, "q", 1, None, True), ("u2", None, "p", 2, "f", False), ("u3", None, "p", 7, None, False)], "url string, var string, path string, line int, method string, is_definition boolean"))
    m = spark.createDataFrame([("p", "f"), ("p", "g")], "path string, name string")
    assert rows(api.classified_calls(idx, m), "name", "local_api_call", "inter_service_api_call") == [("f", ["u1"], ["u2"]), ("g", [], [])]
    assert rows(api.file_level_calls(idx), "path", "urls") == [("p", ["u3"]), ("q", ["u1"])]
    routes = spark.createDataFrame([("d.py", "/v1/items")], "def_path string, route_path string")
    urls = spark.createDataFrame([("c.py", "U", "http://h/v1/items")], "path string, var string, url string")
    assert rows(api.contract_uses(routes, urls, spark.createDataFrame([("c.py", "U", 4)], "path string, var string, line int")), "path", "line") == [("c.py", 4)]
    assert rows(api.contract_lines(routes, spark.createDataFrame([("c.py", 3, "x = h + '/items'")], "path string, line int, text string")), "line") == [(3,)]
    both = api.merged_api(spark.createDataFrame([("p", "f", ["a"]), ("p", "g", [])], "path string, name string, global_uses array<string>"), spark.createDataFrame([("p", "f", ["b", "a"])], "path string, name string, global_uses array<string>"))
    assert rows(both, "name", "global_uses") == [("f", ["a", "b"]), ("g", [])]
    e = api.classified_endpoints(spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "call_id int, path string"), spark.createDataFrame([("/a", "h")], "path string, handler string"), spark.createDataFrame([("T", "/b", "t"), ("S", "/b", "s"), ("S", "/a", "s")], "base string, path string, handler string"))
    assert rows(e, "call_id", "kind", "base", "handler") == [(1, "intra", None, "h"), (2, "inter", "S", "s"), (3, "not_found", None, None)]
    assert api.unmatched_endpoints(spark.createDataFrame([("/z",), ("/a",)], "path string"), spark.createDataFrame([("/a",)], "path string")).count() == 1
    routed = api.routed_methods(spark.createDataFrame([("s.js", "h"), ("s.js", "k")], "path string, name string"), spark.createDataFrame([("h", "/b"), ("h", "/a")], "handler string, url string"))
    assert rows(routed, "name", "api_end_points") == [("h", ["/a", "/b"]), ("k", [])]


def test_graph_build(spark):
    m = spark.createDataFrame([("p", "f", 1, 9), ("p", "f", 2, 8)], "path string, name string, ord int, method_end int")
    assert rows(graph.build_nodes(m), "id", "method_end") == [("p::f", 9)]
    u = spark.createDataFrame([("p", "f", "q", "g", "global", "s1", 1), ("p", "f", "q", "g", "local", "s2", 9), ("p", "f", "q", "h", "local", "s3", 1)], "def_path string, def_name string, use_path string, use_method string, usage_type string, snippet string, ord int")
    e = graph.build_edges(u)
    assert rows(e, "dst", "usage_type", "snippet") == [("q::g", "global", "s1"), ("q::h", "local", "s3")]
    assert graph.multi_edges(u).count() == 3 and rows(graph.with_targets(e, graph.build_nodes(m)), "dst_defined") == [(False,), (False,)]
    assert graph.attached_edges(e, graph.build_nodes(m)).count() == 0
    assert rows(graph.counts(m, e), "n_nodes", "n_edges") == [(2, 2)] and graph.duplicate_nodes(m).count() == 1
    nodes = spark.createDataFrame([("p::f", "svc/p", "f"), ("q::g", "q", "g"), ("q::h", "q", "h")], "id string, path string, name string")
    changes = spark.createDataFrame([("p", "f"), ("zz", "f")], "file string, method string")
    assert rows(graph.one_hop(changes, e, nodes, "global"), "file", "impacted_method", "snippet") == [("p", "g", "s1")]
    links = spark.createDataFrame([("f", "g"), ("f", "none")], "method_nm string, target string")
    viz = spark.createDataFrame([("f", "2"), ("f", "1"), ("g", "3")], "method_nm string, node_id string")
    assert rows(graph.visual_links(links, viz), "source_node", "target_node") == [("1", "3")]
    assert graph.sample_rows(nodes, ["id"], 2).count() == 2


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def test_reachable_and_paths(spark):
    edges = random_edges(20, 28, 4)
    e, s = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,), (5,)], "source int")
    want = {}
    for start in (0, 5):
        level, hops = {d for a, d in edges if a == start}, 1
        while level:
            for x in level:
                want[start, x] = hops
            level, hops = {d for a, d in edges if a in level} - {x for t, x in want if t == start}, hops + 1
    assert {(r.source, r.node): r.hops for r in graph.reachable(e, s).collect()} == want
    assert {(r.source, r.node) for r in graph.reachable(e, s, 2).collect()} == {k for k, h in want.items() if h <= 2}
    found = graph.paths(e, s, 3)

    def walk(path, used):
        yield path
        if len(path) <= 3:
            for a, d in edges:
                if a == path[-1] and (a, d) not in used:
                    yield from walk([*path, d], used | {(a, d)})

    assert sorted(r.path for r in found.collect()) == sorted(p for t in (0, 5) for p in walk([t], frozenset()))
    assert {(r.a, r.b) for r in graph.path_pairs(found).collect()} <= set(edges)


def test_pagerank(spark):
    edges = random_edges(15, 40, 5)
    rank = {x: 0.15 for e in edges for x in e}
    out = {a: sum(b == a for b, _ in edges) for a, _ in edges}
    for _ in range(8):
        rank = {x: 0.15 + 0.85 * sum(rank[a] / out[a] for a, d in edges if d == x) for x in rank}
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src int, dst int"), 8).collect()}
    assert set(got) == set(rank) and all(abs(got[k] - rank[k]) < 1e-9 for k in rank)
    top = graph.top_ranked(graph.pagerank(spark.createDataFrame(edges, "src int, dst int"), 8), 3).collect()
    assert [r.node for r in top] == [x for x, _ in sorted(rank.items(), key=lambda p: (-round(p[1], 6), p[0]))[:3]]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges + [(None, 3)], "src int, dst int")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_windows(spark):
    facts = spark.createDataFrame([("p", "f", 1, ["a"], ["x"]), ("p", "f", 3, ["b"], ["a"]), ("p", "f", 7, ["c"], ["b"]), ("p", "f", 9, ["d"], ["a"])], "path string, method string, lineno int, targets array<string>, values array<string>")
    spans = impact.target_spans(facts)
    assert rows(spans, "target", "first", "last", "next_target") == [("a", 1, 9, "d"), ("b", 3, 7, "c"), ("c", 7, None, None), ("d", 9, None, None)]
    changes = spark.createDataFrame([(1, "p", "f", ["a"]), (2, "p", "f", ["b"]), (3, "p", "f", ["zz"]), (4, "q", "f", ["a"])], "change_id int, path string, method string, targets array<string>")
    assert rows(impact.sphere_of_influence(changes, spans), "change_id", "first", "last") == [(1, 1, 9), (2, 3, 7), (3, None, None), (4, None, None)]
    r = impact.review_ranges(spark.createDataFrame([(1, 10, 10, 40, 2, 12), (2, 10, 10, 40, 2, 4), (3, 35, 10, 40, None, None)], "k int, new_start int, method_begin int, method_end int, first int, last int"))
    assert rows(r, "k", "begin", "end") == [(1, 11, 22), (2, 10, 40), (3, 35, 40)]
    w = impact.line_windows(spark.createDataFrame([("p", 5), ("p", 90)], "path string, lineno int"), spark.createDataFrame([("p", 100)], "path string, n_lines int"))
    assert rows(w, "first", "last") == [(1, 25), (70, 100)]


def test_impacts(spark):
    m = spark.createDataFrame([("x/a.py", "f", 3, 9), ("b/a.py", "f", 1, 2)], "path string, name string, start_line int, end_line int")
    wanted = spark.createDataFrame([("a.py", "f", "needle"), ("a.py", "g", "needle")], "basename string, method string, needle string")
    assert rows(impact.find_ranges(wanted, m), "method", "path", "start_line") == [("f", "b/a.py", 1), ("g", None, None)]
    src = spark.createDataFrame([("x/a.py", 4, "a needle"), ("x/a.py", 6, "needle"), ("b/a.py", 5, "needle")], "path string, lineno int, text string")
    assert rows(impact.entry_points(wanted, m, src), "method", "path", "lineno") == [("f", "x/a.py", 4), ("g", None, None)]
    rec = spark.createDataFrame([("ctx", ["n\n"], ["o\n"])], "method_context string, new_code array<string>, old_code array<string>")
    assert impact.score(rec).first().criticality is None
    scored = impact.score(rec, impact.changed_name_scorer)
    assert scored.first().criticality == 0 and impact.serious(scored).count() == 0
    g, loc = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, x string")
    assert rows(impact.downstream(g, loc, ["k"]), "k", "x", "impact_type") == [(1, "a", "global"), (2, "c", "local")]
    assert [x.x for x in impact.impacts_per_change(g.select("k"), loc, ["k"]).first().impacts] == ["b"]
    owners = spark.createDataFrame([("svc", "a"), ("lib", "b")], "repo string, owner string")
    files = spark.createDataFrame([("svc/lib/x",), ("zzz",)], "impacted_file string")
    assert rows(impact.route_owners(files, owners, "d"), "impacted_file", "owner") == [("svc/lib/x", "b"), ("zzz", "d")]
    ch = spark.createDataFrame([("f", "m", ["o"], ["n"], 1, "ctx", 2, "t"), ("f", "k", ["o"], ["n"], 1, None, None, None)], "file string, method string, old_code array<string>, new_code array<string>, new_start int, method_context string, criticality int, impact_analysis string")
    assert rows(impact.viz_nodes(ch), "node_id") == [("f::m",)]
    links = spark.createDataFrame([("m", "a/b/c", "s", "global"), ("m", "d", "s", "local")], "method string, impacted_method string, snippet string, impact_type string")
    assert rows(impact.viz_links(links), "global_uses", "local_uses", "snippets") == [(["b/c"], ["d"], ["s"])]
    s = spark.createDataFrame([("f", "global", "g1", "m1", "/e1", 1), ("f", "global", "g2", "m2", "/e2", 2)], "file string, usage_type string, impacted_file string, impacted_method string, api_end_point string, ord int")
    assert rows(impact.change_report(spark.createDataFrame([("f",), ("h",)], "file string"), s), "file", "impacted_files", "last_method") == [("f", ["g1", "g2"], "m2")]
    assert impact.plan_results(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, ord int, result string")).first().results == ["a", "b"]


def test_chunks(spark):
    rng = random.Random(7)
    texts = ["x" * rng.randint(0, 40) for _ in range(60)]
    want, total = [[1]], len(texts[0])
    for k, t in enumerate(texts[1:], 2):
        if total > 0 and total + len(t) > 100:
            want.append([k])
            total = len(t)
        else:
            want[-1].append(k)
            total += len(t)
    got = chunks.pack_lines(spark.createDataFrame([("p", k, t) for k, t in enumerate(texts, 1)], "path string, lineno int, text string"), 100)
    assert rows(got.orderBy("chunk"), "chunk", "first_line", "last_line") == sorted([(k, c[0], c[-1]) for k, c in enumerate(want)], key=repr)
    plan = spark.createDataFrame([("d", "s", 1, ["short", " ".join("w" * 12)]), ("d", "s", 2, ["no"])], "doc string, section string, line_num int, row_values array<string>")
    texts = chunks.plan_texts(plan)
    assert rows(texts, "line_num") == [(1,)] and chunks.pack_plan(texts, 10).count() == 1
    with pytest.raises(ValueError):
        chunks.pack_plan(texts, 9000)


def test_symbols(spark, tmp_path):
    from ripplegraph.sources import sinks

    replies = spark.createDataFrame([("p", 0, 1, "package", "Here: ['numpy as np', 're']"), ("p", 1, 50, "package", "['re']"), ("p", 1, 50, "method", "nothing")], "path string, chunk int, first_line int, kind string, reply string")
    found = chunks.symbols_of_replies(replies)
    assert rows(found, "name", "line") == [("np", 1), ("numpy", 1), ("re", 1)]
    sinks.write_symbols(found, str(tmp_path / "s"))
    assert sinks.read_symbols(spark, str(tmp_path / "s"), "package").count() == 3


def test_sql(spark):
    from ripplegraph.plans import session

    session.register(spark)
    session.tables(spark, "/root/testdata/sf0.001", ["nation"])
    samples.python_files(spark).createOrReplaceTempView("files")
    assert spark.sql("SELECT f.name FROM files, LATERAL py_methods(content) f WHERE path = 'stock.py'").count() == 2
    assert spark.sql("SELECT max(fuzzy_ratio(n_name, n_name)) FROM nation").first()[0] == 100


def test_scalars(spark):
    one = spark.createDataFrame([("a/b/c?x", "Risk\nCriticality : 7 or 4\nCriticality 2", "f(a, b)", "ab\ncd", "['x', \"y\"] z")], "u string, r string, c string, t string, l string")
    got = one.select(
        scalars.last_segments("u", 2).alias("a"), scalars.strip_query("u").alias("b"), scalars.criticality("r").alias("c"), scalars.argument_count("c").alias("d"), scalars.line_of_offset("t", F.lit(3)).alias("e"), scalars.nth_line("t", 2).alias("f"),
        scalars.nth_line("t", 9).alias("g"), scalars.strip_punctuation(F.lit("[`'x',]")).alias("h"), scalars.as_array("u").alias("i"), scalars.criticality(F.lit("none")).alias("j"), scalars.token_estimate(F.lit(" a  b ")).alias("k"), scalars.local_time(F.lit(0)).alias("m"), F.length(scalars.run_id()).alias("n"), scalars.ends_with_any("u", ["?x"]).alias("o"), scalars.json_list(F.lit("say ['x', 'y']")).alias("p"),
    ).first()
    assert got[:] == ("b/c?x", "a/b/c", 4, 2, 2, "cd", "NA", "`x", ["a/b/c?x"], None, 2.8, "1970-01-01 00:00:00", 36, True, ["x", "y"])
    pairs = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("a", None), ("same", "same")], "a string, b string")
    assert [r[0] for r in pairs.select(scalars.fuzzy_ratio("a", "b")).collect()] == [62, 100, None, 100]


def test_relational(spark):
    a = spark.createDataFrame([(1, "x", [1, 2]), (2, None, []), (3, "y", [2])], "k int, v string, l array<int>")
    assert rows(relational.matches(a, outside={"v": ["x"]}), "k") == [(2,), (3,)] and rows(relational.matches(a, exists={"v": False}), "k") == [(2,)]
    b = spark.createDataFrame([(1, "r"), (1, "q")], "j int, w string")
    assert rows(relational.looked_up(a, b, "k", "j", "ws", "w"), "k", "ws") == [(1, [("q",), ("r",)]), (2, []), (3, [])]
    assert rows(relational.without_match(a, b, "k", "j"), "k") == [(2,), (3,)] and relational.unwound(a, "l").count() == 3
    assert rows(relational.element_match(a, "l", lambda x: x == 2), "k") == [(1,), (3,)]
    assert [(r.k, r.total) for r in relational.page(a.select("k"), [F.desc("k")], 2, 0).collect()] == [(3, 3), (2, 3)]
    u = relational.updated(a, F.col("k") == 1, {"v": "z"}, {"k": 10}, {"l": 9})
    assert rows(u.where("k = 11"), "v", "l") == [("z", [1, 2, 9])]
    assert rows(relational.updated(a, F.lit(True), pull={"l": [2]}), "k", "l") == [(1, [1]), (2, []), (3, [])]
    assert rows(relational.merged(a.select("k", "v"), spark.createDataFrame([(2, "new")], "k int, v string"), "k"), "k", "v") == [(1, "x"), (2, "new"), (3, "y")]
    assert rows(relational.upserted(a.select("k", "v"), spark.createDataFrame([(3, "n"), (4, "m")], "k int, v string"), "k"), "k", "v") == [(1, "x"), (2, None), (3, "n"), (4, "m")]
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id int, embedding array<double>")
    near = relational.nearest(v, spark.createDataFrame([(0, [4.0, 1.0])], "query_id int, vector array<double>"), 2)
    assert [r.vec_id for r in near.orderBy("rank").collect()] == [4, 3]
    clean = relational.cleaned(a.select("k", "v"), {"v": "w"}, {"w": "none"}, ["w"], ["w"], {"k": "string"})
    assert clean.dtypes == [("k", "string"), ("w", "string")] and clean.count() == 3


def test_increments(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, mtime int")
    new = spark.createDataFrame([("b", 2), ("c", 1), ("a", 1)], "path string, mtime int")
    assert rows(incremental.changed_files(new, old), "path") == [("b",), ("c",)]
    assert rows(incremental.updated_state(old, new), "path", "mtime") == [("a", 1), ("b", 2), ("c", 1)]
    assert rows(incremental.insert_only(old, new), "path", "mtime") == [("a", 1), ("b", 1), ("c", 1)]
    kept, state = incremental.delta_scan(new, old, old, lambda f: f)
    assert rows(kept, "path", "mtime") == rows(state, "path", "mtime") == [("a", 1), ("b", 2), ("c", 1)]
    runs = spark.createDataFrame([(1, "success", 1), (2, "failed", 2), (3, "success", 3)], "run_id int, status string, created int")
    assert rows(incremental.new_runs(runs, 1), "run_id") == [(3,)] and incremental.new_runs(runs, 3).count() == 0


def test_streams(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.diff").write_text(samples.DIFF)
    run = lambda: incremental.watch_diffs(spark, str(folder), lambda df, k: seen.extend(diff.parse_hunks(df).collect()), str(tmp_path / "ck"), every=None).awaitTermination()
    run()
    assert len(seen) == 3
    (folder / "b.diff").write_text(samples.DIFF.replace("stock.py", "other.py"))
    run()
    assert len(seen) == 6 and {r.file for r in seen[3:]} == {"orders.py", "other.py"}
    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.py").write_text("a = 1")
    got = []
    incremental.watch_sources(spark, str(tmp_path / "src"), lambda df, k: got.extend(df.collect()), str(tmp_path / "ck2"), every=None).awaitTermination()
    assert [r.content for r in got] == ["a = 1"]


def test_impact_of_a_change(spark):
    got = rows(catalog.QUERIES["change_impact"](spark, ""), "method", "impacted_file", "impacted_method", "impact_type")
    assert got == [("tax", "orders.py", "create", "local"), ("tax", "orders.py", "later", "local"), ("tax", "stock.py", "price", "global")]
