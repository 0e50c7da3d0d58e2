"""Queries over the driver's tables, each with its twin in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import python_source, script_source, urls
from ..functions.scalars import argument_count, basename, criticality, fuzzy_ratio, last_segments, line_of_offset, safe_name, sections, slash_count, strip_query, token_estimate, url_match
from ..operators import api, chunks, diff, graph, impact, relational, usage
from ..sources.files import lines as lines_of
from ..sources.files import search_words
from ..streaming import incremental
from . import fixtures, samples
from .fixtures import joined, rows_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the succession graph: orders of a day, one customer after the other ----------------------------------------------

SUCCESSION = """
  orders_of_a_day AS (
    SELECT o_orderkey, o_custkey AS src, lead(o_custkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) AS dst
    FROM orders),
  typed AS (
    SELECT src, dst, o_orderkey, CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 'local' ELSE 'global' END AS usage_type
    FROM orders_of_a_day JOIN customer a ON src = a.c_custkey JOIN customer b ON dst = b.c_custkey WHERE src <> dst),
  edges AS (
    SELECT src, dst, usage_type FROM typed
    QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY usage_type = 'global' DESC, o_orderkey DESC) = 1)"""


def succession_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst, usage_type, ..) by build_edges' rule: of the orders between two customers the last one stays."""
    orders, customer = (table(spark, sf_dir, t) for t in ("orders", "customer"))
    orders.select("o_orderkey", "o_custkey", "o_orderdate").createOrReplaceTempView("_orders")
    pairs = spark.sql("SELECT o_orderkey, o_custkey AS a, lead(o_custkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) AS b FROM _orders").where("b IS NOT NULL AND a <> b")
    segment = lambda k: customer.select(F.col("c_custkey").alias(k), F.col("c_mktsegment").alias(f"{k}_segment"))
    typed = pairs.join(segment("a"), "a").join(segment("b"), "b")
    uses = typed.select(
        F.lit("c").alias("def_path"), F.col("a").alias("def_name"), F.lit("c").alias("use_path"), F.col("b").alias("use_method"), F.when(F.expr("a_segment = b_segment"), "local").otherwise("global").alias("usage_type"), F.col("o_orderkey").cast("string").alias("snippet"), F.col("o_orderkey").alias("ord")
    )
    return graph.build_edges(uses)


def _customers(edges: DataFrame) -> DataFrame:
    number = lambda c: F.split_part(c, F.lit("::"), F.lit(2)).cast("bigint")
    return edges.withColumn("src", number(F.col("src"))).withColumn("dst", number(F.col("dst")))


@query(f"WITH {SUCCESSION} SELECT src, dst, usage_type FROM edges")
def last_wins_edges(spark, sf_dir):
    """G2, U6."""
    return _customers(succession_edges(spark, sf_dir)).select("src", "dst", "usage_type")


@query(f"WITH {SUCCESSION} SELECT usage_type, count(*) AS n_edges, count(DISTINCT src) AS n_src FROM edges GROUP BY 1")
def graph_projection(spark, sf_dir):
    """G7, G9."""
    e = _customers(succession_edges(spark, sf_dir))
    both = graph.project(e, "global").unionByName(graph.project(e, "local"))
    return both.groupBy("usage_type").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"))


@query(f"WITH {SUCCESSION} SELECT (SELECT count(*) FROM customer) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_counts(spark, sf_dir):
    """G9, A11."""
    return graph.counts(table(spark, sf_dir, "customer"), succession_edges(spark, sf_dir))


def _hop(mode: str):
    def run(spark, sf_dir):
        customer = table(spark, sf_dir, "customer")
        nodes = customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("seg/"), "c_mktsegment").alias("path"), F.col("c_name").alias("name"))
        changes = customer.select(F.col("c_mktsegment").alias("file"), F.col("c_name").alias("method"))
        edges = _customers(succession_edges(spark, sf_dir))
        hit = graph.one_hop(changes, edges, nodes, mode)
        return hit.groupBy("file", "impacted_file").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("impacted_method").alias("n_methods"))

    run.__name__ = f"one_hop_{mode}"
    return run


for _mode in ("global", "local"):
    query(
        f"""WITH {SUCCESSION} SELECT a.c_mktsegment AS file, 'seg/' || b.c_mktsegment AS impacted_file, count(*) AS n, count(DISTINCT b.c_name) AS n_methods
        FROM edges JOIN customer a ON src = a.c_custkey JOIN customer b ON dst = b.c_custkey WHERE usage_type = '{_mode}' GROUP BY 1, 2"""
    )(_hop(_mode))


@query(
    f"""WITH RECURSIVE {SUCCESSION}, start AS (SELECT min(src) AS s FROM edges),
    walk AS (SELECT dst AS node FROM edges, start WHERE src = s UNION SELECT e.dst FROM walk JOIN edges e ON e.src = walk.node)
    SELECT s AS source, node FROM walk, start"""
)
def reachability(spark, sf_dir):
    """G5, from the smallest source."""
    e = _customers(succession_edges(spark, sf_dir))
    return graph.reachable(e, e.agg(F.min("src").alias("source"))).select("source", "node")


@query(
    f"""WITH RECURSIVE {SUCCESSION},
    walk AS (SELECT min(src) AS node, CAST([] AS VARCHAR[]) AS used, 0 AS hops FROM edges UNION ALL
      SELECT e.dst, list_append(used, e.src || '>' || e.dst), hops + 1 FROM walk JOIN edges e ON e.src = walk.node WHERE hops < 4 AND NOT list_contains(used, e.src || '>' || e.dst))
    SELECT hops, count(*) AS n, min(node) AS least, max(node) AS most FROM walk GROUP BY hops"""
)
def paths_k(spark, sf_dir):
    """G6, up to four hops from the smallest source."""
    e = _customers(succession_edges(spark, sf_dir))
    found = graph.paths(e, e.agg(F.min("src").alias("source")), 4).withColumn("node", F.element_at("path", -1))
    return found.groupBy("hops").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(
        f""", r{k} AS MATERIALIZED (SELECT node, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM nodes LEFT JOIN (
        SELECT dst, sum(rank / n_out) AS got FROM links JOIN r{k - 1} ON src = node GROUP BY dst) ON node = dst)"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH {SUCCESSION}, used AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE usage_type = 'global'),
    links AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n_out FROM used),
    nodes AS MATERIALIZED (SELECT src AS node FROM used UNION SELECT dst FROM used), r0 AS (SELECT node, 0.15::DOUBLE AS rank FROM nodes){steps}
    SELECT node, round(rank, 6) AS rank FROM r{rounds} ORDER BY 2 DESC, node LIMIT 10"""


@query(_pagerank_sql(10))
def pagerank_top(spark, sf_dir):
    """G7, G8, O2."""
    e = graph.project(_customers(succession_edges(spark, sf_dir)), "global")
    return graph.top_ranked(graph.pagerank(e, 10), 10)


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins_nodes(spark, sf_dir):
    """G1, U5."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), "event_id", F.struct("ts", "event_id").alias("ord"))
    return graph.build_nodes(events).select(F.col("path").alias("user_id"), F.col("name").alias("event_type"), "event_id")


@query("SELECT o_custkey AS path, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_nodes(spark, sf_dir):
    """U9."""
    return graph.duplicate_nodes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("name")))


# ---- urls --------------------------------------------------------------------------------------------------------------

_HTTP = r"(https?://[^\s\"''`<>\])},;]+)"


@query(f"SELECT page_id, u AS url, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), '{_HTTP}', 1)) AS u FROM pages) GROUP BY 1, 2")
def url_extract(spark, sf_dir):
    """E12, U1."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.concat_ws(" ", "url", "html").alias("content"))
    return urls.scan_urls(pages).where("kind = 'literal'").groupBy(F.col("path").alias("page_id"), "url").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n_pages, count(DISTINCT split_part(url, '?', 1)) AS n_urls, max(length(url) - length(replace(url, '/', ''))) AS slashes FROM pages GROUP BY 1")
def url_host_counts(spark, sf_dir):
    """A2, X1, X7, X13."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct(strip_query("url")).alias("n_urls"), F.max(slash_count("url")).alias("slashes"))


_PARTS = "string_split({}, '/')"
_LAST2 = "array_to_string(string_split({0}, '/')[greatest(len(string_split({0}, '/')) - 1, 1):], '/')"
MATCHES = f"""
  u AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS base, regexp_extract(split_part(url, '://', 2), '/.*') AS p FROM pages),
  d AS (SELECT DISTINCT p FROM u),
  pairs AS (SELECT a.p AS dp, b.p AS cp, CASE WHEN length(b.p) < length(a.p) THEN b.p ELSE a.p END AS shorter, CASE WHEN length(b.p) < length(a.p) THEN a.p ELSE b.p END AS longer FROM d a, d b),
  m AS (SELECT dp, cp, len({_PARTS.format("shorter")}) >= 2 AND split_part(shorter, '/', -1) <> '' AND contains(longer, {_LAST2.format("shorter")}) AS prim,
      split_part(dp, '/', -1) = split_part(cp, '/', -1) AND split_part(dp, '/', -1) <> '' AS sec FROM pairs),
  hits AS (SELECT x.page_id AS def_id, y.page_id AS call_id, bool_or(prim) AS prim FROM u x JOIN m ON x.p = dp JOIN u y ON y.p = cp WHERE x.base <> y.base AND (prim OR sec) GROUP BY 1, 2)"""


@query(f"WITH {MATCHES} SELECT call_id, count(*) AS n, count(*) FILTER (WHERE prim) AS n_primary, min(def_id) AS first_def FROM hits GROUP BY 1")
def route_last2_match(spark, sf_dir):
    """Pages whose paths, queries and all, match those of other hosts to the letter of the rule."""
    pages = table(spark, sf_dir, "pages")
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    u = pages.select("page_id", F.split_part(rest, F.lit("/"), F.lit(1)).alias("base"), F.regexp_extract(rest, "/.*", 0).alias("p"))
    defs = u.select(F.col("page_id").alias("def_id"), F.col("base").alias("def_base"), F.col("p").alias("def_url"))
    calls = u.select(F.col("page_id").alias("call_id"), F.col("base").alias("call_base"), F.col("p").alias("call_url"))
    return api.match_urls(defs, calls, compat=True).groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("primary"), 1)).alias("n_primary"), F.min("def_id").alias("first_def"))


URL_PAIRS = [("http://h:1/v1/abc/def?k=1", "/abc/def"), ("http://h:1/pay", "/pay"), ("http://h/x/pay", "pay"), ("http://h/x/pay?k=1", "pay"), ("/a/b", "/c/d")]


@query("SELECT * FROM (VALUES (0, 'primary', true), (1, 'primary', true), (2, 'secondary', false)) t(k, found, joined)")
def url_pairs(spark, sf_dir):
    """Which of the pairs match by the scalar rule, and by the join as primary; the query keeps the fourth from it."""
    pairs = spark.createDataFrame([(k, c, d) for k, (c, d) in enumerate(URL_PAIRS)], "k int, c string, d string")
    m = pairs.withColumn("m", url_match("c", "d"))
    found = m.select("k", F.when(F.col("m.primary"), "primary").when(F.col("m.secondary"), "secondary").alias("found")).where("found IS NOT NULL")
    joined = api.match_urls(pairs.select(F.col("k").alias("def_id"), F.lit("S").alias("def_base"), F.col("d").alias("def_url")), pairs.select(F.col("k").alias("call_id"), F.lit("T").alias("call_base"), F.col("c").alias("call_url")), compat=True)
    return found.join(joined.where("def_id = call_id").select(F.col("def_id").alias("k"), F.col("primary").alias("joined")), "k")


_PATH = "regexp_extract(split_part(url, '://', 2), '/[^?#]*')"
_LOCAL, _EXTERNAL = "contains(url, '.example.com')", "NOT contains(url, '.example.com')"


@query(
    f"""WITH l AS (SELECT {_PATH} AS path, min(page_id) AS h FROM pages WHERE {_LOCAL} GROUP BY 1),
    x AS (SELECT {_PATH} AS path, split_part(split_part(url, '://', 2), '/', 1) AS base, page_id FROM pages WHERE {_EXTERNAL}),
    e AS (SELECT path, min(base) AS base, arg_min(page_id, (base, page_id)) AS h FROM x GROUP BY 1),
    c AS (SELECT DISTINCT regexp_replace({_PATH}, '/$', '') AS path FROM pages)
    SELECT c.path, CASE WHEN l.h IS NOT NULL THEN 'intra' WHEN e.base IS NOT NULL THEN 'inter' ELSE 'not_found' END AS kind,
      CASE WHEN l.h IS NULL THEN e.base END AS base, CAST(coalesce(l.h, e.h) AS VARCHAR) AS handler FROM c LEFT JOIN l USING (path) LEFT JOIN e USING (path)"""
)
def endpoint_classification(spark, sf_dir):
    """Paths without their last slash among those of one site and of the others."""
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract(F.split_part("url", F.lit("://"), F.lit(2)), "/[^?#]*", 0)
    known = pages.select(path.alias("path"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("base"), F.col("page_id").alias("handler"), F.col("url"))
    calls = pages.select(F.regexp_replace(path, "/$", "").alias("path")).distinct()
    local = known.where(F.col("url").contains(".example.com"))
    return api.classified_endpoints(calls, local, known.where(~F.col("url").contains(".example.com"))).select("path", "kind", "base", F.col("handler").cast("string").alias("handler"))


@query(f"SELECT {_PATH} AS url, bool_or({_LOCAL}) AS defined FROM pages GROUP BY 1")
def url_definition_flag(spark, sf_dir):
    """A14, A2."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract(F.split_part("url", F.lit("://"), F.lit(2)), "/[^?#]*", 0).alias("url"), F.lit(None).cast("string").alias("var"), F.col("page_id").cast("string").alias("path"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("method"), F.col("url").contains(".example.com").alias("is_definition"))
    return api.definition_flags(api.url_index(rows))


@query("SELECT page_id, split_part(url, '/', -1) AS last, array_to_string(string_split(url, '/')[-2:], '/') AS tail, replace(url, '/', '_') AS safe FROM pages")
def url_segments(spark, sf_dir):
    """X1, X2, X22."""
    return table(spark, sf_dir, "pages").select("page_id", basename("url").alias("last"), last_segments("url", 2).alias("tail"), safe_name("url").alias("safe"))


OWNERS = [("example.com", "team-a"), ("m.", "team-m"), ("www.", "team-w")]


@query(
    f"""WITH o(repo, owner) AS (VALUES {", ".join(map(str, OWNERS))}),
    h AS (SELECT url, arg_min(owner, repo) AS owner FROM (SELECT DISTINCT url FROM pages) JOIN o ON contains(url, repo) GROUP BY 1)
    SELECT coalesce(owner, 'team-default') AS owner, count(*) AS n FROM pages LEFT JOIN h USING (url) GROUP BY 1"""
)
def owner_routing(spark, sf_dir):
    """J15."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("impacted_file"))
    owned = impact.route_owners(pages, spark.createDataFrame(OWNERS, "repo string, owner string"), "team-default")
    return owned.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


# ---- lines, ranges, chunks ---------------------------------------------------------------------------------------------

LINES = "l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS lineno FROM documents)"


def _document_lines(spark, sf_dir):
    return lines_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query(f"WITH {LINES} SELECT path, CAST(max(lineno) AS INT) AS n_lines, max(length(text)) AS longest, count(*) FILTER (WHERE trim(text) = '') AS n_blank FROM l GROUP BY 1")
def line_facts_explode(spark, sf_dir):
    """F7."""
    return _document_lines(spark, sf_dir).groupBy("path").agg(F.max("lineno").alias("n_lines"), F.max(F.length("text")).cast("bigint").alias("longest"), F.count(F.when(F.trim("text") == "", 1)).alias("n_blank"))


@query(
    f"""WITH RECURSIVE {LINES}, s AS (SELECT path, lineno, length(text) AS n, row_number() OVER (PARTITION BY path ORDER BY lineno) AS k FROM l),
    w AS (SELECT path, k, lineno, n, n AS total, 0 AS chunk FROM s WHERE k = 1 UNION ALL
      SELECT s.path, s.k, s.lineno, s.n, CASE WHEN total > 0 AND total + s.n > 4096 THEN s.n ELSE total + s.n END, CASE WHEN total > 0 AND total + s.n > 4096 THEN chunk + 1 ELSE chunk END FROM w JOIN s ON s.path = w.path AND s.k = w.k + 1)
    SELECT path, chunk, CAST(min(lineno) AS INT) AS first_line, CAST(max(lineno) AS INT) AS last_line, CAST(sum(n) AS BIGINT) AS n_chars FROM w GROUP BY 1, 2"""
)
def chunk_pack(spark, sf_dir):
    """W4."""
    return chunks.pack_lines(_document_lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT path, CAST(lineno AS INT) AS lineno, CAST(greatest(lineno - 20, 1) AS INT) AS first, CAST(least(lineno + 20, max(lineno) OVER (PARTITION BY path)) AS INT) AS last FROM l")
def context_window(spark, sf_dir):
    """W6."""
    rows = _document_lines(spark, sf_dir).select("path", "lineno")
    return impact.line_windows(rows, rows.groupBy("path").agg(F.max("lineno").alias("n_lines"))).select("path", "lineno", "first", "last")


@query(
    """WITH m AS (SELECT n_regionkey AS path, n_name AS name, n_nationkey * 10 AS s, n_nationkey * 10 + 35 AS e FROM nation),
    p AS (SELECT s_suppkey, n_regionkey AS path, CAST(s_suppkey % 300 AS BIGINT) AS lineno FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, lineno, name AS method FROM p LEFT JOIN m ON p.path = m.path AND lineno > s AND lineno < e QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY s, name) = 1"""
)
def enclosing_segment(spark, sf_dir):
    """J3, W3."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    m = nation.select(F.col("n_regionkey").alias("path"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 10).alias("start_line"), (F.col("n_nationkey") * 10 + 35).alias("end_line"))
    p = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("path"), (F.col("s_suppkey") % 300).cast("bigint").alias("lineno"))
    return usage.enclosing_methods(p, m).select("s_suppkey", "lineno", "method")


@query(
    """WITH e AS (SELECT user_id AS path, date_diff('second', TIMESTAMP '1970-01-01', ts) AS s, min(event_type) AS name FROM events GROUP BY 1, 2), z AS (SELECT path, max(s) + 1 AS n FROM e GROUP BY 1)
    SELECT path, name, s AS start_line, coalesce(lead(s) OVER (PARTITION BY path ORDER BY s) - 1, n) AS end_line FROM e JOIN z USING (path)"""
)
def range_lead(spark, sf_dir):
    """W2, O1."""
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', date_trunc('second', ts))")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), at.alias("start_line"))
    return usage.method_ends(e, e.groupBy("path").agg((F.max("start_line") + 1).alias("n_lines")))


@query(
    """SELECT p.user_id, p.ts AS call_at, max(s.ts) AS defined_at, max(s.ts) IS NOT NULL AS found
    FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase') p JOIN events s ON s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts < p.ts GROUP BY 1, 2"""
)
def asof_definition(spark, sf_dir):
    """The last signup before each purchase."""
    events = table(spark, sf_dir, "events")
    of = lambda kind: events.where(F.col("event_type") == kind).select(F.col("user_id").alias("path"), F.lit("v").alias("var"), F.col("ts").alias("line"), F.col("event_type").alias("url"))
    hit = api.url_usages(of("signup"), of("purchase").distinct())
    return hit.select(F.col("path").alias("user_id"), F.col("call_line").alias("call_at"), F.col("defined_line").alias("defined_at"), F.col("url").isNotNull().alias("found"))


@query("SELECT conv_id, turn, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.4::DOUBLE, 3) AS tokens FROM conversations")
def token_estimates(spark, sf_dir):
    """A12."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(token_estimate("text"), 3).alias("tokens"))


@query("SELECT conv_id, CAST(len(string_split(left(text, 100), chr(10))) AS INT) AS line, count(*) AS n FROM conversations GROUP BY 1, 2")
def offset_lines(spark, sf_dir):
    """X15."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id", line_of_offset("text", F.lit(100)).alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([a-zA-Z0-9_]+)', 1)) AS name FROM documents)
    SELECT name, count(*) AS n_docs FROM w WHERE name IN ('thing', 'ration', 'the', 'worthless') GROUP BY 1"""
)
def word_search(spark, sf_dir):
    """H1: some whole words, counted at once."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    names = spark.createDataFrame([("thing",), ("ration",), ("the",), ("worthless",)], "name string")
    return search_words(lines_of(docs), names).groupBy("name").agg(F.countDistinct("path").alias("n_docs"))


@query(
    r"""WITH r AS (SELECT event_id, 'Summary\nCriticality: ' || CAST(event_id % 8 AS VARCHAR) || ' of 5\nCriticality: 1' AS t FROM (SELECT event_id FROM events)),
    x AS (SELECT event_id, nullif(regexp_extract(split_part(substr(replace(t, '\n', chr(10)), strpos(replace(t, '\n', chr(10)), 'Criticality') + 11), chr(10), 1), '[0-5]'), '') AS c FROM r)
    SELECT TRY_CAST(c AS INT) AS criticality, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(c AS INT) >= 3) AS n_serious FROM x GROUP BY 1"""
)
def criticality_rollup(spark, sf_dir):
    """X9, F12."""
    text = F.concat(F.lit("Summary\nCriticality: "), (F.col("event_id") % 8).cast("string"), F.lit(" of 5\nCriticality: 1"))
    scored = table(spark, sf_dir, "events").select(criticality(text).alias("criticality"))
    return scored.groupBy("criticality").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("criticality") >= 3, 1)).alias("n_serious"))


# ---- increments --------------------------------------------------------------------------------------------------------

_OLD, _NEW = "o_orderdate < TIMESTAMP '1996-01-01'", "o_orderdate >= TIMESTAMP '1995-06-01'"


@query(f"SELECT o_orderkey AS path, o_totalprice AS v FROM orders WHERE {_OLD} UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE NOT ({_OLD})")
def insert_only_upsert(spark, sf_dir):
    """U3."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where(_OLD).select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("v"))
    new = orders.where(_NEW).select(F.col("o_orderkey").alias("path"), (F.col("o_totalprice") + 1).alias("v"))
    return incremental.insert_only(old, new)


@query(f"SELECT o_orderkey AS path, o_totalprice + 1 AS v FROM orders WHERE {_NEW} UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE NOT ({_NEW})")
def replacing_upsert(spark, sf_dir):
    """Note 5, B17."""
    orders = table(spark, sf_dir, "orders")
    return relational.upserted(orders.select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("v")), orders.where(_NEW).select(F.col("o_orderkey").alias("path"), (F.col("o_totalprice") + 1).alias("v")), "path")


@query(f"SELECT o_orderkey AS path FROM orders WHERE NOT ({_OLD}) OR o_orderstatus = 'F'")
def mtime_delta(spark, sf_dir):
    """orders that are new, or whose time has moved, since a snapshot."""
    orders = table(spark, sf_dir, "orders")
    now = orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    state = orders.where(_OLD).select(F.col("o_orderkey").alias("path"), (F.col("o_orderdate").cast("timestamp") - F.when(F.col("o_orderstatus") == "F", F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))).alias("mtime"))
    return incremental.changed_files(now, state).select("path")


@query(f"SELECT o_orderkey AS path, o_orderdate AS mtime FROM orders WHERE {_OLD} AND NOT ({_NEW}) UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY FROM orders WHERE {_NEW}")
def overwrite_state(spark, sf_dir):
    """U4."""
    orders = table(spark, sf_dir, "orders")
    state = orders.where(_OLD).select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    return incremental.updated_state(state, orders.where(_NEW).select(F.col("o_orderkey").alias("path"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("mtime")))


@query("SELECT DISTINCT user_id AS path, event_type AS name FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.value > 50)")
def set_minus_packages(spark, sf_dir):
    """U8."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), "value")
    return usage.true_variables(e.select("path", "name").distinct(), e.where("value > 50").distinct())


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    """ST1's extension to event time, over a batch."""
    return incremental.windowed_counts(table(spark, sf_dir, "events")).select(F.col("window_start"), "event_type", "n")


# ---- document-store queries --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3)")
def match_filter(spark, sf_dir):
    """B1."""
    return relational.matches(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, {"o_totalprice": 1000}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"o_custkey": [1, 2, 3]}).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)(1|RED)')")
def regex_filter(spark, sf_dir):
    """B2."""
    return relational.matches(table(spark, sf_dir, "part"), like={"p_name": "(1|RED)"}).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_no_orders(spark, sf_dir):
    """B5."""
    return relational.without_match(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def elem_match(spark, sf_dir):
    """B3, B4."""
    full = relational.looked_up(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "items", "l_linenumber", "l_quantity")
    return relational.element_match(full, "items", lambda x: x["l_quantity"] >= 49).select("o_orderkey")


@query("SELECT conv_id, role, turn FROM conversations")
def unwind_turns(spark, sf_dir):
    """B6, B11."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "turn")).alias("turns"))
    return relational.unwound(t, "turns").select("conv_id", "turns.role", "turns.turn")


@query(
    """SELECT count(*) AS n, round(avg(l_quantity), 4) AS avg_qty, min(l_quantity) AS least, max(l_quantity) AS most,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_returned, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS avg_returned FROM lineitem"""
)
def conditional_kpis(spark, sf_dir):
    """B8."""
    returned = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.sum(F.when(returned, 1).otherwise(0)).alias("n_returned"), F.round(F.avg(F.when(returned, F.col("l_quantity"))), 4).alias("avg_returned")
    )


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 4) AS avg_value FROM events GROUP BY 1")
def grouped_events(spark, sf_dir):
    """B9, B19."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 4).alias("avg_value"))


@query("WITH o AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT n AS n_lines, count(*) AS n_orders, round(avg(q), 4) AS avg_qty FROM o GROUP BY 1")
def nested_group(spark, sf_dir):
    """B10."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n_lines"))
    return per.groupBy("n_lines").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.avg("q"), 4).alias("avg_qty"))


@query("SELECT user_id, event_type, CAST(sum(date_diff('microsecond', ts, ts2) // 1000) AS BIGINT) AS ms FROM (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ts2 FROM events) WHERE ts2 IS NOT NULL GROUP BY 1, 2")
def time_between(spark, sf_dir):
    """Milliseconds between a user's events of a type."""
    from pyspark.sql import Window

    ahead = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("ts2", ahead).where("ts2 IS NOT NULL")
    return rows.groupBy("user_id", "event_type").agg(F.sum(F.expr("timestampdiff(MILLISECOND, ts, ts2)")).alias("ms"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def facet_page(spark, sf_dir):
    """B13, B20."""
    return relational.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, 2)


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    """B14."""
    return relational.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT c_custkey, CASE WHEN c_custkey < 100 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey < 100 THEN c_acctbal + 5 ELSE c_acctbal END AS c_acctbal FROM customer")
def updated_fields(spark, sf_dir):
    """B18."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return relational.updated(c, F.col("c_custkey") < 100, {"c_mktsegment": "X"}, {"c_acctbal": 5})


@query("SELECT c_custkey, coalesce(CASE WHEN c_nationkey < 5 THEN 'new' END, c_mktsegment) AS c_mktsegment FROM customer")
def merged_objects(spark, sf_dir):
    """B15."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return relational.merged(c.select("c_custkey", "c_mktsegment"), c.where("c_nationkey < 5").select("c_custkey", F.lit("new").alias("c_mktsegment")), "c_custkey")


@query("SELECT o_orderpriority, round(100.0::DOUBLE * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 2) AS pct FROM orders GROUP BY 1")
def percents(spark, sf_dir):
    """B16, B21."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(relational.percent(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), F.count(F.lit(1))).alias("pct"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, count(*) FILTER (WHERE l_linestatus = 'F') AS n_full FROM lineitem GROUP BY 1")
def pivoted_counts(spark, sf_dir):
    """B21."""
    n = lambda s: F.count(F.when(F.col("l_linestatus") == s, 1))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(n("O").alias("n_open"), n("F").alias("n_full"))


@query("SELECT DISTINCT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def cleaned_rows(spark, sf_dir):
    """B23."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    return relational.cleaned(c, {"c_mktsegment": "segment", "c_nationkey": "nation"}, {"segment": "none"}, ["nation"], ["segment", "nation"], {"nation": "string"})


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)
    SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank, round(s, 4) AS score
    FROM (SELECT query_id, vec_id, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS s FROM embeddings, q)
    QUALIFY rank <= 10"""
)
def vector_topk(spark, sf_dir):
    """Every twentieth vector against all."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return relational.nearest(v, q, 10).select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))


# ---- sources and diffs -------------------------------------------------------------------------------------------------


@query(rows_sql("path, name, start_line, end_line, api_end_point", ("orders.py", "tax", 7, 9, None), ("orders.py", "create", 12, 17, "/v1/orders"), ("orders.py", "later", 19, 21, None), ("stock.py", "price", 4, 9, None), ("stock.py", "items", 12, 13, "/v1/items")))
def py_methods(spark, sf_dir):
    """E1, E2, E6."""
    return python_source.extract(samples.python_files(spark), "py_methods")


#: What each statement of the two sources assigns and reads.
FACTS = [
    ("orders.py", 3, "Assign", "app", 3, "Flask,__name__", "Flask"),
    ("orders.py", 4, "Assign", "BASE", 4, "", None),
    ("orders.py", 5, "Assign", "ITEMS", 5, "BASE", None),
    ("orders.py", 8, "Assign", "rate", 8, "amount", None),
    ("orders.py", 11, "Call", "", 11, "app", "route"),
    ("orders.py", 13, "Assign", "total", 13, "tax,order", "tax"),
    ("orders.py", 14, "Assign", "reply", 14, "requests,ITEMS", "get"),
    ("orders.py", 15, "If", "", 16, "total", None),
    ("orders.py", 16, "Assign", "final", 16, "total", None),
    ("orders.py", 20, "Assign", "due", 20, "tax,order", "tax"),
    ("stock.py", 5, "Assign", "base", 5, "item", None),
    ("stock.py", 6, "Assign", "cost", 6, "tax,base", "tax"),
    ("stock.py", 7, "For", "part", 8, "cost", None),
    ("stock.py", 8, "Assign", "last", 8, "part", None),
    ("stock.py", 11, "Call", "", 11, "app", "route"),
]


@query(rows_sql("path, lineno, type, targets, ending, values, function", *FACTS))
def py_line_facts(spark, sf_dir):
    """E3-E5."""
    return python_source.extract(samples.python_files(spark), "py_line_facts").select("path", "lineno", "type", joined("targets"), "ending", joined("values"), "function")


@query(rows_sql("path, name, start_line, end_line, route_path, methods", ("orders.py", "create", 12, 17, "/v1/orders", "POST"), ("stock.py", "items", 12, 13, "/v1/items", "")))
def py_routes(spark, sf_dir):
    """E9."""
    return python_source.extract(samples.python_files(spark), "py_routes").select("path", "name", "start_line", "end_line", "route_path", joined("methods"))


@query(rows_sql("path, line", ("broken.py", 1)))
def py_parse_errors(spark, sf_dir):
    """H6."""
    return python_source.extract(samples.python_files(spark), "py_parse_error").select("path", "line")


@query(rows_sql("path, var, call_line, defined_line, url", ("orders.py", "ITEMS", 14, 5, "http://stock.example.org/v1/items")))
def py_url_usages(spark, sf_dir):
    """E10, E11, J7."""
    files = samples.python_files(spark)
    return api.url_usages(python_source.extract(files, "py_url_assignments"), python_source.extract(files, "py_http_calls"))


@query(rows_sql("name, path, start_line, end_line, parameters, return_type, api_end_points", ("list", "shop.js", 1, 4, "req,res", "fetch(url)", "/shop/all,/shop/list"), ("pay", "shop.js", 5, 8, "order,total", "total | 0", "/shop/pay")))
def js_methods(spark, sf_dir):
    """E18, E20, J10."""
    files = samples.script_files(spark)
    return api.routed_methods(script_source.extract(files, "js_methods"), script_source.extract(files, "js_routes")).select("name", "path", "start_line", "end_line", joined("parameters"), "return_type", joined("api_end_points"))


@query(rows_sql("path, key, url", ("config.json", "ITEMS_URL", "http://stock.example.org/v1/items"), ("config.json", "list", "https://a.example.org/x"), ("config.json", "LAST", "http://b.example.org/y"), ("config.yml", "url", "http://orders.example.org/v1/orders"), ("config.yml", "others", "https://c.example.org/z")))
def json_url_walk(spark, sf_dir):
    """E17, H4."""
    return urls.config_urls(samples.code_base(spark))


@query(rows_sql("def_path, def_name, use_path, use_line, use_method, use_start, use_end, usage_type", ("orders.py", "tax", "orders.py", 13, "create", 12, 17, "local"), ("orders.py", "tax", "orders.py", 20, "later", 19, 21, "local"), ("orders.py", "tax", "stock.py", 6, "price", 4, 9, "global")))
def def_use(spark, sf_dir):
    """J1, J2, A1."""
    files = samples.python_files(spark)
    m, f = python_source.extract(files, "py_methods"), python_source.extract(files, "py_line_facts")
    return usage.local_uses(m, f).withColumn("usage_type", F.lit("local")).unionByName(usage.global_uses(m, f).withColumn("usage_type", F.lit("global")))


_LINES_SQL = ", ".join("({}, '{}')".format(k, t.replace("'", "''")) for k, t in enumerate(samples.DIFF.split("\n"), 1))


@query(
    f"""WITH t(lineno, line) AS (VALUES {_LINES_SQL}),
    c AS (SELECT *, max(CASE WHEN line LIKE '@@ %' OR line LIKE 'diff --git %' THEN lineno END) OVER w AS head, count(*) FILTER (WHERE line LIKE '@@ %') OVER w AS hunk,
      last_value(nullif(regexp_extract(line, '^diff --git a/(\\S+) b/', 1), '') IGNORE NULLS) OVER w AS file FROM t WINDOW w AS (ORDER BY lineno ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT c.*, x.line AS hl FROM c JOIN t x ON x.lineno = c.head WHERE x.line LIKE '@@ %' AND regexp_matches(file, '\\.(js|py|java)$'))
    SELECT file, CAST(regexp_extract(hl, '-(\\d+)', 1) AS INT) AS old_start, CAST(regexp_extract(hl, '\\+(\\d+)', 1) AS INT) AS new_start,
      count(*) FILTER (WHERE line LIKE '-%') AS n_old, count(*) FILTER (WHERE line LIKE '+%') AS n_new, string_agg(substr(line, 2), '|' ORDER BY lineno) FILTER (WHERE line LIKE '+%') AS new_code
    FROM h WHERE lineno > head GROUP BY hunk, file, hl"""
)
def diff_hunks(spark, sf_dir):
    """S11, W1, A4."""
    h = diff.parse_hunks(samples.diff(spark))
    return h.select("file", "old_start", "new_start", F.size("old_code").cast("bigint").alias("n_old"), F.size("new_code").cast("bigint").alias("n_new"), F.array_join(F.transform("new_code", lambda x: F.rtrim(x, F.lit("\n"))), "|").alias("new_code"))


@query(rows_sql("file, old_start, new_start, old_method, new_method", ("orders.py", 7, 7, "tax", "tax"), ("orders.py", 20, 21, "later", "later"), ("stock.py", 5, 5, "price", "price")))
def hunk_attribution(spark, sf_dir):
    """J4."""
    return diff.attribute_hunks(diff.parse_hunks(samples.diff(spark)), python_source.extract(samples.python_files(spark), "py_methods")).select("file", "old_start", "new_start", "old_method", "new_method")


@query(rows_sql("file, method, impacted_file, impacted_method, snippet, impact_type", ("orders.py", "tax", "orders.py", "create", "total = tax(order)", "local"), ("orders.py", "tax", "orders.py", "later", "due = tax(order)", "local"), ("orders.py", "tax", "stock.py", "price", "cost = tax(base)", "global")))
def change_impact(spark, sf_dir):
    """From a diff to the methods that it reaches: S11, J4, J1, J2, G1, G2, G4."""
    return _impact(spark)


def _impact(spark: SparkSession) -> DataFrame:
    files = samples.python_files(spark)
    m, f = python_source.extract(files, "py_methods"), python_source.extract(files, "py_line_facts")
    changes = diff.attribute_hunks(diff.parse_hunks(samples.diff(spark)), m).where("old_method IS NOT NULL").select("file", F.col("old_method").alias("method"))
    uses = usage.local_uses(m, f).withColumn("usage_type", F.lit("local")).unionByName(usage.global_uses(m, f).withColumn("usage_type", F.lit("global"))).where("use_method IS NOT NULL")
    text = lines_of(files).select(F.col("path").alias("use_path"), F.col("lineno").alias("use_line"), F.trim("text").alias("snippet"))
    edges = graph.build_edges(uses.join(text, ["use_path", "use_line"]).withColumn("ord", F.col("use_line")))
    nodes = graph.build_nodes(m.withColumn("ord", F.col("start_line")))
    return graph.one_hop(changes, edges, nodes, "global").withColumn("impact_type", F.lit("global")).unionByName(graph.one_hop(changes, edges, nodes, "local").withColumn("impact_type", F.lit("local")))


@query(rows_sql("change_id, path, method, first, last", ("c1", "orders.py", "create", 13, 16), ("c2", "stock.py", "price", 5, 8)))
def sphere_of_influence(spark, sf_dir):
    """A6, A7."""
    files = samples.python_files(spark)
    facts = python_source.extract(files, "py_line_facts_compat")
    inside = usage.enclosing_methods(facts, python_source.extract(files, "py_methods"), strict=False)
    changes = spark.createDataFrame([("c1", "orders.py", "create", ["total"]), ("c2", "stock.py", "price", ["base"])], "change_id string, path string, method string, targets array<string>")
    return impact.sphere_of_influence(changes, impact.target_spans(inside)).drop("targets")


@query(rows_sql("a, b, ratio", ("AUTOMOBILE", "BUILDING", 33), ("AUTOMOBILE", "FURNITURE", 32), ("AUTOMOBILE", "HOUSEHOLD", 32), ("AUTOMOBILE", "MACHINERY", 32), ("BUILDING", "FURNITURE", 24), ("BUILDING", "HOUSEHOLD", 35), ("BUILDING", "MACHINERY", 24), ("FURNITURE", "HOUSEHOLD", 22), ("FURNITURE", "MACHINERY", 22), ("HOUSEHOLD", "MACHINERY", 22)))
def fuzzy_ratios(spark, sf_dir):
    """Names of customers' segments against each other."""
    s = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a")).distinct()
    return s.join(s.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).select("a", "b", fuzzy_ratio("a", "b").alias("ratio"))


@query("SELECT 'f(a, b)' AS call, 2 AS n UNION ALL SELECT 'f()', 0 UNION ALL SELECT 'g(x)', 1")
def argument_counts(spark, sf_dir):
    """X16."""
    return spark.createDataFrame([("f(a, b)",), ("f()",), ("g(x)",)], "call string").select("call", argument_count("call").alias("n"))


@query("SELECT 1 AS k, 'first' AS v UNION ALL SELECT 2, 'second'")
def numbered_sections(spark, sf_dir):
    """X10."""
    text = "Intro\nWhat The Plan covers:\n\nfirst\n\nsecond"
    one = spark.createDataFrame([(text.replace("covers:\n\nfirst", "covers: first"),)], "t string")
    return one.select(F.explode(sections("t", "what the plan covers:")).alias("k", "v"))


QUERIES |= fixtures.QUERIES
ORACLES |= fixtures.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that the most important ones lead to, in the graph of orders."""
    edges = _customers(succession_edges(spark, sf_dir))
    top = graph.top_ranked(graph.pagerank(edges, 10), 10)
    return top.join(edges, F.col("node") == F.col("src"), "left").select("node", "rank", F.col("dst").alias("impacted"), "usage_type")
