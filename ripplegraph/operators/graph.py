"""The property graph: a node is a method, an edge leads from a definition to a user of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import cut_lineage

WEIGHT = 0.1


def node_id(path: str, method: str):
    return F.concat(F.col(path), F.lit("::"), F.col(method))


def build_nodes(methods: DataFrame, order: str = "ord") -> DataFrame:
    """A node for each path and method of methods(path, name, .., ord); the first one stays."""
    first = Window.partitionBy("id").orderBy(order)
    rows = methods.withColumn("id", node_id("path", "name")).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return rows.drop("_k").withColumn("importance", F.lit(WEIGHT))


def build_edges(uses: DataFrame, order: str = "ord") -> DataFrame:
    """(src, dst, usage_type, method_nm, snippet, weight) of uses(def_path, def_name, use_path, use_method,
    usage_type, snippet, ord).

    Of the uses between two nodes the last one stays, and global ones count as later than local ones. An aggregate does
    it, so that hot pairs are reduced before they are shuffled.
    """
    rows = uses.select(node_id("def_path", "def_name").alias("src"), node_id("use_path", "use_method").alias("dst"), "usage_type", F.col("use_method").alias("method_nm"), "snippet", F.col(order).alias("_o"))
    last = F.max_by(F.struct("usage_type", "method_nm", "snippet"), F.struct((F.col("usage_type") == "global").alias("g"), "_o"))
    return rows.groupBy("src", "dst").agg(last.alias("e")).select("src", "dst", "e.*", F.lit(WEIGHT).alias("weight"))


def multi_edges(uses: DataFrame) -> DataFrame:
    """T14', J19: parallel edges that differ in type or snippet, each once."""
    rows = uses.select(node_id("def_path", "def_name").alias("src"), node_id("use_path", "use_method").alias("dst"), F.concat("usage_type", F.lit("_uses")).alias("usage_type"), "snippet")
    return rows.dropDuplicates().withColumn("weight", F.lit(WEIGHT))


def attached_edges(edges: DataFrame, nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges with both ends among the nodes that are not there yet."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out if existing is None else out.join(existing, ["src", "dst", "usage_type", "snippet"], "left_anti")


def with_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Note 9: edges with whether their target is defined."""
    known = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("dst_defined"))
    return edges.join(known, "dst", "left").withColumn("dst_defined", F.coalesce("dst_defined", F.lit(False)))


def duplicate_nodes(methods: DataFrame) -> DataFrame:
    """(path, name, n) of methods that are not unique."""
    return methods.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges)."""
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.agg(F.count(F.lit(1)).alias("n_edges")))


def sample_rows(df: DataFrame, keys: list[str], n: int = 25) -> DataFrame:
    """The first n rows, by the keys, for a look at them."""
    return df.orderBy(*keys).limit(n)


def project(edges: DataFrame, usage_type: str) -> DataFrame:
    """The edges of one type."""
    return edges.where(F.col("usage_type") == usage_type)


def one_hop(changes: DataFrame, edges: DataFrame, nodes: DataFrame, mode: str) -> DataFrame:
    """changes(file, method) with what uses the method: (file, method, impacted_file, impacted_method, snippet).

    A node belongs to a change if it has the method's name and its path is or contains the file. The name is the join's
    key and containment its residue, for all changes at once.
    """
    src = nodes.select(F.col("id").alias("src"), F.col("path").alias("_path"), F.col("name").alias("method"))
    start = changes.select("file", "method").distinct().join(src, "method").where("contains(_path, file)")
    dst = nodes.select(F.col("id").alias("dst"), F.col("path").alias("impacted_file"), F.col("name").alias("impacted_method"))
    return start.join(project(edges, mode), "src").join(dst, "dst").select("file", "method", "impacted_file", "impacted_method", "snippet")


def reachable(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, node, hops) of the nodes reached from sources(source), with the least number of hops; the source itself
    only through a cycle.

    Each round joins the frontier alone and keeps what is new. Rounds are written to the checkpoint folder.
    """
    e = edges.select("src", "dst").distinct()
    frontier = cut_lineage(sources.select("source", F.col("source").alias("src")).distinct().join(e, "src").select("source", F.col("dst").alias("node")).distinct().withColumn("hops", F.lit(1)))
    found, rounds = frontier, 0
    while not frontier.isEmpty() and (max_hops is None or max_hops > 1):
        step = frontier.join(e, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        frontier = cut_lineage(step.join(found, ["source", "node"], "left_anti"), tidy=False)
        found, rounds = found.unionByName(frontier), rounds + 1
        if rounds % 8 == 0:  # else the union has a part for each round
            found = cut_lineage(found.coalesce(max(1, frontier.rdd.getNumPartitions())))
        max_hops = None if max_hops is None else max_hops - 1
    return found


def paths(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(source, path, hops) of all paths of 0 to max_hops edges that use no edge twice.

    Paths multiply with every hop, so the caller says how many hops to go. A path's edges are kept as `src>dst` names.
    """
    e = edges.select("src", "dst").distinct()
    level = sources.select("source", F.array("source").alias("path"), F.expr("cast(array() as array<string>)").alias("used"))
    out = level
    for _ in range(max_hops):
        at = F.element_at("path", -1)
        name = F.concat_ws(">", "src", "dst")
        level = level.join(e, at == F.col("src")).where(~F.array_contains("used", name)).select("source", F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array(name)).alias("used"))
        out = out.unionByName(level)
    return out.select("source", "path", (F.size("path") - 1).alias("hops"))


def path_pairs(found: DataFrame) -> DataFrame:
    """(a, b), the nodes next to each other on some path, each pair once."""
    steps = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))
    return found.where("hops > 0").select(F.explode(steps).alias("s")).select("s.a", "s.b").distinct()


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after so many rounds of rank = (1 - damping) + damping * sum of rank / out-degree over the edges in.

    Ranks are not normalised and start at 1 - damping; what nodes without edges out hold is lost. Edges are unique and
    keep their out-degree from round to round; every few rounds the ranks are written to the checkpoint folder.
    """
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    links = cut_lineage(e.join(out, "src"))
    nodes = cut_lineage(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    rank = nodes.withColumn("rank", F.lit(1 - damping))
    for k in range(iterations):
        sent = links.join(rank, F.col("src") == F.col("node")).groupBy(F.col("dst")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        rank = nodes.join(sent, F.col("node") == F.col("dst"), "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            rank = cut_lineage(rank)
    return rank


def top_ranked(rank: DataFrame, n: int = 10, digits: int = 6) -> DataFrame:
    """O2: the n nodes of the highest rank, equal ones by name."""
    return rank.select("node", F.round("rank", digits).alias("rank")).orderBy(F.desc("rank"), "node").limit(n)


def with_importance(nodes: DataFrame, rank: DataFrame) -> DataFrame:
    """Nodes with their rank written to importance; nodes outside the projection keep theirs."""
    return nodes.join(rank.select(F.col("node").alias("id"), "rank"), "id", "left").withColumn("importance", F.coalesce("rank", "importance")).drop("rank")


def visual_links(links: DataFrame, viz_nodes: DataFrame) -> DataFrame:
    """links(method_nm, target) with the ends' first node of the name; links without both are left out."""
    first = viz_nodes.groupBy("method_nm").agg(F.min("node_id").alias("node_id"))
    a = first.select("method_nm", F.col("node_id").alias("source_node"))
    b = first.select(F.col("method_nm").alias("target"), F.col("node_id").alias("target_node"))
    return links.join(a, "method_nm").join(b, "target").select("method_nm", "target", "source_node", "target_node")
