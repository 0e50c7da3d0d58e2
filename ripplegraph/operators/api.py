"""Routes, urls and the calls between services."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, last_segments, segments, url_match


def match_urls(definitions: DataFrame, calls: DataFrame, compat: bool = False) -> DataFrame:
    """definitions(def_id, def_base, def_url) and calls(call_id, call_base, call_url) of different code bases whose
    urls match: (def_id, call_id, primary).

    By default a url's query and fragment are no part of it, and the shorter url's last two segments must stand, whole, in
    the longer one. With compat, url_match() holds to the letter: queries stay, and the two segments may be parts of others.
    Candidates come from keys that a match has in common: two whole segments, or with compat what stands on both sides of
    the slash between them, three characters at most; and the last segments for a secondary match.
    """
    clean = (lambda c: F.col(c)) if compat else (lambda c: F.substring_index(F.substring_index(c, "?", 1), "#", 1))
    d = definitions.select(clean("def_url").alias("d")).where("d IS NOT NULL").distinct()
    c = calls.select(clean("call_url").alias("c")).where("c IS NOT NULL").distinct()
    last = lambda col: F.concat(F.lit("\n"), basename(col))
    parts = lambda df, col: df.withColumn("s", segments(col))
    if compat:
        around = "flatten(transform(sequence(0, least(3, length(get(s, k - 2)))), a -> transform(sequence(1, least(3, length(get(s, k - 1)))), b -> concat(right(get(s, k - 2), a), '/', left(get(s, k - 1), b)))))"
        inside = F.expr(f"flatten(transform(sequence(2, greatest(size(s), 2)), k -> IF(coalesce(length(get(s, k - 1)), 0) = 0, cast(array() as array<string>), {around})))")
        own = F.expr("concat(right(get(s, size(s) - 2), 3), '/', left(get(s, size(s) - 1), 3))")
    else:
        inside = F.expr("transform(sequence(2, greatest(size(s), 2)), k -> concat(get(s, k - 2), '/', get(s, k - 1)))")
        own = F.expr("concat(get(s, size(s) - 2), '/', get(s, size(s) - 1))")
    every = lambda df, col: parts(df, col).select(col, F.explode(F.array_distinct(F.concat(inside, F.array(last(col))))).alias("key")).where("key IS NOT NULL")
    ends = lambda df, col: parts(df, col).select(col, F.explode(F.array(own, last(col))).alias("key")).where("key IS NOT NULL")
    pairs = every(d, "d").join(ends(c, "c"), "key").select("d", "c").union(ends(d, "d").join(every(c, "c"), "key").select("d", "c")).distinct()
    hit = pairs.withColumn("m", url_match("c", "d"))
    if not compat:
        short = F.when(F.length("c") < F.length("d"), F.col("c")).otherwise(F.col("d"))
        long = F.when(F.length("c") < F.length("d"), F.col("d")).otherwise(F.col("c"))
        whole = F.concat(F.lit("/"), long, F.lit("/")).contains(F.concat(F.lit("/"), last_segments(short, 2), F.lit("/")))
        hit = hit.withColumn("m", F.struct((F.col("m.primary") & whole).alias("primary"), F.col("m.secondary").alias("secondary")))
    hit = hit.where("m.primary OR m.secondary").select("d", "c", F.col("m.primary").alias("primary"))
    rows = definitions.withColumn("d", clean("def_url")).join(hit, "d").join(calls.withColumn("c", clean("call_url")), "c").where("def_base <> call_base")
    return rows.groupBy("def_id", "call_id").agg(F.bool_or("primary").alias("primary"))


def inter_service_uses(definitions: DataFrame, calls: DataFrame, changed: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """(def_path, def_method, use_path, use_method, certain) between methods(base, path, method, urls).

    Calls can be narrowed to changed(file), whose names a path must contain; that happens before urls are compared.
    Pairs are unique; `certain` tells primary matches from those that only end alike.
    """
    if changed is not None:
        names = changed.select("file").distinct()
        calls = calls.join(names, F.expr("contains(path, file)"), "left_semi")
    d = definitions.select(F.struct("path", "method").alias("def_id"), F.col("base").alias("def_base"), F.explode("urls").alias("def_url"))
    c = calls.select(F.struct("path", "method").alias("call_id"), F.col("base").alias("call_base"), F.explode("urls").alias("call_url"))
    found = match_urls(d, c, compat)
    return found.select(F.col("def_id.path").alias("def_path"), F.col("def_id.method").alias("def_method"), F.col("call_id.path").alias("use_path"), F.col("call_id.method").alias("use_method"), F.col("primary").alias("certain"))


def url_usages(assignments: DataFrame, calls: DataFrame) -> DataFrame:
    """calls(path, var, line) with the url of the variable's last assignment(path, var, line, url) above them."""
    hit = calls.alias("c").join(assignments.alias("a"), F.expr("c.path = a.path AND c.var = a.var AND a.line < c.line"))
    return hit.groupBy("c.path", "c.var", F.col("c.line").alias("call_line")).agg(F.max("a.line").alias("defined_line"), F.max_by("a.url", "a.line").alias("url"))


def contract_uses(routes: DataFrame, urls: DataFrame, usages: DataFrame) -> DataFrame:
    """routes(def_path, route_path) whose last segment is that of urls(path, var, url), and usages(path, var, line) of
    the variable: (def_path, route_path, path, var, line)."""
    named = routes.withColumn("_tail", basename("route_path")).where("_tail <> ''").join(urls.withColumn("_tail", basename("url")), "_tail")
    return named.select("def_path", "route_path", "path", "var").distinct().join(usages, ["path", "var"]).select("def_path", "route_path", "path", "var", "line")


def contract_lines(routes: DataFrame, assignment_lines: DataFrame) -> DataFrame:
    """J6': assignments (path, line, text) in functions whose source line contains a route's last segment.

    The segment is looked up among the line's words, so that this is an equi-join and not a comparison of all with all.
    """
    words = assignment_lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w-]+)"), F.lit(1)))).alias("_tail"))
    return routes.withColumn("_tail", basename("route_path")).join(words, "_tail").select("def_path", "route_path", "path", "line").distinct()


def url_index(rows: DataFrame) -> DataFrame:
    """(url, var, path, is_definition, lines, methods) of rows(url, var, path, line, method, is_definition)."""
    return rows.groupBy("url", "var", "path").agg(
        F.bool_or("is_definition").alias("is_definition"), F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.collect_set("method")).alias("methods")
    )


def definition_flags(index: DataFrame) -> DataFrame:
    """(url, defined): whether any file defines it."""
    return index.groupBy("url").agg(F.bool_or("is_definition").alias("defined"))


def classified_calls(index: DataFrame, methods: DataFrame) -> DataFrame:
    """methods(path, name) with local_api_call and inter_service_api_call, the urls that they use and that some file
    here defines, or none does."""
    used = index.join(definition_flags(index), "url").select("path", F.explode("methods").alias("name"), "url", "defined")
    lists = used.groupBy("path", "name").agg(
        F.array_sort(F.collect_set(F.when(F.col("defined"), F.col("url")))).alias("local_api_call"), F.array_sort(F.collect_set(F.when(~F.col("defined"), F.col("url")))).alias("inter_service_api_call")
    )
    none = F.expr("cast(array() as array<string>)")
    return methods.select("path", "name").distinct().join(lists, ["path", "name"], "left").select("path", "name", *(F.coalesce(c, none).alias(c) for c in ("local_api_call", "inter_service_api_call")))


def file_level_calls(index: DataFrame) -> DataFrame:
    """(path, urls) that a file uses outside any method, each once."""
    return index.where("size(methods) = 0").groupBy("path").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def merged_api(methods: DataFrame, api: DataFrame) -> DataFrame:
    """methods(path, name, global_uses) with those of api(path, name, global_uses) added, each use once (note 4)."""
    both = methods.select("path", "name", "global_uses").unionByName(api.select("path", "name", "global_uses").join(methods.select("path", "name"), ["path", "name"], "left_semi"))
    uses = both.select("path", "name", F.explode_outer("global_uses").alias("u"))
    return uses.groupBy("path", "name").agg(F.array_sort(F.collect_set("u")).alias("global_uses"))


def routed_methods(methods: DataFrame, routes: DataFrame) -> DataFrame:
    """Script methods(path, name) with api_end_points, the urls of routes(handler, url) that they handle."""
    urls = routes.groupBy(F.col("handler").alias("name")).agg(F.array_sort(F.collect_set("url")).alias("api_end_points"))
    return methods.join(urls, "name", "left").withColumn("api_end_points", F.coalesce("api_end_points", F.expr("cast(array() as array<string>)")))


def classified_endpoints(calls: DataFrame, local: DataFrame, external: DataFrame) -> DataFrame:
    """calls(call_id, path) as intra, with the local handler of the path; inter, with the first external code base, in
    order of names, that has it; or not_found."""
    mine = local.groupBy("path").agg(F.min("handler").alias("_mine"))
    theirs = external.groupBy("path").agg(F.min("base").alias("_base"), F.min_by("handler", F.struct("base", "handler")).alias("_theirs"))
    both = calls.join(mine, "path", "left").join(theirs, "path", "left")
    kind = F.when(F.col("_mine").isNotNull(), "intra").when(F.col("_base").isNotNull(), "inter").otherwise("not_found")
    return both.select(*calls.columns, kind.alias("kind"), F.when(F.col("_mine").isNull(), F.col("_base")).alias("base"), F.coalesce("_mine", "_theirs").alias("handler"))


def unmatched_endpoints(calls: DataFrame, *known: DataFrame) -> DataFrame:
    """Calls whose path no table of handlers has."""
    for k in known:
        calls = calls.join(k.select("path"), "path", "left_anti")
    return calls


def last_rank(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
