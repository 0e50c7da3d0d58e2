"""Definitions and their uses, inside a file and across files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enclosing_methods(points: DataFrame, methods: DataFrame, strict: bool = True) -> DataFrame:
    """points(path, lineno, ..) with the first method, by source order, around the line: method, method_start, method_end.

    Strictly between the method's first and last line, or with these included. An equi-join on the path with a range
    test; the smallest match is an aggregate, so that no window has to sort whole files.
    """
    test = "lineno > start_line AND lineno < end_line" if strict else "lineno BETWEEN start_line AND end_line"
    m = methods.select("path", "name", "start_line", "end_line")
    hit = points.select("path", "lineno").distinct().join(m, "path").where(test).groupBy("path", "lineno").agg(F.min_by(F.struct("name", "start_line", "end_line"), F.struct("start_line", "name")).alias("m"))
    return points.join(hit, ["path", "lineno"], "left").select(*points.columns, F.col("m.name").alias("method"), F.col("m.start_line").alias("method_start"), F.col("m.end_line").alias("method_end"))


def local_uses(methods: DataFrame, facts: DataFrame) -> DataFrame:
    """(def_path, def_name, use_path, use_line, use_method) of calls in the file that defines the name."""
    hit = methods.select("path", "name").distinct().join(facts.select("path", "lineno", F.col("function").alias("name")), ["path", "name"])
    return _with_method(hit.select(F.col("path").alias("def_path"), F.col("name").alias("def_name"), "path", "lineno"), methods)


def global_uses(methods: DataFrame, facts: DataFrame) -> DataFrame:
    """The same of calls in other files, by bare name.

    A hash join on the name with the files' difference as its residue; adaptive execution splits hot names.
    """
    defs = methods.select(F.col("path").alias("def_path"), F.col("name").alias("def_name")).distinct()
    hit = defs.join(facts.select("path", "lineno", "function"), (F.col("def_name") == F.col("function")) & (F.col("def_path") != F.col("path")))
    return _with_method(hit.select("def_path", "def_name", "path", "lineno"), methods)


def _with_method(hit: DataFrame, methods: DataFrame) -> DataFrame:
    around = enclosing_methods(hit, methods)
    return around.select("def_path", "def_name", F.col("path").alias("use_path"), F.col("lineno").alias("use_line"), F.col("method").alias("use_method"), F.col("method_start").alias("use_start"), F.col("method_end").alias("use_end"))


def grouped_uses(uses: DataFrame, source_lines: DataFrame) -> DataFrame:
    """(def_path, def_name, uses array<struct<file_path,method_nm,method_defn,usage,method_end>>), with snippets."""
    text = lambda at, name: source_lines.select(F.col("path").alias("use_path"), F.col("lineno").alias(at), F.trim("text").alias(name))
    rows = uses.join(text("use_line", "usage"), ["use_path", "use_line"], "left").join(text("use_start", "method_defn"), ["use_path", "use_start"], "left").join(text("use_end", "method_end"), ["use_path", "use_end"], "left")
    per_method = rows.groupBy("def_path", "def_name", "use_path", "use_method").agg(
        F.first("method_defn", ignorenulls=True).alias("method_defn"),
        F.transform(F.array_sort(F.collect_set(F.struct("use_line", "usage"))), lambda x: x["usage"]).alias("usage"),
        F.first("method_end", ignorenulls=True).alias("method_end"),
    )
    use = F.struct(F.col("use_path").alias("file_path"), F.coalesce("use_method", F.lit("NA")).alias("method_nm"), "method_defn", "usage", "method_end")
    return per_method.groupBy("def_path", "def_name").agg(F.array_sort(F.collect_list(use)).alias("uses"))


def word_uses(names: DataFrame, source_lines: DataFrame, most: int = 1) -> DataFrame:
    """(def_path, name, use_path, lineno) of calls of names(path, name, arity) as whole words in other files whose
    number of arguments differs by `most` at the utmost."""
    calls = source_lines.select(F.col("path").alias("use_path"), "lineno", F.explode(F.regexp_extract_all("text", F.lit(r"(\b\w+\s*\([^()]*\))"), F.lit(1))).alias("call"))
    inside = F.trim(F.regexp_extract("call", r"\((.*)\)", 1))
    parsed = calls.select("use_path", "lineno", F.regexp_extract("call", r"^(\w+)", 1).alias("name"), F.when(inside == "", 0).otherwise(F.size(F.split(inside, ","))).alias("given"))
    hit = parsed.join(names.select(F.col("path").alias("def_path"), "name", "arity"), "name").where(f"def_path <> use_path AND abs(arity - given) <= {int(most)}")
    return hit.select("def_path", "name", "use_path", "lineno").distinct()


def symbol_uses(symbols: DataFrame, methods: DataFrame, source_lines: DataFrame, ratio: int | None = None) -> DataFrame:
    """(name, kind, path, method, lineno) of symbols(path, kind, name) in lines of methods that define nothing.

    A symbol is used where its whole name stands or, with a ratio, where a word of the line is as similar as that in
    percent; whether the use is local or global follows from the paths.
    """
    from ..functions.scalars import fuzzy_ratio

    inside = enclosing_methods(source_lines.where("NOT contains(text, 'def ')"), methods, strict=False).where("method IS NOT NULL")
    words = inside.select("path", "method", "lineno", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    s = symbols.select(F.col("path").alias("def_path"), "kind", "name").distinct()
    if ratio is None:
        hit = words.join(s, F.col("word") == F.col("name"))
    else:  # similar words agree in length up to what the ratio leaves; different words and names only are compared
        least, most = (F.expr(f"cast({x} as int)") for x in (f"ceil({int(ratio)} * length(name) / (200 - {int(ratio)}))", f"floor((200 - {int(ratio)}) * length(name) / {max(int(ratio), 1)})"))
        names = s.select("name").distinct().withColumn("size", F.explode(F.sequence(least, F.greatest(least, most))))
        near = words.select("word", F.length("word").alias("size")).distinct().join(names, "size").where(fuzzy_ratio("word", "name") >= ratio)
        hit = words.join(near.select("word", "name"), "word").join(s, "name")
    return hit.select("name", "kind", "def_path", "path", "method", "lineno", F.when(F.col("def_path") == F.col("path"), "local").otherwise("global").alias("usage_type")).distinct()


def method_ends(starts: DataFrame, last_lines: DataFrame) -> DataFrame:
    """starts(path, name, start_line) with end_line, the line before the next method, or last_lines(path, n_lines);
    methods that begin on one line are one."""
    order = Window.partitionBy("path").orderBy("start_line")
    one = starts.groupBy("path", "start_line").agg(F.min("name").alias("name"))
    ahead = one.withColumn("_next", F.lead("start_line").over(order)).join(last_lines, "path", "left")
    return ahead.select("path", "name", "start_line", F.coalesce(F.col("_next") - 1, F.col("n_lines")).alias("end_line"))


def true_variables(variables: DataFrame, packages: DataFrame) -> DataFrame:
    """U8: variables(path, name) that are no packages of the same file."""
    return variables.join(packages.select("path", "name"), ["path", "name"], "left_anti")


def reported_lines(names: DataFrame, source_lines: DataFrame) -> DataFrame:
    """names(path, name) with the first line that contains the name, or the file's last `return`."""
    returns = source_lines.where("contains(text, 'return')").groupBy("path").agg(F.max("lineno").alias("_fallback"))
    hit = names.select("path", "name").distinct().join(source_lines, "path").where("contains(text, name)").groupBy("path", "name").agg(F.min("lineno").alias("line"))
    return names.join(hit, ["path", "name"], "left").join(returns, "path", "left").select(*names.columns, F.coalesce("line", "_fallback").alias("line"))
