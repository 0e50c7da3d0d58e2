"""Impact of changes: context windows, scores, reports and owners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import criticality, impact_prompt

#: A window at most this long is not worth it; a window that begins so far from the change begins at the change.
LEAST_LINES, LATE_START, AROUND = 5, 10, 20


def target_spans(facts: DataFrame) -> DataFrame:
    """(path, method, target, first, last, next_target): where each target of facts(path, method, lineno, targets,
    values) is assigned, the last line that reads it, and the first target there."""
    keys = ["path", "method"]
    targets = facts.select(*keys, "lineno", F.explode("targets").alias("target"))
    # a name that is assigned again keeps the last line that does so
    first = targets.groupBy(*keys, "target").agg(F.max("lineno").alias("first"))
    reads = facts.select(*keys, "lineno", F.try_element_at("targets", F.lit(1)).alias("head"), F.explode("values").alias("target"))
    last = reads.groupBy(*keys, "target").agg(F.max("lineno").alias("last"), F.max_by("head", "lineno").alias("next_target"))
    return first.join(last, [*keys, "target"], "left").select(*keys, "target", "first", "last", "next_target")


def sphere_of_influence(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """A7, A8, note 17: changes(change_id, path, method, targets) with (first, last), the lines from the first assignment of
    a changed name to the last read of it and of what it flows into; null if nothing reads them.

    A fold over the method's spans in line order: each changed name is followed from target to next target. A method's
    spans are one array, bounded by its lines.
    """
    span = F.struct("first", "target", "last", "next_target")
    lists = spans.where("last IS NOT NULL").groupBy("path", "method").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    follow = """
      aggregate(targets, named_struct('first', cast(null as int), 'last', cast(null as int)), (acc, t) ->
        aggregate(spans, named_struct('at', t, 'first', acc.first, 'last', acc.last), (s, x) ->
          if(x.target = s.at, named_struct('at', x.next_target, 'first', least(s.first, x.first), 'last', greatest(s.last, x.last)), s),
          s -> named_struct('first', s.first, 'last', s.last)))"""
    found = changes.join(lists, ["path", "method"], "left").withColumn("_w", F.expr(f"if(spans IS NULL, null, {follow})"))
    return found.select(*changes.columns, F.col("_w.first").alias("first"), F.col("_w.last").alias("last"))


def review_ranges(changes: DataFrame) -> DataFrame:
    """changes(.., new_start, method_begin, method_end, first, last) with (begin, end), the lines to look at.

    The whole method where the window is empty, inverted, or no longer than LEAST_LINES; what begins LATE_START lines or
    more away from the change begins at it. first and last count from the method's first line.
    """
    span = F.col("last") - F.col("first")
    whole = F.col("first").isNull() | F.col("last").isNull() | (span <= LEAST_LINES)
    begin = F.when(whole, F.col("method_begin")).otherwise(F.col("method_begin") + F.col("first") - 1)
    end = F.when(whole, F.col("method_end")).otherwise(F.col("method_begin") + F.col("last"))
    clamped = F.when(F.abs(begin - F.col("new_start")) >= LATE_START, F.col("new_start")).otherwise(begin)
    return changes.withColumn("begin", clamped).withColumn("end", end)


def line_windows(points: DataFrame, file_sizes: DataFrame, around: int = AROUND) -> DataFrame:
    """points(path, lineno, ..) with (first, last), so many lines around, inside the file of n_lines."""
    return points.join(file_sizes.select("path", "n_lines"), "path").withColumn("first", F.greatest(F.col("lineno") - around, F.lit(1))).withColumn("last", F.least(F.col("lineno") + around, F.col("n_lines")))


def find_ranges(wanted: DataFrame, methods: DataFrame) -> DataFrame:
    """wanted(basename, method) with the range of the first such method, by path."""
    named = methods.select(F.element_at(F.split("path", "/"), -1).alias("basename"), F.col("name").alias("method"), "path", "start_line", "end_line")
    first = named.groupBy("basename", "method").agg(F.min_by(F.struct("path", "start_line", "end_line"), F.struct("path", "start_line")).alias("m"))
    return wanted.join(first, ["basename", "method"], "left").select(*wanted.columns, "m.path", "m.start_line", "m.end_line")


def entry_points(wanted: DataFrame, methods: DataFrame, source_lines: DataFrame) -> DataFrame:
    """wanted(basename, method, needle) with the first line inside such a method that contains the needle."""
    named = methods.select(F.element_at(F.split("path", "/"), -1).alias("basename"), F.col("name").alias("method"), "path", "start_line", "end_line")
    inside = wanted.join(named, ["basename", "method"]).join(source_lines, "path").where("lineno BETWEEN start_line AND end_line AND contains(text, needle)")
    first = inside.groupBy("basename", "method", "needle").agg(F.min_by(F.struct("path", "lineno"), F.struct("path", "lineno")).alias("m"))
    return wanted.join(first, ["basename", "method", "needle"], "left").select(*wanted.columns, "m.path", "m.lineno")


def changed_name_scorer(prompts: pd.Series) -> pd.Series:
    """A stand-in for a language model: longer changes are more critical."""
    size = prompts.fillna("").str.len()
    return "Criticality: " + (size // 200).clip(upper=5).astype(str) + "\nThe change touches " + size.astype(str) + " characters."


def score(impacts: DataFrame, scorer: Callable[[pd.Series], pd.Series] | None = None, prompt: Column | None = None) -> DataFrame:
    """S25, X11, X9, ST6: impacts(method_context, new_code, old_code, ..) with impact_analysis and criticality.

    The scorer gets batches of prompts and may call what it likes, at its own pace; without one both columns are null.
    """
    if scorer is None:
        return impacts.withColumn("impact_analysis", F.lit(None).cast("string")).withColumn("criticality", F.lit(None).cast("int"))

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield scorer(batch)

    text = impact_prompt(F.col("method_context"), F.col("new_code"), F.col("old_code")) if prompt is None else prompt
    return impacts.withColumn("impact_analysis", answers(text)).withColumn("criticality", criticality("impact_analysis"))


def serious(impacts: DataFrame, least: int = 3) -> DataFrame:
    """F12."""
    return impacts.where(F.col("criticality") >= least)


def downstream(global_hits: DataFrame, local_hits: DataFrame, keys: list[str]) -> DataFrame:
    """Note 15: a change's global uses or, only if it has none, its local ones, with impact_type."""
    only = local_hits.join(global_hits.select(*keys).distinct(), keys, "left_anti")
    return global_hits.withColumn("impact_type", F.lit("global")).unionByName(only.withColumn("impact_type", F.lit("local")))


def impacts_per_change(changes: DataFrame, impacts: DataFrame, keys: list[str]) -> DataFrame:
    """Changes with their impacts as an array, in order."""
    rest = [c for c in impacts.columns if c not in keys]
    lists = impacts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("impacts"))
    return changes.join(lists, keys, "left")


def viz_nodes(changes: DataFrame) -> DataFrame:
    """Changes with a context, one row each."""
    return changes.where("method_context IS NOT NULL").select(F.concat_ws("::", "file", "method").alias("node_id"), F.col("method").alias("method_nm"), "old_code", "new_code", F.col("new_start").alias("ln_no"), "method_context", "criticality", "impact_analysis")


def viz_links(impacts: DataFrame) -> DataFrame:
    """(method_nm, global_uses, local_uses, snippets) of each changed method, its users by their last two path
    parts."""
    short = F.array_join(F.slice(F.split("impacted_method", "/"), F.greatest(F.size(F.split("impacted_method", "/")) - 1, F.lit(1)), 2), "/")
    use = lambda kind: F.array_sort(F.collect_set(F.when(F.col("impact_type") == kind, short)))
    return impacts.groupBy(F.col("method").alias("method_nm")).agg(use("global").alias("global_uses"), use("local").alias("local_uses"), F.array_sort(F.collect_set("snippet")).alias("snippets"))


def route_owners(impacts: DataFrame, owners: DataFrame, default: str) -> DataFrame:
    """impacts(.., impacted_file) with the owner of the first repository, by name, that the path contains.

    Only different paths are compared, with different repositories; the best one is an aggregate.
    """
    rows = owners.select("repo", "owner").distinct()
    hit = impacts.select("impacted_file").distinct().join(rows, F.expr("contains(impacted_file, repo)")).groupBy("impacted_file").agg(F.min_by("owner", F.struct("repo", "owner")).alias("owner"))
    return impacts.join(hit, "impacted_file", "left").withColumn("owner", F.coalesce("owner", F.lit(default)))


def change_report(changes: DataFrame, summary: DataFrame) -> DataFrame:
    """Changes whose file has a global use, with the uses' files and the last use's method and route."""
    used = summary.where("usage_type = 'global'").groupBy("file").agg(
        F.array_sort(F.collect_set("impacted_file")).alias("impacted_files"), F.max_by("impacted_method", "ord").alias("last_method"), F.max_by("api_end_point", "ord").alias("last_end_point")
    )
    return changes.join(used, "file")


def plan_results(rows: DataFrame) -> DataFrame:
    """(key, results) in order of rows(key, ord, result)."""
    return rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "result"))), lambda x: x["result"]).alias("results"))
