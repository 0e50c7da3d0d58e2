"""Packing of lines and rows into chunks of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_list, token_estimate

CHUNK_CHARS, CONTEXT_TOKENS, LEAST_WORDS = 4096, 8192, 10


def pack_lines(lines: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """lines(path, lineno, text) -> (path, chunk, first_line, last_line, n_chars).

    Greedy: a line that would take its chunk beyond the limit opens the next one, so that the sums start anew. That makes
    it a fold over a file's line lengths, which are one array a file; texts stay where they are.
    """
    return _packed(lines.select("path", "lineno", F.length("text").alias("size")), limit)


def _packed(sizes: DataFrame, limit: float) -> DataFrame:
    fold = f"""
      aggregate(items, named_struct('total', cast(0 as double), 'chunk', 0, 'out', cast(array() as array<struct<lineno:int,chunk:int,size:double>>)), (s, x) ->
        if(s.total > 0 AND s.total + x.size > {float(limit)}D,
           named_struct('total', x.size, 'chunk', s.chunk + 1, 'out', concat(s.out, array(named_struct('lineno', x.lineno, 'chunk', s.chunk + 1, 'size', x.size)))),
           named_struct('total', s.total + x.size, 'chunk', s.chunk, 'out', concat(s.out, array(named_struct('lineno', x.lineno, 'chunk', s.chunk, 'size', x.size))))),
        s -> s.out)"""
    item = F.struct(F.col("lineno").cast("int").alias("lineno"), F.col("size").cast("double").alias("size"))
    packed = sizes.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("items")).select("path", F.explode(F.expr(fold)).alias("x"))
    return packed.groupBy("path", F.col("x.chunk").alias("chunk")).agg(F.min("x.lineno").alias("first_line"), F.max("x.lineno").alias("last_line"), F.sum("x.size").cast("bigint").alias("n_chars"))


def plan_texts(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """rows(doc, section, line_num, row_values) with the values of `least` words or more, joined by tabs; rows without
    any go."""
    long = F.filter("row_values", lambda v: F.size(F.filter(F.split(v, r"\s+"), lambda w: w != "")) >= least)
    return rows.select("doc", "section", "line_num", F.array_join(long, "\t").alias("text")).where("text <> ''")


def pack_plan(rows: DataFrame, summary_tokens: float = 0.0, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """rows(doc, section, line_num, text) packed into chunks of the tokens that the context leaves beside the
    summary of changes; a section begins a new chunk: (path, chunk, first_line, last_line, n_chars), path `doc/section`."""
    left = limit - summary_tokens
    if left <= 0:
        raise ValueError("the summary of changes takes the whole context")
    return _packed(rows.select(F.concat_ws("/", "doc", "section").alias("path"), F.col("line_num").alias("lineno"), token_estimate("text").alias("size")), left).withColumnRenamed("n_chars", "n_tokens")


def symbols_of_replies(replies: DataFrame) -> DataFrame:
    """replies(path, chunk, first_line, kind, reply) of a scorer that lists the symbols of a chunk -> symbols(path,
    kind, name, line).

    A reply that is no list gives nothing. `name as alias` names both. Of a symbol that several chunks report, because it
    goes on beyond the end of one, the first chunk's line stays.
    """
    listed = replies.select("path", "kind", "chunk", "first_line", F.explode(json_list("reply")).alias("entry"))
    names = listed.select("path", "kind", "first_line", F.explode(F.split("entry", r"\s+as\s+")).alias("name")).where("trim(name) <> ''")
    return names.groupBy("path", "kind", F.trim("name").alias("name")).agg(F.min("first_line").alias("line"))
