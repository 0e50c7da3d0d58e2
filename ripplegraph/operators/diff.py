"""Diffs: hunks from the lines of `git diff` output, and the methods that they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ends_with_any

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
STRICT_HEADER = r"^@@ -(\d+),(\d+) \+(\d+),(\d+) @@"
FILE = r"^diff --git a/(\S+) b/"
#: Endings of files whose changes count.
ENDINGS = (".js", ".py", ".java")


def _changed(line: Column, compat: bool) -> Column:
    """whether a line is one of a hunk's changes; with compat, doubled signs anywhere rule it out."""
    signed = line.startswith("+") | line.startswith("-")
    return signed & ~(line.contains("--") | line.contains("++")) if compat else signed


def parse_hunks(lines: DataFrame, endings: Sequence[str] = ENDINGS, compat: bool = False) -> DataFrame:
    """diff_lines(source, lineno, line) -> (source, hunk, file, old_start, old_length, new_start,
    new_length, old_code, new_code).

    File and hunk headers are carried down the lines of their source by windows; each source is ordered by itself. The
    lines that a header announces belong to its hunk, and `---`, `+++` and index lines between hunks to none. Lengths
    that a header leaves out are 1. With compat, headers without lengths open no hunk and lines with -- or ++ are lost.
    """
    header = STRICT_HEADER if compat else HEADER
    down = Window.partitionBy("source").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    is_hunk, is_file = F.col("line").startswith("@@ "), F.col("line").startswith("diff --git ")
    carried = lines.select(
        "source",
        "lineno",
        "line",
        F.last(F.when(is_file, F.nullif(F.regexp_extract("line", FILE, 1), F.lit(""))), ignorenulls=True).over(down).alias("file"),
        F.count(F.when(is_hunk, 1)).over(down).alias("hunk"),
        F.last(F.when(is_hunk | is_file, F.struct("line", "lineno")), ignorenulls=True).over(down).alias("head"),
    )
    number = lambda k: F.nullif(F.regexp_extract("head.line", header, k), F.lit("")).cast("int")
    length = lambda k: number(k) if compat else F.coalesce(number(k), F.lit(1))
    parsed = carried.where(F.col("head.line").rlike(header) & ends_with_any("file", endings)).select(
        "source", "hunk", "file", "lineno", "line", number(1).alias("old_start"), length(2).alias("old_length"), number(3).alias("new_start"), length(4).alias("new_length"), (F.col("lineno") == F.col("head.lineno")).alias("is_head")
    )
    # a hunk is over once its announced lines have passed; headers of the next file can then look like changes
    up_to = Window.partitionBy("source", "hunk").orderBy("lineno").rowsBetween(Window.unboundedPreceding, -1)
    text = ~F.col("is_head") & ~F.col("line").startswith("\\")
    seen = lambda *signs: F.coalesce(F.count(F.when(text & ~F.substring("line", 1, 1).isin(*signs), 1)).over(up_to), F.lit(0))
    inside = parsed.withColumn("_old", seen("+")).withColumn("_new", seen("-")).where("is_head OR _old < old_length OR _new < new_length")
    changed = ~F.col("is_head") & _changed(F.col("line"), compat)
    code = lambda sign: F.transform(
        F.array_sort(F.collect_list(F.when(changed & F.col("line").startswith(sign), F.struct("lineno", F.substring("line", 2, 1 << 30).alias("text"))))), lambda x: F.concat(x["text"], F.lit("\n"))
    )
    keys = ["source", "hunk", "file", "old_start", "old_length", "new_start", "new_length"]
    return inside.groupBy(*keys).agg(code("-").alias("old_code"), code("+").alias("new_code"))


def attribute_hunks(hunks: DataFrame, methods: DataFrame) -> DataFrame:
    """Hunks with old_method and new_method, the names of methods(path, name, start_line, end_line) around the
    hunk's old and new start, first and last line included; of several the last one in source order. Null if none.

    Each side is an equi-join on the path with a range test; methods without a range match nothing. Paths with and
    without './' in front are the same.
    """
    plain = lambda c: F.regexp_replace(c, r"^\./", "")
    m = methods.where("start_line IS NOT NULL AND end_line IS NOT NULL").select(plain("path").alias("_path"), "name", "start_line", "end_line")
    keyed = hunks.withColumn("_path", plain("file"))
    starts = keyed.select("_path", F.explode(F.array("old_start", "new_start")).alias("at")).distinct()
    hit = starts.join(m, "_path").where("at BETWEEN start_line AND end_line").groupBy("_path", "at").agg(F.max_by("name", F.struct("start_line", "end_line")).alias("method"))
    out = keyed
    for side in ("old", "new"):
        out = out.join(hit.select("_path", F.col("at").alias(f"{side}_start"), F.col("method").alias(f"{side}_method")), ["_path", f"{side}_start"], "left")
    return out.select(*hunks.columns, "old_method", "new_method")


def changed_file_match(files: DataFrame, keys: DataFrame) -> DataFrame:
    """files(file) with the first of keys(key), in order, that contains the file's name; 'NA' if none does.

    Containment has no key to join on; keys is the smaller side, and the pairs that match are reduced at once.
    """
    hit = files.select("file").distinct().join(keys.select("key").distinct(), F.expr("contains(key, file)")).groupBy("file").agg(F.min("key").alias("key"))
    return files.join(hit, "file", "left").withColumn("key", F.coalesce("key", F.lit("NA")))
