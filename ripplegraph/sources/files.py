"""Sources: trees of files, diffs, summaries, configuration and tables of plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalars import basename, ends_with_any

LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "json": "json", "yml": "yaml", "yaml": "yaml"}


def scan_files(spark: SparkSession, root: str, endings: Sequence[str] = (), service: str = "") -> DataFrame:
    """files(service, lang, path, content, mtime) of a tree, with one of the endings if any are named.

    The endings go to the reader as a glob, so that other files are never opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if endings:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(endings) + "}" if len(endings) > 1 else f"*{endings[0]}")
    files = reader.load(root)
    ending = F.lower(F.element_at(F.split(basename("path"), r"\."), -1))
    lang = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ending), F.lit("other"))
    return files.select(F.lit(service).alias("service"), lang.alias("lang"), "path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))


def lines(files: DataFrame) -> DataFrame:
    """(path, lineno, text), lines numbered from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "text")).select("path", (F.col("n") + 1).alias("lineno"), "text")


def snippets(wanted: DataFrame, source_lines: DataFrame) -> DataFrame:
    """wanted(path, first, last) with the lines in between, first and last included, as an array."""
    keys = ["path", "first", "last"]
    inside = wanted.select(*keys).distinct().join(source_lines, "path").where("lineno BETWEEN first AND last")
    found = inside.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "text"))), lambda x: x["text"]).alias("snippet"))
    return wanted.join(found, keys, "left")


def find_by_basename(files: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) with the path of the first file, in order of paths, that is called so."""
    named = files.select(basename("path").alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"))
    return names.join(named, "name", "left")


def diff_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """diff_lines(source, lineno, line) of files of `git diff` output, each read as a whole to keep its order."""
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return text.select("source", F.posexplode(F.split("value", "\n", -1)).alias("n", "line")).select("source", (F.col("n") + 1).alias("lineno"), "line")


def git_repositories(manifest: DataFrame, col: str = "path") -> DataFrame:
    """H5: directories of a manifest of paths that hold a .git folder."""
    hit = F.regexp_extract(F.col(col), r"^(.*)/\.git(/|$)", 1)
    return manifest.select(hit.alias("repository")).where("repository <> ''").distinct()


def read_summaries(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, path, methods, inter_service_api_call, global_usage_local_api_call) of summary documents."""
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.from_json("value", schema.SUMMARY).alias("doc"))
    rows = text.select("source", F.explode("doc").alias("path", "file"))
    return rows.select("source", "path", F.col("file.method_details_").alias("methods"), "file.inter_service_api_call", "file.global_usage_local_api_call")


def merged_summaries(summaries: DataFrame) -> DataFrame:
    """One row a path; the last source, in order of names, wins."""
    order = Window.partitionBy("path").orderBy(F.desc("source"))
    return summaries.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def methods_of(summaries: DataFrame) -> DataFrame:
    """One row a method of summaries, with its path; methods without a range have nulls."""
    return summaries.select("path", F.explode("methods").alias("m")).select("path", "m.*")


def keyed_path(path: str = "path"):
    """the path with './' in front unless it is there somewhere."""
    return F.when(~F.col(path).contains("./"), F.concat(F.lit("./"), F.col(path))).otherwise(F.col(path))


def read_usage_sample(spark: SparkSession, path: str) -> DataFrame:
    """A table of (method, defining file, calling file, parameters) with a header."""
    return spark.read.csv(path, header=True, multiLine=True)


def plan_kind(path: str = "path"):
    """What reader a plan's file needs; null if none does."""
    return F.when(ends_with_any(path, [".xlsx", ".xls"]), "XL").when(ends_with_any(path, [".docx"]), "DOC")


def read_plan_tables(files: DataFrame) -> DataFrame:
    """plan_rows(doc, section, line_num, text) of workbooks given as (path, bytes); a sheet is a section, the
    cells of a row that are not empty are joined by tabs.

    An XLSX file is a zip of XML and read as such. Other workbooks need a reader that pandas finds; without one they fail.
    """

    def kernel(frames):
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            out = []
            for path, data in zip(frame["path"], frame["bytes"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(data)):
                    sheets = workbook_rows(data)
                else:
                    found = pd.read_excel(io.BytesIO(data), sheet_name=None, header=None)
                    sheets = [(str(name), k, [str(v) for v in row if pd.notna(v)]) for name, sheet in found.items() for k, row in enumerate(sheet.itertuples(index=False), 1)]
                out += [(path, name, k, "\t".join(cells)) for name, k, cells in sheets]
            yield pd.DataFrame(out, columns=["doc", "section", "line_num", "text"])

    return files.select("path", F.col("bytes")).mapInPandas(kernel, "doc string, section string, line_num int, text string")


def workbook_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, texts of the cells that are not empty) of an XLSX file, sheets in the workbook's order."""
    import io
    import zipfile
    from posixpath import join, normpath
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2]
    named = lambda e, name: (x for x in e.iter() if local(x) == name)
    text = lambda e: "".join(t.text or "" for t in named(e, "t"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = lambda part: ElementTree.fromstring(z.read(part))
        there = set(z.namelist())
        shared = [text(e) for e in named(xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in there else []
        target = {e.get("Id"): e.get("Target") for e in xml("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in named(xml("xl/workbook.xml"), "sheet"):
            link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            part = target[link].lstrip("/") if target[link].startswith("/") else normpath(join("xl", target[link]))
            for k, row in enumerate(named(xml(part), "row"), 1):
                cells = []
                for cell in named(row, "c"):
                    value = next((v.text or "" for v in named(cell, "v")), "")
                    kind = cell.get("t")
                    cells.append(shared[int(value)] if kind == "s" and value else text(cell) if kind == "inlineStr" else value)
                out.append((sheet.get("name"), int(row.get("r") or k), [c for c in cells if c]))
    return out


def read_plan_documents(files: DataFrame) -> DataFrame:
    """plan_rows(doc, section, line_num, text) of DOCX files given as (path, bytes).

    A DOCX file is a zip of XML: paragraphs of a heading style open a section, other paragraphs are rows of it.
    """

    def kernel(frames):
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for frame in frames:
            out = []
            for path, data in zip(frame["path"], frame["bytes"], strict=True):
                try:
                    tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                section, k = None, 0
                for p in tree.iter(f"{w}p"):
                    text = "".join(t.text or "" for t in p.iter(f"{w}t")).strip()
                    style = p.find(f"{w}pPr/{w}pStyle")
                    if style is not None and style.get(f"{w}val", "").startswith("Heading"):
                        section = text
                    elif text:
                        k += 1
                        out.append((path, section, k, text))
            yield pd.DataFrame(out, columns=["doc", "section", "line_num", "text"])

    return files.select("path", F.col("bytes")).mapInPandas(kernel, "doc string, section string, line_num int, text string")


def search_words(source_lines: DataFrame, names: DataFrame, exclude_dir: str | None = None, endings: Sequence[str] = (".js", ".py", ".java")) -> DataFrame:
    """H1: (name, path, lineno, text) of lines with a whole word of names(name): many words at once by a join on words."""
    kept = source_lines.where(ends_with_any("path", endings))
    if exclude_dir:
        kept = kept.where(~F.col("path").contains(exclude_dir))
    words = kept.select("path", "lineno", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("name"))
    return words.join(names.select("name").distinct(), "name").select("name", "path", "lineno", "text")
