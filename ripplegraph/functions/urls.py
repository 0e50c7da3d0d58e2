"""Regular expressions for urls in source text, and walks through configuration documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Patterns of literal urls, of configured ones and of those named by the environment.
LITERAL = r"(https?://[^\s\"'`<>\])},;]+)"
CONFIGURED = r"[\"']([A-Z_]+)[\"']\s*:\s*[\"'](https?://[^\s\"']+)[\"']"
ENVIRONMENT = r"os\.environ\[[\"']([A-Z_]+)[\"']\]"
#: Absolute urls and quoted paths in script sources.
SCRIPT = r"(https?://[^\s\"'`]+|/[^\s\"'`]+)"


def literal_urls(text: Column) -> Column:
    """Urls of a text without the quotes, commas and brackets that follow them (note 19)."""
    return F.regexp_extract_all(text, F.lit(LITERAL), F.lit(1))


def scan_urls(files: DataFrame) -> DataFrame:
    """(path, kind, var, url) by the three patterns; kind is literal, config or env."""
    literal = files.select("path", F.lit("literal").alias("kind"), F.lit(None).cast("string").alias("var"), F.explode(literal_urls(F.col("content"))).alias("url"))
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(CONFIGURED), F.lit(1)).alias("var"), F.regexp_extract_all("content", F.lit(CONFIGURED), F.lit(2)).alias("url"))
    config = files.select("path", F.explode(pairs).alias("x")).select("path", F.lit("config").alias("kind"), "x.var", "x.url")
    env = files.select("path", F.lit("env").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(ENVIRONMENT), F.lit(1))).alias("var"), F.lit(None).cast("string").alias("url"))
    return literal.unionByName(config).unionByName(env)


def script_urls(files: DataFrame) -> DataFrame:
    """(path, lineno, url) of every line of script sources, each url cut at a closing parenthesis."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    found = lines.select("path", (F.col("n") + 1).alias("lineno"), F.explode(F.regexp_extract_all("line", F.lit(SCRIPT), F.lit(1))).alias("url"))
    return found.withColumn("url", F.split_part("url", F.lit(")"), F.lit(1)))


def walk_urls(node, key: str | None = None) -> Iterator[tuple[str | None, str]]:
    """(nearest key, url) of every http string in nested maps and lists."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from walk_urls(v, str(k))
    elif isinstance(node, list):
        for v in node:
            yield from walk_urls(v, key)
    elif isinstance(node, str) and node.startswith(("http://", "https://")):
        yield key, node


@udtf(returnType="key string, url string")
class ConfigUrls:
    """Urls of a JSON or YAML document, by its file's ending; a document that does not parse has none."""

    def eval(self, path: str, content: str):
        try:
            if path.endswith(".json"):
                document = json.loads(content)
            elif path.endswith((".yml", ".yaml")):
                import yaml

                document = yaml.safe_load(content)
            else:
                return
        except (ValueError, TypeError, AttributeError):
            return
        except Exception as error:  # yaml's errors have no common base with ValueError
            if type(error).__module__.split(".")[0] != "yaml":
                raise
            return
        yield from walk_urls(document)


def config_urls(files: DataFrame) -> DataFrame:
    """(path, key, url) of configuration files."""
    return files.lateralJoin(ConfigUrls(F.col("path").outer(), F.col("content").outer())).select("path", "key", "url")


def variant_leaves(docs: DataFrame, json_col: str, levels: int = 4) -> DataFrame:
    """E17 in SQL alone: (key, value) of the strings of JSON documents, down to so many levels."""
    level = docs.select(F.lit(None).cast("string").alias("key"), F.try_parse_json(json_col).alias("node"))
    out = None
    for _ in range(levels + 1):
        # a map's entries get its key, a list's items keep theirs
        strings = level.where(F.schema_of_variant("node") == "STRING").select("key", F.variant_get("node", "$", "string").alias("value"))
        out = strings if out is None else out.unionByName(strings)
        rows = level.createOrReplaceTempView("_variant_level") or docs.sparkSession.sql(
            "SELECT coalesce(e.key, l.key) AS key, e.value AS node FROM _variant_level l, LATERAL variant_explode(l.node) e"
        )
        level = rows
    return out
