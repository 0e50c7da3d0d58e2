"""Sinks. All of them write tables or files; none sends anything anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_name


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A snapshot of the graph; edges lie by usage type, so that a projection reads only its own."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("usage_type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_summaries(summaries: DataFrame, path: str) -> None:
    """S18."""
    summaries.write.mode("overwrite").json(path)


def write_changes(hunks: DataFrame, path: str) -> None:
    """S19."""
    hunks.write.mode("overwrite").json(path)


def write_impact_reports(impacts: DataFrame, path: str) -> None:
    """Impacts in folders by criticality, 'NA' where there is none, with a name fit for a file."""
    named = impacts.withColumn("report", safe_name(F.concat_ws("_", "file", "impacted_method"))).withColumn("criticality", F.coalesce(F.col("criticality").cast("string"), F.lit("NA")))
    named.write.mode("overwrite").partitionBy("criticality").json(path)


def write_visualization(nodes: DataFrame, links: DataFrame, path: str, run: str) -> None:
    """S21, ST5: the two tables of a run, beside those of other runs."""
    for name, table in (("viz_nodes", nodes), ("viz_links", links)):
        table.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def read_visualization(spark: SparkSession, path: str, run: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}").where(F.col("run_id") == run).drop("run_id") for name in ("viz_nodes", "viz_links"))


def notifications(report: DataFrame) -> DataFrame:
    """(recipient, subject, body), one row for each owner and file of a report(owner, file, impacted)."""
    owners = report.select(F.explode(F.split("owner", r"\s*,\s*")).alias("recipient"), "file", "impacted")
    body = F.array_join(F.array_sort(F.collect_set("impacted")), "\n")
    return owners.groupBy("recipient", "file").agg(body.alias("body")).select("recipient", F.concat(F.lit("Impact of changes in "), "file").alias("subject"), "body")


def write_table_csv(df: DataFrame, path: str) -> None:
    """B23."""
    df.write.mode("overwrite").csv(path, header=True)


def write_symbols(symbols: DataFrame, path: str) -> None:
    """H9: the stores of variables, packages and methods, a folder for each kind."""
    symbols.write.mode("overwrite").partitionBy("kind").json(path)


def read_symbols(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.json(path).where(F.col("kind") == kind).drop("kind")
