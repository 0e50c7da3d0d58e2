"""A session in which the table functions and the driver's tables can be named in SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..functions import python_source, script_source
from ..functions.scalars import fuzzy_ratio
from ..functions.urls import ConfigUrls

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession) -> None:
    """Make the table functions known: `SELECT f.* FROM files, LATERAL py_methods(content) f`."""
    for name, function in {**python_source.TABLE_FUNCTIONS, **script_source.TABLE_FUNCTIONS, "config_urls": ConfigUrls}.items():
        spark.udtf.register(name, function)
    spark.udf.register("fuzzy_ratio", fuzzy_ratio)


def tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    """Temporary views of a folder's tables."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
