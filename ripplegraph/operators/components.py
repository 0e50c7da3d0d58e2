"""Connected components of an undirected edge list, as a loop of DataFrame joins."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's checkpoint folder. Where none is named, a single machine gets a temporary one; on a cluster the
    executors need a folder that all of them reach, so that one must be named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ripplegraph-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut_lineage(df: DataFrame, tidy: bool = True) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that a lost executor costs no recomputation.

    The plans before it are garbage then. With tidy it is collected, which lets Spark's cleaner drop their shuffle files,
    broadcasts and, where spark.cleaner.referenceTracking.cleanCheckpoints says so, checkpoints at once; loops over small
    tables do without.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if tidy:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Label every node of edges(src, dst) with the smallest node of its component: (node, component).

    Alternates the large-star and small-star steps, which need O(log^2 n) rounds and never give a node more
    neighbours than it had edges, so that long chains and big hubs both stay cheap. Null ends and self loops are
    ignored; an empty edge list gives an empty result. Both steps shuffle the edges that are left, nothing else.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = cut_lineage(e.where("u <> v").distinct())
    state = _fingerprint(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        e = cut_lineage(_small_star(_large_star(e)))
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    smaller = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
