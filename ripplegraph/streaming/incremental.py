"""Incremental runs: what changed since the last one, states that are brought up to date, and streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """files whose (path, mtime) the state does not have."""
    known = state.select("path", F.col("mtime").alias("_seen"))
    return files.join(known, "path", "left").where("NOT mtime <=> _seen").drop("_seen")


def updated_state(state: DataFrame, files: DataFrame) -> DataFrame:
    """The state with the files' times in place of older ones."""
    new = files.select("path", "mtime")
    return state.select("path", "mtime").join(new.select("path"), "path", "left_anti").unionByName(new)


def insert_only(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The old rows and those new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Note 5: the new rows and those old ones whose key is not among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delta_scan(files: DataFrame, state: DataFrame, summaries: DataFrame, extract: Callable[[DataFrame], DataFrame], compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """ST3: summaries and state after a scan of the files that changed; with compat, old rows are never replaced."""
    delta = changed_files(files, state)
    new = extract(delta)
    return (insert_only if compat else replaced)(summaries, new), updated_state(state, delta)


def new_runs(runs: DataFrame, last_id: int | None) -> DataFrame:
    """ST4, O5, S23: the latest successful run of runs(run_id, status, created) if it is not the last one seen."""
    newest = runs.where("status = 'success'").orderBy(F.desc("created"), F.desc("run_id")).limit(1)
    return newest if last_id is None else newest.where(F.col("run_id") != last_id)


def watch_diffs(spark: SparkSession, folder: str, analyse: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "120 seconds") -> StreamingQuery:
    """ST1: run analyse(diff_lines, batch) over the diff files that come into a folder; with every=None over those that are
    there, and stop. The checkpoint makes sure that each file is analysed once."""
    text = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("source"), "value")
    lines = text.select("source", F.posexplode(F.split("value", "\n", -1)).alias("n", "line")).select("source", (F.col("n") + 1).alias("lineno"), "line")
    return _started(lines, analyse, checkpoint, every)


def watch_sources(spark: SparkSession, folder: str, analyse: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.py", every: str | None = "60 seconds") -> StreamingQuery:
    """ST2: the same over source files, as files(path, mtime, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return _started(raw.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content")), analyse, checkpoint, every)


def _started(stream: DataFrame, analyse, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of events(ts, event_type) by time window; as a stream, events later than the watermark are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
