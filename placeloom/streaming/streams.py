"""Streaming: the manifest kept up to date, and labelled extensions on event time."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.manifest import upserted


#: Generations of changes after which one holds the whole manifest again.
COMPACT = 16
_MARK = re.compile(r"(\d{12})\.(whole|changes|done)\.(\d{12})\.(.+)")


class Mark(NamedTuple):
    """A published generation: its number, whether its data are all rows, changes only or gone, and the batch of a query it is from."""

    number: int
    kind: str
    batch: int
    query: str

    def name(self) -> str:
        return f"{self.number:012d}.{self.kind}.{self.batch:012d}.{self.query}"


def manifest_writer(spark: SparkSession, path: str, version: str = "version", compact: int = COMPACT, query: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a manifest kept as a log of generations, which readers see only when they are whole.

    A batch writes its own changes, one row a URL, so its cost doesn't grow with the manifest; every ``compact``
    generations one holds all rows, and what that replaces but for the last whole one is removed. A generation is written
    beside the others and published by the rename of a file of its own, so a batch that was interrupted starts over.

    Batches are known by their query: a batch of a query that was published changes nothing when it comes again, while a query
    with a new checkpoint, whose numbers start over, adds generations of its own. query: the name to go by; else the
    streaming query's id, which its checkpoint keeps. Several queries may follow one another; one writes at a time.
    """

    def write(changes: DataFrame, batch: int) -> None:
        own = query or changes.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batches"
        marks = published(spark, path)
        if any(m.query == own and m.batch >= batch for m in marks):
            return
        since = 0
        for m in marks:
            since = 0 if m.kind == "whole" else since + (m.kind == "changes")
        whole = not any(m.kind == "whole" for m in marks) or since + 1 >= compact
        mark = Mark(marks[-1].number + 1 if marks else 0, "whole" if whole else "changes", batch, own)
        rows = upserted(changes.limit(0), changes, version)
        if whole and marks:
            rows = upserted(_merged(spark, path, marks, version), changes, version)
        rows.write.mode("overwrite").parquet(_generation(path, mark))
        _publish(spark, path, mark)
        if whole:
            _remove_replaced(spark, path)

    return write


def _generation(path: str, mark: Mark) -> str:
    return f"{path}/generation={mark.number:012d}.{mark.batch:012d}.{mark.query}"


def _files(spark: SparkSession, path: str) -> tuple[object, Callable[[str], object]]:
    """The file system of a path and its kind of paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _publish(spark: SparkSession, path: str, mark: Mark) -> None:
    files, make = _files(spark, path)
    files.mkdirs(make(f"{path}/_published"))
    files.create(make(f"{path}/_published/.{mark.name()}"), True).close()
    files.rename(make(f"{path}/_published/.{mark.name()}"), make(f"{path}/_published/{mark.name()}"))


def _remove_replaced(spark: SparkSession, path: str) -> None:
    """Remove data that the last whole generation but one replaces; a query's batches stay known by their marks.

    The whole generation before the last stays with what followed it, for readers that began with it.
    """
    files, make = _files(spark, path)
    marks = published(spark, path)
    kept = [m.number for m in marks if m.kind == "whole"][-2:][0]
    for m in marks:
        if m.number < kept and m.kind != "done":
            files.rename(make(f"{path}/_published/{m.name()}"), make(f"{path}/_published/{m._replace(kind='done').name()}"))
            files.delete(make(_generation(path, m)), True)


def published(spark: SparkSession, path: str) -> list[Mark]:
    """The published generations, in order; several generations of which none is published are an error."""
    files, make = _files(spark, path)
    names = lambda folder: [x.getPath().getName() for x in files.listStatus(make(folder))] if files.exists(make(folder)) else []
    found = [_MARK.fullmatch(n) for n in names(f"{path}/_published")]
    marks = sorted(Mark(int(m[1]), m[2], int(m[3]), m[4]) for m in found if m)
    if not marks and sum(n.startswith("generation=") for n in names(path)) > 1:
        raise RuntimeError("the manifest has generations, but none is published")
    return marks


def _merged(spark: SparkSession, path: str, marks: list[Mark], version: str) -> DataFrame:
    last = max(m.number for m in marks if m.kind == "whole")
    rows, *later = (spark.read.parquet(_generation(path, m)).withColumn("__generation", F.lit(m.number)) for m in marks if m.number >= last)
    if not later:
        return rows.drop("__generation")
    for more in later:
        rows = rows.unionByName(more, allowMissingColumns=True)
    one = F.struct(*(F.col(c) for c in rows.columns if c != "__generation"))
    return rows.groupBy("url").agg(F.max_by(one, F.struct(version, "__generation")).alias("r")).select("r.*")


def current(spark: SparkSession, path: str, version: str = "version") -> DataFrame | None:
    """The manifest as of its last published generation; None before the first.

    The last whole generation and the changes since: of a URL the row of the last version, of equal versions the later one.
    """
    marks = published(spark, path)
    return _merged(spark, path, marks, version) if marks else None


def stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some at a time."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def latest_position(events: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """The last row of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in events.columns if c != key)), F.struct(at, "event_id")).alias("r")).select(key, "r.*")


def settled(changes: DataFrame, frame: str = "16 milliseconds", at: str = "ts", order: str = "event_id") -> DataFrame:
    """The last change of each frame, with the frame's start: what came before it in the frame isn't published."""
    rows = changes.withWatermark(at, frame) if changes.isStreaming else changes
    one = F.struct(*(F.col(c) for c in changes.columns))
    return rows.groupBy(F.window(at, frame).alias("w")).agg(F.max_by(one, F.struct(at, order)).alias("r")).select(F.col("w.start").alias("frame"), "r.*")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, value): an extension for event time; rows later than the watermark don't count in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, events): an extension; a session ends after a gap without events."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
