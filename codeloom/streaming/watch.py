"""Watching a tree: a filtered stream of file events, debounced into sessions, each of which refreshes what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions import code

# fixed values
DEBOUNCE = "500 milliseconds"
KINDS = ["create", "modify", "remove"]


def relevant(events: DataFrame, kind_col: str = "kind", path_col: str = "path") -> DataFrame:
    """Events of the three kinds on watched paths; nulls are none."""
    return events.where(F.lower(kind_col).isin(KINDS) & code.is_watched(F.col(path_col)))


def debounce(events: DataFrame, time_col: str = "ts", keys: tuple[str, ...] = ("session_id",), gap: str = DEBOUNCE, late: str | None = "10 seconds") -> DataFrame:
    """(*keys, first, fires_at, events): one row per burst, due a gap after its last event; an event exactly a gap after another joins it. Batch and stream alike; late is the watermark of a stream."""
    e = events.withWatermark(time_col, late) if late and events.isStreaming else events
    w = F.session_window(time_col, gap)
    return e.groupBy(*keys, w).agg(F.count("*").alias("events")).select(*keys, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("fires_at"), "events")


def file_stream(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """Files as they appear, at most so many per trigger."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(per_trigger)).schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").load(folder)


def start(bursts: DataFrame, refresh: Callable[[DataFrame, int], None], name: str, checkpoint: str) -> StreamingQuery:
    """Calls refresh with each micro-batch of due bursts."""
    return bursts.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(refresh).start()


def status(spark: SparkSession) -> list[dict]:
    return [{"name": q.name, "id": str(q.id), "active": q.isActive, "status": q.status, "progress": q.lastProgress} for q in spark.streams.active]


def stop(spark: SparkSession, name: str | None = None) -> int:
    """Stops one query or all; returns how many."""
    hit = [q for q in spark.streams.active if name is None or q.name == name]
    for q in hit:
        q.stop()
    return len(hit)
