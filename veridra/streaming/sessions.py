"""State over a stream of events: repeated deliveries go, and events of a user that follow each other closely are a session.

A row is late if its time lies more than ``delay`` before the latest seen in earlier micro-batches; late rows are dropped by
either operator.  A session is told once, when the watermark has passed its end (the last event's time and ``gap``), so what is told never
changes; sessions still open when a run ends are kept in its checkpoint and told by a later run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def without_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first of the rows with equal keys; keys are remembered for ``delay``, so state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, user: str, time: str, gap: str, delay: str | None = None) -> DataFrame:
    """user, session_start, session_end, n_events of each session; delay only if the stream has no watermark yet."""
    rows = stream.withWatermark(time, delay) if delay else stream
    found = rows.groupBy(user, F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(user, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n_events")


def write_sessions(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed sessions as Parquet: all that is there now, then it ends."""
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
