"""Aggregates over windows of event time.

A window is reported once, when the watermark (the newest event less `delay`) has passed its end; its state then goes. A row that comes
for a window already reported is left out, so a row counts if it is at most `delay` late, whatever the order of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, time: str, delay: str, width: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """`(*keys, window, *aggregates)` for windows of one width side by side; counts are combined before the shuffle."""
    return events.withWatermark(time, delay).groupBy(*keys, F.window(time, width).alias("window")).agg(*aggregates)


def sessions(events: DataFrame, time: str, delay: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """`(*keys, window, *aggregates)` for stretches of events of a key that lie at most `gap` apart; a stretch ends `gap` after its last event."""
    return events.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("window")).agg(*aggregates)


def start_windows(windows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished windows to a Parquet folder, each exactly once."""
    writer = windows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
