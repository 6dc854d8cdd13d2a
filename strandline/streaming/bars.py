"""Bars from an event stream, an extension: the batch operators have no stream of their own.

Late events are bounded by a watermark; the bar of a window is final once the
watermark has passed it, so the sink appends each bar once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, *, width: str = "1 day", lateness: str = "1 hour", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """ticker, window bounds and open, high, low, close, volume of each key and window.

    Works on a stream (``withWatermark`` drops later events) and on a batch.
    Open and close follow (time, id), so equal times have a defined order.
    """
    order = F.struct(F.col(ts), F.col("event_id"))
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, lateness)
    bars = rows.groupBy(F.window(ts, width).alias("w"), F.col(key).alias("ticker")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "open", "high", "low", "close", "volume")


def write_bars(bars: DataFrame, path: str, checkpoint: str):
    """Append final bars to Parquet; what is there now is read, then the query ends."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
