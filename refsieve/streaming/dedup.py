"""Extension: removal of repeated records from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.dedup import fold


def stream_dedup(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """First record of each folded key among records at most ``delay`` apart; state is dropped behind the watermark."""
    return stream.withWatermark(time, delay).withColumn("__key", fold(stream[key])).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
