"""Daily sums over a stream of observations: a day is given out once, when the watermark has passed its end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_days(stream: DataFrame, keys: Sequence[str], ts: str, value: str, late: str = "6 hours", offset_hours: int = 0, hours: int = 24) -> DataFrame:
    """Sums by key and day for days with every hour: keys, day, total, hours.

    Rows later than the watermark are dropped by Spark; distinct hours are kept as a bit mask, so state is one row a key
    and open day. offset_hours moves the day boundary (9 for UTC+9).
    """
    moved = stream.withColumn("_t", F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {offset_hours} HOURS")).withWatermark("_t", late)
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1), F.hour("_t")))
    days = moved.groupBy(*keys, F.window("_t", "1 day").alias("_w")).agg(F.sum(value).alias("total"), mask.alias("_m"))
    out = days.select(*keys, F.to_date("_w.start").alias("day"), "total", F.bit_count("_m").alias("hours"))
    return out.where(F.col("hours") == hours)
