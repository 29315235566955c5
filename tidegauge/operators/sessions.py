"""Local time, session date and regular hours of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import SessionConfig

COLUMNS = ("local_time", "session_date", "minute_of_day", "is_rth")


def annotate_sessions(bars: DataFrame, config: SessionConfig) -> DataFrame:
    """bars with local_time (wall clock), session_date (local calendar date), minute_of_day and is_rth (start inside, end outside)."""
    start, end = config.minutes()
    local = F.from_utc_timestamp("timestamp", config.tz_rth)
    minute = (F.hour("local_time") * 60 + F.minute("local_time")).cast("int")
    out = bars.withColumn("local_time", local).withColumns({"session_date": F.to_date("local_time"), "minute_of_day": minute})
    return out.withColumn("is_rth", (F.col("minute_of_day") >= start) & (F.col("minute_of_day") < end))
