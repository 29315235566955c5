"""Bars in: files, and bars derived from the events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators.halo import DAY, by_day

PRICES = ("open", "high", "low", "close")
REQUIRED = ("timestamp", *PRICES, "volume")
#: Types of the columns that raw and prepared files can have.
TYPES = {"timestamp": "timestamp", "local_time": "timestamp", "session_date": "date", "minute_of_day": "int", "is_rth": "boolean", "is_outlier": "boolean", "has_gap": "boolean"} | {
    c: "double" for c in (*PRICES, "volume", "atr", "rsi", "avg_volume_lookback", "rvol", "stoch_k", "stoch_d")
}
#: Spellings of an unknown cell in text files.
UNKNOWN = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def normalise(df: DataFrame) -> DataFrame:
    """Lower-case names, the required columns checked, the known ones typed, times in UTC, NaN turned into null, and a symbol (empty where there is none).

    Text becomes null where it is one of UNKNOWN. bad_cells counts the row's cells that are neither that nor of their column's
    type; they are null too. Volumes are doubles, as files may hold 100.0 or fractions; whole numbers stay exact.
    """
    df = df.toDF(*(c.lower() for c in df.columns))
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    given, columns, bad = dict(df.dtypes), {}, [F.col("bad_cells").cast("int")] if "bad_cells" in df.columns else []
    for c, kind in TYPES.items():
        if c not in given:
            continue
        cell = F.col(c)
        if given[c] == "string":
            cell = F.when(~F.trim(cell).isin(*UNKNOWN), F.trim(cell))
            bad.append((cell.isNotNull() & cell.try_cast(kind).isNull()).cast("int"))
            cell = cell.try_cast(kind)
        cell = cell.cast(kind)
        columns[c] = F.nanvl(cell, F.lit(None).cast("double")) if kind == "double" else cell
    symbol = F.coalesce(F.col("symbol").cast("string"), F.lit("")) if "symbol" in df.columns else F.lit("")
    return df.withColumns(columns | {"symbol": symbol, "bad_cells": sum(bad, F.lit(0))})


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as one table with file_ord, the file's place in paths; .parquet is Parquet, anything else CSV with a header, read as text and then typed."""
    if not paths:
        return spark.createDataFrame([], "timestamp timestamp, open double, high double, low double, close double, volume double, symbol string, bad_cells int, file_ord int")
    read = lambda p: spark.read.parquet(p) if p.lower().endswith(".parquet") else spark.read.option("header", True).csv(p)
    parts = [normalise(read(p)).withColumn("file_ord", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_of_each_time(bars: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each time of each of keys: of the first file, and there of least prices and volume, as rows have no order of their own."""
    spare = [] if DAY in bars.columns else [DAY]
    order = Window.partitionBy(*keys, DAY).orderBy("timestamp", "file_ord", *PRICES, "volume")
    seen = by_day(bars).withColumn("seen_", F.lag("timestamp").over(order))
    return seen.filter(F.col("seen_").isNull() | (F.col("seen_") != F.col("timestamp"))).drop("seen_", *spare)


def bars_from_events(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    """Bars of an integer-grid walk over the events in order of time.

    The walk is summed by day: days' sums are added up in a window over one row a day, events in a window over each day, so
    no task sees all events.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    events = events.withColumns({"day": F.to_date("ts"), "step": F.round(F.col("value") * 100).cast("long") % 41 - 20})
    days = events.groupBy("day").agg(F.sum("step").alias("day_step"))
    days = days.select("day", (F.sum("day_step").over(Window.orderBy("day")) - F.col("day_step")).alias("before"))
    inside = Window.partitionBy("day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    walk = events.withColumn("own", F.sum("step").over(inside)).join(days, "day").withColumn("ticks", 60_000 + F.col("before") + F.col("own"))
    at, price = F.struct("ts", "event_id"), lambda c: c * F.lit(0.25)
    return walk.groupBy(F.window("ts", f"{minutes} minutes").start.alias("timestamp")).agg(
        price(F.min_by("ticks", at)).alias("open"), price(F.max("ticks")).alias("high"), price(F.min("ticks")).alias("low"), price(F.max_by("ticks", at)).alias("close"), F.count("*").alias("volume")
    ).withColumn("symbol", F.lit(""))


BARS_SQL = """
walk_ AS (SELECT ts, event_id, CAST(60000 + sum((CAST(round(value * 100) AS BIGINT) % 41) - 20) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ticks FROM events),
bars AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp, 0.25::DOUBLE * arg_min(ticks, (ts, event_id)) AS open, 0.25::DOUBLE * max(ticks) AS high,
  0.25::DOUBLE * min(ticks) AS low, 0.25::DOUBLE * arg_max(ticks, (ts, event_id)) AS close, count(*) AS volume FROM walk_ GROUP BY 1)"""
