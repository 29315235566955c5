"""Validation of bars: rows that go, rows that are flagged, and the report of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import DataQualityConfig
from tidegauge.operators.halo import DAY, by_day, carried

_BY = ("file_ord", "symbol")


def _with_return(rows: DataFrame, name: str, **more: Column) -> DataFrame:
    """rows with the relative change of close against the last known close before it, among rows not dropped so far, infinite after a zero; and more values carried over like that close."""
    known = F.when(F.col("dropped").isNull(), F.col("close"))
    rows = carried(rows, {"before_": known, **more}, F.col("timestamp"), _BY)
    before, now = F.col("before_"), F.coalesce(known, F.col("before_"))
    change = F.when((before == 0) & (now != 0), F.lit(float("inf"))).otherwise(F.try_divide(now, before) - 1)
    return rows.withColumn(name, change).drop("before_")


def bad_ohlc() -> Column:
    high, low = F.col("high"), F.col("low")
    masks = [high < low, high < F.col("open"), high < F.col("close"), low > F.col("open"), low > F.col("close")]
    return F.coalesce(masks[0], F.lit(False)) | F.coalesce(masks[1], F.lit(False)) | F.coalesce(masks[2], F.lit(False)) | F.coalesce(masks[3], F.lit(False)) | F.coalesce(masks[4], F.lit(False))


def marked(bars: DataFrame, config: DataQualityConfig) -> DataFrame:
    """bars, all rows, with dropped (ohlc, spike, volume; null for rows that stay), is_outlier and has_gap.

    Filters apply in that order: returns of the spike rule run over what integrity left, those of the outlier rule over the
    survivors. is_outlier: the return exceeds the threshold times the session's median absolute deviation, scaled; without
    session_date, the threshold times the returns' sample deviation in the file and symbol. has_gap: more minutes than allowed
    since the survivor before it in the same session. Files are judged apart, as symbols are.
    """
    spare, bars = [] if DAY in bars.columns else [DAY], by_day(bars)
    no, dropped = F.lit(None).cast("string"), F.col("dropped")
    out = bars.withColumn("dropped", F.when(bad_ohlc(), "ohlc") if config.check_ohlc_integrity else no)
    if config.max_price_change_pct > 0:
        spike = dropped.isNull() & F.coalesce(F.abs("r_") * 100 > config.max_price_change_pct, F.lit(False))
        out = _with_return(out, "r_").withColumn("spike_", spike).withColumn("dropped", F.when(F.col("spike_"), "spike").otherwise(dropped)).drop("spike_", "r_")
    if config.min_volume > 0:
        low = dropped.isNull() & F.coalesce(F.col("volume") < config.min_volume, F.lit(False))
        out = out.withColumn("dropped", F.when(low, "volume").otherwise(dropped))
    stays, outlier, gap = dropped.isNull(), F.lit(False), F.lit(False)
    last = {"last_": F.when(stays, F.struct("timestamp", "session_date"))} if config.handle_gaps else {}
    if config.remove_outliers or config.handle_gaps:
        out = _with_return(out, "r_", **last).withColumn("r_", F.when(stays, F.col("r_")))
    if config.remove_outliers:
        if "session_date" in bars.columns:
            session = Window.partitionBy(*_BY, "session_date")
            out = out.withColumn("m_", F.median("r_").over(session)).withColumn("mad_", F.median(F.abs(F.col("r_") - F.col("m_"))).over(session))
            limit = config.outlier_std_threshold * F.col("mad_") * 1.4826 + 1e-9
        else:
            out = out.withColumn("dev_", F.stddev_samp("r_").over(Window.partitionBy(*_BY)))
            limit = F.col("dev_") * config.outlier_std_threshold
        outlier = F.coalesce(F.abs("r_") > limit, F.lit(False))
    if config.handle_gaps:
        last = F.col("last_")
        minutes = (F.unix_micros("timestamp") - F.unix_micros(last["timestamp"])) / 60e6
        gap = stays & F.coalesce((last["session_date"] == F.col("session_date")) & (minutes > config.max_gap_minutes), F.lit(False))
    return out.withColumns({"is_outlier": outlier, "has_gap": gap}).drop("r_", "m_", "mad_", "dev_", "last_", *spare)


def validate(bars: DataFrame, config: DataQualityConfig) -> DataFrame:
    """The rows that stay, with is_outlier and has_gap."""
    return marked(bars, config).filter("dropped is null").drop("dropped")


def report(bars: DataFrame, config: DataQualityConfig) -> DataFrame:
    """One row: original_rows, invalid_ohlc, price_spike, low_volume, outliers, gaps_detected, final_rows, rows_removed, removal_pct."""
    return summary(marked(bars, config))


def summary(rows: DataFrame) -> DataFrame:
    """The report of marked rows; with bad_cells, the sum of theirs, where they have that column."""
    gone = lambda kind: F.count_if(F.col("dropped").eqNullSafe(kind))
    bad = [F.coalesce(F.sum("bad_cells"), F.lit(0)).alias("bad_cells")] if "bad_cells" in rows.columns else []
    found = rows.agg(
        F.count("*").alias("original_rows"), gone("ohlc").alias("invalid_ohlc"), gone("spike").alias("price_spike"), gone("volume").alias("low_volume"),
        F.count_if("is_outlier").alias("outliers"), F.count_if("has_gap").alias("gaps_detected"), F.count_if(F.col("dropped").isNull()).alias("final_rows"), *bad,
    )
    found = found.withColumn("rows_removed", F.col("original_rows") - F.col("final_rows"))
    return found.withColumn("removal_pct", F.coalesce(F.try_divide(100.0 * F.col("rows_removed"), F.col("original_rows")), F.lit(0.0)))
