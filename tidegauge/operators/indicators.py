"""Indicators of bars: true range, ATR, RSI, relative volume, stochastics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidegauge.config import IndicatorConfig
from tidegauge.operators.halo import DAY, bounded, by_day, numbered, running
from tidegauge.session import cut

COLUMNS = ("atr", "rsi", "rvol", "stoch_k", "stoch_d")
ROWS_A_SESSION = 390


def indexed(bars: DataFrame) -> DataFrame:
    """bars with bar_idx, the place of the bar among its symbol's, from 0."""
    return numbered(bars, "bar_idx")


def _tr(order: WindowSpec) -> dict[str, Column]:
    before = F.lag("close").over(order)
    return {"tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))}


def _gain_and_loss(order: WindowSpec) -> dict[str, Column]:
    change = F.col("close") - F.lag("close").over(order)
    return {"gain_": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "loss_": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}


def true_range(bars: DataFrame) -> DataFrame:
    return bounded(bars, 1, 0, _tr)


def _decays(known: np.ndarray, alpha: float) -> float:
    """What is left at the end of a day of a change in the mean at the day's first known value."""
    gaps = np.diff(known)
    plain = gaps == 1
    old = (1 - alpha) ** gaps[~plain].astype(float)
    return float((1 - alpha) ** plain.sum() * np.prod(old / (old + alpha)))


def smoothed(bars: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """bars with a recursive mean of each named column: {new: (column, span)}, seeded by its first known value.

    Days run side by side. Each day is summed up in a row (where its own recursion ends, and what of another start would be
    left there); those rows, one a day, are chained for each symbol; then each day recurs from the mean it starts with.
    Unknown values keep the mean and let its weight decay.
    """
    alphas = {name: 2.0 / (span + 1) for name, (_, span) in columns.items()}
    parts = {"end": "double", "left": "double", "first": "double", "lead": "long", "trail": "long"}
    summary = "symbol string, day_ date, " + ", ".join(f"{name}_{part} {kind}" for name in columns for part, kind in parts.items())
    carry = "symbol string, day_ date, " + ", ".join(f"{name}_from_ double, {name}_gap_ long" for name in columns)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, row = pdf.sort_values("timestamp", kind="stable"), {"symbol": [pdf["symbol"].iloc[0]], "day_": [pdf["day_"].iloc[0]]}
        for name, (column, span) in columns.items():
            values = pdf[column].astype(float)
            known = np.flatnonzero(values.notna())
            if len(known):
                own = (values.ewm(span=span, adjust=False).mean().iloc[-1], _decays(known, alphas[name]), values.iloc[known[0]], known[0], len(values) - 1 - known[-1])
            else:
                own = (np.nan, 1.0, np.nan, len(values), 0)
            row |= {f"{name}_{part}": [x] for part, x in zip(parts, own, strict=True)}
        return pd.DataFrame(row)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_", kind="stable")
        out = pdf[["symbol", "day_"]].copy()
        for name, alpha in alphas.items():
            mean, gap, starts = np.nan, 0, []
            for end, left, first, lead, trail in pdf[[f"{name}_{part}" for part in parts]].itertuples(index=False):
                starts.append((mean, gap))
                if np.isnan(end):
                    gap += int(lead)
                    continue
                old = (1 - alpha) ** (gap + lead + 1)
                begun = first if np.isnan(mean) else (old * mean + alpha * first) / (old + alpha)
                mean, gap = end + left * (begun - first), int(trail)
            out[f"{name}_from_"], out[f"{name}_gap_"] = [x for x, _ in starts], [x for _, x in starts]
        return out

    schema = StructType([*bars.drop(DAY).schema.fields, *(StructField(name, DoubleType()) for name in columns)])

    def recur(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp", kind="stable")
        for name, (column, span) in columns.items():
            start, gap, values = pdf[f"{name}_from_"].iloc[0], int(pdf[f"{name}_gap_"].iloc[0]), pdf[column].to_numpy(float)
            head = [] if np.isnan(start) else [start, *[np.nan] * gap]
            pdf[name] = pd.Series(np.concatenate([head, values])).ewm(span=span, adjust=False).mean().to_numpy()[len(head):]
        return pdf[schema.names]

    days = cut(bars.withColumn("day_", F.to_date("timestamp")).drop(DAY))  # read twice
    needed = days.select("symbol", "day_", "timestamp", *{column for column, _ in columns.values()})
    starts = needed.groupBy("symbol", "day_").applyInPandas(summarise, summary).groupBy("symbol").applyInPandas(chain, carry)
    return days.join(starts, ["symbol", "day_"]).groupBy("symbol", "day_").applyInPandas(recur, schema)


def relative_volume(bars: DataFrame, sessions: int) -> DataFrame:
    """bars with avg_volume_lookback and rvol, and place_ by which they were met: volume against its mean over a long trailing window, from differences of running sums.

    The sum that leaves the window is met by its place, so the window's length costs nothing and no task holds it.
    """
    if sessions <= 0:
        return numbered(bars, "place_").withColumn("rvol", F.lit(None).cast("double"))
    width = sessions * ROWS_A_SESSION
    out = running(bars, {"place_": F.lit(1).cast("long"), "s_": F.col("volume"), "c_": F.col("volume").isNotNull().cast("long")})
    out = cut(out)  # met by itself
    left = out.select(F.col("symbol").alias("symbol__"), (F.col("place_") + width).alias("place__"), F.col("s_").alias("s0_"), F.col("c_").alias("c0_"))
    out = out.join(left, F.col("symbol").eqNullSafe(F.col("symbol__")) & (F.col("place_") == F.col("place__")), "left")
    total, count = (F.col(f"{c}_") - F.coalesce(f"{c}0_", F.lit(0)) for c in "sc")
    out = out.withColumn("avg_volume_lookback", F.when(count >= max(1, width // 10), total / count)).drop("s_", "c_", "s0_", "c0_", "symbol__", "place__")
    return out.withColumn("rvol", F.col("volume") / (F.col("avg_volume_lookback") + 1e-12))


def _stochastics(n: int, d: int):
    def k(order: WindowSpec) -> dict[str, Column]:
        least, most = F.min("low").over(order.rowsBetween(1 - n, 0)), F.max("high").over(order.rowsBetween(1 - n, 0))
        k = F.try_divide(100 * (F.col("close") - least), F.nullif(most - least, F.lit(0.0)))
        return {"stoch_k": F.when(k.isNotNull(), F.least(F.greatest(k, F.lit(0.0)), F.lit(100.0)))}

    return k, lambda order: {"stoch_d": F.avg("stoch_k").over(order.rowsBetween(1 - d, 0))}


def stochastics(bars: DataFrame, n: int, d: int) -> DataFrame:
    return bounded(bars, n + d, 0, *_stochastics(n, d))


def add_indicators(bars: DataFrame, config: IndicatorConfig) -> DataFrame:
    """bars with atr, rsi, avg_volume_lookback, rvol, stoch_k and stoch_d; NaN is null. Frames of rows share one pass over ranges."""
    n, d = config.stoch_n, config.stoch_d
    out = bounded(relative_volume(by_day(bars), config.rvol_lookback_sessions), n + d, 0, _tr, _gain_and_loss, *_stochastics(n, d), place="place_").drop("place_")
    out = smoothed(out, {"atr": ("tr", config.atr_n), "up_": ("gain_", config.rsi_n), "down_": ("loss_", config.rsi_n)})
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("atr", "up_", "down_")})
    return out.withColumn("rsi", 100 - 100 / (1 + F.col("up_") / (F.col("down_") + 1e-12))).drop("tr", "gain_", "loss_", "up_", "down_")
