"""Plain row by row versions of the engine's sequential operators, which the tests hold the Spark jobs against."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidegauge.config import EpisodeConfig
from tidegauge.operators.episodes import MEASURES


def track(bars: dict[str, np.ndarray], at: int, low: float, high: float, level: float, resistance: bool, config: EpisodeConfig, stale: float):
    """(outcome, place of the bar that brought it, favorable, adverse) of the touch at bar `at`; None if the bars end first.

    Rules of a bar in their order: a stale gap before it; excursions from the level; flagged bars; a pierced strip beyond the
    band; a close beyond that strip; pierced and reached; left on the favorable side and reached; too many bars.
    """
    favorable = adverse = 0.0
    pierced = left = False
    for i in range(at, len(bars["high"])):
        top, bottom, close = bars["high"][i], bars["low"][i], bars["close"][i]
        if config.max_gap_bars > 0 and i > at and bars["micros"][i] - bars["micros"][i - 1] > stale:
            return "INVALID", i, favorable, adverse
        up, down = max(0.0, top - level), max(0.0, level - bottom)
        favorable, adverse = max(favorable, down if resistance else up), max(adverse, up if resistance else down)
        if bars["is_outlier"][i] or bars["has_gap"][i]:
            return "INVALID", i, favorable, adverse
        pierced = pierced or high < top <= high + config.O or low - config.O <= bottom < low
        reached = favorable >= config.R
        if close > high + config.O or close < low - config.O:
            return "BREAK", i, favorable, adverse
        if pierced and reached:
            return "PIERCE_AND_REVERT", i, favorable, adverse
        left = left or (bottom < low if resistance else top > high)
        if left and reached:
            return "RESPECT", i, favorable, adverse
        if bars["bar_idx"][i] - bars["bar_idx"][at] >= config.T:
            return "BREAK" if config.treat_timeout_as_break else "TIMEOUT", i, favorable, adverse
    return None


def replay(pdf: pd.DataFrame, config: EpisodeConfig) -> pd.DataFrame:
    """A zone's episodes over its live bars: touch, outcome, then the first later bar wholly outside the band before the next touch counts."""
    pdf = pdf.sort_values("bar_idx", kind="stable").reset_index(drop=True)
    bars = {c: pdf[c].to_numpy(float if c in ("high", "low", "close", "prev_close") else None) for c in ("high", "low", "close", "prev_close", "is_outlier", "has_gap", "micros", "bar_idx")}
    head = pdf.iloc[0]
    level, width, resistance = head["level"], head["width"], head["zone_type"] == "RESISTANCE"
    low, high, stale = level - width, level + width, head["spacing"] * config.max_gap_bars
    touching = np.flatnonzero((bars["low"] <= high) & (bars["high"] >= low))
    outside = np.flatnonzero((bars["high"] < low) | (bars["low"] > high))
    start, found = 0, []
    while (k := np.searchsorted(touching, start)) < len(touching):
        at = int(touching[k])
        ended = track(bars, at, low, high, level, resistance, config, stale)
        if ended is None:
            break
        outcome, end, favorable, adverse = ended
        before = bars["prev_close"][at]
        side = True if before > high else False if before < low else None
        found.append((at, end, outcome, favorable, adverse, side))
        if (k := np.searchsorted(outside, end + 1)) == len(outside):
            break
        start = int(outside[k])
    a, b = ([x[i] for x in found] for i in (0, 1))
    touch, last = pdf.iloc[a].reset_index(drop=True), pdf.iloc[b].reset_index(drop=True)
    out = pd.DataFrame({
        "symbol": touch["symbol"], "zone_id": touch["zone_id"], "zone_type": touch["zone_type"], "outcome": pd.Series([x[2] for x in found], dtype=object), "touch_time": touch["timestamp"],
        "outcome_time": last["timestamp"], "bars_to_outcome": (last["bar_idx"] - touch["bar_idx"]).astype("int32"), "max_favorable": pd.Series([x[3] for x in found], dtype=float),
        "max_adverse": pd.Series([x[4] for x in found], dtype=float), "from_above": pd.Series([x[5] for x in found], dtype=object), "end_idx": last["bar_idx"],
    })
    for m in MEASURES:
        out[f"{m}_at_touch"] = touch[m].astype(float)
    out["is_rth_at_touch"], out["minute_of_day_at_touch"] = touch["is_rth"], touch["minute_of_day"]
    for m in MEASURES:
        out[f"{m}_at_outcome"] = last[m].astype(float)
    return out


def cluster(pivots: pd.DataFrame, width: float, span: int | None) -> list[int]:
    """The cluster of each pivot, in order of price and time: one joins while it is near the running mean, and not too late after the first."""
    total, count, first, number, numbers = 0.0, 0, None, -1, []
    for price, time in zip(pivots["price"], pivots["center_time"], strict=True):
        near = count and abs(price - total / count) <= width
        if near and span is not None and (time - first).days > span:
            near = False
        if not near:
            total, count, first, number = 0.0, 0, time, number + 1
        total, count, first = total + price, count + 1, min(first, time)
        numbers.append(number)
    return numbers
