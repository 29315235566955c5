"""Pivots: bars that stand out among the k bars on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegauge.config import ZoneConfig
from tidegauge.operators.halo import bounded, numbered


def detect_pivots(bars: DataFrame, config: ZoneConfig) -> DataFrame:
    """symbol, type, price, center_time, confirm_time, index, session_date of each pivot high and low.

    A high: at least the greatest high of the window less a tick, above the bar before, not below the bar after; a low alike
    the other way up. Windows that are cut short or hold an unknown value have none. A bar can be both.
    """
    k = config.pivot_k

    def frames(order: WindowSpec) -> dict[str, Column]:
        around, columns = order.rowsBetween(-k, k), {"confirm_time": F.lead("timestamp", k).over(order)}
        for c, best in (("high", F.max), ("low", F.min)):
            columns |= {f"{c}_n": F.count(c).over(around), f"{c}_best": best(c).over(around), f"{c}_before": F.lag(c).over(order), f"{c}_after": F.lead(c).over(order)}
        return columns

    seen = bounded(numbered(bars.select("symbol", "timestamp", "session_date", "high", "low"), "index"), k, k, frames, place="index")
    full = 2 * k + 1
    up = (F.col("high_n") == full) & (F.col("high") >= F.col("high_best") - config.tick_size) & (F.col("high") > F.col("high_before")) & (F.col("high") >= F.col("high_after"))
    down = (F.col("low_n") == full) & (F.col("low") <= F.col("low_best") + config.tick_size) & (F.col("low") < F.col("low_before")) & (F.col("low") <= F.col("low_after"))
    kinds = F.array_compact(F.array(F.when(up, F.struct(F.lit("HIGH").alias("type"), F.col("high").alias("price"))), F.when(down, F.struct(F.lit("LOW").alias("type"), F.col("low").alias("price")))))
    return seen.withColumn("p", F.explode(kinds)).select("symbol", "p.type", "p.price", F.col("timestamp").alias("center_time"), "confirm_time", "index", "session_date")


def detect_pivots_each(bars: DataFrame, configs: list[ZoneConfig]) -> DataFrame:
    """The pivots of each config, in kind its place in the list; one plan, whatever their number.

    A bar carries the bars around it as far as the largest k reaches; each different pair of k and tick size is a row of a table
    that is exploded against them, and its pivots go to all kinds that share it.
    """
    pairs: dict[tuple, list[int]] = {}
    for kind, c in enumerate(configs):
        pairs.setdefault((c.pivot_k, float(c.tick_size)), []).append(kind)
    widest = max(k for k, _ in pairs)
    frames = lambda order: {"around": F.collect_list(F.struct("index", "timestamp", "high", "low")).over(order.rowsBetween(-widest, widest))}
    seen = bounded(numbered(bars.select("symbol", "timestamp", "session_date", "high", "low"), "index"), widest, widest, frames, place="index")
    settings = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(tick).alias("tick"), F.array(*map(F.lit, kinds)).alias("kinds")) for (k, tick), kinds in pairs.items()))
    rows = seen.withColumn("s", F.explode(settings)).withColumn("near", F.filter("around", lambda x: F.abs(x["index"] - F.col("index")) <= F.col("s.k"))).drop("around")
    at = lambda i, c: F.get(F.filter("near", lambda x: x["index"] == F.col("index") + i), F.lit(0))[c]
    full = lambda c: F.size(F.filter("near", lambda x: x[c].isNotNull())) == 2 * F.col("s.k") + 1
    best = lambda c, pick: pick(F.transform("near", lambda x: x[c]))
    up = full("high") & (F.col("high") >= best("high", F.array_max) - F.col("s.tick")) & (F.col("high") > at(-1, "high")) & (F.col("high") >= at(1, "high"))
    down = full("low") & (F.col("low") <= best("low", F.array_min) + F.col("s.tick")) & (F.col("low") < at(-1, "low")) & (F.col("low") <= at(1, "low"))
    kinds = F.array_compact(F.array(F.when(up, F.struct(F.lit("HIGH").alias("type"), F.col("high").alias("price"))), F.when(down, F.struct(F.lit("LOW").alias("type"), F.col("low").alias("price")))))
    found = rows.withColumn("confirm_time", at(F.col("s.k"), "timestamp")).withColumn("p", F.explode(kinds))
    return found.select(F.explode("s.kinds").alias("kind"), "symbol", "p.type", "p.price", F.col("timestamp").alias("center_time"), "confirm_time", "index", "session_date")
