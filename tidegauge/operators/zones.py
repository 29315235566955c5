"""Zones: pivots of a side clustered by price, tested for significance, corrected, merged and numbered."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegauge.config import ZoneConfig
from tidegauge.functions.numbers import binomial_tail
from tidegauge.operators.ranks import percentiles
from tidegauge.session import cut

ALPHA, WIDTH = 0.05, 15.0
_SIDE = ("kind", "symbol", "type")


def _each(rows: DataFrame, config) -> tuple[DataFrame, list, list[str]]:
    """rows with kind, which config of several a row belongs to (0 where there is one); the configs; and a column to drop in the end if kind wasn't there."""
    several = "kind" in rows.columns
    return rows if several else rows.withColumn("kind", F.lit(0)), list(config) if isinstance(config, list | tuple) else [config], [] if several else ["kind"]


def _of_kind(values: list, type_: str) -> Column:
    """The value of the row's kind."""
    return F.element_at(F.array(*(F.lit(v).cast(type_) for v in values)), F.col("kind") + 1)


def islands(rows: DataFrame, value: str, gap: Column, order: list[str]) -> DataFrame:
    """rows with island: numbers runs, in order of value within kind, symbol and type, without a step above gap.

    A running mean never exceeds the run's last value, so no fold can reach over such a step: islands fold independently.
    """
    by = Window.partitionBy(*_SIDE).orderBy(value, *order)
    new = F.coalesce(F.col(value) - F.lag(value).over(by) > gap, F.lit(False)).cast("int")
    return rows.withColumn("new_", new).withColumn("island", F.sum("new_").over(by)).drop("new_")


DAY = 86_400_000_000


def cluster_pivots(pivots: DataFrame, config: ZoneConfig | list[ZoneConfig]) -> DataFrame:
    """pivots with cluster, numbered by price within symbol and type; those of clusters with too few touches are left out. A list of configs: those of each kind.

    The fold takes price levels, not pivots: all pivots of one price join one cluster or begin one together, as the mean only
    comes nearer to them; so a group is as long as its prices, however many pivots they have. With a longest span of days
    a level carries its times in order, eight bytes each, and falls into runs, each found by one search.
    """
    pivots, configs, spare = _each(pivots, config)
    widths, spans = [c.cluster_width_points or WIDTH for c in configs], [c.max_cluster_span_days for c in configs]
    spanned = any(x is not None for x in spans)
    times = F.sort_array(F.collect_list(F.unix_micros("center_time"))) if spanned else F.lit(None).cast("array<long>")
    levels = pivots.groupBy(*_SIDE, "price").agg(F.count("*").alias("n"), times.alias("times"))
    fields = "kind int, symbol string, type string, island long, price double, fold long, n long, since long, until long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        width, span = (x[int(pdf["kind"].iloc[0])] for x in (widths, spans))
        total, count, first, cluster, rows = 0.0, 0, 0, -1, []
        for price, n, own in pdf.sort_values("price")[["price", "n", "times"]].itertuples(index=False):
            at = 0
            while at < n:
                near = count and abs(price - total / count) <= width
                if span is not None and near:
                    near = own[at] - first < (span + 1) * DAY
                if not near:
                    total, count, cluster = 0.0, 0, cluster + 1
                to, since, until = n, None, None
                if span is not None:
                    first = min(first, own[at]) if near else own[at]
                    to = max(at + 1, int(np.searchsorted(own, first + (span + 1) * DAY)))
                    since, until = own[at], own[to - 1]
                total, count = total + price * (to - at), count + to - at
                rows.append((price, cluster, to - at, since, until))
                at = to
        out = pd.DataFrame(rows, columns=["price", "fold", "n", "since", "until"]).astype({"since": "Int64", "until": "Int64"})
        return out.assign(**{c: pdf[c].iloc[0] for c in (*_SIDE, "island")})[[x.split()[0] for x in fields.split(", ")]]

    folded = islands(levels, "price", _of_kind(widths, "double"), []).groupBy(*_SIDE, "island").applyInPandas(fold, fields)
    kept = folded.withColumn("n_", F.sum("n").over(Window.partitionBy(*_SIDE, "island", "fold"))).filter(F.col("n_") >= _of_kind([c.min_touches_for_significance for c in configs], "int"))
    number = F.dense_rank().over(Window.partitionBy(*_SIDE).orderBy("island", "fold")) - 1
    runs = kept.select(*_SIDE, "price", "since", "until", number.cast("long").alias("cluster"))
    out = pivots.join(runs, [*_SIDE, "price"])
    if spanned:
        out = out.filter(F.col("since").isNull() | F.unix_micros("center_time").between(F.col("since"), F.col("until")))
    return out.select(*pivots.columns, "cluster").drop(*spare)


def candidates(bars: DataFrame, clusters: DataFrame, config: ZoneConfig | list[ZoneConfig]) -> DataFrame:
    """symbol, type, cluster, level, width, activation_time, touches, p_value of each cluster; kind too where there are several configs.

    Sessions that a cluster spans come from an equi-join on their dates, with each session's extremes worked out first.
    """
    clusters, configs, spare = _each(clusters, config)
    alphas = [c.zone_width_alpha_atr for c in configs]
    by = [*_SIDE, "cluster"]
    confirmed = F.sort_array(F.collect_list("confirm_time"))
    zones = clusters.groupBy(*by).agg(
        F.avg("price").alias("level"), F.transform(F.sort_array(F.collect_list(F.struct("price", "center_time"))), lambda x: x["price"]).alias("touches"),
        F.min("center_time").alias("t0"), F.max("center_time").alias("t1"), F.min("session_date").alias("d0"), F.max("session_date").alias("d1"),
        F.coalesce(F.get(confirmed, F.lit(1)), F.get(confirmed, F.lit(0))).alias("activation_time"),
    )
    days = zones.select(*by, "t0", "t1", F.explode(F.sequence("d0", "d1")).alias("session_date"))
    width = _of_kind([float(c.zone_width_points or WIDTH) for c in configs], "double")
    if any(x is not None for x in alphas):
        inside = days.filter(_of_kind(alphas, "double").isNotNull()).join(bars.select("symbol", "session_date", "timestamp", "atr"), ["symbol", "session_date"]).filter("timestamp between t0 and t1")
        middle = lambda rows, keys, name: percentiles(rows, keys, "atr", [0.5]).select(*keys, F.get("q", F.lit(0)).alias(name))
        zones = zones.join(middle(inside, by, "atr_"), by, "left").join(middle(bars, ["symbol"], "atr_all_"), "symbol", "left")
        alpha = _of_kind(alphas, "double")
        width = F.when(alpha.isNotNull(), F.greatest(F.lit(1e-9), alpha * F.coalesce("atr_", "atr_all_"))).otherwise(width)
    zones, tests = zones.withColumn("width", width), [c.significance_test for c in configs]
    if not any(tests):
        zones = zones.withColumn("p_value", F.lit(0.0))
    else:
        extremes = bars.groupBy("symbol", "session_date").agg(F.max(F.greatest("high", "low")).alias("top"), F.min(F.least("high", "low")).alias("bottom"))
        spread = days.join(extremes, ["symbol", "session_date"]).groupBy(*by).agg((F.max("top") - F.min("bottom")).alias("range"))
        zones = zones.join(spread, by, "left")
        own, times = _of_kind([c.cluster_width_points for c in configs], "double"), _of_kind([c.null_width_multiplier for c in configs], "double")
        zones = zones.withColumn("wide", F.greatest(F.col("width"), F.coalesce(own, F.col("width")) * times)).withColumn("n", F.size("touches"))
        zones = zones.withColumn("x", F.size(F.filter("touches", lambda t: F.abs(t - F.col("level")) <= F.col("wide"))))
        share = F.least(F.lit(1.0), F.try_divide(2 * F.col("wide"), F.col("range")))
        tested = (F.col("n") >= 2) & (F.col("range") > 0)
        p_value = F.when(tested, binomial_tail("n", "x", F.coalesce(share, F.lit(1.0)))).otherwise(1.0)
        zones = zones.withColumn("p_value", F.when(_of_kind(tests, "boolean"), p_value).otherwise(0.0))
    return zones.select(*by, "level", "width", "activation_time", "touches", "p_value").drop(*spare)


def significant(zones: DataFrame, config: ZoneConfig | list[ZoneConfig], alpha: float = ALPHA) -> DataFrame:
    """Benjamini-Hochberg within kind, symbol and type: all zones up to the last whose p-value is at most alpha * rank / count. Without fdr: those whose p-value is below alpha; without a test all."""
    zones, configs, spare = _each(zones, config)
    side = Window.partitionBy(*_SIDE)
    ranked = zones.withColumns({"i_": F.row_number().over(side.orderBy("p_value", "cluster")), "m_": F.count("*").over(side)})
    last = F.max(F.when(F.col("p_value") <= alpha * F.col("i_") / F.col("m_"), F.col("i_"))).over(side)
    passes = F.when(_of_kind([c.fdr for c in configs], "boolean"), F.coalesce(F.col("i_") <= F.col("last_"), F.lit(False))).otherwise(F.col("p_value") < alpha)
    tests = _of_kind([c.significance_test for c in configs], "boolean")
    return ranked.withColumn("last_", last).filter(~tests | passes).drop("i_", "m_", "last_", *spare)


def merge_close(zones: DataFrame, tolerance: float | list[float]) -> DataFrame:
    """Zones of a side within the tolerance of the running level become one: level weighted by touches, least p-value, earliest activation, widths averaged pair by pair."""
    zones, tolerances, spare = _each(zones, tolerance)
    level = F.col("level")
    if max(tolerances) <= 0:
        return zones.withColumn("place", F.col("cluster").cast("double")).drop(*spare)
    zones = cut(zones)  # read for the fold, and for the touches

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each zone the first one that it is merged into, its place there, and what the merged zone comes to."""
        heads, head, near = [], None, tolerances[int(pdf["kind"].iloc[0])]
        for row in pdf.sort_values(["level", "cluster"], kind="stable").to_dict("records"):
            if head and near > 0 and abs(row["level"] - head["level"]) <= near:
                head["level"] = (head["level"] * head["n"] + row["level"] * row["n"]) / (head["n"] + row["n"])
                head["n"] += row["n"]
                head["p_value"], head["activation_time"] = min(head["p_value"], row["p_value"]), min(head["activation_time"], row["activation_time"])
                head["width"] = (head["width"] + row["width"]) / 2
            else:
                head = row | {"members": []}
                heads.append(head)
            head["members"].append(row["cluster"])
        rows = [{**h, "cluster": c, "head": h["members"][0], "at": i} for h in heads for i, c in enumerate(h["members"])]
        return pd.DataFrame(rows, columns=names)

    slim = islands(zones.withColumn("n", F.size("touches")).drop("touches"), "level", _of_kind(tolerances, "double"), ["cluster"])
    names = [*slim.columns, "head", "at"]
    merged = slim.groupBy(*_SIDE, "island").applyInPandas(fold, StructType([*slim.schema.fields, StructField("head", LongType()), StructField("at", LongType())]))
    touches = merged.select(*_SIDE, "cluster", "head", "at").join(zones.select(*_SIDE, "cluster", "touches"), [*_SIDE, "cluster"])
    touches = touches.groupBy(*_SIDE, "head").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "touches"))), lambda x: x["touches"])).alias("touches"))
    out = merged.filter("at = 0").drop("cluster").join(touches, [*_SIDE, "head"]).withColumnRenamed("head", "cluster")
    place = F.when(_of_kind(tolerances, "double") > 0, level).otherwise(F.col("cluster").cast("double"))
    return out.select(*zones.columns, place.alias("place")).drop(*spare)


def detect_zones(bars: DataFrame, pivots: DataFrame, config: ZoneConfig | list[ZoneConfig]) -> DataFrame:
    """symbol, id, type, level, width, activation_time, expiry_time, touches, p_value, is_significant; ids from 1, resistances first, each side by level.

    A list of configs, pivots having a kind for each: the zones of all, with kind first. The plan's size doesn't depend on their number.
    """
    pivots, configs, spare = _each(pivots, config)
    found = significant(candidates(bars, cluster_pivots(pivots, configs), configs), configs)
    merged = merge_close(found, [c.merge_tolerance_points for c in configs]).withColumn("type", F.when(F.col("type") == "HIGH", "RESISTANCE").otherwise("SUPPORT"))
    number = F.row_number().over(Window.partitionBy("kind", "symbol").orderBy("type", "place", "cluster"))
    expiry = F.timestamp_micros(F.unix_micros("activation_time") + _of_kind([c.expire_days for c in configs], "long") * 86_400_000_000)
    return merged.withColumns({"id": number.cast("int"), "expiry_time": expiry, "is_significant": F.lit(True)}).select(
        "kind", "symbol", "id", "type", "level", "width", "activation_time", "expiry_time", "touches", "p_value", "is_significant"
    ).drop(*spare)
