"""Strata of episodes, and statistics of each: counts, rates with exact intervals, metrics with bootstrap intervals."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import EpisodeConfig
from tidegauge.functions.numbers import bootstrap_interval, rate_interval
from tidegauge.operators.ranks import percentiles, ranked
from tidegauge.session import cut

OUTCOMES = ("RESPECT", "PIERCE_AND_REVERT", "BREAK", "TIMEOUT")
METRICS = ("bars_to_outcome", "max_favorable", "max_adverse")


def terciles(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with low, mid or high for each named column, by rank among a symbol's known values, ties in order of zone and time; n/a throughout if fewer than two are known.

    symbol, zone_id and touch_time name a row. All columns are ranked together, by ranges of their values.
    """
    key = ["symbol", "zone_id", "touch_time"]
    values = F.array(*(F.struct(F.lit(new).alias("name_"), F.col(c).cast("double").alias("value_")) for new, c in columns.items()))
    rows = cut(rows)
    melted = rows.select(*key, F.inline(values)).filter("value_ is not null")
    counts = melted.groupBy("symbol", "name_").agg(F.count("*").alias("n_"))
    placed = ranked(melted, ["symbol", "name_"], ["value_", "zone_id", "touch_time"], "rank_").join(counts, ["symbol", "name_"])
    part = F.when(3 * F.col("rank_") < F.col("n_") - 1, "low").when(3 * F.col("rank_") < 2 * (F.col("n_") - 1), "mid").otherwise("high")
    placed = placed.filter("n_ > 1").groupBy(*key).agg(*(F.max(F.when(F.col("name_") == new, part)).alias(new) for new in columns))
    many = counts.groupBy("symbol").agg(*(F.max(F.when(F.col("name_") == new, F.col("n_"))).alias(f"{new}_n_") for new in columns))
    out = rows.join(placed, key, "left").join(many, "symbol", "left")
    return out.withColumns({new: F.when(F.coalesce(f"{new}_n_", F.lit(0)) < 2, "n/a").otherwise(F.col(new)) for new in columns}).drop(*(f"{new}_n_" for new in columns))


def stratify(episodes: DataFrame) -> DataFrame:
    """episodes with hour_at_touch, atr_tercile, rvol_tercile, stoch_tercile, stoch_overbought_touch, stoch_oversold_touch and strata, the names of all strata of the episode."""
    k = F.col("stoch_k_at_touch")
    out = terciles(episodes, {"atr_tercile": "atr_at_touch", "rvol_tercile": "rvol_at_touch", "stoch_tercile": "stoch_k_at_touch"}).withColumns({
        "hour_at_touch": F.floor(F.col("minute_of_day_at_touch") / 60).cast("int"), "stoch_overbought_touch": F.coalesce(k >= 80, F.lit(False)), "stoch_oversold_touch": F.coalesce(k <= 20, F.lit(False)),
    })
    names = [
        F.lit("all"), F.when(F.col("is_rth_at_touch"), "rth").otherwise("eth"), F.when(F.col("stoch_overbought_touch"), "stoch_ge80"),
        F.when(F.col("stoch_oversold_touch"), "stoch_le20"), F.concat(F.lit("hour_"), "hour_at_touch"), *(F.concat(F.lit(f"{m}_"), f"{m}_tercile") for m in ("atr", "rvol", "stoch")),
    ]
    return out.withColumn("strata", F.array_compact(F.array(*names)))


def outcome_rates(stratified: DataFrame) -> DataFrame:
    """A row for each symbol, stratum and outcome: n_episodes (valid), n_invalid, n, rate, ci_low, ci_high; zero counts too."""
    rows = stratified.select("symbol", F.explode("strata").alias("stratum"), "outcome")
    counts = rows.groupBy("symbol", "stratum").agg(
        F.count_if(F.col("outcome") != "INVALID").alias("n_episodes"), F.count_if(F.col("outcome") == "INVALID").alias("n_invalid"),
        F.array(*(F.struct(F.lit(o).alias("outcome"), F.count_if(F.col("outcome") == o).alias("n")) for o in OUTCOMES)).alias("each"),
    )
    out = counts.select("symbol", "stratum", "n_episodes", "n_invalid", F.inline("each"))
    out = out.withColumns({"rate": F.try_divide("n", "n_episodes"), "ci_": rate_interval("n", "n_episodes")})
    known = F.col("n_episodes") > 0
    return out.withColumns({"ci_low": F.when(known, F.col("ci_.low")), "ci_high": F.when(known, F.col("ci_.high"))}).drop("ci_")


def metric_summary(stratified: DataFrame) -> DataFrame:
    """mean, median, p25 and p75 of each metric over the valid episodes of each symbol and stratum, where there are two at least."""
    found = percentiles(_melted(stratified), ["symbol", "stratum", "metric"], "value", [0.25, 0.5, 0.75]).filter("n >= 2")
    return found.select("symbol", "stratum", "metric", "n", "mean", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(2)).alias("p75"))


def _melted(stratified: DataFrame) -> DataFrame:
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))
    rows = stratified.filter("outcome <> 'INVALID'").select("symbol", "zone_id", "touch_time", F.explode("strata").alias("stratum"), values.alias("v"))
    return rows.select("symbol", "zone_id", "touch_time", "stratum", F.inline("v")).filter(F.col("value").isNotNull())


def bootstrap_intervals(stratified: DataFrame, config: EpisodeConfig, n_boot: int = 1000) -> DataFrame:
    """mean_low, mean_high, median_low, median_high of each metric; values in order of zone and time, a group being one symbol's stratum."""
    block = config.T // 2 or 5

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values(["zone_id", "touch_time"], kind="stable")["value"].to_numpy(float)
        if len(data) < 2:
            return pd.DataFrame(columns=["symbol", "stratum", "metric", "mean_low", "mean_high", "median_low", "median_high"])
        ends = [*bootstrap_interval(data, np.mean, n_boot, block), *bootstrap_interval(data, np.median, n_boot, block)]
        return pd.DataFrame([[pdf["symbol"].iloc[0], pdf["stratum"].iloc[0], pdf["metric"].iloc[0], *ends]], columns=["symbol", "stratum", "metric", "mean_low", "mean_high", "median_low", "median_high"])

    return _melted(stratified).groupBy("symbol", "stratum", "metric").applyInPandas(run, "symbol string, stratum string, metric string, mean_low double, mean_high double, median_low double, median_high double")


GROUP = ["symbol", "stratum", "metric"]
ENDS = ("mean_low", "mean_high", "median_low", "median_high")
#: Values of a group that travel as one array to each chunk of its resamples at most, resamples of a chunk, and the seed of the draws.
MOST_VALUES, CHUNK, SEED = 1_000_000, 50, 42


def draw(key: str, resample: int, piece: int, n: int) -> int:
    """Where a block starts: 48 bits of the MD5 of seed, group, resample and piece, modulo n. Any engine can work it out, in any order."""
    return int(hashlib.md5(f"{SEED}|{key}|{resample}|{piece}".encode()).hexdigest()[:12], 16) % n


def keyed_intervals(stratified: DataFrame, config: EpisodeConfig, n_boot: int = 1000, most: int = MOST_VALUES) -> DataFrame:
    """symbol, stratum, metric and the ends of the bootstrap intervals of mean and median, from draws that are hashes of their place.

    Blocks of values in order of zone and time, circular, as in bootstrap_intervals(); but no draw follows another, so chunks of
    a group's resamples are tasks of their own and rerun alike. Values of groups of up to `most` travel as an array; those of
    larger groups stay rows that draws meet by place, so a group of any size is spread.
    """
    block = config.T // 2 or 5
    placed = cut(ranked(_melted(stratified), GROUP, ["zone_id", "touch_time"], "place"))
    sizes = placed.groupBy(*GROUP).agg(F.count("*").alias("n")).filter("n > 1")
    few = placed.join(sizes.filter(F.col("n") <= most), GROUP).groupBy(*GROUP, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    # A number of partitions that adaptive execution leaves alone: chunks are small in bytes, but long to work out.
    tasks = int(stratified.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = few.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(CHUNK)))).repartition(tasks, *GROUP, "first")

    def run(batches):
        for pdf in batches:
            rows = []
            for symbol, stratum, metric, n, values, first in pdf[[*GROUP, "n", "values", "first"]].itertuples(index=False):
                data, key, width = np.asarray(values, float), f"{symbol}|{stratum}|{metric}", block if n >= block else 1
                for b in range(first, min(first + CHUNK, n_boot)):
                    starts = np.array([draw(key, b, piece, n) for piece in range(-(-n // width))])
                    own = data[(starts[:, None] + np.arange(width)).ravel()[:n] % n]
                    rows.append((symbol, stratum, metric, b, own.mean(), np.median(own)))
            yield pd.DataFrame(rows, columns=[*GROUP, "resample", "mean", "median"])

    fields = "symbol string, stratum string, metric string, resample int, mean double, median double"
    found = chunks.mapInPandas(run, fields)
    if not sizes.filter(F.col("n") > most).isEmpty():
        width = F.when(F.col("n") >= block, block).otherwise(1)
        draws = sizes.filter(F.col("n") > most).withColumn("width", width).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        draws = draws.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("width")) - 1)))
        digest = F.md5(F.concat_ws("|", F.lit(SEED), *GROUP, "resample", "piece"))
        start = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
        draws = draws.withColumn("start", start).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).filter(F.col("piece") * F.col("width") + F.col("j") < F.col("n"))
        met = draws.withColumn("place", (F.col("start") % F.col("n") + F.col("j")) % F.col("n")).join(placed.select(*GROUP, "place", "value"), [*GROUP, "place"])
        spread = percentiles(met, [*GROUP, "resample"], "value", [0.5])
        found = found.unionByName(spread.select(*GROUP, "resample", "mean", F.get("q", F.lit(0)).alias("median")))
    shares = F.array(F.lit(0.025), F.lit(0.975))
    ends = found.groupBy(*GROUP).agg(F.percentile("mean", shares).alias("m"), F.percentile("median", shares).alias("d"))  # n_boot values a group
    return ends.select(*GROUP, *(F.get(c, F.lit(i)).alias(name) for name, (c, i) in zip(ENDS, (("m", 0), ("m", 1), ("d", 0), ("d", 1)), strict=True)))
