"""The three jobs: prepare bars, analyze them, sweep over settings."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import EngineConfig, override
from tidegauge.operators import indicators, quality, sessions
from tidegauge.operators.episodes import detect_episodes
from tidegauge.operators.halo import DAY, by_day, carried
from tidegauge.operators.pivots import detect_pivots, detect_pivots_each
from tidegauge.operators.strata import bootstrap_intervals, metric_summary, outcome_rates, stratify
from tidegauge.operators.zones import detect_zones
from tidegauge.session import cut
from tidegauge.sources.bars import first_of_each_time, normalise, read_files


def marked_frame(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Raw bars with file_ord, one row a file, time and symbol, annotated and marked by the filters; rows without a time are left out."""
    once = first_of_each_time(by_day(bars.filter("timestamp is not null")), ["file_ord", "symbol"])
    return quality.marked(sessions.annotate_sessions(once, config.session), config.data_quality)


def prepare_marked(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """Marked rows to prepared bars: those that stay, one a time and symbol, with indicators."""
    clean = first_of_each_time(rows.filter("dropped is null").drop("dropped", "bad_cells"), ["symbol"])
    return indicators.add_indicators(clean, config.indicators).drop(DAY)


def prepare_frame(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Raw bars with file_ord to prepared bars: one row a time and symbol, annotated, validated, with indicators."""
    return prepare_marked(marked_frame(bars, config), config)


def prepare(spark: SparkSession, paths: list[str], config: EngineConfig | None = None) -> DataFrame:
    return prepare_frame(read_files(spark, paths), config or EngineConfig())


def prepare_and_report(spark: SparkSession, paths: list[str], config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Prepared bars and the quality report, both from marked rows that are written once."""
    rows = cut(marked_frame(read_files(spark, paths), config))
    return prepare_marked(rows, config), quality.summary(rows)


def ensure_prepared(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """bars with session columns and indicators where any of them is missing; rows stay as they are."""
    bars = normalise(bars).drop("bad_cells")
    if not set(sessions.COLUMNS) <= set(bars.columns):
        bars = sessions.annotate_sessions(bars, config.session)
    return bars if set(indicators.COLUMNS) <= set(bars.columns) else indicators.add_indicators(bars, config.indicators)


RATES = {"RESPECT": "respect_rate", "PIERCE_AND_REVERT": "pierce_revert_rate", "BREAK": "break_rate", "TIMEOUT": "timeout_rate"}


@dataclass
class Analysis:
    """What analyze() gives, all of it lazy."""

    zones: DataFrame
    episodes: DataFrame
    rates: DataFrame
    metrics: DataFrame
    intervals: DataFrame
    data_shape: DataFrame
    daily_map: DataFrame
    outcome_counts: DataFrame


def analyze(bars: DataFrame, config: EngineConfig | None = None) -> Analysis:
    """Zones of prepared bars, their episodes, and the statistics of each stratum. Bars, zones and episodes are written to the checkpoint folder on the way."""
    config = config or EngineConfig()
    bars = cut(ensure_prepared(bars, config))
    zones = cut(detect_zones(bars, detect_pivots(bars, config.zones), config.zones))
    episodes = cut(stratify(detect_episodes(bars, zones, config.episode)))
    return Analysis(zones, episodes, outcome_rates(episodes), metric_summary(episodes), bootstrap_intervals(episodes, config.episode), data_span(bars), daily_map(bars, zones, episodes, config.session.tz_rth), outcome_counts(episodes))


def data_span(bars: DataFrame) -> DataFrame:
    """One row: rows, columns, first_time and last_time of the bars."""
    return bars.agg(F.count("*").alias("rows"), F.lit(len(bars.columns)).alias("columns"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))


def outcome_counts(episodes: DataFrame) -> DataFrame:
    """symbol, outcome, n: how often each outcome came, INVALID too."""
    return episodes.groupBy("symbol", "outcome").agg(F.count("*").alias("n"))


def run_id(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:10]


def sweep(bars: DataFrame, grid: list[dict]) -> DataFrame:
    """place, run_id, params, n_valid_episodes, n_invalid_episodes and the four rates of each set of settings, in one job.

    Bars are prepared once with the default settings and written to the checkpoint folder; only the groups zones and episode
    take effect. Zones are found for all different groups of zone settings together, keyed by their place in a list, then
    followed in one keyed pass over the bars for all sets, so a grid of hundreds is one plan of the same size. A set without valid episodes has null rates.
    """
    bars = cut(ensure_prepared(bars, EngineConfig()))
    configs = [override(EngineConfig(), params) for params in grid]
    kinds: dict[str, tuple] = {}
    for place, config in enumerate(configs):
        kinds.setdefault(repr(config.zones), (config.zones, []))[1].append(place)
    spark = bars.sparkSession
    sets = spark.createDataFrame([(i, run_id(x), json.dumps(x, sort_keys=True)) for i, x in enumerate(grid)], "place int, run_id string, params string")
    if not grid:
        return sets.selectExpr("*", "0L AS n_valid_episodes", "0L AS n_invalid_episodes", *(f"0D AS {c}" for c in RATES.values()))
    zones, places = [c for c, _ in kinds.values()], F.array(*(F.array(*map(F.lit, p)) for _, p in kinds.values()))
    found = detect_zones(bars, detect_pivots_each(bars, zones), zones).withColumn("place", F.explode(F.element_at(places, F.col("kind") + 1))).drop("kind")
    counted = detect_episodes(bars, cut(found), [c.episode for c in configs], "place").groupBy("place").agg(
        F.count_if(F.col("outcome") != "INVALID").alias("n_valid_episodes"), F.count_if(F.col("outcome") == "INVALID").alias("n_invalid_episodes"),
        *(F.count_if(F.col("outcome") == outcome).alias(rate) for outcome, rate in RATES.items()),
    )
    out = sets.join(counted, "place", "left").fillna(0, ["n_valid_episodes", "n_invalid_episodes"])
    return out.select("place", "run_id", "params", "n_valid_episodes", "n_invalid_episodes", *(F.try_divide(c, "n_valid_episodes").alias(c) for c in RATES.values()))


def nearest_bars(episodes: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, zone_id, touch_time, bar_time and touch_price: the bar nearest to each touch, the earlier of two as near, and its close.

    Both sides are laid in one order of time; a touch looks back and forth inside its day, and at what the days around hand on.
    """
    bar = F.struct(F.col("timestamp").alias("at"), F.col("close").alias("price")).alias("bar")
    marks = episodes.select("symbol", F.col("touch_time").alias("timestamp"), "zone_id").unionByName(bars.select("symbol", "timestamp", F.lit(None).cast("int").alias("zone_id"), bar), allowMissingColumns=True)
    seen = marks.withColumn("t", F.col("timestamp"))
    for side, ahead in (("back", False), ("ahead", True)):
        # A bar at the touch's own time counts on either side: bars come first in the order looked along.
        at = F.struct(F.col("t"), F.col("zone_id").isNull() if ahead else F.col("zone_id").isNotNull())
        seen = carried(seen, {side: F.col("bar")}, at, ("symbol",), ahead)
    gap = lambda c: F.abs(F.unix_micros(F.col(c)["at"]) - F.unix_micros("t"))
    near = F.when(F.col("ahead").isNull() | (gap("back") <= gap("ahead")), F.col("back")).otherwise(F.col("ahead"))
    seen = seen.filter(F.col("zone_id").isNotNull()).withColumn("near", near)
    return seen.select("symbol", "zone_id", F.col("t").alias("touch_time"), F.col("near.at").alias("bar_time"), F.col("near.price").alias("touch_price"))


def zones_by_session(bars: DataFrame, zones: DataFrame, tz: str) -> DataFrame:
    """symbol, session_date, zone_id: the zones that live on each session, for daily maps."""
    local = lambda c: F.to_date(F.from_utc_timestamp(c, tz))
    days = zones.select("symbol", F.col("id").alias("zone_id"), F.explode(F.sequence(local("activation_time"), local("expiry_time"))).alias("session_date"))
    return days.join(bars.select("symbol", "session_date").distinct(), ["symbol", "session_date"]).select("symbol", "session_date", "zone_id")


def daily_map(bars: DataFrame, zones: DataFrame, episodes: DataFrame, tz: str) -> DataFrame:
    """symbol, session_date, kind, starts, ends, zone_id, price, low, high, label: what a chart of each session shows.

    kind close: the bars' closes; zone: level and band of the zones that live on that local date; episode: a mark at the touch,
    with the nearest bar's close and the outcome. A touch belongs to the session of its UTC date, as the surveyed engine has it.
    """
    null = {"starts": "timestamp", "ends": "timestamp", "zone_id": "int", "price": "double", "low": "double", "high": "double", "label": "string"}
    order = ["symbol", "session_date", "kind", *null]
    rows = lambda df, kind: df.withColumn("kind", F.lit(kind)).withColumns({c: F.lit(None).cast(t) for c, t in null.items() if c not in df.columns}).select(order)
    closes = rows(bars.select("symbol", "session_date", F.col("timestamp").alias("starts"), F.col("close").alias("price")), "close")
    bands = zones.select("symbol", F.col("id").alias("zone_id"), F.col("level").alias("price"), (F.col("level") - F.col("width")).alias("low"), (F.col("level") + F.col("width")).alias("high"), F.col("type").alias("label"))
    live = rows(zones_by_session(bars, zones, tz).join(bands, ["symbol", "zone_id"]), "zone")
    marks = nearest_bars(episodes, bars).join(episodes.select("symbol", "zone_id", "touch_time", "outcome_time", "outcome"), ["symbol", "zone_id", "touch_time"])
    marks = marks.select("symbol", F.to_date("touch_time").alias("session_date"), F.col("touch_time").alias("starts"), F.col("outcome_time").alias("ends"), "zone_id", F.col("touch_price").alias("price"), F.col("outcome").alias("label"))
    marks = marks.join(bars.select("symbol", "session_date").distinct(), ["symbol", "session_date"], "left_semi")
    return closes.unionByName(live).unionByName(rows(marks, "episode"))


def histograms(episodes: DataFrame, bins: int = 50) -> DataFrame:
    """metric, bin, n: values of bars_to_outcome, max_favorable and max_adverse from 0 to their 99th percentile, in equal bins."""
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("bars_to_outcome", "max_favorable", "max_adverse")))
    rows = episodes.select(F.inline(values)).filter("value is not null")
    top = rows.groupBy("metric").agg(F.percentile("value", F.lit(0.99)).alias("top"))
    cut = F.when(F.col("top") <= 0, 1).otherwise(F.least(F.floor(F.try_divide(F.col("value") * bins, F.col("top"))) + 1, F.lit(bins)))
    return rows.join(F.broadcast(top), "metric").filter("value <= top").groupBy("metric", cut.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # top: 3 rows
