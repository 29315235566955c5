"""The registered queries over bars of 15 minutes, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import DataQualityConfig, EngineConfig, IndicatorConfig, SessionConfig, ZoneConfig, override
from tidegauge.operators import indicators, quality, sessions, strata, zones
from tidegauge.operators.episodes import MEASURES, detect_episodes
from tidegauge.operators.pivots import detect_pivots
from tidegauge.plans import engine
from tidegauge.session import cut
from tidegauge.sources.bars import BARS_SQL, bars_from_events, first_of_each_time

MINUTES = 15
GRID = [{}, {"episode": {"R": 10, "O": 4}}, {"zones": {"pivot_k": 3, "zone_width_points": 8.0}}]


def _text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _rounded(*columns: str, places: int = 6):
    return [F.round(c, places).alias(c) for c in columns]


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.annotate_sessions(bars_from_events(spark, sf_dir, MINUTES), SessionConfig())


def _prepared(spark, sf_dir, minutes=MINUTES):
    bars = bars_from_events(spark, sf_dir, minutes).withColumn("file_ord", F.lit(0))
    return engine.prepare_frame(bars, EngineConfig())


def dirty(bars: DataFrame) -> DataFrame:
    """Bars with planted faults by their number i: swapped high and low, no volume, spikes, jumps within the limit."""
    bars = indicators.indexed(bars).withColumn("file_ord", F.lit(0))
    i = F.col("bar_idx")
    factor = F.when(i % 83 == 5, 1.5).when(i % 211 == 50, 1.05).otherwise(1.0)
    bars = bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")})
    swap = i % 97 == 13
    return bars.withColumns({"high": F.when(swap, F.col("low")).otherwise(F.col("high")), "low": F.when(swap, F.col("high")).otherwise(F.col("low")), "volume": F.when(i % 89 == 7, 0).otherwise(F.col("volume"))})


def bars(spark, sf_dir):
    return bars_from_events(spark, sf_dir, MINUTES).select(_text("timestamp"), "open", "high", "low", "close", "volume")


def bar_sessions(spark, sf_dir):
    return _annotated(spark, sf_dir).select(_text("timestamp"), _text("local_time"), F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), "minute_of_day", "is_rth")


def quality_report(spark, sf_dir):
    found = quality.report(dirty(_annotated(spark, sf_dir)), DataQualityConfig())
    return found.withColumn("removal_pct", F.round("removal_pct", 6))


def quality_flags(spark, sf_dir):
    return quality.validate(dirty(_annotated(spark, sf_dir)), DataQualityConfig()).select(_text("timestamp"), "bar_idx", "is_outlier", "has_gap")


def window_indicators(spark, sf_dir):
    out = indicators.stochastics(indicators.relative_volume(indicators.true_range(bars_from_events(spark, sf_dir, MINUTES)), 1), 14, 3)
    return out.select(_text("timestamp"), *_rounded("tr", "avg_volume_lookback", "rvol", "stoch_k", "stoch_d"))


def recursive_indicators(spark, sf_dir):
    return indicators.add_indicators(bars_from_events(spark, sf_dir, MINUTES), IndicatorConfig()).select(_text("timestamp"), *_rounded("atr", "rsi"))


def pivots(spark, sf_dir):
    found = detect_pivots(_annotated(spark, sf_dir), ZoneConfig())
    return found.select("type", "price", _text("center_time"), _text("confirm_time"), "index")


def pivot_clusters(spark, sf_dir):
    found = zones.cluster_pivots(detect_pivots(_annotated(spark, sf_dir), ZoneConfig()), ZoneConfig())
    return found.groupBy("type", "cluster").agg(F.count("*").alias("touches"), F.round(F.avg("price"), 6).alias("level"), F.min("price").alias("least"), F.max("price").alias("most"))


def zone_candidates(spark, sf_dir):
    own, config = _annotated(spark, sf_dir), ZoneConfig()
    found = zones.candidates(own, zones.cluster_pivots(detect_pivots(own, config), config), config)
    return found.select("type", "cluster", *_rounded("level", "width"), _text("activation_time"), F.size("touches").alias("n_touches"), F.round("p_value", 9).alias("p_value"))


def atr_zones(spark, sf_dir):
    """Zones as wide as half the median ATR of their pivots' span, each judged by itself."""
    own, config = cut(_prepared(spark, sf_dir)), ZoneConfig(zone_width_alpha_atr=0.5, fdr=False)
    found = zones.significant(zones.candidates(own, zones.cluster_pivots(detect_pivots(own, config), config), config), config)
    return found.select("type", "cluster", *_rounded("level", "width"), _text("activation_time"), F.size("touches").alias("n_touches"), F.round("p_value", 9).alias("p_value"))


def first_of_times(spark, sf_dir):
    """Two files that share times: of every hundredth bar the second has another version, and of every seventh it repeats a time itself."""
    own = indicators.indexed(bars_from_events(spark, sf_dir, MINUTES))
    again = own.filter("bar_idx % 101 = 3 or bar_idx > 2000").withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")}).withColumn("file_ord", F.lit(1))
    twice = again.filter("bar_idx % 7 = 0").withColumns({c: F.col(c) + 2 for c in ("open", "high", "low", "close")})
    every = own.filter("bar_idx <= 2500").withColumn("file_ord", F.lit(0)).unionByName(again).unionByName(twice)
    each = first_of_each_time(every, ["file_ord", "symbol"])
    return first_of_each_time(each, ["symbol"]).select(_text("timestamp"), "file_ord", "open", "high", "low", "close")


def unknown_pivots(spark, sf_dir):
    """Pivots where every 53rd high and every 71st low is unknown: windows that hold one have none of that side."""
    own = indicators.indexed(_annotated(spark, sf_dir))
    hole = lambda c, n: F.when(F.col("bar_idx") % n != 0, F.col(c))
    found = detect_pivots(own.withColumns({"high": hole("high", 53), "low": hole("low", 71)}), ZoneConfig())
    return found.select("type", "price", _text("center_time"), _text("confirm_time"), "index")


def outlier_fallback(spark, sf_dir):
    own = dirty(bars_from_events(spark, sf_dir, MINUTES))
    found = quality.validate(own, DataQualityConfig(handle_gaps=False, outlier_std_threshold=3))
    return found.select(_text("timestamp"), "bar_idx", "is_outlier")


def prepared_bars(spark, sf_dir):
    names = ("atr", "rsi", "avg_volume_lookback", "rvol", "stoch_k", "stoch_d")
    return _prepared(spark, sf_dir).select(_text("timestamp"), _day("session_date"), "is_rth", "is_outlier", "has_gap", *_rounded(*names))


def data_span(spark, sf_dir):
    return engine.data_span(_prepared(spark, sf_dir)).select("rows", _text("first_time"), _text("last_time"))


def _zones(own):
    return zones.detect_zones(own, detect_pivots(own, ZoneConfig()), ZoneConfig())


def zone_list(spark, sf_dir):
    return _zones(_annotated(spark, sf_dir)).select("id", "type", *_rounded("level", "width", "p_value"), F.size("touches").alias("n_touches"), _text("activation_time"), _text("expiry_time"), "is_significant")


def _analysis(spark, sf_dir):
    """Prepared bars and zones, each written once, and the zones' episodes."""
    own = cut(_prepared(spark, sf_dir))
    found = cut(_zones(own))
    return own, found, detect_episodes(own, found, EngineConfig().episode)


def _stratified(spark, sf_dir):
    return strata.stratify(_analysis(spark, sf_dir)[2])


def episodes(spark, sf_dir):
    found = _stratified(spark, sf_dir).withColumn("strata", F.array_join("strata", ","))
    measures = [f"{m}_at_{at}" for at in ("touch", "outcome") for m in MEASURES]
    return found.select(
        "zone_id", "zone_type", "outcome", _text("touch_time"), _text("outcome_time"), "bars_to_outcome", *_rounded("max_favorable", "max_adverse", *measures), "from_above", "end_idx",
        "is_rth_at_touch", "minute_of_day_at_touch", "hour_at_touch", "atr_tercile", "rvol_tercile", "stoch_tercile", "stoch_overbought_touch", "stoch_oversold_touch", "strata",
    )


def stratum_rates(spark, sf_dir):
    return strata.outcome_rates(_stratified(spark, sf_dir)).select("stratum", "outcome", "n_episodes", "n_invalid", "n", *_rounded("rate", "ci_low", "ci_high"))


def stratum_metrics(spark, sf_dir):
    return strata.metric_summary(_stratified(spark, sf_dir)).select("stratum", "metric", "n", *_rounded("mean", "median", "p25", "p75"))


def stratum_intervals(spark, sf_dir):
    found = strata.keyed_intervals(_stratified(spark, sf_dir), EngineConfig().episode)
    return found.select("stratum", "metric", *_rounded(*strata.ENDS))


def parameter_sweep(spark, sf_dir):
    found = engine.sweep(_prepared(spark, sf_dir), GRID)
    return found.select("place", "run_id", "params", "n_valid_episodes", "n_invalid_episodes", *_rounded(*engine.RATES.values()))


def nearest_bar(spark, sf_dir):
    """Touches moved by 7 minutes, so that the nearest bar isn't the touch's own."""
    own, _, found = _analysis(spark, sf_dir)
    moved = found.withColumn("touch_time", F.timestamp_micros(F.unix_micros("touch_time") + F.col("zone_id") % 3 * 420_000_000))
    return engine.nearest_bars(moved, own).select("zone_id", _text("touch_time"), _text("bar_time"), "touch_price")


def zone_days(spark, sf_dir):
    own = cut(_annotated(spark, sf_dir))
    return engine.zones_by_session(own, _zones(own), SessionConfig().tz_rth).select(_day("session_date"), "zone_id")


def daily_map(spark, sf_dir):
    own, found, marks = _analysis(spark, sf_dir)
    shown = engine.daily_map(own, found, cut(marks), SessionConfig().tz_rth)
    return shown.select(_day("session_date"), "kind", _text("starts"), _text("ends"), "zone_id", *_rounded("price", "low", "high"), "label")


def outcome_counts(spark, sf_dir):
    return engine.outcome_counts(_analysis(spark, sf_dir)[2]).select("outcome", "n")


def outcome_histograms(spark, sf_dir):
    return engine.histograms(cut(_analysis(spark, sf_dir)[2]))


def flagship(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    """Outcomes of zone touches per zone type."""
    config = override(EngineConfig(), {"zones": {"zone_width_points": 8.0}, "episode": {"R": 12, "O": 3, "T": 6}})
    own = _prepared(spark, sf_dir, minutes)
    found = detect_episodes(own, zones.detect_zones(own, detect_pivots(own, config.zones), config.zones), config.episode)
    return found.groupBy("zone_type", "outcome").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f for f in (
        bars, bar_sessions, quality_report, quality_flags, window_indicators, recursive_indicators, pivots, pivot_clusters, zone_candidates, zone_list, episodes,
        stratum_rates, stratum_metrics, stratum_intervals, parameter_sweep, nearest_bar, zone_days, daily_map, outcome_counts, outcome_histograms, outlier_fallback,
        prepared_bars, data_span, atr_zones, first_of_times, unknown_pivots,
    )
}

_T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_OFFSET = "CASE WHEN {0} >= TIMESTAMP '2024-03-10 07:00:00' AND {0} < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END"
_LOCAL = f"""
local_ AS (SELECT *, row_number() OVER (ORDER BY timestamp) - 1 AS i, timestamp - {_OFFSET.format("timestamp")} AS local_time FROM bars),
s AS (SELECT *, CAST(local_time AS DATE) AS session_date, CAST(hour(local_time) * 60 + minute(local_time) AS INTEGER) AS minute_of_day FROM local_)"""
_DIRTY = """
f AS (SELECT *, CASE WHEN i % 83 = 5 THEN 1.5::DOUBLE WHEN i % 211 = 50 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS x FROM s),
d0 AS (SELECT timestamp, session_date, i AS bar_idx, open * x AS open, close * x AS close, CASE WHEN i % 97 = 13 THEN low * x ELSE high * x END AS high,
  CASE WHEN i % 97 = 13 THEN high * x ELSE low * x END AS low, CASE WHEN i % 89 = 7 THEN 0 ELSE volume END AS volume FROM f),
d1 AS (SELECT * FROM d0 WHERE NOT (high < low OR high < open OR high < close OR low > open OR low > close)),
d2 AS (SELECT * FROM (SELECT *, close / lag(close) OVER (ORDER BY timestamp) - 1 AS r FROM d1) WHERE coalesce(abs(r) * 100 <= 20, true)),
d3 AS (SELECT * EXCLUDE (r), close / lag(close) OVER (ORDER BY timestamp) - 1 AS r FROM d2 WHERE volume >= 1),
m1 AS (SELECT session_date, median(r) AS m FROM d3 GROUP BY 1),
m2 AS (SELECT session_date, median(abs(r - m)) AS mad FROM d3 JOIN m1 USING (session_date) GROUP BY 1),
d4 AS (SELECT timestamp, bar_idx, coalesce(abs(r) > 10 * mad * 1.4826 + 1e-9, false) AS is_outlier,
  coalesce(session_date = lag(session_date) OVER w AND epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) > 7200000000, false) AS has_gap
  FROM d3 LEFT JOIN m2 USING (session_date) WINDOW w AS (ORDER BY timestamp))"""


def _pivots(k: int = 5, at: str = "") -> str:
    return f"""
p0{at} AS (SELECT timestamp, session_date, i, high, low, max(high) OVER a AS hb, min(low) OVER a AS lb, count(*) OVER a AS n, lag(high) OVER w AS h1, lead(high) OVER w AS h2, lag(low) OVER w AS l1, lead(low) OVER w AS l2,
  lead(timestamp, {k}) OVER w AS confirm_time FROM s WINDOW w AS (ORDER BY timestamp), a AS (ORDER BY timestamp ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)),
pv{at} AS (SELECT 'HIGH' AS type, high AS price, timestamp AS center_time, confirm_time, i AS index, session_date FROM p0{at} WHERE n = {2 * k + 1} AND high >= hb - 0.25 AND high > h1 AND high >= h2
  UNION ALL SELECT 'LOW', low, timestamp, confirm_time, i, session_date FROM p0{at} WHERE n = {2 * k + 1} AND low <= lb + 0.25 AND low < l1 AND low <= l2)"""


def _clusters(at: str = "") -> str:
    near = "abs(o.price - c.total / c.cnt) <= 15"
    return f"""
o{at} AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY price, center_time) AS k FROM pv{at}),
c{at} AS (SELECT type, k, price, price AS total, 1 AS cnt, 0 AS grp FROM o{at} WHERE k = 1
  UNION ALL SELECT o.type, o.k, o.price, CASE WHEN {near} THEN c.total + o.price ELSE o.price END, CASE WHEN {near} THEN c.cnt + 1 ELSE 1 END,
    CASE WHEN {near} THEN c.grp ELSE c.grp + 1 END FROM c{at} c JOIN o{at} o ON o.type = c.type AND o.k = c.k + 1),
g{at} AS (SELECT * FROM (SELECT o.*, c.grp, count(*) OVER (PARTITION BY o.type, c.grp) AS members FROM o{at} o JOIN c{at} c USING (type, k)) WHERE members >= 2),
cl{at} AS (SELECT *, dense_rank() OVER (PARTITION BY type ORDER BY grp) - 1 AS cluster FROM g{at})"""


_TAIL = "CASE WHEN {x} = 0 OR {p} >= 1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(range({x}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))) END"


def _zones_sql(at: str = "", width: float = 15.0) -> str:
    """Candidates with p-values; then Benjamini-Hochberg, the merge of close levels and ids."""
    near = "abs(o.level - m.level) <= 2"
    either = lambda a, b: f"CASE WHEN {near} THEN {a} ELSE {b} END"
    return f"""
z{at} AS (SELECT type, cluster, avg(price) AS level, list(price) AS touches, CAST(count(*) AS INTEGER) AS n, min(session_date) AS a, max(session_date) AS b, list_sort(list(confirm_time))[2] AS activation_time FROM cl{at} GROUP BY 1, 2),
r{at} AS (SELECT z.type, z.cluster, max(high) - min(low) AS width_ FROM z{at} z JOIN s ON s.session_date BETWEEN z.a AND z.b GROUP BY 1, 2),
q{at} AS (SELECT *, len(list_filter(touches, lambda t: abs(t - level) <= 22.5)) AS x, least(1.0::DOUBLE, 45 / width_) AS p FROM z{at} JOIN r{at} USING (type, cluster)),
cand{at} AS (SELECT type, cluster, level, {width}::DOUBLE AS width, activation_time, n, {_TAIL.format(n="n", x="x", p="p")} AS p_value FROM q{at}),
bh{at} AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY p_value, cluster) AS place, count(*) OVER (PARTITION BY type) AS m FROM cand{at}),
sig{at} AS (SELECT * FROM (SELECT *, max(CASE WHEN p_value <= 0.05::DOUBLE * place / m THEN place END) OVER (PARTITION BY type) AS last_place FROM bh{at}) WHERE place <= last_place),
ord{at} AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY level, cluster) AS k FROM sig{at}),
mg{at} AS (SELECT type, k, level, n, p_value, activation_time, width, 0 AS grp FROM ord{at} WHERE k = 1
  UNION ALL SELECT o.type, o.k, {either("(m.level * m.n + o.level * o.n) / (m.n + o.n)", "o.level")}, {either("m.n + o.n", "o.n")}, {either("least(m.p_value, o.p_value)", "o.p_value")},
    {either("least(m.activation_time, o.activation_time)", "o.activation_time")}, {either("(m.width + o.width) / 2", "o.width")}, {either("m.grp", "m.grp + 1")}
  FROM mg{at} m JOIN ord{at} o ON o.type = m.type AND o.k = m.k + 1),
zl{at} AS (SELECT CAST(row_number() OVER (ORDER BY CASE type WHEN 'HIGH' THEN 1 ELSE 2 END, level) AS INTEGER) AS id, CASE type WHEN 'HIGH' THEN 'RESISTANCE' ELSE 'SUPPORT' END AS type, level, width, p_value, n AS n_touches,
  activation_time, activation_time + INTERVAL 30 DAY AS expiry_time FROM (SELECT *, row_number() OVER (PARTITION BY type, grp ORDER BY k DESC) AS final FROM mg{at}) WHERE final = 1)"""


#: Bars after validation, with indicators: the table s of what follows. The clean bars are d0 of the validation above.
_CLEAN = "d0 AS (SELECT timestamp, session_date, minute_of_day, i AS bar_idx, open, high, low, close, volume FROM s0)" + _DIRTY[_DIRTY.index(",\nd1 AS"):]
_PREPARED = f"""{_LOCAL.replace("s AS (", "s0 AS (")}, {_CLEAN},
b0 AS (SELECT d3.* EXCLUDE (r, bar_idx), is_outlier, has_gap, row_number() OVER w - 1 AS i, lag(close) OVER w AS prev_close, epoch_us(timestamp) AS micros, min(low) OVER k AS ll, max(high) OVER k AS hh,
    sum(volume) OVER v AS vs, count(volume) OVER v AS vc
  FROM d3 JOIN d4 USING (timestamp) WINDOW w AS (ORDER BY timestamp), k AS (ORDER BY timestamp ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), v AS (ORDER BY timestamp ROWS BETWEEN 11699 PRECEDING AND CURRENT ROW)),
b1 AS (SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr, close - prev_close AS dx, CASE WHEN vc >= 1170 THEN vs::DOUBLE / vc END AS avg_volume_lookback,
  CASE WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) END AS stoch_k, minute_of_day >= 570 AND minute_of_day < 960 AS is_rth FROM b0),
rec AS (SELECT i, tr AS atr, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS d FROM b1 WHERE i = 0
  UNION ALL SELECT b1.i, e.atr * (13.0::DOUBLE / 15) + b1.tr * (2.0::DOUBLE / 15), CASE WHEN e.u IS NULL THEN greatest(b1.dx, 0) ELSE e.u * (13.0::DOUBLE / 15) + greatest(b1.dx, 0) * (2.0::DOUBLE / 15) END,
    CASE WHEN e.d IS NULL THEN greatest(-b1.dx, 0) ELSE e.d * (13.0::DOUBLE / 15) + greatest(-b1.dx, 0) * (2.0::DOUBLE / 15) END FROM rec e JOIN b1 ON b1.i = e.i + 1),
s AS (SELECT b1.*, atr, 100 - 100 / (1 + u / (d + 1e-12::DOUBLE)) AS rsi, volume / (avg_volume_lookback + 1e-12::DOUBLE) AS rvol, avg(stoch_k) OVER (ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS stoch_d FROM b1 JOIN rec USING (i))"""


def _episodes_sql(at: str = "", zones: str = "", r: float = 12, o: float = 6, t: int = 20) -> str:
    """Every touch is followed for t bars by windows; then the chain of touches, each after the first bar outside the band, by recursion over episodes."""
    side = lambda a, b: f"CASE type WHEN 'RESISTANCE' THEN {a} ELSE {b} END"
    return f"""
sp{at} AS (SELECT CASE WHEN median(d) > 0 THEN median(d) ELSE 6e7 END AS spacing FROM (SELECT micros - lag(micros) OVER (ORDER BY i) AS d FROM s)),
lv{at} AS (SELECT z.id AS zone_id, z.type, z.level, z.level - z.width AS lo, z.level + z.width AS hi, s.*, spacing * 5 AS stale FROM zl{zones} z JOIN s ON s.timestamp > z.activation_time AND s.timestamp <= z.expiry_time CROSS JOIN sp{at}),
tch{at} AS (SELECT zone_id, i AS i0 FROM lv{at} WHERE low <= hi AND high >= lo),
trk{at} AS (SELECT l.*, t.i0, l.micros - lag(l.micros) OVER w AS step, max({side("greatest(0, level - low)", "greatest(0, high - level)")}) OVER w AS fav, max({side("greatest(0, high - level)", "greatest(0, level - low)")}) OVER w AS adv,
    bool_or((high > hi AND high <= hi + {o}) OR (low < lo AND low >= lo - {o})) OVER w AS pierced, bool_or({side("low < lo", "high > hi")}) OVER w AS went
  FROM tch{at} t JOIN lv{at} l ON l.zone_id = t.zone_id AND l.i BETWEEN t.i0 AND t.i0 + {t} WINDOW w AS (PARTITION BY t.zone_id, t.i0 ORDER BY l.i)),
ev{at} AS (SELECT *, coalesce(lag(fav) OVER w, 0) AS fav_before, coalesce(lag(adv) OVER w, 0) AS adv_before,
    CASE WHEN i > i0 AND step > stale THEN 'STALE' WHEN is_outlier OR has_gap THEN 'INVALID' WHEN close > hi + {o} OR close < lo - {o} THEN 'BREAK' WHEN pierced AND fav >= {r} THEN 'PIERCE_AND_REVERT'
      WHEN went AND fav >= {r} THEN 'RESPECT' WHEN i - i0 >= {t} THEN 'TIMEOUT' END AS event FROM trk{at} WINDOW w AS (PARTITION BY zone_id, i0 ORDER BY i)),
res{at} AS (SELECT zone_id, i0, min(i) AS i1, arg_min(event, i) AS event, arg_min(CASE event WHEN 'STALE' THEN fav_before ELSE fav END, i) AS fav, arg_min(CASE event WHEN 'STALE' THEN adv_before ELSE adv END, i) AS adv
  FROM ev{at} WHERE event IS NOT NULL GROUP BY 1, 2),
away{at} AS (SELECT r.zone_id, r.i0, min(l.i) AS away FROM res{at} r JOIN lv{at} l ON l.zone_id = r.zone_id AND l.i > r.i1 AND (l.high < l.lo OR l.low > l.hi) GROUP BY 1, 2),
nxt{at} AS (SELECT a.zone_id, a.i0, min(t.i0) AS i0_next FROM away{at} a JOIN tch{at} t ON t.zone_id = a.zone_id AND t.i0 >= a.away GROUP BY 1, 2),
chain{at} AS (SELECT zone_id, min(i0) AS i0 FROM tch{at} GROUP BY 1 UNION ALL SELECT n.zone_id, n.i0_next FROM chain{at} c JOIN nxt{at} n ON n.zone_id = c.zone_id AND n.i0 = c.i0),
ep{at} AS (SELECT c.zone_id, a.type AS zone_type, CASE r.event WHEN 'STALE' THEN 'INVALID' ELSE r.event END AS outcome, a.timestamp AS touch_time, b.timestamp AS outcome_time, CAST(r.i1 - r.i0 AS INTEGER) AS bars_to_outcome,
    r.fav::DOUBLE AS max_favorable, r.adv::DOUBLE AS max_adverse, CASE WHEN a.prev_close > a.hi THEN true WHEN a.prev_close < a.lo THEN false END AS from_above, r.i1 AS end_idx, a.is_rth AS is_rth_at_touch, a.minute_of_day AS minute_of_day_at_touch,
    {", ".join(f"a.{m} AS {m}_at_touch, b.{m} AS {m}_at_outcome" for m in MEASURES)}
  FROM chain{at} c JOIN res{at} r USING (zone_id, i0) JOIN lv{at} a ON a.zone_id = c.zone_id AND a.i = r.i0 JOIN lv{at} b ON b.zone_id = c.zone_id AND b.i = r.i1)"""


def _tercile_sql(column: str) -> str:
    rank = f"(row_number() OVER (ORDER BY {column} NULLS LAST, zone_id, touch_time) - 1)"
    n = f"count({column}) OVER ()"
    return f"CASE WHEN {n} < 2 THEN 'n/a' WHEN {column} IS NULL THEN NULL WHEN 3 * {rank} < {n} - 1 THEN 'low' WHEN 3 * {rank} < 2 * ({n} - 1) THEN 'mid' ELSE 'high' END"


_STRATA = f"""
st0 AS (SELECT *, CAST(minute_of_day_at_touch // 60 AS INTEGER) AS hour_at_touch, {_tercile_sql("atr_at_touch")} AS atr_tercile, {_tercile_sql("rvol_at_touch")} AS rvol_tercile, {_tercile_sql("stoch_k_at_touch")} AS stoch_tercile,
  coalesce(stoch_k_at_touch >= 80, false) AS stoch_overbought_touch, coalesce(stoch_k_at_touch <= 20, false) AS stoch_oversold_touch FROM ep),
st AS (SELECT *, list_filter(['all', CASE WHEN is_rth_at_touch THEN 'rth' ELSE 'eth' END, CASE WHEN stoch_overbought_touch THEN 'stoch_ge80' END, CASE WHEN stoch_oversold_touch THEN 'stoch_le20' END, 'hour_' || hour_at_touch,
  'atr_' || atr_tercile, 'rvol_' || rvol_tercile, 'stoch_' || stoch_tercile], lambda x: x IS NOT NULL) AS strata FROM st0),
by_stratum AS (SELECT *, unnest(strata) AS stratum FROM st)"""
_BASE = f"WITH RECURSIVE {BARS_SQL}, {_PREPARED}, {_pivots()}, {_clusters()}, {_zones_sql()}, {_episodes_sql()}"
_WHOLE = f"{_BASE}, {_STRATA}"
_RATE = f"""
each_ AS (SELECT stratum, outcome_ AS outcome, CAST(count(*) FILTER (e.outcome <> 'INVALID') AS BIGINT) AS n_episodes, count(*) FILTER (e.outcome = 'INVALID') AS n_invalid, count(*) FILTER (e.outcome = outcome_) AS n
  FROM by_stratum e CROSS JOIN (SELECT unnest(['RESPECT', 'PIERCE_AND_REVERT', 'BREAK', 'TIMEOUT']) AS outcome_) GROUP BY 1, 2),
pairs AS (SELECT DISTINCT n AS k, n_episodes AS m FROM each_ WHERE n_episodes > 0),
bis AS (SELECT k, m, 0 AS step, 0.0::DOUBLE AS a0, 1.0::DOUBLE AS a1, 0.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM pairs
  UNION ALL SELECT k, m, step + 1, CASE WHEN ta < 0.025 THEN pa ELSE a0 END, CASE WHEN ta < 0.025 THEN a1 ELSE pa END, CASE WHEN 1 - tb > 0.025 THEN pb ELSE b0 END, CASE WHEN 1 - tb > 0.025 THEN b1 ELSE pb END
  FROM (SELECT *, {_TAIL.format(n="m", x="k", p="pa")} AS ta, CASE WHEN k >= m THEN 0.0::DOUBLE ELSE {_TAIL.format(n="m", x="k + 1", p="pb")} END AS tb FROM (SELECT *, (a0 + a1) / 2 AS pa, (b0 + b1) / 2 AS pb FROM bis WHERE step < 50))),
ci AS (SELECT k, m, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE (a0 + a1) / 2 END AS ci_low, CASE WHEN k = m THEN 1.0::DOUBLE ELSE (b0 + b1) / 2 END AS ci_high FROM bis WHERE step = 50)"""
_SWEEP = ", ".join([
    _pivots(), _clusters(), _zones_sql(), _pivots(3, "2"), _clusters("2"), _zones_sql("2", 8.0), _episodes_sql(), _episodes_sql("1", "", 10, 4), _episodes_sql("2", "2"),
])
_PARAMS = [(i, engine.run_id(x), json.dumps(x, sort_keys=True)) for i, x in enumerate(GRID)]

ORACLE_SQL = {
    "bars": f"WITH {BARS_SQL} SELECT {_T.format('timestamp')}, open, high, low, close, volume FROM bars",
    "bar_sessions": f"WITH {BARS_SQL}, {_LOCAL} SELECT {_T.format('timestamp')}, {_T.format('local_time')}, strftime(session_date, '%Y-%m-%d') AS session_date, minute_of_day, minute_of_day >= 570 AND minute_of_day < 960 AS is_rth FROM s",
    "quality_flags": f"WITH {BARS_SQL}, {_LOCAL}, {_DIRTY} SELECT {_T.format('timestamp')}, bar_idx, is_outlier, has_gap FROM d4",
    "quality_report": f"""WITH {BARS_SQL}, {_LOCAL}, {_DIRTY}, n AS (SELECT (SELECT count(*) FROM d0) AS a, (SELECT count(*) FROM d1) AS b, (SELECT count(*) FROM d2) AS c, (SELECT count(*) FROM d3) AS d)
SELECT a AS original_rows, a - b AS invalid_ohlc, b - c AS price_spike, c - d AS low_volume, (SELECT count(*) FROM d4 WHERE is_outlier) AS outliers, (SELECT count(*) FROM d4 WHERE has_gap) AS gaps_detected,
  d AS final_rows, a - d AS rows_removed, round(100.0::DOUBLE * (a - d) / a, 6) AS removal_pct FROM n""",
    "window_indicators": f"""WITH {BARS_SQL},
t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, sum(volume) OVER v AS vs, count(volume) OVER v AS vc, min(low) OVER k AS ll, max(high) OVER k AS hh
  FROM bars WINDOW w AS (ORDER BY timestamp), v AS (ORDER BY timestamp ROWS BETWEEN 389 PRECEDING AND CURRENT ROW), k AS (ORDER BY timestamp ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, CASE WHEN vc >= 39 THEN vs::DOUBLE / vc END AS avg_volume_lookback, CASE WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) END AS stoch_k FROM t)
SELECT {_T.format('timestamp')}, round(tr, 6) AS tr, round(avg_volume_lookback, 6) AS avg_volume_lookback, round(volume / (avg_volume_lookback + 1e-12), 6) AS rvol, round(stoch_k, 6) AS stoch_k,
  round(avg(stoch_k) OVER (ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS stoch_d FROM u""",
    "recursive_indicators": f"""WITH RECURSIVE {BARS_SQL},
t AS (SELECT timestamp, row_number() OVER w AS k, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, close - lag(close) OVER w AS dx FROM bars WINDOW w AS (ORDER BY timestamp)),
e AS (SELECT k, timestamp, tr AS atr, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS d FROM t WHERE k = 1
  UNION ALL SELECT t.k, t.timestamp, e.atr * (13.0::DOUBLE / 15) + t.tr * (2.0::DOUBLE / 15), CASE WHEN e.u IS NULL THEN greatest(t.dx, 0) ELSE e.u * (13.0::DOUBLE / 15) + greatest(t.dx, 0) * (2.0::DOUBLE / 15) END,
    CASE WHEN e.d IS NULL THEN greatest(-t.dx, 0) ELSE e.d * (13.0::DOUBLE / 15) + greatest(-t.dx, 0) * (2.0::DOUBLE / 15) END FROM e JOIN t ON t.k = e.k + 1)
SELECT {_T.format('timestamp')}, round(atr, 6) AS atr, round(100 - 100 / (1 + u / (d + 1e-12)), 6) AS rsi FROM e""",
    "pivots": f"WITH {BARS_SQL}, {_LOCAL}, {_pivots()} SELECT type, price, {_T.format('center_time')}, {_T.format('confirm_time')}, index FROM pv",
    "pivot_clusters": f"WITH RECURSIVE {BARS_SQL}, {_LOCAL}, {_pivots()}, {_clusters()} SELECT type, cluster, count(*) AS touches, round(avg(price), 6) AS level, min(price) AS least, max(price) AS most FROM cl GROUP BY type, cluster",
    "zone_candidates": f"""WITH RECURSIVE {BARS_SQL}, {_LOCAL}, {_pivots()}, {_clusters()}, {_zones_sql()}
SELECT type, cluster, round(level, 6) AS level, width, {_T.format('activation_time')}, n AS n_touches, round(p_value, 9) AS p_value FROM cand""",
    "zone_list": f"""WITH RECURSIVE {BARS_SQL}, {_LOCAL}, {_pivots()}, {_clusters()}, {_zones_sql()}
SELECT id, type, round(level, 6) AS level, round(width, 6) AS width, round(p_value, 6) AS p_value, n_touches, {_T.format('activation_time')}, {_T.format('expiry_time')}, true AS is_significant FROM zl""",
    "outlier_fallback": f"""WITH {BARS_SQL}, {_LOCAL}, {_DIRTY[:_DIRTY.index(",\nm1 AS")]}
SELECT {_T.format('timestamp')}, bar_idx, coalesce(abs(r) > 3 * (SELECT stddev_samp(r) FROM d3), false) AS is_outlier FROM d3""",
    "prepared_bars": f"""WITH RECURSIVE {BARS_SQL}, {_PREPARED}
SELECT {_T.format('timestamp')}, strftime(session_date, '%Y-%m-%d') AS session_date, is_rth, is_outlier, has_gap, {", ".join(f"round({c}, 6) AS {c}" for c in ("atr", "rsi", "avg_volume_lookback", "rvol", "stoch_k", "stoch_d"))} FROM s""",
    "atr_zones": f"""WITH RECURSIVE {BARS_SQL}, {_PREPARED}, {_pivots()}, {_clusters()},
z AS (SELECT type, cluster, avg(price) AS level, list(price) AS touches, CAST(count(*) AS INTEGER) AS n, min(session_date) AS a, max(session_date) AS b, min(center_time) AS t0, max(center_time) AS t1, list_sort(list(confirm_time))[2] AS activation_time FROM cl GROUP BY 1, 2),
own AS (SELECT z.type, z.cluster, median(atr) AS atr FROM z JOIN s ON s.timestamp BETWEEN z.t0 AND z.t1 GROUP BY 1, 2),
r AS (SELECT z.type, z.cluster, max(high) - min(low) AS width_ FROM z JOIN s ON s.session_date BETWEEN z.a AND z.b GROUP BY 1, 2),
w AS (SELECT *, greatest(1e-9::DOUBLE, 0.5::DOUBLE * coalesce(atr, (SELECT median(atr) FROM s))) AS width FROM z JOIN own USING (type, cluster) JOIN r USING (type, cluster)),
q AS (SELECT *, len(list_filter(touches, lambda t: abs(t - level) <= greatest(width, 22.5))) AS x, least(1.0::DOUBLE, 2 * greatest(width, 22.5) / width_) AS p FROM w)
SELECT * FROM (SELECT type, cluster, round(level, 6) AS level, round(width, 6) AS width, {_T.format('activation_time')}, n AS n_touches, round({_TAIL.format(n="n", x="x", p="p")}, 9) AS p_value FROM q) WHERE p_value < 0.05""",
    "first_of_times": f"""WITH {BARS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY timestamp) - 1 AS i FROM bars),
f AS (SELECT timestamp, 0 AS file_ord, 0 AS more, i FROM n WHERE i <= 2500 UNION ALL SELECT timestamp, 1, 1, i FROM n WHERE i % 101 = 3 OR i > 2000 UNION ALL SELECT timestamp, 1, 3, i FROM n WHERE (i % 101 = 3 OR i > 2000) AND i % 7 = 0),
k AS (SELECT i, arg_min((file_ord, more), (file_ord, more)) AS best FROM f GROUP BY 1)
SELECT {_T.format('timestamp')}, CAST(best[1] AS INTEGER) AS file_ord, open + best[2] AS open, high + best[2] AS high, low + best[2] AS low, close + best[2] AS close FROM k JOIN n USING (i)""",
    "unknown_pivots": f"""WITH {BARS_SQL}, {_LOCAL.replace("s AS (", "s0 AS (")}, s AS (SELECT * REPLACE (CASE WHEN i % 53 <> 0 THEN high END AS high, CASE WHEN i % 71 <> 0 THEN low END AS low) FROM s0),
{_pivots().replace("count(*) OVER a AS n", "count(high) OVER a AS n, count(low) OVER a AS nl").replace("WHERE n = 11 AND low", "WHERE nl = 11 AND low")}
SELECT type, price, {_T.format('center_time')}, {_T.format('confirm_time')}, index FROM pv""",
    "data_span": f"WITH RECURSIVE {BARS_SQL}, {_PREPARED} SELECT count(*) AS rows, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_time FROM s",
    "episodes": f"""{_WHOLE} SELECT zone_id, zone_type, outcome, {_T.format('touch_time')}, {_T.format('outcome_time')}, bars_to_outcome, round(max_favorable, 6) AS max_favorable, round(max_adverse, 6) AS max_adverse,
  {", ".join(f"round({m}_at_{x}, 6) AS {m}_at_{x}" for m in MEASURES for x in ("touch", "outcome"))}, from_above, end_idx, is_rth_at_touch, minute_of_day_at_touch, hour_at_touch, atr_tercile, rvol_tercile, stoch_tercile,
  stoch_overbought_touch, stoch_oversold_touch, array_to_string(strata, ',') AS strata FROM st""",
    "stratum_rates": f"""{_WHOLE}, {_RATE} SELECT stratum, outcome, n_episodes, n_invalid, n, round(n / nullif(n_episodes, 0), 6) AS rate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
FROM each_ LEFT JOIN ci ON k = n AND m = n_episodes""",
    "stratum_metrics": f"""{_WHOLE}, melted AS (SELECT stratum, unnest(['bars_to_outcome', 'max_favorable', 'max_adverse']) AS metric, unnest([bars_to_outcome::DOUBLE, max_favorable, max_adverse]) AS value FROM by_stratum WHERE outcome <> 'INVALID')
SELECT stratum, metric, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75 FROM melted GROUP BY 1, 2 HAVING count(*) >= 2""",
    "stratum_intervals": f"""{_WHOLE}, melted AS (SELECT stratum, zone_id, touch_time, unnest(['bars_to_outcome', 'max_favorable', 'max_adverse']) AS metric, unnest([bars_to_outcome::DOUBLE, max_favorable, max_adverse]) AS value FROM by_stratum WHERE outcome <> 'INVALID'),
placed AS (SELECT stratum, metric, value, row_number() OVER (PARTITION BY stratum, metric ORDER BY zone_id, touch_time) - 1 AS place, count(*) OVER (PARTITION BY stratum, metric) AS n FROM melted),
sizes AS (SELECT DISTINCT stratum, metric, n, CASE WHEN n < 10 THEN 1 ELSE 10 END AS w FROM placed WHERE n > 1),
draws AS (SELECT stratum, metric, n, w, b, piece, ('0x' || substr(md5('42||' || stratum || '|' || metric || '|' || b || '|' || piece), 1, 12))::BIGINT % n AS start
  FROM (SELECT *, unnest(range(CAST(ceil(n / w) AS BIGINT))) AS piece FROM sizes CROSS JOIN range(1000) t(b))),
taken AS (SELECT stratum, metric, b, (start + j) % n AS place FROM (SELECT *, unnest(range(w)) AS j FROM draws) WHERE piece * w + j < n),
found AS (SELECT stratum, metric, b, avg(value) AS m, median(value) AS d FROM taken JOIN placed USING (stratum, metric, place) GROUP BY 1, 2, 3)
SELECT stratum, metric, round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high, round(quantile_cont(d, 0.025), 6) AS median_low, round(quantile_cont(d, 0.975), 6) AS median_high FROM found GROUP BY 1, 2""",
    "parameter_sweep": f"WITH RECURSIVE {BARS_SQL}, {_PREPARED}, {_SWEEP}" + " UNION ALL ".join(f"""
SELECT {i}::INTEGER AS place, '{run}' AS run_id, '{params}' AS params, count(*) FILTER (outcome <> 'INVALID') AS n_valid_episodes, count(*) FILTER (outcome = 'INVALID') AS n_invalid_episodes,
  {", ".join(f"round(count(*) FILTER (outcome = '{x}') / nullif(count(*) FILTER (outcome <> 'INVALID'), 0), 6) AS {c}" for x, c in engine.RATES.items())} FROM ep{i or ''}""" for i, run, params in _PARAMS),
    "nearest_bar": f"""{_BASE}, t AS (SELECT zone_id, touch_time + INTERVAL 7 MINUTE * (zone_id % 3) AS touch_time FROM ep),
n AS (SELECT zone_id, touch_time, arg_min((timestamp, close), (abs(epoch_us(timestamp) - epoch_us(touch_time)), timestamp)) AS bar FROM t CROSS JOIN s GROUP BY 1, 2)
SELECT zone_id, {_T.format('touch_time')}, strftime(bar[1], '%Y-%m-%d %H:%M:%S') AS bar_time, bar[2] AS touch_price FROM n""",
    "zone_days": f"""WITH RECURSIVE {BARS_SQL}, {_LOCAL}, {_pivots()}, {_clusters()}, {_zones_sql()}
SELECT strftime(session_date, '%Y-%m-%d') AS session_date, id AS zone_id FROM (SELECT DISTINCT session_date FROM s) JOIN zl ON session_date BETWEEN CAST(activation_time - {_OFFSET.format('activation_time')} AS DATE) AND CAST(expiry_time - {_OFFSET.format('expiry_time')} AS DATE)""",
    "daily_map": f"""{_BASE}, days AS (SELECT DISTINCT session_date FROM s), m AS (
SELECT session_date, 'close' AS kind, timestamp AS starts, NULL::TIMESTAMP AS ends, NULL::INTEGER AS zone_id, close AS price, NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL AS label FROM s
UNION ALL SELECT session_date, 'zone', NULL, NULL, id, level, level - width, level + width, type FROM days JOIN zl ON session_date BETWEEN CAST(activation_time - {_OFFSET.format('activation_time')} AS DATE) AND CAST(expiry_time - {_OFFSET.format('expiry_time')} AS DATE)
UNION ALL SELECT days.session_date, 'episode', touch_time, outcome_time, zone_id, s.close, NULL, NULL, outcome FROM ep JOIN days ON CAST(touch_time AS DATE) = days.session_date JOIN s ON s.timestamp = touch_time)
SELECT strftime(session_date, '%Y-%m-%d') AS session_date, kind, {_T.format('starts')}, {_T.format('ends')}, zone_id, round(price, 6) AS price, round(low, 6) AS low, round(high, 6) AS high, label FROM m""",
    "outcome_counts": f"{_BASE} SELECT outcome, count(*) AS n FROM ep GROUP BY 1",
    "outcome_histograms": f"""{_BASE}, melted AS (SELECT unnest(['bars_to_outcome', 'max_favorable', 'max_adverse']) AS metric, unnest([bars_to_outcome::DOUBLE, max_favorable, max_adverse]) AS value FROM ep),
tops AS (SELECT metric, quantile_cont(value, 0.99) AS top FROM melted GROUP BY 1)
SELECT metric, CASE WHEN top <= 0 THEN 1 ELSE CAST(least(floor(value * 50 / top) + 1, 50) AS INTEGER) END AS bin, count(*) AS n FROM melted JOIN tops USING (metric) WHERE value <= top GROUP BY 1, 2""",
}
