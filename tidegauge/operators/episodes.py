"""Episodes: each zone's touches, followed from a touch to its outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import EpisodeConfig
from tidegauge.operators.halo import bounded, numbered
from tidegauge.operators.ranks import percentiles
from tidegauge.session import cut

MEASURES = ("rsi", "atr", "rvol", "stoch_k", "stoch_d")
RULES = ("R", "O", "T", "max_gap_bars", "treat_timeout_as_break")
#: A bar falls into two price buckets or so, a band into ten at most: a bucket is this many mean bar ranges of its day high at
#: least, and this share of the widest band of that day.
RANGES_A_BUCKET, BUCKETS_A_BAND = 4, 8


def spacing(live: DataFrame) -> DataFrame:
    """symbol and the median microseconds between its bars; a minute if there is none above zero."""
    middle = percentiles(live, ["symbol"], "step", [0.5]).select("symbol", F.get("q", F.lit(0)).alias("m"))
    return live.select("symbol").distinct().join(middle, "symbol", "left").select("symbol", F.when(F.col("m") > 0, F.col("m")).otherwise(60e6).alias("spacing"))


def _live(bars: DataFrame) -> DataFrame:
    """Bars with their places, the close before each and the step of time since it; written once, as several joins read them."""
    flags = {c: F.coalesce(F.col(c), F.lit(False)) if c in bars.columns else F.lit(False) for c in ("is_outlier", "has_gap")}
    own = bars.select("symbol", "timestamp", "high", "low", "close", *(c.alias(n) for n, c in flags.items()), "is_rth", "minute_of_day", *MEASURES)
    own = own.withColumns({"micros": F.unix_micros("timestamp"), "day_": F.to_date("timestamp")})
    before = lambda order: {"prev_close": F.lag("close").over(order), "step": F.col("micros") - F.lag("micros").over(order)}
    return cut(bounded(numbered(own, "bar_idx"), 1, 0, before, place="bar_idx"))


def touches(live: DataFrame, zones: DataFrame, key: list[str]) -> DataFrame:
    """key, bar_idx, touching: the live bars that meet each zone's band, and those whose unknown prices leave it open (touching false).

    Zones and bars meet by symbol, day and price bucket, so a zone sees only bars near its band. The pair is kept in the first
    bucket that both have. Buckets follow each day's bar ranges and bands, so that neither side multiplies, whatever its scale.
    """
    days = F.sequence(F.to_date("activation_time"), F.to_date("expiry_time"))
    spans = zones.select(*key, "low_", "high_", "activation_time", "expiry_time", F.explode(days).alias("day_"))
    bands = spans.groupBy("symbol", "day_").agg(F.max(F.col("high_") - F.col("low_")).alias("band"))
    ranges = live.groupBy("symbol", "day_").agg(F.avg(F.abs(F.col("high") - F.col("low"))).alias("range"))
    size = F.greatest(RANGES_A_BUCKET * F.col("range"), F.col("band") / BUCKETS_A_BAND)
    grid = bands.join(ranges, ["symbol", "day_"]).select("symbol", "day_", F.when(size > 0, size).otherwise(1.0).alias("size"))
    slim = live.select("symbol", "day_", "timestamp", "bar_idx", "low", "high")
    bucket = lambda c: F.floor(F.col(c) / F.col("size"))
    there = F.expr("timestamp > activation_time and timestamp <= expiry_time")
    near = slim.join(grid, ["symbol", "day_"]).withColumn("first_", bucket("low")).withColumn("bucket", F.explode(F.sequence("first_", bucket("high"))))
    held = spans.join(grid, ["symbol", "day_"]).withColumn("least_", bucket("low_")).withColumn("bucket", F.explode(F.sequence("least_", bucket("high_"))))
    met = near.drop("size").join(held.drop("size"), ["symbol", "day_", "bucket"]).filter(there & (F.col("bucket") == F.greatest("first_", "least_")) & (F.col("low") <= F.col("high_")) & (F.col("high") >= F.col("low_")))
    unknown = slim.filter("low is null or high is null").join(spans, ["symbol", "day_"]).filter(there & ~F.coalesce((F.col("high") < F.col("low_")) | (F.col("low") > F.col("high_")), F.lit(False)))
    return met.select(*key, "bar_idx", F.lit(True).alias("touching")).unionByName(unknown.select(*key, "bar_idx", F.lit(False).alias("touching")))


def entries(touched: DataFrame, key: list[str]) -> DataFrame:
    """key, start, outside: the first touch of each run of bars without one outside the band, and the place of the bar outside before the run."""
    run = F.col("bar_idx") - F.row_number().over(Window.partitionBy(*key).orderBy("bar_idx"))
    runs = touched.withColumn("run_", run).groupBy(*key, "run_").agg(F.min("bar_idx").alias("first"), F.min(F.when(F.col("touching"), F.col("bar_idx"))).alias("start"))
    return runs.filter("start is not null").select(*key, "start", (F.col("first") - 1).alias("outside"))


def outcomes(started: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """started with event (null where the bars end first), end, favorable, adverse: each touch is followed over its next T bars.

    Rules of a bar in their order: a stale gap before it; excursions from the level; flagged bars; a pierced strip beyond the
    band; a close beyond that strip; pierced and reached; left on the favorable side and reached; too many bars.
    """
    bars = live.select("symbol", "bar_idx", "timestamp", "micros", "high", "low", "close", "is_outlier", "has_gap")
    rows = started.withColumn("bar_idx", F.explode(F.sequence("start", F.col("start") + F.col("T")))).join(bars, ["symbol", "bar_idx"]).filter("timestamp <= expiry_time")
    order = Window.partitionBy(*key, "start").orderBy("bar_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    yes = lambda x: F.coalesce(x, F.lit(False))
    up, down = F.greatest(F.lit(0.0), F.col("high") - F.col("level")), F.greatest(F.lit(0.0), F.col("level") - F.col("low"))
    resistance, high, low, o = F.col("zone_type") == "RESISTANCE", F.col("high_"), F.col("low_"), F.col("O")
    pierced = yes((F.col("high") > high) & (F.col("high") <= high + o)) | yes((F.col("low") < low) & (F.col("low") >= low - o))
    left = F.when(resistance, yes(F.col("low") < low)).otherwise(yes(F.col("high") > high))
    rows = rows.withColumns({
        "step": F.col("micros") - F.lag("micros").over(order), "favorable": F.max(F.when(resistance, down).otherwise(up)).over(so_far), "adverse": F.max(F.when(resistance, up).otherwise(down)).over(so_far),
        "pierced": F.bool_or(pierced).over(so_far), "left": F.bool_or(left).over(so_far),
    })
    rows = rows.withColumns({f"{c}_before": F.coalesce(F.lag(c).over(order), F.lit(0.0)) for c in ("favorable", "adverse")})
    stale = (F.col("max_gap_bars") > 0) & yes(F.col("step") > F.col("spacing") * F.col("max_gap_bars"))
    reached = F.col("favorable") >= F.col("R")
    event = (
        F.when(stale, "STALE").when(F.col("is_outlier") | F.col("has_gap"), "INVALID").when(yes((F.col("close") > high + o) | (F.col("close") < low - o)), "BREAK")
        .when(F.col("pierced") & reached, "PIERCE_AND_REVERT").when(F.col("left") & reached, "RESPECT")
        .when(F.col("bar_idx") - F.col("start") >= F.col("T"), F.when(F.col("treat_timeout_as_break"), "BREAK").otherwise("TIMEOUT"))
    )
    rows = rows.withColumn("event", event).withColumn("is_stale", F.col("event") == "STALE")
    told = F.struct(
        F.when(F.col("is_stale"), "INVALID").otherwise(F.col("event")).alias("event"), F.col("bar_idx").alias("end"),
        *(F.when(F.col("is_stale"), F.col(f"{c}_before")).otherwise(F.col(c)).alias(c) for c in ("favorable", "adverse")),
    )
    found = rows.groupBy(*key, "start", "outside", "zone_type", "low_", "high_").agg(F.min_by(told, F.when(F.col("event").isNotNull(), F.col("bar_idx"))).alias("told"))
    return found.select(*key, "start", "outside", "zone_type", "low_", "high_", "told.event", "told.end", "told.favorable", "told.adverse")


def chained(found: DataFrame, key: list[str]) -> DataFrame:
    """The touches that count: the first; then after each outcome the first whose run of bars began after a bar outside that came after it; none after a touch without an outcome."""
    each = F.struct("start", "outside", "event", "end", "favorable", "adverse", "low_", "high_", "zone_type")
    zones = found.groupBy(*key).agg(F.sort_array(F.collect_list(each)).alias("all"))
    free = F.struct(F.lit(-2).cast("long").alias("end"), F.array().cast("array<boolean>").alias("kept"))

    def step(state, x):
        counts = (state["end"] == -2) | (x["outside"] > state["end"])
        end = F.when(~counts, state["end"]).otherwise(F.coalesce(x["end"], F.lit(2**62)))
        return F.struct(end.cast("long").alias("end"), F.concat(state["kept"], F.array(counts & x["event"].isNotNull())).alias("kept"))

    kept = F.aggregate("all", free, step, lambda s: s["kept"])
    pairs = F.filter(F.arrays_zip(F.col("all").alias("x"), kept.alias("keep")), lambda p: p["keep"])
    return zones.select(*key, F.explode(pairs).alias("p")).select(*key, "p.x.*")


def detect_episodes(bars: DataFrame, zones: DataFrame, config: EpisodeConfig | list[EpisodeConfig], run: str | None = None) -> DataFrame:
    """The episodes of all zones. run: an int column of zones that tells the runs of a sweep apart and comes first; config is then
    a list with the rules of each run.

    A zone meets the bars that touch its band (touches), of each run of such bars only the first counts (entries), and is
    followed over the next T bars (outcomes); a fold over a zone's touches leaves those that don't overlap (chained). The
    measures at touch and outcome are met last, by place. Nothing leaves the JVM.
    """
    key, live = [*([run] if run else []), "symbol", "zone_id"], _live(bars)
    rules = [F.struct(*(F.lit(getattr(c, r)).cast("double" if r in "RO" else "boolean" if r[0] == "t" else "long").alias(r) for r in RULES)) for c in (config if run else [config])]
    own = F.element_at(F.array(*rules), F.col(run) + 1) if run else rules[0]
    held = zones.withColumnRenamed("id", "zone_id").withColumnRenamed("type", "zone_type").withColumns({"low_": F.col("level") - F.col("width"), "high_": F.col("level") + F.col("width"), "rules_": own})
    held = held.join(spacing(live), "symbol").select(*key, "zone_type", "level", "low_", "high_", "activation_time", "expiry_time", "spacing", "rules_.*")
    found = outcomes(entries(touches(live, held, key), key).join(held, key), live, key)
    found = cut(chained(found, key))
    at = lambda suffix, names: live.select("symbol", *(F.col(a).alias(b) for a, b in names.items()), *(F.col(m).alias(f"{m}_at_{suffix}") for m in MEASURES))
    touch = at("touch", {"bar_idx": "start", "timestamp": "touch_time", "prev_close": "prev_close", "is_rth": "is_rth_at_touch", "minute_of_day": "minute_of_day_at_touch"})
    out = found.join(touch, ["symbol", "start"]).join(at("outcome", {"bar_idx": "end", "timestamp": "outcome_time"}), ["symbol", "end"])
    side = F.when(F.col("prev_close") > F.col("high_"), True).when(F.col("prev_close") < F.col("low_"), False)
    return out.select(
        *key, "zone_type", F.col("event").alias("outcome"), "touch_time", "outcome_time", (F.col("end") - F.col("start")).cast("int").alias("bars_to_outcome"), F.col("favorable").alias("max_favorable"),
        F.col("adverse").alias("max_adverse"), side.alias("from_above"), F.col("end").alias("end_idx"), *(f"{m}_at_touch" for m in MEASURES), "is_rth_at_touch", "minute_of_day_at_touch", *(f"{m}_at_outcome" for m in MEASURES),
    )
