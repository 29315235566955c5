"""Hand-built scenarios and properties of the parts that SQL can't hold."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge import cli
from tidegauge.config import EngineConfig, EpisodeConfig, SessionConfig, ZoneConfig, override
from tidegauge.functions.numbers import bootstrap_interval, exact_interval, tail
from tests.plain import cluster, replay
from tidegauge.operators.episodes import MEASURES, detect_episodes
from tidegauge.operators.indicators import smoothed
from tidegauge.operators.ranks import percentiles, ranked
from tidegauge.operators.strata import ENDS, draw, keyed_intervals, terciles
from tidegauge.operators.zones import cluster_pivots, merge_close, significant
from tidegauge.sources.bars import read_files
from tidegauge.sources.sinks import file_hashes

RULES = EpisodeConfig(R=4, O=1, T=3)


def _bars(rows, **flags):
    """rows: (high, low, close); level 100, width 2, a bar each minute."""
    out = pd.DataFrame(rows, columns=["high", "low", "close"], dtype=float)
    n = len(out)
    out["bar_idx"] = np.arange(n)
    out["micros"] = np.arange(n) * 60_000_000
    out["timestamp"] = pd.to_datetime(out["micros"], unit="us")
    out["prev_close"] = out["close"].shift()
    out = out.assign(symbol="", zone_id=1, zone_type=flags.pop("side", "SUPPORT"), level=100.0, width=2.0, spacing=60e6, is_outlier=False, has_gap=False, is_rth=True, minute_of_day=600, **{m: 1.0 for m in MEASURES})
    for name, at in flags.items():
        if name == "late":
            out.loc[at:, "micros"] += 600_000_000
        else:
            out.loc[at, name] = True
    return out


SCENARIOS = [
    ([(101, 96, 96)], {}, [("BREAK", 0)]),
    ([(105, 98.5, 100)], {}, [("RESPECT", 0)]),
    ([(104.5, 97.5, 102)], {}, [("PIERCE_AND_REVERT", 0)]),
    ([(101, 99, 100), (104.5, 99, 102)], {}, [("RESPECT", 1)]),
    ([(101, 99, 100), (105, 99, 104)], {}, [("BREAK", 1)]),
    ([(101, 99, 100)] * 5, {}, [("TIMEOUT", 3)]),
    ([(101, 99, 100)] * 3, {}, []),
    ([*[(101, 99, 100)] * 3, *[(150, 149, 150)] * 4], {"late": 1}, [("INVALID", 1)]),
    ([(101, 99, 100)] * 3, {"is_outlier": 1}, [("INVALID", 1)]),
    ([(101, 99, 100)] * 3, {"has_gap": 0}, [("INVALID", 0)]),
    ([(101, 96, 96), (101, 99, 96)], {}, [("BREAK", 0)]),
    ([(101, 96, 96), (97, 95, 96), (101, 96, 96)], {}, [("BREAK", 0), ("BREAK", 0)]),
    ([(101, 95.5, 98)], {"side": "RESISTANCE"}, [("RESPECT", 0)]),
    ([(110, 105, 106), *[(101, 99, 100)] * 5], {}, [("TIMEOUT", 3)]),
    ([(97, 90, 95), *[(101, 99, 100)] * 5], {}, [("TIMEOUT", 3)]),
    ([(101, 99, 100), (None, 99, 100), (101, None, 100), (104.5, 99, 102), (None, None, None), (101, 99, 100)], {}, [("RESPECT", 3)]),
    ([(101, 96, 96), (None, 95, 96), (97, None, 96), (101, 96, 96)], {}, [("BREAK", 0), ("BREAK", 0)]),
]


def _detected(spark, zones, config):
    """The episodes that Spark finds, by zone; zones: each one's bars as _bars gives them, each a symbol of its own."""
    bars = pd.concat([z.assign(symbol=f"s{i}") for i, z in enumerate(zones)])
    bars = bars.assign(timestamp=pd.to_datetime(1_700_000_000_000_000 + bars["micros"], unit="us"))
    columns = ["symbol", "timestamp", "high", "low", "close", "is_outlier", "has_gap", "is_rth", "minute_of_day", *MEASURES]
    table = spark.createDataFrame(bars[columns])
    table = table.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("high", "low", "close")})
    made = [(f"s{i}", 1, z["zone_type"].iloc[0], 100.0, 2.0, datetime(2023, 11, 14), datetime(2024, 1, 1)) for i, z in enumerate(zones)]
    found = detect_episodes(table, spark.createDataFrame(made, "symbol string, id int, type string, level double, width double, activation_time timestamp, expiry_time timestamp"), config)
    out = {i: [] for i in range(len(zones))}
    for r in found.orderBy("symbol", "touch_time").collect():
        out[int(r["symbol"][1:])].append((r["outcome"], r["bars_to_outcome"], r["max_favorable"], r["max_adverse"], r["from_above"], r["end_idx"]))
    return out


def _plain(bars, config):
    got = replay(bars.assign(spacing=float(np.median(np.diff(bars["micros"]))) if len(bars) > 1 else 60e6), config)
    return [(*x[:2], float(x[2]), float(x[3]), *x[4:]) for x in got[["outcome", "bars_to_outcome", "max_favorable", "max_adverse", "from_above", "end_idx"]].itertuples(index=False, name=None)]


@pytest.mark.parametrize("config", [RULES, EpisodeConfig(R=4, O=1, T=3, treat_timeout_as_break=True)])
def test_scenarios(spark, config):
    zones = [_bars(rows, **dict(flags)) for rows, flags, _ in SCENARIOS]
    got = _detected(spark, zones, config)
    for i, (_, _, want) in enumerate(SCENARIOS):
        assert got[i] == _plain(zones[i], config), i
        if config is RULES:
            assert [x[:2] for x in got[i]] == want, i
        else:
            assert [x[:2] for x in got[i]] == [("BREAK" if o == "TIMEOUT" else o, n) for o, n in want], i
    sides = {i: got[i][0][4] for i in (13, 14)}
    assert sides == {13: True, 14: False}


def test_random_bars_equal_a_plain_replay(spark):
    """Walks around the band with unknown prices, flags and holes in time: touches, outcomes and the order of episodes."""
    rng, zones = np.random.default_rng(8), []
    for i in range(40):
        middle = 100 + np.cumsum(rng.normal(0, 1.2, 300)) * 0.7
        rows = np.stack([middle + rng.random(300) * 2, middle - rng.random(300) * 2, middle + rng.normal(0, 0.5, 300)], axis=1)
        rows[rng.random((300, 3)) < 0.02] = np.nan
        own = _bars([tuple(r) for r in rows], side="RESISTANCE" if i % 2 else "SUPPORT")
        own["is_outlier"], own["has_gap"] = rng.random(300) < 0.01, rng.random(300) < 0.01
        own["micros"] += np.cumsum(rng.random(300) < 0.02) * 600_000_000
        zones.append(own)
    for config in (RULES, EpisodeConfig(R=3, O=2, T=8, max_gap_bars=0)):
        got = _detected(spark, zones, config)
        assert sum(map(len, got.values())) > 100
        for i, own in enumerate(zones):
            assert [tuple(map(repr, x)) for x in got[i]] == [tuple(map(repr, (*x[:4], None if x[4] is None else bool(x[4]), int(x[5])))) for x in _plain(own, config)], i


def test_numbers():
    assert tail(10, 0, 0.3) == 1.0 and tail(3, 3, 0.5) == pytest.approx(0.125) and 0 < tail(100_000, 50_500, 0.5) < 0.01
    assert exact_interval(0, 10) == (0.0, pytest.approx(1 - 0.025**0.1)) and exact_interval(10, 10)[1] == 1.0
    low, high = exact_interval(3, 17)
    assert tail(17, 3, low) == pytest.approx(0.025) and 1 - tail(17, 4, high) == pytest.approx(0.025)


def test_tails_equal_exact_sums_and_large_sizes_are_quick():
    import time
    from fractions import Fraction
    from math import comb, erf, sqrt

    from tidegauge.functions.numbers import exact_intervals, tails

    for n in (1, 2, 7, 30, 200):
        for p in (Fraction(1, 1000), Fraction(1, 7), Fraction(1, 2), Fraction(97, 100)):
            terms = [comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
            want = [float(sum(terms[x:])) for x in range(n + 2)]
            got = tails(n, np.arange(n + 2), float(p))
            assert np.allclose(got, want, rtol=1e-11, atol=1e-300) and got[0] == 1.0 and got[-1] == 0.0
    began = time.time()
    big = 10_000_000
    # Normal with continuity correction: near enough at this size to see that nothing is lost.
    assert tails(big, 5_002_000, 0.5) == pytest.approx((1 - erf((2000 - 0.5) / sqrt(big / 4) / sqrt(2))) / 2, rel=1e-4)
    assert time.time() - began < 1
    k, n = np.array([0, 1, 3, 17, 500_000, 0, 5]), np.array([10, 10, 17, 17, 1_000_000, 0, 5])
    low, high = exact_intervals(k, n)
    for a, b, x, y in zip(k[1:5], n[1:5], low[1:5], high[1:5], strict=True):
        assert tail(b, a, x) == pytest.approx(0.025, rel=1e-9) and (a == b or 1 - tail(b, a + 1, y) == pytest.approx(0.025, rel=1e-9))
    assert low[0] == 0 and high[3] == 1 and np.isnan(low[5]) and low[6] == pytest.approx(0.025**0.2)


@pytest.mark.parametrize("n", [5, 40])
def test_bootstrap_equals_a_plain_loop(n):
    data, block, rng = np.random.default_rng(0).normal(size=n), 10, np.random.default_rng(42)
    values = []
    for _ in range(200):
        if n < block:
            values.append(data[rng.integers(0, n, size=n)].mean())
        else:
            starts = rng.integers(0, n, size=-(-n // block))
            places = np.concatenate([np.arange(s, s + block) for s in starts])[:n]
            values.append(data[places % n].mean())
    assert bootstrap_interval(data, np.mean, 200, block) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])))


def test_terciles(spark):
    for n, want in ((1, ["n/a"]), (2, ["low", "high"]), (4, ["low", "mid", "high", "high"]), (7, ["low", "low", "mid", "mid", "high", "high", "high"])):
        table = spark.createDataFrame([("", float(i), 1, i) for i in range(n)], "symbol string, x double, zone_id int, touch_time int")
        assert [r["t"] for r in terciles(table, {"t": "x"}).orderBy("x").collect()] == want
    table = spark.createDataFrame([("a", None, 1, 0), ("a", 1.0, 1, 1), ("a", 1.0, 1, 2), ("b", None, 1, 0)], "symbol string, x double, zone_id int, touch_time int")
    assert [r["t"] for r in terciles(table, {"t": "x"}).orderBy("symbol", "touch_time").collect()] == [None, "low", "high", "n/a"]


def test_ranks_and_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, 5, 4000).astype(float), "b": rng.normal(size=1501), "c": np.array([7.0]), "d": np.array([1.0, 2.0])}
    rows = [(g, float(x), i) for g, values in groups.items() for i, x in enumerate(values)] + [("a", None, -1), ("e", None, -1)]
    table = spark.createDataFrame(rows, "g string, x double, i int")
    for r in percentiles(table, ["g"], "x", [0.25, 0.5, 0.99]).collect():
        own = groups.pop(r["g"])
        assert r["n"] == len(own) and r["mean"] == pytest.approx(own.mean()) and r["q"] == pytest.approx(list(np.percentile(own, [25, 50, 99])))
    assert not groups
    for g in "abd":
        got = [r["at"] for r in ranked(table.filter("x is not null"), ["g"], ["x", "i"], "at").filter(F.col("g") == g).orderBy("x", "i").collect()]
        assert got == list(range(len(got)))


@pytest.mark.parametrize("most", [1000, 0])
def test_keyed_bootstrap_equals_a_plain_loop(spark, most):
    rng, rows, start = np.random.default_rng(2), [], datetime(2024, 1, 1)
    for i in range(40):
        rows.append(("s", i % 3, start + timedelta(minutes=i), ["all", "few"] if i < 6 else ["all"], "BREAK", int(rng.integers(0, 20)), float(rng.normal()), None))
    table = spark.createDataFrame(rows, "symbol string, zone_id int, touch_time timestamp, strata array<string>, outcome string, bars_to_outcome int, max_favorable double, max_adverse double")
    got = {(r["stratum"], r["metric"]): [r[c] for c in ENDS] for r in keyed_intervals(table, EpisodeConfig(), 60, most).collect()}
    assert set(got) == {(s, m) for s in ("all", "few") for m in ("bars_to_outcome", "max_favorable")}
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    for (stratum, metric), ends in got.items():
        data = np.array([r[5 if metric == "bars_to_outcome" else 6] for r in ordered if stratum in r[3]], float)
        n, width = len(data), 10 if len(data) >= 10 else 1
        means, medians = [], []
        for b in range(60):
            places = [(draw(f"s|{stratum}|{metric}", b, piece, n) + j) % n for piece in range(-(-n // width)) for j in range(width)][:n]
            means.append(data[places].mean())
            medians.append(np.median(data[places]))
        assert ends == pytest.approx([*np.percentile(means, [2.5, 97.5]), *np.percentile(medians, [2.5, 97.5])])


def test_significance_and_merge(spark):
    rows = [("", "HIGH", i, 100.0 + 1.5 * i, 15.0, [1.0] * (i + 2), p) for i, p in enumerate([0.001, 0.04, 0.02, 0.9])]
    table = spark.createDataFrame(rows, "symbol string, type string, cluster long, level double, width double, touches array<double>, p_value double").withColumn("activation_time", F.timestamp_seconds(F.col("cluster")))
    assert {r["cluster"] for r in significant(table, ZoneConfig()).collect()} == {0, 2}
    merged = merge_close(table, 2.0).orderBy("level").collect()
    assert sum(len(r["touches"]) for r in merged) == 14 and all(b["level"] - a["level"] > 0 for a, b in zip(merged, merged[1:], strict=False))


@pytest.mark.parametrize("span", [None, 0, 3])
def test_clusters_of_price_levels_equal_the_fold_of_pivots(spark, span):
    """Dense prices on a grid, many of each; steps of just the width and just above it; times before and after a cluster's first."""
    rng, start = np.random.default_rng(4), datetime(2024, 1, 1)
    prices = np.concatenate([100 + 0.25 * rng.integers(0, 200, 2500), [300, 315, 322.5, 340, 355.25], np.full(400, 500.0)])
    times = [start + timedelta(minutes=int(m)) for m in rng.choice(30_000, len(prices), replace=False)]
    pivots = pd.DataFrame({"symbol": "", "type": "HIGH", "price": prices, "center_time": times}).sort_values(["price", "center_time"], kind="stable")
    want = pd.Series(cluster(pivots, 15.0, span))
    sizes = want.map(want.value_counts())
    names = {c: i for i, c in enumerate(sorted(set(want[sizes >= 2])))}
    config = override(ZoneConfig(), {"max_cluster_span_days": span})
    got = cluster_pivots(spark.createDataFrame(pivots), config).select("price", "center_time", "cluster").collect()
    assert len(names) > 3
    assert sorted(map(tuple, got)) == sorted((p, t.to_pydatetime(), names[c]) for p, t, c, n in zip(pivots["price"], pivots["center_time"], want, sizes, strict=True) if n >= 2)


def test_zones_of_several_settings_equal_each_alone_in_one_plan(spark, small):
    from tidegauge.operators.pivots import detect_pivots, detect_pivots_each
    from tidegauge.operators.zones import detect_zones
    from tidegauge.queries import _prepared
    from tidegauge.session import cut

    bars = cut(_prepared(spark, small, 60))
    settings = [{}, {"pivot_k": 2, "zone_width_points": 4.0, "cluster_width_points": 4.0}, {"zone_width_alpha_atr": 0.7, "fdr": False}, {"max_cluster_span_days": 3, "merge_tolerance_points": 0.0}, {"pivot_k": 2, "tick_size": 0.0, "significance_test": False, "expire_days": 3}]
    configs = [override(ZoneConfig(), x) for x in settings]
    names = ["symbol", "id", "type", "level", "width", "activation_time", "expiry_time", "touches", "p_value"]
    rows = lambda df: sorted(map(tuple, df.select(*names).collect()))
    together = cut(detect_zones(bars, detect_pivots_each(bars, configs), configs))
    found = 0
    for kind, config in enumerate(configs):
        alone = rows(detect_zones(bars, detect_pivots(bars, config), config))
        assert rows(together.filter(F.col("kind") == kind)) == alone, settings[kind]
        found += len(alone)
    assert found > 10
    nodes = lambda own: sum("+-" in line or ":-" in line for line in detect_pivots_each(bars, own)._jdf.queryExecution().analyzed().toString().splitlines())
    assert nodes(configs[:2]) == nodes([override(ZoneConfig(), {"pivot_k": 2 + i % 4, "tick_size": i / 8}) for i in range(60)])


def test_config():
    with pytest.raises(ValueError):
        SessionConfig(rth_start="25:00")
    with pytest.raises(ValueError):
        EpisodeConfig(R=1, O=2)
    config = override(EngineConfig(), {"zones": {"zone_width_points": 8.0}, "nonsense": 1})
    assert config.zones.cluster_width_points == 15.0 and config.zones.zone_width_points == 8.0


def test_episodes_of_a_zone_never_overlap(spark, medium):
    from tidegauge.queries import _analysis, stratum_rates

    found = _analysis(spark, medium)[2].orderBy("zone_id", "touch_time").collect()
    assert found and all(r["bars_to_outcome"] <= 20 for r in found)
    for a, b in zip(found, found[1:], strict=False):
        assert a["zone_id"] != b["zone_id"] or a["outcome_time"] < b["touch_time"]
    rates = stratum_rates(spark, medium).filter("stratum = 'all'").collect()
    assert sum(r["rate"] for r in rates) == pytest.approx(1) and sum(r["n"] for r in rates) == rates[0]["n_episodes"]


@pytest.mark.parametrize("holes", [[], [0, 1], [5, 6, 7, 20], list(range(10, 35)), list(range(60))])
def test_recursive_means_by_day_equal_one_pass(spark, holes):
    values = np.random.default_rng(3).normal(size=60)
    values[holes] = np.nan
    rows = [("a", datetime(2024, 1, 1) + timedelta(hours=5 * i), None if np.isnan(x) else float(x)) for i, x in enumerate(values)]
    found = smoothed(spark.createDataFrame(rows, "symbol string, timestamp timestamp, x double"), {"y": ("x", 14)}).orderBy("timestamp").collect()
    want = pd.Series(values).ewm(span=14, adjust=False).mean()
    assert np.allclose([np.nan if r["y"] is None else r["y"] for r in found], want, rtol=1e-12, equal_nan=True)


def test_volumes_of_any_form(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("Timestamp,Open,High,Low,Close,Volume,Symbol\n" + "".join(f"2024-01-02 10:0{i}:00,1,2,1,2,{v},{s}\n" for i, (v, s) in enumerate([("100.0", "A"), ("", "A"), ("12.5", "B"), ("7", "B")])))
    rows = read_files(spark, [f"{tmp_path}/raw.csv"]).orderBy("timestamp").collect()
    assert [r["volume"] for r in rows] == [100.0, None, 12.5, 7.0] and [r["symbol"] for r in rows] == ["A", "A", "B", "B"]


def test_files_are_hashed_as_streams(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_bytes(b"x" * 100_000)
    (tmp_path / "y.csv").write_bytes(b"")
    got = file_hashes(spark, [f"{tmp_path}/a", f"{tmp_path}/y.csv"])
    assert sorted(got.values()) == sorted(hashlib.sha256(x).hexdigest() for x in (b"x" * 100_000, b""))


def test_two_symbols_keep_their_own(spark, small, tmp_path):
    from tidegauge.config import EngineConfig as Config
    from tidegauge.plans import engine
    from tidegauge.sources.bars import bars_from_events
    from tidegauge.sources.sinks import statistics_tree, zone_rows

    one = bars_from_events(spark, small, 15)
    both = one.withColumn("symbol", F.lit("A")).unionByName(one.withColumn("symbol", F.lit("B"))).withColumn("file_ord", F.lit(0))
    found = engine.analyze(engine.prepare_frame(both, Config()), Config())
    zones = [tuple(r) for r in zone_rows(found.zones).collect()]
    assert zones and sorted(z[:-1] for z in zones if z[-1] == "A") == sorted(z[:-1] for z in zones if z[-1] == "B")
    assert min(z[0] for z in zones) == 1
    tree = statistics_tree(found.rates, found.metrics, found.intervals)
    assert set(tree) == {"A", "B"} and tree["A"] == tree["B"]


def test_a_missing_config_file_warns(caplog):
    from tidegauge.config import load_config

    assert load_config("/nowhere/x.json") == EngineConfig() and "no config file" in caplog.text


def test_spellings_of_unknown_cells(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("timestamp,open,high,low,close,volume,is_rth\n" + "".join(f"2024-01-02 10:0{i}:00,{c},2,1,2,{v},{b}\n" for i, (c, v, b) in enumerate([("NA", "", "True"), ("null", "n/a", "False"), ("1.5", "#N/A", ""), ("oops", "NaN", "maybe"), (" 2 ", "7", "true")])))
    rows = read_files(spark, [f"{tmp_path}/raw.csv"]).orderBy("timestamp").collect()
    assert [r["open"] for r in rows] == [None, None, 1.5, None, 2.0] and [r["volume"] for r in rows] == [None] * 4 + [7.0]
    assert [r["is_rth"] for r in rows] == [True, False, None, None, True] and [r["bad_cells"] for r in rows] == [0, 0, 0, 2, 0]


def test_bars_without_a_time_and_bad_cells_are_reported(spark, tmp_path):
    from tidegauge.plans import engine

    (tmp_path / "raw.csv").write_text("timestamp,open,high,low,close,volume\n" + "".join(f"{t},10,11,9,{c},5\n" for t, c in [("2024-01-02 10:00:00", "10"), ("soon", "10"), ("2024-01-02 10:01:00", "x"), ("2024-01-02 10:02:00", "10")]))
    prepared, report = engine.prepare_and_report(spark, [f"{tmp_path}/raw.csv"], EngineConfig())
    assert prepared.count() == 3 and report.first()["bad_cells"] == 1 and "bad_cells" not in prepared.columns


def test_the_code_hash_covers_the_package(tmp_path):
    from tidegauge.sources import sinks

    assert len(sinks.code_hash()) == 64 and sinks.code_hash() == sinks.code_hash()


def test_command_line(spark, small, tmp_path):
    from tidegauge.sources.bars import bars_from_events

    bars_from_events(spark, small, 60).drop("symbol").coalesce(1).write.option("header", True).csv(f"{tmp_path}/raw")
    assert cli.main(["prepare", "--files", f"{tmp_path}/raw", "--out", f"{tmp_path}/p.parquet"]) == 0
    assert cli.main(["prepare", "--files", f"{tmp_path}/raw", "--out", f"{tmp_path}/p.csv"]) == 0
    assert cli.main(["analyze", "--data", f"{tmp_path}/p.parquet", "--out", f"{tmp_path}/r"]) == 0
    assert cli.main(["analyze", "--data", f"{tmp_path}/p.csv", "--out", f"{tmp_path}/r2"]) == 0
    assert (tmp_path / "r" / "statistics.json").read_text() == (tmp_path / "r2" / "statistics.json").read_text()
    tree = json.loads((tmp_path / "r" / "statistics.json").read_text())
    assert "all" in tree and spark.read.option("header", True).csv(f"{tmp_path}/r/daily_map.csv").count() > 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/zones.csv").columns[0] == "id"
    (tmp_path / "g.json").write_text(json.dumps([{}, {"episode": {"R": 10, "O": 4}}]))
    assert cli.main(["sweep", "--data", f"{tmp_path}/p.csv", "--grid", f"{tmp_path}/g.json", "--out", f"{tmp_path}/s"]) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/s/sweep_summary.csv").count() == 2
