"""Settings of the engine, their checks, and loading them from YAML or JSON."""

from __future__ import annotations

import dataclasses
import json
import logging
import re
from dataclasses import dataclass, field
from pathlib import Path


LOG = logging.getLogger("tidegauge")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


# Names, grouping and defaults of the settings below are the users' file format.


@dataclass
class SessionConfig:
    tz_rth: str = "America/New_York"
    rth_start: str = "09:30"
    rth_end: str = "16:00"

    def __post_init__(self):
        for value in (self.rth_start, self.rth_end):
            _need(bool(re.fullmatch(r"([01]?\d|2[0-3]):[0-5]\d", value)), f"{value!r} is not HH:MM")

    def minutes(self) -> tuple[int, int]:
        """First minute of the day inside regular hours, and the first after them."""
        return tuple(int(h) * 60 + int(m) for h, m in (x.split(":") for x in (self.rth_start, self.rth_end)))


@dataclass
class IndicatorConfig:
    atr_n: int = 14
    rsi_n: int = 14
    stoch_n: int = 14
    stoch_d: int = 3
    rvol_lookback_sessions: int = 30
    vwap_bands_window: int = 60  # accepted, unused

    def __post_init__(self):
        _need(self.atr_n >= 2, "atr_n must be 2 or more")
        _need(self.stoch_d <= self.stoch_n, "stoch_d must not exceed stoch_n")


@dataclass
class ZoneConfig:
    pivot_k: int = 5
    zone_width_points: float | None = 15.0
    zone_width_alpha_atr: float | None = None
    cluster_width_points: float | None = None
    tick_size: float = 0.25
    null_width_multiplier: float = 1.5
    expire_days: int = 30
    merge_tolerance_points: float = 2.0
    max_cluster_span_days: int | None = None
    min_touches_for_significance: int = 2
    significance_test: bool = True
    fdr: bool = True  # false: each zone is held against alpha by itself

    def __post_init__(self):
        _need(self.pivot_k >= 1, "pivot_k must be 1 or more")
        if self.zone_width_points is None and self.zone_width_alpha_atr is None:
            self.zone_width_points = 15.0
        for width in (self.zone_width_points, self.zone_width_alpha_atr, self.cluster_width_points):
            _need(width is None or width > 0, "widths must be positive")
        if self.cluster_width_points is None:
            self.cluster_width_points = self.zone_width_points


@dataclass
class EpisodeConfig:
    R: float = 12.0
    O: float = 6.0  # noqa: E741
    T: int = 20
    treat_timeout_as_break: bool = False
    max_gap_bars: int = 5

    def __post_init__(self):
        _need(self.R > 0 and self.O > 0, "R and O must be positive")
        _need(self.O < self.R, "O must be less than R")
        _need(self.T >= 1, "T must be 1 or more")
        if self.T > 390:
            LOG.warning("T of %d bars is longer than a session of 390 minutes", self.T)


@dataclass
class DataQualityConfig:
    check_ohlc_integrity: bool = True
    max_price_change_pct: float = 20.0
    min_volume: int = 1
    handle_gaps: bool = True
    max_gap_minutes: float = 120
    remove_outliers: bool = True
    outlier_std_threshold: float = 10.0


@dataclass
class EngineConfig:
    session: SessionConfig = field(default_factory=SessionConfig)
    indicators: IndicatorConfig = field(default_factory=IndicatorConfig)
    zones: ZoneConfig = field(default_factory=ZoneConfig)
    episode: EpisodeConfig = field(default_factory=EpisodeConfig)
    data_quality: DataQualityConfig = field(default_factory=DataQualityConfig)
    cache_dir: str = "cache"  # accepted, unused
    out_dir: str = "results"  # accepted, unused


def override(config, values: dict, strict: bool = False):
    """Sets the named fields, groups within groups. Unknown names are passed over and checks are not run again, unless strict."""
    names = {f.name for f in dataclasses.fields(config)}
    for name, value in (values or {}).items():
        if name not in names:
            _need(not strict, f"unknown setting {name}")
            continue
        own = getattr(config, name)
        if dataclasses.is_dataclass(own) and isinstance(value, dict):
            override(own, value, strict)
        else:
            setattr(config, name, value)
    if strict and hasattr(config, "__post_init__"):
        config.__post_init__()
    return config


def read_tree(path: str):
    """YAML by its extension, else JSON."""
    text = Path(path).read_text()
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def load_config(path: str | None, strict: bool = False) -> EngineConfig:
    """Defaults with the file's values over them; the defaults, with a warning, if there is no such file."""
    config = EngineConfig()
    if path and not Path(path).exists():
        LOG.warning("no config file %s: defaults apply", path)
    elif path:
        override(config, read_tree(path) or {}, strict)
    return config


def load_grid(path: str) -> list[dict]:
    grid = read_tree(path)
    _need(isinstance(grid, list), "a grid file holds a list of settings")
    return grid
