"""Numbers that Spark has no function for: binomial tails, exact rate intervals, bootstraps."""

from __future__ import annotations

from math import ceil, lgamma, log, pi

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType


_EPS = 1e-15
_small_lgamma = np.frompyfunc(lgamma, 1, 1)


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves of log(n!): from its series, or outright where n is small."""
    large = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * large**2)) / large**2) / large**2) / large
    small = np.clip(n, 1e-300, 16.0)
    outright = np.asarray(_small_lgamma(small + 1), float) - (small + 0.5) * np.log(small) + small - 0.5 * log(2 * pi)
    return np.where(n >= 16, series, outright)


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x log(x / m) + m - x, without loss where x is near m."""
    apart = x - m
    v = apart / (x + m)
    near, term, power = apart * v, 2 * x * v, v * v
    for j in range(1, 30):
        term = term * power
        near = near + term / (2 * j + 1)
    return np.where(np.abs(v) < 0.1, near, x * np.log(x / m) - apart)


def _front(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x^a (1 - x)^b / B(a, b): a binomial density in saddle-point form, so that sizes of millions lose no digits."""
    n = a + b
    density = np.exp(_stirling_error(n) - _stirling_error(a) - _stirling_error(b) - _deviance(a, n * x) - _deviance(b, n * (1 - x)))
    return density * np.sqrt(a * b / (2 * pi * n))


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays of a, b > 0 and 0 <= x <= 1, by its continued fraction.

    All elements run through the fraction together, some multiple of the root of the largest size in steps.
    """
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    inside = (x > 0) & (x < 1)
    swap = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(swap, b, a), np.where(swap, a, b), np.where(inside, np.where(swap, 1 - x, x), 0.5)
    n = a + b
    front = _front(a, b, y) / a
    tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(y), 1 / tiny(1 - n * y / (a + 1))
    h, open_ = d.copy(), np.ones(y.shape, bool)
    for m in range(1, 100_000):
        for up in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (n + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / tiny(1 + up * d)
            c = tiny(1 + up / c)
            h = np.where(open_, h * c * d, h)
        open_ &= np.abs(c * d - 1) > _EPS  # what is done stays, so no element depends on its neighbours
        if not open_.any():
            break
    found = np.clip(front * h, 0.0, 1.0)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - found, found)))


def tails(n: np.ndarray, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= x) of binomials, for arrays."""
    n, x, p = (np.asarray(v, float) for v in np.broadcast_arrays(n, x, p))
    inside = (x > 0) & (x <= n) & (p > 0) & (p < 1)
    share = beta_share(np.where(inside, x, 1.0), np.where(inside, n - x + 1, 1.0), np.where(inside, p, 0.5))
    return np.where(x <= 0, 1.0, np.where((p <= 0) | (x > n), 0.0, np.where(p >= 1, 1.0, share)))


def tail(n: int, x: int, p: float) -> float:
    return float(tails(n, x, p))


def exact_intervals(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Clopper-Pearson for arrays: the rates at which k or more, or k or fewer, of n are just as rare as alpha / 2; unknown for n = 0.

    Both ends are quantiles of beta distributions, found together by Newton's steps, or by halving where a step leaves what is still open.
    """
    k, n = (np.asarray(v, float) for v in np.broadcast_arrays(k, n))
    a, b = np.stack([k, k + 1]), np.stack([n - k + 1, n - k])
    wanted = np.broadcast_to(np.array([alpha / 2, 1 - alpha / 2]).reshape(2, *[1] * k.ndim), a.shape)
    free = (a > 0) & (b > 0) & (n > 0)
    a, b = np.where(free, a, 1.0), np.where(free, b, 1.0)
    low, high = np.zeros(a.shape), np.ones(a.shape)
    at, open_ = a / (a + b), np.ones(a.shape, bool)
    for _ in range(100):
        over = beta_share(a, b, at) - wanted
        low, high = np.where(over < 0, at, low), np.where(over < 0, high, at)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = at - over * at * (1 - at) / _front(a, b, at)
        new = np.where((step > low) & (step < high) & np.isfinite(step), step, (low + high) / 2)
        at, open_ = np.where(open_, new, at), open_ & (np.abs(new - at) > _EPS * (1 + np.abs(new)))
        if not open_.any():
            break
    below, above = np.where(k <= 0, 0.0, at[0]), np.where(k >= n, 1.0, at[1])
    return np.where(n > 0, below, np.nan), np.where(n > 0, above, np.nan)


def exact_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    low, high = exact_intervals(k, n, alpha)
    return float(low), float(high)


def bootstrap_interval(data: np.ndarray, statistic, n_boot: int = 1000, block: int = 10, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of a statistic (over axis 1) from circular blocks of the data in their order; of single values if the data are fewer than a block."""
    n = len(data)
    rng = np.random.default_rng(seed)
    width, pieces = (1, n) if n < block else (block, ceil(n / block))
    found = []
    rows = max(1, 2_000_000 // n)  # of a chunk of resamples, so that memory stays bounded
    for at in range(0, n_boot, rows):
        starts = rng.integers(0, n, size=(min(rows, n_boot - at), pieces))
        places = (starts[:, :, None] + np.arange(width)).reshape(len(starts), -1)[:, :n] % n
        found.append(statistic(data[places], axis=1))
    low, high = np.percentile(np.concatenate(found), [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


@pandas_udf(DoubleType())
def binomial_tail(n: pd.Series, x: pd.Series, p: pd.Series) -> pd.Series:
    known = p.notna()
    found = tails(n.where(known, 1).to_numpy(float), x.where(known, 0).to_numpy(float), p.where(known, 0.5).to_numpy(float))
    return pd.Series(found, dtype="float64").where(known.reset_index(drop=True))


@pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def rate_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    low, high = exact_intervals(k.to_numpy(float), n.to_numpy(float))
    return pd.DataFrame({"low": low, "high": high})
