"""Problem 7: implausible spikes in measurements."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.intervals import latest_versions


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(w[order])
    return float(x[order][np.searchsorted(total, total[-1] / 2)]) if len(x) and total[-1] > 0 else 0.0


def robust_ar(y: np.ndarray) -> tuple[float, float, float]:
    """Level, coefficient and residual scale of a first-order autoregression.

    Least absolute deviations: the coefficient is the weighted median of successive ratios, weights bounded so that one wild
    reading can't outweigh the rest. The scale is the median
    absolute residual or, if larger, what the 80th percentile of absolute residuals says: thinly traded series
    stand still on many days, and their median alone would call every move wild. A tenth of wild readings moves none far.
    """
    level = float(np.median(y))
    x = y - level
    before, now = x[:-1], x[1:]
    use = np.abs(before) > 0
    bound = 3 * float(np.median(np.abs(x)))
    phi = float(np.clip(weighted_median(now[use] / before[use], np.minimum(np.abs(before[use]), bound)), 0.0, 1.0))
    e = now - phi * before
    size = np.abs(e - np.median(e))
    scale = max(1.4826 * float(np.median(size)), float(np.quantile(size, 0.8)) / 1.2816)
    return level, phi, scale


def additive_outliers(y: np.ndarray, threshold: float, floor: float, longest: int = 2) -> np.ndarray:
    """Marks of the readings that leave the usual movement and are back after one or two readings.

    Iterative tests on the residuals of :func:`robust_ar`: in each round the largest reduction of the residual sum of
    squares among an additive outlier of one reading, one of two, and a level shift is taken out of the
    series, until none exceeds ``threshold`` scales. Level shifts are taken out but not marked: a move that lasts is no spike.
    The first and last reading have one neighbour only and can't be seen to return, so they are never marked.
    """
    n = len(y)
    marks = np.zeros(n, bool)
    if n < 8:
        return marks
    x = y.astype(float).copy()
    least = threshold**2
    for _ in range(n):
        # fitted anew each time: a shift that is still in the series bends level and coefficient
        level, phi, scale = robust_ar(x)
        x = x - level
        s2 = max(scale, floor) ** 2
        e = np.zeros(n)
        e[1:] = x[1:] - phi * x[:-1]
        g = 1 + phi * phi
        b = e[:-1] - phi * e[1:]  # for an outlier at t, with e[0] unknown
        one = np.zeros(n)
        one[1:-1] = b[1:] ** 2 / g / s2
        two = np.zeros(n)
        det = g * g - phi * phi
        b1, b2 = b[1:-1], b[2:]
        two[1:-2] = (g * b1 * b1 + 2 * phi * b1 * b2 + g * b2 * b2) / det / s2
        w1, w2 = (g * b1 + phi * b2) / det, (phi * b1 + g * b2) / det
        small = np.minimum(np.abs(w1), np.abs(w2)) < 0.5 * threshold * np.sqrt(s2 / g)
        two[1:-2][small] = 0
        rest = np.cumsum(e[::-1])[::-1] - e
        shift = (e + (1 - phi) * rest) ** 2 / (1 + (1 - phi) ** 2 * np.arange(n - 1, -1, -1)) / s2
        shift[0] = 0
        best = max(((one.max(), 1, int(one.argmax())), (two.max() - least / 2, 2, int(two.argmax())), (shift.max(), 0, int(shift.argmax()))), key=lambda c: c[0])
        if best[0] < least:
            break
        _, length, t = best
        if length:
            marks[t : t + length] = True
            x[t : t + length] = np.interp(np.arange(t, t + length), [t - 1, t + length], [x[t - 1], x[t + length]])
        else:
            x[t:] -= (e[t] + (1 - phi) * rest[t]) / (1 + (1 - phi) ** 2 * (n - 1 - t))
    return marks


def stuck(v: np.ndarray, least: int) -> np.ndarray:
    """Marks of runs of ``least`` or more successive equal readings; a null reading is in no run and ends one."""
    n = len(v)
    if not n:
        return np.zeros(0, bool)
    same = np.r_[False, v[1:] == v[:-1]]
    run = np.cumsum(~same)
    return (np.bincount(run)[run] >= least) & ~np.isnan(v)


FLAGS = ("limit", "order", "spike", "stuck")


def flag_series(threshold: float, floor: float, run: int, spike_fields: tuple[str, ...], stuck_fields: tuple[str, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def flag(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("bar_date", kind="stable").reset_index(drop=True)
        v = {c: bars[c].to_numpy(float) for c in ("open", "high", "low", "close", "adj_close", "volume")}
        with np.errstate(invalid="ignore"):
            limit = (v["volume"] < 0) | np.any([v[c] <= 0 for c in ("open", "high", "low", "close", "adj_close")], axis=0)
            order = (v["high"] < v["low"]) | np.any([(v[c] < v["low"]) | (v[c] > v["high"]) for c in ("open", "close")], axis=0)
        spike, still = np.zeros(len(bars), bool), np.zeros(len(bars), bool)
        for c in spike_fields:
            with np.errstate(invalid="ignore", divide="ignore"):
                y = np.log1p(v[c]) if c == "volume" else np.log(v[c])
                use = np.flatnonzero(np.isfinite(y) & ((v[c] >= 0) if c == "volume" else (v[c] > 0)))
            spike[use[additive_outliers(y[use], threshold, floor)]] = True
        for c in stuck_fields:
            still |= stuck(v[c], run)
        out = pd.DataFrame({"symbol": bars["symbol"], "bar_date": bars["bar_date"], "limit": limit, "order": order, "spike": spike, "stuck": still})
        return out[limit | order | spike | still]

    return flag


def implausible(bars: DataFrame, threshold: float = 8.5, floor: float = 0.002, run: int = 6, spike_fields: tuple[str, ...] = ("close", "adj_close", "high", "volume"), stuck_fields: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """Flag implausible bars, each symbol against its own normal behaviour.

    ``bars``: symbol, bar_date (string), open, high, low, close, adj_close, volume, bar_seq. Of several rows of one
    symbol and day the one with the highest bar_seq counts (nulls first). Result, only flagged bars: symbol, bar_date, limit
    (zero or negative price, negative volume), order (high below low, open or close outside), spike, stuck (``run``
    or more successive equal closes or volumes). ``threshold``: residual scales a spike must exceed; ``floor``: least
    residual scale on logarithms. Nulls are never implausible and are skipped; a series of under eight readings has
    no spikes; rows without symbol or day are no bars; an empty table gives an empty result; other columns are ignored.

    A symbol goes to one task as a group, which is bounded: after the reduction it has one row per calendar day.
    """
    fields = ["open", "high", "low", "close", "adj_close", "volume"]
    rows = bars.where("symbol is not null and bar_date is not null").select("symbol", "bar_date", "bar_seq", *(F.col(c).cast("double").alias(c) for c in fields))
    counting = latest_versions(rows, ["symbol", "bar_date"], ["bar_seq"]).drop("bar_seq")
    schema = "symbol string, bar_date string, limit boolean, order boolean, spike boolean, stuck boolean"
    return counting.groupBy("symbol").applyInPandas(flag_series(threshold, floor, run, spike_fields, stuck_fields), schema)
