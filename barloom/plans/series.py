"""Indicators of one symbol's bars as arrays, for strategies: the same values as the columns of :mod:`barloom.operators.indicators`.

Each function takes the symbol's own bars (o, h, l, c, v) and gives an array, or several by name, with a value for each bar; NaN where there
is none. A strategy reads them at its day only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from barloom.operators import recursive as R

Values = np.ndarray | dict[str, np.ndarray]


def window(x: pd.Series, n: int):
    return x.rolling(n)


def change(c: pd.Series, n: int = 1) -> pd.Series:
    before = c.shift(n)
    return (c / before.where(before != 0) - 1).where(before.notna())


def daily(c: pd.Series) -> pd.Series:
    """One-bar returns; 0 where the price before is 0."""
    before = c.shift(1)
    return (c / before.where(before != 0) - 1).where(before != 0, 0.0).where(before.notna())


def weighted(x: pd.Series, n: int) -> pd.Series:
    w = np.arange(1, n + 1) / (n * (n + 1) / 2)
    return x.rolling(n).apply(lambda v: float(v @ w), raw=True)


def hull(c: pd.Series, n: int) -> pd.Series:
    return weighted(2 * weighted(c, n // 2) - weighted(c, n), math.floor(math.sqrt(n) + 0.5))


def true_range(b: pd.DataFrame) -> pd.Series:
    before = b["c"].shift(1)
    return pd.concat([b["h"] - b["l"], (b["h"] - before).abs(), (b["l"] - before).abs()], axis=1).max(axis=1).where(before.notna())


def typical(b: pd.DataFrame) -> pd.Series:
    return (b["h"] + b["l"] + b["c"]) / 3


def averaged(n: int, weight: float | None = None) -> R.Step:
    def run(fields: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        a = R.Average(n, len(fields[0]), weight)
        for j in range(fields[0].shape[1]):
            yield {"value": a.step(fields[0][:, j])}

    return run


def ema(x: pd.Series, n: int) -> pd.Series:
    """Over a look-back of 3n + 5 bars."""
    return pd.Series(R.rolled([x.to_numpy(float)], 3 * n + 5, averaged(n), ["value"])["value"] if len(x) else [], x.index, float)


def atr(b: pd.DataFrame, n: int = 14, lookback: int | None = None) -> pd.Series:
    tr = true_range(b).to_numpy(float)[1:]
    own = R.rolled([tr], (lookback or 4 * n + 5) - 1, averaged(n, 1 / n), ["value"])["value"] if len(tr) else np.empty(0)
    return pd.Series(np.r_[[np.nan] * min(1, len(b)), own], b.index)


def stepped(b: pd.DataFrame, fields: str, lookback: int, recursion: R.Step, names: list[str]) -> dict[str, np.ndarray]:
    return R.rolled([b[f].to_numpy(float) for f in fields], lookback, recursion, names) if len(b) else {k: np.empty(0) for k in names}


def bollinger(b: pd.DataFrame, n: int = 20, k: float = 2.0) -> Values:
    mid, sd = window(b["c"], n).mean(), window(b["c"], n).std()
    return {"middle": mid, "upper": mid + k * sd, "lower": mid - k * sd}


def keltner(b: pd.DataFrame, n: int = 20, k: float = 2.0) -> Values:
    mid, band = ema(b["c"], n), atr(b, n, 3 * n + 5)
    return {"middle": mid, "upper": mid + k * band, "lower": mid - k * band}


def stochastic(b: pd.DataFrame, n: int = 14, smooth: int = 3) -> Values:
    high, low = window(b["h"], n).max(), window(b["l"], n).min()
    k = (100 * (b["c"] - low) / (high - low).where(high != low)).where(high != low, 50.0).where(high.notna())
    return {"k": k, "d": window(k, smooth).mean()}


def williams(b: pd.DataFrame, n: int = 14) -> pd.Series:
    high, low = window(b["h"], n).max(), window(b["l"], n).min()
    return -100 * (high - b["c"]) / (high - low).where(high != low)


def cci(b: pd.DataFrame, n: int = 20) -> pd.Series:
    tp = typical(b)
    mean, spread = window(tp, n).mean(), window(tp, n).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
    return ((tp - mean) / (0.015 * spread).where(spread != 0)).where(spread != 0, 0.0).where(spread.notna())


def obv(b: pd.DataFrame, n: int = 60) -> pd.Series:
    return window((np.sign(b["c"].diff()) * b["v"]), n - 1).sum()


def mfi(b: pd.DataFrame, n: int = 14) -> pd.Series:
    tp = typical(b)
    flow, step = tp * b["v"], tp.diff()
    up, down = (window(flow.where(s, 0.0).where(step.notna()), n).sum() for s in (step > 0, step < 0))
    return (100 - 100 / (1 + up / down.where(down != 0))).where(down != 0, 100.0).where((up != 0) | (down != 0)).where(up.notna())


def vwap(b: pd.DataFrame, n: int = 20) -> pd.Series:
    total = window(b["v"], n).sum()
    return window(typical(b) * b["v"], n).sum() / total.where(total != 0)


def cmf(b: pd.DataFrame, n: int = 20) -> pd.Series:
    span = b["h"] - b["l"]
    some = span != 0
    flow = (((b["c"] - b["l"]) - (b["h"] - b["c"])) / span.where(some) * b["v"]).where(some, 0.0)
    total = window(b["v"].where(some, 0.0), n).sum()
    return window(flow, n).sum() / total.where(total != 0)


def donchian(b: pd.DataFrame, n: int = 20) -> Values:
    high, low = window(b["h"], n).max(), window(b["l"], n).min()
    return {"upper": high, "lower": low, "middle": (high + low) / 2}


def aroon(b: pd.DataFrame, n: int = 25) -> Values:
    since = lambda x, f: window(x, n + 1).apply(lambda v: 100.0 * (n - int(f(v[::-1]))) / n, raw=True)
    up, down = since(b["h"], np.argmax), since(b["l"], np.argmin)
    return {"up": up, "down": down, "oscillator": up - down}


def ichimoku(b: pd.DataFrame, conversion: int = 9, base: int = 26, span: int = 52) -> Values:
    mid = lambda n: (window(b["h"], n).max() + window(b["l"], n).min()) / 2
    return {"conversion": mid(conversion), "base": mid(base), "span_a": (mid(conversion) + mid(base)) / 2, "span_b": mid(span)}


def choppiness(b: pd.DataFrame, n: int = 14) -> pd.Series:
    span, total = window(b["h"], n).max() - window(b["l"], n).min(), window(true_range(b), n).sum()
    ok = (span > 0) & (total > 0)
    return 100 * np.log10((total / span.where(ok)).where(ok)) / math.log10(n)


def linreg(b: pd.DataFrame, n: int = 20) -> Values:
    x = np.arange(n) - (n - 1) / 2
    sxx = float(x @ x)
    slope = window(b["c"], n).apply(lambda y: float(x @ y) / sxx, raw=True)
    mean = window(b["c"], n).mean()
    intercept = mean - slope * (n - 1) / 2
    spread = window(b["c"], n).apply(lambda y: float(((y - y.mean()) ** 2).sum()), raw=True)
    return {"slope": slope, "intercept": intercept, "r2": (slope**2 * sxx / spread.where(spread > 0)), "forecast": intercept + slope * n}


INDICATORS: dict[str, Callable[..., Values]] = {
    "sma": lambda b, n=20: window(b["c"], n).mean(), "stdev": lambda b, n=20: window(b["c"], n).std(), "bollinger": bollinger, "highest": lambda b, n=20: b["c"].rolling(n, min_periods=1).max(), "lowest": lambda b, n=20: b["c"].rolling(n, min_periods=1).min(),
    "momentum": lambda b, n=20: change(b["c"], n), "roc": lambda b, n=10: change(b["c"], n), "zscore": lambda b, n=20: (b["c"] - window(b["c"], n).mean()) / window(b["c"], n).std().where(lambda s: s != 0),
    "drawdown": lambda b, n=252: b["c"] / b["c"].rolling(n, min_periods=1).max() - 1, "wma": lambda b, n=20: weighted(b["c"], n), "hma": lambda b, n=20: hull(b["c"], n), "ema": lambda b, n=20: ema(b["c"], n),
    "rsi": lambda b, n=14: stepped(b, "c", 4 * n + 5, R.rsi(n), ["value"])["value"], "macd": lambda b, fast=12, slow=26, signal=9: stepped(b, "c", 4 * slow + 3 * signal + 10, R.macd(fast, slow, signal), ["line", "signal", "histogram"]),
    "trix": lambda b, n=15: stepped(b, "c", 4 * n + 10, R.trix(n), ["value"])["value"], "adx": lambda b, n=14: stepped(b, "hlc", 4 * n + 10, R.adx(n), ["adx", "plus_di", "minus_di"]), "supertrend": lambda b, n=10, k=3.0: stepped(b, "hlc", 6 * n + 10, R.supertrend(n, k), ["value", "rising"]),
    "psar": lambda b, step=0.02, most=0.2: stepped(b, "hl", 120, R.psar(step, most), ["value"])["value"], "atr": atr, "keltner": keltner, "stochastic": stochastic, "williams_r": williams, "cci": cci, "obv": obv, "mfi": mfi, "vwap": vwap, "cmf": cmf,
    "donchian": donchian, "aroon": aroon, "ichimoku": ichimoku, "choppiness": choppiness, "linreg": linreg,
}
