"""Indicators with a running state, as array code over the look-back windows of a symbol.

Each value is what a recursion gives that begins at the start of the bar's own look-back window. All windows of a symbol are stacked
as rows of a matrix and stepped through together, so a step is one vector operation over all bars. Bars whose history is shorter than
the look-back share one window that begins at the symbol's first bar. A symbol is bounded by its calendar days.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[list[np.ndarray]], Iterator[dict[str, np.ndarray]]]


def rolled(fields: list[np.ndarray], lookback: int, recursion: Step, names: list[str]) -> dict[str, np.ndarray]:
    """Last values of the recursion over each bar's window. ``recursion`` takes fields of shape (windows, length) and gives
    the values after each step."""
    n = len(fields[0])
    out = {k: np.full(n, np.nan) for k in names}
    head = recursion([f[None, : min(n, lookback)] for f in fields])
    for t, values in enumerate(head):
        for k in names:
            out[k][t] = values[k][0]
    if n > lookback:
        windows = [np.lib.stride_tricks.sliding_window_view(f, lookback) for f in fields]
        values = deque(recursion(windows), maxlen=1)[0]
        for k in names:
            out[k][lookback - 1 :] = values[k]
    return out


class Average:
    """Exponential average seeded with the mean of the first n values; NaN input is passed over."""

    def __init__(self, n: int, rows: int, weight: float | None = None) -> None:
        self.n, self.a = n, weight or 2 / (n + 1)
        self.seen, self.sum, self.value, self.full = np.zeros(rows, int), np.zeros(rows), np.full(rows, np.nan), False

    def step(self, x: np.ndarray) -> np.ndarray:
        if self.full and not np.isnan(x).any():
            self.value = x * self.a + self.value * (1 - self.a)
            return self.value
        ok = ~np.isnan(x)
        self.seen = self.seen + ok
        self.sum = np.where(ok, self.sum + x, self.sum)
        new = np.where(self.seen < self.n, np.nan, np.where(self.seen == self.n, self.sum / self.n, x * self.a + self.value * (1 - self.a)))
        self.value = np.where(ok, new, self.value)
        self.full = bool((self.seen >= self.n).all())
        return self.value


def macd(fast: int, slow: int, signal: int) -> Step:
    def run(fields: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        (c,) = fields
        f, s, g = (Average(n, len(c)) for n in (fast, slow, signal))
        for j in range(c.shape[1]):
            line = f.step(c[:, j]) - s.step(c[:, j])
            sig = g.step(line)
            ready = j + 1 >= slow + signal
            yield {"line": np.where(ready, line, np.nan), "signal": np.where(ready, sig, np.nan), "histogram": np.where(ready, line - sig, np.nan)}

    return run


def trix(n: int) -> Step:
    def run(fields: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        (c,) = fields
        a, b, d = (Average(n, len(c)) for _ in range(3))
        before = np.full(len(c), np.nan)
        for j in range(c.shape[1]):
            now = d.step(b.step(a.step(c[:, j])))
            with np.errstate(divide="ignore", invalid="ignore"):
                yield {"value": np.where((before != 0) & (j + 1 >= 3 * n + 2), now / before - 1, np.nan)}
            before = now

    return run


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray, j: int) -> np.ndarray:
    return np.maximum.reduce([h[:, j] - l[:, j], np.abs(h[:, j] - c[:, j - 1]), np.abs(l[:, j] - c[:, j - 1])])


def adx(n: int) -> Step:
    """Wilder sums of true range and directional moves; the index is their Wilder average, seeded with a mean."""

    def run(fields: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        h, l, c = fields
        rows = len(c)
        sums = np.zeros((3, rows))
        average = Average(n, rows, 1 / n)
        nan = np.full(rows, np.nan)
        yield {"adx": nan, "plus_di": nan, "minus_di": nan}
        for j in range(1, c.shape[1]):
            up, down = h[:, j] - h[:, j - 1], l[:, j - 1] - l[:, j]
            new = np.stack([true_range(h, l, c, j), np.where((up > down) & (up > 0), up, 0), np.where((down > up) & (down > 0), down, 0)])
            sums = sums + new if j <= n else sums - sums / n + new
            value, plus, minus = nan, nan, nan
            if j >= n:
                with np.errstate(divide="ignore", invalid="ignore"):
                    plus, minus = (np.where(sums[0] > 0, 100 * sums[i] / sums[0], 0) for i in (1, 2))
                    dx = np.where(plus + minus > 0, 100 * np.abs(plus - minus) / (plus + minus), 0)
                value = average.step(dx)
            yield {k: np.where(j + 1 >= 2 * n + 1, x, np.nan) for k, x in (("adx", value), ("plus_di", plus), ("minus_di", minus))}

    return run


def supertrend(n: int, k: float) -> Step:
    """Bands about the middle of the bar that only close in until the close crosses them."""

    def run(fields: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        h, l, c = fields
        rows = len(c)
        atr = Average(n, rows, 1 / n)
        high, low, up = np.full(rows, np.inf), np.full(rows, -np.inf), np.ones(rows, bool)
        started = np.zeros(rows, bool)
        for j in range(c.shape[1]):
            width = k * atr.step(true_range(h, l, c, j)) if j else np.full(rows, np.nan)
            mid = (h[:, j] + l[:, j]) / 2
            known = ~np.isnan(width)
            before = c[:, j - 1] if j else c[:, j]
            up = np.where(started & (c[:, j] > high), True, np.where(started & (c[:, j] < low), False, np.where(started, up, c[:, j] >= mid)))
            high = np.where(known, np.where(started & (mid + width > high) & (before <= high), high, mid + width), high)
            low = np.where(known, np.where(started & (mid - width < low) & (before >= low), low, mid - width), low)
            started = started | known
            ready = started & (j + 1 >= 3 * n)
            yield {"value": np.where(ready, np.where(up, low, high), np.nan), "rising": np.where(ready, up.astype(float), np.nan)}

    return run


def psar(step: float, most: float) -> Step:
    def run(fields: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        h, l = fields
        rows, m = h.shape
        yield {"value": np.full(rows, np.nan)}
        if m < 2:
            return
        up = h[:, 1] + l[:, 1] >= h[:, 0] + l[:, 0]
        stop, best, speed = np.where(up, l[:, 0], h[:, 0]), np.where(up, h[:, 0], l[:, 0]), np.full(rows, step)
        for j in range(1, m):
            h1, l1, h2, l2 = h[:, j - 1], l[:, j - 1], h[:, max(j - 2, 0)], l[:, max(j - 2, 0)]
            moved = stop + speed * (best - stop)
            moved = np.where(up, np.minimum(moved, np.minimum(l1, l2)), np.maximum(moved, np.maximum(h1, h2)))
            turn = np.where(up, l[:, j] < moved, h[:, j] > moved)
            further = np.where(up, h[:, j] > best, l[:, j] < best)
            reached = np.where(up, h[:, j], l[:, j])
            stop = np.where(turn, best, moved)
            speed = np.where(turn, step, np.where(further, np.minimum(speed + step, most), speed))
            best = np.where(turn, np.where(up, l[:, j], h[:, j]), np.where(further, reached, best))
            up = up ^ turn
            yield {"value": np.where(j + 1 >= 5, stop, np.nan)}

    return run


def rsi(n: int) -> Step:
    """100 without losses, 50 without any change."""

    def run(fields: list[np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        (c,) = fields
        up, down = Average(n, len(c), 1 / n), Average(n, len(c), 1 / n)
        yield {"value": np.full(len(c), np.nan)}
        for j in range(1, c.shape[1]):
            change = c[:, j] - c[:, j - 1]
            gain, loss = up.step(np.maximum(change, 0)), down.step(np.maximum(-change, 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                yield {"value": np.where((loss == 0) & (gain == 0), 50, np.where(loss == 0, 100, 100 - 100 / (1 + gain / loss)))}

    return run


#: fields, look-back, recursion, names of the results
KINDS: dict[str, tuple[list[str], int, Step, list[str]]] = {
    "rsi": (["c"], 4 * 14 + 5, rsi(14), ["value"]),
    "macd": (["c"], 4 * 26 + 3 * 9 + 10, macd(12, 26, 9), ["line", "signal", "histogram"]),
    "trix": (["c"], 4 * 15 + 10, trix(15), ["value"]),
    "adx": (["h", "l", "c"], 4 * 14 + 10, adx(14), ["adx", "plus_di", "minus_di"]),
    "supertrend": (["h", "l", "c"], 6 * 10 + 10, supertrend(10, 3.0), ["value", "rising"]),
    "psar": (["h", "l"], 120, psar(0.02, 0.2), ["value"]),
}


def recursive(bars: DataFrame, kind: str, fields: list[str] | None = None, lookback: int | None = None, recursion: Step | None = None, names: list[str] | None = None) -> DataFrame:
    """The indicator for every bar: symbol, bar_date and its values (null while the history is short).

    ``bars``: symbol, bar_date and adjusted h, l, c. ``kind`` is one of KINDS; other periods are given by the further arguments.
    """
    f0, m0, r0, n0 = KINDS[kind]
    fields, lookback, recursion, names = fields or f0, lookback or m0, recursion or r0, names or n0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_date", kind="stable")
        values = rolled([pdf[f].to_numpy(float) for f in fields], lookback, recursion, names)
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "bar_date": pdf["bar_date"].to_numpy(), **values})

    schema = "symbol string, bar_date date, " + ", ".join(f"{n} double" for n in names)
    return bars.select("symbol", "bar_date", *fields).groupBy("symbol").applyInPandas(run, schema)
