"""Technical indicators as Column expressions over bounded look-backs.

Every indicator is a function of a bounded frame of the latest bars of a symbol, so it needs one sort by (symbol, day),
shared by all indicators of a query, and no Python. The path-dependent ones (exponential and Wilder averages) begin anew at the
start of their look-back on every bar, with the look-backs documented at each function; they are folds over a ``collect_list`` frame. Those with
more state are in :mod:`barloom.operators.recursive`.
Input columns: symbol, bar_date and the adjusted o, h, l, c, v of :func:`barloom.operators.bars.adjusted`.
A value is null while the history is too short, unless the window is said to clamp.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIODS = 252


def by_symbol():
    return W.partitionBy("symbol").orderBy("bar_date")


def null() -> Column:
    return F.lit(None).cast("double")


def last(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def history(c: str | Column, m: int) -> Column:
    """The latest m values or fewer, oldest first."""
    return F.collect_list(col(c)).over(last(m))


def full(c: Column, x: str | Column, n: int) -> Column:
    """c where the window has n values."""
    return F.when(F.count(col(x)).over(last(n)) == n, c)


def nz(c: Column) -> Column:
    return F.when(c != 0, c)


# -- windows ---------------------------------------------------------------------------------------------------------------


def sma(n: int = 20, x: str | Column = "c") -> Column:
    return full(F.avg(col(x)).over(last(n)), x, n)


def stdev(n: int = 20, x: str | Column = "c") -> Column:
    """Sample standard deviation."""
    return full(F.stddev_samp(col(x)).over(last(n)), x, n)


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = sma(n), stdev(n)
    return {"middle": mid, "upper": mid + k * sd, "lower": mid - k * sd}


def highest(n: int = 20, x: str = "c") -> Column:
    """Clamps to the bars there are."""
    return F.max(x).over(last(n))


def lowest(n: int = 20, x: str = "c") -> Column:
    return F.min(x).over(last(n))


def momentum(n: int = 20, x: str = "c") -> Column:
    """Change over n bars; null where the past value is 0."""
    return F.col(x) / nz(F.lag(x, n).over(by_symbol())) - 1


def ret(n: int = 1) -> Column:
    past = F.lag("c", n).over(by_symbol())
    return F.when(past == 0, 0.0).otherwise(F.col("c") / past - 1)


def zscore(n: int = 20) -> Column:
    return (F.col("c") - sma(n)) / nz(stdev(n))


def volatility(n: int = 20, periods: float = PERIODS) -> Column:
    """Annualised; needs the column r (one-bar returns) of :func:`with_returns`."""
    return stdev(n, "r") * math.sqrt(periods)


def drawdown(n: int = 252) -> Column:
    return F.col("c") / F.max("c").over(last(n)) - 1


def correlation(n: int = 60, a: str = "r", b: str = "rb") -> Column:
    """Null with a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    flat = (F.min(a).over(last(n)) == F.max(a).over(last(n))) | (F.min(b).over(last(n)) == F.max(b).over(last(n)))
    spread = F.sqrt(F.var_pop(a).over(last(n)) * F.var_pop(b).over(last(n)))
    return F.when((F.sum(both.cast("int")).over(last(n)) == n) & ~flat, F.covar_pop(a, b).over(last(n)) / nz(spread))


def beta(n: int = 60, a: str = "r", b: str = "rb") -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    flat = F.min(b).over(last(n)) == F.max(b).over(last(n))
    return F.when((F.sum(both.cast("int")).over(last(n)) == n) & ~flat, F.covar_pop(a, b).over(last(n)) / nz(F.var_pop(b).over(last(n))))


def weighted(xs: Column) -> Column:
    """Linear weights, the newest the heaviest."""
    n = F.size(xs).cast("double")
    pairs = F.transform(xs, lambda x, i: x * (i + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (n * (n + 1) / 2)


def wma(n: int = 20, x: str = "c") -> Column:
    return full(weighted(history(x, n)), x, n)


def hma_input(n: int = 20) -> Column:
    """2 WMA(n/2) - WMA(n): the column that :func:`hma` averages once more."""
    return 2 * wma(n // 2) - wma(n)


def hma(n: int = 20, x: str = "hma_input") -> Column:
    m = math.floor(math.sqrt(n) + 0.5)
    return full(weighted(history(x, m)), x, m)


def typical() -> Column:
    return (F.col("h") + F.col("l") + F.col("c")) / 3


def stochastic_k(n: int = 14) -> Column:
    high, low = F.max("h").over(last(n)), F.min("l").over(last(n))
    return full(F.when(high == low, 50.0).otherwise(100 * (F.col("c") - low) / (high - low)), "c", n)


def williams_r(n: int = 14) -> Column:
    high, low = F.max("h").over(last(n)), F.min("l").over(last(n))
    return full(F.when(high != low, -100 * (high - F.col("c")) / (high - low)), "c", n)


def cci(n: int = 20) -> Column:
    """Deviation from the typical price's average in units of 0.015 mean absolute deviations; 0 where that is 0."""
    xs, mean = history("tp", n), F.avg("tp").over(last(n))
    spread = F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.abs(x - mean)) / n
    return full(F.when(spread == 0, 0.0).otherwise((F.col("tp") - mean) / (0.015 * spread)), "tp", n)


def obv(n: int = 60) -> Column:
    """Over the look-back only: n bars, n - 1 changes."""
    change = F.col("c") - F.col("pc")
    signed = F.when(change > 0, F.col("v")).when(change < 0, -F.col("v")).otherwise(0.0)
    return full(F.sum(F.when(F.col("pc").isNotNull(), signed)).over(last(n - 1)), "c", n)


def mfi(n: int = 14) -> Column:
    """Money flow: 100 where nothing flowed out; null where nothing flowed at all."""
    flow = F.col("tp") * F.col("v")
    up = F.sum(F.when(F.col("tp") > F.col("ptp"), flow).otherwise(0.0)).over(last(n))
    down = F.sum(F.when(F.col("tp") < F.col("ptp"), flow).otherwise(0.0)).over(last(n))
    value = F.when((down == 0) & (up == 0), None).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))
    return F.when(F.count("ptp").over(last(n)) == n, value)


def vwap(n: int = 20) -> Column:
    return full(F.sum(F.col("tp") * F.col("v")).over(last(n)) / nz(F.sum("v").over(last(n))), "c", n)


def cmf(n: int = 20) -> Column:
    """Bars without a range count in neither sum."""
    span = F.col("h") - F.col("l")
    place = F.when(span != 0, ((F.col("c") - F.col("l")) - (F.col("h") - F.col("c"))) / span * F.col("v"))
    return full(F.sum(place).over(last(n)) / nz(F.sum(F.when(span != 0, F.col("v"))).over(last(n))), "c", n)


def donchian(n: int = 20) -> dict[str, Column]:
    high, low = full(F.max("h").over(last(n)), "h", n), full(F.min("l").over(last(n)), "l", n)
    return {"upper": high, "lower": low, "middle": (high + low) / 2}


def aroon(n: int = 25) -> dict[str, Column]:
    """Bars since the extreme of the last n + 1; of equal extremes the latest counts."""
    def since(x: str, extreme: Callable[[Column], Column]) -> Column:
        newest_first = F.reverse(history(x, n + 1))
        return full(100.0 * (n - (F.array_position(newest_first, extreme(newest_first)) - 1)) / n, x, n + 1)

    up, down = since("h", F.array_max), since("l", F.array_min)
    return {"up": up, "down": down, "oscillator": up - down}


def ichimoku(conversion: int = 9, base: int = 26, span: int = 52) -> dict[str, Column]:
    """Spans aren't shifted forward."""
    middle = lambda n: full((F.max("h").over(last(n)) + F.min("l").over(last(n))) / 2, "h", n)
    a, b = middle(conversion), middle(base)
    return {"conversion": a, "base": b, "span_a": (a + b) / 2, "span_b": middle(span)}


def choppiness(n: int = 14) -> Column:
    span = F.max("h").over(last(n)) - F.min("l").over(last(n))
    total = F.sum("tr").over(last(n))
    return F.when((F.count("tr").over(last(n)) == n) & (span > 0) & (total > 0), 100 * F.log10(total / span) / math.log10(n))


def linreg(n: int = 20) -> dict[str, Column]:
    """Slope, intercept (x = 0 at the oldest bar), r squared and the line's value at the next bar; n of 3 or more."""
    xs = history("c", n)
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    sy = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    sxy = F.aggregate(F.transform(xs, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    intercept = (sy - slope * sx) / n
    mean = sy / n
    fit = F.aggregate(F.transform(xs, lambda x, i: (x - intercept - slope * i) * (x - intercept - slope * i)), F.lit(0.0), lambda s, x: s + x)
    all_ = F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return {"slope": full(slope, "c", n), "intercept": full(intercept, "c", n), "r2": full(F.when(all_ > 0, 1 - fit / all_), "c", n), "forecast": full(intercept + slope * n, "c", n)}


# -- folds over a look-back ------------------------------------------------------------------------------------------------


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def rest(xs: Column, n: int) -> Column:
    """All of the array after its first n elements."""
    return F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0)))


def ema_of(xs: Column, n: int) -> Column:
    """Begins with the mean of the first n values of the array."""
    a = 2 / (n + 1)
    start = total(F.slice(xs, 1, n)) / n
    return F.when(F.size(xs) >= n, F.aggregate(rest(xs, n), start, lambda s, x: x * a + s * (1 - a)))


def ema(n: int = 20, x: str = "c") -> Column:
    """Look-back 3n + 5."""
    return ema_of(history(x, 3 * n + 5), n)


def wilder_of(xs: Column, n: int) -> Column:
    start = total(F.slice(xs, 1, n)) / n
    return F.when(F.size(xs) >= n, F.aggregate(rest(xs, n), start, lambda s, x: (s * (n - 1) + x) / n))


def atr(n: int = 14, lookback: int | None = None) -> Column:
    """Wilder average of the true range; look-back 4n + 5 bars, whose first has no true range."""
    return wilder_of(history("tr", (lookback or 4 * n + 5) - 1), n)


def keltner(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Look-back 3n + 5 for both parts."""
    mid, band = ema(n), atr(n, 3 * n + 5)
    return {"middle": mid, "upper": mid + k * band, "lower": mid - k * band}


def with_inputs(bars: DataFrame) -> DataFrame:
    """Adds what several indicators start from: r, pc, tp, ptp, tr."""
    before = lambda c: F.lag(c).over(by_symbol())
    df = bars.withColumns({"pc": before("c"), "tp": typical()})
    return df.withColumns(
        {
            "r": ret(1), "ptp": before("tp"),
            "tr": F.when(F.col("pc").isNotNull(), F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("pc")), F.abs(F.col("l") - F.col("pc")))),
        }
    )
