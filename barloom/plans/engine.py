"""Event-driven portfolio simulation: one run is one group of a DataFrame of runs.

Orders queue and fill at the next bar's open (or at the same close); stops, costs, borrow and leverage are applied in a fixed
order. The loop is the one part that is sequential by nature, so it is Python inside a group; runs are independent, and
everything before and after (bars, calendars, measures, sweeps) stays DataFrame code.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.plans import series

LOGS_A_DAY = 50
#: By name in upper case: the days on which values became known (in order), and the values.
Macro = dict[str, tuple[np.ndarray, np.ndarray]]


@dataclass
class Costs:
    slippage_bps: float = 5.0
    commission_share: float = 0.0
    commission_pct: float = 0.0
    commission_min: float = 0.0
    borrow_pct: float = 3.0
    cash_pct: float = 0.0
    impact: float = 0.0


@dataclass
class Spec:
    cash: float = 100_000.0
    fill: str = "next_open"
    leverage: float = 1.0
    allow_short: bool = False
    fractional: bool = True
    periods: float = 252.0
    warmup: int = 0
    costs: Costs = field(default_factory=Costs)
    borrow: dict[str, float | None] = field(default_factory=dict)  # yearly per cent by symbol; None can't be borrowed
    seed: int = 42
    calendar: str = "session"
    risk_free: float = 0.0

    @classmethod
    def of(cls, options: dict) -> Spec:
        known = {f.name for f in fields(cls)} - {"costs"}
        costs = {f.name: float(options[f.name]) for f in fields(Costs) if f.name in options}
        return cls(**{k: v for k, v in options.items() if k in known}, costs=Costs(**costs))


@dataclass
class Order:
    symbol: str
    shares: float | None = None
    notional: float | None = None
    weight: float | None = None
    target: bool = False
    limit: float | None = None
    no_flip: bool = False
    reason: str = ""
    stops: dict[str, float] | None = None


@dataclass
class Position:
    shares: float
    price: float  # mean entry price
    opened: int
    peak: float
    trough: float


class Market:
    """Bars of a run's symbols on their union calendar, as matrices (days x symbols)."""

    def __init__(self, bars: pd.DataFrame) -> None:
        number = bars["day"].to_numpy() if "day" in bars else pd.to_datetime(bars["bar_date"]).to_numpy("datetime64[D]").astype(np.int64)
        self.days = np.unique(number)  # days since 1970
        self.symbols = sorted(bars["symbol"].unique())
        at = np.searchsorted(self.days, number)
        col = np.searchsorted(np.array(self.symbols), bars["symbol"].to_numpy())
        self.index = {s: i for i, s in enumerate(self.symbols)}
        self.o, self.h, self.l, self.c, self.v, self.raw = (self.matrix(at, col, bars[f].to_numpy(float)) for f in ("o", "h", "l", "c", "v", "close"))
        self.has = ~np.isnan(self.c)
        self.asof = pd.DataFrame(self.c).ffill().to_numpy()
        self.raw_asof = pd.DataFrame(self.raw).ffill().to_numpy()
        date = self.days.astype("datetime64[D]")
        self.year, self.month = (date.astype(f"datetime64[{u}]").astype(np.int64) for u in "YM")
        self.week = (self.days + 3) // 7  # Mondays begin weeks
        self.cache: dict[tuple, list[float] | dict[str, list[float]]] = {}
        extra = lambda f: pd.DataFrame(self.matrix(at, col, bars[f].to_numpy(float))).ffill().to_numpy() if f in bars else None
        self.shares, self.member = extra("shares"), extra("member")  # as known on each day
        self.names = set(self.symbols)
        self.now: list[list[float]] = self.asof.tolist()  # plain floats: the loop reads single values

    def matrix(self, at: np.ndarray, col: np.ndarray, v: np.ndarray) -> np.ndarray:
        m = np.full((len(self.days), len(self.symbols)), np.nan)
        m[at, col] = v
        return m

    def own(self, symbol: str) -> pd.DataFrame:
        """A symbol's own bars: the days on which it has one."""
        i = self.index[symbol]
        has = np.flatnonzero(self.has[:, i])
        return pd.DataFrame({f: m[has, i] for f, m in (("o", self.o), ("h", self.h), ("l", self.l), ("c", self.c), ("v", self.v))}, index=has)

    def indicator(self, symbol: str, name: str, args: tuple) -> list[float] | dict[str, list[float]]:
        """An indicator of a symbol's own bars for each day, carried forward over days on which it has none. Runs over the same bars share it."""
        key = (symbol, name, args)
        if key not in self.cache:
            own = self.own(symbol)
            if name == "volatility":
                n, periods = args
                values: series.Values = series.daily(own["c"]).rolling(n).std() * math.sqrt(periods)
            elif name in ("correlation", "beta"):
                other, n = args
                both = pd.concat([series.daily(own["c"]).rename("a"), series.daily(self.own(other)["c"]).rename("b")], axis=1).reindex(own.index)
                cov, var = both["a"].rolling(n).cov(both["b"]), both["b"].rolling(n).var()
                values = cov / var.where(var > 0) if name == "beta" else cov / (both["a"].rolling(n).std() * both["b"].rolling(n).std()).where(lambda x: x > 0)
            else:
                values = series.INDICATORS[name](own, *args)
            spread = lambda v: pd.Series(np.asarray(v, float), own.index).reindex(range(len(self.days))).ffill().tolist()
            self.cache[key] = {k: spread(v) for k, v in values.items()} if isinstance(values, dict) else spread(values)
        return self.cache[key]


class Draws:
    """A small generator of draws that are the same everywhere: a 64-bit linear congruence of which the upper 53 bits are used."""

    def __init__(self, seed: int) -> None:
        self.state = seed or 1

    def next(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % 2**64  # fixed values: Knuth's multiplier and increment
        return self.state >> 11

    def below(self, n: int) -> int:
        """From 0 to n - 1, by the high bits."""
        return 0 if n <= 1 else (((self.next() << 11) % 2**64) * n) >> 64

    def unit(self) -> float:
        return (self.next() % 2**53) / 2**53


class Context:
    """What a strategy sees on a day: nothing after it."""

    def __init__(self, market: Market, spec: Spec, params: dict, macro: Macro | None = None) -> None:
        self.market, self.spec, self.params, self.macros = market, spec, dict(params), macro or {}
        self.t = -1
        self.cash = spec.cash
        self.book: dict[str, Position] = {}
        self.pending: list[Order] = []
        self.stops: dict[str, dict[str, float]] = {}
        self.fills: list[tuple] = []
        self.fresh: list[tuple] = []
        self.state: dict = {}
        self.logs: list[str] = []
        self.logged = 0  # today
        self.random = Draws(spec.seed)
        self.paid = {"borrow": 0.0, "commission": 0.0, "slippage": 0.0}
        self.borrowed: dict[str, list[float]] = {}  # fee and days by symbol
        self.refused: list[tuple[str, float]] = []
        self.declared: dict[str, dict] = {}
        self.chosen: list[str] | None = None
        self.warned: set[str] = set()

    # -- what setup declares --

    def param(self, name: str, default=None, grid: list | None = None, low: float | None = None, high: float | None = None, step: float | None = None, description: str = ""):
        """Declare a parameter and get its value; the first declaration counts. ``grid``, or ``low``, ``high`` and ``step``, is what a search tries."""
        if not name:
            raise ValueError("a parameter needs a name")
        if name not in self.declared:
            if grid is None and None not in (low, high, step):
                from barloom.plans.search import expand

                grid = expand(low, high, step)
            self.declared[name] = {"default": default, "grid": list(grid or []), "description": description}
        return self.params.setdefault(name, default)

    def universe(self, names=None) -> list[str]:
        """The symbols that can be traded today; with ``names`` (a list or a text with commas) in setup: restricts the run to them."""
        if names is None:
            return self.symbols()
        if self.t >= 0:
            raise ValueError("the universe is set in setup")
        self.chosen = symbol_list(names)
        self.market_names = set(self.chosen)
        return self.chosen

    def warmup(self, n: int) -> None:
        """Bars before the first day; it can only be raised."""
        self.spec = replace(self.spec, warmup=max(self.spec.warmup, int(n)))

    def warn(self, key: str, text: str) -> None:
        if key not in self.warned:
            self.warned.add(key)
            self.log(text)

    # -- the day --

    @property
    def date(self) -> dt.date:
        return dt.date(1970, 1, 1) + dt.timedelta(int(self.market.days[self.t]))

    day_index = property(lambda self: self.t - self.start)
    year = property(lambda self: self.date.year)
    month = property(lambda self: self.date.month)
    day_of_month = property(lambda self: self.date.day)
    weekday = property(lambda self: self.date.isoweekday() % 7, doc="0 is Sunday.")
    starting_cash = property(lambda self: self.spec.cash)

    def every_n_days(self, n: int = 1) -> bool:
        return self.day_index % max(1, n) == 0

    # -- data --

    def price(self, s: str) -> float | None:
        i = self.market.index.get(s)
        x = math.nan if i is None else self.market.now[self.t][i]
        return None if x != x else x

    def has_data(self, s: str) -> bool:
        return self.price(s) is not None

    def symbols(self) -> list[str]:
        """What has a price and, where bars tell membership, is a member today."""
        found = [s for s, x in zip(self.market.symbols, self.market.now[self.t]) if x == x]
        if self.chosen is not None:
            found = [s for s in found if s in self.market_names]
        if self.market.member is not None:
            found = [s for s in found if self.market.member[self.t, self.market.index[s]] == 1]
        return found

    def last_bar(self, s: str) -> int | None:
        """Number of the last day up to today on which the symbol has a bar."""
        i = self.market.index.get(s)
        if i is None:
            return None
        has = np.flatnonzero(self.market.has[: self.t + 1, i])
        return int(has[-1]) if len(has) else None

    def field(self, s: str, matrix: np.ndarray) -> float | None:
        t = self.last_bar(s)
        return None if t is None else float(matrix[t, self.market.index[s]])

    def raw_price(self, s: str) -> float | None:
        return self.field(s, self.market.raw)

    def open(self, s: str) -> float | None:
        return self.field(s, self.market.o)

    def high(self, s: str) -> float | None:
        return self.field(s, self.market.h)

    def low(self, s: str) -> float | None:
        return self.field(s, self.market.l)

    def volume(self, s: str) -> float | None:
        """As it was traded: adjusted volume by the split factor."""
        t = self.last_bar(s)
        if t is None:
            return None
        i, m = self.market.index[s], self.market
        return float(m.v[t, i] * (m.c[t, i] / m.raw[t, i] if m.raw[t, i] else 1.0))

    def bar(self, s: str) -> dict | None:
        """The last bar as it was traded, with its adjusted close."""
        t = self.last_bar(s)
        if t is None:
            return None
        i, m = self.market.index[s], self.market
        factor = m.raw[t, i] / m.c[t, i] if m.c[t, i] else 1.0
        return {"date": dt.date(1970, 1, 1) + dt.timedelta(int(m.days[t])), "open": m.o[t, i] * factor, "high": m.h[t, i] * factor, "low": m.l[t, i] * factor, "close": m.raw[t, i], "adj_close": m.c[t, i], "volume": m.v[t, i] / factor}

    def history(self, s: str, n: int = 20) -> list[dict]:
        """The latest n adjusted bars, oldest first."""
        i, m = self.market.index.get(s), self.market
        if i is None:
            return []
        at = np.flatnonzero(m.has[: self.t + 1, i])[-max(1, n) :]
        return [{"day": int(m.days[t]), "open": m.o[t, i], "high": m.h[t, i], "low": m.l[t, i], "close": m.c[t, i], "volume": m.v[t, i]} for t in at]

    def resample(self, s: str, size: str, n: int = 50) -> list[dict]:
        """The latest n bars of a week (``1wk``) or month (``1mo``), the one of today as it stands so far; other sizes are no coarser than a day."""
        unit = {"1wk": "W", "1mo": "M"}.get(size)
        if unit is None:
            return self.history(s, n)
        out: list[dict] = []
        # enough daily bars for n whole ones and the parts at both ends
        for b in self.history(s, int((n + 2) * (5 if unit == "W" else 21)) + 2):
            bucket = (b["day"] + 3) // 7 if unit == "W" else int(np.datetime64(b["day"], "D").astype("datetime64[M]").astype(int))
            if not out or out[-1]["bucket"] != bucket:
                out.append({"bucket": bucket, **b})
            else:
                last = out[-1]
                last.update(high=max(last["high"], b["high"]), low=min(x for x in (last["low"], b["low"]) if x) if last["low"] or b["low"] else 0.0, close=b["close"], volume=last["volume"] + b["volume"])
        return out[-n:]

    def resampled_closes(self, s: str, size: str, n: int = 50) -> list[float]:
        return [b["close"] for b in self.resample(s, size, n)]

    def macro(self, name: str, days_ago: int = 0) -> float | None:
        """An economic series as it was published by today (or so many days before); None before its first value, or where there is none."""
        found = self.macros.get(name.strip().upper())
        if found is None:
            self.warn(f"macro-{name}", f"there is no series {name}")
            return None
        known, values = found
        k = int(np.searchsorted(known, self.market.days[self.t] - days_ago, side="right")) - 1
        return float(values[k]) if k >= 0 else None

    def macro_change(self, name: str, days: int = 365) -> float | None:
        now, then = self.macro(name), self.macro(name, days)
        return now / then - 1 if now is not None and then else None

    def market_cap(self, s: str) -> float | None:
        """Shares known on the day times the last raw close, where bars tell shares."""
        i = self.market.index.get(s)
        if i is None or self.market.shares is None:
            return None
        x = self.market.shares[self.t, i] * self.market.raw_asof[self.t, i]
        return None if x != x else float(x)

    def by_market_cap(self) -> list[str]:
        """Symbols with a price today, the largest first, whether members or not."""
        priced = [s for s, x in zip(self.market.symbols, self.market.now[self.t]) if x == x]
        valued = [(self.market_cap(s), s) for s in priced]
        return [s for x, s in sorted(valued, key=lambda v: (-(v[0] or 0.0), v[1])) if x is not None]

    def top_by_market_cap(self, n: int = 1) -> list[str]:
        return self.by_market_cap()[: max(1, n)]

    def biggest_company(self) -> str | None:
        return next(iter(self.by_market_cap()), None)

    def market_cap_rank(self, s: str) -> int | None:
        ranked = self.by_market_cap()
        return ranked.index(s) + 1 if s in ranked else None

    def indicator(self, name: str, s: str, *args):
        """Any indicator of :mod:`barloom.plans.series` as of today: a number, or a dict of numbers, None where undefined. Also as ``ctx.<name>(symbol, …)``."""
        known = self.market.cache.get((s, name, args))
        if known is None:
            if s not in self.market.index:
                return None
            known = self.market.indicator(s, name, args)
        if isinstance(known, dict):
            return {k: None if v[self.t] != v[self.t] else v[self.t] for k, v in known.items()}
        x = known[self.t]
        return None if x != x else x

    def __getattr__(self, name: str):
        if name in series.INDICATORS:
            return lambda s, *args: self.indicator(name, s, *args)
        raise AttributeError(name)

    def sma(self, s: str, n: int = 20) -> float | None:
        return self.indicator("sma", s, n)

    def volatility(self, s: str, n: int = 20) -> float | None:
        return self.indicator("volatility", s, n, self.spec.periods)

    def correlation(self, a: str, b: str, n: int = 60) -> float | None:
        return self.indicator("correlation", a, b, n) if b in self.market.index else None

    def beta(self, s: str, benchmark: str, n: int = 60) -> float | None:
        return self.indicator("beta", s, benchmark, n) if benchmark in self.market.index else None

    def optimize(self, symbols: Iterable[str], objective: str = "min_variance", lookback: int = 252, most: float | None = None, long_only: bool = True, shrinkage: float | None = None) -> dict[str, float]:
        """Weights of the symbols that have a whole look-back of returns."""
        from barloom.operators.construct import weights

        kept = {s: c for s in dict.fromkeys(symbols) if s in self.market.index and len(c := self.closes(s, lookback + 1)) == lookback + 1}
        if not kept:
            return {}
        x = np.stack([c[1:] / c[:-1] - 1 for c in kept.values()], axis=1)
        return dict(zip(kept, map(float, weights(x, objective, long_only, most, shrinkage))))

    def closes(self, s: str, n: int) -> np.ndarray:
        c = self.market.c[: self.t + 1, self.market.index[s]]
        return c[~np.isnan(c)][-n:]

    METRICS = {
        "marketcap": lambda self, s, n: self.market_cap(s), "momentum": lambda self, s, n: self.indicator("momentum", s, n), "volatility": lambda self, s, n: self.volatility(s, n), "rsi": lambda self, s, n: self.indicator("rsi", s, n),
        "volume": lambda self, s, n: self.dollar_volume(s), "price": lambda self, s, n: self.price(s), "drawdown": lambda self, s, n: self.indicator("drawdown", s, n),
    }
    ALIASES = {"market_cap": "marketcap", "cap": "marketcap", "size": "marketcap", "return": "momentum", "performance": "momentum", "ret": "momentum", "vol": "volatility", "dollarvolume": "volume"}

    def dollar_volume(self, s: str) -> float | None:
        v, c = self.volume(s), self.raw_price(s)
        return None if v is None or c is None else v * c

    def rank(self, metric: str | Callable[[str], float | None], n: int = 0, ascending: bool = False, window: int = 20) -> list[str]:
        """Symbols by a metric, a name (unknown ones are momentum) or a function of the symbol; without a finite value a symbol isn't ranked."""
        if isinstance(metric, str):
            name = metric.strip().lower()
            of = self.METRICS.get(self.ALIASES.get(name, name), self.METRICS["momentum"])
            metric = lambda s: of(self, s, window)
        scored = [(x, s) for s in self.symbols() if (x := metric(s)) is not None and math.isfinite(x)]
        scored.sort(key=lambda p: (p[0] if ascending else -p[0], p[1]))
        return [s for _, s in scored][: n or None]

    def first_of(self, period: str) -> bool:
        x = getattr(self.market, period)
        return self.t == self.start or x[self.t] != x[self.t - 1]

    def last_of(self, period: str) -> bool:
        x = getattr(self.market, period)
        return self.t == len(x) - 1 or x[self.t] != x[self.t + 1]

    # -- book --

    def shares(self, s: str) -> float:
        return self.book[s].shares if s in self.book else 0.0

    def equity(self) -> float:
        return self.cash + sum(self.book[s].shares * (self.price(s) or self.book[s].price) for s in sorted(self.book))

    def gross(self) -> float:
        return sum(abs(self.book[s].shares) * (self.price(s) or self.book[s].price) for s in sorted(self.book))

    def gain(self, s: str) -> float | None:
        p, x = self.book.get(s), self.price(s)
        return None if p is None or x is None or not p.price else (x / p.price - 1) * (1 if p.shares > 0 else -1)

    def exposure(self) -> float:
        e = self.equity()
        return self.gross() / e if e else 0.0

    def weight(self, s: str) -> float:
        e, x = self.equity(), self.price(s)
        return self.book[s].shares * x / e if s in self.book and e and x is not None else 0.0

    def entry_price(self, s: str) -> float | None:
        return self.book[s].price if s in self.book else None

    def days_held(self, s: str) -> int:
        """Calendar days since the position was opened."""
        return int(self.market.days[self.t] - self.market.days[self.book[s].opened]) if s in self.book else 0

    def position(self, s: str) -> dict | None:
        p = self.book.get(s)
        if p is None:
            return None
        x = self.price(s) or p.price
        return {
            "symbol": s, "shares": p.shares, "price": x, "entry_price": p.price, "value": p.shares * x, "weight": self.weight(s), "unrealised": (x - p.price) * p.shares, "gain": self.gain(s), "days_held": self.days_held(s), "short": p.shares < 0,
            "opened": dt.date(1970, 1, 1) + dt.timedelta(int(self.market.days[p.opened])),
        }

    def positions(self) -> dict[str, dict]:
        return {s: self.position(s) for s in sorted(self.book)}

    def held(self) -> list[str]:
        return sorted(self.book)

    # -- orders --

    def order(self, symbol: str, **kw) -> None:
        self.pending.append(Order(symbol, **kw))

    SIZES = {"notional": "notional", "amount": "notional", "dollars": "notional", "usd": "notional", "shares": "shares", "weight": "weight", "target_weight": "weight", "pct_cash": "cash", "percent_of_cash": "cash", "pct_equity": "equity", "percent_of_equity": "equity"}

    def sized(self, sign: int, notional: float | None, kw: dict) -> dict | None:
        """The size of an order in any of its spellings (a weight is the target); None without any."""
        named = {self.SIZES[k]: kw.pop(k) for k in list(kw) if k in self.SIZES}
        if notional is not None:
            named.setdefault("notional", notional)
        of = {"cash": self.cash, "equity": self.equity()} if named.keys() & {"cash", "equity"} else {}
        for kind in ("shares", "notional", "weight", "cash", "equity"):
            if named.get(kind) is not None:
                x = sign * abs(float(named[kind]))
                return {"weight": x, "target": True} if kind == "weight" else {"notional": x * of[kind]} if kind in of else {kind: x}
        return None

    def buy(self, s: str, notional: float | None = None, **kw) -> None:
        """Without a size: all cash."""
        size = self.sized(1, notional, kw)
        self.order(s, **(size or {"notional": self.cash}), **kw)

    def sell(self, s: str, notional: float | None = None, **kw) -> None:
        """Without a size: the whole position."""
        size = self.sized(-1, notional, kw)
        if size is None:
            self.close(s, **kw)
        else:
            self.order(s, **size, **kw)

    def short(self, s: str, notional: float | None = None, **kw) -> None:
        """Without a size: as much as the equity."""
        size = self.sized(-1, notional, kw)
        self.order(s, **(size or {"notional": -self.equity()}), **kw)

    def cover(self, s: str, notional: float | None = None, **kw) -> None:
        """Buys back what is short, never more."""
        size = self.sized(1, notional, kw)
        self.order(s, **(size or {"shares": max(0.0, -self.shares(s))}), no_flip=True, **kw)

    def close(self, s: str, **kw) -> None:
        self.stops.pop(s, None)
        self.order(s, weight=0.0, target=True, **kw)

    def set_weight(self, s: str, w: float, **kw) -> None:
        self.order(s, weight=w, target=True, **kw)

    def rebalance(self, targets: dict[str, float], **kw) -> None:
        for s in sorted(targets):
            self.set_weight(s, targets[s], **kw)
        for s in sorted(self.book):
            if s not in targets:
                self.close(s, **kw)

    def equal_weight(self, symbols: Iterable[str], gross: float = 1.0, **kw) -> None:
        names = sorted(set(symbols))
        self.rebalance({s: gross / len(names) for s in names}, **kw)

    def liquidate(self, **kw) -> None:
        for s in sorted(self.book):
            self.close(s, **kw)

    def clear_stops(self, s: str) -> None:
        self.stops.pop(s, None)

    def stop(self, s: str, **levels: float) -> None:
        """loss, profit, trailing: shares of the price."""
        self.stops.setdefault(s, {}).update(levels)

    def log(self, text: str) -> None:
        """A line of the run's record; of one day the first LOGS_A_DAY are kept."""
        if self.logged < LOGS_A_DAY:
            self.logged += 1
            self.logs.append(f"{np.datetime64(int(self.market.days[self.t]), 'D')} {text}" if self.t >= 0 else text)

    # -- execution --

    def delta(self, o: Order, price: float, equity: float) -> float:
        held = self.shares(o.symbol)
        if o.weight is not None:
            q = o.weight * equity / price - (held if o.target else 0.0)
        elif o.notional is not None:
            q = o.notional / price
        else:
            q = o.shares or 0.0
        if o.no_flip and held * (held + q) < 0:
            q = -held
        return q

    def reduces(self, o: Order) -> bool:
        held = self.shares(o.symbol)
        way = o.weight * 1e9 - held if o.weight is not None and o.target else (o.weight or o.notional or o.shares or 0.0)
        return held * way < 0

    def execute(self, orders: list[Order], prices: np.ndarray) -> None:
        equity = self.equity()
        for o in sorted(orders, key=lambda o: not self.reduces(o)):
            i = self.market.index.get(o.symbol)
            price = float(prices[i]) if i is not None and not np.isnan(prices[i]) else self.price(o.symbol)
            if not price:
                continue
            q = self.delta(o, price, equity)
            if o.limit is not None and (price > o.limit if q > 0 else price < o.limit):
                continue
            self.trade(o.symbol, q, price, o.reason, equity)
            if o.stops and o.symbol in self.book:
                self.stop(o.symbol, **o.stops)

    def affordable(self, s: str, q: float, price: float, equity: float) -> float:
        """Enlarging trades are cut to the cash (or to the leverage there is), slippage and commission included."""
        held, c = self.shares(s), self.spec.costs
        grow = q if held * q >= 0 else q + held
        if grow * q <= 0:
            return q
        unit = price * (1 + c.slippage_bps / 1e4) * (1 + c.commission_pct / 100) + c.commission_share
        room = self.cash if q > 0 and self.spec.leverage <= 1 else equity * self.spec.leverage - self.gross()
        if q > 0 and self.spec.leverage <= 1 and held < 0:
            room -= -held * unit
        most = max(0.0, (room - c.commission_min) / unit)
        if abs(grow) <= most:
            return q
        return q - grow + math.copysign(most, grow)

    def trade(self, s: str, q: float, price: float, reason: str, equity: float) -> bool:
        held, c = self.shares(s), self.spec.costs
        if not self.spec.allow_short and held + q < 0:
            q = -max(held, 0.0)
        if held + q < min(held, 0.0) and self.spec.borrow.get(s, 0.0) is None:  # no shares to borrow
            self.refused.append((s, -(held + q) + min(held, 0.0)))
            q = -max(held, 0.0)
        q = self.affordable(s, q, price, equity)
        if not self.spec.fractional:
            q = float(math.trunc(q + math.copysign(1e-9, q)))
        if abs(q) < 1e-9:
            return False
        worse = c.slippage_bps / 1e4 + self.impact(s, q)
        paid = price * (1 + math.copysign(worse, q))
        fee = max(abs(q) * c.commission_share + abs(q) * paid * c.commission_pct / 100, c.commission_min)
        realised, p = 0.0, self.book.get(s)
        closed = min(abs(q), abs(held)) if held * q < 0 else 0.0
        if closed and p:
            realised = closed * (paid - p.price) * (1 if held > 0 else -1)
        side = ("buy" if held >= 0 else "cover") if q > 0 else ("sell" if held > 0 else "short")
        after = held + q
        if abs(after) < 1e-9:
            self.book.pop(s, None)
        elif p is None or held * after < 0:
            self.book[s] = Position(after, paid, self.t, paid, paid)
        else:
            if held * q > 0:
                p.price = (abs(held) * p.price + abs(q) * paid) / abs(after)
            p.shares = after
        self.cash -= q * paid + fee
        self.paid["commission"] += fee
        self.paid["slippage"] += abs(q) * price * worse
        fill = (self.t, s, side, q, paid, fee, abs(q) * price * worse, realised, reason)
        self.fills.append(fill)
        self.fresh.append(fill)
        return True

    def impact(self, s: str, q: float) -> float:
        """Square-root impact on the mean volume and volatility of 20 bars; at most a half."""
        k = self.spec.costs.impact
        if not k:
            return 0.0
        i = self.market.index[s]
        volume = self.market.v[max(0, self.t - 19) : self.t + 1, i]
        adv, vol = np.nanmean(volume) if (~np.isnan(volume)).any() else 0.0, self.volatility(s, 20)
        return min(0.5, k * (vol or 0.0) / math.sqrt(self.spec.periods) * math.sqrt(abs(q) / adv)) if adv else 0.0

    def run_stops(self) -> list[tuple]:
        """Loss before profit before trailing, at the level, symbols in order; a stop outlives its own trigger."""
        hit = []
        for s in sorted(self.stops):
            p, i = self.book.get(s), self.market.index.get(s)
            if p is None or i is None or not self.market.has[self.t, i]:
                continue
            up, levels = p.shares > 0, self.stops[s]
            high, low = self.market.h[self.t, i], self.market.l[self.t, i]
            sign = 1 if up else -1
            tests = []
            if "loss" in levels:
                tests.append(("loss", p.price * (1 - sign * levels["loss"]), False))
            if "profit" in levels:
                tests.append(("profit", p.price * (1 + sign * levels["profit"]), True))
            if "trailing" in levels:
                tests.append(("trailing", p.peak * (1 - levels["trailing"]) if up else p.trough * (1 + levels["trailing"]), False))
            for kind, level, gain in tests:
                if (high >= level if up == gain else low <= level):
                    if self.trade(s, -p.shares, float(level), f"stop {kind}", self.equity()):
                        hit.append((s, kind, level))
                    break
        return hit

    def finance(self) -> None:
        c, periods = self.spec.costs, self.spec.periods
        for s in sorted(self.book):
            p = self.book[s]
            if p.shares < 0:
                rate = self.spec.borrow.get(s, c.borrow_pct)
                fee = -p.shares * (self.price(s) or p.price) * (c.borrow_pct if rate is None else rate) / 100 / periods
                self.cash -= fee
                self.paid["borrow"] += fee
                own = self.borrowed.setdefault(s, [0.0, 0.0])
                own[0] += fee
                own[1] += 1
        if self.cash > 0 and c.cash_pct:
            self.cash += self.cash * c.cash_pct / 100 / periods

    def mark(self) -> None:
        for s, p in self.book.items():
            x = self.price(s)
            if x is not None:
                p.peak, p.trough = max(p.peak, x), min(p.trough, x)


def symbol_list(names) -> list[str]:
    """Symbols of a list or a text with commas or blanks, trimmed, upper case, once each in order."""
    parts = names.replace(",", " ").split() if isinstance(names, str) else [str(n) for n in names]
    return list(dict.fromkeys(p.strip().upper() for p in parts if p.strip()))


class Strategy:
    """setup is called once, on_day on every bar from the start on; the other hooks are optional."""

    def setup(self, ctx: Context) -> None: ...

    def on_day(self, ctx: Context) -> None: ...

    def on_week(self, ctx: Context) -> None: ...

    def on_month(self, ctx: Context) -> None: ...

    def on_fill(self, ctx: Context, fill: tuple) -> None: ...

    def on_stop(self, ctx: Context, symbol: str, kind: str) -> None: ...


def declared(strategy: Strategy, params: dict | None = None) -> tuple[dict[str, dict], int]:
    """What a strategy's setup declares, without any data: parameters with default, grid and description, and the warm-up."""
    none = pd.DataFrame({k: pd.Series(dtype=t) for k, t in (("day", "int64"), ("symbol", "object"), *((f, "float64") for f in ("o", "h", "l", "c", "v", "close")))})
    ctx = Context(Market(none), Spec(), params or {})
    strategy.setup(ctx)
    return ctx.declared, ctx.spec.warmup


def simulate(bars: pd.DataFrame | Market, strategy: Strategy, spec: Spec, params: dict, start=None, end=None, macro: Macro | None = None) -> dict:
    """One run. ``bars``: symbol, bar_date, o, h, l, c, v, close, perhaps shares (known on the day) and member (0 or 1), or a :class:`Market` of them that
    runs share. The simulation begins at ``start`` and after the warm-up's bars; bars before serve the look-backs only."""
    market = bars if isinstance(bars, Market) else Market(bars)
    ctx = Context(market, spec, params, macro)
    strategy.setup(ctx)
    spec = ctx.spec
    number = lambda d: np.datetime64(d, "D").astype(np.int64)
    first = int(np.searchsorted(market.days, number(start))) if start is not None else 0
    last = int(np.searchsorted(market.days, number(end), side="right")) if end is not None else len(market.days)
    ctx.start = max(first, ctx.spec.warmup)
    months, weeks = (np.r_[True, np.diff(x) != 0].tolist() for x in (market.month, market.week))
    curve, errors = [], 0
    for t in range(ctx.start, last):
        ctx.t, ctx.fresh, ctx.logged = t, [], 0
        hits: list[tuple] = []
        queued, ctx.pending = ctx.pending, []
        if spec.fill == "next_open":
            hits += ctx.run_stops() if ctx.stops else []
            if queued:
                ctx.execute(queued, market.o[t])
        if ctx.book or spec.costs.cash_pct:
            ctx.finance()
            ctx.mark()
        try:
            if months[t] or t == ctx.start:
                strategy.on_month(ctx)
            if weeks[t] or t == ctx.start:
                strategy.on_week(ctx)
            strategy.on_day(ctx)
        except Exception as e:  # a strategy's error is part of the record of the run
            errors += 1
            ctx.log(f"{type(e).__name__}: {e}")
        if spec.fill == "close":
            queued, ctx.pending = ctx.pending, []
            ctx.execute(queued, market.asof[t])
            hits += ctx.run_stops()
        for s, kind, _ in hits:
            strategy.on_stop(ctx, s, kind)
        for fill in ctx.fresh:
            strategy.on_fill(ctx, fill)
        if ctx.book:
            value = ctx.equity()
            curve.append((t, value, ctx.cash, ctx.gross() / value if value else 0.0))
        else:
            curve.append((t, ctx.cash, ctx.cash, 0.0))
    path = np.array(curve).reshape(-1, 4)
    return {"days": market.days[path[:, 0].astype(int)], "value": path[:, 1], "cash": path[:, 2], "exposure": path[:, 3], "fills": [(int(market.days[f[0]]), *f[1:]) for f in ctx.fills], "errors": errors, "logs": ctx.logs, **ctx.paid, "refused": len(ctx.refused), "borrowed": [(s, *ctx.borrowed[s]) for s in sorted(ctx.borrowed)], "refusals": ctx.refused}


MEASURES = ("bars", "total_return", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "ulcer", "trades", "expectancy", "trade_win_rate", "profit_factor")


def round_trip_results(fills: list[tuple]) -> list[float]:
    """Net results of the closed round trips of a run's fills, first in, first out, with the costs of both sides by shares."""
    lots: dict[str, deque] = {}
    out = []
    for _, symbol, _, q, price, fee, slip, *_ in fills:
        own, unit = lots.setdefault(symbol, deque()), (fee + slip) / abs(q) if q else 0.0
        while abs(q) > 1e-9:
            if not own or own[0][0] * q > 0:
                own.append([q, price, unit])
                break
            lot = own[0]
            sign, n = (1 if lot[0] > 0 else -1), min(abs(q), abs(lot[0]))
            out.append(sign * (price - lot[1]) * n - n * (lot[2] + unit))
            lot[0] -= sign * n
            q += sign * n
            if abs(lot[0]) <= 1e-9:
                own.popleft()
    return out


def measures(run: dict, periods: float) -> dict:
    """MEASURES of one run, as :mod:`barloom.operators.performance` defines them; None where undefined."""
    v, n = run["value"], len(run["value"])
    out: dict = dict.fromkeys(MEASURES)
    results = np.array(round_trip_results(run["fills"]))
    out.update(bars=n, trades=len(results))
    if len(results):
        won, lost = results[results > 0].sum(), -results[results <= 0].sum()
        out.update(expectancy=float(results.mean()), trade_win_rate=float((results > 0).mean()), profit_factor=float(won / lost) if lost > 0 else math.inf if won > 0 else None)
    if not n:
        return out
    peak = np.maximum.accumulate(v)
    dd = np.where(peak != 0, v / np.where(peak != 0, peak, 1) - 1, 0.0)
    before = v[:-1]
    r = np.where(before > 0, v[1:] / np.where(before > 0, before, 1) - 1, 0.0)
    years = (run["days"][-1] - run["days"][0]) / 365.25
    out.update(max_drawdown=float(dd.min()), ulcer=float(np.sqrt((dd * dd).mean())), total_return=float(v[-1] / v[0] - 1) if v[0] else None)
    if v[0] > 0 and v[-1] > 0 and years > 0:
        out["cagr"] = float((v[-1] / v[0]) ** (1 / years) - 1)
        out["calmar"] = out["cagr"] / abs(out["max_drawdown"]) if out["max_drawdown"] else None
    if len(r) > 1:
        sd, down = float(r.std(ddof=1)), r[r < 0]
        out["volatility"] = sd * math.sqrt(periods)
        out["sharpe"] = float(r.mean()) / sd * math.sqrt(periods) if sd else None
    else:
        down = r[r < 0]
    if len(down):
        out["sortino"] = float(r.mean() / math.sqrt((down * down).mean()) * math.sqrt(periods))
    return out


RUN = (
    "run_id string, days array<int>, value array<double>, cash array<double>, exposure array<double>, "
    "fills array<struct<day:int,symbol:string,side:string,shares:double,price:double,commission:double,slippage:double,realised:double,reason:string>>, "
    "errors long, borrow double, commission double, slippage double, refused long, logs array<string>, "
    "borrowed array<struct<symbol:string,fee:double,days:double>>, refusals array<struct<symbol:string,shares:double>>, error string"
)
RUNS_A_TASK = 64  # runs that share one copy of their universe's bars
MOST_MACRO = 1_000_000


def macros_of(macro: DataFrame | None) -> Macro:
    """Economic series by name: days on which values became known, and the values. They are sent to every task, so there may be MOST_MACRO rows at most."""
    if macro is None:
        return {}
    known = macro.select(F.upper(F.trim("series")).alias("series"), (F.unix_date("day") + F.coalesce(F.col("lag_days"), F.lit(30))).alias("known"), F.col("value").cast("double").alias("value"))
    rows = known.where("series is not null and known is not null and value is not null").limit(MOST_MACRO + 1).toPandas()
    if len(rows) > MOST_MACRO:
        raise ValueError(f"over {MOST_MACRO} rows of economic series")
    return {k: (g["known"].to_numpy(np.int64), g["value"].to_numpy(float)) for k, g in rows.sort_values("known", kind="stable").groupby("series")}


def measured_runs(bars: DataFrame, runs: DataFrame, macro: DataFrame | None = None, strategies: dict[str, type[Strategy]] | None = None, per_task: int = RUNS_A_TASK) -> DataFrame:
    """Like :func:`backtests`, but with MEASURES of each run in place of its curve and fills, which never leave the task: for searches."""
    return backtests(bars, runs, macro, strategies, per_task, curves_too=False)


def backtests(bars: DataFrame, runs: DataFrame, macro: DataFrame | None = None, strategies: dict[str, type[Strategy]] | None = None, per_task: int = RUNS_A_TASK, curves_too: bool = True) -> DataFrame:
    """Simulate all ``runs``: one row per run with its curve and fills.

    ``runs``: run_id, strategy (a name of :mod:`barloom.plans.strategies`, or of ``strategies``), symbols (array), params (JSON), options (JSON of
    :class:`Spec`), start, end (dates or null). ``bars``: adjusted, with raw close, perhaps shares and member. ``macro``: series, day, value,
    lag_days (30 where null). A run without bars has an empty curve; one that fails has an error and an empty curve.

    Runs over one universe share its bars: a task gets one copy of them and up to ``per_task`` runs, which share matrices and indicators. So R runs over
    U universes shuffle U copies of bars and one more for each ``per_task`` runs, not R. A task holds one universe at a time.
    """
    from barloom.plans.strategies import STRATEGIES

    known, series_of = {**STRATEGIES, **(strategies or {})}, macros_of(macro)
    r = runs.withColumn("symbols", F.array_sort(F.array_distinct("symbols"))).withColumn("universe", F.sha2(F.concat_ws(",", "symbols"), 256))
    sizes = r.groupBy("universe").agg(F.ceil(F.count("*") / per_task).alias("chunks"))
    r = r.join(sizes, "universe").withColumn("task", F.concat_ws("#", "universe", F.pmod(F.xxhash64("run_id"), F.col("chunks")).cast("string"))).drop("universe", "chunks")
    extra = [c for c in ("shares", "member") if c in bars.columns]
    wanted = r.groupBy("task").agg(F.first("symbols").alias("symbols")).select(F.col("task").alias("of_task"), F.explode("symbols").alias("symbol"))
    fed = wanted.join(bars.select("symbol", F.unix_date("bar_date").alias("day"), *"ohlcv", "close", *(F.col(c).cast("double").alias(c) for c in extra)), "symbol")
    names = [c.split()[0] for c in ("run_id", "days", "value", "cash", "exposure", "fills", "errors", "borrow", "commission", "slippage", "refused", "logs", "borrowed", "refusals")]
    nothing = {k: [] for k in ("days", "value", "cash", "exposure", "fills", "logs", "borrowed", "refusals")}

    def some(group: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        market, out = Market(pdf), []
        day = lambda x: None if x is None or pd.isna(x) else x
        for h in group.to_dict("records"):
            try:
                params, options = json.loads(h["params"] or "{}"), json.loads(h["options"] or "{}")
                spec = Spec.of(options)
                r = simulate(market, known[h["strategy"]](), spec, params, day(h["start"]), day(h["end"]), series_of)
                out.append({"run_id": h["run_id"], **({k: r[k] for k in names[1:]} if curves_too else measures(r, spec.periods)), "error": None})
            except Exception as e:  # a run that fails is a row of the result, the others go on
                out.append({"run_id": h["run_id"], **dict.fromkeys(MEASURES), "error": f"{type(e).__name__}: {e}"[:300]} if not curves_too else {"run_id": h["run_id"], **nothing, "errors": 1, "borrow": 0.0, "commission": 0.0, "slippage": 0.0, "refused": 0, "error": f"{type(e).__name__}: {e}"[:300]})
        if curves_too:
            return pd.DataFrame(out, columns=[*names, "error"])
        rows = pd.DataFrame(out, columns=["run_id", *MEASURES, "error"])
        return rows.astype({k: "Int64" if k in ("bars", "trades") else "Float64" for k in MEASURES})

    schema = RUN if curves_too else "run_id string, " + ", ".join(f"{k} {'long' if k in ('bars', 'trades') else 'double'}" for k in MEASURES) + ", error string"
    # simulation costs time, not bytes: the number of parts is given, else a plan that adapts to bytes would put all runs into one task
    spark = runs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return r.repartition(parts, "task").groupBy("task").cogroup(fed.repartition(parts, "of_task").groupBy("of_task")).applyInPandas(some, schema)


def curves(results: DataFrame) -> DataFrame:
    days = F.transform("days", lambda d: F.date_from_unix_date(d))
    return results.select("run_id", F.inline(F.arrays_zip(days.alias("bar_date"), "value", "cash", "exposure")))


def fills(results: DataFrame) -> DataFrame:
    """With seq, the order of execution inside a run."""
    rows = results.select("run_id", F.posexplode("fills").alias("seq", "f")).select("run_id", "seq", "f.*")
    return rows.withColumn("bar_date", F.date_from_unix_date("day")).drop("day")


def positions(results: DataFrame, bars: DataFrame) -> DataFrame:
    """The book at the close of each day of each run: run_id, bar_date, symbol, shares, price, value, weight. ``bars``: symbol, bar_date, c.

    Put together from fills: a run's days are laid out for the symbols it traded, and shares and prices carried along by as-of joins.
    """
    from barloom.operators.bars import asof

    f = fills(results)
    w = W.partitionBy("run_id", "symbol").orderBy("seq")
    after = f.select("run_id", "symbol", "bar_date", F.round(F.sum("shares").over(w), 6).alias("shares"), "seq")
    last = after.groupBy("run_id", "symbol", "bar_date").agg(F.max_by("shares", "seq").alias("shares"))
    days = curves(results).select("run_id", "bar_date", F.col("value").alias("equity"))
    grid = days.join(last.select("run_id", "symbol").distinct(), "run_id")
    held = asof(grid, last, ["run_id", "symbol"], "bar_date", ["shares"]).where("shares != 0")
    priced = asof(held, bars.select("symbol", "bar_date", F.col("c").alias("price")), ["symbol"], "bar_date", ["price"])
    value = F.col("shares") * F.col("price")
    return priced.select("run_id", "bar_date", "symbol", "shares", "price", value.alias("value"), (value / F.when(F.col("equity") != 0, F.col("equity"))).alias("weight"))


def faults_of(strategy: type) -> list[str]:
    """What keeps a class from being a strategy: no on_day or other hook of its own, or a setup that fails without data."""
    out = []
    if not (isinstance(strategy, type) and issubclass(strategy, Strategy)):
        return ["it isn't a Strategy"]
    if all(getattr(strategy, h) is getattr(Strategy, h) for h in ("on_day", "on_week", "on_month")):
        out.append("it does nothing on any day")
    try:
        declared(strategy())
    except Exception as e:  # whatever it is, it is the strategy's
        out.append(f"setup fails: {type(e).__name__}: {e}")
    return out
