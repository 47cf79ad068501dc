"""Strategies that come with the library."""

from __future__ import annotations

import numpy as np

from barloom.plans.engine import Context, Strategy


class GoldenCross(Strategy):
    """In while the fast average is above the slow one; an optional trailing stop."""

    def on_day(self, ctx: Context) -> None:
        p = ctx.params
        for s in ctx.symbols():
            fast, slow = ctx.sma(s, int(p.get("fast", 20))), ctx.sma(s, int(p.get("slow", 50)))
            if fast is None or slow is None:
                continue
            if fast > slow and not ctx.shares(s):
                ctx.set_weight(s, 1 / len(ctx.market.symbols), reason="fast above slow", stops={"trailing": p["trail"]} if p.get("trail") else None)
            elif fast < slow and ctx.shares(s):
                ctx.close(s, reason="fast below slow")


class MeanReversion(Strategy):
    """Buys what is oversold by RSI and sells it when it is back."""

    def on_day(self, ctx: Context) -> None:
        p = ctx.params
        for s in ctx.symbols():
            x = ctx.rsi(s, int(p.get("n", 14)))
            if x is None:
                continue
            if x < p.get("low", 30) and not ctx.shares(s):
                ctx.set_weight(s, p.get("weight", 0.9) / len(ctx.market.symbols), reason="oversold", stops={"loss": p.get("loss", 0.1)})
            elif x > p.get("high", 55) and ctx.shares(s):
                ctx.close(s, reason="recovered")


class MomentumRotation(Strategy):
    """Each month the strongest names in equal weights."""

    def on_month(self, ctx: Context) -> None:
        best = ctx.rank(lambda s: ctx.momentum(s, int(ctx.params.get("n", 60))), int(ctx.params.get("top", 3)))
        if best:
            ctx.equal_weight(best, reason="strongest")


class SixtyForty(Strategy):
    """Fixed weights in the first two symbols, set anew each quarter."""

    def on_month(self, ctx: Context) -> None:
        names = ctx.symbols()[:2]
        if len(names) == 2 and (ctx.market.month[ctx.t] % 3 == 1 or not ctx.book):
            ctx.rebalance(dict(zip(names, (0.6, 0.4))), reason="quarter")


class DailyReversal(Strategy):
    """Yesterday's losers in equal weights, for some days."""

    def on_day(self, ctx: Context) -> None:
        if (ctx.t - ctx.start) % int(ctx.params.get("hold", 1)) == 0:
            worst = ctx.rank(lambda s: ctx.momentum(s, 1), int(ctx.params.get("top", 2)), ascending=True)
            if worst:
                ctx.equal_weight(worst, reason="loser")


class PairsTrade(Strategy):
    """Long and short the ratio of two symbols when it is far from its mean."""

    def on_day(self, ctx: Context) -> None:
        names, n = ctx.market.symbols[:2], int(ctx.params.get("n", 40))
        if len(names) < 2:
            return
        a, b = (ctx.closes(s, n) for s in names)
        if len(a) < n or len(b) < n:
            return
        ratio = np.log(a / b)
        z = (ratio[-1] - ratio.mean()) / ratio.std(ddof=1) if ratio.std(ddof=1) > 0 else 0.0
        if abs(z) > ctx.params.get("enter", 2.0) and not ctx.book:
            way = -1 if z > 0 else 1
            ctx.set_weight(names[0], 0.5 * way, reason="wide")
            ctx.set_weight(names[1], -0.5 * way, reason="wide")
        elif abs(z) < ctx.params.get("leave", 0.5) and ctx.book:
            ctx.liquidate(reason="closed")


class BuyAndHold(Strategy):
    def on_day(self, ctx: Context) -> None:
        if not ctx.book and not ctx.state.get("done"):
            ctx.state["done"] = True
            ctx.equal_weight(ctx.symbols(), reason="hold")


class BiggestCompany(Strategy):
    """All in the largest company by market value, looked up each month."""

    def on_month(self, ctx: Context) -> None:
        top = ctx.biggest_company()
        if top is not None and ctx.held() != [top]:
            ctx.rebalance({top: 1.0}, reason="largest")


class DeclaredCross(Strategy):
    """The average crossing with declared parameters, so that it can be searched."""

    def setup(self, ctx: Context) -> None:
        self.fast = int(ctx.param("fast", 5, grid=[5, 10, 15], description="bars of the fast average"))
        self.slow = int(ctx.param("slow", 20, grid=[20, 30, 40], description="bars of the slow average"))
        ctx.warmup(self.slow)

    def on_day(self, ctx: Context) -> None:
        for s in ctx.symbols():
            fast, slow = ctx.sma(s, self.fast), ctx.sma(s, self.slow)
            if fast is None or slow is None:
                continue
            if fast > slow and not ctx.shares(s):
                ctx.set_weight(s, 1 / len(ctx.market.symbols), reason="fast above slow")
            elif fast < slow and ctx.shares(s):
                ctx.close(s, reason="fast below slow")


class MinimumVariance(Strategy):
    """Each month the weights of least variance of all that can be traded."""

    def on_month(self, ctx: Context) -> None:
        w = ctx.optimize(ctx.symbols(), ctx.params.get("objective", "min_variance"), int(ctx.params.get("lookback", 40)), most=0.5)
        if w:
            ctx.rebalance(w, reason="weights")


class RateTiming(Strategy):
    """In while an economic series falls over half a year, out while it rises; its values count from their publication on."""

    def on_week(self, ctx: Context) -> None:
        change = ctx.macro_change(ctx.params.get("series", "RATE"), 182)
        if change is not None and change < 0 and not ctx.book:
            ctx.equal_weight(ctx.symbols(), reason="falling")
        elif change is not None and change > 0 and ctx.book:
            ctx.liquidate(reason="rising")


STRATEGIES: dict[str, type[Strategy]] = {"golden-cross": GoldenCross, "mean-reversion": MeanReversion, "momentum-rotation": MomentumRotation, "sixty-forty": SixtyForty, "daily-reversal": DailyReversal, "pairs-trade": PairsTrade, "buy-and-hold": BuyAndHold, "biggest-company": BiggestCompany, "declared-cross": DeclaredCross, "minimum-variance": MinimumVariance, "rate-timing": RateTiming}
