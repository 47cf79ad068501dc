"""The simulation, trades, construction and inference on cases that can be worked out by hand or by plain loops."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import construct as C
from barloom.operators import inference as N
from barloom.operators import performance as P
from barloom.operators import trades as T
from barloom.plans import engine as E
from barloom.plans import search as S
from barloom.plans.strategies import STRATEGIES
from barloom.queries import search

D = dt.date


def bars(closes, symbol="A", **over):
    n = len(closes)
    c = np.array(closes, float)
    p = pd.DataFrame({"symbol": symbol, "bar_date": pd.bdate_range("2020-01-01", periods=n), "o": c, "h": c, "l": c, "c": c, "v": 1e6, "close": c})
    return p.assign(**over)


class Script(E.Strategy):
    def __init__(self, steps):
        self.steps = steps

    def on_day(self, ctx):
        for step in self.steps.get(ctx.t, []):
            step(ctx)


def run(p, steps, **options):
    return E.simulate(p, Script(steps), E.Spec.of({"slippage_bps": 0.0, **options}), {})


def test_orders_fill_at_the_next_open():
    p = bars([10, 11, 12, 13], o=[10, 11.5, 12, 13])
    r = run(p, {0: [lambda x: x.buy("A", shares=100)], 2: [lambda x: x.close("A")]}, cash=2000)
    assert [(f[1], f[2], f[3], f[4]) for f in r["fills"]] == [("A", "buy", 100.0, 11.5), ("A", "sell", -100.0, 13.0)]
    assert r["value"].tolist() == [2000, 2000 - 1150 + 1100, 2000 - 1150 + 1200, 2000 + 150]


def test_cash_limits_a_purchase_and_costs_count():
    r = run(bars([10, 10, 10]), {0: [lambda x: x.buy("A")]}, cash=1000, slippage_bps=100.0, commission_share=0.1)
    assert r["cash"][-1] == pytest.approx(0, abs=1e-6)
    q = r["fills"][0][3]
    assert q == pytest.approx(1000 / (10.1 + 0.1)) and r["commission"] == pytest.approx(q * 0.1) and r["slippage"] == pytest.approx(q * 0.1)


def test_no_short_unless_allowed_and_borrow_is_charged():
    steps = {0: [lambda x: x.short("A", 500)]}
    assert run(bars([10, 10, 10]), steps)["fills"] == []
    r = run(bars([10, 10, 8]), steps, allow_short=True, leverage=2.0, cash=1000, borrow_pct=25.2)
    assert r["fills"][0][2] == "short" and r["value"][-1] == pytest.approx(1000 + 100 - 500 * 0.001 - 400 * 0.001)
    assert run(bars([10, 10, 10]), steps, allow_short=True, leverage=2.0, borrow={"A": None})["refused"] == 1


def test_stops_fill_at_their_level_loss_first():
    p = bars([100, 100, 100, 100], l=[100, 100, 80, 100], h=[100, 100, 130, 100])
    r = run(p, {0: [lambda x: x.buy("A", shares=1, stops={"loss": 0.1, "profit": 0.2})]}, cash=1000)
    assert r["fills"][1][4] == pytest.approx(90) and r["fills"][1][-1] == "stop loss"
    t = run(bars([100, 100, 120, 120, 100], l=[100, 100, 120, 105, 100]), {0: [lambda x: x.buy("A", shares=1, stops={"trailing": 0.1})]}, cash=1000)
    assert t["fills"][1][4] == pytest.approx(108)


def test_limit_orders_targets_and_rebalance():
    r = run(bars([10, 10, 10]), {0: [lambda x: x.buy("A", shares=1, limit=9.0)]})
    assert r["fills"] == []
    two = pd.concat([bars([10, 10, 20, 20]), bars([10, 10, 10, 10], "B")])
    r = run(two, {0: [lambda x: x.rebalance({"A": 0.5, "B": 0.5})], 2: [lambda x: x.rebalance({"B": 1.0})]}, cash=1000)
    assert [(f[1], round(f[3], 6)) for f in r["fills"]] == [("A", 50.0), ("B", 50.0), ("A", -50.0), ("B", 100.0)]
    assert r["value"][-1] == pytest.approx(1500)


def test_a_strategy_error_is_recorded():
    assert run(bars([1, 2, 3]), {1: [lambda x: 1 / 0]})["errors"] == 1


def test_nothing_later_changes_what_was(spark):
    rng = np.random.default_rng(1)
    c = 100 * np.exp(np.cumsum(0.02 * rng.standard_normal(200)))
    for name in STRATEGIES:
        p = pd.concat([bars(c), bars(c[::-1], "B")])
        whole = E.simulate(p, STRATEGIES[name](), E.Spec(allow_short=True, leverage=2), {})
        cut = p[p["bar_date"] < p["bar_date"].max() - pd.Timedelta(60, "D")]
        part = E.simulate(cut, STRATEGIES[name](), E.Spec(allow_short=True, leverage=2), {})
        n = len(part["value"]) - 1  # the last day of a shorter history ends its month
        assert whole["value"][:n].tolist() == part["value"][:n].tolist(), name


def test_runs_are_groups(spark):
    p = spark.createDataFrame(bars(np.linspace(50, 80, 120).tolist())).withColumn("bar_date", F.to_date("bar_date"))
    rows = [{"run_id": f"r{i}", "strategy": "golden-cross", "symbols": ["A", "A"], "params": {"fast": f, "slow": 20}, "options": {"slippage_bps": 0.0}, "end": D(2020, 6, 1)} for i, f in enumerate((3, 5))]
    out = E.backtests(p, S.runs_of(spark, rows + [{"run_id": "none", "strategy": "buy-and-hold", "symbols": ["ZZZ"]}]))
    assert E.curves(out).groupBy("run_id").count().count() == 2
    assert E.curves(out).agg(F.max("bar_date")).first()[0] <= D(2020, 6, 1)
    assert E.fills(out).where("run_id = 'r0'").first()["side"] == "buy"
    scan = S.ladder(spark, p, rows[0], "slippage_bps", [0.0, 50.0]).orderBy("level").collect()
    assert scan[0].total_return > scan[1].total_return
    assert S.objective(out).orderBy("rank").first()["score"] is not None


def test_grids_folds_and_crossings():
    assert S.grid({"b": [1, 2], "a": [3]}, x=9) == [{"x": 9, "a": 3, "b": 1}, {"x": 9, "a": 3, "b": 2}]
    with pytest.raises(ValueError):
        S.grid({"a": list(range(100)), "b": list(range(100))})
    assert S.expand(0.1, 0.5, 0.1) == [0.1, 0.2, 0.3, 0.4, 0.5] and S.label({"b": 2.0, "a": 1.5}) == "a=1.5 b=2"
    assert S.folds(10, 4, 2) == [(0, 3, 4, 5), (2, 5, 6, 7), (4, 7, 8, 9)] and S.folds(8, 4, 2, 1, True)[0] == (0, 3, 5, 6)
    assert S.crossing([(0, 4), (10, 2), (20, -2)]) == 15 and S.crossing([(1, 2.0), (100, 0.0)], 1.0, log=True) == pytest.approx(10)


def fills_frame(spark, rows):
    return spark.createDataFrame([(a, b, i, D(2020, 1, i), q, p, c) for a, b, i, q, p, c in rows], "run_id string, symbol string, seq int, bar_date date, shares double, price double, cost double")


def test_fifo(spark):
    rows = [("r", "A", 1, 10.0, 100.0), ("r", "A", 2, 10.0, 120.0), ("r", "A", 3, -15.0, 130.0), ("r", "B", 1, 5.0, 10.0), ("r", "C", 1, 4.0, 1.0), ("r", "C", 2, -4.0, 2.0), ("r", "C", 3, 4.0, 3.0)]
    f = fills_frame(spark, [(*r, 0.0) for r in rows])
    got = {(r.symbol, r.entry_seq, r.exit_seq): (r.shares, r.net_pnl, r.open) for r in T.round_trips(f).collect()}
    assert got == {("A", 1, 3): (10, 300, False), ("A", 2, 3): (5, 50, False), ("A", 2, None): (5, None, True), ("B", 1, None): (5, None, True), ("C", 1, 2): (4, 4, False), ("C", 3, None): (4, None, True)}
    assert T.round_trips(f.limit(0)).count() == 0
    days = [(s, D(2020, 1, i), 100.0 + i, 90.0 + i, 95.0 + i) for s in "AC" for i in range(1, 6)]
    b = spark.createDataFrame(days, "symbol string, bar_date date, h double, l double, c double")
    s = T.trade_stats(T.enriched(T.round_trips(f), b)).first()
    assert (s.closed, s.open, s.win_rate, s.median_bars, s.profit_factor) == (3, 3, 1.0, 2, math.inf)


def naive_trades(fills):
    """Lots in a list, oldest first."""
    out, lots = [], {}
    for run, symbol, seq, q, price, cost in fills:
        own, unit = lots.setdefault((run, symbol), []), cost / abs(q)
        while abs(q) > 1e-9:
            if not own or own[0][1] * q > 0:
                own.append([seq, q, price, unit])
                break
            n = min(abs(q), abs(own[0][1]))
            sign = 1 if own[0][1] > 0 else -1
            out.append((run, symbol, "long" if sign > 0 else "short", own[0][0], seq, round(n, 6), round(sign * (price - own[0][2]) * n - n * (own[0][3] + unit), 4)))
            own[0][1] -= sign * n
            q += sign * n
            if abs(own[0][1]) <= 1e-9:
                own.pop(0)
    return out + [(run, symbol, "long" if q > 0 else "short", seq, None, round(abs(q), 6), None) for (run, symbol), own in lots.items() for seq, q, _, _ in own]


def test_signed_fifo_with_flips_and_costs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i % 3}", "AB"[i % 2], 1 + i // 6, float(rng.integers(-8, 9) or 1), float(rng.integers(5, 20)), float(rng.integers(0, 3))) for i in range(150)]
    got = T.round_trips(fills_frame(spark, rows)).collect()
    assert sorted((r.run_id, r.symbol, r.direction, r.entry_seq, r.exit_seq or 0, round(r.shares, 6), None if r.net_pnl is None else round(r.net_pnl, 4) + 0.0) for r in got) == sorted((*t[:4], t[4] or 0, *t[5:]) for t in naive_trades(rows))
    flip = T.round_trips(fills_frame(spark, [("r", "A", 1, 10.0, 100.0, 10.0), ("r", "A", 2, -15.0, 90.0, 15.0), ("r", "A", 3, 5.0, 80.0, 5.0)])).orderBy("entry_seq").collect()
    assert [(t.direction, t.shares, t.gross_pnl, t.costs, t.net_pnl) for t in flip] == [("long", 10, -100, 20, -120), ("short", 5, 50, 10, 40)]
    marked = T.round_trips(fills_frame(spark, [("r", "A", 1, -2.0, 50.0, 1.0)]), marks=spark.createDataFrame([("A", D(2020, 1, 9), 40.0)], "symbol string, last_day date, last double")).first()
    assert (marked.open, marked.net_pnl, marked.ret, marked.days_held) == (True, 19.0, 0.19, 8)


def test_excursions_against_all_bars(spark):
    rng = np.random.default_rng(4)
    every = [D(2020, 1, 1) + dt.timedelta(i) for i in range(300) if rng.random() < 0.6]
    b = [("A", x, float(rng.uniform(100, 120)), float(rng.uniform(80, 99)), 100.0) for x in every]
    spans = [sorted(rng.integers(-20, 320, 2).tolist()) for _ in range(60)]
    t = [("r", "A", "long" if i % 2 else "short", i, i if i % 5 else None, D(2020, 1, 1) + dt.timedelta(a), D(2020, 1, 1) + dt.timedelta(z) if i % 5 else None, 100.0, 1.0, not i % 5) for i, (a, z) in enumerate(spans)]
    f = spark.createDataFrame(t, "run_id string, symbol string, direction string, entry_seq int, exit_seq int, entry_day date, exit_day date, entry_price double, shares double, open boolean")
    for r in T.enriched(f, spark.createDataFrame(b, "symbol string, bar_date date, h double, l double, c double")).collect():
        inside = [x for x in b if x[1] >= r.entry_day and (r.open or x[1] <= r.exit_day)]
        low, high = min((x[3] for x in inside), default=100.0) / 100 - 1, max((x[2] for x in inside), default=100.0) / 100 - 1
        want = (min(0, low), max(0, high)) if r.direction == "long" else (min(0, -high), max(0, -low))
        assert r.bars_held == len(inside) and (r.mae_pct, r.mfe_pct) == pytest.approx(want)


def test_decay_keeps_what_a_trade_ended_with(spark):
    b = spark.createDataFrame([("A", D(2020, 1, i), 100.0 + 10 * i) for i in range(1, 9)], "symbol string, bar_date date, c double")
    t = spark.createDataFrame([("r", "A", "long", 1, 2, D(2020, 1, 1), D(2020, 1, 4), 110.0, False), ("r", "A", "short", 3, 4, D(2020, 1, 2), D(2020, 1, 3), 120.0, False), ("r", "A", "long", 5, None, D(2020, 1, 1), None, 110.0, True)], "run_id string, symbol string, direction string, entry_seq int, exit_seq int, entry_day date, exit_day date, entry_price double, open boolean")
    p = {r.horizon: (round(r.mean_return, 6), r.still_open, r.trades) for r in T.decay(t, b, (1, 2, 5)).collect()}
    assert p == {1: (round((10 / 110 - 10 / 120) / 2, 6), 2, 2), 2: (round((20 / 110 - 10 / 120) / 2, 6), 1, 2), 5: (round((30 / 110 - 10 / 120) / 2, 6), 0, 2)}
    s = T.decay_summary(T.decay(t, b, (1, 2, 5))).first()
    assert (s.peak_bars, s.still_rising, s.given_back) == (5, True, None)


def test_reasons_add_up(spark):
    rows = [("r", "A", "long", i, i + 1, D(2020, 1, 1), D(2020, 1, 2), f"RSI {i}  up" if i < 9 else None, "out", float(i - 4), i, 1, 0.0, 0.0, False) for i in range(10)]
    t = spark.createDataFrame(rows, "run_id string, symbol string, direction string, entry_seq int, exit_seq int, entry_day date, exit_day date, entry_reason string, exit_reason string, net_pnl double, bars_held int, days_held int, mae_pct double, mfe_pct double, open boolean")
    r = T.both_reasons(t).collect()
    assert {(x.side, x.grouping): sum(y.net for y in r if (y.side, y.grouping) == (x.side, x.grouping)) for x in r} == {(a, b): 5.0 for a in ("entry", "exit") for b in ("verbatim", "numberless")}
    assert {x.reason for x in r if x.grouping == "numberless"} == {"RSI N up", T.NO_REASON, "out"} and {x.preferred for x in r} == {"numberless"}
    kept = T.head_and_tail(spark.createDataFrame([("g", f"n{i}", float(i)) for i in range(9)], "g string, n string, v double"), "g", "v", 5, "n").orderBy("place").collect()
    assert [x.n for x in kept] == ["n8", "n7", "n2", "n1", "n0"]


def test_fills_of_books(spark):
    b = spark.createDataFrame([("r", 1, D(2020, 1, 1), "A", 5.0, 10.0), ("r", 2, D(2020, 1, 2), "A", 8.0, 11.0), ("r", 2, D(2020, 1, 2), "B", 1.0, 1.0), ("r", 3, D(2020, 1, 3), "B", 1.0, 1.0)], "run_id string, seq int, bar_date date, symbol string, shares double, price double")
    assert sorted((r.seq, r.symbol, r.shares) for r in T.fills_of(b).collect()) == [(1, "A", 5.0), (2, "A", 3.0), (2, "B", 1.0), (3, "A", -8.0)]


def test_measures_of_flat_and_short_curves(spark):
    c = spark.createDataFrame([("flat", D(2020, 1, i), 100.0) for i in (1, 2, 3)] + [("one", D(2020, 1, 1), 5.0)], "run_id string, bar_date date, value double")
    got = {r.run_id: r for r in P.headline(c).collect()}
    assert got["flat"].sharpe is None and got["flat"].total_return == 0 and got["one"].volatility is None and got["one"].cagr is None
    assert P.risk(c).count() == 1 and P.rolling(c, 2).count() == 1


def test_weights():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 4)) * np.array([0.01, 0.02, 0.03, 0.04])
    for o in C.OBJECTIVES:
        w = C.weights(x, o)
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
    assert C.weights(x, "inverse_vol", shrinkage=0.0) == pytest.approx((1 / x.std(axis=0, ddof=1)) / (1 / x.std(axis=0, ddof=1)).sum())
    cov = np.cov(x, rowvar=False)
    part = C.risk_parity(cov) * (cov @ C.risk_parity(cov))
    assert part == pytest.approx(np.full(4, part.mean()), rel=1e-4)
    assert C.weights(x, "min_variance", most=0.3).max() <= 0.3 + 1e-9 and C.capped(np.array([1.0, 0]), 0.4).tolist() == [0.5, 0.5]
    assert C.weights(x[:5], "hrp").tolist() == [0.25] * 4 and C.weights(x[:, :1], "hrp").tolist() == [1.0]


def brute_pbo(x, blocks=8):
    t, k = x.shape
    at = np.floor(np.arange(t) * blocks / t).astype(int)
    lost = []
    for half in itertools.combinations(range(blocks), blocks // 2):
        inside = np.isin(at, half)
        a, b = (x[m].mean(axis=0) / x[m].std(axis=0, ddof=1) for m in (inside, ~inside))
        lost.append((b < b[a.argmax()]).sum() < (k - 1) / 2)
    return np.mean(lost)


def frame(spark, x, study="s"):
    return spark.createDataFrame([(study, f"{k:03d}", t, float(x[t, k])) for t in range(x.shape[0]) for k in range(x.shape[1])], "study string, trial string, no int, r double")


def test_overfitting_and_reality_check(spark):
    rng = np.random.default_rng(2)
    noise = rng.standard_normal((400, 12)) * 0.01
    edge = noise.copy()
    edge[:, 3] += 0.004
    for x in (noise, edge):
        got = N.overfitting(frame(spark, x), ["study"], "trial", "no", "r").first()
        assert got.splits == 70 and got.trials == 12 and got.pbo == pytest.approx(brute_pbo(x))
    assert N.overfitting(frame(spark, edge), ["study"], "trial", "no", "r").first().pbo <= 0.1
    p = N.reality_check(frame(spark, noise), "study", "trial", "no", "r", draws=300).first()
    q = N.reality_check(frame(spark, edge), "study", "trial", "no", "r", draws=300).first()
    assert p.reality_p > 0.05 and q.reality_p < 0.02 and q.spa_p < 0.02
    d = N.deflated_sharpe(frame(spark, edge), ["study"], "trial", "r").first()
    assert d.best == "003" and d.deflated > 0.9
    assert N.aligned(frame(spark, noise).where("trial != '000' or no < 5"), ["study"], "trial").select("trial").distinct().count() == 11


def test_factor_model_is_exact_and_refuses_dependent_factors(spark):
    f = np.sin(np.arange(100.0))
    rows = spark.createDataFrame([("r", D(2020, 1, 1) + dt.timedelta(i), 1.5 * float(f[i]) + 0.01, float(f[i]), 2 * float(f[i])) for i in range(100)], "run_id string, bar_date date, r double, a double, b double")
    got = {x.term: x.coef for x in N.factor_model(rows, ["a"]).collect()}
    assert got == {"alpha": pytest.approx(0.01), "a": pytest.approx(1.5)}
    assert N.factor_model(rows, ["a", "b"]).count() == 0 and N.factor_model(rows.limit(10), ["a"]).count() == 0


def test_bootstrap_and_nulls(spark):
    rng = np.random.default_rng(5)
    r = (0.001 + 0.01 * rng.standard_normal(300)).tolist()
    c = spark.createDataFrame([("r", i, r[i]) for i in range(300)] + [("short", 0, 0.1)], "run_id string, no int, r double")
    b = N.bootstrap_bands(c, draws=300).collect()
    assert len(b) == 1 and b[0].p05 < b[0].p50 < b[0].p95 and b[0].dd05 <= b[0].dd50 <= 0
    e = spark.createDataFrame([("lucky", i, 1.0 if r[i] > 0.012 else 0.0, r[i]) for i in range(300)], "run_id string, no int, exposure double, rb double")
    n = N.null_exposure(e, draws=200).first()
    assert n.percentile > 0.99 and math.isfinite(n.median)


def test_walk_forward_and_combinatorial_by_hand(spark):
    """One pair always wins by 1 %: it is chosen in every fold and split."""
    rows = [("A", f, 20, t, 0.01 * (f == 5) + 0.001 * (-1) ** t) for f in (5, 10) for t in range(60)]
    t = spark.createDataFrame(rows, "symbol string, fast int, slow int, no int, r double")
    w = S.walk_forward(t, 20, 10).orderBy("fold").collect()
    assert [(x.fold, x.fast) for x in w] == [(i, 5) for i in range(4)] and w[0].test_return == pytest.approx(math.prod(1.01 + 0.001 * (-1) ** k for k in range(10)) - 1)
    c = S.combinatorial(t, 6, 2, 3).collect()
    assert len(c) == 15 and {x.fast for x in c} == {5} and not any(x.below for x in c)


@pytest.mark.parametrize("name", ["run_sixty_forty", "run_pairs_trade"])
def test_every_symbol_has_its_pairs(spark, sf, name):
    """A run for each two neighbours of the sorted symbols, none left out."""
    symbols = sorted(r.symbol for r in search.prices(spark, sf).join(B.counting_bars(spark, sf), ["symbol", "bar_date"]).select("symbol").distinct().collect())
    got = sorted(r.run_id for r in search.QUERIES[name](spark, sf).collect())
    assert len(symbols) > 2 and got == sorted(f"{a}/{b}" for a, b in zip(symbols, symbols[1:]))


def test_pairs_trade_both_symbols(spark, sf):
    traded = E.fills(search.simulated(spark, sf, "sixty-forty", "pair")).groupBy("run_id").agg(F.collect_set("symbol").alias("s")).collect()
    assert len({x for r in traded for x in r.s}) > 2 and all(set(r.s) <= set(r.run_id.split("/")) for r in traded)


# -- strategies' view ---------------------------------------------------------------------------------------------------------


def noisy(n, symbol="A", seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(0.02 * rng.standard_normal(n)))
    o, spread = c * (1 + 0.005 * rng.standard_normal(n)), 1 + np.abs(0.01 * rng.standard_normal(n))
    p = bars(c, symbol, o=o, h=np.maximum(o, c) * spread, l=np.minimum(o, c) / spread, v=rng.integers(1e5, 1e6, n).astype(float))
    return p[rng.random(n) < 0.9] if gaps else p


def test_strategies_see_the_indicators_of_the_columns(spark):
    """Every indicator a strategy can ask for has the value that the column of the same name has on that day."""
    from barloom.operators import indicators as I
    from barloom.operators import recursive as R
    from barloom.plans import series

    p = noisy(260)
    market = E.Market(p)
    df = I.with_inputs(spark.createDataFrame(p).withColumn("bar_date", F.to_date("bar_date"))).withColumns({"hma_input": I.hma_input(20), "k": I.stochastic_k(14)})
    one = {"sma": I.sma(20), "stdev": I.stdev(20), "highest": I.highest(20), "lowest": I.lowest(20), "momentum": I.momentum(20), "roc": I.momentum(10), "zscore": I.zscore(20), "drawdown": I.drawdown(252), "wma": I.wma(20), "hma": I.hma(20), "ema": I.ema(20), "atr": I.atr(14), "williams_r": I.williams_r(14), "cci": I.cci(20), "obv": I.obv(60), "mfi": I.mfi(14), "vwap": I.vwap(20), "cmf": I.cmf(20), "choppiness": I.choppiness(14)}
    many = {"bollinger": I.bollinger(20, 2.0), "keltner": I.keltner(20, 2.0), "donchian": I.donchian(20), "aroon": I.aroon(25), "ichimoku": I.ichimoku(), "linreg": I.linreg(20), "stochastic": {"k": F.col("k"), "d": I.sma(3, "k")}}
    columns = {n: {"": c} for n, c in one.items()} | many
    want = df.select("bar_date", *(c.alias(f"{n}.{k}") for n, cs in columns.items() for k, c in cs.items())).orderBy("bar_date").toPandas()
    for kind in R.KINDS:
        got = R.recursive(df, kind).orderBy("bar_date").toPandas()
        for name in R.KINDS[kind][3]:
            want[f"{kind}.{name if len(R.KINDS[kind][3]) > 1 else ''}"] = got[name].to_numpy()
    assert {c.split(".")[0] for c in want.columns[1:]} == set(series.INDICATORS)
    for c in want.columns[1:]:
        name, part = c.split(".")
        values = market.indicator("A", name, ())
        own = pd.Series(values[part] if part else values, dtype=float)
        expected = pd.Series(want[c].to_numpy(float))
        assert (own.isna() == expected.isna()).all(), c
        assert np.allclose(own.dropna(), expected.dropna(), rtol=1e-6, atol=1e-6), c


def test_what_strategies_see_and_declare():
    two = pd.concat([noisy(80), bars(np.linspace(10, 20, 80), "B")]).assign(shares=lambda x: np.where(x["symbol"] == "A", 5.0, 1000.0), member=1.0)
    two.loc[(two["symbol"] == "B") & (two["bar_date"] < "2020-02-01"), "member"] = 0.0
    seen = []

    class Look(E.Strategy):
        def setup(self, ctx):
            assert ctx.param("n", 3, low=1, high=3, step=1) == 7 and ctx.param("m", 5) == 5 and ctx.param("n", 99) == 7
            assert ctx.universe("b, a") == ["B", "A"]
            ctx.warmup(10)
            ctx.warmup(2)

        def on_day(self, ctx):
            seen.append((ctx.date, tuple(ctx.symbols()), ctx.biggest_company(), ctx.market_cap_rank("A"), ctx.bar("B")["close"], ctx.history("B", 3)[0]["close"], ctx.resample("B", "1mo", 2)[-1], ctx.macro("cpi"), ctx.macro("cpi", 40)))
            if ctx.day_index == 0:
                ctx.buy("B", pct_equity=0.5)
            if ctx.day_index == 2:
                seen.append(ctx.position("B"))
                assert ctx.every_n_days(2) and ctx.weekday == ctx.date.isoweekday() % 7 and ctx.macro("none") is None and ctx.raw_price("B") == ctx.price("B")

    macro = {"CPI": (np.array([np.datetime64("2020-02-10", "D").astype(int), np.datetime64("2020-03-10", "D").astype(int)]), np.array([1.5, 2.5]))}
    r = E.simulate(two, Look(), E.Spec.of({"slippage_bps": 0.0}), {"n": 7}, macro=macro)
    assert r["errors"] == 0 and len(r["value"]) == 70
    days = [x for x in seen if isinstance(x, tuple)]
    assert all(("B" in x[1]) == (x[0] >= D(2020, 2, 1)) for x in days) and {x[2] for x in days} == {"B"} and {x[3] for x in days} == {2}
    b = bars(np.linspace(10, 20, 80), "B").assign(day=lambda x: x["bar_date"].dt.date)
    for day, _, _, _, close, third, month, now, before in days:
        past = b[b["day"] <= day]
        assert close == past["c"].iloc[-1] and third == past["c"].iloc[-3]
        this = past[past["bar_date"].dt.month == day.month]
        assert (month["open"], month["close"], month["high"]) == (this["o"].iloc[0], this["c"].iloc[-1], this["h"].max())
        assert now == (None if day < D(2020, 2, 10) else 1.5 if day < D(2020, 3, 10) else 2.5) and (before is None) == (day < D(2020, 2, 10) + dt.timedelta(40))
    held = next(x for x in seen if isinstance(x, dict))
    assert held["weight"] == pytest.approx(0.5, abs=0.01) and held["days_held"] >= 1 and not held["short"]
    names, warm = E.declared(STRATEGIES["declared-cross"]())
    assert warm == 20 and names["fast"]["grid"] == [5, 10, 15]


def test_draws_are_the_same_everywhere():
    g = E.Draws(42)
    first = (42 * 6364136223846793005 + 1442695040888963407) % 2**64 >> 11
    assert g.next() == first and 0 <= g.below(10) < 10 and 0 <= g.unit() < 1 and E.Draws(0).state == 1


def test_runs_over_one_universe_share_its_bars(spark):
    p = spark.createDataFrame(pd.concat([noisy(150), noisy(150, "B", 2)])).withColumn("bar_date", F.to_date("bar_date"))
    u = spark.createDataFrame([("x", ["A"]), ("y", ["B", "A"])], "study string, symbols array<string>")
    configs = {f"{f}-{s}": {"fast": f, "slow": s} for f in (3, 5, 8) for s in (15, 20)} | {"bad": {"fast": "none", "slow": 20}}
    runs = S.runs_over(u, "declared-cross", configs)
    alone = {r.run_id: [round(v, 6) for v in r.value] for r in E.backtests(p, runs, per_task=1).collect()}
    assert alone == {r.run_id: [round(v, 6) for v in r.value] for r in E.backtests(p, runs, per_task=4).collect()} and len(alone) == 14
    rows = S.scored(E.measured_runs(p, runs), runs, score="total_return").orderBy("study", "place").collect()
    assert [r.config for r in rows if r.error] == ["bad", "bad"] and [r.place for r in rows] == [*range(1, 8)] * 2
    for study in ("x", "y"):
        scores = [r.score for r in rows if r.study == study and r.score is not None]
        assert scores == sorted(scores, reverse=True) and len(scores) == 6
    assert S.best_of(S.scored(E.measured_runs(p, runs), runs)).count() == 2
    with pytest.raises(ValueError):
        S.scored(E.measured_runs(p, runs), runs, score="luck")


def test_simulated_walk_forward_and_groups(spark):
    p = spark.createDataFrame(noisy(200, gaps=False)).withColumn("bar_date", F.to_date("bar_date"))
    u = spark.createDataFrame([("x", ["A"])], "study string, symbols array<string>")
    configs = {"a": {"fast": 3, "slow": 10}, "b": {"fast": 5, "slow": 20}}
    rows = S.simulated_walk_forward(p, u, "declared-cross", configs, 80, 30, embargo=-1).orderBy("fold").collect()
    assert [(r.fold, (r.test_from - D(2020, 1, 1)).days > 0) for r in rows] == [(0, True), (1, True), (2, True), (3, True)]
    grown = 1.0
    for r in rows:
        grown *= 1 + (r.test_return or 0.0)
        assert r.equity == pytest.approx(grown) and r.train_to < r.test_from
    s = S.walk_forward_summary(S.simulated_walk_forward(p, u, "declared-cross", configs, 80, 30, embargo=-1)).first()
    assert s.folds == 4 and s.equity == pytest.approx(grown)
    t = S.simulated_groups(p, u, "declared-cross", configs, 4)
    assert t.count() == 400
    chosen = S.combinatorial(t, 4, 2, study="study", config=("config",))
    assert chosen.count() == 6
    whole = S.paths(t, chosen, 4, 2, study="study", config=("config",))
    assert whole.count() == 3 and S.path_spread(whole, "study").first().paths == 3


def test_ranks_by_parts(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert [r["rank"] for r in S.ranked(df.repartition(7), [F.desc("v")]).orderBy(F.desc("v")).collect()] == list(range(1, 1001))


def test_measures_in_the_task_are_those_of_the_columns(spark):
    p = spark.createDataFrame(pd.concat([noisy(200), noisy(200, "B", 2)])).withColumn("bar_date", F.to_date("bar_date"))
    u = spark.createDataFrame([("x", ["A", "B"]), ("y", ["B"]), ("none", ["Z"])], "study string, symbols array<string>")
    runs = S.runs_over(u, "pairs-trade", {"n": {"n": 20, "enter": 1.0}}, {"": {"allow_short": True, "leverage": 2.0, "commission_pct": 0.1}}).unionByName(S.runs_over(u, "golden-cross", {"g": {"fast": 3, "slow": 12}}))
    got = {r.run_id: r for r in E.measured_runs(p, runs).collect()}
    results = E.backtests(p, runs).cache()
    curve = E.curves(results).select("run_id", "bar_date", "value")
    head = {r.run_id: r for r in P.headline(curve).collect()}
    t = T.round_trips(E.fills(results).withColumn("cost", F.col("commission") + F.col("slippage")))
    flat = spark.createDataFrame([(s, D(2020, 1, 1), 1.0, 1.0) for s in "AB"], "symbol string, bar_date date, h double, l double")
    stats = {r.run_id: r for r in T.trade_stats(T.enriched(t, flat)).collect()}
    assert len(got) == 6 and got["none@g"].bars == 0 and got["none@g"].error is None and {"x@n", "x@g"} <= stats.keys()
    for k, r in got.items():
        if k in head:
            for m in ("bars", "total_return", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown"):
                assert (r[m] is None) == (head[k][m] is None) and (r[m] is None or r[m] == pytest.approx(head[k][m])), (k, m)
        if k in stats and stats[k].closed:
            s = stats[k]
            assert (r.trades, r.expectancy, r.trade_win_rate, r.profit_factor) == (s.closed, pytest.approx(s.expectancy), pytest.approx(s.win_rate), pytest.approx(s.profit_factor))


def test_positions_are_what_the_equity_is_made_of(spark):
    p = spark.createDataFrame(pd.concat([noisy(120), noisy(120, "B", 2)])).withColumn("bar_date", F.to_date("bar_date"))
    u = spark.createDataFrame([("x", ["A", "B"])], "study string, symbols array<string>")
    results = E.backtests(p, S.runs_over(u, "pairs-trade", {"n": {"n": 20, "enter": 1.0}}, {"": {"allow_short": True, "leverage": 2.0}})).cache()
    held = E.positions(results, p).groupBy("run_id", "bar_date").agg(F.sum("value").alias("held"))
    j = E.curves(results).join(held, ["run_id", "bar_date"], "left").fillna(0.0, ["held"]).collect()
    assert any(r.held != 0 for r in j) and all(r.value == pytest.approx(r.cash + r.held, abs=0.01) for r in j)


def test_faults_of_strategies_and_placements(spark):
    class Idle(E.Strategy):
        pass

    class Broken(E.Strategy):
        def setup(self, ctx):
            ctx.param("")

        def on_day(self, ctx): ...

    assert E.faults_of(STRATEGIES["declared-cross"]) == [] and E.faults_of(Idle) == ["it does nothing on any day"] and "setup fails" in E.faults_of(Broken)[0] and E.faults_of(int)
    paths_ = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.3)], "symbol string, total_return double")
    r = S.placed_in(paths_, spark.createDataFrame([("a", 0.25)], "symbol string, walked double"), "symbol", "walked").first()
    assert (round(r.below, 4), r.median, r.paths) == (0.6667, 0.2, 3)
