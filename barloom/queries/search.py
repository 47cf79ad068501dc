"""Queries of sweeps, validation, inference, construction and simulated runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import construct as C
from barloom.operators import inference as N
from barloom.operators import indicators as I
from barloom.operators import performance as P
from barloom.plans import engine as E
from barloom.plans import search as S
from barloom.queries.market import BARS
from barloom.queries.runs import CURVE, FILLS, curve, shown
from barloom.queries.runs import books as T_books
from barloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FASTS, SLOWS = [5, 10, 15], [20, 30, 40]


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def prices(s: SparkSession, d: str) -> DataFrame:
    return B.adjusted(B.counting_bars(s, d))


def trials(s: SparkSession, d: str) -> DataFrame:
    return S.cross_sweep(prices(s, d), FASTS, SLOWS)


PAIRS = ", ".join(f"(cast({f} as bigint), cast({s} as bigint))" for f in FASTS for s in SLOWS)
AVERAGES = ", ".join(f"round(avg(c) over (partition by symbol order by bar_date rows between {n - 1} preceding and current row), 9) as a{n}" for n in FASTS + SLOWS)
CHOOSE = lambda x, ns: "case " + x + " " + " ".join(f"when {n} then a{n}" for n in ns) + " end"
TRIALS = f"""{BARS}, av as (select symbol, bar_date, {AVERAGES}, row_number() over (partition by symbol order by bar_date) as k, lead(o, 2) over (partition by symbol order by bar_date) / lead(o, 1) over (partition by symbol order by bar_date) - 1 as nr from x),
tr as (select symbol, bar_date, k - {max(SLOWS)} as no, fast, slow, case when {CHOOSE('fast', FASTS)} > {CHOOSE('slow', SLOWS)} then nr else 0 end as r from av cross join (values {PAIRS}) p(fast, slow) where k >= {max(SLOWS)} and nr is not null),
rw as (select symbol, fast, slow, count(*) as bars, case when stddev_samp(r) > 1e-12 then avg(r) / stddev_samp(r) * sqrt(252) end as sharpe, exp(sum(ln(1 + r))) - 1 as total_return, avg(case when r <> 0 then 1.0 else 0.0 end) as held from tr group by symbol, fast, slow)
"""
add("sweep_cross", lambda s, d: shown(S.sweep_rows(trials(s, d))), f"{TRIALS} select symbol, fast, slow, bars, round(sharpe, 6) + 0 as sharpe, round(total_return, 6) + 0 as total_return, round(held, 6) as held from rw")
add("sweep_robustness", lambda s, d: shown(S.robustness(S.sweep_rows(trials(s, d)), ["symbol"], "sharpe"), 5), f"{TRIALS} select symbol, round(max(sharpe), 5) + 0 as best, round(quantile_cont(sharpe, 0.5), 5) + 0 as median, round(min(sharpe), 5) + 0 as worst, round(stddev_samp(sharpe), 5) as spread, round(avg(case when sharpe > 0 then 1.0 else 0.0 end), 5) as positive, count(*) as trials from rw where sharpe is not null group by symbol")


def surface(s: SparkSession, d: str) -> DataFrame:
    """Mean Sharpe ratio over symbols, slow averages down and fast ones across."""
    rows = S.sweep_rows(trials(s, d))
    return shown(rows.groupBy("slow").pivot("fast", FASTS).agg(F.avg("sharpe")).withColumnsRenamed({str(f): f"fast_{f}" for f in FASTS}), 5)


add("sweep_surface", surface, f"{TRIALS} select slow, {', '.join(f'round(avg(case when fast = {f} then sharpe end), 5) + 0 as fast_{f}' for f in FASTS)} from rw group by slow")
SPLITS = "sp as (select m as split, b as block, (m >> b) & 1 = 1 as inside from range(256) t(m), range(8) u(b) where bit_count(cast(m as integer)) = 4)"
add("search_overfitting", lambda s, d: shown(N.overfitting(trials(s, d).withColumn("pair", F.format_string("%03d-%03d", "fast", "slow")), ["symbol"], "pair", "no", "r")), f"""{TRIALS}, {SPLITS},
mo as (select tr.symbol, fast, slow, cast(floor(no * 8.0 / t) as int) as block, count(r) as n, sum(r) as s, sum(r * r) as q from tr join (select symbol, max(no) + 1 as t from tr group by symbol) l on tr.symbol = l.symbol group by all),
si as (select symbol, split, fast, slow, inside, sum(n) as n, sum(s) as s, sum(q) as q from mo join sp on mo.block = sp.block group by all),
sc as (select *, round(case when (q - s * s / n) / nullif(n - 1, 0) > 1e-18 then s / n / sqrt((q - s * s / n) / (n - 1)) else -1e9 end, 9) as score from si),
bo as (select symbol, split, fast, slow, max(case when inside then score end) as a, max(case when not inside then score end) as b from sc group by all),
ra as (select *, row_number() over (partition by symbol, split order by a desc, fast, slow) as pick, rank() over (partition by symbol, split order by b) - 1 as below, count(*) over (partition by symbol, split) as trials from bo)
select symbol, round(avg(case when below < (trials - 1) / 2.0 then 1.0 else 0.0 end), 6) as pbo, count(*) as splits, max(trials) as trials from ra where pick = 1 group by symbol""")
add("search_deflated_sharpe", lambda s, d: shown(N.deflated_sharpe(trials(s, d).withColumn("pair", F.format_string("%03d-%03d", "fast", "slow")), ["symbol"], "pair", "r")))
add("search_plateau", lambda s, d: shown(N.plateau(S.sweep_rows(trials(s, d)).withColumn("sharpe", F.round("sharpe", 9)).where("sharpe is not null"), ["symbol"], ["fast", "slow"], "sharpe"), 5))
add("search_walk_forward", lambda s, d: shown(S.walk_forward(trials(s, d), 40, 20), 5), f"""{TRIALS},
bl as (select symbol, fast, slow, no // 20 as block, count(*) as n, sum(r) as s, sum(r * r) as q, sum(ln(1 + r)) as g from tr group by all having count(*) = 20),
fo as (select *, sum(n) over v as tn, sum(s) over v as ts, sum(q) over v as tq from bl window v as (partition by symbol, fast, slow order by block rows between 2 preceding and 1 preceding)),
sc as (select *, round(case when (tq - ts * ts / tn) / (tn - 1) > 1e-18 then ts / tn / sqrt((tq - ts * ts / tn) / (tn - 1)) * sqrt(252) else -1e9 end, 9) as score from fo where block >= 2 and tn >= 40),
pk as (select *, row_number() over (partition by symbol, block order by score desc, fast, slow) as pick from sc)
select symbol, block - 2 as fold, fast, slow, case when score > -1e8 then round(score, 5) + 0 end as train_sharpe, case when (q - s * s / n) / (n - 1) > 1e-18 then round(s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252), 5) + 0 end as test_sharpe, round(exp(g) - 1, 5) + 0 as test_return from pk where pick = 1""")
add("search_combinatorial", lambda s, d: shown(S.combinatorial(trials(s, d), 6, 2, 5), 5))
add("search_reality_check", lambda s, d: shown(N.reality_check(trials(s, d).withColumn("pair", F.format_string("%03d-%03d", "fast", "slow")), "symbol", "pair", "no", "r", draws=500)))


def returns(s: SparkSession, d: str) -> DataFrame:
    return P.with_returns(curve(s, d)).where("r is not null")


add("infer_bootstrap", lambda s, d: shown(N.bootstrap_bands(returns(s, d))))


def nulls(s: SparkSession, d: str) -> DataFrame:
    """The crossing's spells in each symbol against the same spells at other times."""
    c = E.curves(simulated(s, d, "golden-cross", "each")).withColumn("no", F.row_number().over(W.partitionBy("run_id").orderBy("bar_date")))
    own = I.with_inputs(prices(s, d)).select(F.col("symbol").alias("run_id"), "bar_date", F.col("r").alias("rb"))
    return N.null_exposure(c.join(own, ["run_id", "bar_date"]), draws=300)


add("infer_null_exposure", lambda s, d: shown(nulls(s, d)))


def factored(s: SparkSession, d: str) -> DataFrame:
    m = returns(s, d).groupBy("bar_date").agg(F.avg("r").alias("market"), F.stddev_pop("r").alias("dispersion"))
    return N.factor_model(returns(s, d).join(m, "bar_date"), ["market", "dispersion"], 30)


add("infer_factors", lambda s, d: shown(factored(s, d), 5))


def run_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each run against the one that began next in its quarter."""
    ids = curve(s, d).groupBy("run_id").agg(F.min("bar_date").alias("first"))
    w = W.partitionBy(F.date_trunc("quarter", "first")).orderBy("first", "run_id")
    return ids.select(F.col("run_id").alias("a"), F.lead("run_id").over(w).alias("b")).where("b is not null")


def run_setups(s: SparkSession, d: str) -> DataFrame:
    """How each run was set up, as far as its records tell: its first equity and whether it ever was short."""
    c = curve(s, d).groupBy("run_id").agg(F.round(F.min_by("value", "bar_date"), -3).alias("cash"), F.date_trunc("month", F.min("bar_date")).cast("date").alias("start"))
    short = T_books(s, d).groupBy("run_id").agg(F.max((F.col("shares") < 0).cast("int")).alias("shorts"))
    return c.join(short, "run_id", "left").fillna(0, ["shorts"])


add("infer_sharpe_gap", lambda s, d: shown(N.sharpe_gap(run_pairs(s, d), returns(s, d), 500)))
add("infer_comparable", lambda s, d: N.mismatches(run_pairs(s, d), run_setups(s, d), ["cash", "start", "shorts"]).select("a", "b", F.array_join("differ", ",").alias("differ"), "comparable"), f"""{FILLS}, fd as (select run_id, min(bar_date) as fd, round(arg_min(value, bar_date), -3) as cash, date_trunc('month', min(bar_date)) as start from c group by run_id), sh as (select run_id, max(case when shares < 0 then 1 else 0 end) as shorts from b group by run_id),
st as (select fd.*, coalesce(shorts, 0) as shorts from fd left join sh on sh.run_id = fd.run_id), pr as (select * from (select run_id as a, lead(run_id) over (partition by date_trunc('quarter', fd) order by fd, run_id) as b from fd) where b is not null)
select pr.a, pr.b, array_to_string(list_filter([case when x.cash <> y.cash then 'cash' end, case when x.start <> y.start then 'start' end, case when x.shorts <> y.shorts then 'shorts' end], lambda e: e is not null), ',') as differ, x.cash = y.cash and x.start = y.start and x.shorts = y.shorts as comparable from pr join st x on x.run_id = pr.a join st y on y.run_id = pr.b""")
LAGS = " + ".join(f"case when {k} <= lg then 2 * (1 - {k} / (lg + 1.0)) * coalesce(u * lag(u, {k}) over (partition by a, b order by bar_date), 0) else 0 end" for k in range(1, 11))
add("infer_paired", lambda s, d: shown(N.paired(run_pairs(s, d), returns(s, d)), 5), f"""{CURVE}, re as (select run_id, bar_date, r from w where r is not null), pr as (select * from (select run_id as a, lead(run_id) over (partition by date_trunc('quarter', fd) order by fd, run_id) as b from (select run_id, min(bar_date) as fd from c group by run_id)) where b is not null),
xa as (select a, b, bar_date, r as ra from pr join re on re.run_id = a), xb as (select a, b, bar_date, r as rb from pr join re on re.run_id = b),
j as (select coalesce(xa.a, xb.a) as a, coalesce(xa.b, xb.b) as b, coalesce(xa.bar_date, xb.bar_date) as bar_date, ra, rb from xa full join xb on xa.a = xb.a and xa.b = xb.b and xa.bar_date = xb.bar_date),
cn as (select a, b, count(case when rb is null then 1 end) as only_a, count(case when ra is null then 1 end) as only_b from j group by a, b),
me as (select a, b, avg(ra - rb) as m, count(*) as n, stddev_samp(ra - rb) as s, avg(case when ra > rb then 1.0 else 0.0 end) as ws, covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0) as co from j where ra is not null and rb is not null group by a, b),
u as (select j.a, j.b, bar_date, ra - rb - m as u, least(10, greatest(1, floor(4 * pow(n / 100.0, 2.0 / 9)))) as lg from j join me on j.a = me.a and j.b = me.b where ra is not null and rb is not null),
p as (select a, b, u * u + {LAGS} as p from u), v as (select a, b, sum(p) as v from p group by a, b)
select me.a, me.b, n as days, only_a, only_b, round(m, 5) + 0 as mean_gap, round(m / nullif(s, 0) * sqrt(n), 5) + 0 as naive_t, case when v > 0 then round(m * n / sqrt(v), 5) + 0 end as robust_t, round(ws, 5) as win_share, round(co, 5) + 0 as correlation from me join v on me.a = v.a and me.b = v.b join cn on me.a = cn.a and me.b = cn.b""")


def month_weights(s: SparkSession, d: str) -> DataFrame:
    """At each month end, weights of the ten steadiest symbols by their last 40 returns, which each month end carries along as an array."""
    back = I.by_symbol().rowsBetween(-39, 0)
    p = I.with_inputs(prices(s, d)).select("symbol", "bar_date", I.stdev(40, "r").alias("sd"), F.collect_list("r").over(back).alias("rs"))
    ends = p.groupBy(F.trunc("bar_date", "month").alias("m")).agg(F.max("bar_date").alias("bar_date"))
    at = p.join(ends, "bar_date").where("sd is not null")
    top = at.withColumn("place", F.row_number().over(W.partitionBy("bar_date").orderBy("sd", "symbol"))).where("place <= 10")
    look = top.select(F.col("bar_date").cast("string").alias("day"), "symbol", F.posexplode("rs").alias("k", "r")).select("day", "symbol", (39 - F.col("k")).alias("no"), "r")
    return C.constructed(look, "day", "symbol", "no", "r")


add("construct_weights", lambda s, d: shown(month_weights(s, d)))


def run_bars(s: SparkSession, d: str) -> DataFrame:
    """Adjusted bars with the raw close, in one pass."""
    b = B.counting_bars(s, d)
    sf = B.split_factor()
    return b.select("symbol", "bar_date", (F.col("open") * sf).alias("o"), (F.col("high") * sf).alias("h"), (F.col("low") * sf).alias("l"), F.col("adj_close").alias("c"), (F.col("volume") / sf).alias("v"), "close")


def universes(s: SparkSession, d: str, kind: str) -> DataFrame:
    """study and symbols: ``each`` symbol, each ``pair`` of neighbours in the sorted list of symbols, or sixteen ``groups`` of symbols."""
    symbols = B.counting_bars(s, d).select("symbol").distinct()
    if kind == "each":
        return symbols.select(F.col("symbol").alias("study"), F.array("symbol").alias("symbols"))
    if kind == "pair":  # for strategies that trade two symbols; the window's one partition holds a row a symbol
        both = symbols.select("symbol", F.lead("symbol").over(W.orderBy("symbol")).alias("next")).where("next is not null")
        return both.select(F.concat_ws("/", "symbol", "next").alias("study"), F.array("symbol", "next").alias("symbols"))
    return symbols.groupBy(F.pmod(F.crc32("symbol"), F.lit(16)).cast("string").alias("study")).agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def simulated(s: SparkSession, d: str, strategy: str, kind: str, variants: dict[str, dict] | None = None, bars: DataFrame | None = None, macro: DataFrame | None = None, **options) -> DataFrame:
    """Runs of a strategy over each universe; with ``variants`` (name to options) one for each, named universe@name, all over the same bars."""
    runs = S.runs_over(universes(s, d, kind), strategy, options={k: {**options, **v} for k, v in (variants or {"": {}}).items()})
    return E.backtests(run_bars(s, d) if bars is None else bars, runs, macro)


def measured(r: DataFrame) -> DataFrame:
    costs = r.select("run_id", F.size("fills").alias("fills"), "commission", "slippage", "borrow", "errors")
    return shown(P.headline(E.curves(r).select("run_id", "bar_date", "value")).select("run_id", "bars", "total_return", "sharpe", "max_drawdown").join(costs, "run_id"))


for name, kind, options in (("golden-cross", "each", {}), ("mean-reversion", "each", {}), ("momentum-rotation", "groups", {}), ("sixty-forty", "pair", {}), ("daily-reversal", "groups", {}), ("pairs-trade", "pair", {"allow_short": True, "leverage": 2.0}), ("buy-and-hold", "groups", {"slippage_bps": 0.0}), ("minimum-variance", "groups", {})):
    add(f"run_{name.replace('-', '_')}", lambda s, d, n=name, k=kind, o=options: measured(simulated(s, d, n, k, **o)))


def cost_scan(s: SparkSession, d: str) -> DataFrame:
    """Every symbol's crossing at four slippages: one DataFrame of runs, which share their symbol's bars."""
    return measured(simulated(s, d, "golden-cross", "each", {f"{x:02d}": {"slippage_bps": float(x)} for x in (0, 5, 20, 50)}))


add("run_cost_scan", cost_scan)


# -- searches over simulated runs ---------------------------------------------------------------------------------------------

CONFIGS = {f"{f:02d}-{w:02d}": {"fast": f, "slow": w} for f in FASTS for w in SLOWS}


def searched(s: SparkSession, d: str) -> DataFrame:
    """Every symbol's declared crossing at all nine settings, by simulation with costs."""
    runs = S.runs_over(universes(s, d, "each"), "declared-cross", CONFIGS)
    return S.scored(E.measured_runs(run_bars(s, d), runs), runs)


add("sweep_simulated", lambda s, d: shown(searched(s, d), 5))
add("sweep_simulated_best", lambda s, d: shown(S.best_of(searched(s, d)).select("study", "config", "score", "total_return", "trades"), 5))


def walked(s: SparkSession, d: str) -> DataFrame:
    return S.simulated_walk_forward(run_bars(s, d), universes(s, d, "each"), "declared-cross", CONFIGS, 90, 30, embargo=5)


add("search_simulated_walk_forward", lambda s, d: shown(walked(s, d), 5))
add("search_walk_forward_summary", lambda s, d: shown(S.walk_forward_summary(walked(s, d)), 5))


def simulated_paths(s: SparkSession, d: str) -> DataFrame:
    """Whole histories of the sixteen groups' crossing, put together from stretches in which the choice wasn't made, and how they spread."""
    t = S.simulated_groups(run_bars(s, d), universes(s, d, "groups"), "declared-cross", CONFIGS)
    chosen = S.combinatorial(t, 6, 2, 5, study="study", config=("config",))
    return S.path_spread(S.paths(t, chosen, 6, 2, study="study", config=("config",)), "study")


add("search_simulated_paths", lambda s, d: shown(simulated_paths(s, d), 5))


def nine_years(s: SparkSession, d: str) -> DataFrame:
    """1,064 settings of the crossing over nine years of one made symbol, ranked by Sharpe ratio: the size of search that published figures are given for."""
    made = files.synthetic(s, ["MADE"], "2015-01-05", "2023-12-29")
    bars = B.adjusted(made).join(made.select("symbol", "bar_date", "close"), ["symbol", "bar_date"])
    one = s.createDataFrame([("MADE", ["MADE"])], "study string, symbols array<string>")
    configs = {f"{f:03d}-{w:03d}": {"fast": f, "slow": w} for f in range(4, 80, 4) for w in range(90, 370, 5)}
    runs = S.runs_over(one, "golden-cross", configs)
    return shown(S.scored(E.measured_runs(bars, runs), runs), 5)


add("sweep_nine_years", nine_years)
