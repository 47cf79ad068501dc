"""Searches over runs: parameter grids, vectorised and simulated sweeps, walk-forward, combinatorial validation, cost and capital ladders."""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.common import cut
from barloom.operators import performance as P
from barloom.plans.engine import backtests, curves, measured_runs


def grid(axes: dict[str, list], limit: int = 5000, **fixed) -> list[dict]:
    """All combinations, axes in order of name; refuses more than ``limit``."""
    names = sorted(axes)
    size = math.prod(len(axes[n]) for n in names)
    if size > limit:
        raise ValueError(f"{size} combinations; the limit is {limit}")
    return [{**fixed, **dict(zip(names, values))} for values in itertools.product(*(axes[n] for n in names))]


def expand(low: float, high: float, step: float, limit: int = 10_000) -> list[float]:
    """Grid values from low to high with as many decimals as the step has; refuses more than ``limit``, a step of 0 or less and an empty range."""
    if not step > 0 or high < low:
        raise ValueError("a grid needs a step above 0 and an end that isn't before its start")
    size = int((high - low) / step + 1e-9) + 1
    if size > limit:
        raise ValueError(f"{size} values; the limit is {limit}")
    places = max(0, len(f"{step:.10f}".rstrip("0").split(".")[1]))
    return [round(low + i * step, places) for i in range(size)]


def merge_grids(declared: dict[str, dict], given: dict[str, list]) -> dict[str, list]:
    """The values that a search tries: what the caller gives before what the strategy declared; names that weren't declared come last, sorted."""
    out = {n: list(given.get(n, d["grid"] or [d["default"]])) for n, d in declared.items()}
    return out | {n: list(given[n]) for n in sorted(given.keys() - declared.keys())}


def universe_of(text: str, named: dict[str, list[str]]) -> list[str]:
    """Symbols of a universe's name, or of a text with commas, trimmed, in upper case, once each in order."""
    from barloom.plans.engine import symbol_list

    return symbol_list(named[text.strip().lower()] if text.strip().lower() in named else text)


def label(params: dict) -> str:
    show = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return " ".join(f"{k}={show(v)}" for k, v in sorted(params.items()))


def runs_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Runs from dicts with run_id, strategy, symbols, params, options, start, end."""
    schema = "run_id string, strategy string, symbols array<string>, params string, options string, start date, end date"
    return spark.createDataFrame([(r["run_id"], r["strategy"], r["symbols"], json.dumps(r.get("params", {})), json.dumps(r.get("options", {})), r.get("start"), r.get("end")) for r in rows], schema)


def runs_over(universes: DataFrame, strategy: str, params: dict[str, dict] | None = None, options: dict[str, dict] | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Runs of a strategy over each universe (study, symbols) for each named set of parameters and of options: run_id is study@name@name, empty
    names left out; study and config (the parameters' name) are kept. The names are a short list; universes may be many."""
    named = lambda sets: F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(json.dumps(v)).alias("json")) for k, v in (sets or {"": {}}).items())))
    null = F.lit(None).cast("date")
    r = universes.withColumn("p", named(params)).withColumn("o", named(options))
    name = F.array_join(F.filter(F.array("study", "p.name", "o.name"), lambda x: x != ""), "@")
    return r.select(name.alias("run_id"), F.lit(strategy).alias("strategy"), "symbols", F.col("p.json").alias("params"), F.col("o.json").alias("options"), (null if start is None else start).alias("start"), (null if end is None else end).alias("end"), "study", F.col("p.name").alias("config"))


def replayed(universes: DataFrame, windows: DataFrame, strategy: str, params: dict | None = None) -> DataFrame:
    """Runs of a strategy over each universe in each of some windows (window, start, end; a short list), each from its own start."""
    each = windows.agg(F.collect_list(F.struct("window", "start", "end")).alias("w"))
    r = universes.join(F.broadcast(each)).select("study", "symbols", F.inline("w"))  # one row of windows
    return r.select(F.concat_ws("@", "study", "window").alias("run_id"), F.lit(strategy).alias("strategy"), "symbols", F.lit(json.dumps(params or {})).alias("params"), F.lit("{}").alias("options"), "start", "end", "study", "window")


def cross_sweep(bars: DataFrame, fasts: list[int], slows: list[int]) -> DataFrame:
    """Trial returns of all average crossings (fast < slow) of every symbol, without a simulation.

    Held from the next open to the open after it while fast is above slow. Each average is computed once, then the pairs are laid
    out per bar: symbol, fast, slow, no (0, 1, … from the first bar on which every average exists), bar_date, r.
    """
    w = W.partitionBy("symbol").orderBy("bar_date")
    over = lambda n: F.round(F.avg("c").over(w.rowsBetween(-(n - 1), 0)), 9)  # noqa: E731 equal averages are equal whatever the order of their sums
    df = bars.withColumns({f"_{n}": over(n) for n in sorted({*fasts, *slows})}).withColumns({"_k": F.row_number().over(w), "_r": F.lead("o", 2).over(w) / F.lead("o", 1).over(w) - 1})
    first = max(*fasts, *slows)
    ready = df.where((F.col("_k") >= first) & F.col("_r").isNotNull()).withColumn("no", F.col("_k") - first)
    pairs = [(f, s) for f in sorted(fasts) for s in sorted(slows) if f < s]
    trial = F.array(*(F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.when(F.col(f"_{f}") > F.col(f"_{s}"), F.col("_r")).otherwise(0.0).alias("r")) for f, s in pairs))
    return ready.select("symbol", "bar_date", "no", F.inline(trial))


def sweep_rows(trials: DataFrame, periods: float = 252) -> DataFrame:
    """One row per symbol and pair: bars, Sharpe ratio, compounded return, share of bars in the market."""
    sd = F.stddev_samp("r")
    return trials.groupBy("symbol", "fast", "slow").agg(F.count("*").alias("bars"), F.when(sd > 1e-12, F.avg("r") / sd * math.sqrt(periods)).alias("sharpe"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total_return"), F.avg((F.col("r") != 0).cast("double")).alias("held"))


def robustness(rows: DataFrame, study: list[str], score: str) -> DataFrame:
    """Best, median, worst, spread and share of positive scores of each study."""
    return rows.where(F.col(score).isNotNull()).groupBy(*study).agg(F.max(score).alias("best"), F.percentile(score, F.lit(0.5)).alias("median"), F.min(score).alias("worst"), F.stddev_samp(score).alias("spread"), F.avg((F.col(score) > 0).cast("double")).alias("positive"), F.count("*").alias("trials"))


#: What a search can aim at; less is better for the last two.
OBJECTIVES = ("sharpe", "sortino", "calmar", "cagr", "total_return", "profit_factor", "expectancy", "max_drawdown", "ulcer")


def scored(measured: DataFrame, runs: DataFrame, score: str = "sharpe") -> DataFrame:
    """A row per run with its measures, score and place in its study, best first, undefined scores and failed runs last.

    ``measured``: of :func:`barloom.plans.engine.measured_runs`; ``runs``: run_id, study, config. Places are given inside a study, so studies
    are spread over the cluster; a study has as many rows as configurations.
    """
    if score not in OBJECTIVES:
        raise ValueError(f"unknown objective {score}; there are {', '.join(OBJECTIVES)}")
    value = -F.abs(F.col(score)) if score in ("max_drawdown", "ulcer") else F.col(score)
    r = runs.select("run_id", "study", "config").join(measured, "run_id").withColumn("score", F.round(F.when(F.col("error").isNull(), value), 9))
    return r.withColumn("place", F.row_number().over(W.partitionBy("study").orderBy(F.desc_nulls_last("score"), "config")).cast("long"))


def best_of(rows: DataFrame, n: int = 1) -> DataFrame:
    """The n best configurations of each study that have a score."""
    return rows.where((F.col("place") <= n) & F.col("score").isNotNull())


def objective(results: DataFrame, score: str = "sharpe") -> DataFrame:
    """Measures of simulated runs (a row each) and their score, the best of all first; ranked by a sort over the cluster, not in one task."""
    rows = P.headline(curves(results).select("run_id", "bar_date", "value")).withColumn("score", F.col(score))
    return ranked(rows, [F.desc_nulls_last("score"), F.asc("run_id")])


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank, 1 for the first in ``order``. Rows are sorted over the cluster by ranges; each part is numbered by itself after the sizes of the parts before it."""
    parts = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    parts = cut(parts)  # the parts are to stay as they are
    sizes = parts.groupBy("_part").count()  # a row per part
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return parts.join(F.broadcast(before), "_part").withColumn("rank", (F.col("_before") + local + 1).cast("long")).drop("_part", "_at", "_before")


def simulated_walk_forward(bars: DataFrame, universes: DataFrame, strategy: str, configs: dict[str, dict], train: int, test: int, embargo: int = 0, anchored: bool = False, score: str = "sharpe", options: dict | None = None, macro: DataFrame | None = None) -> DataFrame:
    """Search on each training window by simulation and report on the test window after it, per study and fold: the chosen configuration, its
    scores in training and test, the test's return, and the equity chained over folds (1 at the beginning).

    Folds are counted in sessions of each study's own calendar. ``embargo`` sessions lie between training and test (below 0: none; 0: the strategy's
    warm-up). Each test begins with the run's own cash; chaining multiplies the returns, which is the same unless costs have a minimum.
    All folds and configurations are one DataFrame of runs for the training, and one for the tests.
    """
    from barloom.plans.engine import declared
    from barloom.plans.strategies import STRATEGIES

    gap = 0 if embargo < 0 else embargo or declared(STRATEGIES[strategy]())[1]
    days = universes.select("study", F.explode("symbols").alias("symbol")).join(bars.select("symbol", "bar_date"), "symbol").select("study", "bar_date").distinct()
    days = days.withColumn("no", F.row_number().over(W.partitionBy("study").orderBy("bar_date")) - 1)
    length = days.groupBy("study").agg((F.max("no") + 1).alias("n"))
    count = F.floor((F.col("n") - train - gap - test) / test) + 1
    fold = length.where(F.col("n") >= train + gap + test).select("study", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("fold"))
    at = {"train_from": F.lit(0) if anchored else F.col("fold") * test, "train_to": F.col("fold") * test + train - 1, "test_from": F.col("fold") * test + train + gap, "test_to": F.col("fold") * test + train + gap + test - 1}
    edges = fold.select("study", "fold", F.inline(F.array(*(F.struct(F.lit(k).alias("edge"), v.cast("long").alias("no")) for k, v in at.items()))))
    edges = edges.join(days.withColumn("no", F.col("no").cast("long")), ["study", "no"]).groupBy("study", "fold").pivot("edge", list(at)).agg(F.first("bar_date"))
    placed = universes.join(edges, "study").withColumn("of", F.concat_ws("#", "study", "fold"))
    inside = runs_over(placed.select(F.col("of").alias("study"), "symbols", "train_from", "train_to"), strategy, configs, {"": options or {}}, F.col("train_from"), F.col("train_to"))
    chosen = cut(best_of(scored(measured_runs(bars, inside, macro), inside, score)).select(F.col("study").alias("of"), "config", F.col("score").alias("train_score"), F.col("total_return").alias("train_return")))
    params = F.create_map(*(F.lit(x) for k, v in configs.items() for x in (k, json.dumps(v))))
    outside = placed.join(chosen, "of").select(F.col("of").alias("run_id"), F.lit(strategy).alias("strategy"), "symbols", params[F.col("config")].alias("params"), F.lit(json.dumps(options or {})).alias("options"), F.col("test_from").alias("start"), F.col("test_to").alias("end"), F.col("of").alias("study"), "config")
    tested = scored(measured_runs(bars, outside, macro), outside, score).select(F.col("study").alias("of"), F.col("score").alias("test_score"), F.col("total_return").alias("test_return"))
    rows = placed.select("of", "study", "fold", *at).join(chosen, "of").join(tested, "of", "left").drop("of")
    w = W.partitionBy("study").orderBy("fold")
    grown = F.exp(F.sum(F.log1p(F.greatest(F.coalesce("test_return", F.lit(0.0)), F.lit(-0.999999)))).over(w))
    return rows.withColumns({"equity": grown, "same": F.col("config") == F.lag("config").over(w)})


def walk_forward_summary(rows: DataFrame) -> DataFrame:
    """Per study: folds, mean returns in training and test, how much of the first was kept (efficiency), how often the choice stayed, folds with a gain."""
    g = rows.groupBy("study").agg(F.count("*").alias("folds"), F.avg("train_return").alias("in_sample"), F.avg("test_return").alias("out_of_sample"), F.avg(F.col("same").cast("double")).alias("stability"), F.count(F.when(F.col("test_return") > 0, 1)).alias("gains"), F.max_by("equity", "fold").alias("equity"))
    return g.withColumn("efficiency", F.col("out_of_sample") / F.when(F.col("in_sample") != 0, F.col("in_sample")))


def simulated_groups(bars: DataFrame, universes: DataFrame, strategy: str, configs: dict[str, dict], groups: int = 6, options: dict | None = None, macro: DataFrame | None = None) -> DataFrame:
    """Trial returns for :func:`combinatorial` and :func:`paths` from simulations: each configuration is run in each of ``groups`` stretches of a
    study's calendar by itself, so nothing is carried from one into the next. Columns: study, config, no, bar_date, r; days without a value have 0."""
    days = universes.select("study", F.explode("symbols").alias("symbol")).join(bars.select("symbol", "bar_date"), "symbol").select("study", "bar_date").distinct()
    days = days.withColumns({"no": (F.row_number().over(W.partitionBy("study").orderBy("bar_date")) - 1).cast("long"), "n": F.count("*").over(W.partitionBy("study"))}).withColumn("g", F.floor(F.col("no") * groups / F.col("n")))
    spans = days.groupBy("study", "g").agg(F.min("bar_date").alias("a"), F.max("bar_date").alias("z"))
    runs = runs_over(universes.join(spans, "study").select(F.concat_ws("#", "study", "g").alias("study"), "symbols", "a", "z"), strategy, configs, {"": options or {}}, F.col("a"), F.col("z"))
    c = P.with_returns(curves(backtests(bars, runs, macro)).select("run_id", "bar_date", "value")).join(runs.select("run_id", F.substring_index("study", "#", 1).alias("study"), "config"), "run_id")
    every = days.select("study", "bar_date", "no", F.explode(F.array(*map(F.lit, configs))).alias("config"))
    return every.join(c.select("study", "config", "bar_date", "r"), ["study", "config", "bar_date"], "left").fillna(0.0, ["r"])


def path_spread(paths_: DataFrame, by: str, value: str = "total_return") -> DataFrame:
    """How the results of whole paths spread: mean, median, deviation, 5 % and 95 %, worst, best, share below 0."""
    pct = lambda p: F.percentile(value, F.lit(p))
    return paths_.groupBy(by).agg(F.count("*").alias("paths"), F.avg(value).alias("mean"), pct(0.5).alias("median"), F.stddev_samp(value).alias("sd"), pct(0.05).alias("p05"), pct(0.95).alias("p95"), F.min(value).alias("worst"), F.max(value).alias("best"), F.avg((F.col(value) < 0).cast("double")).alias("below_zero"))


def fixed_spread(trials: DataFrame, study: str, config: list[str], groups: int = 6) -> DataFrame:
    """How the result of each fixed configuration spreads over the groups of a study's bars."""
    length = trials.groupBy(study).agg((F.max("no") + 1).alias("_t"))
    parts = trials.join(length, study).groupBy(study, *config, F.floor(F.col("no") * groups / F.col("_t")).alias("g")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("total_return"))
    name = F.concat_ws("-", *config)
    spread = path_spread(parts.withColumn("_by", F.struct(study, name.alias("config"))), "_by")
    return spread.select(f"_by.{study}", "_by.config", F.col("paths").alias("groups"), "mean", "median", "sd", "worst", "best", "below_zero")


def placed_in(paths_: DataFrame, own: DataFrame, by: str, value: str) -> DataFrame:
    """Where a result (``own``: by, value) stands among the paths of its study: the share of them that is lower, and their median."""
    j = paths_.select(by, F.col("total_return").alias("_p")).join(own.select(by, value), by)
    return j.groupBy(by, value).agg(F.avg((F.col("_p") < F.col(value)).cast("double")).alias("below"), F.percentile("_p", F.lit(0.5)).alias("median"), F.count("*").alias("paths"))


def capacity_rungs(results: DataFrame) -> DataFrame:
    """Rungs of a ladder of capital (run_id study@rung): measures, mean exposure, costs as a share of the capital, whether it was put to work (mean exposure at least half
    of the smallest rung's) and whether size bites (a return under half of the smallest rung's)."""
    c = curves(results)
    rows = P.headline(c.select("run_id", "bar_date", "value")).select("run_id", "bars", "total_return", "sharpe", "max_drawdown", "first_value")
    used = c.groupBy("run_id").agg(F.avg("exposure").alias("exposure"), F.avg("value").alias("mean_equity"))
    paid = results.select("run_id", (F.col("commission") + F.col("slippage")).alias("paid"), F.size("fills").alias("fills"))
    r = rows.join(used, "run_id").join(paid, "run_id").withColumns({"study": F.substring_index("run_id", "@", 1), "rung": F.substring_index("run_id", "@", -1), "cost_share": F.col("paid") / F.col("first_value")})
    w = W.partitionBy("study").orderBy("first_value").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base, own = F.first("total_return").over(w), F.first("exposure").over(w)
    return r.withColumns({"deployed": F.col("exposure") >= 0.5 * own, "bites": (base > 0) & (F.col("total_return") < 0.5 * base)}).select("run_id", "study", "rung", "bars", "total_return", "sharpe", "max_drawdown", "exposure", "mean_equity", "cost_share", "fills", "deployed", "bites")


def capacity_ends(rungs: DataFrame) -> DataFrame:
    """Per study the first and the last rung that is put to work without size biting."""
    ok = F.col("deployed") & ~F.col("bites")
    size = F.col("rung").cast("double")
    return rungs.groupBy("study").agg(F.min(F.when(ok, size)).alias("first_ok"), F.max(F.when(ok, size)).alias("last_ok"), F.max(size).alias("largest"))


def folds(days: int, train: int, test: int, embargo: int = 0, anchored: bool = False) -> list[tuple[int, int, int, int]]:
    """First and last day number of training and test of each fold."""
    out, at = [], 0
    while at + train + embargo + test <= days:
        out.append((0 if anchored else at, at + train - 1, at + train + embargo, at + train + embargo + test - 1))
        at += test
    return out


def walk_forward(trials: DataFrame, train: int, test: int, embargo: int = 0, anchored: bool = False, periods: float = 252) -> DataFrame:
    """Per symbol and fold: the pair that was best in training and how it did in the test after it.

    Trials are summed per block of ``test`` bars once, folds are sums of blocks; ``train`` and ``embargo`` must be multiples of ``test``.
    """
    if train % test or embargo % test:
        raise ValueError("train and embargo must be multiples of test")
    k, gap = train // test, embargo // test
    blocks = trials.groupBy("symbol", "fast", "slow", F.floor(F.col("no") / test).alias("block")).agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.sum(F.log1p("r")).alias("g")).where(F.col("n") == test)
    w = W.partitionBy("symbol", "fast", "slow").orderBy("block")
    back = w.rowsBetween(W.unboundedPreceding if anchored else -(k + gap), -(1 + gap))
    f = blocks.withColumns({"tn": F.sum("n").over(back), "ts": F.sum("s").over(back), "tq": F.sum("q").over(back)}).where((F.col("block") >= k + gap) & (F.col("tn") >= train))
    var = (F.col("tq") - F.col("ts") * F.col("ts") / F.col("tn")) / (F.col("tn") - 1)
    f = f.withColumn("score", F.round(F.when(var > 1e-18, F.col("ts") / F.col("tn") / F.sqrt(var) * math.sqrt(periods)).otherwise(-1e9), 9))
    best = f.withColumn("pick", F.row_number().over(W.partitionBy("symbol", "block").orderBy(F.desc("score"), "fast", "slow"))).where("pick = 1")
    own = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    return best.select("symbol", (F.col("block") - k - gap).alias("fold"), "fast", "slow", F.when(F.col("score") > -1e8, F.col("score")).alias("train_sharpe"), F.when(own > 1e-18, F.col("s") / F.col("n") / F.sqrt(own) * math.sqrt(periods)).alias("test_sharpe"), (F.exp("g") - 1).alias("test_return"))


def combinatorial(trials: DataFrame, groups: int = 6, tests: int = 2, embargo: int = 0, periods: float = 252, study: str = "symbol", config: tuple[str, ...] = ("fast", "slow")) -> DataFrame:
    """Combinatorial purged cross-validation: per symbol and split, the best pair outside the test groups and its result inside.

    Bars within ``embargo`` of a test group are left out of training. Columns: symbol, split, fast, slow, train_sharpe, test_sharpe,
    below (the choice is under the median of all pairs inside).
    """
    length = trials.groupBy(study).agg((F.max("no") + 1).alias("_t"))
    g = F.floor(F.col("no") * groups / F.col("_t"))
    t = trials.join(length, study).withColumn("g", g)
    start, end = F.ceil(F.col("g") * F.col("_t") / groups), F.ceil((F.col("g") + 1) * F.col("_t") / groups)
    # a bar may be near the group before or after its own
    t = t.withColumns({"near_left": F.col("no") < start + embargo, "near_right": F.col("no") >= end - embargo})
    sums = t.groupBy(study, *config, "g", "near_left", "near_right").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    plan = [(i, x, x in c, x - 1 in c, x + 1 in c) for i, c in enumerate(itertools.combinations(range(groups), tests)) for x in range(groups)]
    splits = trials.sparkSession.createDataFrame(plan, "split int, g long, test boolean, left boolean, right boolean")
    j = sums.join(F.broadcast(splits), "g").withColumn("purged", ~F.col("test") & ((F.col("left") & F.col("near_left")) | (F.col("right") & F.col("near_right"))))
    part = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0.0))
    train = ~F.col("test") & ~F.col("purged")
    s = j.groupBy(study, "split", *config).agg(*(part(train, x).alias(f"t{x}") for x in "nsq"), *(part(F.col("test"), x).alias(f"o{x}") for x in "nsq"))

    def sharpe(a: str) -> Column:
        n, m, q = (F.col(f"{a}{x}") for x in "nsq")
        var = (q - m * m / F.when(n > 1, n)) / F.when(n > 1, n - 1)
        return F.round(F.when(var > 1e-18, m / n / F.sqrt(var) * math.sqrt(periods)).otherwise(-1e9), 9)

    w = W.partitionBy(study, "split")
    r = s.withColumns({"a": sharpe("t"), "b": sharpe("o")}).withColumns({"pick": F.row_number().over(w.orderBy(F.desc("a"), *config)), "under": F.rank().over(w.orderBy("b")) - 1, "k": F.count("*").over(w)})
    seen = lambda c: F.when(F.col(c) > -1e8, F.col(c))
    return r.where("pick = 1").select(study, "split", *config, seen("a").alias("train_sharpe"), seen("b").alias("test_sharpe"), (F.col("under") < (F.col("k") - 1) / 2).alias("below"))


def paths(trials: DataFrame, chosen: DataFrame, groups: int = 6, tests: int = 2, study: str = "symbol", config: tuple[str, ...] = ("fast", "slow")) -> DataFrame:
    """Whole histories put together from the test groups of :func:`combinatorial`: symbol, path, compounded return.

    Each group is tested in several splits; the p-th of them gives the group's part of path p.
    """
    length = trials.groupBy(study).agg((F.max("no") + 1).alias("_t"))
    g = F.floor(F.col("no") * groups / F.col("_t"))
    parts = trials.join(length, study).groupBy(study, *config, g.alias("g")).agg(F.sum(F.log1p("r")).alias("log"))
    plan = [(i, x) for i, c in enumerate(itertools.combinations(range(groups), tests)) for x in c]
    tested = trials.sparkSession.createDataFrame(plan, "split int, g long")
    j = chosen.select(study, "split", *config).join(F.broadcast(tested), "split").join(parts, [study, *config, "g"])
    j = j.withColumn("path", F.row_number().over(W.partitionBy(study, "g").orderBy("split")))
    return j.groupBy(study, "path").agg((F.exp(F.sum("log")) - 1).alias("total_return"), F.count("*").alias("groups"))


def holdout(trials: DataFrame, share: float = 0.7, periods: float = 252) -> DataFrame:
    """The pair that was best in the first ``share`` of the bars, and what it did in the rest, which the choice never saw."""
    length = trials.groupBy("symbol").agg((F.max("no") + 1).alias("_t"))
    t = trials.join(length, "symbol").withColumn("seen", F.col("no") < F.floor(F.col("_t") * share + 1e-9))
    sharpe = lambda c: F.round(F.when(F.stddev_samp(F.when(c, F.col("r"))) > 1e-12, F.avg(F.when(c, F.col("r"))) / F.stddev_samp(F.when(c, F.col("r"))) * math.sqrt(periods)), 9)
    g = t.groupBy("symbol", "fast", "slow").agg(sharpe(F.col("seen")).alias("train_sharpe"), sharpe(~F.col("seen")).alias("test_sharpe"), (F.exp(F.sum(F.when(~F.col("seen"), F.log1p("r")))) - 1).alias("test_return"))
    best = W.partitionBy("symbol").orderBy(F.desc_nulls_last("train_sharpe"), "fast", "slow")
    return g.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def ladder(spark: SparkSession, bars: DataFrame, base: dict, option: str, levels: list[float]) -> DataFrame:
    """The same run at each level of one option (slippage_bps: a cost scan; cash: a capacity ladder): level and measures."""
    rows = [{**base, "run_id": f"{i:03d}", "options": {**base.get("options", {}), option: x}} for i, x in enumerate(levels)]
    level = spark.createDataFrame([(f"{i:03d}", float(x)) for i, x in enumerate(levels)], "run_id string, level double")
    out = P.headline(curves(backtests(bars, runs_of(spark, rows))).select("run_id", "bar_date", "value"))
    return level.join(out, "run_id", "left")


def crossing(points: list[tuple[float, float]], target: float = 0.0, log: bool = False) -> float | None:
    """Level at which the measure first falls through ``target``, between two levels by interpolation (of logarithms, for capital)."""
    at = math.log10 if log else float
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if y0 >= target > y1:
            x = at(x0) + (y0 - target) / (y0 - y1) * (at(x1) - at(x0))
            return 10**x if log else x
    return None
