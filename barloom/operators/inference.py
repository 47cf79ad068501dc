"""Statistics for searches over many trials: overfitting probability, deflated Sharpe ratio, plateau, bootstrap bands, reality
check, relocated-exposure nulls, factor regressions and paired comparison.

What moments can express runs as Catalyst aggregations; resampling runs as array code, one trial set or run to a task, in blocks of
replicates, so memory is bounded by BLOCK replicates of one series.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCKS, BLOCK = 8, 50
EULER = 0.5772156649015329
NORMAL = NormalDist()


def nz(c: Column) -> Column:
    return F.when(c != 0, c)


def aligned(returns: DataFrame, study: list[str], trial: str) -> DataFrame:
    """Trials of the most frequent length of their study (of equally frequent ones the longest); the others are left out."""
    n = returns.groupBy(*study, trial).agg(F.count("*").alias("_n"))
    most = n.groupBy(*study, "_n").agg(F.count("*").alias("_k")).groupBy(*study).agg(F.max(F.struct("_k", "_n")).alias("_m"))
    keep = n.join(most, study).where("_n = _m._n").select(*study, trial)
    return returns.join(keep, [*study, trial], "left_semi")


def halves(blocks: int = BLOCKS) -> list[tuple[int, ...]]:
    """All ways to take half of the blocks: a fixed number (70 for eight blocks)."""
    return list(itertools.combinations(range(blocks), blocks // 2))


def overfitting(returns: DataFrame, study: list[str], trial: str, no: str, r: str, blocks: int = BLOCKS) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation, per study.

    ``returns``: study, trial, ``no`` (0, 1, … without gaps, the same for all trials), ``r``. In each split the trial with the best Sharpe
    ratio inside is looked at outside; the share of splits in which it is below the median there is the result. Trials are summed up
    per block first (count, sum, sum of squares), so no return meets a split, and a study is one task's eight rows a trial.
    """
    length = returns.groupBy(*study).agg((F.max(no) + 1).alias("_t"))
    block = F.floor(F.col(no) * blocks / F.col("_t")).cast("int")
    moments = returns.join(length, study).groupBy(*study, trial, block.alias("block")).agg(F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(F.col(r) * F.col(r)).alias("q"))
    sides = np.zeros((len(halves(blocks)), blocks))
    for i, half in enumerate(halves(blocks)):
        sides[i, list(half)] = 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A study's splits as products of its moments (trials x blocks) with the splits (splits x blocks)."""
        trials, row = np.unique(pdf[trial].to_numpy(), return_inverse=True)
        at = (row, pdf["block"].to_numpy(int))

        def scores(inside: np.ndarray) -> np.ndarray:
            n, s_, q = (m @ inside.T for m in moment)
            with np.errstate(divide="ignore", invalid="ignore"):
                var = (q - s_ * s_ / n) / (n - 1)
                return np.where(var > 1e-18, np.round(s_ / n / np.sqrt(var), 9), -1e9)

        moment = []
        for c in "nsq":
            m = np.zeros((len(trials), blocks))
            m[at] = pdf[c].to_numpy(float)
            moment.append(m)
        a, b = scores(sides), scores(1 - sides)
        pick = a.argmax(axis=0)  # of equal ones the first by name
        below = (b < b[pick, np.arange(len(sides))]).sum(axis=0)
        return pdf[study].head(1).assign(pbo=float((below < (len(trials) - 1) / 2).mean()), splits=len(sides), trials=len(trials))

    kinds = dict(returns.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in study), "pbo double", "splits long", "trials long"])
    return moments.groupBy(*study).applyInPandas(run, schema)


def expected_max(sd: float, n: int) -> float:
    """Expected largest of n normal draws, by the two-term approximation."""
    if n < 2:
        return 0.0
    return sd * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / n) + EULER * NORMAL.inv_cdf(1 - 1 / (n * math.e)))


def deflated_sharpe(returns: DataFrame, study: list[str], trial: str, r: str) -> DataFrame:
    """Per study: the best trial and the probability that its Sharpe ratio beats the luckiest of as many worthless trials."""
    g = returns.groupBy(*study, trial).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.skewness(r).alias("g3"), F.kurtosis(r).alias("g4")).where("n >= 30 and s > 0")
    n = F.col("n")
    g = g.withColumns({"sharpe": F.col("m") / F.col("s"), "skew": F.col("g3") * F.pow((n - 1) / n, F.lit(1.5)), "kurt": (F.col("g4") + 3) * F.pow((n - 1) / n, F.lit(2.0))})
    best = g.groupBy(*study).agg(F.max_by(F.struct(trial, "n", "sharpe", "skew", "kurt"), F.struct("sharpe", trial)).alias("b"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("spread"), F.count("*").alias("trials"))

    @F.pandas_udf("double")
    def probability(sharpe: pd.Series, skew: pd.Series, kurt: pd.Series, n: pd.Series, spread: pd.Series, trials: pd.Series) -> pd.Series:
        out = []
        for x, g3, g4, k, sd, t in zip(sharpe, skew, kurt, n, spread, trials):
            luck = expected_max(sd, int(t))
            var = 1 - g3 * x + (g4 - 1) / 4 * x * x
            out.append(NORMAL.cdf((x - luck) * math.sqrt(k - 1) / math.sqrt(var)) if var > 0 else None)
        return pd.Series(out, dtype="float64")

    return best.select(*study, F.col(f"b.{trial}").alias("best"), F.col("b.sharpe").alias("sharpe"), "spread", "trials", probability("b.sharpe", "b.skew", "b.kurt", F.col("b.n").cast("double"), "spread", "trials").alias("deflated"))


def plateau(scores: DataFrame, study: list[str], axes: list[str], score: str) -> DataFrame:
    """Mean score of the grid points one step from the best along one axis, as a share of the best (0 to 1)."""
    ranked = scores.withColumns({f"_{a}": F.dense_rank().over(W.partitionBy(*study).orderBy(a)) for a in axes})
    best = ranked.groupBy(*study).agg(F.max(F.struct(F.col(score).alias("s"), *(F.col(f"_{a}").alias(a) for a in axes))).alias("b"))
    steps = sum((F.abs(F.col(f"_{a}") - F.col(f"b.{a}")) for a in axes[1:]), F.abs(F.col(f"_{axes[0]}") - F.col(f"b.{axes[0]}")))
    near = ranked.join(best, study).where(steps == 1).groupBy(*study).agg(F.avg(score).alias("near"), F.count("*").alias("neighbours"), F.max("b.s").alias("best"))
    return near.select(*study, "best", "near", "neighbours", F.when(F.col("best") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("near") / nz(F.col("best"))))).alias("ratio"))


def stationary_indices(rng: np.random.Generator, n: int, rows: int, mean: int) -> np.ndarray:
    """Stationary bootstrap: blocks of geometric length, wrapped around."""
    start = rng.random((rows, n)) < 1 / mean
    start[:, 0] = True
    first = rng.integers(0, n, (rows, n))
    at = np.maximum.accumulate(np.where(start, np.arange(n), 0), axis=1)
    return (np.take_along_axis(first, at, axis=1) + np.arange(n) - at) % n


def block_indices(rng: np.random.Generator, n: int, rows: int, length: int) -> np.ndarray:
    """Moving blocks of one length."""
    length = min(length, n)
    k = -(-n // length)
    starts = rng.integers(0, n - length + 1, (rows, k))
    return (starts[:, :, None] + np.arange(length)).reshape(rows, -1)[:, :n]


def seed_of(seed: int, *key: object) -> int:
    import zlib

    return zlib.crc32("|".join(map(str, (seed, *key))).encode())


def bootstrap_bands(curves: DataFrame, draws: int = 1000, length: int = 21, seed: int = 7) -> DataFrame:
    """Per run (run_id, no, r; 30 returns or more): bands of the total return and of the deepest drawdown over redrawn histories."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("no")["r"].to_numpy(float)
        if len(r) < 30:
            return pd.DataFrame(columns=["run_id", "p05", "p50", "p95", "dd05", "dd50", "loss"])
        rng = np.random.default_rng(seed_of(seed, pdf["run_id"].iloc[0]))
        totals, deep = [], []
        for low in range(0, draws, BLOCK):
            path = np.cumprod(1 + r[block_indices(rng, len(r), min(BLOCK, draws - low), length)], axis=1)
            totals.append(path[:, -1] - 1)
            deep.append((path / np.maximum(np.maximum.accumulate(path, axis=1), 1) - 1).min(axis=1))
        total, dd = np.concatenate(totals), np.concatenate(deep)
        return pd.DataFrame([(pdf["run_id"].iloc[0], *np.percentile(total, [5, 50, 95]), *np.percentile(dd, [5, 50]), (total < 0).mean())], columns=["run_id", "p05", "p50", "p95", "dd05", "dd50", "loss"])

    return curves.select("run_id", "no", "r").where("r is not null").groupBy("run_id").applyInPandas(run, "run_id string, p05 double, p50 double, p95 double, dd05 double, dd50 double, loss double")


def reality_check(returns: DataFrame, study: str, trial: str, no: str, r: str, draws: int = 1000, mean: int = 21, seed: int = 7, most: int = 32 * 2**20) -> DataFrame:
    """Per study (200 bars or more): p values that the best trial is luck (reality check) and that allow for poor trials (superior ability).

    All trials are redrawn with the same indices, so a study is one task's matrix of bars and trials; one of over ``most`` cells is refused. The test of superior ability studentises by the redrawn spread and recentres
    trials at zero that are worse than -sqrt(2 ln ln T) standard errors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index=no, columns=trial, values=r).dropna(axis=1).to_numpy(float)
        t, k = x.shape
        if t < 200 or k < 1:
            return pd.DataFrame(columns=[study, "trials", "reality_p", "spa_p"])
        rng = np.random.default_rng(seed_of(seed, pdf[study].iloc[0]))
        means = x.mean(axis=0)
        redrawn = []
        for low in range(0, draws, BLOCK):
            idx = stationary_indices(rng, t, min(BLOCK, draws - low), mean)
            weight = np.stack([np.bincount(i, minlength=t) for i in idx]) / t
            redrawn.append(weight @ x)
        centred = np.sqrt(t) * (np.concatenate(redrawn) - means)
        omega = np.maximum(centred.std(axis=0, ddof=1), 1e-12)
        best, stud = np.sqrt(t) * means.max(), max(0.0, (np.sqrt(t) * means / omega).max())
        poor = np.sqrt(t) * means / omega < -math.sqrt(2 * math.log(math.log(t)))
        spa = np.maximum(((centred + np.where(poor, np.sqrt(t) * means, 0)) / omega).max(axis=1), 0)
        return pd.DataFrame([(pdf[study].iloc[0], k, float((centred.max(axis=1) >= best).mean()), float((spa >= stud).mean()))], columns=[study, "trials", "reality_p", "spa_p"])

    size = returns.groupBy(study).agg(F.count("*").alias("_cells"))
    ok = F.when(F.col("_cells") > most, F.raise_error(F.concat(F.lit(f"over {most} returns in study "), F.col(study))).cast("boolean")).otherwise(True)
    returns = returns.join(size, study).where(ok)
    return returns.select(study, trial, no, r).where(f"{r} is not null").groupBy(study).applyInPandas(run, f"{study} string, trials long, reality_p double, spa_p double")


def null_exposure(curves: DataFrame, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Per run: where its Sharpe ratio stands among histories with the same spells of exposure at other times.

    ``curves``: run_id, no, r, exposure, rb (the market's return). Runs of under 60 bars, or in or out of the market for under 5 % of them,
    give no row. The spells keep their lengths and weights; their order and the gaps between them are drawn.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        e, m = pdf["exposure"].fillna(0).to_numpy(float), pdf["rb"].fillna(0).to_numpy(float)
        on, n = e > 0, len(pdf)
        columns = ["run_id", "sharpe", "median", "percentile"]
        if n < 60 or not 0.05 <= on.mean() <= 0.95:
            return pd.DataFrame(columns=columns)
        edge = np.flatnonzero(np.diff(np.r_[0, on.astype(int), 0]))
        spells = [e[a:b] for a, b in zip(edge[::2], edge[1::2])]
        rng = np.random.default_rng(seed_of(seed, pdf["run_id"].iloc[0]))
        score = lambda x: x.mean() / x.std(ddof=1) * math.sqrt(252) if x.std(ddof=1) > 0 else 0.0
        free, drawn = n - sum(map(len, spells)), []
        for _ in range(draws):
            cuts = np.diff(np.r_[0, np.sort(rng.integers(0, free + 1, len(spells))), free])
            path, at = np.zeros(n), 0
            for gap, i in zip(cuts, rng.permutation(len(spells))):
                at += gap
                path[at : at + len(spells[i])] = spells[i]
                at += len(spells[i])
            drawn.append(score(path * m))
        own = score(e * m)
        return pd.DataFrame([(pdf["run_id"].iloc[0], own, float(np.sort(drawn)[len(drawn) // 2]), float((np.array(drawn) < own).mean()))], columns=columns)

    return curves.select("run_id", "no", "exposure", "rb").groupBy("run_id").applyInPandas(run, "run_id string, sharpe double, median double, percentile double")


def bandwidth(n: int) -> int:
    """Newey-West: 4 (n / 100)^(2/9), from 1 to 10."""
    return int(min(10, max(1, math.floor(4 * (n / 100) ** (2 / 9)))))


def factor_model(rows: DataFrame, factors: list[str], least: int = 60) -> DataFrame:
    """Least squares of r on factors per run, with standard errors robust to autocorrelation: run_id, term, coef, se, t, r2, n.

    Columns are scaled by their root mean square; a run whose factors are linearly dependent, or with under ``least`` rows, gives no row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_date")
        columns = ["run_id", "term", "coef", "se", "t", "r2", "n"]
        y, x = pdf["r"].to_numpy(float), np.column_stack([np.ones(len(pdf)), *(pdf[f].to_numpy(float) for f in factors)])
        n, k = x.shape
        scale = np.sqrt((x * x).mean(axis=0))
        if n < max(least, k + 2) or (scale == 0).any() or np.linalg.matrix_rank(x / scale) < k:
            return pd.DataFrame(columns=columns)
        z = x / scale
        inverse = np.linalg.inv(z.T @ z)
        beta = inverse @ z.T @ y
        u = y - z @ beta
        d = z * u[:, None]
        lag = bandwidth(n)
        meat = d.T @ d
        for j in range(1, lag + 1):
            g = d[j:].T @ d[:-j]
            meat += (1 - j / (lag + 1)) * (g + g.T)
        var = inverse @ meat @ inverse * n / (n - k)
        coef, se = beta / scale, np.sqrt(np.maximum(np.diag(var), 0)) / scale
        total = ((y - y.mean()) ** 2).sum()
        r2 = 1 - (u @ u) / total if total > 0 else None
        return pd.DataFrame([(pdf["run_id"].iloc[0], t, c, s, c / s if s > 0 else None, r2, n) for t, c, s in zip(["alpha", *factors], coef, se)], columns=columns)

    need = " and ".join(f"{c} is not null" for c in ["r", *factors])
    return rows.where(need).select("run_id", "bar_date", "r", *factors).groupBy("run_id").applyInPandas(run, "run_id string, term string, coef double, se double, t double, r2 double, n long")


def paired(pairs: DataFrame, curves: DataFrame) -> DataFrame:
    """Compare pairs of runs (a, b) on their common days: numbers of days, mean gap, naive and robust t, win share, correlation.

    ``curves``: run_id, bar_date, r. The robust variance sums ten lagged products, weighted by the pair's own bandwidth.
    """
    x = pairs.join(curves.withColumnsRenamed({"run_id": "a", "r": "ra"}), "a")
    y = pairs.join(curves.withColumnsRenamed({"run_id": "b", "r": "rb"}), "b")
    j = x.join(y, ["a", "b", "bar_date"], "full_outer")
    counts = j.groupBy("a", "b").agg(F.count(F.when(F.col("rb").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("ra").isNull(), 1)).alias("only_b"))
    c = j.where("ra is not null and rb is not null").withColumn("g", F.col("ra") - F.col("rb"))
    mean = c.groupBy("a", "b").agg(F.avg("g").alias("m"), F.count("*").alias("n"), F.stddev_samp("g").alias("s"), (F.count(F.when(F.col("g") > 0, 1)) / F.count("*")).alias("win_share"), (F.covar_samp("ra", "rb") / nz(F.stddev_samp("ra") * F.stddev_samp("rb"))).alias("correlation"))
    u = c.join(mean, ["a", "b"]).withColumn("u", F.col("g") - F.col("m"))
    w = W.partitionBy("a", "b").orderBy("bar_date")
    lag = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))))
    weighted = sum((F.when(F.lit(k) <= lag, 2 * (1 - k / (lag + 1)) * F.coalesce(F.col("u") * F.lag("u", k).over(w), F.lit(0.0))).otherwise(0.0) for k in range(2, 11)), 2 * (1 - 1 / (lag + 1)) * F.coalesce(F.col("u") * F.lag("u", 1).over(w), F.lit(0.0)))
    v = u.withColumn("p", F.col("u") * F.col("u") + weighted).groupBy("a", "b").agg(F.sum("p").alias("v"))
    out = mean.join(v, ["a", "b"]).join(counts, ["a", "b"])
    robust = F.when(F.col("v") > 0, F.col("m") * F.col("n") / F.sqrt("v"))
    return out.select("a", "b", F.col("n").alias("days"), "only_a", "only_b", F.col("m").alias("mean_gap"), (F.col("m") / nz(F.col("s")) * F.sqrt("n")).alias("naive_t"), robust.alias("robust_t"), "win_share", "correlation")


def sharpe_gap(pairs: DataFrame, curves: DataFrame, draws: int = 1000, mean: int = 21, least: int = 60, periods: float = 252, seed: int = 7) -> DataFrame:
    """Per pair of runs (a, b): the gap of their Sharpe ratios on their common days, with its 5 % and 95 % by a bootstrap that redraws both with the same
    blocks, and the share of draws in which a is ahead. Pairs of under ``least`` common days have none. ``curves``: run_id, bar_date, r.

    A pair is one task's two columns of days, so it is bounded by the days of a run.
    """
    x = pairs.join(curves.withColumnsRenamed({"run_id": "a", "r": "ra"}), "a")
    j = x.join(curves.withColumnsRenamed({"run_id": "b", "r": "rb"}), ["b", "bar_date"]).where("ra is not null and rb is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_date")
        a, b, n = pdf["a"].iloc[0], pdf["b"].iloc[0], len(pdf)
        columns = ["a", "b", "days", "gap", "p05", "p95", "ahead"]
        if n < least:
            return pd.DataFrame([(a, b, n, None, None, None, None)], columns=columns)
        both = pdf[["ra", "rb"]].to_numpy(float)

        def ratio(v: np.ndarray) -> np.ndarray:
            sd = v.std(axis=-2, ddof=1)
            return np.where(sd > 1e-12, v.mean(axis=-2) / np.maximum(sd, 1e-12), 0.0) * math.sqrt(periods)

        rng = np.random.default_rng(seed_of(seed, f"{a}|{b}"))
        gaps = np.concatenate([(s := ratio(both[stationary_indices(rng, n, min(BLOCK, draws - low), mean)]))[:, 0] - s[:, 1] for low in range(0, draws, BLOCK)])
        own = ratio(both)
        return pd.DataFrame([(a, b, n, float(own[0] - own[1]), *np.percentile(gaps, [5, 95]), float((gaps > 0).mean()))], columns=columns)

    return j.select("a", "b", "bar_date", "ra", "rb").groupBy("a", "b").applyInPandas(run, "a string, b string, days long, gap double, p05 double, p95 double, ahead double")


def mismatches(pairs: DataFrame, setups: DataFrame, fields: list[str]) -> DataFrame:
    """Which of the set-up's fields differ between the runs of a pair: a pair with any isn't to be compared. ``setups``: run_id and the fields."""
    x = pairs.join(setups.select(F.col("run_id").alias("a"), F.struct(*fields).alias("_x")), "a", "left").join(setups.select(F.col("run_id").alias("b"), F.struct(*fields).alias("_y")), "b", "left")
    differ = F.array_compact(F.array(*(F.when(~F.col("_x")[f].eqNullSafe(F.col("_y")[f]), f) for f in fields)))
    return x.select("a", "b", differ.alias("differ"), (F.size(differ) == 0).alias("comparable"))
