"""Portfolio weights from a matrix of returns (observations x assets)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEAST = 20


def equal(n: int) -> np.ndarray:
    return np.full(n, 1 / n)


def normal(w: np.ndarray) -> np.ndarray:
    s = w.sum()
    return w / s if np.isfinite(s) and abs(s) > 1e-12 else equal(len(w))


def shrunk(x: np.ndarray, intensity: float | None = None) -> np.ndarray:
    """Sample covariance shrunk to a diagonal of its mean variance; without an intensity by Ledoit and Wolf's."""
    cov = np.cov(x, rowvar=False, ddof=1).reshape(x.shape[1], -1)
    target = np.eye(len(cov)) * np.trace(cov) / len(cov)
    if intensity is None:
        z = x - x.mean(axis=0)
        spread = ((cov - target) ** 2).sum()
        noise = sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / len(z) ** 2
        intensity = min(1.0, noise / spread) if spread > 0 else 1.0
    return (1 - intensity) * cov + intensity * target


def solved(cov: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    try:
        if np.linalg.cond(cov) > 1e14:
            return None
        return normal(np.linalg.solve(cov, b))
    except np.linalg.LinAlgError:
        return None


def inverse_vol(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return normal(np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0))


def risk_parity(cov: np.ndarray, rounds: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Equal contributions to risk, by a damped multiplicative iteration."""
    w = inverse_vol(cov)
    for _ in range(rounds):
        part = w * (cov @ w)
        if (part <= 0).any():
            break
        new = normal(w * np.sqrt(part.mean() / part))
        done = np.abs(new - w).max() < tolerance
        w = new
        if done:
            break
    return w


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage, quasi-diagonal order, recursive bisection."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    distance = np.sqrt(np.maximum(0, (1 - np.clip(cov / np.outer(sd, sd), -1, 1)) / 2))
    groups = [[i] for i in range(len(cov))]
    while len(groups) > 1:
        best = min(((distance[np.ix_(a, b)].min(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda x: x)
        _, i, j = best
        groups = [*groups[:i], groups[i] + groups[j], *groups[i + 1 : j], *groups[j + 1 :]]
    w = np.ones(len(cov))

    def variance(idx: list[int]) -> float:
        part = cov[np.ix_(idx, idx)]
        v = inverse_vol(part)
        return float(v @ part @ v)

    todo = [groups[0]]
    while todo:
        order = todo.pop()
        if len(order) < 2:
            continue
        left, right = order[: len(order) // 2], order[len(order) // 2 :]
        a, b = variance(left), variance(right)
        share = 1 - a / (a + b) if a + b > 0 else 0.5
        w[left] *= share
        w[right] *= 1 - share
        todo += [left, right]
    return normal(w)


def capped(w: np.ndarray, most: float, rounds: int = 50) -> np.ndarray:
    """No weight above ``most``; the excess goes to the others in proportion. Equal weights where that can't be."""
    if most * len(w) < 1 - 1e-12:
        return equal(len(w))
    w = w.copy()
    for _ in range(rounds):
        over = w > most + 1e-12
        if not over.any():
            break
        excess = (w[over] - most).sum()
        w[over] = most
        rest = ~over & (w < most)
        base = w[rest].sum()
        w[rest] += excess * (w[rest] / base if base > 0 else 1 / max(rest.sum(), 1))
    return w


def weights(x: np.ndarray, objective: str, long_only: bool = True, most: float | None = None, shrinkage: float | None = None) -> np.ndarray:
    """Weights that sum to 1. One asset gets all; equal weights with under 20 observations or a singular problem."""
    n = x.shape[1]
    if n == 1:
        return np.ones(1)
    if len(x) < LEAST or not np.isfinite(x).all():
        return equal(n)
    cov = shrunk(x, shrinkage)
    if objective == "equal":
        w = equal(n)
    elif objective == "inverse_vol":
        w = inverse_vol(cov)
    elif objective == "risk_parity":
        w = risk_parity(cov)
    elif objective == "hrp":
        w = hierarchical(cov)
    elif objective in ("min_variance", "max_sharpe"):
        w = solved(cov, np.ones(n) if objective == "min_variance" else x.mean(axis=0))
        w = equal(n) if w is None else w
    else:
        raise ValueError(f"no such objective: {objective}")
    if long_only and (w < 0).any():
        w = np.maximum(w, 0)
        w = normal(w) if w.sum() > 0 else equal(n)
    return capped(w, most) if most else w


OBJECTIVES = ("equal", "inverse_vol", "min_variance", "max_sharpe", "risk_parity", "hrp")


def constructed(returns: DataFrame, group: str, asset: str, no: str, r: str, objectives: tuple[str, ...] = OBJECTIVES, most: float | None = None) -> DataFrame:
    """Weights per group (a rebalance) and objective; assets with a gap in the group's look-back are left out.

    ``returns`` holds the look-back rows of each group: a rebalance's universe times its look-back, so a group is bounded by both.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index=no, columns=asset, values=r).dropna(axis=1)
        if not x.shape[1]:
            return pd.DataFrame(columns=[group, "objective", asset, "weight"])
        rows = [(pdf[group].iloc[0], o, a, float(w)) for o in objectives for a, w in zip(x.columns, weights(x.to_numpy(float), o, most=most))]
        return pd.DataFrame(rows, columns=[group, "objective", asset, "weight"])

    return returns.select(group, asset, no, r).groupBy(group).applyInPandas(run, f"{group} string, objective string, {asset} string, weight double")
