"""Walk-forward folds, Monte Carlo and evaluation as grouped maps, phyla of signatures, and reports as text."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators.density import density_clusters


def walk_forward_splits(n_bars: int, train: int = 500, test: int = 200, step: int = 200, expanding: bool = True) -> list[tuple[int, int, int, int]]:
    """train_start, train_end, test_start, test_end (ends excluded) of the folds that fit."""
    return [(0 if expanding else t, t + train, t + train, t + train + test) for t in range(0, n_bars - train - test + 1, step)]


def cpcv_paths(blocks: int = 6, tests: int = 2) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    return [(t, tuple(b for b in range(blocks) if b not in t)) for t in itertools.combinations(range(blocks), tests)]


def purged(n: int, test: tuple[int, int], horizon: int = 10, embargo: int = 5) -> np.ndarray:
    """Training rows outside a test interval, its horizon before and the embargo on both sides."""
    i = np.arange(n)
    return i[(i < test[0] - horizon - embargo) | (i >= test[1] + embargo)]


def monte_carlo(returns: DataFrame, sims: int = 1000, block: int = 20, seed: int = 42) -> DataFrame:
    """symbol, name, value: figures of bootstrap paths of `returns` (symbol, timestamp, r). A symbol's returns are one task's."""

    def run(pdf):
        import pandas as pd

        out = kernels.monte_carlo(pdf.sort_values("timestamp")["r"].to_numpy(float), sims, block, seed)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "name": list(out), "value": list(out.values())})

    return returns.where("r is not null").groupBy("symbol").applyInPandas(run, "symbol string, name string, value double")


def evaluate(returns: DataFrame, blocks: int = 6, tests: int = 2, horizon: int = 10, embargo: int = 5) -> DataFrame:
    """symbol, path, n_train, n_test, train_sharpe, test_sharpe, deflated, passed: every combination of test blocks, training rows purged."""

    def run(pdf):
        import pandas as pd

        r = pdf.sort_values("timestamp")["r"].to_numpy(float)
        edges = np.linspace(0, len(r), blocks + 1).astype(int)
        rows = []
        for k, (test, _) in enumerate(cpcv_paths(blocks, tests)):
            train = np.arange(len(r))
            for b in test:
                train = np.intersect1d(train, purged(len(r), (edges[b], edges[b + 1]), horizon, embargo))
            y = np.concatenate([r[edges[b] : edges[b + 1]] for b in test])
            sharpe = lambda x: float(x.mean() / x.std(ddof=1)) if len(x) > 2 and x.std(ddof=1) > 0 else 0.0
            z = (y - y.mean()) / max(y.std(), 1e-12)
            skew, kurt = float((z**3).mean()), float((z**4).mean())
            s, trials = sharpe(y), len(cpcv_paths(blocks, tests))
            deflated = s - np.sqrt(2 * np.log(trials)) * np.sqrt(max(1 - skew * s + (kurt - 1) * s * s / 4, 0) / max(len(y), 1))
            rows.append((pdf["symbol"].iloc[0], k, len(train), len(y), sharpe(r[train]), s, float(deflated), bool(deflated > 0 and kernels.deflated_paths(y) > 0.5)))
        return pd.DataFrame(rows, columns=["symbol", "path", "n_train", "n_test", "train_sharpe", "test_sharpe", "deflated", "passed"])

    return returns.where("r is not null").groupBy("symbol").applyInPandas(run, "symbol string, path int, n_train int, n_test int, train_sharpe double, test_sharpe double, deflated double, passed boolean")


def phyla(signatures: DataFrame, columns: list[str], least: int = 4) -> DataFrame:
    """`signatures` (a row a symbol) with phylum: the density cluster of its columns, or noise."""
    return density_clusters(signatures, "symbol", columns, least)


def regime_flag(reversals: int, trends: int, volatility: float, calm: float = 0.01) -> str:
    """A label of the whole market from counts of signals."""
    if volatility < calm:
        return "quiet"
    return "mean_reverting" if reversals > trends else "trending"


def arrow(name: str, before: float, after: float) -> str:
    """Whether a figure got better; less is better for risks."""
    if after == before:
        return "="
    return "better" if (after < before) == (name in ("max_drawdown_size", "std", "var")) else "worse"


def comparison_report(rows: DataFrame, title: str = "Comparison") -> str:
    """Markdown of arms (arm, symbol and figures): a table of means and one of symbols."""
    pdf = rows.toPandas()  # two rows a symbol
    figures = [c for c in pdf.columns if c not in ("arm", "symbol")]
    arms = sorted(pdf["arm"].unique())
    mean = pdf.groupby("arm")[figures].mean()
    out = [f"# {title}", "", f"{pdf['symbol'].nunique()} symbols", "", "| figure | " + " | ".join(arms) + " | |", "|-" * (len(arms) + 2) + "|"]
    out += [f"| {f} | " + " | ".join(f"{mean.loc[a, f]:.4f}" for a in arms) + f" | {arrow(f, mean.loc[arms[0], f], mean.loc[arms[-1], f])} |" for f in figures]
    out += ["", "| symbol | arm | " + " | ".join(figures) + " |", "|-" * (len(figures) + 2) + "|"]
    out += [f"| {r.symbol} | {r.arm} | " + " | ".join(f"{getattr(r, f):.4f}" for f in figures) + " |" for r in pdf.sort_values(["symbol", "arm"]).itertuples()]
    return "\n".join(out) + "\n"


def health_report(rows: DataFrame) -> str:
    """HTML of health scores (symbol, n, gaps, outs, score, tier), the best and the worst first."""
    import html

    top, low = (rows.orderBy(o, "symbol").limit(10).collect() for o in (F.desc("score"), F.asc("score")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("a")).first()
    line = lambda r: f"<tr class='{r['tier']}'><td>{html.escape(r['symbol'])}</td><td>{r['score']}</td><td>{r['gaps']}</td></tr>"
    table = lambda name, rs: f"<h2>{name}</h2><table><tr><th>symbol</th><th>score</th><th>gaps</th></tr>{''.join(map(line, rs))}</table>"
    return f"<html><body><h1>{total['n']} symbols, average {total['a'] or 0:.1f}</h1>{table('Best', top)}{table('Worst', low)}</body></html>"
