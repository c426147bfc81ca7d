"""Kernels that need a recursion, a transform or a factorisation: numpy over one symbol's series (oldest first).

Each takes the arrays of a symbol's columns and returns one number. All asked for run in one grouped map, a symbol a group, over the last TAIL bars:
the longest window that any of them has, so no value depends on bars before, and a group is bounded however long the history is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TAIL = 512


def log_returns(close: np.ndarray) -> np.ndarray:
    return np.diff(np.log(np.maximum(close, 1e-12)))


def garch(r: np.ndarray, omega: float = 1e-6, alpha: float = 0.1, beta: float = 0.85) -> float:
    """Volatility after the GARCH(1,1) recursion, seeded with the mean square."""
    v = float(np.mean(r * r)) if len(r) else math.nan
    for x in r:
        v = omega + alpha * x * x + beta * v
    return math.sqrt(v)


def hurst(r: np.ndarray) -> float:
    """Rescaled range of one window."""
    s = r.std(ddof=1)
    if len(r) < 10 or s == 0:
        return 0.5
    d = np.cumsum(r - r.mean())
    return float(np.clip(math.log((d.max() - d.min()) / s) / math.log(len(r)), 0, 1))


def huber_mean(r: np.ndarray, c: float = 1.345) -> float:
    """Mean with weights that fall off beyond c scales; the scale is that of the deviations from the median, once."""
    m = float(np.median(r))
    scale = 1.4826 * np.median(np.abs(r - m)) + 1e-12
    for _ in range(10):
        w = np.minimum(1, c / np.maximum(np.abs(r - m) / scale, 1e-12))
        new = float((w * r).sum() / w.sum())
        if abs(new - m) < 1e-8:
            return new
        m = new
    return m


def dfa(r: np.ndarray) -> float:
    """Fluctuation of the detrended profile in boxes of a quarter."""
    y, n = np.cumsum(r - r.mean()), max(len(r) // 4, 4)
    t = np.arange(n)
    parts = [y[i : i + n] for i in range(0, len(y) - n + 1, n)]
    return float(math.sqrt(np.mean([np.mean((p - np.polyval(np.polyfit(t, p, 1), t)) ** 2) for p in parts]))) if parts else math.nan


def dominant_period(v: np.ndarray) -> float:
    """Period of the strongest frequency."""
    power = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2
    return float(len(v) / (1 + int(np.argmax(power)))) if len(power) else math.nan


def haar_orthogonality(v: np.ndarray, levels: int = 3) -> float:
    """1 - n sum (share - 1/n)^2 of the energies of a Haar pyramid."""
    energy = []
    for _ in range(levels):
        v = v[: len(v) // 2 * 2]
        energy.append(float(((v[::2] - v[1::2]) ** 2).sum() / 4))
        v = (v[::2] + v[1::2]) / 2
    e = np.array(energy) / max(sum(energy), 1e-12)
    return float(np.clip(1 - levels * ((e - 1 / levels) ** 2).sum(), 0, 1))


def kalman_beta(x: np.ndarray, y: np.ndarray, q: float = 1e-5, noise: float = 1e-2) -> float:
    """Last slope of a two-state filter of y on x."""
    b, p = np.zeros(2), np.eye(2)
    for u, v in zip(x, y, strict=True):
        h = np.array([1.0, u])
        p = p + q * np.eye(2)
        k = p @ h / (h @ p @ h + noise)
        b = b + k * (v - h @ b)
        p = p - np.outer(k, h) @ p
    return float(b[1])


def kalman_ar(r: np.ndarray, order: int = 2, q: float = 1e-5, noise: float = 1e-3) -> float:
    """Sum of absolute coefficients of an autoregression whose coefficients drift: least squares to start with, then a filter."""
    if len(r) < 4 * order:
        return math.nan
    x = np.stack([r[order - k - 1 : len(r) - k - 1] for k in range(order)], 1)
    y = r[order:]
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    p = np.eye(order)
    for h, v in zip(x, y, strict=True):
        p = p + q * np.eye(order)
        k = p @ h / (h @ p @ h + noise)
        b = b + k * (v - h @ b)
        p = p - np.outer(k, h) @ p
    return float(np.abs(b).sum())


def volume_poc(close: np.ndarray, volume: np.ndarray, levels: int = 50) -> float:
    """Price with the highest Gaussian kernel density of volume."""
    h = max(close.std(ddof=1) * len(close) ** -0.2, 1e-9)
    at = np.linspace(close.min(), close.max(), levels)
    return float(at[np.argmax((volume * np.exp(-0.5 * ((at[:, None] - close) / h) ** 2)).sum(1))])


def svd_share(cols: np.ndarray) -> float:
    """Share of the first singular direction of standardised columns."""
    z = (cols - cols.mean(0)) / (cols.std(0) + 1e-12)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    return float(s[0] / max(s.sum(), 1e-12))


def hull(close: np.ndarray, n: int = 16) -> float:
    def wma(x, k):
        w = np.arange(1, k + 1)
        return np.convolve(x, w[::-1], "valid") / w.sum()

    a, b = wma(close, n // 2), wma(close, n)
    return float(wma(2 * a[-len(b) :] - b, int(math.sqrt(n)))[-1]) if len(b) >= int(math.sqrt(n)) else math.nan


def bootstrap_sharpe(r: np.ndarray, sims: int = 200, block: int = 20, seed: int = 42) -> float:
    """Median annual Sharpe ratio over block bootstraps (single draws under two blocks)."""
    g, n = np.random.default_rng(seed), len(r)
    block = block if n >= 2 * block else 1
    at = g.integers(0, n - block + 1, (sims, -(-n // block)))
    x = r[(at[:, :, None] + np.arange(block)).reshape(sims, -1)[:, :n]]
    return float(np.median(x.mean(1) / np.maximum(x.std(1, ddof=1), 1e-12)) * math.sqrt(8760))


def polynomial_forecast(close: np.ndarray, window: int = 60) -> float:
    """Next value by a ridge polynomial in time of the degree (1 to 3) with the least error plus 0.05 AIC."""
    y = close[-window:]
    t = np.linspace(-1, 1, len(y))
    best = (math.inf, math.nan)
    for d in (1, 2, 3):
        x = np.vander(t, d + 1)
        b = np.linalg.solve(x.T @ x + 1e-8 * np.eye(d + 1), x.T @ y)
        mse = float(np.mean((y - x @ b) ** 2))
        score = mse + 0.05 * (len(y) * math.log(mse + 1e-12) + 2 * (d + 1))
        if score < best[0]:
            best = (score, float(np.vander([1 + t[1] - t[0]], d + 1)[0] @ b))
    return best[1]


def cycle_lookback(close: np.ndarray, window: int = 400, alpha: float = 0.5, lo: int = 12, hi: int = 168) -> float:
    """A share of the strongest period of the tapered closes."""
    x = close[-window:]
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x))))[1:] ** 2
    return float(np.clip(round(alpha * len(x) / (1 + int(np.argmax(power)))), lo, hi))


def price_cluster(close: np.ndarray, volume: np.ndarray, window: int = 100, least: int = 5, scale: float = 0.1) -> float:
    """Median close of the cluster (closes without a gap) with the most volume, among bars of more than median volume."""
    c, v = close[-window - 1 : -1], volume[-window - 1 : -1]
    some = v > np.median(v)
    c, v = c[some], v[some]
    if not len(c):
        return float(close[-1])
    order = np.argsort(c, kind="stable")
    c, v = c[order], v[order]
    cut = np.flatnonzero(np.diff(c) > scale * c.std()) + 1
    parts = [(p, w) for p, w in zip(np.split(c, cut), np.split(v, cut), strict=True) if len(p) >= least]
    return float(np.median(max(parts, key=lambda x: x[1].sum())[0])) if parts else float(np.median(c))


def low_pass(close: np.ndarray, window: int = 128, bins: int = 10) -> float:
    """Last value of the prior bars' lowest frequencies."""
    x = close[-window - 1 : -1]
    f = np.fft.rfft((x - x.mean()) * np.hanning(len(x)))
    f[bins:] = 0
    return float(np.fft.irfft(f, len(x))[-1] + x.mean())


#: Scaling filter of the Daubechies wavelet with four vanishing moments.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def wavelet_trend(close: np.ndarray, levels: int = 3) -> float:
    """Trend of the prior bars: a causal low-pass filter a level, its taps twice as far apart each time."""
    x, h = close[:-1], np.array(DB4) / math.sqrt(2)
    for level in range(levels):
        at = np.arange(len(x))[:, None] - (1 << level) * np.arange(len(h))
        x = x[np.maximum(at, 0)] @ h
    return float(x[-1])


def bridge_fill(close: np.ndarray, theta: float = 0.1, sigma: float = 0.1, seed: int = 42) -> float:
    """Mean of the series after its gaps (nulls) are filled by a mean-reverting walk from the bar before."""
    x, g = close.copy(), np.random.RandomState(seed)
    mu, s = np.nanmean(x), np.nanstd(x) * sigma
    for i in np.flatnonzero(np.isnan(x)):
        last = x[i - 1] if i else mu
        x[i] = last + theta * (mu - last) + s * g.standard_normal()
    return float(x.mean())


def distance_correlation(a: np.ndarray, b: np.ndarray, window: int = 24) -> float:
    def centred(v):
        d = np.abs(v[:, None] - v)
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    x, y = centred(a[-window:]), centred(b[-window:])
    var = math.sqrt(max(float((x * x).mean() * (y * y).mean()), 0))
    return math.sqrt(max(float((x * y).mean()), 0) / var) if var > 0 else 0.0


def standard(cols: np.ndarray) -> np.ndarray:
    return (cols - cols.mean(0)) / (cols.std(0) + 1e-12)


def weighted_pca(cols: np.ndarray, window: int = 100) -> float:
    """Last bar on the first principal axis of columns weighted by the entropy of their histograms."""
    z = standard(cols[-window:])
    share = [np.histogram(c, 10)[0] / len(c) for c in z.T]
    w = np.array([-(p[p > 0] * np.log(p[p > 0])).sum() for p in share])
    z = z * (w / max(w.sum(), 1e-12))
    axis = np.linalg.svd(z, full_matrices=False)[2][0]
    return float(z[-1] @ (axis * np.sign(axis[np.argmax(np.abs(axis))])))


def phase_shift(a: np.ndarray, b: np.ndarray, most: int = 50) -> float:
    """Lag at which the standardised series differ least."""
    x, y = standard(a), standard(b)
    cost = {}
    for k in range(-min(most, len(x) - 10), min(most, len(x) - 10) + 1):
        p, q = (x[k:], y[: len(y) - k]) if k >= 0 else (x[:k], y[-k:])
        cost[k] = float(np.mean((p - q) ** 2))
    return float(min(cost, key=lambda k: (round(cost[k], 12), abs(k))))


def gumbel_copula(a: np.ndarray, b: np.ndarray, window: int = 100) -> float:
    """Copula of the last bar's ranks; the dependence follows from Kendall's tau."""
    x, y = a[-window:], b[-window:]
    n = len(x)
    u, v = ((s <= s[-1]).mean() * n / (n + 1) for s in (x, y))
    i, j = np.triu_indices(n, 1)
    tau = float(np.mean(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])))
    theta = 1 / (1 - np.clip(tau, 0.0, 0.95))
    return float(np.exp(-(((-np.log(u)) ** theta + (-np.log(v)) ** theta) ** (1 / theta))))


def oas(s: np.ndarray, n: int) -> float:
    """Oracle approximating shrinkage towards the mean variance."""
    p, t, t2 = len(s), np.trace(s), np.trace(s @ s)
    low = (n + 1 - 2 / p) * (t2 - t * t / p)
    return float(np.clip(((1 - 2 / p) * t2 + t * t) / low, 0, 1)) if low > 0 else 1.0


def shrinkage(cols: np.ndarray, window: int = 100) -> float:
    x = cols[-window:]
    return oas(np.cov(x.T), len(x))


def dcc_garch(r: np.ndarray, m: np.ndarray, window: int = 50, a: float = 0.05, b: float = 0.9) -> float:
    """GARCH volatility raised by a fifth of the dynamic correlation with another series, which is shrunk."""
    x, y = r[-window:], m[-window:]
    z = standard(np.stack([x, y], 1))
    mean = np.corrcoef(z.T)[0, 1].clip(-0.9, 0.9)
    long = np.array([[1, mean], [mean, 1]])
    q = long.copy()
    for e in z[:-1]:
        q = (1 - a - b) * long + a * np.outer(e, e) + b * q
    rho = oas(q, len(x))
    q = (1 - rho) * q + rho * np.eye(2)
    return garch(x) * (1 + 0.2 * abs(np.clip(q[0, 1] / math.sqrt(q[0, 0] * q[1, 1] + 1e-12), -0.9, 0.9)))


def pca_share(cols: np.ndarray, k: int = 2) -> float:
    """Share of the variance on the first k principal axes."""
    s = np.linalg.svd(standard(cols), compute_uv=False) ** 2
    return float(s[:k].sum() / max(s.sum(), 1e-12))


def network_edges(rho: np.ndarray, least: float = 0.5) -> int:
    """Edges of the minimum spanning tree by 2 (1 - |rho|), and those of at least `least` besides."""
    d, n = 2 * (1 - np.abs(rho)), len(rho)
    inside, edges = {0}, set()
    while len(inside) < n:
        i, j = min(((i, j) for i in inside for j in range(n) if j not in inside), key=lambda e: d[e])
        inside.add(j)
        edges.add((min(i, j), max(i, j)))
    return len(edges | {(i, j) for i in range(n) for j in range(i + 1, n) if abs(rho[i, j]) >= least})


def mahalanobis(cols: np.ndarray) -> float:
    """Squared distance of the last two rows."""
    d = cols[-1] - cols[-2]
    return float(d @ np.linalg.solve(np.atleast_2d(np.cov(cols.T)) + 1e-6 * np.eye(cols.shape[1]), d))


def loess(x: np.ndarray, y: np.ndarray, at: float, span: float = 0.3) -> float:
    """Local line at a place; weights (1 - u)^3 of the nearest share of the points."""
    d = np.abs(x - at)
    h = max(float(np.quantile(d, span)), 1e-12)
    w = np.clip(1 - d / h, 0, None) ** 3
    a = np.stack([np.ones_like(x), x - at], 1)
    return float(np.linalg.solve((a * w[:, None]).T @ a + 1e-8 * np.eye(2), (a * w[:, None]).T @ y)[0])


def soft_state(cols: np.ndarray, k: int = 3, rounds: int = 50, seed: int = 42) -> float:
    """Largest membership of the last row, by inverse distances to k means."""
    z, g = standard(cols), np.random.RandomState(seed)
    centres = z[g.choice(len(z), k, replace=False)]
    for _ in range(rounds):
        of = np.argmin(((z[:, None] - centres) ** 2).sum(2), 1)
        new = np.stack([z[of == c].mean(0) if (of == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    w = 1 / (np.linalg.norm(z[-1] - centres, axis=1) + 1e-6)
    return float((w / w.sum()).max())


def paths_of(r: np.ndarray, sims: int, block: int, seed: int) -> np.ndarray:
    """Block bootstraps of a series (single draws under two blocks), a row each."""
    g, n = np.random.default_rng(seed), len(r)
    block = block if n >= 2 * block else 1
    at = g.integers(0, n - block + 1, (sims, -(-n // block)))
    return r[(at[:, :, None] + np.arange(block)).reshape(sims, -1)[:, :n]]


def deflated_paths(r: np.ndarray, sims: int = 200, trials: int = 100, block: int = 20, seed: int = 42) -> float:
    """Share of bootstrap paths whose Sharpe ratio, less what the best of many trials has by chance, is above 0."""
    x = paths_of(r, sims, block, seed)
    z = (x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, keepdims=True), 1e-12)
    sr, skew, kurt = x.mean(1) / np.maximum(x.std(1, ddof=1), 1e-12), (z**3).mean(1), (z**4).mean(1)
    low = math.sqrt(2 * math.log(trials)) * np.sqrt(np.maximum(1 - skew * sr + (kurt - 1) * sr * sr / 4, 0) / len(r))
    return float((sr - low > 0).mean())


def monte_carlo(r: np.ndarray, sims: int = 1000, block: int = 20, seed: int = 42, level: float = 0.95) -> dict[str, float]:
    """Mean, deviation and interval of the metrics of bootstrap paths."""
    x = paths_of(r, sims, block, seed)
    curve = np.cumprod(1 + x, axis=1)
    down = np.where(x < 0, x, np.nan)
    figures = {
        "sharpe": x.mean(1) / np.maximum(x.std(1, ddof=1), 1e-12) * math.sqrt(8760),
        "total_return": curve[:, -1] - 1,
        "max_drawdown": (curve / np.maximum.accumulate(curve, 1) - 1).min(1),
        "sortino": x.mean(1) / np.maximum(np.nan_to_num(np.nanstd(down, axis=1, ddof=1) if (x < 0).sum(1).min() > 1 else x.std(1)), 1e-12) * math.sqrt(8760),
    }
    a = (1 - level) / 2
    return {f"{n}_{k}": float(v) for n, f in figures.items() for k, v in (("mean", f.mean()), ("std", f.std()), ("low", np.quantile(f, a)), ("high", np.quantile(f, 1 - a)), ("positive", (f > 0).mean()))}


def sharpe_difference(a: np.ndarray, b: np.ndarray, sims: int = 1000, seed: int = 42) -> dict[str, float]:
    """Difference of two annual Sharpe ratios under resampling: how likely it is above 0, and its interval."""
    g, n = np.random.default_rng(seed), min(len(a), len(b))
    sharpe = lambda x: np.where(x.std(-1) < 1e-12, 0.0, x.mean(-1) / np.maximum(x.std(-1), 1e-12) * math.sqrt(8760))
    d = sharpe(a[g.integers(0, n, (sims, n))]) - sharpe(b[g.integers(0, n, (sims, n))])
    return {"difference": float(sharpe(a[:n]) - sharpe(b[:n])), "likely": float((d > 0).mean()), "low": float(np.percentile(d, 2.5)), "high": float(np.percentile(d, 97.5))}


def min_variance(cov: np.ndarray, lo: float = 0.0, hi: float = 0.3) -> np.ndarray:
    w = np.linalg.solve(cov + 1e-10 * np.eye(len(cov)), np.ones(len(cov)))
    w = np.clip(w / w.sum(), lo, hi)
    return w / max(w.sum(), 1e-12)


def density_clusters(x: np.ndarray, least: int = 4) -> np.ndarray:
    """Cluster of each row, -1 for noise: single linkage by mutual reachability (first neighbours), the tree condensed at
    clusters of `least` rows, and those kept that are stable for longer than what they split into."""
    n = len(x)
    label = np.full(n, -1)
    if n < 2 * least:
        return label
    d = np.linalg.norm(x[:, None] - x, axis=2)
    core = np.sort(d, 1)[:, 1]
    reach = np.maximum(np.maximum(core[:, None], core), d)
    near, of, inside = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0], edges = True, []
    for _ in range(n - 1):
        k = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((near[k], of[k], k))
        inside[k] = True
        up = reach[k] < near
        near[up], of[up] = reach[k][up], k
    kids, members, height, top = {}, {i: [i] for i in range(n)}, {}, list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for w, i, j in sorted(edges, key=lambda e: e[0]):
        a, b = find(int(i)), find(int(j))
        c = len(top)
        top.append(c)
        top[a] = top[b] = c
        kids[c], members[c], height[c] = (a, b), members[a] + members[b], max(float(w), 1e-12)

    def chosen(c, born):
        """Stability of the cluster, and the clusters that it is worth."""
        gain, here = 0.0, c
        while here in kids:
            a, b = kids[here]
            big = [k for k in (a, b) if len(members[k]) >= least]
            lam = 1 / height[here]
            if len(big) == 2:
                gain += len(members[here]) * (lam - born)
                parts = [chosen(k, lam) for k in big]
                below = sum(p[0] for p in parts)
                return (below, [x for p in parts for x in p[1]]) if below > gain or c == len(top) - 1 else (gain, [c])
            gain += (len(members[here]) - sum(len(members[k]) for k in big)) * (lam - born)
            if not big:
                return gain, [c]
            here = big[0]
        return gain, [c]

    found = [c for c in chosen(len(top) - 1, 0.0)[1] if c != len(top) - 1]
    for k, c in enumerate(found):
        label[members[c]] = k
    return label


def normalised(cols: np.ndarray, clip: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns as a predictor takes them: standardised and clipped; mean and deviation to turn its answer back."""
    if np.isnan(cols).any():
        raise ValueError("a predictor's input has no nulls")
    mean, std = cols.mean(0), cols.std(0)
    return np.clip((cols - mean) / (std + 1e-5), -clip, clip), mean, std


def restored(z: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return z * (std + 1e-5) + mean


def sampled(logits: np.ndarray, k: int = 0, p: float = 1.0, temperature: float = 1.0, seed: int = 42) -> int:
    """A draw from the k likeliest tokens, or the fewest whose probabilities reach p."""
    z = logits / max(temperature, 1e-6)
    if k:
        z = np.where(z >= np.sort(z)[-min(k, len(z))], z, -np.inf)
    order = np.argsort(-z, kind="stable")
    w = np.exp(z[order] - z[order[0]])
    w /= w.sum()
    w[1:][np.cumsum(w)[:-1] >= p] = 0
    return int(np.random.default_rng(seed).choice(order, p=w / w.sum()))


def sign_tokens(z: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Two token ids a row: the signs of the first `split` columns as bits, and those of the others."""
    bits = (z > 0).astype(np.int64)
    code = lambda b: b @ (1 << np.arange(b.shape[1]))
    return code(bits[:, :split]), code(bits[:, split:])


def token_signs(first: np.ndarray, second: np.ndarray, split: int, width: int) -> np.ndarray:
    """Unit vectors of the signs of two token ids."""
    bits = np.concatenate([(first[:, None] >> np.arange(split)) & 1, (second[:, None] >> np.arange(width - split)) & 1], axis=1)
    return (2 * bits - 1) / math.sqrt(width)


_COLS = ("close", "volume", "quote_volume")

KERNELS = {
    "garch": lambda d: garch(log_returns(d.close)),
    "hurst": lambda d: hurst(log_returns(d.close)),
    "huber_mean": lambda d: huber_mean(log_returns(d.close)[-50:]),
    "dfa": lambda d: dfa(log_returns(d.close)),
    "dominant_period": lambda d: dominant_period(d.volume),
    "haar_orthogonality": lambda d: haar_orthogonality(d.close),
    "kalman_ar": lambda d: kalman_ar(log_returns(d.close)),
    "kalman_beta": lambda d: kalman_beta(log_returns(d.volume), log_returns(d.close)),
    "volume_poc": lambda d: volume_poc(d.close, d.volume),
    "svd_share": lambda d: svd_share(d.cols()),
    "hull_average": lambda d: hull(d.close),
    "bootstrap_sharpe": lambda d: bootstrap_sharpe(log_returns(d.close)),
    "polynomial_forecast": lambda d: polynomial_forecast(d.close),
    "cycle_lookback": lambda d: cycle_lookback(d.close),
    "price_cluster": lambda d: price_cluster(d.close, d.volume),
    "low_pass": lambda d: low_pass(d.close),
    "wavelet_trend": lambda d: wavelet_trend(d.close),
    "bridge_fill": lambda d: bridge_fill(np.where(d.volume < np.quantile(d.volume, 0.1), np.nan, d.close)),
    "distance_correlation": lambda d: distance_correlation(d.close, d.volume),
    "weighted_pca": lambda d: weighted_pca(d.cols()),
    "phase_shift": lambda d: phase_shift(d.close, d.volume),
    "gumbel_copula": lambda d: gumbel_copula(log_returns(d.close), d.volume[1:]),
    "shrinkage": lambda d: shrinkage(d.cols()),
    "dcc_garch": lambda d: dcc_garch(log_returns(d.close), log_returns(d.volume)),
    "pca_share": lambda d: pca_share(d.cols()),
    "network_edges": lambda d: float(network_edges(np.corrcoef(d.cols()[-50:].T))),
    "mahalanobis": lambda d: mahalanobis(d.cols()),
    "loess": lambda d: loess(np.arange(len(d.close), dtype=float), d.close, len(d.close) - 1.0),
    "soft_state": lambda d: soft_state(d.cols()),
    "deflated_paths": lambda d: deflated_paths(np.expm1(np.clip(log_returns(d.close), -5, 5)) / 100),
    "min_variance_weight": lambda d: float(min_variance(np.cov(standard(d.cols()[-100:]).T), 0.0, 1.0)[0]),
}
for _name in ("sharpe", "total_return", "max_drawdown", "sortino"):
    KERNELS[f"monte_carlo_{_name}"] = lambda d, n=_name: monte_carlo(np.expm1(np.clip(log_returns(d.close), -5, 5)) / 100, 200)[f"{n}_mean"]
KERNELS["sharpe_likely_better"] = lambda d: sharpe_difference(log_returns(d.close) / 100, log_returns(d.close) / 100 - 0.00013, 200)["likely"]


class Series:
    def __init__(self, pdf: pd.DataFrame):
        for c in _COLS:
            setattr(self, c, pdf[c].to_numpy(float))

    def cols(self) -> np.ndarray:
        return np.stack([getattr(self, c) for c in _COLS], 1)


def by_symbol(bars: DataFrame, names: list[str], least: int = 20) -> DataFrame:
    """symbol, name and value of some kernels on every symbol's last TAIL bars; null under `least` bars."""
    last = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    tail = bars.select("symbol", "timestamp", "close", "volume", "quote_volume").where("close is not null").withColumn("k", F.row_number().over(last)).where(F.col("k") <= TAIL)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        values = [KERNELS[n](Series(pdf)) if len(pdf) >= least else None for n in names]
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "name": names, "value": values})

    return tail.groupBy("symbol").applyInPandas(run, "symbol string, name string, value double")
