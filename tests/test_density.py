"""Density clusters on tables against the tree written out for all pairs, and runs of many rows."""

import numpy as np
import pytest

from barloom.operators.density import Blocks, _cells, density_clusters, spanning_tree


def plain_clusters(x, least, samples):
    """Labels by thresholds: components of all pairs at each height, from the top down."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, min(samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core), d)

    def parts(rows, h):
        """Components of some rows by edges shorter than h."""
        left, out = np.zeros(n, bool), []
        left[rows] = True
        while left.any():
            seen = np.zeros(n, bool)
            new = np.arange(n) == int(np.argmax(left))
            while new.any():
                seen |= new
                new = (reach[new] < h).any(0) & left & ~seen
            left &= ~seen
            out.append(np.flatnonzero(seen))
        return out

    def joined(rows):
        """The height at which some rows become one component."""
        near, top = np.full(n, np.inf), 0.0
        near[rows] = reach[rows[0], rows]
        near[rows[0]] = np.inf
        for _ in range(len(rows) - 1):
            k = int(np.argmin(near))
            top = max(top, near[k])
            near = np.where(np.isfinite(near), np.minimum(near, reach[k]), np.inf)
            near[k] = np.inf
        return top

    def worth(rows, born, whole):
        gain, here = 0.0, rows
        while True:
            h = joined(here)
            lam = 1 / max(h, 1e-12)
            big = [p for p in parts(here, h) if len(p) >= least] if h > 0 else []
            if len(big) == 1:
                gain += (len(here) - len(big[0])) * (lam - born)
                here = big[0]
                continue
            gain += len(here) * (lam - born)
            if not big:
                return gain, [] if whole else [rows]
            below = [worth(p, lam, False) for p in big]
            total = sum(b[0] for b in below)
            return (total, [c for b in below for c in b[1]]) if total > gain or whole else (gain, [rows])

    label = np.full(n, -1)
    if n >= least:
        for c in worth(np.arange(n), 0.0, True)[1]:
            label[c] = min(c)
    return label


def made(kind, n, seed=4):
    g = np.random.default_rng(seed)
    if kind == "blobs":
        x = np.concatenate([g.normal(m, s, (n // 5, 3)) for m, s in ((0, 0.1), (1, 0.2), (3, 0.05), (3.4, 0.05))] + [g.uniform(-1, 5, (n - n // 5 * 4, 3))])
    elif kind == "ties":
        x = g.integers(0, 12, (n, 2)).astype(float)
    else:
        x = np.clip(g.normal(0.7, 0.2, (n, 8)), 0.58, 0.91).round(2)
        x[: n // 3] = x[0]
    return g.permutation(x)


@pytest.mark.parametrize(("kind", "n", "samples", "size", "band"), [("blobs", 500, 1, 64, 200), ("ties", 150, 1, 32, 40), ("clamped", 240, 2, 32, 1000), ("blobs", 200, 4, 30, 100)])
def test_same_as_all_pairs(spark, kind, n, samples, size, band):
    x = made(kind, n)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["k", *[f"c{j}" for j in range(x.shape[1])]])
    got = density_clusters(rows, "k", rows.columns[1:], 4, samples, size, band).toPandas().sort_values("k")
    want = plain_clusters(x, 4, samples)
    assert got["phylum"].tolist() == [f"phylum_{c}" if c >= 0 else "noise" for c in want]
    assert len(set(want)) > 2 or kind == "ties"


def test_odd_rows(spark):
    schema = "k string, a double, phylum_ string, x double"
    assert density_clusters(spark.createDataFrame([], schema), "k", ["a", "x"]).count() == 0
    few = [("a", 1.0, None, 2.0), ("b", None, "", 2.0), ("c", float("nan"), "", 1.0), ("d", float("inf"), "", 1.0)]
    assert {r["phylum"] for r in density_clusters(spark.createDataFrame(few, schema), "k", ["a", "x"]).collect()} == {"noise"}
    copies = [(f"r{i:03d}", float(i % 2), "", 0.0) for i in range(40)]
    got = density_clusters(spark.createDataFrame(copies, schema), "k", ["a", "x"]).collect()
    assert {(r["a"], r["phylum"]) for r in got} == {(0.0, "phylum_r000"), (1.0, "phylum_r001")}


def test_tree_length(spark):
    x = made("blobs", 700, 9)
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, x array<double>, w long")
    edges = spanning_tree(Blocks(points, 64)).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    inside, near, total = np.zeros(len(x), bool), d[0].copy(), 0.0
    inside[0] = True
    for _ in range(len(x) - 1):
        k = int(np.argmin(np.where(inside, np.inf, near)))
        total += near[k]
        inside[k] = True
        near = np.minimum(near, d[k])
    assert len(edges) == len(x) - 1 and edges["w"].sum() == pytest.approx(total)


def test_cells_of_repeated_values():
    x = np.zeros((1000, 2))
    x[600:, 0], x[:, 1] = np.arange(1, 401), np.linspace(0, 1, 1000)
    assert len(_cells(x, 16)) == 15


def test_tree_of_planes(spark):
    """Few values in one column, as of counts: components that are far from each other, and points far out; joined in rounds of few edges a task."""
    g = np.random.default_rng(3)
    x = np.column_stack([np.log(g.poisson(3, 2500) + 1.0), g.normal(0, 0.3, 2500), g.normal(0, 0.3, 2500)])
    x[:20] = g.uniform(-4, 4, (20, 3))
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, x array<double>, w long")
    edges = spanning_tree(Blocks(points, 64), 1, 40).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    inside, near, total = np.zeros(len(x), bool), d[0].copy(), []
    inside[0] = True
    for _ in range(len(x) - 1):
        k = int(np.argmin(np.where(inside, np.inf, near)))
        total.append(near[k])
        inside[k] = True
        near = np.minimum(near, d[k])
    assert np.allclose(np.sort(edges["w"]), np.sort(total), rtol=1e-12, atol=0)
