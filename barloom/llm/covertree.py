"""op2: exact cosine near-duplicates by a dual traversal of cover trees.

Vectors that are equal but for a power of two become one point with a count. Unit vectors at cosine
c are sqrt(2 - 2c) apart, so links are pairs within a radius. The top of the cover tree is a set of nested
nets with halving radii over a bounded sample (SAMPLE points, at most CELLS centres at the last level); every
point goes to the cell of its nearest centre, and a cell knows its covering radius. Pairs of cells further
apart than their radii and the threshold are pruned on the way down. What is left is dealt out as pairs of
blocks of at most about BLOCK points (a large cell is several blocks), and each task builds the lower levels for its
two blocks, traverses them together with the same bound and compares leaves in double precision (where single precision
does not show that all their pairs are below the threshold by more than its error). A pair whose unit vectors come within TIE of the threshold is decided by its own
vectors, not by those that division by the norms has rounded: dot product over the root of the product of their squares, so that a cosine of exactly 0.9 links.

A task returns, by point, how many rows it links to (counts, not pairs), and only the edges of a spanning forest.
Components come from those edges by distributed star rounds.

Vectors that are null, empty, zero or hold null or non-finite parts link with nothing: n_links 0, their own component.
Vectors of another length than the most common one are compared among themselves. Rows without a vec_id take no part and have no row. Repeated vec_ids count as
separate rows and get a row each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stash, table

COSINE, SAMPLE, CELLS, BLOCK, LEAF = 0.9, 4096, 256, 4096, 64
#: Slack of the bounds for rounding; the comparison itself has none.
SLACK = 1e-7
#: Cosines of rounded unit vectors this near the threshold are computed again from the vectors.
TIE = 1e-12


def scaled(rows: pa.Array) -> list:
    """Per row the vector in double precision, its largest part brought into [0.5, 1) by a power of two (which rounds nothing), or None if it is unusable."""
    out = []
    for v in rows:
        x = v.as_py()
        if not x or any(a is None for a in x):
            out.append(None)
            continue
        a = np.asarray(x, np.float64)
        top = np.abs(a).max()
        if not np.isfinite(a).all() or top == 0:
            out.append(None)
            continue
        up = -int(np.frexp(top)[1])
        out.append(np.ldexp(np.ldexp(a, up // 2), up - up // 2))
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / math.sqrt(float(v @ v))


def together(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two vectors link: one root of the product of their squares, so that what is exactly at the threshold stays there."""
    return float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)) >= COSINE


def unit_rows(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    def scale(batches):
        for b in batches:
            u = scaled(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else x.tobytes() for x in u], pa.binary())], names=["vec_id", "u"])

    return df.where(F.col(vec_id).isNotNull()).select(vec_id, embedding).mapInArrow(scale, "vec_id long, u binary")


def nets(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Nested nets of a cover tree with halving radii: each level's centres hold those before, are a radius apart and cover all points."""
    chosen, near, radius, levels = [0], np.linalg.norm(x - x[0], axis=1), 1.0, []
    while True:
        while near.max() > radius and len(chosen) < most:
            k = int(np.argmax(near))
            chosen.append(k)
            np.minimum(near, np.linalg.norm(x - x[k], axis=1), out=near)
        levels.append(np.array(chosen))
        if len(chosen) >= most or near.max() <= 1e-9 or radius < 0.05:
            return levels
        radius /= 2


class Node:
    """A subtree: its points, a centre that is one of them, and the covering radius."""

    __slots__ = ("at", "centre", "kids", "radius", "short")

    def __init__(self, x: np.ndarray, at: np.ndarray, depth: int = 0):
        self.at, self.centre = at, x[at[0]]
        d = np.linalg.norm(x[at] - self.centre, axis=1)
        self.radius, self.kids, self.short = float(d.max()), [], None
        if len(at) > LEAF and self.radius > 1e-9 and depth < 24:
            centres, near = [0], d
            of = np.zeros(len(at), int)
            while near.max() > self.radius / 2 and len(centres) < 16:
                k = int(np.argmax(near))
                e = np.linalg.norm(x[at] - x[at[k]], axis=1)
                up = e < near
                of[up], near = len(centres), np.minimum(near, e)
                centres.append(k)
            if len(centres) > 1:
                for i in range(len(centres)):
                    if (of == i).any():
                        own = at[of == i]
                        own[[0, np.flatnonzero(own == at[centres[i]])[0]]] = own[[np.flatnonzero(own == at[centres[i]])[0], 0]]
                        self.kids.append(Node(x, own, depth + 1))

    def single(self, x: np.ndarray) -> np.ndarray:
        """The points in single precision, kept for the next pair."""
        if self.short is None:
            self.short = x[self.at].astype(np.float32)
        return self.short


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def dual(a: Node, b: Node, x: np.ndarray, v: np.ndarray, w: np.ndarray, links: np.ndarray, forest: Forest, edges: list, reach: float) -> None:
    """Links between the points of two nodes; each pair once. Same node: pairs within it. x: the unit vectors of v."""
    todo, below = [(a, b)], COSINE - x.shape[1] * 2.0**-22 - SLACK  # more than single precision can be off for unit vectors
    while todo:
        a, b = todo.pop()
        if a is not b and float(np.linalg.norm(a.centre - b.centre)) > a.radius + b.radius + reach + SLACK:
            continue
        if not a.kids and not b.kids or len(a.at) * len(b.at) <= LEAF * LEAF * 4:
            if a is not b and (a.single(x) @ b.single(x).T).max() < below:
                continue
            cosine = x[a.at] @ x[b.at].T
            hit = cosine >= COSINE
            for p, q in zip(*np.nonzero(np.abs(cosine - COSINE) <= TIE), strict=True):
                hit[p, q] = together(v[a.at[p]], v[b.at[q]])
            if a is b:
                hit &= ~np.eye(len(a.at), dtype=bool)
            if not hit.any():
                continue
            links[a.at] += hit @ w[b.at]
            if a is not b:
                links[b.at] += w[a.at] @ hit
            i, j = np.nonzero(np.triu(hit) if a is b else hit)
            for p, q in zip(a.at[i].tolist(), b.at[j].tolist(), strict=True):
                if forest.join(p, q):
                    edges.append((p, q))
        elif a is b:
            todo += [(p, q) for k, p in enumerate(a.kids) for q in a.kids[k:]]
        elif not b.kids or a.kids and a.radius >= b.radius:
            todo += [(p, b) for p in a.kids]
        else:
            todo += [(a, q) for q in b.kids]


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    rows = stash(unit_rows(df, vec_id, embedding))
    good = rows.where("u is not null")
    # one point for equal vectors; its id is the smallest vec_id
    points = stash(good.groupBy("u").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")))
    reach = math.sqrt(2 - 2 * COSINE)
    blocks, replicas = _deal(points, reach)
    if blocks is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    else:
        found = stash(replicas.groupBy("task").applyInPandas(_compare(reach), "a long, b long, n long"))
    comp = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    by_point = stash(points.join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").select("u", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c")))
    return rows.join(by_point, "u", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("c", "vec_id")).alias("kept"))


def _deal(points: DataFrame, reach: float):
    """Points to cells and blocks, and each block to the tasks of its pairs. The driver holds a sample of SAMPLE points and figures of at most CELLS cells a vector length."""
    spark = points.sparkSession
    sizes = points.groupBy(F.length("u").alias("k")).count().collect()  # a row for each length of vectors
    if not sizes:
        return None, None
    tops = {}
    for r in sizes:
        sample = points.where(F.length("u") == r["k"]).select("u").orderBy(F.xxhash64("u"), "u").limit(SAMPLE).collect()
        x = np.stack([unit(np.frombuffer(s["u"], np.float64)) for s in sample])
        tops[r["k"]] = x[nets(x, min(CELLS, -(-r["count"] // BLOCK)))[-1]]
    top = spark.sparkContext.broadcast(tops)

    def cell(batches):
        for b in batches:
            out, dist, lens = [], [], []
            for u in b.column(1):
                v = unit(np.frombuffer(u.as_py(), np.float64))
                c = top.value[len(v) * 8]
                d = np.sqrt(np.maximum(2 - 2 * (c @ v), 0))
                k = int(np.argmin(d))
                out.append(k)
                dist.append(float(np.linalg.norm(c[k] - v)))
                lens.append(len(v) * 8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lens, pa.int64()), pa.array(out, pa.int64()), pa.array(dist, pa.float64())], names=["id", "u", "w", "k", "cell", "d"])

    placed = stash(points.select("id", "u", "w").mapInArrow(cell, "id long, u binary, w long, k long, cell long, d double"))
    figures = placed.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect()  # at most CELLS rows a length
    parts = {(f["k"], f["cell"]): -(-f["n"] // BLOCK) for f in figures}
    plan = []
    for k, c in tops.items():
        own = sorted((f["cell"], f["r"]) for f in figures if f["k"] == k)
        for i, (p, rp) in enumerate(own):
            for q, rq in own[i:]:
                if p == q or float(np.linalg.norm(c[p] - c[q])) <= rp + rq + reach + SLACK:
                    plan.append((k, p, q))
    partner = [(k, p, q, parts[k, p], parts[k, q], p <= q) for k, a, b in plan for p, q in ({(a, b), (b, a)})]
    plan_df = spark.createDataFrame(partner, "k long, cell long, other long, n_own long, n_other long, first boolean")
    own_block = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("n_own"))
    j = placed.join(F.broadcast(plan_df), ["k", "cell"]).withColumn("own", own_block)  # at most CELLS * CELLS rows a length
    j = j.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_other") - 1)))
    same = F.col("cell") == F.col("other")
    j = j.select("id", "u", "w", "k", F.struct("cell", "own").alias("me"), F.struct(F.col("other").alias("cell"), F.col("theirs").alias("own")).alias("you"), same.alias("same"))
    task = F.struct("k", F.least("me", "you").alias("lo"), F.greatest("me", "you").alias("hi"))
    return True, j.select("id", "u", "w", task.alias("task"), (F.col("me") == F.least("me", "you")).alias("left"))


def _compare(reach: float):
    def run(pdf):
        import pandas as pd

        lo, hi = pdf["task"].iloc[0]["lo"], pdf["task"].iloc[0]["hi"]
        same = lo == hi
        pdf = pdf.sort_values(["left", "id"], ascending=[False, True])
        ids, w = pdf["id"].to_numpy(), pdf["w"].to_numpy()
        v = np.stack([np.frombuffer(u, np.float64) for u in pdf["u"]])
        x = v / np.sqrt((v * v).sum(axis=1))[:, None]
        left = np.flatnonzero(pdf["left"].to_numpy())
        right = np.flatnonzero(~pdf["left"].to_numpy())
        links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        if same:
            n = Node(x, left)
            dual(n, n, x, v, w, links, forest, edges, reach)
        elif len(left) and len(right):
            dual(Node(x, left), Node(x, right), x, v, w, links, forest, edges, reach)
        some = np.flatnonzero(links)
        a = [*ids[some], *(ids[p] for p, _ in edges)]
        b = [*[None] * len(some), *(ids[q] for _, q in edges)]
        n = [*links[some], *[0] * len(edges)]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": pd.array(b, "Int64"), "n": np.array(n, np.int64)})

    return run


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
