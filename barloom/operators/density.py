"""Density clusters of vectors on tables: a spanning tree by mutual reachability, grown in rounds, and its condensed tree.

Equal vectors are one point with a weight. Points lie in blocks of some hundred near ones, each with a box around it. A task takes in a block and the points around its box and finds the shortest
tree of these; an edge that is shorter than the way to any point further away, from one of the two components that it joins, is in the whole tree. What these edges leave apart, mostly a few large
components and points far out, is joined in rounds: every component but the largest looks for its shortest edge to another one, first to points of near blocks, which gives a bound, then in the blocks
whose boxes are nearer than that and hold other components. There are at most log2(n) rounds.

The tree's edges are then taken by length: in groups of near blocks at once, each component up to the first edge that leaves the group, the others in bands of bounded size. A component carries a
state of fixed size (its points only while there are fewer than `least`), so a band's task holds its edges and the states at their ends. Edges of one length are one split into many parts, in whatever
order and bands they come.

What the driver holds is bounded: a sample of SAMPLE points, from which blocks are made, and a box and a point for each of at most BLOCKS blocks.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, BLOCKS = 20_000, 2048
#: Heights below this are taken as this: the density of equal vectors is finite.
LEAST_HEIGHT = 1e-12


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder (spark.checkpoint.dir) and read back, so that later rounds neither compute it again nor carry its plan and the sizes guessed from it. The caller deletes that folder."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        d = sc.getCheckpointDir()
    path = f"{d.rstrip('/')}/density-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(d)


def _cells(sample: np.ndarray, leaves: int) -> list[tuple]:
    """Cuts of the widest column at its middle, largest part first: (column, value, left, right), where a part that is no cut is -1 - its cell."""
    parts, cuts, where = [sample], [], [None]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: len(parts[i]))
        p = parts[k]
        if len(p) < 2 or (p == p[0]).all():
            break
        column = int(np.argmax(p.max(0) - p.min(0)))
        value = float(np.median(p[:, column]))
        if value == p[:, column].min():
            # half of the part has its least value: that is one side
            value = float(p[p[:, column] > value, column].min())
        left = p[:, column] < value
        cuts.append([column, value, -1 - k, -1 - len(parts)])
        if where[k] is not None:
            cuts[where[k][0]][where[k][1]] = len(cuts) - 1
        where[k] = (len(cuts) - 1, 2)
        where.append((len(cuts) - 1, 3))
        parts[k] = p[left]
        parts.append(p[~left])
    return [tuple(c) for c in cuts]


def _placed(x: np.ndarray, cuts: list[tuple]) -> np.ndarray:
    """The cell of each point."""
    if not cuts:
        return np.zeros(len(x), int)
    at, table = np.zeros(len(x), int), np.array(cuts)
    while len(here := np.flatnonzero(at >= 0)):
        c = at[here]
        at[here] = np.where(x[here, table[c, 0].astype(int)] < table[c, 1], table[c, 2], table[c, 3]).astype(int)
    return -1 - at


def _gap(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How far points are from boxes; of either there may be one."""
    return np.sqrt((np.maximum(np.maximum(lo - x, x - hi), 0) ** 2).sum(-1))


def _matrix(column) -> np.ndarray:
    return np.concatenate([np.asarray(v, float) for v in column]).reshape(len(column), -1)


class Blocks:
    """points: id, x (array of doubles), w. Written once, with the block of each point."""

    def __init__(self, points: DataFrame, size: int = 256):
        self.spark = points.sparkSession
        self.n = points.count()
        sample = points.orderBy(F.xxhash64("x")).limit(SAMPLE).select("x").toPandas()["x"]
        cuts = _cells(_matrix(sample), min(BLOCKS // 2, -(-self.n // size))) if self.n else []
        most = max(size, 2 * -(-self.n // (BLOCKS // 2)))

        def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    yield pdf.assign(cell=_placed(_matrix(pdf["x"]), cuts))

        cells = points.select("id", "x", "w").mapInPandas(placed, "id long, x array<double>, w long, cell long")
        nth = F.row_number().over(Window.partitionBy("cell").orderBy("id")) - 1
        self.points = cut(cells.withColumn("block", F.concat_ws("-", "cell", F.floor(nth / most))).drop("cell"))
        d = len(sample.iloc[0]) if self.n else 0
        box = [F.min(F.col("x")[k]).alias(f"lo{k}") for k in range(d)] + [F.max(F.col("x")[k]).alias(f"hi{k}") for k in range(d)]
        boxes = self.points.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *box).orderBy("block").toPandas()  # at most BLOCKS rows
        self.names = boxes["block"].to_numpy()
        self.lo, self.hi = boxes[[f"lo{k}" for k in range(d)]].to_numpy(float), boxes[[f"hi{k}" for k in range(d)]].to_numpy(float)
        self.reach = self._reach(_matrix(sample)) if self.n else np.zeros(0)

    def _reach(self, sample: np.ndarray) -> np.ndarray:
        """How far around each box the points are that a task takes in: to about three times the points of a block, by the sample; without end where these are all."""
        near = 3 * -(-len(sample) // len(self.names))
        return np.array([np.inf if near >= len(sample) else np.partition(_gap(sample, lo, hi), near)[near] for lo, hi in zip(self.lo, self.hi, strict=True)])

    def groups(self, most: int) -> dict[str, int]:
        """For each block the number of its group of near blocks, of about `most` points."""
        middle = (self.lo + self.hi) / 2
        cuts = _cells(middle, min(len(middle), -(-self.n // most))) if self.n else []
        return dict(zip(self.names, _placed(middle, cuts), strict=True))

    def near(self, bounds: DataFrame) -> DataFrame:
        """block, other: for rows (block, bound), the other blocks whose boxes are at most that far."""
        names, lo, hi = self.names, self.lo, self.hi

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = {b: k for k, b in enumerate(names)}
            for pdf in parts:
                for b, bound in zip(pdf["block"], pdf["bound"], strict=True):
                    k = at[b]
                    gap = np.maximum(np.maximum(lo - hi[k], lo[k] - hi), 0)
                    other = names[(np.sqrt((gap**2).sum(1)) * (1 - 1e-12) <= bound) & (np.arange(len(names)) != k)]
                    yield pd.DataFrame({"block": b, "other": other})

        return bounds.mapInPandas(run, "block string, other string")


def _met(packed: DataFrame, near: DataFrame) -> DataFrame:
    """A row for each pair of blocks, with both contents (a, b)."""
    a, b = packed.withColumnRenamed("rows", "a"), packed.select(F.col("block").alias("other"), F.col("rows").alias("b"))
    return near.join(a, "block").join(b, "other").select("a", "b")


def _packed(points: DataFrame, columns: list[str]) -> DataFrame:
    return points.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _unpack(rows) -> dict[str, np.ndarray]:
    return {k: (_matrix if k == "x" else np.array)([r[k] for r in rows]) for k in rows[0]}


def cores(blocks: Blocks, samples: int) -> DataFrame:
    """id, core: the distance to the point's `samples`-th nearest other vector, equal ones counted; the farthest where there are fewer."""

    def nearest(a, b, same: bool) -> pd.DataFrame:
        d = distances(a["x"], b["x"])
        w = np.broadcast_to(b["w"], d.shape).copy()
        if same:
            np.fill_diagonal(w, a["w"] - 1)
        k = np.argsort(d, 1, kind="stable")[:, : samples + 1]
        return pd.DataFrame({"id": np.repeat(a["id"], k.shape[1]), "d": np.take_along_axis(d, k, 1).ravel(), "w": np.take_along_axis(w, k, 1).ravel()})

    def inside(parts):
        for pdf in parts:
            for rows in pdf["rows"]:
                a = _unpack(rows)
                yield nearest(a, a, True)

    def across(parts):
        for pdf in parts:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                yield nearest(_unpack(a), _unpack(b), False)

    packed, schema = _packed(blocks.points, ["id", "x", "w"]), "id long, d double, w long"
    own = cut(packed.select("rows").mapInPandas(inside, schema))
    # the first distance at which enough vectors are met
    run = F.aggregate(F.sort_array(F.collect_list(F.struct("d", "w"))), F.struct(F.lit(0).cast("long").alias("w"), F.lit(None).cast("double").alias("d"), F.lit(0.0).alias("far")),
        lambda s, v: F.struct((s["w"] + v["w"]).alias("w"), F.coalesce(s["d"], F.when(s["w"] + v["w"] >= samples, v["d"])).alias("d"), F.greatest(s["far"], v["d"]).alias("far")))
    met = lambda df: df.groupBy("id").agg(run.alias("s"))
    bounds = met(own).join(blocks.points.select("id", "block"), "id").groupBy("block").agg(F.max(F.coalesce("s.d", F.lit(float("inf")))).alias("bound"))
    others = _met(packed, blocks.near(bounds)).mapInPandas(across, schema)
    return met(own.unionByName(others)).select("id", F.coalesce("s.d", "s.far").alias("core"))


def _prim(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w, i, j: the shortest spanning tree of all pairs of some points by mutual reachability, ties by the smaller and then the larger place."""
    n = len(x)
    axes, core, plain = [c.copy() for c in x.T], core.copy(), not core.any()
    place, near, by = np.arange(n), np.full(n, np.inf), np.zeros(n, int)
    w, i, j = np.zeros(n - 1), np.zeros(n - 1, int), np.zeros(n - 1, int)
    at = 0
    for step in range(n):
        # the point at `at` joins the tree; the last one left takes its place
        m, here, c, v = n - 1 - step, place[at], core[at], [a[at] for a in axes]
        for column in (*axes, core, place, near, by):
            column[at] = column[m]
        if not m:
            return w, i, j
        d = (axes[0][:m] - v[0]) ** 2
        for a, u in zip(axes[1:], v[1:], strict=True):
            d += (a[:m] - u) ** 2
        np.sqrt(d, out=d)
        if not plain:
            np.maximum(d, np.maximum(core[:m], c), out=d)
        better, same = d < near[:m], d == near[:m]
        if same.any():
            better |= same & (here < by[:m])
        np.copyto(near[:m], d, where=better)
        by[:m][better] = here
        at = int(near[:m].argmin())
        ties = np.flatnonzero(near[:m] == near[at])
        if len(ties) > 1:
            at = ties[np.lexsort((np.maximum(place[ties], by[ties]), np.minimum(place[ties], by[ties])))[0]]
        w[step], i[step], j[step] = near[at], min(place[at], by[at]), max(place[at], by[at])


class Union:
    """Disjoint sets of places; a set's name is its smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    def join(self, a: int, b: int) -> int:
        a, b = min(a, b), max(a, b)
        self.up[b] = a
        return a


_LOCAL = "w double, lo long, hi long, sure boolean, inner boolean"


def _local(pdf: pd.DataFrame, lo: np.ndarray, hi: np.ndarray, reach: float) -> pd.DataFrame:
    """Edges of the tree of a block's points and of all within `reach` of its box, those with an end in the block, and the local component of each of its points (w -1; lo, hi: the point, the component).
    sure: no edge to a point further away can be shorter, for one of the two components that the edge joins, so it is in the whole tree. The local components are joined by sure edges inside the block."""
    pdf = pdf.sort_values("id", ignore_index=True)
    ids, x, own = pdf["id"].to_numpy(), _matrix(pdf["x"]), pdf["own"].to_numpy(bool)
    w, i, j = _prim(x, pdf["core"].to_numpy(float))
    depth = np.minimum(x - lo, hi - x).min(1)
    free = (reach + np.where(own, depth, -_gap(x, lo, hi)) - 1e-12 * (reach + np.abs(depth)) if np.isfinite(reach) else np.full(len(x), np.inf)).tolist()
    sets, inner, out = Union(len(x)), Union(len(x)), []
    for k in np.lexsort((j, i, w)):
        p, q, length = int(i[k]), int(j[k]), w[k]
        a, b = sets.find(p), sets.find(q)
        sure, within = length < max(free[a], free[b]), own[p] and own[q]
        free[sets.join(a, b)] = min(free[a], free[b])
        if sure and within:
            inner.join(inner.find(p), inner.find(q))
        if own[p] or own[q]:
            out.append((k, sure, within))
    at = np.array([o[0] for o in out], int)
    edges = pd.DataFrame({"w": w[at], "lo": ids[i[at]], "hi": ids[j[at]], "sure": [bool(o[1]) for o in out], "inner": [bool(o[2]) for o in out]})
    mine = np.flatnonzero(own)
    labels = pd.DataFrame({"w": -1.0, "lo": ids[mine], "hi": ids[[inner.find(int(k)) for k in mine]], "sure": True, "inner": True})
    return pd.concat([edges, labels]) if len(edges) else labels


def _taken(rows: pd.DataFrame, parts: list[tuple]) -> pd.DataFrame:
    """The rows at the places of each part (places, block, ...), for that block."""
    if not parts:
        return rows.iloc[:0]
    return rows.iloc[np.concatenate([p[0] for p in parts])].assign(block=np.repeat(np.array([p[1] for p in parts], object), [len(p[0]) for p in parts]))


def components(edges: DataFrame, most: int) -> DataFrame:
    """comp, to: for rows (a, b, w, lo, hi), edges between components, each component that has one and the smallest that it is connected with. Rounds, in which each takes its first edge, until at most
    `most` edges are left, which one task joins."""
    edges, to = cut(edges.select("a", "b", "w", "lo", "hi")), None
    while edges.count() > most:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "lo", "hi"))
        step = ends.groupBy("a").agg(F.min(F.struct("w", "lo", "hi", "b")).alias("e")).select(F.col("a").alias("comp"), F.col("e.b").alias("to"))
        back = step.select(F.col("comp").alias("to"), F.col("to").alias("back"))
        # of two that chose one edge, the smaller is the root
        step = cut(step.join(back, "to").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to")))
        while True:
            both = cut(step.join(step.select(F.col("comp").alias("to"), F.col("to").alias("next")), "to"))
            step = both.select("comp", F.col("next").alias("to"))
            if both.where("next <> to").isEmpty():
                break
        to = step if to is None else cut(_moved(to, step, "to"))
        edges = cut(_moved(_moved(edges, step, "a"), step, "b").where("a <> b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        sets = Union(len(names))
        for a, b in at.reshape(-1, 2).tolist():
            a, b = sets.find(a), sets.find(b)
            if a != b:
                sets.join(a, b)
        return pd.DataFrame({"comp": names, "to": names[[sets.find(k) for k in range(len(names))]]})

    last = cut(edges.select("a", "b", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "comp long, to long"))
    return last if to is None else cut(_moved(to, last, "to"))


def _moved(rows: DataFrame, to: DataFrame, *columns: str) -> DataFrame:
    """`rows` whose components in these columns are named as `to` (comp, to) says."""
    for c in columns:
        rows = rows.join(to.select(F.col("comp").alias(c), F.col("to").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return rows


_EDGE = "comp long, other long, w double, lo long, hi long"


def _shortest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Of the edges from a's points (with a bound for each) to those of b in other components, not longer than the bound, the first by (reach, ends) for each two components, as far as it is some point's shortest."""
    out, xb, idb, coreb, compb = [], _matrix(b["x"]), b["id"].to_numpy(), b["core"].to_numpy(float), b["comp"].to_numpy()
    step = max(1, 1_000_000 // len(b))
    for k in range(0, len(a), step):
        part = a.iloc[k : k + step]
        comp, ids = part["comp"].to_numpy(), part["id"].to_numpy()
        w = distances(_matrix(part["x"]), xb)
        if coreb.any():
            w = np.maximum(np.maximum(w, part["core"].to_numpy(float)[:, None]), coreb[None, :])
        w[comp[:, None] == compb[None, :]] = np.inf
        low = w.min(1)
        rows = np.flatnonzero(np.isfinite(low) & (low <= part["bound"].to_numpy(float)))
        i, j = np.nonzero(w[rows] == low[rows, None])
        i = rows[i]
        out.append(pd.DataFrame({"comp": comp[i], "other": compb[j], "w": w[i, j], "lo": np.minimum(ids[i], idb[j]), "hi": np.maximum(ids[i], idb[j])}))
    return pd.concat(out).sort_values(["w", "lo", "hi"], kind="stable").drop_duplicates(["comp", "other"])


def spanning_tree(blocks: Blocks, samples: int = 1, most: int = 200_000) -> DataFrame:
    """w, lo, hi: the edges of a shortest spanning tree of the points by mutual reachability (ties by the ends' ids). most: edges between components that one task joins."""
    spark = blocks.spark
    if blocks.n < 2:
        return spark.createDataFrame([], "w double, lo long, hi long")
    # with one neighbour no core is longer than a distance
    core = blocks.points.withColumn("core", F.lit(0.0)) if samples == 1 else cut(blocks.points.join(cores(blocks, samples), "id"))
    core = core.select("id", "x", "block", "core")
    names, lo, hi, reach = blocks.names, blocks.lo, blocks.hi, blocks.reach
    at = {b: k for k, b in enumerate(names)}

    def around(key, rows):
        k, x, out = at[key[0]], _matrix(rows["x"]), []
        for q in np.flatnonzero(np.sqrt((np.maximum(np.maximum(lo - hi[k], lo[k] - hi), 0) ** 2).sum(1)) <= reach):
            here = np.arange(len(x)) if q == k else np.flatnonzero(_gap(x, lo[q], hi[q]) <= reach[q])
            out.append((here, names[q], q == k))
        return _taken(rows, out).assign(own=np.repeat([o[2] for o in out], [len(o[0]) for o in out]))

    def local(key, pdf):
        k = at[key[0]]
        return _local(pdf, lo[k], hi[k], reach[k])

    found = cut(core.groupBy("block").applyInPandas(around, "id long, x array<double>, block string, core double, own boolean").groupBy("block").applyInPandas(local, _LOCAL))
    edges = found.where("w >= 0")
    crossing = cut(edges.where("not inner").groupBy("w", "lo", "hi").agg(F.max("sure").alias("sure")))
    labels = found.where("w < 0").select(F.col("lo").alias("id"), F.col("hi").alias("comp"))
    ends = lambda df: df.join(labels.select(F.col("id").alias("lo"), F.col("comp").alias("a")), "lo").join(labels.select(F.col("id").alias("hi"), F.col("comp").alias("b")), "hi")
    tree = edges.where("inner and sure").select("w", "lo", "hi").unionByName(crossing.where("sure").select("w", "lo", "hi"))
    to = components(ends(crossing.where("sure")), most)
    label = cut(_moved(core.join(labels, "id"), to, "comp"))
    # edges that may be in the tree or not: bounds
    known = cut(_moved(ends(edges.where("inner and not sure").select("w", "lo", "hi").unionByName(crossing.where("not sure").select("w", "lo", "hi"))), to, "a", "b").where("a <> b"))
    while True:
        left, largest = label.groupBy("comp").count().agg(F.count(F.lit(1)), F.max_by("comp", "count")).first()
        if left == 1:
            return tree
        # a point of each block, and the component of blocks that have one only
        head = label.groupBy("block").agg(F.min_by(F.struct("id", "x", "core", "comp"), "id").alias("p"), (F.min("comp") == F.max("comp")).alias("pure")).select("block", "p.*", "pure").toPandas().set_index("block").loc[names].reset_index()
        heads, pure = head.assign(bound=np.inf), np.where(head["pure"], head["comp"], -1)

        def bounded(key, pdf):
            near = np.argsort(np.sqrt((np.maximum(np.maximum(lo - hi[at[key[0]]], lo[at[key[0]]] - hi), 0) ** 2).sum(1)), kind="stable")
            main = pdf["comp"].mode()[0]
            # the nearest ones, and nearest ones for the component with the most points, which may have all of these
            others = np.union1d(near[:48], near[heads["comp"].to_numpy()[near] != main][:16])  # noqa: B023
            return _shortest(pdf.assign(bound=np.inf), heads.iloc[others])  # noqa: B023

        def asked(key, rows):
            k, x, comp, bound, out = at[key[0]], _matrix(rows["x"]), rows["comp"].to_numpy(), rows["bound"].to_numpy(float), []
            for q in np.flatnonzero(np.sqrt((np.maximum(np.maximum(lo - hi[k], lo[k] - hi), 0) ** 2).sum(1)) * (1 - 1e-12) <= bound.max()):
                mixed = pure[q] != comp  # noqa: B023
                if mixed.any():
                    out.append((np.flatnonzero(mixed & (_gap(x, lo[q], hi[q]) * (1 - 1e-12) <= bound)), names[q], False))
            return _taken(rows, out)

        def met(a, b):
            return _shortest(a, b) if len(a) and len(b) else pd.DataFrame(columns=["comp", "other", "w", "lo", "hi"])

        asks = label.where(F.col("comp") != largest)
        both = known.select(F.col("a").alias("comp"), F.col("b").alias("other"), "w", "lo", "hi").unionByName(known.select(F.col("b").alias("comp"), F.col("a").alias("other"), "w", "lo", "hi"))
        own = cut(asks.groupBy("block").applyInPandas(bounded, _EDGE).unionByName(both.where(F.col("comp") != largest)))
        best = lambda df: df.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*")
        questions = asks.join(best(own).select("comp", F.col("w").alias("bound")), "comp", "left").fillna(float("inf"), "bound").select("id", "x", "block", "core", "comp", "bound")
        questions = questions.groupBy("block").applyInPandas(asked, questions.schema)
        seen = cut(questions.groupBy("block").cogroup(label.groupBy("block")).applyInPandas(met, _EDGE))
        chosen = cut(best(own.unionByName(seen)))
        tree = cut(tree.unionByName(chosen.select("w", "lo", "hi").distinct()))
        to = components(chosen.select(F.col("comp").alias("a"), F.col("other").alias("b"), "w", "lo", "hi"), most)
        label = cut(_moved(label, to, "comp"))
        more = own.unionByName(seen).select(F.least("comp", "other").alias("a"), F.greatest("comp", "other").alias("b"), "w", "lo", "hi").groupBy("a", "b").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("a", "b", "e.*")
        known = cut(_moved(known.unionByName(more), to, "a", "b").where("a <> b"))


_STATE = "comp long, size long, h double, big long, node long, members array<long>, s double, inner long, worth double, split boolean, extra long"
_OUT = "kind string, a long, b long, size long, h double, big long, node long, members array<long>, s double, inner long, worth double, split boolean, extra long"


class Condensing:
    """Components while a band's edges are taken by length. A state is that of the split at height h, the component's last, which more edges of that length may widen:
    big, how many clusters meet there; node, its own; of one cluster below, s, inner and worth are its sum of densities, points and the worth of what it split into; of more, worth is the sum of theirs.
    extra: where points go that joined the one cluster at height h; whether they are its own is known when no more edges of that length come."""

    def __init__(self, least: int, states: dict[int, dict]):
        self.least, self.states, self.top = least, states, {c: c for c in states}
        self.nodes, self.members = [], []

    def find(self, c: int) -> int:
        while self.top[c] != c:
            self.top[c] = self.top[self.top[c]]
            c = self.top[c]
        return c

    def sealed(self, t: dict) -> dict:
        """What the component is above its last split."""
        lam = 1 / max(t["h"], LEAST_HEIGHT)
        if t["node"] is None:
            return t | {"big": 0}
        if t["big"] == 1:
            self.below(t["extra"], t["node"])
            return t | {"s": t["s"] + (t["size"] - t["inner"]) * lam, "inner": t["size"], "extra": None}
        return t | {"big": 1, "s": t["size"] * lam, "inner": t["size"], "split": t["big"] > 1, "worth": t["worth"] if t["big"] > 1 else 0.0}

    def closed(self, t: dict, h: float, parent: int) -> float:
        """The worth of the one cluster below t, whose birth is at h: its own stability or that of its parts, whichever is more."""
        stability = t["s"] - t["inner"] / max(h, LEAST_HEIGHT)
        own = not (t["split"] and t["worth"] > stability)
        self.nodes.append((t["node"], parent, own))
        return stability if own else t["worth"]

    def below(self, node: int | None, parent: int) -> None:
        if node is not None:
            self.nodes.append((node, parent, False))

    def take(self, edge: int, lo: int, hi: int, h: float) -> None:
        a, b = self.find(lo), self.find(hi)
        p, q = (self.states[c] if self.states[c]["h"] == h else self.sealed(self.states[c]) | {"h": h} for c in (a, b))
        if (p["big"], p["node"] is not None) < (q["big"], q["node"] is not None):
            p, q = q, p
        out = dict(p, size=p["size"] + q["size"], h=h)
        loose = [m for t in (p, q) if t["node"] is None for m in t["members"]]
        home = p["node"]
        if p["big"] == 1 and q["big"] == 1:
            home = edge
            out |= {"node": edge, "big": 2, "worth": self.closed(p, h, edge) + self.closed(q, h, edge), "extra": None}
            self.below(p["extra"], edge)
            self.below(q["extra"], edge)
        elif q["big"] == 1:
            out |= {"big": p["big"] + 1, "worth": p["worth"] + self.closed(q, h, home)}
            self.below(q["extra"], home)
        elif p["big"] == 1:
            home = out["extra"] = next(x for x in (p["extra"], q["node"], edge) if x is not None)
            self.below(q["node"] if q["node"] != home else None, home)
        elif q["node"] is not None:
            # clusters that began, or splits, at one height are one
            self.below(q["node"], home)
            if q["big"] > 1:
                out |= {"big": p["big"] + q["big"], "worth": p["worth"] + q["worth"]}
        if out["node"] is None and out["size"] >= self.least:
            home = out["node"] = edge
        if out["node"] is None:
            out["members"] = loose
        else:
            out["members"] = None
            self.members += [(m, home) for m in loose]
        self.top[b] = a
        self.states[a] = out
        del self.states[b]


def _rows(c: Condensing, edges: list[tuple] = ()) -> pd.DataFrame:
    names = [n.split()[0] for n in _STATE.split(", ")]
    rows = [("state", k, None, *[t[x] for x in names[1:]]) for k, t in c.states.items()]
    rows += [("map", k, c.find(k), *[None] * 10) for k in list(c.top)]
    rows += [("node", n, p, *[None] * 8, own, None) for n, p, own in c.nodes]
    rows += [("member", m, n, *[None] * 10) for m, n in c.members]
    rows += [("edge", c.find(a), c.find(b), None, w, e, *[None] * 7) for e, w, a, b in edges]
    out = pd.DataFrame(rows, columns=["kind", "a", "b", *names[1:]])
    for k in ("a", "b", "size", "big", "node", "inner", "extra"):
        out[k] = out[k].astype("Int64")
    return out


def _band(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    names = [c.split()[0] for c in _STATE.split(", ")]
    states = {}
    for end in ("sa", "sb"):
        for s in pdf[end]:
            t = {k: s[k] for k in names}
            for k in ("node", "extra"):
                t[k] = None if t[k] is None or t[k] != t[k] else int(t[k])
            t["members"] = None if t["members"] is None else [int(m) for m in t["members"]]
            states[int(t.pop("comp"))] = t
    c = Condensing(least, states)
    for e in pdf.sort_values(["w", "edge"]).itertuples():
        c.take(int(e.edge), int(e.sa["comp"]), int(e.sb["comp"]), float(e.w))
    return _rows(c)


def _group(points: pd.DataFrame, edges: pd.DataFrame, least: int) -> pd.DataFrame:
    """A group of blocks as far as it can be condensed alone: a component takes edges up to the first that leaves the group (stop) or waits for another such component. Edges that wait are given back."""
    if not len(points):
        return _rows(Condensing(least, {}))
    ids, weights = points["id"].tolist(), points["w"].tolist()
    c = Condensing(least, {i: {"size": w, "h": 0.0, "big": 0, "node": -1 - i if w >= least else None, "members": None if w >= least else [i], "s": 0.0, "inner": 0, "worth": 0.0, "split": False, "extra": None} for i, w in zip(ids, weights, strict=True)})
    stop, wait = dict(zip(ids, points["stop"].tolist(), strict=True)), []
    edges = edges.sort_values(["w", "edge"])
    for e, w, lo, hi in zip(edges["edge"].tolist(), edges["w"].tolist(), edges["lo"].tolist(), edges["hi"].tolist(), strict=True):
        a, b = c.find(lo), c.find(hi)
        first = min(stop[a], stop[b])
        if w <= first:
            c.take(e, lo, hi, w)
            stop[a] = first
        else:
            stop[a], stop[b] = min(stop[a], w), min(stop[b], w)
            wait.append((e, w, lo, hi))
    return _rows(c, wait)


def condensed(blocks: Blocks, tree: DataFrame, least: int, band: int = 100_000) -> DataFrame:
    """id, cluster: the id of the cluster of each point, null for noise. Of the clusters of at least `least` vectors, those are taken that are more stable than what they split into; never the whole."""
    near = blocks.spark.createDataFrame([(str(b), int(g)) for b, g in blocks.groups(max(1, band // 3)).items()], "block string, grp long")
    home = cut(blocks.points.join(F.broadcast(near), "block").select("id", "w", "grp"))
    end = lambda c: home.select(F.col("id").alias(c), F.col("grp").alias(f"g_{c}"))
    edges = cut(tree.join(end("lo"), "lo").join(end("hi"), "hi").select("w", "lo", "hi", "g_lo", "g_hi", F.monotonically_increasing_id().alias("edge")))
    across = edges.where("g_lo <> g_hi")
    stops = across.select(F.col("lo").alias("id"), "w").unionByName(across.select(F.col("hi").alias("id"), "w")).groupBy("id").agg(F.min("w").alias("stop"))
    points = home.join(stops, "id", "left").fillna(float("inf"), "stop")
    inside = edges.where("g_lo = g_hi").select(F.col("g_lo").alias("grp"), "edge", "w", "lo", "hi")
    out = cut(points.groupBy("grp").cogroup(inside.groupBy("grp")).applyInPandas(lambda a, b: _group(a, b, least), _OUT))
    parts = lambda out: (
        out.where("kind = 'state'").select(F.col("a").alias("comp"), *[c.split()[0] for c in _STATE.split(", ")[1:]]),
        out.where("kind = 'map'").select(F.col("a").alias("comp"), F.col("b").alias("to")),
        out.where("kind = 'node'").select(F.col("a").alias("node"), F.col("b").alias("parent"), F.col("split").alias("own")),
        out.where("kind = 'member'").select(F.col("a").alias("id"), F.col("b").alias("node")),
    )
    states, moved, nodes, members = parts(out)
    members = blocks.points.where(F.col("w") >= least).select("id", (-1 - F.col("id")).alias("node")).unionByName(members)
    waiting = out.where("kind = 'edge'").select(F.col("big").alias("edge"), F.col("h").alias("w"), F.col("a").alias("lo"), F.col("b").alias("hi"))
    # the other edges join components of groups
    edges = cut(waiting.unionByName(_moved(across.select("edge", "w", "lo", "hi"), moved, "lo", "hi")))
    bands = max(1, -(-edges.count() // band))
    edges = cut(edges.repartitionByRange(bands, "w", "edge").withColumn("band", F.spark_partition_id()))
    states = cut(states)
    at = states.select(F.col("comp").alias("id"), "comp")
    for k in range(bands):
        end = lambda c, s: at.select(F.col("id").alias(c), "comp").join(states, "comp").select(c, F.struct(*states.columns).alias(s))  # noqa: E731, B023
        met = edges.where(F.col("band") == k).join(end("lo", "sa"), "lo").join(end("hi", "sb"), "hi").select("band", "edge", "w", "sa", "sb")
        out = cut(met.groupBy("band").applyInPandas(lambda pdf: _band(pdf, least), _OUT))
        new, moved, below, named = parts(out)
        states = cut(states.join(moved, "comp", "left_anti").unionByName(new))
        at = cut(at.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        nodes, members = nodes.unionByName(below), members.unionByName(named)
    # the whole is no cluster; each node's uppermost one that is taken, by doubling the ways up
    root = states.where("node is not null").select("node", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("own"))
    late = states.where("extra is not null").select(F.col("extra").alias("node"), F.col("node").alias("parent"), F.lit(False).alias("own"))
    way = cut(nodes.unionByName(root).unionByName(late).select("node", F.col("parent").alias("up"), F.when(F.col("own"), F.col("node")).alias("top")))
    while not way.where("up is not null").isEmpty():
        above = way.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        way = cut(way.join(above, "up", "left").select("node", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")))
    named = members.join(way.select("node", "top"), "node", "left").select("id", F.col("top").alias("cluster"))
    return blocks.points.select("id").join(named, "id", "left")


def density_clusters(rows: DataFrame, key: str, columns: list[str], least: int = 4, samples: int = 1, size: int = 256, band: int = 100_000) -> DataFrame:
    """`rows` with phylum: phylum_ and the smallest key of the row's density cluster by its columns, or noise. Rows with a null or non-finite column are noise.

    least: the vectors of the smallest cluster. samples: the neighbour whose distance is a vector's core. size: points of a block. band: edges of a task.
    An empty table gives an empty one."""
    rows = cut(rows)
    usual = [F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(columns)]
    x = [f"__x{k}" for k in range(len(columns))]
    valued = rows.select(F.col(key).alias("__key"), *usual).where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in x))
    points = cut(valued.groupBy(*x).agg(F.count(F.lit(1)).alias("w")).select(F.monotonically_increasing_id().alias("id"), F.array(*x).alias("x"), "w", *x))
    blocks = Blocks(points, size)
    clusters = condensed(blocks, spanning_tree(blocks, samples), least, band)
    found = cut(valued.join(points.select("id", *x), x).join(clusters, "id").where("cluster is not null").select("__key", "cluster"))
    names = found.groupBy("cluster").agg(F.concat(F.lit("phylum_"), F.min("__key").cast("string")).alias("__phylum"))
    named = found.join(names, "cluster").select(F.col("__key").alias(key), F.col("__phylum")).distinct()
    return rows.join(named, key, "left").select(*rows.columns, F.coalesce("__phylum", F.lit("noise")).alias("phylum"))
