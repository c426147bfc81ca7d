"""Folds as table functions, purging by interval joins, and bootstrap paths dealt by simulation.

`walk_forward`, `cpcv` and `purged_train` are table functions for SQL: their table argument has a row a symbol (symbol, n bars), so folds are those of each symbol's own length.

`purge` keeps the rows whose label does not reach into a test interval or its embargo. Intervals come from a table, of any number; both sides are cut into bins, so that the join has
equal keys and a row meets the intervals near it only.

`paths_text`: block bootstrap of whole return series. A path's blocks begin where a hash of (seed, symbol, simulation, block) says, so any task can make any path again, and the same. Blocks are summed
up once for each place where one can begin; a path joins these summaries, one for each of its blocks, never its returns. Bars that are left over at a path's end are blocks of one.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.dialect import duck, spark
from ..sources.bars import EVENT_BARS_SQL, event_bars
from .reports import _SCALED, ANN, S


@udtf(returnType="symbol string, fold int, train_start int, train_end int, test_start int, test_end int")
class WalkForward:
    """Of rows (symbol, n): folds of `train` bars (all so far where `expanding`) and the `test` bars after them, `step` bars apart; ends are excluded."""

    def eval(self, row, train: int, test: int, step: int, expanding: bool):
        for k, t in enumerate(range(0, row["n"] - train - test + 1, step)):
            yield row["symbol"], k, 0 if expanding else t, t + train, t + train, t + train + test


@udtf(returnType="symbol string, path int, block int, is_test boolean, first int, last int")
class Cpcv:
    """Of rows (symbol, n): every choice of `tests` of `blocks` equal blocks as test blocks; last is excluded."""

    def eval(self, row, blocks: int, tests: int):
        edges = [row["n"] * b // blocks for b in range(blocks + 1)]
        for k, chosen in enumerate(itertools.combinations(range(blocks), tests)):
            for b in range(blocks):
                yield row["symbol"], k, b, b in chosen, edges[b], edges[b + 1]


@udtf(returnType="symbol string, fold int, first int, last int")
class PurgedTrain:
    """Of rows (symbol, n): for each of `folds` equal test folds the runs of bars that train, `horizon` bars before and `embargo` bars after the test left out; last is excluded."""

    def eval(self, row, folds: int, horizon: int, embargo: int):
        n = row["n"]
        for k in range(folds):
            lo, hi = n * k // folds, n * (k + 1) // folds
            for a, b in ((0, lo - horizon), (hi + embargo, n)):
                if a < b:
                    yield row["symbol"], k, a, b


def register(session: SparkSession) -> SparkSession:
    for name, f in (("walk_forward", WalkForward), ("cpcv", Cpcv), ("purged_train", PurgedTrain)):
        session.udtf.register(name, f)
    return session


#: What the table functions are called with, and the same folds for the checking engine (r: a row symbol, n).
FOLDS = {
    "walk_forward_folds": (
        "SELECT * FROM walk_forward(TABLE(SELECT symbol, CAST(count(*) AS INT) AS n FROM {bars} GROUP BY symbol), 500, 200, 200, true)",
        "SELECT symbol, (t // 200)::INT AS fold, 0 AS train_start, (t + 500)::INT AS train_end, (t + 500)::INT AS test_start, (t + 700)::INT AS test_end FROM r, unnest(generate_series(0, n - 700, 200)) AS u(t)",
    ),
    "walk_forward_rolling": (
        "SELECT * FROM walk_forward(TABLE(SELECT symbol, CAST(count(*) AS INT) AS n FROM {bars} GROUP BY symbol), 100, 24, 12, false)",
        "SELECT symbol, (t // 12)::INT AS fold, t::INT AS train_start, (t + 100)::INT AS train_end, (t + 100)::INT AS test_start, (t + 124)::INT AS test_end FROM r, unnest(generate_series(0, n - 124, 12)) AS u(t)",
    ),
    "cpcv_paths": (
        "SELECT * FROM cpcv(TABLE(SELECT symbol, CAST(count(*) AS INT) AS n FROM {bars} GROUP BY symbol), 6, 2)",
        "SELECT symbol, path, b::INT AS block, b IN (x, y) AS is_test, (n * b // 6)::INT AS first, (n * (b + 1) // 6)::INT AS last FROM r, (SELECT x, y, (row_number() OVER (ORDER BY x, y) - 1)::INT AS path FROM range(6) AS u(x), range(6) AS v(y) WHERE x < y), range(6) AS w(b)",
    ),
    "purged_train_runs": (
        "SELECT * FROM purged_train(TABLE(SELECT symbol, CAST(count(*) AS INT) AS n FROM {bars} GROUP BY symbol), 5, 10, 24)",
        "SELECT symbol, k::INT AS fold, a::INT AS first, b::INT AS last FROM (SELECT symbol, k, CASE WHEN s = 0 THEN 0 ELSE n * (k + 1) // 5 + 24 END AS a, CASE WHEN s = 0 THEN n * k // 5 - 10 ELSE n END AS b FROM r, range(5) AS u(k), range(2) AS v(s)) WHERE a < b",
    ),
}


def purge(rows: DataFrame, tests: DataFrame, embargo: int = 24, width: int = 256) -> DataFrame:
    """The rows (symbol, i, horizon and others) whose label, bars i to i + horizon, meets no interval of `tests` (symbol, fold, test_start, test_end, both ends in it) of a fold, nor
    the `embargo` bars after it; with the fold: a row for each fold that it may train. width: bars of a bin."""
    banned = tests.select("symbol", "fold", F.col("test_start").alias("lo"), (F.col("test_end") + embargo).alias("hi"))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    near = banned.withColumn("bin", bins(F.col("lo"), F.col("hi")))
    label = rows.select("symbol", "i", (F.col("i") + F.col("horizon")).alias("end")).withColumn("bin", bins(F.col("i"), F.col("end")))
    hit = label.join(near, ["symbol", "bin"]).where("i <= hi AND end >= lo").select("symbol", "fold", "i").distinct()
    folds = tests.select("symbol", "fold").distinct()
    return rows.join(folds, "symbol").join(hit, ["symbol", "fold", "i"], "left_anti")


#: Bars with a label horizon of their own, and overlapping test intervals, many a symbol, every third of which is a fold's.
_ROWS = f"SELECT symbol, CAST(row_number() OVER ({S}) - 1 AS INT) AS i, CAST(1 + count % 12 AS INT) AS horizon FROM {{bars}}"
_TESTS = "SELECT symbol, CAST(i % 3 AS INT) AS fold, i AS test_start, CAST(i + 4 + horizon AS INT) AS test_end FROM ({rows}) WHERE i % 29 = 7"


def _purged_rows(session, sf_dir):
    rows = session.sql(spark(_ROWS), bars=event_bars(session.read.parquet(f"{sf_dir}/events.parquet")))
    tests = session.sql(spark(_TESTS).replace("({rows})", "{rows}"), rows=rows)
    return purge(rows, tests, 5).select("symbol", "fold", "i")


_PURGED_SQL = f"WITH rows AS ({_ROWS}), tests AS ({_TESTS.replace('({rows})', 'rows')}) SELECT symbol, fold, i FROM rows JOIN (SELECT DISTINCT symbol, fold FROM tests) AS f USING (symbol) WHERE NOT EXISTS (SELECT 1 FROM tests t WHERE t.symbol = rows.symbol AND t.fold = f.fold AND rows.i <= t.test_end + 5 AND rows.i + rows.horizon >= t.test_start)"


def paths_text(sims: int = 1000, block: int = 20, seed: int = 42, level: float = 0.95) -> str:
    """Per symbol mean, deviation, interval and share above 0 of the paths' Sharpe and Sortino ratios, total log return and greatest drawdown."""
    a = (1 - level) / 2
    over = f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING)"
    ret = f"SELECT symbol, CAST(row_number() OVER ({S}) - 1 AS INT) AS i, count(*) OVER (PARTITION BY symbol) AS n, r, ln(1 + r) AS g FROM ({_SCALED})"
    low = "CASE WHEN r < 0 THEN r ELSE 0e0 END"
    sums = {"sr": "r", "sq": "r * r", "nn": "CASE WHEN r < 0 THEN 1e0 ELSE 0e0 END", "nr": low, "nq": f"{low} * {low}", "sg": "g"}
    # prefix sums of growth: with p before a block's first bar, its bars are at c - p; the block's highest, lowest and deepest fall are those of c
    base = f"SELECT *, sum(g) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM ({ret})"
    falls = f"SELECT *, LIST(c) {over} AS cs FROM ({base})"
    one = f"SELECT symbol, n, 1 AS size, i AS start, r AS sr, r * r AS sq, {sums['nn']} AS nn, {low} AS nr, {low} * {low} AS nq, g AS sg, g AS top, g AS bottom, 0e0 AS fall FROM ({base})"
    full = f"SELECT symbol, n, {block} AS size, i AS start, {', '.join(f'sum({e}) {over} AS {k}' for k, e in sums.items())}, max(c) {over} - (c - g) AS top, min(c) {over} - (c - g) AS bottom, cs FROM ({falls})"
    full = f"SELECT symbol, n, size, start, sr, sq, nn, nr, nq, sg, top, bottom, FALL_OF_cs AS fall FROM ({full}) WHERE start + {block} <= n AND n >= {2 * block}"
    unit = f"CASE WHEN n >= {2 * block} THEN {block} ELSE 1 END"
    draws = f"SELECT symbol, n, sim, UNNEST_SEQ(0, CAST(ceil(n / ({unit} * 1e0)) AS INT) - 1)) AS b FROM (SELECT symbol, n, UNNEST_SEQ(0, {sims - 1})) AS sim FROM (SELECT symbol, max(n) AS n FROM ({ret}) GROUP BY symbol))"
    begun = f"SELECT *, HEX[substr(md5(concat('{seed}', '-', symbol, '-', sim, '-', b)), 1, 8)] % (n - {unit} + 1) AS start0, least({unit}, n - b * {unit}) AS bars FROM ({draws})"
    whole = f"SELECT symbol, sim, b, 0 AS o, CAST(start0 AS INT) AS start, CAST({unit} AS INT) AS size FROM ({begun}) WHERE bars = {unit}"
    rest = f"SELECT symbol, sim, b, o, CAST(start0 + o AS INT) AS start, 1 AS size FROM (SELECT *, UNNEST_SEQ(0, CAST(bars AS INT) - 1)) AS o FROM ({begun}) WHERE bars < {unit})"
    joined = f"SELECT p.symbol AS symbol, p.sim AS sim, p.b AS b, p.o AS o, u.n AS n, u.sr AS sr, u.sq AS sq, u.nn AS nn, u.nr AS nr, u.nq AS nq, u.sg AS sg, u.top AS top, u.bottom AS bottom, u.fall AS fall FROM ({whole} UNION ALL {rest}) p JOIN ({one} UNION ALL {full}) u ON p.symbol = u.symbol AND p.start = u.start AND p.size = u.size"
    path = "PARTITION BY symbol, sim ORDER BY b, o"
    walked = f"SELECT *, coalesce(sum(sg) OVER ({path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS s0 FROM ({joined})"
    peaked = f"SELECT *, max(s0 + top) OVER ({path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM ({walked})"
    by_path = f"SELECT symbol, sim, max(n) AS n, sum(sr) AS sr, sum(sq) AS sq, sum(nn) AS nn, sum(nr) AS nr, sum(nq) AS nq, sum(sg) AS sg, min(least(fall, CASE WHEN peak IS NULL THEN fall ELSE s0 + bottom - peak END)) AS fall FROM ({peaked}) GROUP BY symbol, sim"
    figures = {
        "sharpe": f"sr / n / nullif(sqrt((sq - sr * sr / n) / (n - 1)), 0) * sqrt({ANN})", "log_total": "sg", "max_drawdown": "exp(fall) - 1",
        "sortino": f"sr / n / nullif(CASE WHEN nn > 1 THEN sqrt(greatest(nq - nr * nr / nn, 0e0) / (nn - 1)) END, 0) * sqrt({ANN})",
    }
    valued = f"SELECT symbol, {', '.join(f'{e} AS {k}' for k, e in figures.items())} FROM ({by_path})"
    out = ", ".join(f"round(avg({k}), 5) AS {k}_mean, round(stddev_pop({k}), 5) AS {k}_std, round(PCT({k}, {a}), 5) AS {k}_low, round(PCT({k}, {1 - a}), 5) AS {k}_high, round(avg(CASE WHEN {k} > 0 THEN 1e0 ELSE 0e0 END), 6) AS {k}_positive" for k in figures)
    return f"SELECT symbol, count(*) AS simulations, {out} FROM ({valued}) GROUP BY symbol"


#: The deepest fall from a block's highest bar so far, of the list cs.
_FALL = {
    "spark": "aggregate(cs, named_struct('m', cs[0], 'd', 0e0), (acc, v) -> named_struct('m', greatest(acc.m, v), 'd', least(acc.d, v - greatest(acc.m, v))), acc -> acc.d)",
    "duck": "list_min(list_transform(cs, lambda v, j: v - list_max(cs[1:j])))",
}


def paths(bars: DataFrame, sims: int = 1000, block: int = 20, seed: int = 42) -> DataFrame:
    return bars.sparkSession.sql(spark(paths_text(sims, block, seed).replace("FALL_OF_cs", _FALL["spark"])), bars=bars)


def _bars(session, sf_dir):
    return event_bars(session.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES = {name: (lambda session, d, t=text: register(session).sql(t, bars=_bars(session, d))) for name, (text, _) in FOLDS.items()}
QUERIES |= {"purged_rows": _purged_rows, "monte_carlo_paths": lambda session, d: paths(_bars(session, d))}
SQL = {name: f"WITH r AS (SELECT symbol, count(*) AS n FROM ({EVENT_BARS_SQL}) GROUP BY symbol) {text}" for name, (_, text) in FOLDS.items()}
SQL |= {"purged_rows": duck(_PURGED_SQL).replace("{bars}", f"({EVENT_BARS_SQL})"), "monte_carlo_paths": duck(paths_text().replace("FALL_OF_cs", _FALL["duck"])).replace("{bars}", f"({EVENT_BARS_SQL})")}
