"""op12: importance resampling towards a target distribution over hashed n-gram buckets.

Each partition of a scan is counted by a DuckDB connection of its own: SQL lowers, splits and unnests the words of a batch of
texts, windows give the runs of up to `runs` words, and a registered function gives zlib's CRC of each different
run, whose remainder is its bucket. The bucket counts of every document are spilled to Parquet in the shared folder; Spark merges them
into those of the corpus and of the target, and scores each document from its own counts.

A document's weight is the floored mean, over its features, of the gains of their buckets (a thousandth of a unit of log likelihood ratio, smoothed by one a
bucket). Seeded Gumbel noise by doc_id turns a sort by score into a draw without replacement in proportion to the exponential of the weight: the
`percent` of the documents with LEAST_WORDS words or more that score highest are drawn. Ranks need no task that sees all rows: scores are whole numbers of a bounded
range, so the rows above each score are counted by score, and only equal scores among the drawn are put in order (by doc_id, then the other columns).

Long texts reach DuckDB in pieces of about PIECE characters, cut next to a sign that is in no word; runs of words go on across pieces. DuckDB gets MEMORY and one thread, and spills nothing.

Null, empty and wordless texts: no features, weight 0, a score, never drawn (but where `least_words` is 0). Repeated rows each count and each have a row. Rows
without a doc_id count in the corpus, have a row, and neither score nor rank. Empty documents: no rows. Empty target: its counts are zero. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

RUNS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
PIECE, MEMORY, SCALE = 1 << 17, "512MB", 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

COUNTED = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about `size` characters, none of which ends or begins within a word."""
    at = 0
    while len(text) - at > size:
        m = _GAP.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def counting_sql(runs: int, buckets: int) -> str:
    """Of the table `t` (r, p, text): a row for each r: r, n_words, n_features, buckets, counts."""
    longer = "".join(
        f" UNION ALL SELECT r, w{''.join(f' || chr(32) || lead(w, {k}) OVER o' for k in range(1, n))} AS g FROM words WINDOW o AS (PARTITION BY r ORDER BY p, i) QUALIFY lead(w, {n - 1}) OVER o IS NOT NULL"
        for n in range(2, runs + 1)
    )
    return f"""
    WITH split AS (SELECT r, p, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM t),
    words AS (SELECT r, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
    grams AS (SELECT r, w AS g FROM words{longer}),
    counted AS MATERIALIZED (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g),
    coded AS (SELECT g, (crc(g) % {buckets})::INT AS b FROM (SELECT DISTINCT g FROM counted)),
    by_bucket AS (SELECT r, b, sum(n) AS n FROM counted JOIN coded USING (g) GROUP BY r, b),
    totals AS (SELECT r, sum(len(ws)) AS n FROM split GROUP BY r)
    SELECT r, any_value(totals.n)::BIGINT AS n_words, coalesce(sum(by_bucket.n), 0)::BIGINT AS n_features,
        coalesce(list(b ORDER BY b) FILTER (b IS NOT NULL), []) AS buckets, coalesce(list(by_bucket.n::INT ORDER BY b) FILTER (b IS NOT NULL), []) AS counts
    FROM totals LEFT JOIN by_bucket USING (r) GROUP BY r ORDER BY r
    """


def _crc(column):
    return pa.array([zlib.crc32(x) for x in column.cast(pa.binary()).to_pylist()], pa.int64())


def bucket_counts(df: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, text: str = "text", doc_id: str = "doc_id", memory: str = MEMORY) -> DataFrame:
    """doc_id, n_words, n_features, buckets (ascending), counts: of every row, by a DuckDB connection a partition. doc_id may be null."""
    sql = counting_sql(runs, buckets)

    def run(batches):
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                r, p, parts = [], [], []
                for i, x in enumerate(b.column(1).to_pylist()):
                    for k, piece in enumerate(pieces(x or "")):
                        r.append(i)
                        p.append(k)
                        parts.append(piece)
                con.register("t", pa.table({"r": pa.array(r, pa.int32()), "p": pa.array(p, pa.int32()), "text": pa.array(parts, pa.string())}))
                out = con.sql(sql).to_arrow_table()
                con.unregister("t")
                cols = [out.column(n).combine_chunks() for n in ("n_words", "n_features", "buckets", "counts")]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                cols = [c.cast(k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_words", "n_features", "buckets", "counts"])
        finally:
            con.close()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, COUNTED)


def merged(counted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The sum over all rows of each bucket's count. Partial sums before the shuffle; `buckets` rows at most reach the driver."""
    out = [0] * buckets
    one = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    for b, n in one.collect():
        out[b] = n
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Floored thousandths of the log of the ratio of each bucket's share in the target to that in the corpus."""
    k = len(corpus)
    s_all, t_all = float(sum(corpus) + k), float(sum(target) + k)
    return np.array([math.floor(SCALE * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: int, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(counted: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of rows of `bucket_counts`."""

    def run(batches):
        for b in batches:
            lists, n = b.column(3), b.column(2).to_numpy(zero_copy_only=False)
            bound = lists.offsets.to_numpy().astype(np.int64)
            each = gain[lists.values.to_numpy()[: bound[-1]]] * b.column(4).values.to_numpy()[: bound[-1]]
            total = np.concatenate([[0], np.cumsum(each)])
            weight = (total[bound[1:]] - total[bound[:-1]]) // np.maximum(n, 1)
            ids = b.column(0).to_pylist()
            score = [None if i is None else w + noise(i, seed) for i, w in zip(ids, weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(weight), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`scored` (written) with rank: 1, 2, 3... from the highest score for the drawn rows, null for the others."""
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    # a row for each different score: bounded by the range of gains and noise, whatever the number of documents
    by_score = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw, above, steps = sum(n for _, n in by_score) * percent // 100, 0, []
    for score, n in by_score:
        if above >= draw:
            break
        steps.append((score, above))
        above += n
    if not steps:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cut = able & (F.col("score") >= steps[-1][0])
    more = F.broadcast(scored.sparkSession.createDataFrame(steps, "score long, above long"))
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    top = scored.where(cut).join(more, "score").withColumn("rank", F.col("above") + F.row_number().over(order))
    top = top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(*scored.columns, "rank")
    return scored.where(~F.coalesce(cut, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).unionByName(top)


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of `docs`; the rows with a rank are the sample."""
    counted = stash(bucket_counts(docs, runs, buckets, text, doc_id))
    aim = stash(bucket_counts(target.select(F.lit(None).cast("long").alias("id"), target_text), runs, buckets, target_text, "id"))
    gain = gains(merged(counted, buckets), merged(aim, buckets))
    return ranked(stash(weighed(counted, gain, seed)), percent, least_words)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: zlib's CRC in SQL, by its rule: the remainder table of the reversed polynomial, then a step a byte of each different word.
_CRC_SQL = """
    poly AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS u(i)),
    crcs AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda k: ('0x' || substr(hex(encode(w)), k, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT w FROM dw UNION SELECT DISTINCT w FROM bw), poly)"""
_WORDS_SQL = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}'))"
SQL = {
    "op12_resample": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    dw AS (SELECT r, {_WORDS_SQL} AS w FROM d),
    bw AS (SELECT {_WORDS_SQL} AS w FROM benchmark),
    {_CRC_SQL},
    cs AS (SELECT b, count(*)::DOUBLE AS n FROM dw JOIN crcs USING (w) GROUP BY b),
    ct AS (SELECT b, count(*)::DOUBLE AS n FROM bw JOIN crcs USING (w) GROUP BY b),
    sums AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s, (SELECT count(*) FROM bw)::DOUBLE AS t),
    gain AS (SELECT cs.b, floor(1000 * ln((coalesce(ct.n, 0) + 1) * (s + 10000) / ((cs.n + 1) * (t + 10000))))::BIGINT AS g FROM cs LEFT JOIN ct USING (b), sums),
    weights AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN crcs USING (w) JOIN gain USING (b) GROUP BY r),
    s AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        CASE WHEN doc_id IS NOT NULL THEN (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT END AS score FROM d LEFT JOIN weights USING (r)),
    ranks AS (SELECT *, CASE WHEN n_features >= 20 AND score IS NOT NULL THEN row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id, n_features, weight) END AS k FROM s)
    SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT count(k) * 10 // 100 FROM ranks) THEN k END AS rank FROM ranks
    """
}
