"""op5: benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Every benchmark window (10 consecutive words of an item; all words of a shorter one) is a set of ordered
shingles of 5 words. The documents' words are written once. A first pass counts how often each shingle of the benchmark
occurs in them: this orders shingles by rarity. Of each window only its rarest shingle, the necessary prefix, is joined
with the documents; the shingle's place in the window bounds where an occurrence can start and whether it fits the document, and
the words there are compared exactly. Item ids are joined at the end, once for each set of windows that some document has.

The benchmark's shingles are broadcast only if they are counted to be at most BROADCAST_ROWS; the words are then compared where they are scanned.
Beyond that the same joins are shuffled, without words, and the documents that hold candidates are read for the comparison.

Null and empty texts: no words. Items without words have no windows. Equal items each count. Rows with one doc_id are told apart by a hash
of their texts and each is hit by its own words. Rows without a doc_id take no part and have no row. Empty benchmark: nothing is
hit. Empty documents: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

WINDOW, SHINGLE, BROADCAST_ROWS = 10, 5, 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z is lowered.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The key of a document row: its id, and a hash of its text.
ROW = ["doc_id", "row_hash"]


def words_of(text: str) -> Column:
    """The words of a text, A-Z lowered. Texts of ASCII alone take the faster function, which does the same to them."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _GAP), "")


def _shingles(words: str, t: int) -> Column:
    """Place and fingerprint of all t-word shingles of an array column."""
    one = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(words, i + k) for k in range(t)]).alias("h"))
    return F.when(F.size(words) >= t, F.transform(F.sequence(F.lit(0), F.size(words) - t), one)).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def item_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id (a string), w (words), size, wid (a fingerprint of w): the windows of every item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(text).alias("words")).where("size(words) > 0 and item_id is not null")
    size = F.least(F.size("words"), F.lit(WINDOW))
    one = items.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("w"))
    return one.withColumn("wid", F.xxhash64("w")).distinct()


def document_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, row_hash, n, words."""
    out = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("row_hash"), words_of(text).alias("words"))
    return out.select("doc_id", "row_hash", F.size("words").alias("n"), "words")


def matches(words: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, row_hash, start (word, from 0), size, wid: every occurrence of every window. words: of `document_words`; windows: of `item_windows`."""
    own = windows.select("w", "size", "wid").distinct()
    sizes = sorted(r["t"] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("t")).distinct().collect())  # SHINGLE rows at most
    parts = F.lit(None)
    for t in sizes:
        parts = F.when(F.least("size", F.lit(SHINGLE)) == t, _shingles("w", t)).otherwise(parts)
    shingles = stash(own.select("w", "size", "wid", F.explode(parts).alias("s")).select("w", "size", "wid", F.col("s.pos").alias("o"), F.col("s.h").alias("h"))) if sizes else None
    if shingles is None:
        return words.select(*ROW, F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("wid")).where("false")
    keys = stash(shingles.select("h").distinct())
    small = shingles.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda df: df)
    scan = F.explode(F.flatten(F.array(*[_shingles("words", t) for t in sizes]))).alias("s")
    rarity = words.select(scan).select(F.col("s.h").alias("h")).join(near(keys), "h").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # a window's rarest shingle; one that occurs nowhere makes the window impossible
    ranked = shingles.join(rarity, "h", "left").groupBy("wid", "w", "size").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "o", "h")).alias("x"))
    prefix = stash(ranked.where("x.df > 0").select("wid", "w", "size", "x.o", "x.h"))
    start = F.col("s.pos") - F.col("o")
    fits, same = (start >= 0) & (start + F.col("size") <= F.col("n")), F.slice("words", F.col("start") + 1, F.col("size")) == F.col("w")
    if small:
        found = words.select(*ROW, "n", "words", scan).join(near(prefix), F.col("s.h") == F.col("h")).where(fits).withColumn("start", start).where(same)
        return found.select(*ROW, "start", "size", "wid")
    candidates = words.select(*ROW, "n", scan).join(prefix, F.col("s.h") == F.col("h")).where(fits).select(*ROW, start.alias("start"), "size", "wid", "w").distinct()
    return words.join(candidates.hint("merge"), ROW).where(same).select(*ROW, "start", "size", "wid").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    words, windows = stash(document_words(docs, text, doc_id)), stash(item_windows(benchmark))
    found = stash(matches(words, windows))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "size")), lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    by_row = stash(found.groupBy(*ROW).agg(covered.cast("long").alias("n_hit"), F.sort_array(F.collect_set("wid")).alias("wids")))
    # the items of each set of windows, once for all documents that have it
    sets = by_row.select(F.xxhash64("wids").alias("set"), "wids").distinct()
    ids = sets.select("set", F.explode("wids").alias("wid")).join(windows.select("wid", "item_id"), "wid").groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    items = stash(ids.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    hit = by_row.select(*ROW, "n_hit", F.xxhash64("wids").alias("set")).join(items, "set").drop("set")
    none = F.lit(0).cast("long")
    return words.select(*ROW, F.col("n").cast("long").alias("n_words")).join(hit, ROW, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark window. Rows without a doc_id stay."""
    hit = stash(matches(stash(document_words(docs, text, doc_id)), stash(item_windows(benchmark))).select(F.col("doc_id").alias("__barloom_id"), F.col("row_hash").alias("__barloom_hash")).distinct())
    return docs.join(hit, (F.col(doc_id) == F.col("__barloom_id")) & (F.xxhash64(F.col(text)) == F.col("__barloom_hash")), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_GAP}'), lambda x: x <> '')"
SQL = {
    "op5_decontaminate": f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, w[i : i + least(len(w), {WINDOW}) - 1] AS g FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS u(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT size FROM bw),
    dw AS (SELECT doc_id, size, i, w[i : i + size - 1] AS g FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
    hit AS (SELECT doc_id, item_id, i, size FROM dw JOIN bw USING (size, g)),
    nh AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, size)) AS u(k) GROUP BY doc_id),
    ni AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
    """
}
