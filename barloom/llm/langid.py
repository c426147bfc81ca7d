"""op7: multilingual mixture inference.

Learning: counts of hashed character n-grams (1 to 4 bytes of a word with its ends marked) by language over a
sample of at most about SAMPLE_PER_LANG training documents a language, drawn by a hash of the id. A
prediction sees only the text: every distinct word gets a likelihood by language, expectation-maximisation
turns a document's words into language proportions, and the language set (the best single language, the
two or three leading ones, or all) is the one with the best likelihood less PENALTY * log(words) for each
language more. lang_pred is the largest share in that set, score its share.

Null, empty and letterless texts: und, score 0. No training rows: und for all. Ties go to the language first
by name. Rows without a doc_id take no part and have no row; copies of a row are predicted each. Very long texts are read whole. Empty table: no rows. Other
columns are ignored. The model is a row of BUCKETS counts a language on the driver; more than MOST_LANGUAGES different values of lang are refused, not cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import table

#: Bounds of the learning sample (documents a language) and of the model (buckets of hashed n-grams).
SAMPLE_PER_LANG, BUCKETS, ORDERS = 3000, 1 << 16, (1, 2, 3, 4)
ROUNDS, PENALTY, SMOOTH, MOST_LANGUAGES = 12, 3.0, 0.5, 2000

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words, and the word that each is of."""
    n = ends - starts + 2
    bound = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(bound[-1]) - bound[owner]
    inside = (at > 0) & (at < n[owner] - 1)
    chars = np.full(len(owner), 1, np.uint64)
    chars[inside] = tk.LOWER[buf[(starts[owner] + at - 1)[inside]]]
    out, own, acc = [], [], np.zeros(len(owner), np.uint64)
    for k in ORDERS:
        m = len(owner) - k + 1
        if m <= 0:
            break
        acc = acc[:m] * tk.U64(257) + chars[k - 1 :]
        ok = owner[:m] == owner[k - 1 :]
        if k == 1:
            ok = ok & inside
        out.append((tk.mix(acc[ok] + np.full(1, k, np.uint64) * tk.GOLDEN) % tk.U64(BUCKETS)).astype(np.int64))
        own.append(owner[:m][ok])
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate(own) if own else np.zeros(0, np.int64)


def in_training(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 != 2


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (language, bucket)."""
    rows = docs.where(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds {MOST_LANGUAGES}")
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, SAMPLE_PER_LANG / sizes[k]))])
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for c in tk.chunks(batches):
            s, e, bound = tk.words(c, LETTERS)
            b, own = grams(c.buf, s, e)
            lang = np.array(c.rows.column(2).to_pylist(), object)
            code, names = np.unique(lang, return_inverse=True)
            doc = np.repeat(np.arange(len(c)), np.diff(bound))
            of = names[doc[own]]
            for i, name in enumerate(code):
                total[name] = total.get(name, 0) + np.bincount(b[of == i], minlength=BUCKETS)
        for name, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(t[at])], names=["lang", "bucket", "n"])

    table = np.full((len(langs), BUCKETS), SMOOTH)
    got = drawn.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS rows at most
    table[got["lang"].map(langs.index).to_numpy(int), got["bucket"].to_numpy(int)] += got["n"].to_numpy(float)
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def mixture(like: np.ndarray, weight: np.ndarray, bound: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM proportions (document, language) and log likelihoods; like: (word, language), bound: each document's words."""
    n = np.diff(bound)
    doc = np.repeat(np.arange(len(n)), n)
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1e-300)
    full, ll = n > 0, np.zeros(len(n))
    at = bound[:-1][full]
    if not len(at):
        return share, ll
    total = np.add.reduceat(weight, at)[:, None]
    for k in range(ROUNDS):
        r = share[doc] * like
        z = r.sum(1, keepdims=True)
        if k == ROUNDS - 1:
            ll[full] = np.add.reduceat(weight * np.log(np.maximum(z[:, 0], 1e-300)), at)
            break
        r *= weight[:, None] / np.maximum(z, 1e-300)
        share[full] = np.add.reduceat(r, at, axis=0) / total
    return share, ll


def infer(like: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Shares (document, language) under the language set of the best penalised likelihood."""
    d, k = len(bound) - 1, like.shape[1]
    share, ll = mixture(like, weight, bound, np.ones((d, k)))
    words = np.maximum(np.diff(bound), 2)
    best, best_ll = share.copy(), ll - PENALTY * (k - 1) * np.log(words)
    order = np.argsort(-share, axis=1, kind="stable")
    for m in range(1, min(3, k - 1) + 1):
        allowed = np.zeros((d, k))
        np.put_along_axis(allowed, order[:, :m], 1.0, 1)
        s, l = mixture(like, weight, bound, allowed) if m > 1 else (allowed, mixture_single(like, weight, bound, order[:, 0]))
        l = l - PENALTY * (m - 1) * np.log(words)
        up = l >= best_ll
        best[up], best_ll[up] = s[up], l[up]
    return best


def mixture_single(like: np.ndarray, weight: np.ndarray, bound: np.ndarray, lang: np.ndarray) -> np.ndarray:
    n = np.diff(bound)
    v = np.concatenate([[0], np.cumsum(weight * np.log(np.maximum(like[np.arange(len(weight)), np.repeat(lang, n)], 1e-300)))])
    return v[bound[1:]] - v[bound[:-1]]


def identify_languages(docs: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and shares (by language, in the order of `langs`)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(np.ascontiguousarray(log_p.T))  # BUCKETS x languages
    schema = "doc_id long, lang_pred string, score double, shares array<double>"

    def predict(batches):
        table, roll = model.value, tk.Roller()
        for c in tk.chunks(batches):
            share = np.zeros((len(c), len(langs)))
            s, e, bound = tk.words(c, LETTERS)
            if len(langs) and len(s):
                low = tk.LOWER[c.buf]
                h = roll.of(roll.prefix(low), s, e)
                _, first, at = np.unique(h, return_index=True, return_inverse=True)
                b, own = grams(c.buf, s[first], e[first])
                by = np.argsort(own, kind="stable")
                cut = np.searchsorted(own[by], np.arange(len(first)))
                log = np.add.reduceat(table[b[by]], cut, axis=0).astype(np.float64)
                log /= len(ORDERS)  # the orders overlap
                like = np.exp(log - log.max(1, keepdims=True))
                share = infer(like[at], np.ones(len(s)), bound)
            none = np.diff(bound) == 0
            if not len(langs):
                none[:] = True
            for i in np.flatnonzero(~none):  # words of other bytes than A to Z may hold no letter
                t = c.buf[c.starts[i] : c.ends[i]]
                if not (LETTERS[:128][t[t < 128]]).any() and not any(x.isalpha() for x in t.tobytes().decode("utf-8", "replace")):
                    none[i] = True
            share[none] = 0
            best = share.argmax(1) if len(langs) else np.zeros(len(c), int)
            names = np.array([*langs, "und"], object)[np.where(none, len(langs), best)]
            shares = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * len(langs)), pa.array(share.ravel()))
            yield pa.RecordBatch.from_arrays([c.rows.column(0), pa.array(names, pa.string()), pa.array(np.clip(share.max(1, initial=0), 0, 1)), shares], names=["doc_id", "lang_pred", "score", "shares"])

    out = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(predict, schema)
    return out.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score", "shares")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, *learn(docs)).drop("shares")
