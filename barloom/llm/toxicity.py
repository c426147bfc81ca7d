"""op8: noisy-channel deobfuscation, then toxicity scoring.

Learning (from all rows that `learn` is given; the query op8 gives it those outside its held-out third, the pipeline all):
- a character trigram model of plain words, from their words;
- a lexicon of words and word beginnings (4 to 7 letters): features of toxic documents, chosen greedily by how many
  still unexplained toxic documents each adds, with its precision as its weight.
All labelled rows are counted. The lexicon has no set size: each feature explains GAIN documents or more, so it has at most a third as many as there are
toxic documents. The greedy choice runs on the driver for up to PAIRS pairs of document and feature; of more, rounds on tables first take all features at once
that come before every other feature of their documents, which gives the same choice.

Scoring reads whole texts: tokens that look disguised (letters with look-alike digits or signs, a letter
repeated, single letters spaced out) become character lattices; a Viterbi search under the character model picks the
likeliest plain word (of single letters spaced out also the likeliest words, as each separator may end one, with and without words of one letter), which is scored beside the text's own words. The score is a noisy-or of the weights
of the features found, over a base rate.

Null and empty texts, texts without a feature, and all texts where nothing can be learnt: half of the base rate (or of half the
threshold, if that is less). Documents without a label row are scored like others; rows of `labels` without toxic or doc_id, or for absent documents,
teach nothing. Tokens of any length are decoded. Copies of a row are scored each; rows without a doc_id take no part in scoring, and are judged by their
text in `drop_toxic`. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import stash, table

#: Least toxic documents of a feature; least that it adds; least precision.
LEAST, GAIN, PRECISION = 4, 3, 0.9
#: Counts that a task gathers before it passes them on; pairs of document and feature that the driver takes.
GATHER, PAIRS = 1 << 18, 1 << 20
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

#: Characters that are written for letters.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "&": "a"}

#: Log probability that a or i is a word.
ALONE = -1.0

_SIGNS = re.escape("".join(LOOKALIKES))
#: A disguised token: 3 or more letters and look-alikes with both, or a letter three times, or three or more single letters with one separator between.
#: A run of letters and look-alikes is only tried from its start, so long runs take linear time.
DISGUISED = re.compile(rf"(?<![\w@$])(?:(?<![{_SIGNS}])(?=[{_SIGNS}]*+[a-z])(?=[a-z]*+[{_SIGNS}])[a-z{_SIGNS}]{{3,}}|[a-z]*([a-z])\1\1[a-z]*|[a-z{_SIGNS}](?:[ ._*-][a-z{_SIGNS}]){{2,}})(?![a-z0-9@$])")
_ANY = re.compile(rf"[a-z][{_SIGNS}]|[{_SIGNS}][a-z]|([a-z])\1\1|(?<![a-z])[a-z{_SIGNS}][ ._*-][a-z{_SIGNS}][ ._*-][a-z{_SIGNS}](?![a-z0-9@$])")
_SPACED = re.compile(rf"[a-z{_SIGNS}](?:[ ._*-][a-z{_SIGNS}])+")
_REPEATS = re.compile(r"(.)\1\1+")


class CharModel:
    """Character trigrams over a to z with word ends (26); log probabilities with add-one smoothing."""

    def __init__(self, counts: np.ndarray | None = None):
        c = np.ones((27, 27, 27)) if counts is None else counts + 0.1
        self.log = np.log(c / c.sum(2, keepdims=True))

    @staticmethod
    def count(words: dict[str, int]) -> np.ndarray:
        c = np.zeros((27, 27, 27))
        for w, n in words.items():
            codes = [26, 26, *(ord(x) - 97 for x in w), 26]
            for a, b, x in zip(codes, codes[1:], codes[2:], strict=False):
                c[a, b, x] += n
        return c

    def split(self, run: str, alone: bool = True) -> list[str]:
        """The likeliest plain words of single letters spaced out: each separator may end a word, whose end and the next one's start the model scores. alone: a and i may be words."""
        states = {(26, 26): (0.0, "")}
        for ch in re.sub(r"[ ._*-]", "", run):
            options = LOOKALIKES.get(ch, ch)
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in states.items():
                starts = [(a, b, score, text)]
                if text:
                    # the model has no words of one letter; two do not follow each other
                    end = ALONE if alone and a == 26 and b in (0, 8) and (len(text) == 1 or len(text) > 3 and text[-4] != " ") else self.log[a, b, 26]
                    starts.append((26, 26, score + end, text + " "))
                for x, y, s, t in starts:
                    for o in options:
                        k = ord(o) - 97
                        v = s + self.log[x, y, k]
                        if (y, k) not in nxt or nxt[y, k][0] < v:
                            nxt[y, k] = (v, t + o)
            states = nxt
        return max(((s + self.log[a, b, 26], t) for (a, b), (s, t) in states.items()), default=(0, ""))[1].split()

    def decode(self, token: str, switch: float = -1.0) -> str:
        """The likeliest plain word of a token: each sign stands for one of its letters, each run of a letter for one or two of it (or all it has, if two or fewer)."""
        runs: list[list[str]] = []
        last, n = "", 0
        for ch in [*token, ""]:
            if ch == last:
                n += 1
                continue
            if last:
                options = LOOKALIKES.get(last, last if "a" <= last <= "z" else "")
                if options:
                    runs.append([o * k for o in options for k in ((n,) if n < 2 else (1, 2))])
            last, n = ch, 1
        states = {(26, 26): (0.0, "")}
        for options in runs:
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, word) in states.items():
                for o in options:
                    s, x, y = score, a, b
                    for ch in o:
                        k = ord(ch) - 97
                        s += self.log[x, y, k]
                        x, y = y, k
                    if (x, y) not in nxt or nxt[x, y][0] < s:
                        nxt[x, y] = (s, word + o)
            states = nxt
        return max(((s + self.log[a, b, 26], w) for (a, b), (s, w) in states.items()), default=(0, ""))[1]


def restored(text: str, model: CharModel, cache: dict[str, str]) -> list[str]:
    """Plain words behind the disguised tokens of a lower-case text."""
    if not _ANY.search(text):
        return []
    out = []
    for m in DISGUISED.finditer(text):
        t = _REPEATS.sub(r"\1\1\1", m[0])
        spaced = _SPACED.fullmatch(t)
        if t not in cache:
            if len(cache) > 200_000:
                cache.clear()
            whole = re.sub(r"(?<=.)[ ._*-](?=.)", "", t)
            words = [model.decode(whole)]
            if spaced:  # one word or several, or one after or before a word of one letter
                words += model.split(t) + model.split(t, False) + [model.decode(x) for x in (whole[1:] if whole[0] in "ai" else "", whole[:-1] if whole[-1] in "ai" else "") if len(x) > 2]
            cache[t] = " ".join(dict.fromkeys(words))
        out += [w for w in cache[t].split() if len(w) > 2]
    return out


def features(c: tk.Chunk, model: CharModel, cache: dict[str, str], roll: tk.Roller) -> tuple[np.ndarray, np.ndarray]:
    """Feature fingerprints of a chunk's words, word beginnings and restored words, and the document of each."""
    low = tk.LOWER[c.buf]
    extra, owners = [], []
    for i in range(len(c)):
        for w in restored(low[c.starts[i] : c.ends[i]].tobytes().decode("utf-8", "ignore"), model, cache):
            extra.append(w.encode())
            owners.append(i)
    s, e, bound = tk.words(c, LETTERS)
    doc = np.repeat(np.arange(len(c)), np.diff(bound))
    out, of = _grams(low, s, e, roll)
    docs = [doc[of]]
    if extra:
        buf = np.frombuffer(b"".join(extra), np.uint8)
        ends = np.cumsum([len(x) for x in extra])
        more, at = _grams(buf, ends - np.array([len(x) for x in extra]), ends, roll)
        out = np.concatenate([out, more])
        docs.append(np.array(owners)[at])
    return out, np.concatenate(docs)


def _grams(buf, s, e, roll):
    p = roll.prefix(buf)
    n = e - s
    out, of = [roll.of(p, s, e)], [np.arange(len(s))]
    for k in PREFIXES:
        ok = np.flatnonzero(n > k)
        out.append(roll.of(p, s[ok], s[ok] + k) ^ np.full(1, 1, np.uint64))
        of.append(ok)
    return np.concatenate(out), np.concatenate(of)


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def trigrams(c: tk.Chunk) -> np.ndarray:
    """Counts of the character trigrams of a chunk's plain words (3 to 19 letters, nothing else), as CharModel.count gives them."""
    low = tk.LOWER[c.buf]
    s, e, _ = tk.words(c)
    letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    n = e - s
    ok = (n > 2) & (n < 20) & (letters[e] - letters[s] == n)
    s, n = s[ok], n[ok]
    # each word with its two start signs and its end
    flat = np.full(int((n + 3).sum()), 26, np.int32)
    first = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    flat[np.repeat(first + 3 * np.arange(len(n)) + 2, n) + step] = low[np.repeat(s, n) + step].astype(np.int32) - 97
    out = np.bincount(flat[:-2] * 729 + flat[1:-1] * 27 + flat[2:], minlength=27**3).reshape(27, 27, 27) if len(flat) else np.zeros((27, 27, 27), int)
    out[:, 26, 26] = 0  # between two words
    return out


def present(c: tk.Chunk, model: CharModel, cache: dict[str, str], roll: tk.Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different features of a chunk, and the feature's place among them and the document of each pair, without repeats."""
    f, d = features(c, model, cache, roll)
    u, at = np.unique(f.view(np.int64), return_inverse=True)
    pair = np.unique(d * max(len(u), 1) + at)
    return u, pair % max(len(u), 1), pair // max(len(u), 1)


def cover(pairs: DataFrame) -> dict[int, float]:
    """Weights of the features chosen greedily among `pairs` (doc_id, f, p and n, the toxic and clean rows with f), each for the most documents that none chosen before has, times its precision; of equal ones the smallest."""
    chosen: dict[int, float] = {}
    precision, weight = F.col("p") / (F.col("p") + F.col("n")), (F.col("p") / (F.col("p") + F.col("n") + 1)).alias("w")
    while pairs.count() > PAIRS:
        gain = stash(pairs.groupBy("f", "p", "n").agg((F.count(F.lit(1)) * precision).alias("gain")).where(F.col("gain") >= GAIN * PRECISION))
        pairs = stash(pairs.join(gain.select("f", "gain"), "f"))
        # what comes first in all its documents is chosen before anything that could lessen its gain
        first = pairs.groupBy("doc_id").agg(F.max(F.struct("gain", F.bitwise_not("f").alias("g"))).alias("first"))
        ahead = stash(pairs.join(first, "doc_id").groupBy("f", "p", "n").agg(F.min(F.col("first.g") == F.bitwise_not("f")).alias("ahead")).where("ahead").select("f", weight))
        t = ahead.toArrow()
        chosen |= zip(t["f"].to_pylist(), t["w"].to_pylist(), strict=True)
        pairs = stash(pairs.join(pairs.join(ahead, "f").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "f", "p", "n"))
    t = pairs.select("doc_id", "f", "p", "n").toArrow()
    _, doc = np.unique(t["doc_id"].to_numpy(), return_inverse=True)
    f, some, at = np.unique(t["f"].to_numpy(), return_index=True, return_inverse=True)
    p, n = t["p"].to_numpy()[some], t["n"].to_numpy()[some]
    left = np.bincount(at, minlength=len(f))
    of_doc, of_f = np.argsort(doc, kind="stable"), np.argsort(at, kind="stable")
    doc_bound, f_bound = np.searchsorted(doc[of_doc], np.arange(len(doc) + 1)), np.searchsorted(at[of_f], np.arange(len(f) + 1))
    open_ = np.ones(len(doc), bool)
    # gains only fall: a feature whose gain is still the one it was queued with is the best
    queue = [(-float(x), k) for k, x in enumerate(left * (p / (p + n)))]
    heapq.heapify(queue)
    while queue:
        was, k = heapq.heappop(queue)
        now = float(left[k] * (p[k] / (p[k] + n[k])))
        if now < GAIN * PRECISION:
            continue
        if now < -was:
            heapq.heappush(queue, (-now, k))
            continue
        chosen[int(f[k])] = float(p[k] / (p[k] + n[k] + 1))
        for i in doc[of_f[f_bound[k] : f_bound[k + 1]]]:
            if open_[i]:
                open_[i] = False
                left[at[of_doc[doc_bound[i] : doc_bound[i + 1]]]] -= 1
    return chosen


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], np.ndarray, float]:
    """Weights by feature, counts of character trigrams, base rate."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos or not neg:
        return {}, np.zeros((27, 27, 27)), 0.5 if pos else 0.0
    train = stash(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(rows.hint("merge"), "doc_id"))

    def chars(batches):
        t = np.zeros((27, 27, 27), np.int64)
        for c in tk.chunks(batches):
            t += trigrams(c)
        t = t.ravel()
        k = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t[k])], names=["k", "n"])

    counts = np.zeros(27**3)
    for r in train.select("text").mapInArrow(chars, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # 27**3 rows at most
        counts[r["k"]] = r["n"]
    counts = counts.reshape(27, 27, 27)

    def count(batches):
        model, cache, roll = CharModel(counts), {}, tk.Roller()
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            f, p, q = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at = np.unique(f, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u), *(pa.array(np.bincount(at, x).astype(np.int64)) for x in (p, q))], names=["f", "p", "n"])

        for c in tk.chunks(batches):
            u, i, d = present(c, model, cache, roll)
            toxic = c.ids("toxic")[d] == 1
            held.append((u, np.bincount(i[toxic], minlength=len(u)), np.bincount(i[~toxic], minlength=len(u))))
            if sum(len(x[0]) for x in held) > GATHER:
                yield merged()
                held.clear()
        if held:
            yield merged()

    sums = train.select("text", "toxic").mapInArrow(count, "f long, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    good = stash(sums.where((F.col("p") >= LEAST) & (F.col("p") / (F.col("p") + F.col("n")) >= PRECISION)))

    def found(batches):
        model, cache, roll = CharModel(counts), {}, tk.Roller()
        for c in tk.chunks(batches):
            u, i, d = present(c, model, cache, roll)
            yield pa.RecordBatch.from_arrays([pa.array(c.ids()[d]), pa.array(u[i])], names=["doc_id", "f"])

    pairs = train.where("toxic = 1").select("doc_id", "text").mapInArrow(found, "doc_id long, f long").join(good, "f").distinct()
    return cover(stash(pairs)), counts, pos / (pos + neg)


def _scorer(weights: dict[int, float], counts: np.ndarray, base: float):
    """Scores of a chunk's texts and how many features each has; made once a task."""
    keys = np.array(sorted(weights), np.int64)
    logs = np.array([np.log1p(-min(weights[int(k)], 0.9999)) for k in keys])
    floor = min(base, THRESHOLD / 2)

    def make():
        model, cache, roll = CharModel(counts), {}, tk.Roller()

        def score(c):
            total, found = np.zeros(len(c)), np.zeros(len(c), np.int64)
            if len(keys):
                f, d = features(c, model, cache, roll)
                f = f.view(np.int64)
                i = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
                ok = np.flatnonzero(keys[i] == f)
                pairs = np.unique(np.stack([d[ok], i[ok]]), axis=1)
                total = np.bincount(pairs[0], logs[pairs[1]], len(c))
                found = np.bincount(pairs[0], minlength=len(c))
            # no evidence at all: half the base rate
            return 1 - (1 - floor / 2) * np.exp(total), found

        return score

    return make


def score_toxicity(docs: DataFrame, weights: dict[int, float], counts: np.ndarray, base: float) -> DataFrame:
    """doc_id, score and n_evidence (features found), by document."""
    make = _scorer(weights, counts, base)

    def run(batches):
        score = make()
        for c in tk.chunks(batches):
            s, found = score(c)
            yield pa.RecordBatch.from_arrays([c.rows.column(0), pa.array(s), pa.array(found)], names=["doc_id", "score", "n_evidence"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_evidence long")


def drop_toxic(docs: DataFrame, weights: dict[int, float], counts: np.ndarray, base: float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below the threshold."""
    make = _scorer(weights, counts, base)

    def run(batches):
        score = make()
        for c in tk.chunks(batches):
            yield c.rows.filter(pa.array(score(c)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, seen = table(spark, sf_dir, "documents"), ~is_held_out()
    out = score_toxicity(docs, *learn(docs.where(seen), table(spark, sf_dir, "labels").where(seen)))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_evidence")
