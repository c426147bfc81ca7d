"""op4: Katz backoff language model (bigrams over unigrams), counted and evaluated in partitioned tables.

Tokens are words and one end a text, the history of a text's first token is a start. Bigrams seen CUTOFF
times or more in training, so all of them, are discounted by Good and Turing (counts up to RELIABLE); unigrams likewise, the unseen mass is the unknown word's. The backoff weight of a
history is the mass its bigrams leave over the unigram mass of words not among them, so every
distribution sums to 1 over the V training tokens and the unknown one.

Layout: a scan turns the texts into blocks of about BLOCK tokens, each with its own dictionary of word fingerprints
(64 bits) and its tokens as places in it. What a block needs to know, it asks for by sorted keys in one message for each
key range; a key range merges the messages of all blocks, counts, and answers each message in its order:
1. counts of words; 2. counts of bigrams, and which block accounts for a bigram; 3. sums by history, answered with backoff weights.
So counts are pre-aggregated by block, a frequent word is one key among many, and no table is ever
collected or broadcast: only totals and counts of counts reach the driver. Then each block evaluates its tokens:
the bigram if it is known, else backoff weight times unigram.

Null and empty texts: the end token alone. Repeated rows are counted and scored each. No training rows: every token is
unknown with probability 1 (score 0). Rows without a doc_id take no part and have no row. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import stash, table

BLOCK, CUTOFF, RELIABLE = 3 << 18, 1, 7
_END, _START = np.uint64(1), np.uint64(2)
MESSAGE = "p int, block long, kind int, keys binary, a binary, b binary"


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes, then all second ones, compressed: most numbers here are small or alike."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) if len(x) else b""


def unplanes(b: bytes, kind) -> np.ndarray:
    if not len(b):
        return np.zeros(0, kind)
    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the key ranges in sorted keys."""
    edges = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 1


def blocks_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        roll, held, size = tk.Roller(), [], 0

        def made():
            h = np.concatenate([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            words, at = np.unique(h, return_inverse=True)
            ids, train = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([pack(words)], pa.binary()), pa.array([planes(at.astype(np.uint32))], pa.binary()), pa.array([planes(n.astype(np.uint32))], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.packbits(train).tobytes()], pa.binary())],
                names=["block", "words", "tokens", "sizes", "ids", "train"],
            )

        for c in tk.chunks(batches):
            low = tk.LOWER[c.buf]
            s, e, bound = tk.words(c)
            h = roll.of(roll.prefix(low), s, e)
            n = np.diff(bound) + 1
            out = np.full(n.sum(), _END, np.uint64)
            doc = np.repeat(np.arange(len(c)), n - 1)
            out[np.arange(len(h)) + doc] = h
            held.append((out, n, c.ids(), c.rows.column(2).to_numpy(zero_copy_only=False).astype(bool)))
            size += len(out)
            if size >= BLOCK:
                yield made()
                held, size, block = [], 0, block + 1
        if held:
            yield made()

    return docs.where("doc_id is not null").select("doc_id", "text", (~is_held_out()).alias("train")).mapInArrow(run, "block long, words binary, tokens binary, sizes binary, ids binary, train binary")


class Block:
    def __init__(self, row: dict):
        self.id = row["block"]
        self.words = unpack(row["words"])
        self.tokens = unplanes(row["tokens"], np.uint32).astype(np.int64)
        self.sizes = unplanes(row["sizes"], np.uint32).astype(np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        train = np.unpackbits(np.frombuffer(row["train"], np.uint8))[: len(self.ids)].astype(bool)
        self.train = np.repeat(train, self.sizes)
        self.docs_in_training = int(train.sum())
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        v = len(self.words)
        history = np.empty_like(self.tokens)
        history[1:] = self.tokens[:-1]
        history[self.first] = v  # the start
        self.code = history * (v + 1) + self.tokens

    def pairs(self):
        """Distinct bigrams sorted by key: keys, history and word (places; the start is len(words)), each token's bigram, counts in training."""
        v = len(self.words)
        code, at = np.unique(self.code, return_inverse=True)
        h, w = code // (v + 1), code % (v + 1)
        names = np.append(self.words, _START)
        keys = tk.mix(tk.mix(names[h]) * tk.GOLDEN + names[w])
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        at = rank[at]
        return keys[order], h[order], w[order], at, np.bincount(at[self.train], minlength=len(keys)).astype(np.uint32)


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _messages(block: int, kind: int, keys: np.ndarray, parts: int, a=None, b=None) -> pa.RecordBatch:
    cut = cuts(keys, parts)
    some = [i for i in range(parts) if cut[i + 1] > cut[i]]
    part = lambda x: [None if x is None else planes(x[cut[i] : cut[i + 1]]) for i in some]
    n = len(some)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([pack(keys[cut[i] : cut[i + 1]]) for i in some], pa.binary()), pa.array(part(a), pa.binary()), pa.array(part(b), pa.binary())], names=["p", "block", "kind", "keys", "a", "b"])


def _by_range(batches):
    """The messages of each key range (rows sorted by it)."""
    held, p = [], None
    for r in _rows(batches):
        if r["p"] != p and held:
            yield p, held
            held = []
        p = r["p"]
        held.append(r)
    if held:
        yield p, held


def _answers(p, rows, out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([p] * len(rows), pa.int32()), pa.array([None] * len(rows), pa.int64()), pa.array(out, pa.binary())], names=["block", "p", "r", "data"])


def _stats(p, totals) -> pa.RecordBatch:
    n = len(totals)
    return pa.RecordBatch.from_arrays([pa.array([None] * n, pa.int64()), pa.array([p] * n, pa.int32()), pa.array([r for r, _ in totals], pa.int64()), pa.array([np.array([x], np.int64).tobytes() for _, x in totals], pa.binary())], names=["block", "p", "r", "data"])


ANSWER = "block long, p int, r long, data binary"


def count_keys(messages: DataFrame) -> DataFrame:
    """Answers (count * 2, and 1 for the block that accounts for the key) and, as rows without a block, totals: r = -1 tokens, 0 types, r types seen r times."""

    def run(batches):
        for p, rows in _by_range(batches):
            keys = [unpack(r["keys"]) for r in rows]
            sizes = np.array([len(k) for k in keys])
            u, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.bincount(at, np.concatenate([unplanes(r["a"], np.uint32) for r in rows]), len(u)).astype(np.int64)
            out = (total * 2)[at]
            out[first] += 1
            end = np.cumsum(sizes)
            yield _answers(p, rows, [planes(out[e - s : e].astype(np.uint64)) for s, e in zip(sizes, end, strict=True)])
            seen = total[total > 0]
            low = np.bincount(seen[seen <= RELIABLE + 1], minlength=RELIABLE + 2)
            yield _stats(p, [(-1, int(seen.sum())), (0, len(seen)), *((r, int(low[r])) for r in range(1, RELIABLE + 2))])

    return stash(_dealt(messages).mapInArrow(run, ANSWER))


def _dealt(messages: DataFrame) -> DataFrame:
    return messages.repartition("p").sortWithinPartitions("p", "block")


def totals_of(answers: DataFrame) -> dict[int, int]:
    out: dict[int, int] = {}
    for r in answers.where("block is null").select("r", "data").collect():  # RELIABLE + 3 rows a key range
        out[r["r"]] = out.get(r["r"], 0) + int(np.frombuffer(r["data"], np.int64)[0])
    return out


def discounts(n: dict[int, int], least: int) -> np.ndarray:
    """Good-Turing discount of each count up to RELIABLE (1 beyond, 0 below `least`); where the counts of counts give none in (0, 1], absolute discounting's."""
    d = np.ones(RELIABLE + 1)
    d[0] = 0
    n1 = max(n.get(1, 0), 1)
    common = (RELIABLE + 1) * n.get(RELIABLE + 1, 0) / n1
    for r in range(1, RELIABLE + 1):
        nr, nx = n.get(r, 0), n.get(r + 1, 0)
        x = ((r + 1) * nx / (r * nr) - common) / (1 - common) if nr and common < 1 else 0
        d[r] = x if 0.1 < x < 1 else 1 - 0.5 / r
        if r < least:
            d[r] = 0
    return d


def mass(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return c * np.where(c > RELIABLE, 1.0, d[np.minimum(c, RELIABLE)])


class Unigram:
    """P1 of words by count: discounted, or the unknown word's for count 0."""

    def __init__(self, totals: dict[int, int]):
        self.n, self.types = totals.get(-1, 0), totals.get(0, 0)
        self.d = discounts(totals, 1)
        low = sum(r * totals.get(r, 0) * (1 - self.d[r]) for r in range(1, RELIABLE + 1))
        # without discounted words the unknown word gets half a count
        self.left, self.scale = (low / self.n, 1 / self.n) if low > 0 and self.n else (0.5 / (self.n + 0.5), 1 / (self.n + 0.5))

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, mass(c, self.d) * self.scale, self.left)


def _joined(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    out = blocks
    for i, a in enumerate(answers):
        by = a.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("p", "data"))).alias(f"a{i}"))
        out = out.join(by, "block")
    return out


def _told(row: dict, name: str, kind) -> np.ndarray:
    return np.concatenate([unplanes(x["data"], kind) for x in row[name]])


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 12)
    blocks = stash(blocks_of(docs))

    def words(batches):
        for r in _rows(batches):
            b = Block(r)
            yield _messages(b.id, 0, b.words, parts, np.bincount(b.tokens[b.train], minlength=len(b.words)).astype(np.uint32))

    def bigrams(batches):
        for r in _rows(batches):
            b = Block(r)
            keys, _, _, _, n = b.pairs()
            yield _messages(b.id, 0, keys, parts, n)

    uni = count_keys(blocks.mapInArrow(words, MESSAGE))
    bi = count_keys(blocks.mapInArrow(bigrams, MESSAGE))
    uni_totals, starts = totals_of(uni), docs.where(F.col("doc_id").isNotNull() & ~is_held_out()).count()
    p1, d2 = Unigram(uni_totals), discounts(totals_of(bi), CUTOFF)

    def sums(batches):
        """By history: the unigram mass of its known words, and the mass that its bigrams have (each bigram from one block); and what every block asks."""
        for r in _rows(batches):
            b = Block(r)
            c = np.append(_told(r, "a0", np.uint64) >> 1, starts).astype(np.int64)
            _, h, w, _, _ = b.pairs()
            told = _told(r, "a1", np.uint64)
            n = (told >> 1).astype(np.int64)
            own = np.flatnonzero((told & 1).astype(bool) & (n >= CUTOFF))
            v = len(b.words)
            s = np.bincount(h[own], p1(c[w[own]]), v + 1)
            d = np.bincount(h[own], mass(n[own], d2) / c[h[own]], v + 1)
            names = np.append(b.words, _START)
            order = np.argsort(names, kind="stable")
            some = order[s[order] > 0]
            if len(some):
                yield _messages(b.id, 1, names[some], parts, s[some], d[some])
            yield _messages(b.id, 0, names[order], parts)

    def weights(batches):
        for p, rows in _by_range(batches):
            told = [r for r in rows if r["kind"] == 1]
            ask = [r for r in rows if r["kind"] == 0]
            out = []
            if told:
                u, at = np.unique(np.concatenate([unpack(r["keys"]) for r in told]), return_inverse=True)
                s = np.bincount(at, np.concatenate([unplanes(r["a"], np.float64) for r in told]), len(u))
                d = np.bincount(at, np.concatenate([unplanes(r["b"], np.float64) for r in told]), len(u))
                # where all words are known after a history, its bigrams share the whole mass (sign: a divisor)
                full = 1 - s < 1e-9
                alpha = np.where(full, -d, (1 - d) / np.maximum(1 - s, 1e-300))
            for r in ask:
                k = unpack(r["keys"])
                x = np.ones(len(k))
                if told:
                    i = np.minimum(np.searchsorted(u, k), len(u) - 1)
                    x = np.where(u[i] == k, alpha[i], 1.0)
                out.append(planes(x))
            yield _answers(p, ask, out)

    backoff = stash(_dealt(_joined(blocks, uni, bi).mapInArrow(sums, MESSAGE)).mapInArrow(weights, ANSWER))

    def score(batches):
        for r in _rows(batches):
            b = Block(r)
            c = np.append(_told(r, "a0", np.uint64) >> 1, starts).astype(np.int64)
            _, h, w, at, _ = b.pairs()
            n = (_told(r, "a1", np.uint64) >> 1).astype(np.int64)
            names = np.append(b.words, _START)
            alpha = np.empty(len(names))
            alpha[np.argsort(names, kind="stable")] = _told(r, "a2", np.float64)
            known = n >= CUTOFF
            a = alpha[h]
            p = np.where(known, mass(n, d2) / np.maximum(c[h], 1) / np.where(a < 0, -a, 1.0), np.where(a < 0, 0.0, a) * p1(c[w]))
            lp = np.log10(np.maximum(p, 1e-300))[at]
            cw = c[b.tokens]
            base = np.log10((cw + 0.5) / (p1.n + 0.5 * (p1.types + 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids), pa.array(b.sizes), pa.array(np.add.reduceat((cw > 0).astype(np.int64), b.first)), pa.array(np.full(len(b.ids), p1.n, np.int64)), pa.array(np.add.reduceat(base, b.first)), pa.array(np.add.reduceat(lp, b.first))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return _joined(blocks, uni, bi, backoff).mapInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
