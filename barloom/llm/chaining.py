"""op6: substring dedup by collinear chaining of shared k-mer seeds.

Seeds are the window minima (of WINDOW neighbouring K-word shingles the one with the smallest fingerprint),
so texts that share WINDOW + K - 1 words share a seed. Every seed of a document is linked to the
first document (smallest doc_id) that holds it, not to all others: a passage in m documents makes m - 1
links. Exact passages of more than LEAST words whose seeds belong to other documents are found by
fingerprints of LEAST words. Stretches of repeated seeds that no passage explains are linked anew: every shingle of them to its first document among such
stretches and to the document before, so that a passage is found also where others hold its seeds in pieces. The links of a pair of documents are chained: in the order of one document's words, each link follows the best of
the links before it in both, where a gap costs GAP for each of its words in either document (so the best is a prefix maximum, which a Fenwick tree
over the other document's words keeps); the best chains are taken until none covers LEAST_SEED words. Links that no others lie near (MOST_GAP words)
are chained apart, so that a stray link hides nothing; chains in a row with gaps of at most BRIDGE words are then joined. Chains are aligned on the
texts: each stretch between two seeds by itself, both ends word by word as long as more match than not. A passage is a chain of LEAST
words or more of which IDENTITY match; a chain in which fewer do is split at its largest gap and its parts are judged.

Result of `passages`: a row per passage and document pair: doc_id, source_id (the earlier document), start, length (words of doc_id), source_start,
source_length, matched. A document's passages may overlap.

Null, empty and short texts have no seeds and no rows. Repeats within one document are not reported (op1 does
that). Rows with one doc_id and different texts are told apart by a hash of their texts (all but one of them come last in the order of documents);
copies of one row are one document. Rows without a doc_id take no part. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import stash, table
from .jaccard import _batch, grouped

K, WINDOW, GAP, LEAST_SEED, LEAST_FURTHER, LEAST, IDENTITY, REACH, MOST_GAP, BRIDGE, PORTION = 6, 12, 0.04, 12, 8, 50, 0.8, 96, 40, 150, 256
#: What a differing word takes from an end's score (a matching one adds 1), and how far below its best an end is followed.
MISS, DROP = 1.5, 9.0


def word_prints(c: tk.Chunk, roll: tk.Roller):
    low = tk.LOWER[c.buf]
    s, e, bound = tk.words(c)
    return roll.of(roll.prefix(low), s, e), s, e, bound


def minima(h: np.ndarray, bound: np.ndarray, window: int) -> np.ndarray:
    """Places of the window minima (the last of equal ones) of every text's fingerprints; a text with fewer has one."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    best = np.arange(n)
    step = 1
    while step < window:  # best[i]: place of the minimum of h[i : i + step'], doubled each time
        hop = min(step, window - step)
        other = np.minimum(best[np.minimum(np.arange(n) + hop, n - 1)], n - 1)
        ok = text[np.minimum(np.arange(n) + hop, n - 1)] == text
        better = ok & (h[other] <= h[best])
        best = np.where(better, other, best)
        step += hop
    last = np.maximum(bound[1:] - window, bound[:-1])[text]
    return np.unique(best[np.arange(n) <= last])


def seeds(docs: DataFrame) -> DataFrame:
    """f, doc_id, at: the seeds of every document and their places in it."""

    def run(batches):
        roll = tk.Roller()
        for c in tk.chunks(batches):
            w, _, _, bound = word_prints(c, roll)
            sh, b = tk.shingles(w, bound, K)
            count = np.diff(bound)
            at = minima(sh, b, WINDOW)
            doc = np.searchsorted(b, at, "right") - 1
            ok = count[doc] >= K
            at, doc = at[ok], doc[ok]
            order = np.lexsort((at, sh[at], doc))
            at, doc = at[order], doc[order]
            f = sh[at]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])
            first = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array((at - b[doc]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(f[first].view(np.int64)), pa.array(c.ids()[doc[first]]), places], names=["f", "doc_id", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, "f long, doc_id long, at array<int>")


def links(docs: DataFrame) -> DataFrame:
    """doc_id, source_id, x, y: each seed's places to those in its first document, the nth to the nth there (or the last).

    The first document is a partial minimum, and a row per repeated seed meets the seed's rows in merge joins of written
    tables, which AQE splits: a seed that a third of all documents hold is no single task's.
    """
    return linked(repeated(docs))


def repeated(docs: DataFrame) -> DataFrame:
    """f, doc_id, at, source_id: the seeds that several rows hold, and their first document."""
    own = stash(seeds(docs))
    heads = stash(own.groupBy("f").agg(F.min("doc_id").alias("source_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("f", "source_id"))
    return stash(own.join(heads.hint("merge"), "f"))


def linked(rows: DataFrame) -> DataFrame:
    first = stash(rows.where("doc_id = source_id").groupBy("f").agg(F.min("at").alias("there")))
    both = rows.where("doc_id <> source_id").join(first.hint("merge"), "f").select("doc_id", "source_id", "there", F.posexplode("at").alias("nth", "x"))
    return both.select("doc_id", "source_id", "x", F.element_at("there", F.least(F.col("nth") + 1, F.size("there"))).alias("y"))


def _stretches(batches, gap: int = WINDOW):
    """lo, hi: the stretches of a document in which repeated seeds are at most `gap` words apart, with the words around that can belong to them."""
    for b in batches:
        at, ids, lo, hi = b.column(1), [], [], []
        for i, places in zip(b.column(0).to_pylist(), at, strict=True):
            p = np.unique(places.values.to_numpy())
            cut = np.append(np.flatnonzero(np.diff(p, prepend=-2 * gap) > gap), len(p))
            a, e = p[cut[:-1]] - WINDOW + 1, p[cut[1:] - 1] + K + WINDOW - 1
            ok = e - a > LEAST
            ids.append(i)
            lo.append(np.maximum(a[ok], 0).tolist())
            hi.append(e[ok].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lo, pa.list_(pa.int32())), pa.array(hi, pa.list_(pa.int32()))], names=["doc_id", "lo", "hi"])


def _long_keys(batches, width: int = LEAST):
    """f, doc_id, x: fingerprints of all `width` words in the stretches."""
    roll = tk.Roller()
    for c in tk.chunks(batches):
        w, _, _, bound = word_prints(c, roll)
        parts, owner, first = [], [], []
        los, his = (c.rows.column(c.rows.schema.get_field_index(n)).to_pylist() for n in ("lo", "hi"))
        for i, (lo, hi) in enumerate(zip(los, his, strict=True)):
            for a, e in zip(lo, hi, strict=True):
                parts.append(w[bound[i] + a : min(bound[i] + e, bound[i + 1])])
                owner.append(i)
                first.append(a)
        if not parts:
            continue
        size = np.array([len(p) for p in parts])
        sh, b = tk.shingles(np.concatenate(parts), np.concatenate([[0], np.cumsum(size)]), width)
        part = np.repeat(np.arange(len(parts)), np.diff(b))
        at = np.flatnonzero(size[part] >= width)
        part = part[at]
        x = at - b[part] + np.array(first)[part]
        yield _batch(f=sh[at].view(np.int64), doc_id=c.ids()[np.array(owner)[part]].astype(np.int64), x=x.astype(np.int64))


def cover(start: np.ndarray, end: np.ndarray, first: int = 0) -> list[int]:
    """Places (from `first` on) of the fewest intervals with the same union: a run of one repeated word has a diagonal at every word."""
    out, far, best = [], -1, -1
    for k in [*np.lexsort((-end, start)), -1]:
        if best >= 0 and end[best] > far and (k < 0 or start[k] > far):
            out.append(first + int(best))
            far = end[best]
        if k >= 0:
            far = max(far, start[k])
            best = k if best < 0 or end[k] > end[best] else best
    return out


def _diagonals(batches):
    """Runs of long keys on one diagonal (rows sorted by document, source, diagonal and place) as passages, without those whose words others have."""
    for (doc, source, g, x), _ in grouped(batches):
        new = np.ones(len(x), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (g[1:] != g[:-1]) | (np.diff(x) > 1)
        a = np.flatnonzero(new)
        pair = np.flatnonzero(np.concatenate([[True], (doc[a][1:] != doc[a][:-1]) | (source[a][1:] != source[a][:-1]), [True]]))
        n = x[np.append(a[1:], len(x)) - 1] + LEAST - x[a]
        kept = np.array([k for i, j in zip(pair, pair[1:], strict=False) for k in cover(x[a[i:j]], x[a[i:j]] + n[i:j], i)], int)
        a, n = a[kept], n[kept]
        yield _batch(doc_id=doc[a], source_id=source[a], start=x[a], length=n, source_start=x[a] - g[a], source_length=n, matched=n)


def places_of(rows: DataFrame) -> DataFrame:
    """doc_id, at: the places of a document's repeated seeds, in order. `rows` is of `repeated`."""

    def ordered(batches):
        for b in batches:
            at = b.column(1)
            lists = [np.unique(x.values.to_numpy()) for x in at]
            bound = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bound), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32()))], names=["doc_id", "at"])

    return rows.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("at")).mapInArrow(ordered, "doc_id long, at array<int>")


def exact_passages(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Exact passages of more than LEAST words by their own words, whoever holds their seeds.

    The seeds of a passage may all have been in other documents before, in pieces, so that no link leads to the document with
    the whole passage. All are repeated, though: so the stretches of repeated seeds give a key for LEAST words each, and a key's
    first document has all of these words. `places` is of `places_of`.
    """
    spans = stash(places.mapInArrow(_stretches, "doc_id long, lo array<int>, hi array<int>").where("size(lo) > 0"))
    keys = stash(docs.join(spans.hint("merge"), "doc_id").select("doc_id", "text", "lo", "hi").mapInArrow(_long_keys, "f long, doc_id long, x long"))
    heads = stash(keys.groupBy("f").agg(F.min(F.struct("doc_id", "x")).alias("s"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("f", F.col("s.doc_id").alias("source_id"), F.col("s.x").alias("y")))
    both = keys.join(heads.hint("merge"), "f").where("doc_id <> source_id").select("doc_id", "source_id", (F.col("x") - F.col("y")).alias("g"), "x")
    return both.repartition("doc_id", "source_id").sortWithinPartitions("doc_id", "source_id", "g", "x").mapInArrow(_diagonals, PASSAGES)


def _with_previous(batches):
    """doc_id, source_id, x, y: rows (f, doc_id, x, source_id, y), in order, to their key's first document and to the last one before their own."""
    last, before = None, None  # the row before, and the last row of the document before its own, if it has the same key
    for b in batches:
        if not b.num_rows:
            continue
        f, doc, x, source, y = (b.column(i).to_numpy() for i in range(5))
        n = len(f)
        same_f, same_doc = np.zeros(n, bool), np.zeros(n, bool)
        same_f[1:] = f[1:] == f[:-1]
        same_doc[1:] = same_f[1:] & (doc[1:] == doc[:-1])
        if last is not None:
            same_f[0] = f[0] == last[0]
            same_doc[0] = same_f[0] and doc[0] == last[1]
        start = np.maximum.accumulate(np.where(same_doc, -1, np.arange(n)))  # of a document's rows of one key; -1: they began before
        own = start > 0
        prev_doc, prev_x = np.full(n, -1), np.zeros(n, np.int64)
        has = np.zeros(n, bool)
        i = start[own]
        has[own], prev_doc[own], prev_x[own] = same_f[i], doc[i - 1], x[i - 1]
        for mask, row in ((start == 0, last if same_f[0] else None), (start == -1, before)):
            if row is not None:
                has[mask], prev_doc[mask], prev_x[mask] = True, row[1], row[2]
        before = (f[-1], prev_doc[-1], prev_x[-1]) if has[-1] else None
        last = f[-1], doc[-1], x[-1]
        first, more = doc != source, has & (prev_doc != source)
        cols = [np.concatenate(v) for v in ((doc[first], doc[more]), (source[first], prev_doc[more]), (x[first], x[more]), (y[first], prev_x[more]))]
        yield _batch(doc_id=cols[0], source_id=cols[1], x=cols[2], y=cols[3])


def further_links(docs: DataFrame, places: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, source_id, x, y of the stretches whose repeated seeds no passage of their document explains.

    Where earlier documents hold a passage's seeds in pieces, too short for a passage each, no seed leads to the document with the whole passage. In such stretches (repeated seeds at
    most MOST_GAP words apart, LEAST words or more) every shingle is a key, and leads both to its first document there and to the one before: pieces do not hold the
    shingles across their ends. Documents are in order over all partitions; where one begins within a key, its first row leads to the first document only.
    """
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("spans"))
    left = places.join(spans.hint("merge"), "doc_id", "left").mapInArrow(_unexplained, "doc_id long, at array<int>")
    ranges = stash(left.mapInArrow(lambda b: _stretches(b, MOST_GAP), "doc_id long, lo array<int>, hi array<int>").where("size(lo) > 0"))
    keys = stash(docs.join(ranges.hint("merge"), "doc_id").select("doc_id", "text", "lo", "hi").mapInArrow(lambda b: _long_keys(b, K), "f long, doc_id long, x long"))
    heads = stash(keys.groupBy("f").agg(F.min(F.struct("doc_id", "x")).alias("s"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("f", F.col("s.doc_id").alias("source_id"), F.col("s.x").alias("y")))
    both = stash(keys.join(heads.hint("merge"), "f").select("f", "doc_id", "x", "source_id", "y"))
    return both.repartitionByRange("f", "doc_id").sortWithinPartitions("f", "doc_id", "x").mapInArrow(_with_previous, "doc_id long, source_id long, x long, y long")


def _unexplained(batches):
    """doc_id, at: the places outside the spans (doc_id, at, spans)."""
    for b in batches:
        ids, out = [], []
        for i, at, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            p = np.array(at, np.int64)
            for r in spans or ():
                p = p[(p < r["start"]) | (p + K > r["end"])]
            if len(p):
                ids.append(i)
                out.append(p.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "at"])


class Best:
    """Fenwick tree of prefix maxima: the largest value, and whose it is, at places up to one."""

    def __init__(self, n: int):
        self.value, self.owner = [-1e18] * (n + 1), [-1] * (n + 1)

    def put(self, place: int, value: float, owner: int) -> None:
        k = place + 1
        while k < len(self.value):
            if value > self.value[k]:
                self.value[k], self.owner[k] = value, owner
            k += k & -k

    def before(self, place: int) -> tuple[float, int]:
        """Of the places before this one."""
        value, owner, k = -1e18, -1, place
        while k > 0:
            if self.value[k] > value:
                value, owner = self.value[k], self.owner[k]
            k -= k & -k
        return value, owner


def chain(x: list[int], y: list[int], cover: int = LEAST_SEED) -> list[list[int]]:
    """The best chains of links, best first, without common links; each covers `cover` words or more.

    A link scores K, less GAP for each word of both documents between it and its predecessor. After a chain is taken, the links outside
    its words are chained again, in parts that lie more than MOST_GAP + K words apart.
    """
    most = MOST_GAP + K
    places = sorted({(a, b): i for i, (a, b) in enumerate(zip(x, y, strict=True))}.values(), key=lambda i: (x[i], y[i]))
    out, parts = [], [places]
    while parts:
        part = parts.pop()
        cut = [0, *(k for k in range(1, len(part)) if x[part[k]] - x[part[k - 1]] > most), len(part)]
        if len(cut) > 2:
            parts += [part[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            continue
        if not part or x[part[-1]] - x[part[0]] + K < cover:
            continue
        rank = {v: r for r, v in enumerate(sorted({y[i] for i in part}))}
        tree, held = Best(len(rank)), []
        score, back, start, best = [], [], [], -1
        for k, i in enumerate(part):
            if held and x[part[held[0]]] < x[i]:  # links of one place cannot follow each other
                for q in held:
                    tree.put(rank[y[part[q]]], score[q] + GAP * (x[part[q]] + y[part[q]]), q)
                held = []
            v, p = tree.before(rank[y[i]])
            v -= GAP * (x[i] + y[i])
            score.append(K + max(v, 0.0))
            back.append(p if v > 0 else -1)
            start.append(start[p] if v > 0 else x[i])
            held.append(k)
            if x[i] - start[k] + K >= cover and (best < 0 or score[k] > score[best]):
                best = k
        if best < 0:
            continue
        got, k = [], best
        while k >= 0:
            got.append(part[k])
            k = back[k]
        out.append((score[best], got[::-1]))
        a, b = x[got[-1]], x[got[0]]
        parts.append([i for i in part if not a <= x[i] <= b])
    return [g for _, g in sorted(out, key=lambda o: -o[0])]


def bridged(chains: list, x, y) -> list[list[int]]:
    """Chains of one pair, those in a row in both documents with gaps of at most BRIDGE words joined."""
    out: list[list[int]] = []
    for g in sorted((list(g) for g in chains), key=lambda g: x[g[0]]):
        if out and all(0 < v[g[0]] - v[out[-1][-1]] <= BRIDGE + K for v in (x, y)):
            out[-1] += g
        else:
            out.append(g)
    return out


def _chains(batches, cover: int = LEAST_SEED):
    """Chains of every pair of documents (rows sorted by pair)."""
    for (doc, source, x, y), _ in grouped(batches):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]), [True]])
        cut = np.flatnonzero(new)
        out, seeds_x, seeds_y = [], [], []
        for a, b in zip(cut, cut[1:], strict=False):
            xs, ys = x[a:b], y[a:b]
            if xs.max() - xs.min() + K < cover:
                continue
            if (np.diff(xs) > 0).all() and (np.diff(xs) == np.diff(ys)).all() and (b - a < 2 or np.diff(xs).max() <= MOST_GAP + K):
                got = [range(b - a)]  # one diagonal
            else:
                got = bridged(chain(xs.tolist(), ys.tolist(), cover), xs, ys)
            for g in got:
                gx, gy = xs[list(g)], ys[list(g)]
                out.append((doc[a], source[a], gx[0], gx[-1] + K, gy[0], gy[-1] + K))
                seeds_x.append(gx - gx[0])
                seeds_y.append(gy - gy[0])
        if out:
            o = np.array(out, np.int64).T
            at = np.cumsum([0, *map(len, seeds_x)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(v).astype(np.int32))) for v in (seeds_x, seeds_y)]
            yield _batch(doc_id=o[0], source_id=o[1], x0=o[2], x1=o[3], y0=o[4], y1=o[5], xs=lists[0], ys=lists[1])


def _ends(batches):
    """Fingerprints of the REACH words outside both ends of a chain, on one of its documents."""
    roll = tk.Roller()
    for c in tk.chunks(batches):
        w, _, _, bound = word_prints(c, roll)
        ids, sides, before, after, inside = [], [], [], [], []
        ends = c.rows.column(c.rows.schema.get_field_index("ends")).to_pylist()
        for i, asked in enumerate(ends):
            own = w[bound[i] : bound[i + 1]]
            for r in asked:
                ids.append(r["id"])
                sides.append(r["side"])
                before.append(own[max(0, r["lo"] - REACH) : r["lo"]][::-1].tobytes())
                after.append(own[r["hi"] : r["hi"] + REACH].tobytes())
                inside.append(own[r["lo"] : r["hi"]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sides, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(inside, pa.binary())], names=["id", "side", "before", "after", "inside"])


def same_words(a: bytes, b: bytes) -> tuple[int, int]:
    """How far two word lists match, and how many words do: up to the best score, while the score stays within DROP of the best so far."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    eq = a[:n] == b[:n]
    score = np.cumsum(np.where(eq, 1.0, -MISS))
    over = np.flatnonzero(np.maximum(np.maximum.accumulate(score), 0) - score > DROP)
    end = int(over[0]) if len(over) else n
    if not end or score[:end].max() <= 0:
        return 0, 0
    k = int(np.argmax(score[:end])) + 1
    return k, int(eq[:k].sum())


def inner_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Matching words of the stretches from one seed to the next: those from both ends on, and between them, where it is more, those
    on the diagonal or greedy along a band around it (steps over up to 8 words)."""
    n = min(len(a), len(b))
    eq = a[:n] == b[:n]
    if eq.all():
        return n
    head = int(np.argmin(eq))
    tail = int(np.argmin(np.append((a[::-1][: n - head] == b[::-1][: n - head]), False)))
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    diagonal = int((a == b).sum()) if len(a) == len(b) else 0
    i = j = got = 0
    while i < len(a) and j < len(b):
        run = np.flatnonzero(a[i : i + min(len(a) - i, len(b) - j)] != b[j : j + min(len(a) - i, len(b) - j)])
        k = int(run[0]) if len(run) else min(len(a) - i, len(b) - j)
        i, j, got = i + k, j + k, got + k
        step = next(((p, q) for s in range(1, 17) for p in range(max(0, s - 8), min(8, s) + 1) for q in (s - p,) if i + p < len(a) and j + q < len(b) and a[i + p] == b[j + q]), None)
        if step is None:
            break
        i, j = i + step[0], j + step[1]
    return head + tail + max(got, diagonal)


def judged(r: dict, least: int) -> set[tuple[int, int, int, int, int]]:
    """start, length, source_start, source_length, matched: the chain with its ends, or, where too few of its words match, the parts on both sides of its largest gap, and so on."""
    a, b = (np.concatenate([np.frombuffer(r[f"b{i}"], np.uint64)[::-1], np.frombuffer(r[f"i{i}"], np.uint64), np.frombuffer(r[f"a{i}"], np.uint64)]) for i in "01")
    off = r["x0"] - len(r["b0"]) // 8, r["y0"] - len(r["b1"]) // 8
    x, y = np.array(r["xs"]) + len(r["b0"]) // 8, np.array(r["ys"]) + len(r["b1"]) // 8
    m = np.array([inner_matches(a[p:q], b[u:v]) for p, q, u, v in zip(x, x[1:], y, y[1:], strict=False)], int)
    gap = np.maximum(np.diff(x), np.diff(y)) - m
    total = np.append(0, np.cumsum(m))
    out, parts = set(), [(0, len(x) - 1)]
    while parts:
        s, e = parts.pop()
        x0, x1, y0, y1 = x[s], x[e] + K, y[s], y[e] + K
        left, lm = same_words(a[max(0, x0 - REACH) : x0][::-1].tobytes(), b[max(0, y0 - REACH) : y0][::-1].tobytes())
        right, rm = same_words(a[x1 : x1 + REACH].tobytes(), b[y1 : y1 + REACH].tobytes())
        n, k, got = x1 - x0 + left + right, y1 - y0 + left + right, total[e] - total[s] + K + lm + rm
        if n >= least and got >= IDENTITY * max(n, k):
            out.add((int(x0 - left + off[0]), int(n), int(y0 - left + off[1]), int(k), int(got)))
        elif s < e and gap[wide := s + int(np.argmax(gap[s:e]))]:
            parts += [(s, wide), (wide + 1, e)]
    return out


def _extend(batches, least: int):
    for b in batches:
        out = [(r["doc_id"], r["source_id"], *x) for r in b.to_pylist() for x in sorted(judged(r, least))]
        o = np.array(out, np.int64).reshape(-1, 7).T
        yield _batch(doc_id=o[0], source_id=o[1], start=o[2], length=o[3], source_start=o[4], source_length=o[5], matched=o[6])


PASSAGES = "doc_id long, source_id long, start long, length long, source_start long, source_length long, matched long"


#: Rows whose doc_id another text has come after all plain ids.
LATER = 1 << 62


def with_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, bool]:
    """`docs` with __barloom_id, which is the doc_id, but for rows whose doc_id another text has too; whether there are such rows. Rows without a doc_id have none."""
    v = F.hash(F.col(text))
    shared = stash(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("__barloom_of"), v.alias("v")).groupBy("__barloom_of").agg(F.min("v").alias("__barloom_v"), F.max("v").alias("hi")).where("__barloom_v <> hi").drop("hi"))
    if not shared.limit(1).count():
        return docs.withColumn("__barloom_id", F.col(doc_id).cast("long")), False
    other = F.col("__barloom_v").isNotNull() & (F.col("__barloom_v") != v)
    later = F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("long"), v), 2) + F.lit(LATER)
    both = docs.join(shared.hint("merge"), F.col(doc_id) == F.col("__barloom_of"), "left")
    return both.withColumn("__barloom_id", F.when(other, later).otherwise(F.col(doc_id).cast("long"))).select(*docs.columns, "__barloom_id"), True


def passages(docs: DataFrame, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    rows, some = with_ids(docs, text, doc_id)
    out = passages_of(rows.select(F.col("__barloom_id").alias("doc_id"), F.col(text).alias("text")), least)
    if not some:
        return out
    own = rows.where(F.col("__barloom_id") >= LATER).select("__barloom_id", F.col(doc_id).alias("__barloom_own")).distinct()
    for name in ("doc_id", "source_id"):
        out = out.join(own.withColumnRenamed("__barloom_id", name), name, "left").withColumn(name, F.coalesce("__barloom_own", name)).drop("__barloom_own")
    return out.selectExpr(*[x.split()[0] for x in PASSAGES.split(", ")])


def passages_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    docs = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    rows = repeated(docs)
    places = stash(places_of(rows))
    found = stash(aligned(docs, linked(rows), least))
    # exact passages that lie in no passage found by chains, then what neither explains
    found = stash(found.unionByName(outside(exact_passages(docs, places).where(F.col("length") >= least), found)))
    return found.unionByName(outside(aligned(docs, further_links(docs, places, found), least, LEAST_FURTHER), found))


def outside(more: DataFrame, found: DataFrame) -> DataFrame:
    """The passages that lie in no passage of `found` of the same document."""
    own = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("spans"))
    inside = F.exists(F.coalesce("spans", F.array()), lambda p: (p["start"] <= F.col("start")) & (p["end"] >= F.col("start") + F.col("length")))
    return stash(more).join(own.hint("merge"), "doc_id", "left").where(~inside).drop("spans")


def aligned(docs: DataFrame, pairs: DataFrame, least: int = LEAST, cover: int = LEAST_SEED) -> DataFrame:
    """The passages of chained and aligned links."""
    pairs = pairs.repartition("doc_id", "source_id").sortWithinPartitions("doc_id", "source_id", "x", "y")
    chains = stash(pairs.mapInArrow(lambda b: _chains(b, cover), "doc_id long, source_id long, x0 long, x1 long, y0 long, y1 long, xs array<int>, ys array<int>").where(F.col("x1") - F.col("x0") >= cover).withColumn("id", F.xxhash64("doc_id", "source_id", "x0", "y0")))
    asked = chains.select("doc_id", F.struct("id", F.lit(0).alias("side"), F.col("x0").alias("lo"), F.col("x1").alias("hi")).alias("e")).union(chains.select("source_id", F.struct("id", F.lit(1).alias("side"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))))
    # a document that is the source of many is asked in portions of about PORTION ends
    portions = stash(asked.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / PORTION).alias("portions")))
    asked = asked.join(portions.hint("merge"), "doc_id").select("doc_id", F.pmod(F.xxhash64("e.id"), "portions").alias("part"), "e")
    asked = stash(asked.groupBy("doc_id", "part").agg(F.collect_set("e").alias("ends")).select("doc_id", "ends"))
    ends = stash(asked.hint("merge").join(docs, "doc_id").select("text", "ends").mapInArrow(_ends, "id long, side int, before binary, after binary, inside binary").dropDuplicates(["id", "side"]))
    a = ends.where("side = 0").select("id", F.col("before").alias("b0"), F.col("after").alias("a0"), F.col("inside").alias("i0"))
    b = ends.where("side = 1").select("id", F.col("before").alias("b1"), F.col("after").alias("a1"), F.col("inside").alias("i1"))
    full = chains.join(a, "id").join(b, "id").select("doc_id", "source_id", "x0", "x1", "y0", "y1", "xs", "ys", "b0", "a0", "i0", "b1", "a1", "i1")
    return full.mapInArrow(lambda batches: _extend(batches, least), PASSAGES)


def cut_passages(docs: DataFrame, spans: DataFrame, text: str = "text", doc_id: str = "doc_id", drop_empty: bool = False) -> DataFrame:
    """`docs`, all columns, without the words of `spans` (doc_id, start, length); other texts stay as they are, byte for byte. drop_empty: rows that lose all their words go."""
    by_doc = stash(spans.groupBy(F.col("doc_id").alias("__barloom_of")).agg(F.collect_set(F.struct("start", "length")).alias("__barloom_spans")))
    names = docs.columns

    def cut(batches):
        for b in batches:
            of = b.schema.get_field_index
            texts = b.column(of(text)).to_pylist()
            cuts = b.column(of("__barloom_spans")).to_pylist()
            stay = np.ones(b.num_rows, bool)
            for i, s in enumerate(cuts):
                if s and texts[i]:
                    texts[i] = without(texts[i], [(r["start"], r["start"] + r["length"]) for r in s])
                    stay[i] = not drop_empty or bool(tk.WORDS[np.frombuffer(texts[i].encode(), np.uint8)].any())
            cols = [pa.array(texts, b.schema.field(text).type) if n == text else b.column(of(n)) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stay))

    # only documents with passages go through Python
    here = F.col(doc_id) == F.col("__barloom_of")
    hit = docs.join(by_doc.hint("merge"), here).mapInArrow(cut, docs.schema)
    return docs.join(by_doc.select("__barloom_of").hint("merge"), here, "left_anti").select(*names).unionByName(hit)


def cut_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs`, all columns, where only the first document of each passage keeps it; rows that lose all their words go, rows without a doc_id stay as they are."""
    rows, _ = with_ids(docs, text, doc_id)
    found = passages_of(rows.select(F.col("__barloom_id").alias("doc_id"), F.col(text).alias("text")))
    return cut_passages(rows, found.select("doc_id", "start", "length"), text, "__barloom_id", True).drop("__barloom_id")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    buf = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = tk.words(tk.Chunk(buf, np.array([0]), np.array([len(buf)]), None))
    keep = np.ones(len(buf), bool)
    for a, b in spans:
        a, b = max(a, 0), min(b, len(s))
        if a < b:
            keep[s[a] : s[b] if b < len(s) else len(buf)] = False
    return buf[keep].tobytes().decode("utf-8", "ignore")


def op6_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
