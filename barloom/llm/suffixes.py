"""op1: exact removal of repeated byte strings with logarithmic families of suffix arrays.

Suffixes are sampled: of WIDTH - KEY + 1 neighbouring KEY-byte strings the one with the smallest fingerprint (the last
of equal ones) is an anchor, so equal WIDTH-byte windows hold the same anchor at the same place. The windows of one
anchor are neighbours and make a segment (at most 2 * WIDTH - KEY bytes).

1. Segments that are equal as a whole (128-bit fingerprints, partial counts) repeat all their windows; one of them
   stands for all in what follows.
2. Segments whose KEY bytes also occur in other segments are dealt by these bytes. A key with more than HOT different segments
   is dealt by longer strings instead, which are sorted apart by a quarter of their windows a round: what all windows of
   the quarter have in common is the longer key, segments that agree on all bytes of the quarter share all its windows and go
   on as one. So a hot key never meets in one task, and each round only takes what still shares its longer key.
3. Each task builds families of levels for its keys. A batch of segments gets a suffix array of its right contexts and one of
   its reversed left contexts with their common-prefix lengths, and is scanned for matches; while a level of the same size
   class exists, the two are merged in linear time and scanned for matches between them, and the larger level
   goes on (sizes grow geometrically). Batches are drawn across keys, so the segments of a key lie in several levels.
   Two windows are equal where the right contexts agree far enough and the left ones do; matches are exact, on bytes.
   Every pair of batches meets in exactly one merge, so no match is lost.

Repeated windows come back by document, their union is removed. `SuffixIndex` keeps such levels as tables between calls: a new batch of
documents is scanned against each level, then equal-sized levels are merged.

Null text: empty. Repeated rows and equal texts remove each other wherever they have WIDTH bytes. Rows with one doc_id
are told apart by a hash of their texts and get their own results. Rows without a doc_id take no part and have no row. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import stash, table
from .jaccard import _batch, grouped

WIDTH, KEY, HOT, BATCH = 200, 72, 512, 4096
#: Parts into which a hot key's windows are split a round.
FAN = 4

SEGMENT = "k long, s1 long, s2 long, doc_id long, v int, at int, lo int, hi int"
INDEX = "k long, s1 long, s2 long, a int, lo int, hi int, seg binary"


def anchors(c: tk.Chunk, roll: tk.Roller, width: int, key: int):
    """Of every text: anchor places, first and last window start of each anchor, and its text."""
    p = roll.prefix(c.buf)
    n = c.ends - c.starts
    count = np.maximum(n - key + 1, 0)
    count[n < width] = 0
    bound = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(c)), count)
    at = np.arange(bound[-1]) - bound[text] + c.starts[text]
    h = roll.of(p, at, at + key)
    # the minimum of each window, by window start
    span = width - key + 1
    best = np.arange(len(h))
    step = 1
    while step < span:
        hop = min(step, span - step)
        other = best[np.minimum(np.arange(len(h)) + hop, len(h) - 1)]
        better = (np.arange(len(h)) + hop < bound[text + 1]) & (h[other] <= h[best])
        best = np.where(better, other, best)
        step += hop
    windows = np.flatnonzero(np.arange(len(h)) + span <= bound[text + 1])
    own = best[windows]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[windows][1:] != text[windows][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    return p, h[own[first]], at[own[first]], at[windows[first]], at[windows[last]], text[windows[first]]


def _segments(width, key, with_bytes=False):
    def run(batches):
        roll, second = tk.Roller(), tk.Roller(1)
        for c in tk.chunks(batches):
            p, h, at, lo, hi, text = anchors(c, roll, width, key)
            q = second.prefix(c.buf)
            place = (at - lo).astype(np.uint64)
            s1 = roll.of(p, lo, hi + width) ^ tk.mix(place)
            s2 = second.of(q, lo, hi + width) ^ tk.mix(place)
            base = c.starts[text]
            out = {"k": h.view(np.int64), "s1": s1.view(np.int64), "s2": s2.view(np.int64), "doc_id": c.ids()[text], "v": c.ids("v")[text], "at": (at - base).astype(np.int32), "lo": (lo - base).astype(np.int32), "hi": (hi - base).astype(np.int32)}
            if with_bytes:
                out["seg"] = pa.array([c.buf[a:b].tobytes() for a, b in zip(lo.tolist(), (hi + width).tolist(), strict=True)], pa.binary())
            yield _batch(**out)

    return run


class Level:
    """Segments in the order of their key and right context, and in that of their key and reversed left context, each with common-prefix lengths to the one before (below 0: another key)."""

    def __init__(self, right, left, lo, hi, ids, sa=None, rsa=None, second=None):
        self.right, self.left, self.lo, self.hi, self.ids = right, left, lo, hi, ids
        self.sa = np.argsort(texts(right), kind="stable") if sa is None else sa
        self.rsa = np.argsort(texts(left), kind="stable") if rsa is None else rsa
        self.lcp, self.rlcp = common(right, self.sa), common(left, self.rsa)
        #: which segments are of the second of two merged levels
        self.second = np.zeros(len(ids), bool) if second is None else second

    def __len__(self):
        return len(self.ids)


def keyed(key: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Context bytes with the key's eight before them."""
    return np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), ctx], axis=1)


def texts(ctx: np.ndarray) -> np.ndarray:
    """Rows as byte strings, which numpy orders."""
    return np.ascontiguousarray(ctx).view(f"S{ctx.shape[1]}").ravel()


def common(ctx: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many context bytes each row has in common with the one before."""
    out = np.full(len(order), -1)
    if len(order) > 1:
        diff = ctx[order[1:]] != ctx[order[:-1]]
        out[1:] = np.where(diff.any(1), diff.argmax(1), ctx.shape[1]) - 8
    return out


def merge(a: Level, b: Level) -> Level:
    """Both levels' segments; the sorted orders are interleaved, not sorted again."""

    def interleaved(ca, cb, oa, ob):
        at = np.searchsorted(texts(ca[oa]), texts(cb[ob]), "right") + np.arange(len(ob))
        out = np.empty(len(oa) + len(ob), int)
        free = np.ones(len(out), bool)
        free[at] = False
        out[at], out[free] = ob + len(oa), oa
        return out

    cat = lambda f: np.concatenate([getattr(a, f), getattr(b, f)])
    return Level(cat("right"), cat("left"), cat("lo"), cat("hi"), cat("ids"), interleaved(a.right, b.right, a.sa, b.sa), interleaved(a.left, b.left, a.rsa, b.rsa), np.arange(len(a) + len(b)) >= len(a))


def scan(level: Level, hit: np.ndarray, side: int, between: bool) -> int:
    """Marks hit[segment id, window] of the windows that two segments of the level share (between: of different merged levels); how many it marked.

    Window w (left bytes) of a segment needs side - w right bytes: segments in one run of the suffix array with common prefixes
    that long, and in one run of the reversed array with w, share the window.
    """

    def longest(order, lcp):
        out = np.empty(len(order), int)
        out[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        return out

    first = np.maximum(level.lo, side - longest(level.sa, level.lcp))
    last = np.minimum(level.hi, longest(level.rsa, level.rlcp))
    able, marked = np.flatnonzero(first <= last), 0
    if len(able) < 2:
        return 0
    rank_r, rank_l = np.empty(len(level), int), np.empty(len(level), int)
    for w in range(int(first[able].min()), int(last[able].max()) + 1):
        some = able[(first[able] <= w) & (w <= last[able])]
        if len(some) < 2:
            continue
        rank_r[level.sa] = np.cumsum(level.lcp < side - w)
        rank_l[level.rsa] = np.cumsum(level.rlcp < w)
        code = rank_r[some] * (len(level) + 1) + rank_l[some]
        order = np.argsort(code, kind="stable")
        c = code[order]
        run = np.cumsum(np.concatenate([[True], c[1:] != c[:-1]])) - 1
        if between:
            of = level.second[some[order]]
            ok = (np.bincount(run, of) > 0) & (np.bincount(run, ~of) > 0)
        else:
            ok = np.bincount(run) > 1
        found = level.ids[some[order][ok[run]]]
        hit[found, w] = True
        marked += len(found)
    return marked


class Family:
    """Levels of geometrically growing sizes; `merges` and `between` count the merges and the windows they found."""

    def __init__(self, hit, side):
        self.levels: dict[int, Level] = {}
        self.hit, self.side, self.merges, self.between = hit, side, 0, 0

    def _merged(self, a: Level, b: Level) -> Level:
        both = merge(a, b)
        self.merges += 1
        self.between += scan(both, self.hit, self.side, True)
        return both

    def add(self, batch: Level) -> None:
        scan(batch, self.hit, self.side, False)
        size = 0
        while size in self.levels:
            batch = self._merged(self.levels.pop(size), batch)
            size += 1
        self.levels[size] = batch

    def close(self) -> None:
        rest = [self.levels[k] for k in sorted(self.levels)]
        while len(rest) > 1:
            rest[:2] = [self._merged(rest[0], rest[1])]


def matched(k, a, lo, hi, seg, side: int, key: int, batch: int | None = None) -> tuple[np.ndarray, Family]:
    """hit[segment, window]: the windows that segments with one key share."""
    n, batch = len(k), batch or BATCH
    right, left = np.zeros((n, side), np.uint8), np.zeros((n, side), np.uint8)
    for i, s in enumerate(seg):
        s = np.frombuffer(s, np.uint8)
        # the segment starts `a` bytes before the anchor
        r, l = s[a[i] + key : a[i] + key + side], s[: a[i]][::-1]
        right[i, : len(r)], left[i, : len(l)] = r, l
    k = k.view(np.uint64)
    right, left = keyed(k, right), keyed(k, left)
    fam = Family(np.zeros((n, side + 1), bool), side)
    drawn = np.argsort(tk.mix(np.arange(n, dtype=np.uint64) + tk.GOLDEN), kind="stable")
    for at in range(0, n, batch):
        i = drawn[at : at + batch]
        fam.add(Level(right[i], left[i], lo[i], hi[i], i))
    fam.close()
    return fam.hit, fam


def _match(side, key):
    """Index rows (sorted by key) to the repeated windows of each, as runs by left bytes."""

    def run(batches):
        for (k, s1, s2, a, lo, hi, seg), _ in grouped(batches):  # whole keys
            hit, _ = matched(k, a, lo, hi, seg, side, key)
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            i, first = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            yield _batch(s1=s1[i], s2=s2[i], first=first.astype(np.int32), last=(end - 1).astype(np.int32))

    return run


def _split(side, key):
    """Entries of hot keys to those of each FANth of their windows: f, what all these windows have in common, and u1, u2, all their bytes."""

    def run(batches):
        roll, second = tk.Roller(), tk.Roller(1)
        for c in tk.chunks(batches, "seg"):
            p, q = roll.prefix(c.buf), second.prefix(c.buf)
            i = np.repeat(np.arange(len(c)), FAN)
            child = np.tile(np.arange(FAN), len(c))
            from_, to = c.ids("n0").astype(int)[i], c.ids("n1").astype(int)[i]
            size = -(-(to - from_ + 1) // FAN)
            n0 = from_ + child * size
            n1 = np.minimum(n0 + size - 1, to)
            lo, hi = np.maximum(c.ids("lo")[i], n0), np.minimum(c.ids("hi")[i], n1)
            ok = lo <= hi
            i, n0, n1, lo, hi = i[ok], n0[ok], n1[ok], lo[ok], hi[ok]
            at = c.starts[i] + c.ids("a")[i]
            name = tk.mix((n0 * 1024 + n1).astype(np.uint64) + tk.GOLDEN)
            f = roll.of(p, at - n0, at + key + side - n1) ^ name
            own = tk.mix((lo * 1024 + hi).astype(np.uint64))
            u1 = roll.of(p, at - hi, at + key + side - lo) ^ own
            u2 = second.of(q, at - hi, at + key + side - lo) ^ own
            seg = c.rows.column("seg").take(pa.array(i))
            yield _batch(f=f.view(np.int64), u1=u1.view(np.int64), u2=u2.view(np.int64), s1=c.ids("s1")[i], s2=c.ids("s2")[i], a=c.ids("a")[i], lo=lo.astype(np.int32), hi=hi.astype(np.int32), n0=n0.astype(np.int32), n1=n1.astype(np.int32), seg=seg)

    return run


def split_hot(rows: DataFrame, side: int, key: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Index rows of hot keys to rows under longer keys of at most HOT each, and the runs (s1, s2, first, last) found on the way."""
    ready, found = None, None
    entries = rows.withColumn("n0", F.lit(0)).withColumn("n1", F.lit(side))
    width = side + 1
    while True:
        width = -(-width // FAN)
        entries = stash(entries.select("s1", "s2", "a", "lo", "hi", "n0", "n1", "seg").mapInArrow(_split(side, key), "f long, u1 long, u2 long, s1 long, s2 long, a int, lo int, hi int, n0 int, n1 int, seg binary"))
        # one entry of those that agree on all bytes goes on; the others, and it, share all their windows
        kinds = stash(entries.groupBy("f", "u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s1", "s2")).alias("one")))
        same = entries.join(kinds.where("n > 1").select("u1", "u2", "f").hint("merge"), ["f", "u1", "u2"], "left_semi").select("s1", "s2", F.col("lo").alias("first"), F.col("hi").alias("last"))
        found = same if found is None else found.unionByName(same)
        if width == 1:
            return ready, found
        groups = kinds.groupBy("f").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        ones = kinds.join(groups.hint("merge"), "f").select("f", "m", "one.*")
        left = stash(entries.join(ones.hint("merge"), ["f", "s1", "s2"]).select(F.col("f").alias("k"), "s1", "s2", "a", "lo", "hi", "n0", "n1", "seg", "m"))
        few = left.where(F.col("m") <= HOT).select("k", "s1", "s2", "a", "lo", "hi", "seg")
        ready = few if ready is None else ready.unionByName(few)
        entries = left.where(F.col("m") > HOT)
        if not entries.limit(1).count():
            return ready, found


def repeats_of(seg: DataFrame, fetch, width: int, key: int) -> DataFrame:
    """doc_id, v, lo, hi: runs of window starts whose windows also occur elsewhere among some segments. fetch: adds `seg`, a segment's bytes."""
    side = width - key
    keys = seg.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    some = stash(seg.join(stash(keys), "k"))
    classes = stash(some.groupBy("k", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "v", "lo", "hi", "at")).alias("one")))
    whole = some.join(classes.where("n > 1").select("s1", "s2", "k"), ["k", "s1", "s2"], "left_semi").select("doc_id", "v", "lo", "hi")
    several = stash(classes.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    part = stash(classes.join(several, "k").select("k", "s1", "s2", "n", "m", "one.*"))
    rows = stash(fetch(part).select("k", "s1", "s2", (F.col("at") - F.col("lo")).alias("a"), (F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo")).alias("hi"), "seg", "m"))
    index = rows.where(F.col("m") <= HOT).select("k", "s1", "s2", "a", "lo", "hi", "seg")
    hot, runs = rows.where(F.col("m") > HOT), None
    if hot.limit(1).count():
        more, runs = split_hot(hot.select("s1", "s2", "a", "lo", "hi", "seg"), side, key)
        index = index if more is None else index.unionByName(more)
    got = index.repartition("k").sortWithinPartitions("k").mapInArrow(_match(side, key), "s1 long, s2 long, first int, last int")
    got = stash(got if runs is None else got.unionByName(runs))
    lone = stash(part.where("n = 1").select("s1", "s2", "doc_id", "v", "at"))
    return whole.unionByName(lone.join(got, ["s1", "s2"]).select("doc_id", "v", (F.col("at") - F.col("last")).alias("lo"), (F.col("at") - F.col("first")).alias("hi")))


def _bytes(width):
    """The bytes of the segments asked of each document."""

    def run(batches):
        for c in tk.chunks(batches):
            asked = c.rows.column("e")
            e = asked.flatten()
            doc = np.repeat(np.arange(len(c)), np.diff(asked.offsets.to_numpy()))
            cols = {n: e.field(n) for n in ("k", "s1", "s2", "n", "m", "lo", "hi", "at")}
            lo = c.starts[doc] + cols["lo"].to_numpy()
            end = c.starts[doc] + cols["hi"].to_numpy() + width
            seg = pa.array([c.buf[x:y].tobytes() for x, y in zip(lo.tolist(), end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols.values(), seg], names=[*cols, "seg"])

    return run


def named(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, v, text; v tells rows with one doc_id and different texts apart."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.hash(F.col(text)).alias("v"), F.col(text).alias("text")).where("doc_id is not null")


def repeated_windows(docs: DataFrame, width: int, key: int) -> DataFrame:
    """doc_id, v, lo, hi: runs of window starts (bytes) whose windows also occur elsewhere in `docs` (as `named` gives them)."""

    def fetch(part):
        asked = part.select("doc_id", "v", F.struct("k", "s1", "s2", "n", "m", "lo", "hi", "at").alias("e")).groupBy("doc_id", "v").agg(F.collect_list("e").alias("e"))
        texts_ = asked.join(docs, ["doc_id", "v"]).select("text", "e")
        # repeated rows give the same segments
        return texts_.mapInArrow(_bytes(width), "k long, s1 long, s2 long, n long, m long, lo int, hi int, at int, seg binary")

    return repeats_of(stash(docs.mapInArrow(_segments(width, key), SEGMENT)), fetch, width, key)


class SuffixIndex:
    """A logarithmic family of levels as tables in a shared folder, for documents that come in batches.

    `add` gives the repeated windows of the new batch and of the documents before that share them: the batch is
    scanned in itself and against each level (only the level's segments whose key the batch holds are read on). Then it becomes a level of size 1, and
    while there are two levels of a size they are merged, sorted, into one of twice the size. `levels`: size -> path; `merges` counts the merges.
    """

    def __init__(self, folder: str, width: int = WIDTH, key: int = KEY):
        self.folder, self.width, self.key = folder.rstrip("/"), width, key
        self.levels: dict[int, str] = {}
        self.merges = 0

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        rows.repartition("k").sortWithinPartitions("k", "seg").write.option("compression", "zstd").parquet(path)
        return path

    def add(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        spark = docs.sparkSession
        schema = f"{SEGMENT}, seg binary"
        path = self._write(named(docs, text, doc_id).mapInArrow(_segments(self.width, self.key, True), schema))
        batch = spark.read.schema(schema).parquet(path)
        keys = stash(batch.select("k").distinct())
        here = ["k", "s1", "s2", "doc_id", "v", "lo", "hi", "at"]

        def scanned(rows):
            rows = stash(rows)
            return repeats_of(rows.drop("seg"), lambda part: part.join(rows.select(*here, "seg"), here), self.width, self.key)

        out = scanned(batch)
        for level in self.levels.values():
            old = spark.read.schema(schema).parquet(level).join(keys, "k", "left_semi").select(*batch.columns)
            out = out.unionByName(scanned(batch.unionByName(old)))
        out, size = stash(out.distinct()), 1
        while size in self.levels:
            path = self._write(spark.read.schema(schema).parquet(path, self.levels.pop(size)))
            size, self.merges = size * 2, self.merges + 1
        self.levels[size] = path
        return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: int = KEY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes (kept)."""
    docs = named(docs, text, doc_id)
    runs = repeated_windows(docs, width, key)
    by_doc = stash(runs.groupBy("doc_id", "v").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")))

    def keep(batches):
        for b in batches:
            data, offs = tk.bounds(b.column(1))
            n_bytes, removed, spans, sha, kept = [], [], [], [], []
            asked = b.column(2)
            cut = asked.offsets.to_numpy() - asked.offsets[0].as_py() if b.num_rows else []
            flat, some = asked.flatten(), asked.is_valid().to_numpy(zero_copy_only=False)
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            for i in range(b.num_rows):
                t = data[offs[i] : offs[i + 1]]
                n_bytes.append(len(t))
                if some[i]:
                    edge = np.zeros(len(t) + 1, np.int64)
                    np.add.at(edge, lo[cut[i] : cut[i + 1]], 1)
                    np.add.at(edge, hi[cut[i] : cut[i + 1]] + width, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    t = t[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(t.tobytes())
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(by_doc, ["doc_id", "v"], "left").select("doc_id", "text", "runs").mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
