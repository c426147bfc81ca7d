"""op3: exact n-gram Jaccard join with set-relation skipping.

Sets are the distinct WIDTH-word shingle fingerprints of a text. Equal sets are one set from the start. A
link needs a shared shingle among the first n - ceil(J n) + 1 of both sets in any common order; the order here
puts shingles that many documents share (the FREQUENT most frequent of those that repeat within a scan
task) last, and is by fingerprint otherwise. Index lists are the sets under such a prefix shingle, in
blocks by size and with the shingle's position:

- Blocks of a list whose sizes or positions cannot reach the overlap are skipped as a whole, and so are pairs that share too
  few prefix shingles to reach it with all shingles beyond.
- A list of more than PAIRWISE sets is first compared with one hub only, the set with the fewest rare shingles.
  Sets linked to one hub are one component, so most long lists are answered by the hub's answers.
- Lists that then still hold several components are compared across components only, and from the hub's
  overlaps (Jaccard distance is a metric: |d(x, hub) - d(y, hub)| <= d(x, y)) pairs that cannot link are skipped.
  Where more pairs are left than twice the list's sets, no pair is listed: the list's sets join the hub's family. There one set's
  overlaps with all others are counted, and the overlaps of each other set are derived from these and its differences to that set,
  which are few; only a spanning forest of the links comes back.

Before any text is read again, pairs are pruned by odd sketches (Mitzenmacher, Pagh and Pham 2014): one bit for each
bucket of shingles, whether the set has an odd number there. Bits that differ are at most the shingles that differ, so a
pair with more of them than a link allows is none; a sketch has two to four bits a word.

So no link between components is lost, and the components are exact. Set ids and shingles are 64-bit
fingerprints; candidates are verified on the whole sets.

Null, empty and wordless texts: n_shingles 0, linked with nothing. Fewer words than WIDTH: one shingle of all.
Equal texts and repeated rows link. Rows with one doc_id are told apart by a hash of their texts: each is linked by its own text,
and component_id is the smallest doc_id of its group. Rows without a doc_id take no part and have no row. Empty table: no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import components, stash, table

WIDTH, SHARE, PAIRWISE, PARTNERS, PART, BITS = 5, 75, 6, 64, 256, 2
#: Bound of the list of frequent shingles that is sent to tasks (any list gives right results), least count for it.
FREQUENT, LEAST = 1 << 17, 8


def sets_of(c: tk.Chunk, roll: tk.Roller, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted within it, and their bounds."""
    low = tk.LOWER[c.buf]
    s, e, bound = tk.words(c)
    sh, b = tk.shingles(roll.of(roll.prefix(low), s, e), bound, width)
    doc = np.repeat(np.arange(len(c)), np.diff(b))
    at = np.lexsort((sh, doc))
    sh, doc = sh[at], doc[at]
    first = np.ones(len(sh), bool)
    first[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(c)))])


def set_ids(sh: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A fingerprint for each set; 0 for empty ones."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(sh + tk.GOLDEN))])
    n = np.diff(bound).astype(np.uint64)
    out = tk.mix(total[bound[1:]] - total[bound[:-1]] + n * tk.GOLDEN) >> tk.U64(1)
    out[n == 0] = 0
    return out.view(np.int64)


def sketches(sh: np.ndarray, bound: np.ndarray) -> pa.Array:
    """Odd sketches of the sets, each of the least power of two of bits that is no less than BITS times the set (64 at least)."""
    n = np.diff(bound)
    bits = 64 << np.ceil(np.log2(np.maximum(BITS * n, 64) / 64)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(bits)])
    where = np.repeat(at[:-1], n) + (tk.mix(sh) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(where, minlength=at[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def apart(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches, the longer folded to the shorter: a lower bound of the symmetric difference."""
    size = 8 * min(len(x), len(y))
    i, j = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for length, v in ((8 * len(x), i), (8 * len(y), j)):
        while length > size:
            length //= 2
            v = (v >> length) ^ (v & ((1 << length) - 1))
        i, j = j, v
    return (i ^ j).bit_count()


def _need(n, m, share):
    """Least overlap of sets of n and m that link: ceil(share (n + m) / (100 + share))."""
    return -(-share * (n + m) // (100 + share))


def jaccard_components(docs: DataFrame, width: int = WIDTH, share: int = SHARE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id."""
    own = grouped_rows(docs, width, share, text, doc_id)
    low = stash(own.where("sid <> 0").groupBy("c").agg(F.min("doc_id").alias("low")))
    return own.join(low, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid") == 0, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, share: int = SHARE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs`, all columns: of each group of linked rows the one with the smallest doc_id (and text hash) stays. Rows without words or without a doc_id stay."""
    own = grouped_rows(docs, width, share, text, doc_id)
    first = own.where("sid <> 0").groupBy("c").agg(F.min(F.struct("doc_id", "v")).alias("k")).select("k.*")
    rows = own.groupBy("doc_id", "v").agg(F.count(F.lit(1)).alias("n"), F.max("sid").alias("sid"))
    # how many rows a kept text of a doc_id has: copies of one row
    keep = stash(rows.where("sid = 0").select("doc_id", "v", F.lit(1).alias("n")).union(rows.join(first, ["doc_id", "v"]).select("doc_id", "v", "n")))
    keep = keep.select(F.col("doc_id").alias("__barloom_id"), F.col("v").alias("__barloom_v"), F.col("n").alias("__barloom_n"))
    names, here = docs.columns, (F.col(doc_id) == F.col("__barloom_id")) & (F.hash(F.col(text)) == F.col("__barloom_v"))
    stay = docs.join(keep.where("__barloom_n = 1").hint("merge"), here, "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
    copies = keep.where("__barloom_n > 1")
    if copies.limit(1).count():
        more = docs.join(copies.hint("merge"), here).dropDuplicates(["__barloom_id", "__barloom_v"]).select(*names)
        stay = stay.unionByName(more)
    return stay


def grouped_rows(docs: DataFrame, width: int = WIDTH, share: int = SHARE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, v (a hash of the text), n, sid (set id; 0: no words), c (the group: one of its set ids), of every row with a doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.hash(F.col(text)).alias("v"), F.col(text).alias("text")).where("doc_id is not null")

    def repeated(batches):
        seen, counts, n = [], [], 0

        def merged():
            k = np.concatenate(seen)
            v = np.concatenate(counts)
            u, at = np.unique(k, return_inverse=True)
            return u, np.bincount(at, v).astype(np.int64)

        roll = tk.Roller()
        for c in tk.chunks(batches):
            sh, bound = sets_of(c, roll, width)
            if not len(sh):
                continue
            u, v = np.unique(sh, return_counts=True)
            seen.append(u)
            counts.append(v)
            n += len(u)
            if n > 1 << 22:
                u, v = merged()
                keep = v > 1
                yield _batch(f=u[keep].view(np.int64), n=v[keep])
                seen, counts, n = [], [], 0
        if seen:
            u, v = merged()
            keep = v > 1
            yield _batch(f=u[keep].view(np.int64), n=v[keep])

    top = docs.where("text is not null").select("text").mapInArrow(repeated, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    frequent = np.sort(np.array([r["f"] for r in top.orderBy(F.desc("n"), "f").limit(FREQUENT).collect()], np.int64).view(np.uint64))
    often = spark.sparkContext.broadcast(frequent)

    def index(batches):
        roll, last = tk.Roller(), often.value
        for c in tk.chunks(batches):
            sh, bound = sets_of(c, roll, width)
            n = np.diff(bound)
            sid = set_ids(sh, bound)
            doc = np.repeat(np.arange(len(c)), n)
            common = np.zeros(len(sh), bool)
            if len(last) and len(sh):
                common = last[np.minimum(np.searchsorted(last, sh), len(last) - 1)] == sh
            at = np.lexsort((sh, common, doc))
            pos = np.arange(len(sh)) - bound[doc]
            take = pos < (n - (-(-share * n // 100)) + 1)[doc]
            rare = np.bincount(doc[~common], minlength=len(c))
            d, tok, p = doc[take], sh[at][take], pos[take]
            # equal sets of a chunk are indexed once
            _, one = np.unique(sid, return_index=True)
            ok = np.zeros(len(c), bool)
            ok[one] = True
            k = ok[d]
            d = d[k]
            yield _batch(f=tok[k].view(np.int64), sid=sid[d], n=n[d].astype(np.int32), pos=p[k].astype(np.int32), rare=rare[d].astype(np.int32))

    sets = stash(docs.mapInArrow(_ids_only(width), "doc_id long, v int, sid long, n long, sketch binary"))
    lists = docs.mapInArrow(index, "f long, sid long, n int, pos int, rare int").repartition("f").sortWithinPartitions("f", "n", "sid")
    found = lists.mapInArrow(_lists(share), "kind int, f long, a long, b long, n int, m int, c int")
    found = stash(found.groupBy("kind", "f", "a", "b", "n", "m").agg(F.sum("c").alias("c")))
    long = found.where("kind = 1")
    # prefix shingles that two sets share, in short lists (counted) and in long ones (compared): the overlap is no more
    # than these and what either set has beyond its prefix
    in_long = stash(long.groupBy("a").agg(F.collect_set("f").alias("fs")))
    counted = found.where("kind = 0").join(in_long.withColumnRenamed("fs", "fa"), "a", "left").join(in_long.select(F.col("a").alias("b"), F.col("fs").alias("fb")), "b", "left")
    shared = F.col("c") + F.coalesce(F.size(F.array_intersect("fa", "fb")), F.lit(0))
    beyond = F.greatest(F.ceil(F.greatest("n", "m") * share / 100), F.lit(1)) - 1
    likely = counted.where(shared + beyond >= F.ceil(share * (F.col("n") + F.col("m")) / (100 + share))).select("a", "b")
    first_id = stash(sets.where("sid <> 0").groupBy("sid").agg(F.min(F.struct("doc_id", "v")).alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def near(pairs: DataFrame) -> DataFrame:
        """a, b: the pairs that their sketches allow to link."""
        one, two = (first_id.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")).hint("merge") for k in ("a", "b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_allowed(share), "a long, b long")

    def verify(pairs: DataFrame) -> DataFrame:
        """a, b, n, m, both: sizes and overlaps of the pairs, from the whole texts.

        Of a pair, the set in more pairs is the hub. A hub's text is sent once for PARTNERS partners, not once a pair.
        """
        pairs = stash(pairs.select("a", "b").distinct())
        ends = pairs.select(F.col("a").alias("s")).union(pairs.select("b"))
        degree = stash(ends.groupBy("s").agg(F.count(F.lit(1)).alias("k")))
        of = pairs.join(degree.select(F.col("s").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("s").alias("b"), F.col("k").alias("kb")), "b")
        more = F.col("ka") >= F.col("kb")
        of = of.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("sid"), F.greatest("ka", "kb").alias("k"))
        of = of.withColumn("part", F.pmod(F.xxhash64("sid"), F.ceil(F.col("k") / PARTNERS)))
        asked = of.select("hub", "part", "sid").union(of.select("hub", "part", F.col("hub").alias("sid")).distinct())
        asked = stash(asked.join(first_id.select("sid", "id"), "sid").select("hub", "part", "sid", "id.*"))
        texts = docs.join(asked.hint("merge"), ["doc_id", "v"]).select("hub", "part", (F.col("sid") != F.col("hub")).alias("other"), "sid", "text")
        dealt = texts.repartition("hub", "part").sortWithinPartitions("hub", "part", "other", "sid")
        return stash(dealt.mapInArrow(_overlap(width), "a long, b long, n int, m int, both int"))

    def families(members: DataFrame, comp: DataFrame) -> DataFrame:
        """a, b: links between components inside each hub's family; its texts are compared in blocks, a task for each pair of parts of about PART members."""
        members = stash(members.distinct())
        size = stash(members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")))
        m = members.join(size, "hub").join(comp.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("mine", F.pmod(F.xxhash64("a", "hub"), "parts"))
        m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        m = m.select("hub", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", F.col("a").alias("sid"), F.coalesce("component", "a").alias("c"))
        asked = stash(m.join(first_id.select("sid", "id"), "sid").select("hub", "i", "j", "mine", "sid", "c", "id.*"))
        texts = docs.join(asked.hint("merge"), ["doc_id", "v"]).select("hub", "i", "j", "mine", "sid", "c", "text")
        dealt = texts.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
        return stash(dealt.mapInArrow(_family(width, share), "a long, b long"))

    def links(v: DataFrame) -> DataFrame:
        return v.where(F.col("both") * 100 >= share * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")

    v1 = verify(near(likely))
    comp = components(links(v1))
    # long lists again, where several components are left
    d1 = 1 - F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    to_hub = v1.select("a", "b", d1.alias("d")).union(v1.select(F.col("b").alias("a"), F.col("a").alias("b"), d1.alias("d")))
    v = v1
    if long.limit(1).count():
        known = long.select("f", F.col("a"), F.col("b"), "n", F.col("m").alias("pos")).join(comp.select(F.col("node").alias("a"), "component"), "a", "left").join(to_hub, ["a", "b"], "left")
        known = known.select("f", "a", "b", "n", "pos", F.coalesce("component", "a").alias("c"), F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("d")).alias("d"))
        several = stash(known.groupBy("f").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("f"))
        rest = stash(known).join(several, "f").repartition("f").sortWithinPartitions("f", "n", "a")
        left = stash(rest.mapInArrow(_across(share), "a long, b long, family boolean").distinct())
        v2 = verify(near(left.where("not family").select("a", "b")))
        comp = components(links(v1).union(links(v2)).union(families(left.where("family").select("a", F.col("b").alias("hub")), comp)))
    return stash(sets.select("doc_id", "v", "sid", "n").join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "v", "n", "sid", F.coalesce("component", "sid").alias("c")))


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))


def _ids_only(width):
    def run(batches):
        roll = tk.Roller()
        for c in tk.chunks(batches):
            sh, bound = sets_of(c, roll, width)
            yield _batch(doc_id=c.ids(), v=c.ids("v"), sid=set_ids(sh, bound), n=np.diff(bound).astype(np.int64), sketch=sketches(sh, bound))

    return run


def _allowed(share):
    """Pairs whose sketches differ in no more bits than the shingles in which sets of these sizes that link may differ."""

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            far = np.array([apart(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
            keep = far * (100 + share) <= n * (100 - share)
            yield b.select([0, 1]).filter(pa.array(keep))

    return run


def _overlap(width):
    """Overlaps of hubs with their partners (rows sorted by hub and part, the hub first)."""

    def run(batches):
        roll, hub, own, part, last = tk.Roller(), None, None, None, None
        for c in tk.chunks(batches):
            sh, bound = sets_of(c, roll, width)
            hubs, parts, sids = c.ids("hub"), c.ids("part"), c.ids("sid")
            out = []
            for i in range(len(c)):
                x = sh[bound[i] : bound[i + 1]]
                if hubs[i] == sids[i]:
                    hub, part, own, last = hubs[i], parts[i], x, None
                elif (hubs[i], parts[i]) == (hub, part) and sids[i] != last:  # copies of one row come together
                    last = sids[i]
                    at = np.minimum(np.searchsorted(own, x), len(own) - 1)
                    out.append((hub, sids[i], len(own), len(x), int((own[at] == x).sum())))
            o = np.array(out, np.int64).reshape(-1, 5).T
            yield _batch(a=o[0], b=o[1], n=o[2].astype(np.int32), m=o[3].astype(np.int32), both=o[4].astype(np.int32))

    return run


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Overlaps of all sets with all. Those of the first are counted; the others' are derived from them: a set overlaps another as the first does,
    and by one more or less for each shingle of the other that only the set or only the first has. Shingles that all sets have drop out."""
    n = np.array([len(x) for x in sets])
    u, at, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    first = np.zeros(len(u), bool)
    first[at[: n[0]]] = True
    answers = np.bincount(row, first[at], len(sets))
    differ = (freq < len(sets)) & ((freq > 1) | first)
    dense = np.cumsum(differ) - 1
    ok = differ[at]
    row, col = row[ok], dense[at[ok]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    own = first[differ]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, len(own), columns):
        lo, hi = np.searchsorted(col, [k, k + columns])
        m = np.zeros((len(sets), min(columns, len(own) - k)), np.float32)
        m[row[lo:hi], col[lo:hi] - k] = 1
        both += (m - own[k : k + columns].astype(np.float32)) @ m.T
    both = np.rint(both + answers[None, :]).astype(np.int64)
    np.fill_diagonal(both, n)  # shingles of one set alone were left out
    return both


def _family(width, share):
    """Links between components among the sets of a family's part pair (rows sorted by it), as a spanning forest."""

    def run(batches):
        roll, key, held = tk.Roller(), None, []

        def compare():
            sets = [x for x, _, _, _ in held]
            n = np.array([len(x) for x in sets])
            sid, comp, mine = (np.array(v) for v in zip(*((b, c, m) for _, b, c, m in held), strict=True))
            both = overlaps(sets)
            ok = (100 * both >= share * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
            if key[1] != key[2]:  # pairs within a part belong to another task
                ok &= mine[:, None] != mine[None, :]
            up = {}

            def find(v):
                while up.setdefault(v, v) != v:
                    up[v] = up[up[v]]
                    v = up[v]
                return v

            out = []
            for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
                p, q = find(int(comp[i])), find(int(comp[j]))
                if p != q:
                    up[p] = q
                    out.append((sid[i], sid[j]))
            o = np.array(out, np.int64).reshape(-1, 2).T
            return _batch(a=o[0], b=o[1])

        for c in tk.chunks(batches):
            sh, bound = sets_of(c, roll, width)
            cols = [c.ids(k) for k in ("hub", "i", "j", "sid", "c", "mine")]
            for r in range(len(c)):
                k = tuple(int(x[r]) for x in cols[:3])
                if k != key and held:
                    yield compare()
                    held = []
                key = k
                held.append((sh[bound[r] : bound[r + 1]], int(cols[3][r]), int(cols[4][r]), int(cols[5][r])))
        if held:
            yield compare()

    return run


def grouped(batches, key: int = 0):
    """Rows of an input sorted by a column as (columns, bounds of whole groups), a few batches at a time; a group is never split."""
    held: list[list[np.ndarray]] = []

    def ready(last: bool):
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        k = cols[key]
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        if not last:
            cut = cut[:-1]
        held.clear()
        if not last:
            held.append([c[cut[-1] :] for c in cols])
        return [c[: cut[-1]] for c in cols], cut

    n = 0
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n > 1 << 16 and held[0][key][0] != held[-1][key][-1]:
                cols, cut = ready(False)
                n = len(held[0][0])
                if len(cut) > 1:
                    yield cols, cut
    if held and sum(len(h[0]) for h in held):
        yield ready(True)


def _lists(share):
    """Index lists to pairs (kind 0) and, for long lists, their entries with the hub (kind 1)."""

    def run(batches):
        for (f, sid, n, pos, rare), cut in grouped(batches):
            size = np.diff(cut)
            a_out, b_out = [], []
            one = np.repeat(np.arange(len(size)), size)
            # short lists: all pairs, a step at a time
            for k in range(1, PAIRWISE):
                i = np.flatnonzero(one[:-k] == one[k:]) if k < len(one) else np.zeros(0, int)
                i = i[size[one[i]] <= PAIRWISE]
                a_out.append(i)
                b_out.append(i + k)
            i, j = np.concatenate(a_out), np.concatenate(b_out)
            ok = reachable(n[i], pos[i], n[j], pos[j], share) & (sid[i] != sid[j])
            i, j = i[ok], j[ok]
            yield _pairs(sid[i], sid[j], n[i], n[j])
            hubs, rows = [], []
            for g in np.flatnonzero(size > PAIRWISE):
                at = np.arange(cut[g], cut[g + 1])
                hub = at[np.lexsort((sid[at], rare[at]))[0]]
                at = at[sid[at] != sid[hub]]
                hubs.append(np.full(len(at), hub))
                rows.append(at)
                hubs.append([hub])
                rows.append([hub])
            if rows:
                r, h = np.concatenate(rows).astype(int), np.concatenate(hubs).astype(int)
                other = sid[r] != sid[h]
                yield _pairs(sid[r[other]], sid[h[other]], n[r[other]], n[h[other]])
                yield _batch(kind=np.ones(len(r), np.int32), f=f[r], a=sid[r], b=sid[h], n=n[r], m=pos[r], c=np.ones(len(r), np.int32))

    return run


def _pairs(a, b, n, m):
    """Pairs, smaller id first, with their sizes and how often each came."""
    up = a > b
    p = np.stack([np.where(up, b, a), np.where(up, a, b), np.where(up, m, n), np.where(up, n, m)])
    p, c = np.unique(p, axis=1, return_counts=True)
    k = p.shape[1]
    return _batch(kind=np.zeros(k, np.int32), f=np.zeros(k, np.int64), a=p[0], b=p[1], n=p[2].astype(np.int32), m=p[3].astype(np.int32), c=c.astype(np.int32))


def reachable(n, i, m, j, share):
    """Whether sets of n and m with a shared shingle at positions i and j can reach the overlap: length and positional bounds."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return (np.minimum(n, m) * 100 >= share * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= _need(n, m, share) - np.minimum(i, j))


def block_bound(n, i, m, j) -> int:
    """The most that any sets of two blocks can overlap, from the blocks' largest sizes and how far apart their places of the shared shingle are."""
    return min(int(n.max()) - max(0, int(i.min()) - int(j.max())), int(m.max()) - max(0, int(j.min()) - int(i.max())))


def _across(share, block: int = 512):
    """Pairs of a list's sets from different components that may link; blocks by size and hub distance are skipped as a whole."""

    def run(batches):
        far = 1 - share / 100 + 1e-9
        for (f, sid, hub, n, pos, comp, d), cut in grouped(batches):
            out, kin = [], []
            for lo, hi in zip(cut, cut[1:], strict=False):
                at = np.arange(lo, hi)
                if len(np.unique(comp[at])) < 2:
                    continue
                at = at[np.lexsort((sid[at], pos[at], n[at]))]
                own, count = [], 0
                for p in range(0, len(at), block):
                    x = at[p : p + block]
                    for q in range(p, len(at), block):
                        y = at[q : q + block]
                        if n[x].max() * 100 < share * n[y].min():  # and all later blocks are larger
                            break
                        if block_bound(n[x], pos[x], n[y], pos[y]) < _need(int(n[x].min()), int(n[y].min()), share):
                            continue
                        ok = (comp[x][:, None] != comp[y][None, :]) & reachable(n[x][:, None], pos[x][:, None], n[y][None, :], pos[y][None, :], share)
                        gap = np.abs(d[x][:, None] - d[y][None, :])
                        i, j = np.nonzero(ok & ~(gap > far))
                        if p == q:
                            keep = i < j
                            i, j = i[keep], j[keep]
                        count += len(i)
                        if count > 2 * len(at):  # too many to list: all that have one are a family
                            own = [np.unique(sid[at])]
                            break
                        own.append(np.stack([np.minimum(sid[x[i]], sid[y[j]]), np.maximum(sid[x[i]], sid[y[j]])]))
                    if count > 2 * len(at):
                        break
                if count > 2 * len(at):
                    kin.append(np.stack([own[0], np.full(len(own[0]), hub[lo])]))
                else:
                    out += own
            for rows, family in ((out, False), (kin, True)):
                if rows:
                    u = np.unique(np.concatenate(rows, axis=1), axis=1)
                    yield _batch(a=u[0], b=u[1], family=np.full(u.shape[1], family))

    return run


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
