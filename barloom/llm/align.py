"""op11: which tokens of two tokenizers stand for the same bytes, and in how many documents.

Each text is encoded by both, A being given a leading space and B adding it. Where tokens of both end at one byte the text is cut into
groups, and each A token of a group is linked to each B token of it. An id pair is one int64 key, A's id times B's vocabulary plus B's.

One scan encodes the texts and writes every document's different keys with their links. Then each partition counts in how many of its documents a key occurs (np.unique, merged
every BLOCK keys), the partial counts are sorted over all partitions by ranges of the key, and equal keys, now side by side, are summed by run length. Each sorted range is written to
the shared folder as shards of at most SHARD keys. The lookup maps the shards into memory and finds its keys by searchsorted; where the folder is on a store that cannot be mapped, a
task reads a shard whole instead. A key that a third of all documents hold is a row a partition before the sort. An A id's highest count comes from its shards (an array as long as A's
vocabulary).

Both tokenizers split at a single space between signs that are no white space: A's pattern begins a match there, and no piece of B has a space after another sign (`Pair` verifies this). So
texts are cut into such units, and the different units of some CHARS characters of text are encoded, aligned and paired once, as arrays; a document's figures and keys are sums over its units.

A document with more than PART different keys is written as several rows, whose figures are added up. Groups of any size are whole: their pairs are made a range of A's ids at a time.

Null, empty texts and those whose joined bytes of either side are not the text's (such as ones with B's sign for a space): no tokens, zeros, and an empty groups_sha256. Repeated rows are
documents each. Rows without a doc_id count and have a row. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stash, table

BLOCK, SHARD, PART = 1 << 22, 1 << 22, 1 << 20
#: Characters that are worked out together; units in a line; pairs of a group that are listed, not counted by id.
CHARS, LINE, WIDE = 1 << 23, 500, 1 << 14
#: Where both tokenizers split: a space after something else and before what is no white space.
_UNITS, _ODD = re.compile(r"(?<! ) (?=\S)"), re.compile(r" \s|^\s| $")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def units_of(text: str) -> list[str]:
    """The units of a space and the text, each without its own leading space."""
    if not _ODD.search(text):
        return text.split(" ")
    parts = _UNITS.split(f" {text}")
    return parts[1:] if not parts[0] else [parts[0][1:], *parts[1:]]


def byte_table() -> dict[str, int]:
    """Signs of a byte-level vocabulary: printable ones of Latin-1 stand for themselves, the other bytes in turn for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Unit:
    """Tokens of both sides of some bytes, cut at their common ends: a unit with a group of more than WIDE pairs, which are not listed one by one."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.ids_a, self.ids_b = ids_a, ids_b
        common = np.intersect1d(ends_a, ends_b)
        self.cuts_a, self.cuts_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1

    def pairs(self, width: int, most: int, lo: int = 0, hi: int = 1 << 31):
        """Different keys (ascending) of A's ids from lo up to hi, and their links, in parts by ranges of A's ids, of about `most` pairs of ids each."""
        groups = []
        for a0, a1, b0, b1 in zip([0, *self.cuts_a], self.cuts_a, [0, *self.cuts_b], self.cuts_b, strict=False):
            a = self.ids_a[a0:a1]
            a = a[(a >= lo) & (a < hi)]
            if len(a):
                groups.append((*np.unique(a, return_counts=True), *np.unique(self.ids_b[b0:b1], return_counts=True)))
        if not groups:
            return
        ids = np.concatenate([g[0] for g in groups])
        cost = np.concatenate([np.full(len(g[0]), len(g[2])) for g in groups])
        order = np.argsort(ids, kind="stable")
        ids, cost = ids[order], np.cumsum(cost[order])
        lows = np.unique(ids[np.flatnonzero(np.diff((cost - 1) // most, prepend=-1))])
        for first, end in zip(lows, [*lows[1:], hi], strict=True):
            ks, ns = [], []
            for ua, na, ub, nb in groups:
                i, j = np.searchsorted(ua, (first, end))
                if i < j:
                    ks.append((ua[i:j, None] * width + ub[None, :]).ravel())
                    ns.append((na[i:j, None] * nb[None, :]).ravel())
            yield summed(np.concatenate(ks), np.concatenate(ns))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of slices, one slice after the other."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


class Worked:
    """Different units, worked out: figures of each, its groups as text, its different keys and their links."""

    def __init__(self, figures, texts, bound, keys, links, wide):
        self.figures, self.texts, self.bound, self.keys, self.links, self.wide = figures, texts, bound, keys, links, wide


class Pair:
    """Both tokenizers."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=True)
        signs = byte_table()
        bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            bytes_a[i] = bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.whole = any(re.search("[^▁]▁", x) for x in names)  # then a text is one unit
        bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(x)) else x.replace("▁", " ").encode() for x in names]
        self.ids, self.width = len(bytes_a), len(names)
        self.sizes, self.pools, self.starts, self.names = [], [], [], []
        for v, marks in ((bytes_a, b",|"), (bytes_b, b",;")):
            size = np.array([len(x) for x in v], np.int64)
            self.sizes.append(size)
            self.starts.append(np.cumsum(size) - size)
            self.pools.append(np.frombuffer(b"".join(v), np.uint8))
            # a token's id in groups_sha256's text, followed by a comma or, at the end of its side of a group, the other mark
            self.names += [b"%d%c" % (i, m) for i in range(len(v)) for m in marks]

    def _encoded(self, lines: list[str]):
        """Per side (ids, ends), and which lines both sides give back, byte for byte; the others have no tokens."""
        raws = [b" " + x.encode() for x in lines]
        n = np.array([len(x) for x in raws], np.int64)
        base, raw = np.cumsum(n) - n, np.frombuffer(b"".join(raws), np.uint8)
        good, sides = np.ones(len(lines), bool), []
        for side, lists in enumerate(([e.ids for e in self.a.encode_batch_fast([f" {x}" for x in lines], add_special_tokens=False)], self.b.encode(lines, num_threads=1))):
            count = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum()))
            of, size = np.repeat(np.arange(len(lists)), count), self.sizes[side][ids]
            good &= np.bincount(of, size, len(lists)).astype(np.int64) == n
            sides.append((ids, of, size))
        for side, (ids, of, size) in enumerate(sides):
            on = good[of]
            ids, of, size = ids[on], of[on], size[on]
            said = self.pools[side][spread(self.starts[side][ids], size)]
            there = raw[spread(base[good], n[good])]
            wrong = np.flatnonzero(said != there)
            if len(wrong):
                bad = np.flatnonzero(good)[np.searchsorted(np.cumsum(n[good]), wrong, "right")]
                good[bad] = False
        out = []
        for ids, of, size in sides:
            on = good[of]
            ids, of, size = ids[on], of[on], size[on]
            first = np.cumsum(size) - size
            start = np.zeros(len(lines), np.int64)
            new = np.flatnonzero(np.diff(of, prepend=-1))
            start[of[new]] = first[new]
            out.append((ids, base[of] + first - start[of] + size))
        return out, good, base, len(raw)

    def work_out(self, units: list[str]) -> Worked:
        """Units in lines: joined by spaces they are split as they were. Those that begin or end with white space, or hold B's sign for one, have lines of their own, as have all of a line that is not given back."""
        alone = [k for k, u in enumerate(units) if not u or u[0].isspace() or u[-1].isspace() or "▁" in u]
        own = set(alone)
        joined = [k for k in range(len(units)) if k not in own]
        members = [joined[i : i + LINE] for i in range(0, len(joined), LINE)] + [[k] for k in alone]
        sides, good, base, n_bytes = self._encoded([" ".join([units[k] for k in m]) for m in members])
        again = [m for m, g in zip(members, good, strict=True) if not g and len(m) > 1]
        if again:
            members = [m for m, g in zip(members, good, strict=True) if g or len(m) == 1] + [[k] for m in again for k in m]
            sides, good, base, n_bytes = self._encoded([" ".join([units[k] for k in m]) for m in members])
        # units in the order of the lines: ends in bytes
        order = np.array([k for m in members for k in m], np.int64)
        length = np.array([len(units[k].encode()) + 1 for k in order], np.int64)
        line = np.repeat(np.arange(len(members)), [len(m) for m in members])
        end = np.cumsum(length)
        (ids_a, ends_a), (ids_b, ends_b) = sides
        flag_a, flag_b = np.zeros(n_bytes + 1, bool), np.zeros(n_bytes + 1, bool)
        flag_a[ends_a], flag_b[ends_b] = True, True
        cut_a, cut_b = np.flatnonzero(flag_b[ends_a]), np.flatnonzero(flag_a[ends_b])  # last tokens of the groups
        n_a, n_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        first_a, first_b = cut_a - n_a + 1, cut_b - n_b + 1
        links = n_a * n_b
        unit = np.searchsorted(end, ends_a[cut_a])  # of each group, in the order of the lines
        m = len(units)
        sums = lambda v: np.bincount(unit, v, m).astype(np.int64)
        figures = np.stack([sums(n_a), sums(n_b), sums(np.ones(len(unit))), sums(links)], axis=1)
        texts = self._texts(ids_a, ids_b, n_a, n_b, first_a, first_b, figures)
        wide_units = np.unique(unit[links > WIDE])
        wide = {int(order[k]): self._unit(ids_a, ids_b, ends_a, ends_b, unit, first_a, cut_a, first_b, cut_b, k) for k in wide_units}
        on = ~np.isin(unit, wide_units)
        within, g = spread(np.zeros(int(on.sum()), np.int64), links[on]), np.repeat(np.flatnonzero(on), links[on])
        keys = ids_a[first_a[g] + within // n_b[g]] * self.width + ids_b[first_b[g] + within % n_b[g]]
        full, n = summed(unit[g] * (self.ids * self.width) + keys, np.ones(len(keys), np.int64))
        owner, keys = full // (self.ids * self.width), full % (self.ids * self.width)
        bound = np.searchsorted(owner, np.arange(m + 1))
        # back to the order of `units`
        back = np.empty(m, np.int64)
        back[order] = np.arange(m)
        texts = [texts[k] for k in back.tolist()]
        for k in np.flatnonzero(~good[line]):
            texts[order[k]] = None
        size = np.diff(bound)[back]
        at = spread(bound[:-1][back], size)
        return Worked(figures[back], texts, np.concatenate([[0], np.cumsum(size)]), keys[at], n[at], wide)

    def _texts(self, ids_a, ids_b, n_a, n_b, first_a, first_b, figures) -> list[bytes]:
        """The groups of each unit, each followed by a semicolon."""
        sign = np.zeros(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[first_a + n_a - 1], last_b[first_b + n_b - 1] = 1, 1
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        sign[np.arange(len(ids_a)) + first_b[group_a]] = ids_a * 2 + last_a
        sign[np.arange(len(ids_b)) + (first_a + n_a)[group_b]] = (self.ids + ids_b) * 2 + last_b
        parts = list(map(self.names.__getitem__, sign.tolist()))
        ends = np.cumsum(figures[:, 0] + figures[:, 1]).tolist()
        return [b"".join(parts[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _unit(ids_a, ids_b, ends_a, ends_b, unit, first_a, cut_a, first_b, cut_b, k) -> Unit:
        g = np.flatnonzero(unit == k)
        a, b = slice(first_a[g[0]], cut_a[g[-1]] + 1), slice(first_b[g[0]], cut_b[g[-1]] + 1)
        return Unit(ids_a[a], ids_b[b], ends_a[a], ends_b[b])

    def _some(self, lists: list[list[str]]):
        """Figures, groups as text (None: not given back), keys, links and wide units (with their times) of lists of units."""
        index: dict[str, int] = {}
        for x in lists:
            for u in x:
                if u not in index:
                    index[u] = len(index)
        at = [list(map(index.__getitem__, x)) for x in lists]
        w = self.work_out(list(index))
        doc = np.repeat(np.arange(len(lists)), [len(x) for x in at])
        pair, n = np.unique(doc * len(index) + np.fromiter(chain.from_iterable(at), np.int64, len(doc)), return_counts=True)
        d, u = pair // len(index), pair % len(index)
        size = w.bound[u + 1] - w.bound[u]
        where = spread(w.bound[u], size)
        one = self.ids * self.width
        full, links = summed(np.repeat(d, size) * one + w.keys[where], w.links[where] * np.repeat(n, size))
        bound = np.searchsorted(full, np.arange(len(lists) + 1) * one)
        figures = np.zeros((len(lists), 4), np.int64)
        np.add.at(figures, d, w.figures[u] * n[:, None])
        keys = full % one
        for i, x in enumerate(at):
            try:
                text = b"".join(map(w.texts.__getitem__, x))
            except TypeError:  # a unit that is not given back
                yield None
                continue
            wide = [(w.wide[k], x.count(k)) for k in dict.fromkeys(x) if k in w.wide] if w.wide else []
            yield figures[i], text, keys[bound[i] : bound[i + 1]], links[bound[i] : bound[i + 1]], wide

    def documents(self, texts: list[str | None], part: int = PART, chars: int = CHARS):
        """n_a, n_b, n_groups, n_links, groups_sha256, and the parts (keys, links) of each text. part: keys in a part; chars: characters worked out at once."""
        held, size = [], 0
        for t in texts:
            if t and len(t) > chars:
                yield from self._short(held, part)
                held, size = [], 0
                yield self._long(t, part, chars)
                continue
            held.append(t)
            size += len(t or "")
            if size > chars:
                yield from self._short(held, part)
                held, size = [], 0
        yield from self._short(held, part)

    def _units(self, text: str) -> list[str]:
        return [text] if self.whole else units_of(text)

    def _short(self, texts: list[str | None], part: int):
        if not texts:
            return
        found = self._some([self._units(t) for t in texts if t]) if any(texts) else iter(())
        for t in texts:
            x = next(found) if t else None
            if x is None:
                yield (0, 0, 0, 0, ""), [NONE]
            else:
                figures, text, keys, links, wide = x
                yield (*figures.tolist(), hashlib.sha256(text[:-1]).hexdigest()), self._parts(keys, links, wide, part)

    def _long(self, text: str, part: int, chars: int):
        """A text of many units, some of them at a time."""
        units, sha, figures, (keys, links), wide, some = self._units(text), hashlib.sha256(), np.zeros(4, np.int64), NONE, [], []
        size, last = 0, len(units) - 1
        for i, u in enumerate(units):
            some.append(u)
            size += len(u) + 1
            if size > chars or i == last:
                x = next(self._some([some]))
                if x is None:
                    return (0, 0, 0, 0, ""), [NONE]
                figures = figures + x[0]
                sha.update(x[1] if i < last else x[1][:-1])
                keys, links = summed(np.concatenate([keys, x[2]]), np.concatenate([links, x[3]]))
                wide += x[4]
                some, size = [], 0
        return (*figures.tolist(), sha.hexdigest()), self._parts(keys, links, wide, part)

    def _parts(self, keys, links, wide, part: int):
        """The parts of a document, none with a key of another. wide: units with large groups, and how often they occur."""
        if not wide:
            return [(keys[i : i + part], links[i : i + part]) for i in range(0, max(1, len(keys)), part)]
        return self._by_range(keys, links, wide, part)

    def _by_range(self, keys, links, wide, part: int):
        edges = np.unique(np.concatenate([*(x.ids_a for x, _ in wide), keys // self.width]))
        # as many A ids at a time as can have `part` keys
        edges = edges[:: max(1, part // self.width)]
        for lo, hi in zip(edges, [*edges[1:], self.ids], strict=True):
            i, j = np.searchsorted(keys, (lo * self.width, hi * self.width))
            ks, ns = [keys[i:j]], [links[i:j]]
            for x, times in wide:
                for k, n in x.pairs(self.width, part, lo, hi):
                    ks.append(k)
                    ns.append(n * times)
            k, n = summed(np.concatenate(ks), np.concatenate(ns))
            if len(k):
                yield k, n


NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


_PAIRS: dict[tuple, Pair] = {}


def tokenizers(byte_level: str | None, pieces: str | None) -> Pair:
    """This process's pair of tokenizers. None: the installed byte_bpe_50k.json and piece_bpe_32k.model."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    key = byte_level, pieces
    if key not in _PAIRS:
        if byte_level is None or pieces is None:
            import public_tokenizers

            byte_level, pieces = byte_level or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model")
        _PAIRS[key] = Pair(byte_level, pieces)
    return _PAIRS[key]


WRITTEN = FIGURES + ", row string, part int, keys array<long>, links array<long>"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bound = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bound), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def aligned(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, text: str = "text", doc_id: str = "doc_id", part: int = PART, chars: int = CHARS) -> DataFrame:
    """A row for each document (more for one with more than PART different keys, with equal `row`): its figures, keys and links."""

    def run(batches):
        both = tokenizers(byte_level, pieces)
        for b in batches:
            out, keys, links, held = [], [], [], 0
            for i, (figures, parts) in zip(b.column(0).to_pylist(), both.documents(b.column(1).to_pylist(), part, chars), strict=True):
                many = not isinstance(parts, list) or len(parts) > 1
                row = uuid.uuid4().hex if many else None
                for p, (k, n) in enumerate(parts):
                    out.append((i, *figures, row, p))
                    keys.append(k)
                    links.append(n)
                    held += len(k)
                    if held > PART:
                        yield _written(out, keys, links)
                        out, keys, links, held = [], [], [], 0
            if out:
                yield _written(out, keys, links)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, WRITTEN)


def _written(out, keys, links) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int32()]
    cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*cols, _lists(keys), _lists(links)], names=[x.split()[0] for x in WRITTEN.split(", ")])


def partial_counts(written: DataFrame) -> DataFrame:
    """key, n: in how many documents of a partition each key occurs."""

    def run(batches):
        keys, counts, raw, n_raw, n_old = [], [], [], 0, 0

        def merge():
            if raw:
                u, n = np.unique(np.concatenate(raw), return_counts=True)
                keys.append(u)
                counts.append(n.astype(np.int64))
                raw.clear()
            u, n = summed(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [u], [n]
            return len(u)

        for b in batches:
            v = b.column(0)
            flat = v.values.to_numpy()[v.offsets[0].as_py() : v.offsets[-1].as_py()]
            raw.append(flat)
            n_raw += len(flat)
            if n_raw > max(BLOCK, n_old):
                n_old, n_raw = merge(), 0
        if raw or keys:
            merge()
            for i in range(0, len(keys[0]), BLOCK // 4):
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][i : i + BLOCK // 4]), pa.array(counts[0][i : i + BLOCK // 4])], names=["key", "n"])

    return written.select("keys").mapInArrow(run, "key long, n long")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def count_shards(partial: DataFrame, width: int, folder: str, most: int = SHARD) -> DataFrame:
    """Sorts partial counts by ranges of the key, sums equal keys and writes them: path, lo, hi (keys), size, and the A ids of the shard with their highest counts."""

    def run(batches):
        held_k, held_n, size = [], [], 0

        def shard(last: bool):
            k, n = np.concatenate(held_k), np.concatenate(held_n)
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            k, n = k[first], np.add.reduceat(n, first)
            keep = 0 if last else 1  # the last key can go on in the next batch
            held_k[:], held_n[:] = [k[len(k) - keep :]], [n[len(n) - keep :]]
            k, n = k[: len(k) - keep], n[: len(n) - keep]
            if not len(k):
                return None
            path = f"{folder}/shard-{uuid.uuid4().hex}"
            store, at = _file_system(path)
            with store.open_output_stream(at) as f:
                f.write(k.tobytes())
                f.write(n.tobytes())
            a = k // width
            new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            row = [[path], [int(k[0])], [int(k[-1])], [len(k)], [a[new].tolist()], [np.maximum.reduceat(n, new).tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(row[0]), *(pa.array(x, pa.int64()) for x in row[1:4]), *(pa.array(x, pa.list_(pa.int64())) for x in row[4:])], names=["path", "lo", "hi", "size", "a", "top"])

        for b in batches:
            if b.num_rows:
                held_k.append(b.column(0).to_numpy())
                held_n.append(b.column(1).to_numpy())
                size += b.num_rows
                if size >= most:
                    if (out := shard(False)) is not None:
                        yield out
                    size = 0
        if held_k and (out := shard(True)) is not None:
            yield out

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "path string, lo long, hi long, size long, a array<long>, top array<long>")


class Counts:
    """The sorted count shards: (path, lo, hi, size) in order of their keys."""

    def __init__(self, shards: list[tuple[str, int, int, int]]):
        self.shards, self.open = shards, {}
        self.lows = np.array([s[1] for s in shards], np.int64)

    def _arrays(self, i: int):
        path, _, _, size = self.shards[i]
        if i in self.open:
            return self.open[i]
        from pyarrow import fs

        store, at = _file_system(path)
        if isinstance(store, fs.LocalFileSystem):
            both = np.memmap(at, np.int64, "r", shape=(2, size))
            self.open[i] = both
            return both
        with store.open_input_file(at) as f:
            return np.frombuffer(f.readall(), np.int64).reshape(2, size)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys that are in order and all counted."""
        out = np.zeros(len(keys), np.int64)
        which = np.searchsorted(self.lows, keys, "right") - 1
        cut = np.flatnonzero(np.diff(which, prepend=-1, append=-1))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            k, n = self._arrays(int(which[i]))
            out[i:j] = n[np.searchsorted(k, keys[i:j])]
        return out


def looked_up(written: DataFrame, shards: list[tuple[str, int, int, int]], best: np.ndarray, width: int) -> DataFrame:
    """The rows of `aligned` with n_best and count_sum in place of their keys."""
    best = written.sparkSession.sparkContext.broadcast(best)  # a number for each id of A

    def run(batches):
        counts = Counts(shards)
        for b in batches:
            v, w = b.column(b.schema.get_field_index("keys")), b.column(b.schema.get_field_index("links"))
            bound = v.offsets.to_numpy().astype(np.int64)
            keys, links = v.values.to_numpy()[bound[0] : bound[-1]], w.values.to_numpy()[bound[0] : bound[-1]]
            u, at = np.unique(keys, return_inverse=True)
            n = counts.of(u)
            top = (n == best.value[u // width])[at]
            total = [np.concatenate([[0], np.cumsum(x)]) for x in (links * top, links * n[at])]
            each = [t[bound[1:] - bound[0]] - t[bound[:-1] - bound[0]] for t in total]
            names = [x.split()[0] for x in FIGURES.split(", ")] + ["row", "part"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in names), *(pa.array(x) for x in each)], names=[*names, "n_best", "count_sum"])

    return written.mapInArrow(run, FIGURES + ", row string, part int, n_best long, count_sum long")


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, text: str = "text", doc_id: str = "doc_id", part: int = PART, chars: int = CHARS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The documents (FIGURES, n_best, count_sum), and the corpus-wide counts (a, b, documents). Paths of the tokenizers must be readable by the executors."""
    spark = docs.sparkSession
    both = tokenizers(byte_level, pieces)
    width = both.width
    written = stash(aligned(docs, byte_level, pieces, text, doc_id, part, chars))
    partial = stash(partial_counts(written))
    folder = f"{shared_dir(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}"
    _folder(spark, folder)
    # a row for each shard; the ids and counts in them are a few for each id of A
    rows = stash(count_shards(partial, width, folder, shard)).orderBy("lo").collect()
    best = np.zeros(both.ids, np.int64)
    for r in rows:
        np.maximum.at(best, r["a"], r["top"])
    one = looked_up(written, [(r["path"], r["lo"], r["hi"], r["size"]) for r in rows], best, width)
    names = [x.split()[0] for x in FIGURES.split(", ")]
    figures = [F.col(n) for n in (*names, "n_best", "count_sum")]
    several = one.where("row is not null").groupBy("row").agg(*[F.first(n).alias(n) for n in names], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    counts = partial.groupBy("key").agg(F.sum("n").alias("documents")).select(F.expr(f"key div {width}").alias("a"), F.pmod("key", F.lit(width)).alias("b"), "documents")
    return one.where("row is null").select(*figures).unionByName(several.select(*figures)), counts


def _folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
