"""op9: hierarchical multi-length packing.

Each task packs the documents it scans, so no token is shuffled. A document's ids are cut into full
windows of `top` tokens; what is left over is routed to the smallest tier that holds it. Tiers are packed
from the longest: a tier's document opens a window of the tier's size, the gap takes the longest fitting
leftovers of the same and shorter tiers, and the last gap takes the head of a leftover that is cut there.
So windows are full. The one unfilled window a task ends with is split at powers of two, so nothing is
padded. Windows are then dealt to step groups of nearly equal token counts.

Null text: empty, one piece that holds only the end id. Repeated rows: each row is packed (the contract's
doc_id then repeats). Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk
from .common import table

TOP, TIERS, END_ID = 2048, (256, 512, 1024, 2048), 1
END = np.uint32(END_ID).tobytes()
#: Leftover tokens a task holds before it packs them, windows in a step group, words a task's cache holds.
BUFFER_TOKENS, STEP_WINDOWS, CACHE_WORDS = 1 << 20, 8, 3 << 19

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class WordTokenizer:
    """Ids (unsigned 32-bit, as bytes) of whole texts through a cache of the ids of their words.

    Right for tokenizers that drop white space and never look across it, ignore case, and split letters from other
    signs (`word_bpe_49k.json`): the ids of a text are then those of its words in turn, and a mark of punctuation after a letter at the
    end of a word is a word. Words of letters are looked up together, a line of them at a time; the model's
    ends of words part the ids again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache = {"": b""}

    def _fill(self, missing: list[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {"": b""}
        plain = [w for w in missing if w.isalpha()]
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        for words, e in zip(lines, self.model.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) == len(words):
                data, at = ids.tobytes(), 0
                for w, k in zip(words, cut.tolist(), strict=True):
                    self.cache[w] = data[at:k]
                    at = k
        rest = [w for w in missing if w not in self.cache]
        for w, e in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, np.uint32).tobytes()

    def batch(self, texts: pa.Array) -> list[bytes]:
        data, offs = tk.bounds(texts)
        lo = int(offs[0])
        buf, ends = data[lo : offs[-1]], offs[1:] - lo
        if b"<|" not in buf.tobytes():  # special tokens keep their case
            buf = tk.LOWER[buf]
        buf = _SPACE[buf]
        # a space before marks that end a word after a letter
        kind = _KINDS[buf]
        follows = np.append(kind[1:], np.uint8(0))
        follows[ends[(ends > 0) & (ends <= len(buf))] - 1] = 0
        mark = np.flatnonzero((kind == 2) & (np.append(np.uint8(0), kind[:-1]) == 1) & (follows == 0))
        starts = offs[:-1] - lo
        mark = mark[~np.isin(mark, starts)]
        buf = np.insert(buf, mark, 32)
        starts, ends = starts + np.searchsorted(mark, starts), ends + np.searchsorted(mark, ends)
        raw = buf.tobytes()
        words = [raw[a:b].decode().split(" ") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        missing = set().union(*words).difference(self.cache)
        if missing:
            self._fill(list(missing))
            if len(self.cache) <= len(missing) + 1:  # it was emptied before
                self._fill([w for w in set().union(*words) if w not in self.cache])
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) for w in words]


_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[9:14] = 32
_KINDS = np.full(256, 3, np.uint8)  # 0 space, 1 plain letter, 2 mark, 3 other
_KINDS[32], _KINDS[97:123] = 0, 1
_KINDS[[ord(x) for x in ".,;:!?"]] = 2
LINE_WORDS = 200


class Packer:
    """Windows of one task. Pieces are (doc, start, ids, doc_tokens)."""

    def __init__(self, first_id: int):
        self.next_id, self.next_group, self.held, self.tokens = first_id, first_id, [], 0
        self.out: list[tuple] = []
        self.groups: list[tuple[int, list]] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        n = len(ids)
        for s in range(0, n - n % TOP, TOP):
            self._close([(doc, s, ids[s : s + TOP], n)], TOP)
        if n % TOP:
            s = n - n % TOP
            self.held.append((n - s, doc, s, ids[s:], n))
            self.tokens += n - s
            if self.tokens >= BUFFER_TOKENS:
                self.flush(False)

    def _close(self, pieces: list, tier: int) -> None:
        self.groups.append((sum(len(p[2]) for p in pieces), pieces, tier))
        if len(self.groups) >= STEP_WINDOWS * 16:
            self._deal()

    def _deal(self) -> None:
        """Windows to step groups, longest first, each to the group with the fewest tokens so far."""
        n = max(1, -(-len(self.groups) // STEP_WINDOWS))
        load = [(0, g) for g in range(n)]
        for size, pieces, tier in sorted(self.groups, key=lambda w: -w[0]):
            load.sort()
            least, g = load[0]
            load[0] = (least + size, g)
            at = 0
            for doc, start, ids, total in pieces:
                self.out.append((doc, start, len(ids), zlib.crc32(ids), total, self.next_id, at, tier, self.next_group + g))
                at += len(ids)
            self.next_id += 1
        self.next_group += n
        self.groups = []

    def flush(self, last: bool) -> None:
        held = sorted(self.held, key=lambda x: (x[0], x[1], x[2]))
        lengths = [x[0] for x in held]
        rest = None
        while held:
            size = held[-1][0]
            tier = TIERS[bisect.bisect_left(TIERS, size)]
            pieces, gap = [], tier
            while gap and held:
                at = bisect.bisect_right(lengths, gap) - 1
                if at < 0:  # nothing fits: cut the shortest
                    n, doc, s, ids, total = held.pop(0)
                    lengths.pop(0)
                    pieces.append((doc, s, ids[:gap], total))
                    left = (n - gap, doc, s + gap, ids[gap:], total)
                    to = bisect.bisect_left(lengths, left[0])
                    held.insert(to, left)
                    lengths.insert(to, left[0])
                    gap = 0
                else:
                    n, doc, s, ids, total = held.pop(at)
                    lengths.pop(at)
                    pieces.append((doc, s, ids, total))
                    gap -= n
            if gap:
                rest = (tier, pieces)
            else:
                self._close(pieces, tier)
        self.held, self.tokens = [], 0
        if rest and not last:
            self.held = [(len(p[2]), p[0], p[1], p[2], p[3]) for p in rest[1]]
            self.tokens = sum(x[0] for x in self.held)
        elif rest:
            self._powers(rest[1])
        if last and self.groups:
            self._deal()

    def _powers(self, pieces: list) -> None:
        todo, left = list(pieces), sum(len(p[2]) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            got, gap = [], size
            while gap:
                doc, s, ids, total = todo.pop(0)
                got.append((doc, s, ids[:gap], total))
                if len(ids) > gap:
                    todo.insert(0, (doc, s + gap, ids[gap:], total))
                gap -= len(got[-1][2])
            self._close(got, size)
            left -= size

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        cols = list(zip(*out, strict=True)) or [[]] * 9
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of the packed sequences. tokenizer: a path that executors can read; None: the installed word_bpe_49k.json."""

    def packed(batches):
        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        tok = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
        p = Packer(TaskContext.get().partitionId() << 32)
        for b in batches:
            if b.num_rows:
                for doc, ids in zip(b.column(0).to_pylist(), tok.batch(b.column(1)), strict=True):
                    p.add(doc, np.frombuffer(ids + END, np.uint32))
            if len(p.out) > 4096:
                yield p.rows()
        p.flush(True)
        yield p.rows()

    return docs.select(doc_id, text).mapInArrow(packed, SCHEMA)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
