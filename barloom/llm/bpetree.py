"""op13: BPE encoding and decoding by tree concatenation.

A text of more than `leaf` characters is halved, wherever the middle falls, until no part is longer. The parts become rows of their own, which Spark deals
over the cluster and which are encoded without regard to each other. Then neighbours are joined, pair by pair up the tree: a window around each join is encoded
again, and grows until both sides agree with it exactly; the ids outside it stay.

What agreement proves, for this tokenizer (it drops white space, and splits letters, single digits and other signs from each other before it merges):
- A window that ends at a place where the tokenizer splits whatever stands around it (`SAFE`: white space, ASCII digits, between ASCII letters and marks), or at an end of the text,
  changes nothing outside. Both sides must hold the ids of their part of the window, which are encoded for comparison.
- Within a run of letters without such places near, the window ends between tokens. A BPE encoding is right if each two tokens in a row are: the first merge across a border
  of tokens would also happen in the encoding of those two alone. So the window's first token must be the left side's, and some later one, at the same
  letters, the right side's. The letters next to the ends of a run stay outside (they can belong to a contraction or a special token).
- Where neither succeeds the window grows to the next safe place, however far that is: the ids are exact for every text.

Texts of up to `leaf` characters are one part. Decoding is that of the tokenizer's file, which names no decoder: tokens with spaces between.

Null text: empty, no ids. Repeated rows each have a row; equal long texts of one doc_id are encoded once. A null doc_id is a doc_id like others here. Empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pack import WordTokenizer

#: Characters of a part at most; characters a window first takes of either side; how far the next safe place may be before a run of letters is joined at tokens;
#: letters that stay outside at the ends of a run (more than the longest special token has); tokens such a window first takes of either side.
LEAF, REACH, FAR, MARGIN, TOKENS = 16_384, 48, 256, 16, 8

_MARK = re.escape("!\"#$%&()*+,-./:;=?@[\\]^_`{}~")
#: Places where the tokenizer always splits. `<`, `>` and `|` stand in its special tokens, and `'` begins contractions.
SAFE = re.compile(rf"(?=[\t-\r ])|(?<=[\t-\r ])|(?=[0-9])|(?<=[0-9])(?=[ -~])|(?<=[A-Za-z])(?=[{_MARK}'])|(?<=[{_MARK}])(?=[A-Za-z])")
_LETTERS = re.compile("[A-Za-z]*")


def halves(n: int, leaf: int) -> list[int]:
    """Ends of the parts of n characters."""
    if n <= leaf:
        return [n]
    left = halves(n // 2, leaf)
    return left + [n // 2 + e for e in halves(n - n // 2, leaf)]


def safe_before(text: str, lo: int, at: int) -> int:
    """The last safe place up to `at` and after `lo`, or else `lo`."""
    hi, step = at, 256
    while hi > lo:
        start = max(lo, hi - step)
        last = -1
        for m in SAFE.finditer(text, start, min(len(text), hi + 1)):
            if start < m.start() <= hi and m.start() > lo:
                last = m.start()
        if last >= 0:
            return last
        hi, step = start, step * 2
    return lo


def safe_after(text: str, at: int, hi: int) -> int:
    """The first safe place from `at` on and before `hi`, or else `hi`."""
    m = SAFE.search(text, at, min(len(text), hi + 1))
    return m.start() if m and m.start() < hi else hi


class TreeEncoder:
    """Ids of whole texts, of parts, and of joined neighbours."""

    def __init__(self, path: str, reach: int = REACH, far: int = FAR):
        self.words, self.reach, self.far = WordTokenizer(path), reach, far
        vocab = self.words.model.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            names[i] = t
        self.names = [x.encode() + b" " for x in names]
        #: Letters of a token, where it is one of ASCII letters.
        self.letters = np.array([len(x.removesuffix("</w>")) for x in names], np.int64)

    def whole(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint32) for x in self.words.batch(texts)]

    def _encode(self, *texts: str) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.words.model.encode_batch_fast(list(texts), add_special_tokens=False)]

    def join(self, text: str, a: int, c: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[a:b] from those of text[a:c] and text[c:b]."""
        reach = self.reach
        while True:
            p, q = safe_before(text, a, max(a, c - reach)), safe_after(text, min(b, c + reach), b)
            if c - p > reach + self.far and q - c > reach + self.far and (found := self._in_letters(text, a, c, b, left, right)) is not None:
                return found
            before, after, both = self._encode(text[p:c], text[c:q], text[p:q])
            n, m = len(left) - len(before), len(after)
            if n >= 0 and np.array_equal(left[n:], before) and np.array_equal(right[:m], after):
                return np.concatenate([left[:n], both, right[m:]])
            if p == a and q == b:
                return both
            reach *= 2

    def _in_letters(self, text: str, a: int, c: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """The same within a run of ASCII letters, where the window ends between tokens; None if the run ends before both sides agree."""
        hi = _LETTERS.match(text, c, b).end() - MARGIN
        lo, k = c, 256
        while True:
            k *= 2
            part = text[max(a, c - k) : c][::-1]
            lo = c - _LETTERS.match(part).end()
            if c - lo < k or lo == a:
                break
        lo += MARGIN
        k = TOKENS
        while k < len(left) and k < len(right):
            i = len(left) - k
            s, e = c - int(self.letters[left[i:]].sum()), c + int(self.letters[right[:k]].sum())
            if s < lo or e > hi:
                return None
            mid = self._encode(text[s:e])[0]
            if mid[0] == left[i]:
                at = s + np.cumsum(self.letters[mid])
                there = c + np.cumsum(self.letters[right[:k]])
                _, x, y = np.intersect1d(at[:-1], there, return_indices=True)
                # ends of tokens that both have, of the same token
                same = np.flatnonzero(mid[x] == right[y])
                if len(same):
                    return np.concatenate([left[:i], mid[: x[same[0]] + 1], right[y[same[0]] + 1 :]])
            k *= 2
        return None

    def tree(self, text: str, ends: list[int], parts: list[np.ndarray]) -> np.ndarray:
        """The ids of a text from those of its parts, neighbours joined pair by pair."""
        nodes = [(s, e, ids) for s, e, ids in zip([0, *ends], ends, parts, strict=False)]
        while len(nodes) > 1:
            up = [(x[0], y[1], self.join(text, x[0], x[1], y[1], x[2], y[2])) for x, y in zip(nodes[::2], nodes[1::2], strict=False)]
            nodes = up + nodes[len(up) * 2 :]
        return nodes[0][2]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.names.__getitem__, ids.tolist()))[:-1]


_ENCODERS: dict[str | None, TreeEncoder] = {}


def encoder(path: str | None) -> TreeEncoder:
    """This process's encoder. None: the installed word_bpe_49k.json."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path not in _ENCODERS:
        file = path
        if file is None:
            import public_tokenizers

            file = public_tokenizers.path("word_bpe_49k.json")
        _ENCODERS[path] = TreeEncoder(file)
    return _ENCODERS[path]


def _rows(enc: TreeEncoder, doc_ids, all_ids: list[np.ndarray], what: str) -> pa.RecordBatch:
    """what: "ids" for the ids and the decoded text, "digest" for their hashes."""
    n, first = [len(x) for x in all_ids], None
    texts = [enc.decode(x) for x in all_ids]
    if what == "ids":
        bound = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        flat = np.concatenate(all_ids).astype(np.int32) if all_ids else np.zeros(0, np.int32)
        first, second = pa.ListArray.from_arrays(pa.array(bound), pa.array(flat)), pa.array([t.decode() for t in texts], pa.string())
    else:
        first, second = (pa.array([hashlib.sha256(x).hexdigest() for x in v], pa.string()) for v in (all_ids, texts))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), first, second], names=["doc_id", "n_tokens", "a", "b"])


def encode_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", leaf: int = LEAF, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded; with `digests` ids_sha256 and decoded_sha256 in place of the last two. tokenizer: a path that executors can read."""
    what = "digest" if digests else "ids"
    schema = "doc_id long, n_tokens long, a " + ("string" if digests else "array<int>") + ", b string"
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def short(batches):
        enc = encoder(tokenizer)
        for b in batches:
            if b.num_rows:
                yield _rows(enc, b.column(0), enc.whole(b.column(1)), what)

    def cut(batches):
        for b in batches:
            for i, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, ends = hashlib.sha256(t.encode()).hexdigest(), halves(len(t), leaf)
                parts = [t[s:e] for s, e in zip([0, *ends], ends, strict=False)]
                m = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([i] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array([key] * m), pa.array(range(m), pa.int32()), pa.array(parts, pa.string())], names=["doc_id", "copies", "key", "part", "text"])

    def encode(batches):
        enc = encoder(tokenizer)
        for b in batches:
            if b.num_rows:
                ids = [x.tobytes() for x in enc.whole(b.column(4))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=["doc_id", "copies", "key", "part", "text", "ids"])

    def concatenate(rows: pa.Table) -> pa.Table:
        """One text's parts."""
        enc = encoder(tokenizer)
        rows = rows.sort_by("part")
        parts = rows.column("text").to_pylist()
        ends = np.cumsum([len(p) for p in parts]).tolist()
        ids = enc.tree("".join(parts), ends, [np.frombuffer(x, np.uint32) for x in rows.column("ids").to_pylist()])
        n = rows.column("copies")[0].as_py()
        one = _rows(enc, pa.array([rows.column("doc_id")[0].as_py()], pa.int64()), [ids], what)
        return pa.concat_tables([pa.Table.from_batches([one])] * n)

    done = docs.where(F.length("text") <= leaf).mapInArrow(short, schema)
    long = docs.where(F.length("text") > leaf).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")).select("doc_id", "copies", "text")
    of = "doc_id long, copies long, key string, part int, text string"
    parts = long.mapInArrow(cut, of).repartition("doc_id", "key", "part").mapInArrow(encode, of + ", ids binary")
    joined = parts.groupBy("doc_id", "key").applyInArrow(concatenate, schema)
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return done.unionByName(joined).withColumnsRenamed({"a": names[0], "b": names[1]})


def op13_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digests=True)
