"""Byte-level text kernels: tokens, rolling fingerprints and shingles of whole Arrow batches at once.

All of them work on one flat byte buffer that holds many texts, so that numpy does a few passes over a
megabyte instead of Python doing one call per word. A null text is an empty text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are gathered into buffers of about this many bytes (a longer text gets a buffer of its own).
CHUNK_BYTES = 1 << 20

#: Odd multipliers of the splitmix64 finaliser and of the rolling fingerprints.
_M1, _M2, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_BASES = (0x5851F42D4C957F2D, 0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words `[^\x20\x09-\x0D]+`.
WORDS = np.ones(256, bool)
WORDS[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


class Chunk:
    """Some texts in one buffer: text i is buf[starts[i]:ends[i]]; row i of `rows` is its record."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: pa.RecordBatch):
        self.buf, self.starts, self.ends, self.rows = buf, starts, ends, rows

    def ids(self, name: str = "doc_id") -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.starts)


def bounds(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; nulls take no bytes."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    for b in batches:
        if not b.num_rows:
            continue
        data, offs = bounds(b.column(b.schema.get_field_index(text)))
        i, n = 0, b.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            lo, hi = int(offs[i]), int(offs[j])
            yield Chunk(data[lo:hi], offs[i:j] - lo, offs[i + 1 : j + 1] - lo, b.slice(i, j - i))
            i = j


class Roller:
    """Polynomial fingerprints (mod 2**64, odd base, a random value per byte) of any slice of a buffer."""

    def __init__(self, which: int = 0):
        self.base = U64(_BASES[which])
        self.inv = U64(pow(_BASES[which], -1, 1 << 64))
        self.values = mix(np.arange(1 + 256 * which, 257 + 256 * which, dtype=np.uint64) * GOLDEN)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * (self.up[-1:] * self.base)])
            self.down = np.concatenate([self.down, self.down * (self.down[-1:] * self.inv)])
            assert len(self.up) == 2 * k

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        n = len(buf)
        self._grow(max(n, 1))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[buf] * self.up[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of the slices; the length is part of them."""
        self._grow(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)

    def every(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of all slices of one width, by start."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[width:] - prefix[:n]) * self.down[:n] + U64(width) * GOLDEN)


def words(chunk: Chunk, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that `table` marks) of every text, and n + 1 bounds: the words of text i are bounds[i]:bounds[i + 1]."""
    n = len(chunk.buf)
    on = np.zeros(n + 2, bool)
    on[1:-1] = table[chunk.buf]
    first, last = on[1:-1] & ~on[:-2], on[1:-1] & ~on[2:]
    full = chunk.ends > chunk.starts
    s, e = chunk.starts[full], chunk.ends[full] - 1
    first[s] = on[1:-1][s]
    last[e] = on[1:-1][e]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.append(np.searchsorted(starts, chunk.starts), len(starts))


def shingles(h: np.ndarray, bound: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the `width`-word shingles of every text (one of all words where there are fewer), and their n + 1 bounds."""
    count = np.diff(bound)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_bound = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(count)), n)
    first = np.arange(len(owner)) - out_bound[owner] + bound[owner]
    acc = np.zeros(len(owner), np.uint64)
    end = bound[owner + 1] if len(owner) else first
    for k in range(width):
        at = first + k
        ok = at < end
        v = np.zeros(len(owner), np.uint64)
        v[ok] = h[at[ok]]
        acc = mix(acc * GOLDEN + v + ok.astype(np.uint64))
    return acc, out_bound


def crc_of_id(ids: np.ndarray) -> np.ndarray:
    """crc32 of the ids as decimal text."""
    return np.fromiter((zlib.crc32(str(int(i)).encode()) for i in ids), np.int64, len(ids))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
