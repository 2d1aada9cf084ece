"""Vectorised words, n-grams and minimizers over Arrow string columns.

Everything here works on the bytes of many texts at once, so that a Python
worker spends its time in numpy and not in loops over words.  A *word* is a
maximal run of ASCII letters, ASCII digits and non-ASCII characters; ASCII
letters compare without case.  Hashes are 64 bits wide and the same on every
machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_is_word = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _is_word[list(_r)] = True
_code = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_code_exact = _code.copy()
_code[65:91] = _code[97:123]
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)
#: a regular expression for the same words, in the syntax of RE2 and Java, on text whose ASCII letters are lower case
WORD_RE = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, CHUNK_BYTES * 2)
        _pow, _inv = np.full(n, _P, U64), np.full(n, _P_INV, U64)
        _pow[0] = _inv[0] = 1
        np.multiply.accumulate(_pow, out=_pow)
        np.multiply.accumulate(_inv, out=_inv)
    return _pow, _inv


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls, uncopied."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1] if off else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offs.astype(np.int64)


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about ``limit`` bytes."""
    data, offs = buffers(arr)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@dataclass
class Words:
    row: np.ndarray  #: of the chunk, for each word
    start: np.ndarray  #: byte offsets in the chunk
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: index of the first word of each row, and the number of words

    @property
    def position(self) -> np.ndarray:
        return np.arange(len(self.row)) - self.first[self.row]


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    n = len(data)
    cls = _is_word[data]
    inner = offs[(offs > 0) & (offs < n)]
    edge = np.empty(n + 1, bool)
    edge[1:n] = cls[1:] != cls[:-1]
    edge[0] = edge[n] = True
    edge[inner] = True
    at = np.flatnonzero(edge)
    keep = cls[at[:-1]] if n else np.zeros(0, bool)
    start, end = at[:-1][keep], at[1:][keep]
    pow_, inv = _powers(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(_code[data] * pow_[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64))
    first = np.searchsorted(start, offs)
    return Words(np.repeat(np.arange(len(offs) - 1), np.diff(first)), start, end, h, first)


def grams(w: Words, n: int) -> np.ndarray:
    """Hash of the n words from each word on; meaningless within n - 1 words of a row's end (see :func:`fits`)."""
    h = w.hash
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def fits(w: Words, n: int) -> np.ndarray:
    """Whether the n words from each word on lie in one row."""
    return w.row[: max(0, len(w.row) - n + 1)] == w.row[n - 1 :] if len(w.row) >= n else np.zeros(0, bool)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(w: Words, k: int, span: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers: of the first ``span`` k-word grams of every window of ``length`` words, the one with the least hash.

    Returns the windows' first words, each window's anchor (a word index) and the grams' hashes.  Equal windows have
    equal anchors wherever they stand, as ties go to the left.
    """
    assert span + k - 1 <= length
    g = grams(w, k)
    if len(w.row) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    bits = U64(max(1, int(len(g)).bit_length()))
    least = window_min(((g >> bits) << bits) | np.arange(len(g), dtype=U64), span)
    ok = np.flatnonzero(fits(w, length))
    return ok, (least[ok] & ((U64(1) << bits) - U64(1))).astype(np.int64), g


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start indices of runs in which all keys stay the same, and the length."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n]))


def binary(rows: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """A binary column: of the rows of a matrix, or of pieces of a byte array that end at ``ends``."""
    if ends is None:
        ends = np.arange(1, len(rows) + 1, dtype=np.int64) * (rows.strides[0] if rows.ndim == 2 else rows.itemsize)
    offs = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(rows))])


def expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (n[0] of them), lo[1], ..."""
    n = n.astype(np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)


def merge_spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite touching and overlapping half-open spans of each document; sorted."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    first = runs(doc)
    base = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (int(hi.max()) - int(lo.min()) + 2)
    reach = np.maximum.accumulate(hi + base)
    new = np.concatenate(([True], (lo + base)[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], lo[at], reach[last] - base[last]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 100_000, shift: int = 0) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``key`` into tables of at least ``least`` rows that split no key (less its last ``shift`` bits)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy() >> shift
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            rows = t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)
