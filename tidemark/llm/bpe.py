"""Byte-pair encoding and decoding with the vocabularies of public tokenizers.

A text is cut into words by the vocabulary's pattern.  A short word is merged over a contiguous array: the boundaries
of its parts and, beside each, the rank of the pair of parts that meet there.  The least rank is found by scanning
the array, its boundary is deleted and the two ranks next to it are looked up anew, until no pair has a rank.  Words
of more than ``SHORT`` bytes, for which scanning would grow with the square, use a heap and give the same parts.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, CACHED = 96, 300_000
NONE = 1 << 62


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks by bytes, from a file with a base64 string and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word, by the contiguous rank array."""
    n = len(word)
    cut = list(range(n + 1))
    get = ranks.get
    rank = [get(word[i : i + 2], NONE) for i in range(n - 1)]
    while rank:
        least = min(rank)
        if least == NONE:
            break
        i = rank.index(least)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[cut[i] : cut[i + 2]], NONE)
        if i:
            rank[i - 1] = get(word[cut[i - 1] : cut[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as :func:`merge_short` in n log n steps: a heap of pairs over linked parts."""
    n = len(word)
    nxt, prv = list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or nxt[nxt[i]] != end:
            continue
        j = nxt[i]
        alive[j] = False
        nxt[i] = end
        if end < n:
            prv[end] = i
            if (r := get(word[i : nxt[end]], NONE)) != NONE:
                heapq.heappush(heap, (r, i, nxt[end]))
        if (p := prv[i]) >= 0 and (r := get(word[p:end], NONE)) != NONE:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : nxt[i]]])
        i = nxt[i]
    return out


class Words(dict):
    """Token ids, as the bytes of 32-bit numbers, by word; worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        out = np.array(ids, np.int32).tobytes()
        if len(raw) <= SHORT:
            if len(self) >= CACHED:
                self.clear()
            self[word] = out
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        parts = [b""] * (max(ranks.values()) + 1)
        for part, i in ranks.items():
            parts[i] = part
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.data[tv.expand(self.start[ids], self.size[ids])]


def _encode(ranks, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, word, decode = regex.compile(pattern).findall, Words(ranks.value), Decoder(ranks.value)
        get = word.__getitem__
        for b in batches:
            for i in range(0, b.num_rows, 256):
                ids, column = b.column("doc_id").slice(i, 256), b.column("text").slice(i, 256)
                null = column.is_null().to_numpy(zero_copy_only=False)
                texts = column.to_pylist()
                raw = [b"" if t is None else b"".join(map(get, find(t))) for t in texts]
                n = np.array([len(r) >> 2 for r in raw], np.int64)
                flat = np.frombuffer(b"".join(raw), np.int32)
                ends = np.concatenate(([0], np.cumsum(n)))
                ok = [t is None or decode(flat[ends[k] : ends[k + 1]]).tobytes() == t.encode() for k, t in enumerate(texts)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(null, False)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(n, mask=null), pa.array(ok, pa.bool_(), mask=null)], schema=schema)

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip), a row for each row, the whole text encoded and decoded again.

    ``round_trip`` tells whether decoding gives the text back byte for byte.  A null text has null in all three; an
    empty one no tokens.  Null ids and repeated rows are kept as they are; other columns play no part.  The
    vocabulary's file is read by the driver and sent to the workers once; one that lacks a byte is an error, as texts
    with that byte would have no tokens.
    """
    own = load(vocabulary)
    if lacking := [i for i in range(256) if bytes([i]) not in own]:
        raise ValueError(f"the vocabulary lacks {len(lacking)} of the 256 bytes, the first is {lacking[0]}")
    ranks = docs.sparkSession.sparkContext.broadcast(own)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_encode(ranks, pattern), "doc_id long, tokens array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null tokens give a null text.  Bytes that aren't UTF-8 become U+FFFD."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(ranks.value)
        for b in batches:
            lists = b.column("tokens")
            out = [None if not x.is_valid else back(x.values.to_numpy()).tobytes().decode("utf-8", "replace") if len(x.values) else "" for x in lists]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")
