"""Suffix-array dedup by threshold-bounded interval expansion.

The corpus is cut into blocks that no repeat crosses (see :mod:`passages`).  A block's segments, each distinct one
once with its number of occurrences, are joined with unique separators; its suffixes are sorted by prefix doubling as
deep as the threshold, which gives the Burrows-Wheeler transform.  Breadth-first backward extension, one word a level,
then writes the common prefixes of neighbouring suffixes by increasing value, each entry once, and stops at the
minimum length: entries that are still unwritten are those of repeated windows.  (Beller, Gog, Ohlebusch, Schnattinger:
Computing the longest common prefix array based on the Burrows-Wheeler transform, 2013.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .passages import SPANS, keyed, often, scan, united, wanted, window_spans

LENGTH, GRAM, HOT = 50, 8, 200_000


def suffix_sort(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least; the text must end with a symbol of its own."""
    n, have = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while have < depth and n:
        nxt = np.zeros(n, np.int64)
        nxt[: n - have] = rank[have:] + 1
        order = np.argsort(key := rank * (n + 1) + nxt)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        have *= 2
        if n and rank[order[-1]] == n - 1:
            return order
    return np.argsort(rank, kind="stable")


def bounded_prefixes(text: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``; those of ``least`` and more stay at ``least``.

    ``sa`` need only be sorted ``least`` symbols deep.
    """
    n = len(text)
    lcp = np.full(n + 1, least, np.int32)
    if not n:
        return lcp[:0]
    done = np.zeros(n + 1, bool)
    done[0] = done[n] = True
    lcp[0] = lcp[n] = 0
    at = np.empty(n, np.int64)
    at[sa] = np.arange(n)
    back = at[sa - 1]  # of each suffix, where the one that starts a symbol earlier stands
    first = text[sa]
    lb, rb = np.zeros(1, np.int64), np.full(1, n - 1)
    for depth in range(least):
        if not len(lb):
            break
        size = rb - lb + 1
        parent = np.repeat(np.arange(len(lb)), size)
        pos = back[tv.expand(lb, size)]
        order = np.argsort(pos)
        pos, parent = pos[order], parent[order]
        cut = tv.runs(parent, first[pos])
        lb, rb = pos[cut[:-1]], pos[cut[1:] - 1]
        new = ~done[rb + 1]
        lb, rb = lb[new], rb[new]
        done[rb + 1] = True
        lcp[rb + 1] = depth
    return lcp[:n]


def repeated_windows(tokens: np.ndarray, ends: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """Which tokens of the segments (that end at ``ends`` and occur ``times``) begin a window that occurs twice or more."""
    sizes = np.diff(np.concatenate(([0], ends)))
    segment = np.repeat(np.arange(len(ends)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(tokens))
    ids = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    text = np.empty(len(tokens) + len(ends), np.int64)
    place = np.arange(len(tokens)) + segment
    text[place] = ids
    text[ends + np.arange(len(ends))] = len(tokens) + np.arange(len(ends))
    sa = suffix_sort(text, length)
    deep = bounded_prefixes(text, sa, length) >= length
    hit = np.zeros(len(text), bool)
    hit[sa[deep]] = True
    hit[sa[np.flatnonzero(deep) - 1]] = True
    return (hit[place] | (times[segment] > 1)) & (left >= length)


def _blocks(length: int, block_rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def one(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        gram, seg = col("gram"), col("seg")
        first = tv.runs(gram, seg)
        times = np.diff(first)
        own = t.column("words").take(pa.array(first[:-1]))
        data, offs = tv.buffers(own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own)
        tokens = data[offs[0] : offs[-1]].view(np.uint32)
        ends = (offs[1:] - offs[0]) // 4
        # a segment alone under its anchor can only repeat as a whole
        of = tv.runs(gram[first[:-1]])
        alone = np.repeat(np.diff(of) == 1, np.diff(of))
        sizes = np.diff(np.concatenate(([0], ends)))
        hit = np.zeros(len(tokens), bool)
        many = ~alone
        if many.any():
            inside = np.repeat(many, sizes)
            hit[inside] = repeated_windows(tokens[inside], np.cumsum(sizes[many]), times[many], length)
        segment = np.repeat(np.arange(len(ends)), sizes)
        offset = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
        hit |= (times[segment] > 1) & (offset + length <= sizes[segment])
        s, lo, hi = tv.merge_spans(segment[hit], offset[hit], offset[hit] + length)
        if not len(s):
            return None
        rows = tv.expand(first[s], times[s])
        lo, hi = np.repeat(lo, times[s]), np.repeat(hi, times[s])
        start = col("start")[rows]
        return pa.RecordBatch.from_arrays([pa.array(col("doc_id")[rows]), pa.array(col("rk")[rows]), pa.array((start + lo).astype(np.int32)), pa.array((start + hi).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tv.whole_groups(batches, "gram", block_rows):
            if (out := one(t)) is not None:
                yield out

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", block_rows: int = 8_000, hot_rows: int = HOT) -> DataFrame:
    """Spans of words that also occur elsewhere, ``length`` words or more at a stretch.

    Returns (doc_id, start_word, end_word), half-open word numbers within the document; all occurrences are reported,
    the first too.  ``gram`` words make an anchor; ``block_rows`` segments make a block.  Windows whose anchor stands in
    more than ``hot_rows`` places would not fit in a block; they are counted by hash instead, which loses none.  Nulls,
    short and empty texts, repeated rows and further columns: see :mod:`passages`.
    """
    docs = keyed(docs, text, doc_id)
    span = length - gram + 1

    def find(w: tv.Words, doc: np.ndarray, rk: np.ndarray):
        s, a, g = tv.anchors(w, gram, span, length)
        a = a[tv.runs(a)[:-1]]
        return g[a].view(np.int64), doc[w.row[a]], rk[w.row[a]], w.position[a].astype(np.int32)

    marks = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("pos", pa.int32())])
    found = docs.mapInArrow(scan(["doc_id", "rk"], marks, find), "gram long, doc_id long, rk long, pos int")
    counts = often(found, "gram")
    hot = counts.where(F.col("n") > hot_rows)
    at = found.join(counts.where(F.col("n") <= hot_rows).select("gram"), "gram", "left_semi").groupBy("doc_id", "rk").agg(F.collect_set("pos").alias("at"))

    def cut(w: tv.Words, doc: np.ndarray, rk: np.ndarray, at: pa.Array):
        s, a, g = tv.anchors(w, gram, span, length)
        first = tv.runs(a)
        hit, _ = wanted(w, a[first[:-1]], w.row, at)
        lo, n, a = s[first[:-1]][hit], np.diff(first)[hit] + length - 1, a[first[:-1]][hit]
        if not len(lo):
            return None
        inside = tv.expand(lo, n)
        tokens = (w.hash[inside] >> np.uint64(32)).astype(np.uint32)
        ends = np.cumsum(n)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(tv.mix(w.hash[inside] + (np.arange(len(inside)) - np.repeat(ends - n, n)).astype(np.uint64)))))
        seg = tv.mix(sums[ends] - sums[ends - n] + n.astype(np.uint64))
        return g[a].view(np.int64), seg.view(np.int64), doc[w.row[lo]], rk[w.row[lo]], w.position[lo].astype(np.int32), tv.binary(tokens, ends * 4)

    pieces = pa.schema([("gram", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])
    segments = docs.join(at, ["doc_id", "rk"]).select("doc_id", "rk", "at", "text").mapInArrow(scan(["doc_id", "rk", "at"], pieces, cut), "gram long, seg long, doc_id long, rk long, start int, words binary")
    spans = segments.repartition("gram").sortWithinPartitions("gram", "seg").mapInArrow(_blocks(length, block_rows), SPANS)
    if not hot.isEmpty():
        spans = spans.unionByName(window_spans(docs, found, hot, "gram", gram, span, length))
    return united(spans)
