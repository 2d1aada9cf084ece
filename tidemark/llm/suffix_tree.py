"""Substring dedup by prefix-partitioned suffix trees.

Suffixes begin at minimizers, of which every window of ``length`` words has one within its first ``reach`` words; two
equal windows share it, so their suffixes agree for ``length - reach + 1`` words at least, the *floor*.  Suffixes are
split by prefixes of increasing length until a group fits in memory, prefixes of up to ``floor`` words lose nothing;
groups of one suffix are dropped, small groups share a task.  Each group's suffixes, sorted with their common
prefixes, are the leaves of its suffix tree in depth-first order; the tree's internal nodes are built from them, each
with its leaves, its depth and its parent (:func:`nodes`).  A node deeper than the floor is a repeat of as many words;
leaves of one node that also agree on the words before, so many that ``length`` are reached, are repeats of at least
``length`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import saved
from .passages import SPANS, keyed, often, scan, united, wanted, window_spans

LENGTH, GRAM, REACH, GROUP, HOT = 50, 8, 32, 50_000, 200_000


def leaves(right: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth-first order of the leaves of all groups' suffix trees and each leaf's common prefix with the one before."""
    wide = right if right.shape[1] % 2 == 0 else np.pad(right, ((0, 0), (0, 1)))
    # two words to a number, the first in its upper half, or suffixes that share an odd number of words would not stand together
    pairs = wide[:, ::2].astype(np.uint64) << np.uint64(32) | wide[:, 1::2]
    order = np.lexsort((*reversed(pairs.T), group))
    r, g = right[order], group[order]
    same = np.ones((len(r), right.shape[1] + 1), bool)
    same[1:, :-1] = r[1:] == r[:-1]
    same[:, -1] = False
    depth = same.argmin(axis=1)
    depth[0:1] = 0
    depth[1:][g[1:] != g[:-1]] = 0
    return order, depth


@dataclass
class Tree:
    """Internal nodes of a group's suffix tree that are at least as deep as was asked for, children before parents."""

    first: np.ndarray  #: of its leaves, in depth-first order
    last: np.ndarray
    depth: np.ndarray  #: words that all its leaves share
    parent: np.ndarray  #: a node, or -1 where the parent isn't deep enough

    @property
    def above(self) -> np.ndarray:
        """The depth at which each node's edge begins."""
        return np.where(self.parent < 0, 0, self.depth[self.parent]) if len(self.depth) else self.depth


def nodes(depth: np.ndarray, least: int) -> Tree:
    """The tree of leaves with these common prefixes: from the deepest up, each node takes in the nodes and leaves between its ends."""
    first, last, deep, parent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    top, n = np.full(len(depth), -1, np.int64), 0
    parents = np.zeros(0, np.int64)
    for d in np.unique(depth[depth >= least])[::-1]:
        begin = np.flatnonzero(depth < d)  # leaves that share less than d words with the one before
        end = np.append(begin[1:], len(depth)) - 1
        at = np.unique(np.searchsorted(begin, np.flatnonzero(depth == d), "right") - 1)
        lo, hi = begin[at], end[at]
        inside = tv.expand(lo, hi - lo + 1)
        own = np.repeat(np.arange(n, n + len(lo)), hi - lo + 1)
        parents = np.append(parents, np.full(len(lo), -1))
        child = top[inside]
        parents[child[child >= 0]] = own[child >= 0]
        top[inside] = own
        first.append(lo)
        last.append(hi)
        deep.append(np.full(len(lo), d))
        n += len(lo)
    return Tree(np.concatenate(first), np.concatenate(last), np.concatenate(deep), parents)


def maximal_repeats(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, group: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """For each suffix and each number of words before it (columns): does the window that starts there repeat?

    A window with o words before the suffix needs length - o words of it.  The nodes whose edges cross that depth hold
    the suffixes that share them; of a node's leaves, those that also agree on the o words before are one repeat.
    """
    order, depth = leaves(right, group)
    t = nodes(depth, length - left.shape[1])
    above = t.above
    left, n_left, n_right, times = left[order], n_left[order], n_right[order], times[order]
    out = np.zeros((len(order), left.shape[1] + 1), bool)
    before = np.zeros(len(order), np.uint64)
    for o in range(left.shape[1] + 1):
        if o:
            before = tv.mix(before + left[:, -o].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(o))
        whole = (n_left >= o) & (n_right >= length - o)
        out[:, o] = whole & (times > 1)
        across = np.flatnonzero((t.depth >= length - o) & (above < length - o))
        size = t.last[across] - t.first[across] + 1
        leaf, node = tv.expand(t.first[across], size), np.repeat(across, size)
        leaf, node = leaf[whole[leaf]], node[whole[leaf]]
        if not len(leaf):
            continue
        _, which = np.unique(tv.mix(node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ before[leaf]), return_inverse=True)
        out[leaf, o] = np.bincount(which, weights=times[leaf])[which] > 1
    back = np.empty_like(out)
    back[order] = out
    return back


def _groups(length: int, reach: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def one(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        group, context = col("part"), col("context")
        first = tv.runs(group, context)
        times, own = np.diff(first), first[:-1]
        take = t.column("words").take(pa.array(own))
        data, offs = tv.buffers(take.combine_chunks() if isinstance(take, pa.ChunkedArray) else take)
        m = data[offs[0] : offs[-1]].view(np.uint32).reshape(len(own), reach - 1 + length)
        out = maximal_repeats(m[:, : reach - 1], col("n_left")[own], m[:, reach - 1 :], col("n_right")[own], group[own], times, length)
        leaf, o = np.nonzero(out)
        leaf, lo, hi = tv.merge_spans(leaf, -o, -o + length)
        if not len(leaf):
            return None
        at = tv.expand(first[leaf], times[leaf])
        pos = col("pos")[at]
        ends = [pa.array((pos + np.repeat(x, times[leaf])).astype(np.int32)) for x in (lo, hi)]
        return pa.RecordBatch.from_arrays([pa.array(col("doc_id")[at]), pa.array(col("rk")[at]), *ends], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tv.whole_groups(batches, "part", rows):
            if (out := one(t)) is not None:
                yield out

    return run


def prefixes(found: DataFrame, levels: list[str], most: int) -> DataFrame:
    """(last level, part): the shortest prefix that at most ``most`` suffixes share, else the longest one."""
    counts = found.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    part = F.col(levels[-1])
    for level in reversed(levels[:-1]):
        sizes = counts.groupBy(level).agg(F.sum("n").alias(f"n_{level}"))
        counts = counts.join(sizes, level)
        part = F.when(F.col(f"n_{level}") <= most, F.col(level)).otherwise(part)
    return counts.select(levels[-1], part.alias("part"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, reach: int = REACH, text: str = "text", doc_id: str = "doc_id", group_rows: int = GROUP, hot_rows: int = HOT) -> DataFrame:
    """Spans of words that also occur elsewhere, ``length`` words or more at a stretch.

    Returns (doc_id, start_word, end_word), half-open word numbers within the document; all occurrences are reported,
    the first too.  A group of suffixes holds ``group_rows`` at most, unless more than that share their first
    ``length - reach + 1`` words; where more than ``hot_rows`` share even those, their windows are counted by hash
    instead, which loses none.  Nulls, short and empty texts, repeated rows and further columns: see :mod:`passages`.
    """
    docs = keyed(docs, text, doc_id)
    floor = length - reach + 1
    depths = sorted({gram, (gram + floor) // 2, floor})
    levels = [f"p{d}" for d in depths]
    assert reach + gram - 1 <= length and gram <= floor

    def find(w: tv.Words, doc: np.ndarray, rk: np.ndarray):
        a = np.unique(tv.anchors(w, gram, reach, length)[1])
        return *(tv.grams(w, d)[a].view(np.int64) for d in depths), doc[w.row[a]], rk[w.row[a]], w.position[a].astype(np.int32)

    ids = [("doc_id", pa.int64()), ("rk", pa.int64()), ("pos", pa.int32())]
    marks = pa.schema([*((x, pa.int64()) for x in levels), *ids])
    found = docs.mapInArrow(scan(["doc_id", "rk"], marks, find), ", ".join(f"{x} long" for x in levels) + ", doc_id long, rk long, pos int")
    counts = often(found, levels[-1])
    hot = counts.where(F.col("n") > hot_rows)
    again = saved(found.join(counts.where(F.col("n") <= hot_rows).select(levels[-1]), levels[-1], "left_semi"))
    at = again.join(prefixes(again, levels, group_rows), levels[-1]).groupBy("doc_id", "rk").agg(F.collect_set(F.struct("pos", "part")).alias("at"))

    def cut(w: tv.Words, doc: np.ndarray, rk: np.ndarray, at: pa.Array):
        a = np.unique(tv.anchors(w, gram, reach, length)[1])
        hit, which = wanted(w, a, w.row, at)
        a = a[hit]
        if not len(a):
            return None
        lo, hi = w.first[w.row[a]], w.first[w.row[a] + 1]
        n_left, n_right = np.minimum(a - lo, reach - 1), np.minimum(hi - a, length)
        inside = a[:, None] + np.arange(-(reach - 1), length)
        real = (inside >= lo[:, None]) & (inside < hi[:, None])
        m = np.where(real, (w.hash[np.where(real, inside, 0)] >> np.uint64(32)).astype(np.uint32), np.uint32(0))
        wide = np.zeros((len(m), m.shape[1] + m.shape[1] % 2), np.uint32)
        wide[:, : m.shape[1]] = m
        wide = wide.view(np.uint64)
        context = np.zeros(len(a), np.uint64)
        for j in range(wide.shape[1]):
            context = tv.mix(context + wide[:, j])
        context = tv.mix(context + (n_left * 1000 + n_right).astype(np.uint64))
        part = at.flatten().field("part").to_numpy()[which]
        return part, context.view(np.int64), doc[w.row[a]], rk[w.row[a]], w.position[a].astype(np.int32), n_left.astype(np.int32), n_right.astype(np.int32), tv.binary(m)

    pieces = pa.schema([("part", pa.int64()), ("context", pa.int64()), *ids, ("n_left", pa.int32()), ("n_right", pa.int32()), ("words", pa.binary())])
    suffixes = docs.join(at, ["doc_id", "rk"]).select("doc_id", "rk", "at", "text").mapInArrow(scan(["doc_id", "rk", "at"], pieces, cut), "part long, context long, doc_id long, rk long, pos int, n_left int, n_right int, words binary")
    spans = suffixes.repartition("part").sortWithinPartitions("part", "context").mapInArrow(_groups(length, reach, 10_000), SPANS)
    if not hot.isEmpty():
        spans = spans.unionByName(window_spans(docs, found, hot, levels[-1], gram, reach, length))
    return united(spans)


def spans_sql(length: int = LENGTH, table: str = "documents") -> str:
    """The same spans in SQL that DuckDB runs, by comparing all windows."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{tv.WORD_RE}') AS ws FROM {table}),
    g AS (SELECT doc_id, i, hash(ws[i + 1 : i + {length}]) AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {length} + 1)) AS i FROM w WHERE len(ws) >= {length})),
    r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
    b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM r),
    s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM b)
    SELECT doc_id, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + {length} AS BIGINT) AS end_word FROM s GROUP BY doc_id, k"""
