"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of the test items are counted in all documents.  Those that occur are seeds: a document that holds one is
aligned, around the seed's place, with the items that have it.  Where all seeds of a passage are frequent, it is aligned
only if it holds enough of the item's words for the score to be reached at all, which loses none.  The local alignment
scores words: +2 for a match, -1 for a mismatch, -1 for a word left out or put in.  Its share of the score that the
whole item would reach decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import packed, texts

GRAM, RARE, THRESHOLD, WORDS = 3, 1e-3, 0.5, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def smith_waterman(items: np.ndarray, n_items: np.ndarray, passages: np.ndarray, n_passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item (a row of word hashes, ``n_items`` of them real) with its passage: (score, end in the passage)."""
    n, width = passages.shape
    real = np.arange(width) < n_passages[:, None]
    ramp = np.arange(1, width + 1, dtype=np.int32) * -GAP
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(items.shape[1]):
        live = i < n_items
        s = np.where((passages == items[:, i, None]) & real, MATCH, MISMATCH)
        row = np.maximum(np.maximum(above[:, :-1] + s, above[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp  # words of the passage that the item lacks
        row = np.where(real, row, 0)
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = live & (top > best)
        best[better], end[better] = top[better], at[better] + 1
        above[:, 1:] = np.where(live[:, None], row, above[:, 1:])
    return best, end


class Seeds:
    """The items' words and the seed n-grams, sorted, each with its item and place; as many as the benchmark has."""

    def __init__(self, ids: list[int], text: list[str], gram: int):
        w = tv.words(*_joined(text))
        self.gram, self.ids, self.first, self.words = gram, np.array(ids, np.int64), w.first, w.hash
        self.n = np.diff(w.first)
        at = np.flatnonzero(tv.fits(w, gram)) if len(w.row) >= gram else np.zeros(0, np.int64)
        g = tv.grams(w, gram)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.key, self.of, self.place = g[order], w.row[at][order], (at - w.first[w.row[at]])[order]

    def keep(self, which: np.ndarray, rare: np.ndarray) -> None:
        self.key, self.of, self.place, self.rare = self.key[which], self.of[which], self.place[which], rare[which]
        self.table()

    def table(self) -> None:
        """A bitmap of 2^22 bits that tells most n-grams that are no seeds."""
        self.map = np.zeros(1 << 22, bool)
        self.map[(self.key >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word index, index of the first seed of that n-gram)"""
        g = tv.grams(w, self.gram)
        at = np.flatnonzero(self.map[(g >> np.uint64(42)).astype(np.int64)])
        at = at[w.row[at] == w.row[at + self.gram - 1]]
        k = np.searchsorted(self.key, g[at])
        k[k == len(self.key)] = 0
        ok = self.key[k] == g[at] if len(self.key) else np.zeros(len(at), bool)
        return at[ok], k[ok]


def _joined(text: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offs = tv.buffers(pa.array(text, pa.string()))
    return data[: offs[-1]], offs


def _count(seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        for b in batches:
            for _, _, data, offs in tv.chunks(b.column("text")):
                w = tv.words(data, offs)
                at, k = s.hits(w)
                pair = np.unique(w.row[at] * (len(s.key) + 1) + k) % (len(s.key) + 1)
                which, n = np.unique(pair, return_counts=True)
                if len(which):
                    yield pa.RecordBatch.from_arrays([pa.array(s.key[which].view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "n"])

    return run


def _slices(row: np.ndarray, n: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of whole rows whose ``n`` add up to about ``most``."""
    first, total = tv.runs(row), np.concatenate(([0], np.cumsum(n)))
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(total[first], total[first[lo]] + most, "right")) - 1)
        yield first[lo], first[hi]
        lo = hi


def _passages(s: Seeds, w: tv.Words, at: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, start, end, whether a rare seed is in it); seeds of the same item that lie near each other share a passage."""
    seed, at = tv.expand(k, n), np.repeat(at, n)
    item, row = s.of[seed], w.row[at]
    slack = s.n[item] // 4 + 3
    start = np.maximum(w.first[row], at - s.place[seed] - slack)
    end = np.minimum(w.first[row + 1], at - s.place[seed] + s.n[item] + slack)
    own = row * len(s.ids) + item
    pair, lo, hi = tv.merge_spans(own, start, end)
    wide = len(w.row) + 1
    rare = np.zeros(len(pair), bool)
    rare[np.searchsorted(pair * wide + lo, (own * wide + start)[s.rare[seed]], "right") - 1] = True
    return pair // len(s.ids), pair % len(s.ids), lo, hi, rare


def _shared(items: np.ndarray, n_items: np.ndarray, passages: np.ndarray, n_passages: np.ndarray) -> np.ndarray:
    """How many of each item's words stand anywhere in its passage; an alignment can't match more."""
    there = np.zeros(items.shape, bool)
    for j in range(passages.shape[1]):
        there |= (items == passages[:, j, None]) & (j < n_passages)[:, None]
    return (there & (np.arange(items.shape[1]) < n_items[:, None])).sum(axis=1)


def _align(seeds, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        upto = np.searchsorted(s.key, s.key, "right")
        for b in batches:
            doc, rk = b.column("doc_id").to_numpy(), b.column("rk").to_numpy()
            for lo, hi, data, offs in tv.chunks(b.column("text")):
                w = tv.words(data, offs)
                at, k = s.hits(w)
                if not len(at):
                    continue
                for x, y in _slices(w.row[at], upto[k] - k):
                    row, item, start, end, rare = _passages(s, w, at[x:y], k[x:y], (upto[k] - k)[x:y])
                    size = end - start
                    for one in np.array_split(np.argsort(size, kind="stable"), len(size) // 256 + 1):
                        m = _matrix(s.words, s.first[item[one]], s.n[item[one]])
                        p = _matrix(w.hash, start[one], size[one])
                        able = rare[one] | (_shared(m, s.n[item[one]], p, size[one]) >= threshold * s.n[item[one]])
                        one, m, p = one[able], m[able], p[able]
                        if not len(one):
                            continue
                        best, stop = smith_waterman(m, s.n[item[one]], p, size[one])
                        share = best / (MATCH * s.n[item[one]])
                        ok = np.flatnonzero(share >= threshold)
                        if not len(ok):
                            continue
                        r = row[one][ok]
                        yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][r]), pa.array(rk[lo:hi][r]), pa.array(s.ids[item[one][ok]]), pa.array(share[ok]), pa.array(start[one][ok] + stop[ok] - w.first[r])], schema=schema)

    return run


def _matrix(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(int(n.max()))
    return words[np.minimum(at, len(words) - 1)]


def _pass(spark: SparkSession, d: DataFrame, n_docs: int, rows: list, gram: int, rare: float, threshold: float) -> DataFrame | None:
    s = Seeds([int(r[0]) for r in rows], [r[1] for r in rows], gram)
    if not len(s.key):
        return None
    s.table()
    counted = spark.sparkContext.broadcast(s)
    df = d.select("text").mapInArrow(_count(counted), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    key, n = df.column("g").to_numpy().view(np.uint64), df.column("n").to_numpy()
    counted.unpersist()
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key, s.key, sorter=order), max(len(key) - 1, 0))
    count = np.where(key[order][at] == s.key, n[order][at], 0) if len(key) else np.zeros(len(s.key), np.int64)
    s.keep(count > 0, count <= max(1, rare * n_docs))
    if not len(s.key):
        return None
    return d.mapInArrow(_align(spark.sparkContext.broadcast(s), threshold), "doc_id long, rk long, item_id long, score double, end_word long")


def leaks(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, rare: float = RARE, threshold: float = THRESHOLD, words: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents that hold a test item or an edited copy of it: (doc_id, rk, item_id, score, end_word).

    ``score`` is the best alignment's share of the full score, ``threshold`` the least that is reported; ``end_word``
    the number of the document's word after the aligned passage; of equal scores the first passage counts.  All
    n-grams of ``gram`` words are seeds, whatever their number; those in at most a share ``rare`` of the documents need
    no count of words before the alignment.  A copy without ``gram`` words in a row of the item isn't found.
    Seeds meet the passages' n-grams in a broadcast join.  The benchmark is gone through in parts of at most ``words``
    words (one longer item is a part of its own), some 40 bytes each where they are broadcast, so that their size is
    bounded whatever the benchmark's is.  Rows without id or text, and items of fewer than ``gram`` words, match
    nothing; repeated rows, items or documents, are reported once per id; other columns play no part.
    """
    spark = docs.sparkSession
    d = texts(docs, text, doc_id).withColumn("rk", F.xxhash64("text"))
    out = spark.createDataFrame([], "doc_id long, rk long, item_id long, score double, end_word long")
    n_docs, held, n_words = None, [], 0
    tests = texts(benchmark, "text", "item_id").distinct().orderBy("doc_id", "text")

    def add(out: DataFrame, rows: list) -> DataFrame:
        found = _pass(spark, d, n_docs, rows, gram, rare, threshold)
        return out if found is None else out.unionByName(found)

    # the number of runs of word characters, at most one more than that of the gaps between them
    sized = tests.withColumn("n", F.length(F.regexp_replace("text", "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+", "")) + 1)
    for r in sized.toLocalIterator():
        n_docs = d.count() if n_docs is None else n_docs
        if held and n_words + r["n"] > words:
            out, held, n_words = add(out, held), [], 0
        held.append(r)
        n_words += r["n"]
    if held:
        out = add(out, held)
    best = F.max(F.struct("score", (-F.col("end_word")).alias("back"))).alias("best")
    return out.groupBy("doc_id", "rk", "item_id").agg(best).select("doc_id", "rk", "item_id", F.round("best.score", 6).alias("score"), (-F.col("best.back")).alias("end_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns of them, that hold no test item; rows without id or text stay."""
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("id"), "rk").distinct()
    return packed(docs).join(found, ["id", "rk"], "left_anti").select("row.*")
