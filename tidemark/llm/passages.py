"""Repeated passages: the steps that the suffix-array and the suffix-tree operator share.

A *window* is ``length`` consecutive words.  Both operators report the words of a document that some window covers
which occurs at least twice in the corpus, as the least number of half-open spans of word numbers.  Both cut the
corpus where no repeat can be lost: every window holds one minimizer (:func:`textvec.anchors`), equal windows hold
equal ones, so windows whose minimizer occurs once need no further look.

Defined for every input: rows without id or text, and texts of fewer than ``length`` words, give nothing; a row that
repeats another one, id and all, is a further occurrence; rows of equal id and different text keep separate spans
under that id; columns besides id and text play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import saved, texts

SPANS = "doc_id long, rk long, lo int, hi int"


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rk, text): rk tells rows of one id apart."""
    return texts(docs, text, doc_id).withColumn("rk", F.xxhash64("text"))


def united(spans: DataFrame) -> DataFrame:
    """Touching and overlapping spans of a document become one: (doc_id, start_word, end_word)."""
    w = Window.partitionBy("doc_id", "rk").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") <= reach, 0).otherwise(1)
    return (
        spans.withColumn("new", new)
        .withColumn("island", F.sum("new").over(w))
        .groupBy("doc_id", "rk", "island")
        .agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"))
        .select("doc_id", F.col("start_word").cast("long"), F.col("end_word").cast("long"))
    )


def often(found: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that occur more than once, written down; counting combines on the map side."""
    return saved(found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def window_spans(docs: DataFrame, found: DataFrame, hot: DataFrame, key: str, gram: int, span: int, length: int) -> DataFrame:
    """(doc_id, rk, lo, hi) of repeated windows whose minimizer is too frequent for its windows to meet in one task.

    Such windows are told by a hash of all their words and counted, which combines on the map side, so that a passage
    in a third of all documents costs no more memory than any other.  Every window under a hot key is counted.
    found: (key, doc_id, rk, pos); hot: the hot keys.
    """
    at = found.join(hot.select(key), key, "left_semi").groupBy("doc_id", "rk").agg(F.collect_set("pos").alias("at"))

    def windows(w: tv.Words, doc: np.ndarray, rk: np.ndarray, at: pa.Array):
        s, a, _ = tv.anchors(w, gram, span, length)
        order = np.argsort(a, kind="stable")
        s, a = s[order], a[order]
        first = tv.runs(a)
        hit, _ = wanted(w, a[first[:-1]], w.row, at)
        s = s[np.repeat(hit, np.diff(first))]
        if not len(s):
            return None
        pow_, inv = tv._powers(len(w.hash) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(w.hash * pow_[: len(w.hash)])))
        h = tv.mix((sums[s + length] - sums[s]) * inv[s])
        return h.view(np.int64), doc[w.row[s]], rk[w.row[s]], w.position[s].astype(np.int32)

    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("lo", pa.int32())])
    every = docs.join(at, ["doc_id", "rk"]).select("doc_id", "rk", "at", "text").mapInArrow(scan(["doc_id", "rk", "at"], schema, windows), "h long, doc_id long, rk long, lo int")
    again = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return every.join(again, "h", "left_semi").select("doc_id", "rk", "lo", (F.col("lo") + length).cast("int").alias("hi"))


def scan(columns: list[str], schema: pa.Schema, f: Callable) -> Callable:
    """For mapInArrow: calls f with each chunk's words and its rows of the columns, which come as numpy arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c) for c in columns]
            flat = [c.to_numpy(zero_copy_only=False) if not pa.types.is_nested(c.type) else c for c in cols]
            for lo, hi, data, offs in tv.chunks(b.column("text")):
                out = f(tv.words(data, offs), *(c[lo:hi] if isinstance(c, np.ndarray) else c.slice(lo, hi - lo) for c in flat))
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(i).type) if isinstance(x, np.ndarray) else x for i, x in enumerate(out)], schema=schema)

    return run


def wanted(w: tv.Words, at: np.ndarray, row: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where in the rows' lists of word numbers the words ``at`` stand: (which of ``at`` are listed, index into the flat list)."""
    flat = lists.flatten()
    pos = (flat.field("pos") if pa.types.is_struct(flat.type) else flat).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    have = w.first[np.repeat(np.arange(len(sizes)), sizes)] + pos
    order = np.argsort(have, kind="stable")
    k = np.searchsorted(have, at, sorter=order)
    k[k == len(have)] = 0
    hit = have[order[k]] == at if len(have) else np.zeros(len(at), bool)
    return hit, order[k[hit]]
