"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is hashed; windows whose hash occurs more than once in the corpus repeat.  All
but the first occurrence, in the order of doc_id, text hash and line number, are removed: the lines that such windows
cover go, their covered positions merged.  A line that goes always stands in an earlier document or line that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from . import textvec as tv
from .common import packed, texts

WINDOW = 3


def _lines(data: np.ndarray, offs: np.ndarray):
    """Row, first byte, end and hash of each line; a line holds its bytes without the line feed."""
    n = len(data)
    feed = np.flatnonzero(data == 10)
    start = np.concatenate((offs[:-1], feed + 1))
    end = np.concatenate((feed, offs[1:]))
    # a feed's line begins at the last row start or feed before it
    start.sort()
    end.sort()
    pow_, inv = tv._powers(n + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(tv._code_exact[data] * pow_[:n])))
    h = tv.mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))
    # a text that ends with a feed has an empty last line, which begins where the next text does
    row = np.repeat(np.arange(len(offs) - 1), 1 + np.diff(np.searchsorted(feed, offs)))
    return row, start, end, h


def _windows(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("line", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, rk = b.column("doc_id").to_numpy(), b.column("rk").to_numpy()
            for lo, hi, data, offs in tv.chunks(b.column("text")):
                row, start, end, h = _lines(data, offs)
                if len(row) < width:
                    continue
                w = np.zeros(len(row) - width + 1, np.uint64)
                full = np.zeros(len(w), bool)
                blank = np.concatenate(([0], np.cumsum(~np.isin(data, (9, 10, 13, 32)))))
                text = blank[end] > blank[start]
                for k in range(width):
                    w = tv.mix(w + h[k : len(row) - width + 1 + k])
                    full |= text[k : len(row) - width + 1 + k]
                at = np.flatnonzero((row[: len(w)] == row[width - 1 :]) & full)
                if len(at):
                    first = np.searchsorted(row, np.arange(hi - lo))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][row[at]]), pa.array(rk[lo:hi][row[at]]), pa.array((at - first[row[at]]).astype(np.int32)), pa.array(w[at].view(np.int64))], schema=schema)

    return run


def later_windows(docs: DataFrame, width: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rk, line) of the windows that occurred before.  rk is xxhash64 of the text."""
    d = texts(docs, text, doc_id).withColumn("rk", F.xxhash64("text"))
    w = d.mapInArrow(_windows(width), "doc_id long, rk long, line int, h long")
    first = w.groupBy("h").agg(F.min(F.struct("doc_id", "rk", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first")
    return w.join(first, "h").where(F.struct("doc_id", "rk", "line") != F.col("first")).select("doc_id", "rk", "line")


def without_lines(text: pa.Array, at: pa.Array, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts without the lines that the windows at the line numbers ``at`` cover, their numbers of lines before, and of those removed."""
    pieces, n_lines, n_gone = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    flat, bounds = at.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))))
    for lo, hi, data, offs in tv.chunks(text):
        row, start, end, _ = _lines(data, offs)
        first = np.searchsorted(row, np.arange(hi - lo + 1))
        listed = np.repeat(first[:-1], np.diff(bounds[lo : hi + 1])) + flat[bounds[lo] : bounds[hi]]
        cover = np.zeros(len(row) + 1, np.int64)
        np.add.at(cover, listed, 1)
        np.add.at(cover, np.minimum(listed + width, first[np.searchsorted(first, listed, "right")]), -1)
        gone = np.cumsum(cover[:-1]) > 0
        # of the lines that stay, all but a row's last one keep the line feed behind them
        kept = np.flatnonzero(~gone)
        final = np.ones(len(kept), bool)
        final[:-1] = row[kept[1:]] != row[kept[:-1]]
        size = end[kept] - start[kept] + ~final
        total = np.zeros(hi - lo, np.int64)
        np.add.at(total, row[kept], size)
        pieces.append(tv.binary(np.append(data, np.uint8(10))[tv.expand(start[kept], size)], np.cumsum(total)).cast(pa.string()))
        n_lines.append(np.diff(first))
        n_gone.append(np.bincount(row[gone], minlength=hi - lo))
    return pa.concat_arrays(pieces or [pa.array([], pa.string())]), np.concatenate(n_lines), np.concatenate(n_gone)


def _cut(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lines, gone = without_lines(b.column("text"), b.column("at"), width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), text, pa.array(lines), pa.array(gone)], schema=schema)

    return run


def _removed(docs: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    return later_windows(docs, width, text, doc_id).groupBy("doc_id", "rk").agg(F.sort_array(F.collect_set("line")).alias("at"))


def dedup_lines(docs: DataFrame, width: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's text without the lines that repeat earlier ones: (doc_id, text, n_lines, n_removed).

    Lines end at line feeds and compare exactly; windows of blank lines only never count, nor do documents of fewer
    than ``width`` lines.  Rows without id or text are not returned; an empty text has one empty line and stays.
    Rows of equal id and text count as one document and all lose the same lines, rows of equal id and different text
    are ordered by text hash.  Columns besides id and text play no part.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("rk", F.xxhash64("text"))
    return d.join(_removed(docs, width, text, doc_id), ["doc_id", "rk"], "left").select("doc_id", "text", "at").mapInArrow(_cut(width), "doc_id long, text string, n_lines long, n_removed long")


def clean(docs: DataFrame, width: int = WINDOW, emptied: bool = True) -> DataFrame:
    """The documents, all columns of them, with ``text`` as :func:`dedup_lines` leaves it.

    ``n_chars``, where there is one, is counted again.  Rows without id or text stay as they are.  Documents all of
    whose lines repeat earlier ones stay as empty texts, or go if ``emptied`` is false.
    """
    gone = _removed(docs, width, "text", "doc_id").withColumnRenamed("doc_id", "id")
    cut = packed(docs).join(gone, ["id", "rk"], "left").select(F.col("row.text").cast("string").alias("text"), "at", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            touched = b.column("at").is_valid()
            where = pa.array(np.flatnonzero(touched.to_numpy(zero_copy_only=False)))
            text, lines, removed = without_lines(b.column("text").cast(pa.string()).take(where), b.column("at").take(where), width)
            empty = np.zeros(b.num_rows, bool)
            empty[where.to_numpy()] = lines == removed
            yield pa.RecordBatch.from_arrays([pc.replace_with_mask(b.column("text").cast(pa.string()), touched, text), touched, pa.array(empty), b.column("row")], names=["kept", "touched", "empty", "row"])

    flags = [StructField("touched", BooleanType()), StructField("empty", BooleanType()), StructField("row", cut.schema["row"].dataType)]
    done = cut.mapInArrow(run, StructType([StructField("kept", StringType()), *flags]))
    done = done if emptied else done.where("not empty")
    new = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    own = lambda c: F.col(f"row.`{c}`")
    return done.select(*[F.when(F.col("touched"), new[c]).otherwise(own(c)).alias(c) if c in new else own(c).alias(c) for c in docs.columns])


SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, i, hash(ls[i + 1 : i + 3]) AS h FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l WHERE len(ls) >= 3)
      WHERE length(translate(array_to_string(ls[i + 1 : i + 3], ''), chr(9) || chr(13) || ' ', '')) > 0),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT DISTINCT doc_id, i + j AS line FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1),
x AS (SELECT l.doc_id, i, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM l) l),
k AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS text, count(*) AS n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.line = x.i WHERE c.line IS NULL GROUP BY x.doc_id)
SELECT l.doc_id, coalesce(k.text, '') AS text, CAST(len(l.ls) AS BIGINT) AS n_lines, CAST(len(l.ls) - coalesce(k.n, 0) AS BIGINT) AS n_removed FROM l LEFT JOIN k ON k.doc_id = l.doc_id"""
