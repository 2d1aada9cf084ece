"""Sharding by histogram sort.

Documents get a key that orders them at random but the same in every run.  Splitters that cut the order into shards of
equal bytes are found by rounds of probes: all partitions count the exact bytes below each probe, and each splitter's
bracket shrinks to the probes around its target, until every splitter is within the tolerance or has no key left
between its bounds.  Then the documents are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SHARDS, TOLERANCE, PROBES = 64, 0.01, 32
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(probes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(len(probes) + 1), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column("key").to_numpy(), "right")
            sums += np.bincount(at, weights=b.column("bytes").to_numpy(), minlength=len(sums))
            rows += np.bincount(at, minlength=len(sums))
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.int64)), pa.array(rows[at])], names=["at", "bytes", "rows"])

    return run


def bytes_below(sizes: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes and number of the rows with a key below each probe (sorted), a column each; as many numbers as probes reach the driver."""
    sums = np.zeros((len(probes) + 1, 2), np.int64)
    for at, size, rows in sizes.mapInArrow(_below(probes), "at int, bytes long, rows long").groupBy("at").agg(F.sum("bytes"), F.sum("rows")).collect():
        sums[at] = size, rows
    return np.cumsum(sums, axis=0)[:-1]


def between(lo: int, hi: int, n: int) -> list[int]:
    """At most n whole numbers strictly between lo and hi, evenly spread."""
    n = min(n, hi - lo - 1)
    return [lo + (hi - lo) * (k + 1) // (n + 1) for k in range(n)]


def splitters(sizes: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """Keys at which shards begin, all but the first; bytes below the i-th are within tolerance of i shares if keys allow it.

    sizes: (key long, bytes long).  Keys that many rows share can't be cut; the nearer side is taken.
    """
    total, rows = map(int, sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first())
    targets = [total * i // shards for i in range(1, shards)]
    slack = tolerance * total / shards
    lo, hi = [(LOW, 0, 0)] * len(targets), [(HIGH, total, rows)] * len(targets)
    done: list[int | None] = [None] * len(targets)
    while (open_ := [i for i, d in enumerate(done) if d is None]):
        tried = sorted({p for i in open_ for p in between(lo[i][0], hi[i][0], probes)})
        counted = dict(zip(tried, bytes_below(sizes, np.array(tried, np.int64)).tolist())) if tried else {}
        for i in open_:
            for p in between(lo[i][0], hi[i][0], probes):
                if counted[p][0] <= targets[i]:
                    lo[i] = max(lo[i], (p, *counted[p]))
                else:
                    hi[i] = min(hi[i], (p, *counted[p]))
            near = min(lo[i], hi[i], key=lambda x: abs(x[1] - targets[i]))
            if abs(near[1] - targets[i]) <= slack or hi[i][2] - lo[i][2] <= 1 or hi[i][0] - lo[i][0] <= 1:
                done[i] = near[0]
    return sorted(done)


def keys(docs: DataFrame, text: str, doc_id: str) -> tuple:
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")), size


def shards(docs: DataFrame, n: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows as (shard, key, doc_id, text), each shard one partition in the order of key.

    A shard's bytes of text differ from an n-th of all by twice the tolerance at most, unless single texts or repeated
    rows are larger than that.  Null ids and texts are kept, a null text counts no bytes; other columns are left out.
    Repeated rows have equal keys and are never parted; an empty table gives no rows.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    key, size = keys(d, "text", "doc_id")
    cuts = splitters(saved(d.select(key.alias("key"), size.alias("bytes"))), n, tolerance, probes)
    held = docs.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, k.to_numpy(), "right").astype(np.int32))

    placed = d.withColumn("key", key).select(place("key").alias("shard"), "key", "doc_id", "text")
    return placed.repartitionById(n, "shard").sortWithinPartitions("key")
