"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log of the ratio of their smoothed frequencies in the two classes; a linear model
is then fitted to them with the hinge loss, by dual coordinate descent.  (Wang, Manning: Baselines and bigrams, 2012;
Hsieh et al.: A dual coordinate descent method for large-scale linear SVM, 2008.)  Two such models share the features:
one tells low quality, one toxic text; a document that either rejects is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import texts

SAMPLE, BITS, PREFIXES, TOLERANCE = 8_000, 20, (4, 6, 8), 1e-2
_kind = np.where(tv._is_word, 1, 2).astype(np.int8)
_kind[[9, 10, 11, 12, 13, 32]] = 0
_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), sorted, each once: runs of word characters or of signs, pairs of them, their first bytes, and one to three of their shapes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _kind[data]
    edge = np.empty(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[0] = edge[n] = True
    edge[offs[(offs > 0) & (offs < n)]] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] > 0
    start, end = at[:-1][keep], at[1:][keep]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pow_, inv = tv._powers(n + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(tv._code[data] * pow_[:n])))
    h = tv.mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))
    row = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs)))
    upper = np.concatenate(([0], np.cumsum(_upper[data])))
    capitals = upper[end] - upper[start]
    sign = kind[start] == 2
    shape = np.where(sign, h, np.select([_digit[data[start]], (capitals == end - start) & (end - start > 1), _upper[data[start]]], [4, 3, 2], 1).astype(np.uint64))
    out = []
    heads = []
    for k in PREFIXES:
        stop = np.minimum(start + k, end)
        heads.append((tv.mix((sums[stop] - sums[start]) * inv[start]), (1,), 40 + k))
    for seq, orders, salt in ((h, (1, 2), 11), (shape, (1, 2, 3), 29), *heads):
        for k in orders:
            if len(seq) < k:
                continue
            g = np.full(len(seq) - k + 1, salt + k, np.uint64)
            for j in range(k):
                g = g * np.uint64(0xD6E8FEB86659FD93) + tv.mix(seq[j : len(seq) - k + 1 + j] + np.uint64(1))
            ok = row[: len(g)] == row[k - 1 :]
            out.append((row[: len(g)][ok] << bits) | (tv.mix(g[ok]) >> np.uint64(64 - bits)).astype(np.int64))
    key = np.unique(np.concatenate(out))
    return key >> bits, key & ((1 << bits) - 1)


def scaling_counts(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many samples of class +1 and of class -1 each feature occurs."""
    out = np.zeros((2, width), np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    for a, b, c in zip(starts, ends, y):
        out[int(c < 0), flat[a:b]] += 1  # a sample has each of its features once
    return out[0], out[1]


def dual_coordinate_descent(flat: np.ndarray, ends: np.ndarray, value: np.ndarray, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, tolerance: float = TOLERANCE, seed: int = 7) -> np.ndarray:
    """Weights, the bias last, of least |w|^2 / 2 + sum of cost * hinge loss.

    Sample i has the features flat[ends[i - 1]:ends[i]], each with its ``value`` times scale[i], and a constant 1.
    Rounds over the samples in random order go on until no projected gradient of the dual is off by more than
    ``tolerance`` in a round over all samples; there is no other end.  Samples at a bound that the gradient holds there
    are left out of the rounds in between (shrinking).
    """
    starts = np.concatenate(([0], ends[:-1]))
    square = value * value
    own = [flat[a:b] for a, b in zip(starts, ends)]
    norm = np.array([1 + s * s * square[x].sum() for x, s in zip(own, scale)])
    # u holds the weights times the values, so that a margin is a sum of u over a sample's features
    u, bias, alpha = np.zeros(len(value)), 0.0, np.zeros(len(y))
    rng = np.random.Generator(np.random.PCG64(seed))
    everyone = np.arange(len(y))
    active, high, low = everyone, np.inf, -np.inf
    while len(y):
        most, least, stay = -np.inf, np.inf, []
        for i in rng.permutation(active).tolist():
            x, sign, a = own[i], y[i], alpha[i]
            g = sign * (scale[i] * u[x].sum() + bias) - 1
            if a <= 0:
                if g > high:
                    continue
                pg = min(g, 0.0)
            elif a >= cost[i]:
                if g < low:
                    continue
                pg = max(g, 0.0)
            else:
                pg = g
            stay.append(i)
            most, least = max(most, pg), min(least, pg)
            if abs(pg) > 1e-12:
                now = min(max(a - g / norm[i], 0.0), cost[i])
                if now != a:
                    u[x] += (now - a) * sign * scale[i] * square[x]
                    bias += (now - a) * sign
                    alpha[i] = now
        if most - least <= tolerance or not stay:
            if len(active) == len(y):
                break
            active, high, low = everyone, np.inf, -np.inf
            continue
        active = np.array(stay)
        high, low = most if most > 0 else np.inf, least if least < 0 else -np.inf
    w = np.zeros(len(value) + 1)
    np.divide(u, value, out=w[:-1], where=value != 0)
    w[-1] = bias
    return w


def fit(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, bits: int = BITS, cost: float = 1.0, smooth: float = 1.0, least: int = 4, tolerance: float = TOLERANCE) -> np.ndarray:
    """One weight for each feature and, last, the bias, from samples whose features end at ``ends`` in ``flat``.

    y: +1 or -1; classes weigh alike.  With samples of one class only, the answer is that class always.  Features of
    fewer than ``least`` samples weigh nothing.  Memory is that of ``flat``, some of it twice.
    """
    width = 1 << bits
    out = np.zeros(width + 1)
    if not len(y) or (y > 0).all() or (y < 0).all():
        out[-1] = 1.0 if not len(y) or y[0] > 0 else -1.0
        return out
    pos, neg = scaling_counts(flat, ends, y, width)
    often = np.flatnonzero(pos + neg >= least)
    pos, neg = pos + smooth, neg + smooth
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    # the features that are left get numbers without gaps, so that what a round touches stays in the caches
    number = np.full(width, -1, np.int32)
    number[often] = np.arange(len(often), dtype=np.int32)
    starts = np.concatenate(([0], ends[:-1]))
    own = [x[x >= 0] for x in (number[flat[a:b]] for a, b in zip(starts, ends))]
    ends = np.cumsum([len(x) for x in own])
    flat = np.concatenate(own)
    del own
    scale = 1 / np.sqrt(np.maximum(1, np.diff(ends, prepend=0)))
    share = {c: len(y) / (2 * (y == c).sum()) for c in (1, -1)}
    w = dual_coordinate_descent(flat, ends, ratio[often], scale, y, np.array([cost * share[int(c)] for c in y]), tolerance)
    out[often], out[-1] = w[:-1] * ratio[often], w[-1]
    return out


@dataclass
class Model:
    quality: np.ndarray
    toxic: np.ndarray
    bits: int


def _extract(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "quality", "toxic")]
            for lo, hi, data, offs in tv.chunks(b.column("text")):
                row, f = features(data, offs, bits)
                ends = np.searchsorted(row, np.arange(hi - lo), "right")
                yield pa.RecordBatch.from_arrays([*(pa.array(c[lo:hi].astype(np.int64)) for c in cols), tv.binary(f.astype(np.uint32), ends * 4)], names=["doc_id", "quality", "toxic", "f"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """(doc_id, quality, toxic, f) of ``sample`` labelled documents, the first in the order of a hash of their ids; -1: no such label.

    Of contradicting labels of a document, low quality and toxic count.
    """
    lab = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    lab = lab.agg(F.coalesce(F.min("quality"), F.lit(-1)).cast("long").alias("quality"), F.coalesce(F.max("toxic"), F.lit(-1)).cast("long").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return texts(docs).join(F.broadcast(lab), "doc_id").mapInArrow(_extract(bits), "doc_id long, quality long, toxic long, f binary")


def _fit(bits: int, tolerance: float):
    schema = pa.schema([("head", pa.string()), ("w", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("doc_id").to_numpy(), b.column("quality").to_numpy(), b.column("toxic").to_numpy(), *tv.buffers(b.column("f")), b) for b in batches if b.num_rows]
        pieces = [np.frombuffer(data[a:z].tobytes(), np.uint32) for *_, data, offs, _ in got for a, z in zip(offs[:-1], offs[1:])]
        ids, quality, toxic = (np.concatenate([g[k] for g in got] or [np.zeros(0, np.int64)]) for k in range(3))
        del got
        # the order in which rows arrive must not matter
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], len(pieces[i]), pieces[i].tobytes())), np.int64)
        for name, label, good in (("quality", quality, 1), ("toxic", toxic, 0)):
            which = order[label[order] >= 0]
            flat = np.concatenate([pieces[i] for i in which] or [np.zeros(0, np.uint32)])
            ends = np.cumsum([len(pieces[i]) for i in which]).astype(np.int64)
            w = fit(flat, ends, np.where((label[which] > 0) == (good > 0), 1, -1), bits, tolerance=tolerance).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w.tobytes()], pa.binary())], schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, tolerance: float = TOLERANCE) -> Model:
    """Both models, fitted to a bounded sample of the labelled documents (``sample`` rows, a parameter).

    Features are taken from the texts in parallel; the fit is one task of an executor, which another one repeats if
    that executor is lost.  What comes to the driver are the two models, 4 bytes for each of 2^``bits`` features.
    """
    rows = labelled(docs, labels, sample, bits).repartition(1).mapInArrow(_fit(bits, tolerance), "head string, w binary").collect()
    empty = fit(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0), bits).astype(np.float32)
    heads = {r["head"]: np.frombuffer(bytes(r["w"]), np.float32) for r in rows}
    return Model(heads.get("quality", empty), heads.get("toxic", empty), bits)


def _judge(m: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality score, toxic score and whether to keep, of each row of a chunk."""
    n = len(offs) - 1
    row, f = features(data, offs, m.bits)
    size = np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    q, t = (np.round(np.bincount(row, weights=w[f], minlength=n) / size + w[-1], 5) for w in (m.quality, m.toxic))
    return q, -t, (q >= 0) & (t >= 0)


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("quality_score", pa.float64()), ("toxic_score", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            doc, rk = b.column("doc_id"), b.column("rk")
            for lo, hi, data, offs in tv.chunks(b.column("text")):
                q, t, keep = _judge(m, data, offs)
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), rk.slice(lo, hi - lo), pa.array(q), pa.array(t), pa.array(keep)], schema=schema)

    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rk, quality_score, toxic_score, keep) for each row with id and text; rk is xxhash64 of the text.

    A quality score below 0 or a toxic score above 0 rejects.  Texts without any n-gram have the models' bias as score.
    Repeated rows are scored each; rows without id or text are not returned; other columns play no part.
    """
    d = texts(docs, text, doc_id).withColumn("rk", F.xxhash64("text"))
    return d.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, rk long, quality_score double, toxic_score double, keep boolean")


def _pick(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, ids = b.column("text").cast(pa.string()), b.column("doc_id")
            judged = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(b.num_rows, bool)
            own = text.take(pa.array(judged))
            keep[judged] = np.concatenate([_judge(model.value, data, offs)[2] for _, _, data, offs in tv.chunks(own)] or [keep[:0]])
            yield b.filter(pa.array(keep))

    return run


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, all columns of them, that the classifier trained on ``labels`` doesn't reject; those without id or text stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    return docs.mapInArrow(_pick(model), docs.schema)
