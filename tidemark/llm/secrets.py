"""Secret scans by character Markov models.

Two first-order models of characters, one of random strings and one of ordinary identifiers, are trained from labelled
samples: random strings are generated, in the alphabets that keys and tokens use, and ordinary ones are all words of
letters in the corpus, together with compounds as programs name things.  A candidate is a long run of the characters
that keys are made of; the log-likelihood ratio of the two models, over the stretch of the run where it is greatest,
decides.  So a path or a name that is glued to a key doesn't hide it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import texts

LEAST, ODDS = 16, 12.0
_in = np.zeros(256, bool)
_in[[*b"+/=_-"]] = True
_in |= tv._is_word
_key = _in & (np.arange(256) < 128)
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_letter[128:] = True
_CODE = np.where(np.arange(256) < 128, np.arange(256), 127)  # all that isn't ASCII is one character
_EDGE = 0
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
_NAMES = ("get set put user name id key value list item index count page size max min time date start end node edge file path read write open close config default test data table row column client server request response handler manager error message status code type class object array string number int float "
          "input output load save update delete create build parse format encode decode cache session token access api http url host port json xml html base util common core model view controller service event queue worker thread lock pool stream buffer").split()  # fmt: skip


def random_strings(n: int, seed: int) -> list[str]:
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for k in range(n):
        alphabet = _ALPHABETS[k % len(_ALPHABETS)]
        out.append("".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(16, 65)))))
    return out


def identifiers(n: int, seed: int) -> list[str]:
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for k in range(n):
        parts = [_NAMES[i] for i in rng.integers(0, len(_NAMES), int(rng.integers(2, 6)))]
        style = k % 5
        s = "_".join(parts) if style == 0 else "-".join(parts) if style == 1 else parts[0] + "".join(p.title() for p in parts[1:]) if style == 2 else "_".join(parts).upper() if style == 3 else "/".join(parts)
        out.append(s + (str(int(rng.integers(0, 1000))) if k % 3 == 0 else ""))
    return out


def transitions(strings: list[str]) -> np.ndarray:
    out = np.zeros((128, 128))
    for s in strings:
        c = np.concatenate(([_EDGE], _CODE[np.frombuffer(s.encode(), np.uint8)]))
        np.add.at(out, (c[:-1], c[1:]), 1)
    return out


def model(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log probabilities of the next character."""
    usable = np.zeros(128, bool)
    usable[_CODE[np.flatnonzero(_in)]] = True
    c = np.where(usable, counts + smooth, 1e-9)
    return np.log(c / c.sum(axis=1, keepdims=True))


def _runs(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    cls = kind[data]
    edge = np.empty(n + 1, bool)
    edge[1:n] = cls[1:] != cls[:-1]
    edge[0] = edge[n] = True
    edge[offs[(offs > 0) & (offs < n)]] = True
    at = np.flatnonzero(edge)
    keep = cls[at[:-1]] if n else np.zeros(0, bool)
    return at[:-1][keep], at[1:][keep]


def _ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(128 * 128, np.int64)
    for b in batches:
        for _, _, data, offs in tv.chunks(b.column("text")):
            start, end = _runs(data, offs, _in)
            odd = np.concatenate(([0], np.cumsum(~_letter[data])))
            word = (odd[end] == odd[start]) & (end - start >= 4)
            c = _CODE[data]
            pair = np.zeros(len(data), np.int64)
            pair[1:] = c[:-1] * 128 + c[1:]
            pair[start] = _EDGE * 128 + c[start]
            mark = np.zeros(len(data) + 1, np.int8)
            mark[start[word]] += 1
            np.add.at(mark, end[word], -1)
            out += np.bincount(pair[np.cumsum(mark[:-1], dtype=np.int8) > 0], minlength=128 * 128)
    at = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["pair", "n"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros((2, 128, 128), np.int64)
    for b in batches:
        for text, secret in zip(b.column("text").to_pylist(), b.column("secret").to_pylist()):
            out[int(secret)] += transitions([text]).astype(np.int64)
    label, pair = np.nonzero(out.reshape(2, -1))
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(out.reshape(2, -1)[label, pair])], names=["label", "pair", "n"])


def sample_counts(samples: DataFrame) -> np.ndarray:
    """Transitions of ordinary and of secret strings, from labelled samples (text, secret); rows that lack either are left out."""
    out = np.zeros((2, 128 * 128))
    d = samples.select(F.col("text").cast("string"), F.col("secret").cast("boolean")).where("text is not null and text <> '' and secret is not null")
    for label, pair, n in d.mapInArrow(_labelled, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n")).collect():
        out[label, pair] = n
    return out.reshape(2, 128, 128)


def train(docs: DataFrame, samples: DataFrame | int = 6000, seed: int = 11) -> np.ndarray:
    """The ratio of the two models' log probabilities, by character and next one.

    ``samples``: labelled strings (text, secret), or how many of each kind to generate, which is for want of any.  A
    kind of which there are no samples is generated too.  The words of all documents are ordinary strings besides, and
    weigh as much as those labelled so; what reaches the driver are matrices of fixed size.
    """
    own = np.zeros(128 * 128)
    for pair, n in docs.select("text").mapInArrow(_ordinary, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():
        own[pair] = n
    n_made = 6000 if isinstance(samples, DataFrame) else samples
    plain, secret = sample_counts(samples) if isinstance(samples, DataFrame) else (np.zeros((128, 128)),) * 2
    made = plain if plain.any() else transitions(identifiers(n_made, seed))
    secret = secret if secret.any() else transitions(random_strings(n_made, seed))
    ordinary = made / made.sum() + own.reshape(128, 128) / max(1.0, own.sum())
    return model(secret) - model(ordinary * made.sum())


def ratio(tokens: list[str], llr: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each string."""
    out = np.zeros(len(tokens))
    for k, s in enumerate(tokens):
        c = np.concatenate(([_EDGE], _CODE[np.frombuffer(s.encode(), np.uint8)]))
        out[k] = llr[c[:-1], c[1:]].sum()
    return out


def stretches(c: np.ndarray, llr: np.ndarray, least: int, odds: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of the best stretch of at least ``least`` codes, and so on left and right of it, while above ``odds``."""
    out, todo = [], [(0, len(c))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        sums = np.concatenate(([0.0], np.cumsum(llr[c[lo : hi - 1], c[lo + 1 : hi]])))
        begin = llr[_EDGE, c[lo:hi]] - sums
        top = np.maximum.accumulate(begin[: hi - lo - least + 1])
        score = sums[least - 1 :] + top
        k = int(score.argmax())
        if score[k] > odds:
            i, j = lo + int(begin[: k + 1].argmax()), lo + k + least
            out.append((i, j, float(score[k])))
            todo += [(lo, i), (j, hi)]
    return sorted(out)


def _find(llr, least: int, odds: float):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("token", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = llr.value
        for b in batches:
            doc = b.column("doc_id").to_numpy()
            for lo, hi, data, offs in tv.chunks(b.column("text")):
                start, end = _runs(data, offs, _key)
                long = end - start >= least
                start, end = start[long], end[long]
                if not len(start):
                    continue
                n = end - start
                c = _CODE[data[at := tv.expand(start, n)]]
                first = np.cumsum(n) - n
                # no stretch of a run scores more than its best beginning and all that speaks for a key
                gain = np.maximum(m[np.concatenate(([_EDGE], c[:-1])), c], 0)
                gain[first] = 0
                able = np.maximum.reduceat(m[_EDGE, c], first) + np.add.reduceat(gain, first) > odds
                found = [(start[r] + i, start[r] + j, x) for r in np.flatnonzero(able) for i, j, x in stretches(c[first[r] : first[r] + n[r]], m, least, odds)]
                found = [x for x in found if _letter[data[x[0] : x[1]]].any()]
                if found:
                    start, end = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
                    row = np.searchsorted(offs, start, "right") - 1
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    a, z = chars[start] - chars[offs[row]], chars[end] - chars[offs[row]]
                    token = [data[x:y].tobytes().decode() for x, y in zip(start, end)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][row]), pa.array(a), pa.array(z), pa.array(token, pa.string()), pa.array([round(x[2], 4) for x in found])], schema=schema)

    return run


def find_secrets(docs: DataFrame, least: int = LEAST, odds: float = ODDS, text: str = "text", doc_id: str = "doc_id", llr: np.ndarray | None = None, samples: DataFrame | int = 6000) -> DataFrame:
    """(doc_id, start, end, token, score) of the random strings; offsets count characters, half open.

    A candidate is a run of at least ``least`` ASCII letters, digits and ``+/=_-``.  Its stretch of at
    least ``least`` characters with the greatest log-likelihood ratio is reported if that is above ``odds`` and a letter
    is in it; what is left on either side is a candidate again.  Numbers are no candidates; characters outside ASCII end a run.
    Rows without id or text give nothing; repeated rows are reported each; other columns play no part.  ``samples``: what
    the models are trained from, see :func:`train`; ``llr``: trained ones.
    """
    d = texts(docs, text, doc_id)
    llr = train(d, samples) if llr is None else llr
    return d.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(llr), least, odds), "doc_id long, start long, end long, token string, score double")
