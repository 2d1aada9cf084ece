"""SimHash near-dedup by the generalised pigeonhole principle.

A document's signature has 64 bits to search by and 64 more to verify with: signs of the weighted sums of the hash
bits of its distinct words, longer words weighing more.  The search bits are split into parts of correlated bits; each
part gets a threshold of its own, -1 for none, such that the thresholds and the parts' number less one add up to the
allowed distance: two signatures within it must be within the threshold in some part (Qin et al., GPH, 2018).  The
thresholds come from a dynamic programme over the parts' candidate counts, which the counts of all signatures' part
values give exactly: a Walsh-Hadamard transform turns them into pairs by distance.  Pairs meet half-way: within t
bits they share a value that is t/2 bits from both.  Candidates are verified by all 128 bits and by size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import packed, saved, texts
from .components import components

DISTANCE, CHECK, RATIO, PARTS, BLOCK = 10, 22, 1.25, 4, 100_000
#: width of a size band; a document whose like may lie in the next one is probed in both
_BAND = math.log(2.5)
_SECOND = np.uint64(0x2545F4914F6CDD1D)


def _signs(h: np.ndarray, weight: np.ndarray, first: np.ndarray, total: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits * weight[:, None], first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("size", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())])
    for b in batches:
        doc, rk = b.column("doc_id").to_numpy(), b.column("rk").to_numpy()
        for lo, hi, data, offs in tv.chunks(b.column("text")):
            w = tv.words(data, offs)
            if not len(w.row):
                continue
            order = np.lexsort((w.hash, w.row))
            row, h = w.row[order], w.hash[order]
            own = tv.runs(row, h)[:-1]
            row, h = row[own], h[own]
            weight = np.clip((w.end - w.start)[order][own] - 2, 1, 8).astype(np.uint8)
            first = tv.runs(row)[:-1]
            total = np.add.reduceat(weight.astype(np.int32), first)
            at = row[first]
            s1, s2 = _signs(h, weight, first, total), _signs(tv.mix(h ^ _SECOND), weight, first, total)
            size = np.diff(np.concatenate((first, [len(row)])))
            yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][at]), pa.array(rk[lo:hi][at]), pa.array(size.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], schema=schema)


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rk, size, s1, s2) of the documents that have words; size is the number of distinct ones, rk xxhash64 of the text."""
    d = texts(docs, text, doc_id).withColumn("rk", F.xxhash64("text"))
    return d.mapInArrow(_signatures, "doc_id long, rk long, size int, s1 long, s2 long")


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Split the 64 bits into equal parts of bits that correlate.  together: how often both bits are set, of n signatures."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    c = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(c, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        want = len(left) // (parts - k)
        seed = max(left, key=lambda i: (max((c[i, j] for j in left if j != i), default=0), -i))
        part = [seed]
        left.discard(seed)
        while len(part) < want:
            best = max(left, key=lambda i: (c[i, part].sum(), -i))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def part_values(s: np.ndarray, part: list[int]) -> np.ndarray:
    v = np.zeros(len(s), np.uint64)
    for k, bit in enumerate(part):
        v |= ((s >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return v.astype(np.int64)


def pairs_within(counts: np.ndarray, bits: int) -> np.ndarray:
    """Ordered pairs of values by Hamming distance at most 0, 1, ... bits."""
    h = counts.astype(np.float64)
    for _ in range(2):
        step = 1
        while step < len(h):
            h = h.reshape(-1, 2, step)
            h = np.stack((h[:, 0] + h[:, 1], h[:, 0] - h[:, 1]), axis=1).reshape(-1)
            step *= 2
        h = h * h if _ == 0 else h / len(h)
    return np.cumsum(np.bincount(np.bitwise_count(np.arange(len(h), dtype=np.uint64)), weights=h, minlength=bits + 1))


def ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(radius + 1))


def allocate(pairs: list[np.ndarray], widths: list[int], n: int, distance: int, row_cost: float = 50.0) -> list[int]:
    """Thresholds of least cost that add up to distance - parts + 1; a row to shuffle costs as much as ``row_cost`` pairs."""
    need = max(distance - len(pairs) + 1, -len(pairs))
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for p, width in zip(pairs, widths):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, ts) in best.items():
            for t in range(-1, min(width, distance) + 1):
                more = 0.0 if t < 0 else row_cost * n * (ball(width, t // 2) if t % 2 == 0 else ball(width, t // 2) + ball(width, t // 2 + 1)) + p[t] * ball(t, t // 2)
                if have + t not in nxt or cost + more < nxt[have + t][0]:
                    nxt[have + t] = (cost + more, [*ts, t])
        best = nxt
    return best[need][1]


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def _roles(t: int) -> list[tuple[int, int]]:
    """(role, radius) of the probes for a threshold: all alike, or two kinds that meet each other."""
    return [] if t < 0 else [(0, t // 2)] if t % 2 == 0 else [(1, t // 2), (2, t // 2 + 1)]


def blocks(counts: list[np.ndarray], widths: list[int], thresholds: list[int], block_rows: int) -> dict[int, np.ndarray]:
    """By part, into how many blocks the probes of each value are split, from how many signatures have the values around it.

    Parts without a hot value are left out.
    """
    out = {}
    for i, (c, width, t) in enumerate(zip(counts, widths, thresholds)):
        here = np.arange(1 << width)
        probes = sum((c[here ^ m] for _, r in _roles(t) for m in _masks(width, r)), np.zeros(1 << width))
        if (n := np.ceil(probes / block_rows).astype(np.int32)).max(initial=0) > 1:
            out[i] = np.maximum(n, 1)
    return out


def _probes(parts: list[list[int]], thresholds: list[int], ratio: float, split: dict[int, np.ndarray]):
    """A probe is one number k, its group, role and size, and the signature; those of a hot value go to every pair of blocks that their own is in.

    Groups have 32 bits: whether two roles meet, and the part, band and value, or a hash of them and of the blocks; two
    that fall together only cost comparisons.
    """
    schema = pa.schema([("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
    plan = [(i, part, role, _masks(len(part), r)) for i, (part, t) in enumerate(zip(parts, thresholds)) for role, r in _roles(t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                size, s1, s2 = (piece.column(c).to_numpy() for c in ("size", "s1", "s2"))
                at = np.log(size.astype(np.float64))
                lo, hi = (np.floor((at + x * math.log(ratio) / 2) / _BAND).astype(np.int64) + 1 for x in (-1.000001, 1.000001))
                who, band = np.repeat(np.arange(len(size)), hi - lo + 1), tv.expand(lo, hi - lo + 1)
                own = node_of(s1, s2, size).view(np.uint64)
                for i, part, role, masks in plan:
                    v = part_values(s1.view(np.uint64), part)[who][:, None] ^ masks
                    g = ((np.int64(i) << 6 | band)[:, None] << 16 | v).reshape(-1)
                    rep = np.repeat(who, len(masks))
                    if i in split:
                        n = split[i][v.reshape(-1)].astype(np.int64)
                        hot = np.flatnonzero(n > 1)
                        times = n[hot] - 1
                        mine = np.repeat((own[rep[hot]] % n[hot].astype(np.uint64)).astype(np.int64), times)
                        other = tv.expand(np.zeros(len(hot), np.int64), times)
                        other += other >= mine
                        pair = np.minimum(mine, other) * np.repeat(n[hot], times) + np.maximum(mine, other)
                        cold = np.flatnonzero(n == 1)
                        g = np.concatenate((g[cold], (tv.mix((pair << 28 ^ np.repeat(g[hot], times)).view(np.uint64)) >> np.uint64(33)).view(np.int64)))
                        rep = np.concatenate((rep[cold], np.repeat(rep[hot], times)))
                    k = (int(role > 0) << 31 | g) << 31 | role << 29 | size[rep].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(s1[rep]), pa.array(s2[rep])], schema=schema)

    return run


def node_of(s1: np.ndarray, s2: np.ndarray, size: np.ndarray) -> np.ndarray:
    return tv.mix(tv.mix(s1.view(np.uint64)) + s2.view(np.uint64) * np.uint64(3) + size.astype(np.uint64)).view(np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Component of each of n nodes, named by its least node; ``root``: what is known of them, which is changed."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root[:] = nxt
    return root


def _close(s1, s2, size, i, j, distance: int, check: int, ratio: float) -> np.ndarray:
    d1 = np.bitwise_count(s1[i] ^ s1[j])
    near = d1 <= distance
    near &= d1 + np.bitwise_count(s2[i] ^ s2[j]) <= check
    x, y = size[i], size[j]
    return near & (np.maximum(x, y) <= ratio * np.minimum(x, y))


def _links(distance: int, check: int, ratio: float, rows: int, large: int = 512, at_once: int = 2_000_000):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def reach(a: np.ndarray, b: np.ndarray, close) -> tuple[np.ndarray, np.ndarray]:
        """Links that hold the components of a large group together, found by going from each member to those of the other side that nothing has reached yet; a is b if all meet all."""
        ea, eb, free = [], [], [a, a if a is b else b]
        while len(free[0]):
            front, free[0] = [(int(free[0][0]), 0)], free[0][1:]
            if a is b:
                free[1] = free[0]
            while front:
                x, side = front.pop()
                there = free[1 - side]
                near = close(np.full(len(there), x), there)
                ea.append(np.full(int(near.sum()), x))
                eb.append(there[near])
                front.extend((y, 1 - side) for y in there[near].tolist())
                free[1 - side] = there[~near]
                if a is b:
                    free[side] = free[1 - side]
        none = a[:0]
        return np.concatenate(ea or [none]), np.concatenate(eb or [none])

    def one(t: pa.Table) -> pa.RecordBatch | None:
        k = t.column("k").to_numpy()
        g, rs = k >> 31, k & ((1 << 31) - 1)
        s1, s2 = (t.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
        size, role = rs & ((1 << 29) - 1), rs >> 29
        close = lambda i, j: _close(s1, s2, size, i, j, distance, check, ratio)
        name, which = np.unique(node_of(s1, s2, size), return_inverse=True)
        root = np.arange(len(name))
        first = tv.runs(g)
        sizes = np.diff(first)
        end = np.repeat(first[1:], sizes)
        here = np.arange(len(g))
        # of a group whose halves differ, those of role 1 meet those of role 2; else all meet all
        split = np.repeat(np.add.reduceat(role == 1, first[:-1]), sizes) + np.repeat(first[:-1], sizes)
        lo = np.where(role == 0, here + 1, np.where(role == 1, split, end))
        n = end - lo
        n[np.repeat(sizes > large, sizes)] = 0
        ends = np.cumsum(n)
        done = 0
        while done < len(n):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + at_once, "right")))
            i = np.repeat(here[done:upto], n[done:upto])
            j = tv.expand(lo[done:upto], n[done:upto])
            ok = close(i, j)
            local_roots(len(name), which[i[ok]], which[j[ok]], root)
            done = upto
        for big in np.flatnonzero(sizes > large):
            members = here[first[big] : first[big + 1]]
            sides = (members, members) if role[members[0]] == 0 else (members[role[members] == 1], members[role[members] == 2])
            i, j = reach(*sides, close)
            local_roots(len(name), which[i], which[j], root)
        root = local_roots(len(name), which[:0], which[:0], root)
        on = np.flatnonzero(root != np.arange(len(name)))
        if not len(on):
            return None
        return pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(name[root[on]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tv.whole_groups(batches, "k", rows, 31):
            if (out := one(t)) is not None:
                yield out

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((64, 64))
    for b in batches:
        for i in range(0, b.num_rows, 20_000):
            s = np.ascontiguousarray(b.column("s1").to_numpy()[i : i + 20_000])
            bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            sums += bits.T @ bits
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j].astype(np.int64))], names=["i", "j", "n"])


def _values(parts: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << len(p), np.int64) for p in parts]
        for b in batches:
            s = b.column("s1").to_numpy().view(np.uint64)
            for k, p in enumerate(parts):
                sums[k] += np.bincount(part_values(s, p), minlength=len(sums[k]))
        for k, x in enumerate(sums):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["part", "value", "n"])

    return run


def plan(own: DataFrame, distance: int = DISTANCE, parts: int = PARTS, block_rows: int = BLOCK) -> tuple[list[list[int]], list[int], dict[int, np.ndarray]]:
    """The parts' bits, their thresholds and their hot values' blocks for a table of distinct signatures; what comes to the driver has a fixed size."""
    n = own.count()
    together = np.zeros((64, 64))
    for i, j, x in own.select("s1").mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        together[i, j] = together[j, i] = x
    bits = correlated_parts(together, n, parts)
    counts = [np.zeros(1 << len(p)) for p in bits]
    for k, v, x in own.select("s1").mapInArrow(_values(bits), "part int, value int, n long").groupBy("part", "value").agg(F.sum("n")).toLocalIterator():
        counts[k][v] = x
    widths = [len(p) for p in bits]
    thresholds = allocate([pairs_within(c, len(p)) for c, p in zip(counts, bits)], widths, n, distance)
    return bits, thresholds, blocks(counts, widths, thresholds, block_rows)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, check: int = CHECK, ratio: float = RATIO, parts: int = PARTS, text: str = "text", doc_id: str = "doc_id", block_rows: int = BLOCK) -> DataFrame:
    """Groups of near-duplicate documents: (doc_id, rk, group_id, kept, copies), for documents in groups of two and more.

    Two documents are near duplicates if their signatures differ in at most ``distance`` of the 64 search bits and
    ``check`` of all 128, and the larger has at most ``ratio`` times the distinct words of the smaller.  Groups are the
    connected components; group_id is the least doc_id in the group, whose row is the one to keep (of rows with that
    id, the one whose text hash rk is least).  ``copies`` is the number of rows that share both id and text; such rows
    are duplicates of one another and come as one row here.  Documents without id, text or any word are in no group.
    Probes that share more than ``block_rows`` others' key are dealt out in blocks, and every pair of blocks meets in a
    task of its own: no key fills a task, and no pair is lost.
    """
    if not (4 <= parts <= 63 and 0 <= distance <= 64 and ratio >= 1):
        raise ValueError("parts must be 4 to 63, distance 0 to 64 and ratio 1 or more")
    sig = saved(signatures(docs, text, doc_id).groupBy("doc_id", "rk", "size", "s1", "s2").agg(F.count(F.lit(1)).alias("copies")))
    own = saved(sig.select("s1", "s2", "size").distinct())
    bits, thresholds, split = plan(own, distance, parts, block_rows)
    probes = own.mapInArrow(_probes(bits, thresholds, ratio, split), "k long, s1 long, s2 long")
    links = probes.repartition(F.expr("shiftright(k, 31)")).sortWithinPartitions("k").mapInArrow(_links(distance, check, ratio, 200_000), "a long, b long")
    roots = components(links)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s1, s2, size = (b.column(c).to_numpy() for c in ("s1", "s2", "size"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), b.column("copies"), pa.array(node_of(s1, s2, size))], names=["doc_id", "rk", "copies", "node"])

    nodes = sig.mapInArrow(name, "doc_id long, rk long, copies long, node long")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min(F.struct("doc_id", "rk")).alias("head"), F.sum("copies").alias("n")).where("n > 1")
    return named.join(heads, "root").select("doc_id", "rk", F.col("head.doc_id").alias("group_id"), (F.struct("doc_id", "rk") == F.col("head")).alias("kept"), "copies")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without near duplicates: of each group the row to keep stays, all else that is in no group too."""
    found = near_duplicates(docs, **options).select(F.col("doc_id").alias("id"), "rk", "kept", "copies")
    marked = packed(docs).join(found, ["id", "rk"], "left")
    stay = marked.where("kept is null or (kept and copies = 1)").select("row.*")
    return stay.unionByName(marked.where("kept and copies > 1").dropDuplicates(["id", "rk"]).select("row.*"))
