"""Pattern scan, confidence, dedupe, dictionary scan: from texts to spans.

Texts come as (source_id, row, col, text); a document has null row and col.  Offsets are half-open code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import compress
from operator import and_
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.needed import sieve
from tidemark.functions.validators import VALIDATORS, passes
from tidemark.plans.rules import DEFAULT_WEIGHT, Rule, rule_table

CELL = ["source_id", "row", "col"]


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null, as a document's row and col are; the right side's keys go."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how).drop(*[f"_{k}" for k in keys])


def documents(df: DataFrame, text: str = "text", source_id: str = "doc_id") -> DataFrame:
    """Any table of texts in the shape that the operators take; null texts go."""
    return df.select(F.col(source_id).cast("string").alias("source_id"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("col"), F.col(text).cast("string").alias("text")).where("text is not null")


def confidence(base: Column, valid: Column, weight: Column, primary: Column) -> Column:
    """From a pattern's weight and the outcome of its check; a failed check lowers it but doesn't drop the span."""
    ok = F.when(primary, F.coalesce(weight, F.greatest(base, F.lit(0.92)))).when(weight.isNotNull(), F.greatest(base, weight)).otherwise(F.greatest(base, F.least(base + 0.05, F.lit(1.0))))
    bad = F.when(weight.isNotNull(), F.least(F.lit(0.85), 0.28 * base + 0.32 * weight)).otherwise(F.least(F.lit(0.48), 0.55 * base))
    return F.when(valid.isNull(), base).when(valid, ok).otherwise(bad)


MATCHES = "ord int, base double, start int, end int, value string, before string, after string"


def _weight(r: Rule, k: int) -> float:
    own = r.weights[k] if r.weights else None
    return next(x for x in (own, r.weight, DEFAULT_WEIGHT) if x is not None)


def _tagged(ord_: int, base: float) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(ord_).alias("ord"), F.lit(base).cast("double").alias("base"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))


def _native(texts: DataFrame, rules: tuple[Rule, ...], reach: int) -> DataFrame:
    at = F.col("text")
    arrays = []
    for i, r in enumerate(rules):
        for k, p in enumerate(r.native):
            found = T.find_all(at, p)
            if r.anchor:
                found = F.when(at.rlike("(?U)" + r.anchor), found)
            arrays.append(F.transform(F.coalesce(found, F.array().cast(f"array<{T.SPAN}>")), _tagged(i, _weight(r, k))))
    rows = texts.select(*CELL, "text", F.explode(F.array_distinct(F.concat(*arrays))).alias("s"))
    before = F.substring("text", F.greatest(F.col("s.start") - reach + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(reach)))
    return rows.select(*CELL, "s.ord", "s.base", "s.start", "s.end", F.col("s.text").alias("value"), before.alias("before"), F.substring(F.col("text"), F.col("s.end") + 1, F.lit(reach)).alias("after"))


def _matcher(rules: tuple[Rule, ...], reach: int):
    plan: dict[str | None, list] = {}
    for i, r in enumerate(rules):
        for k, p in enumerate(r.patterns):
            plan.setdefault(r.anchor, []).append((i, _weight(r, k), p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal patterns of several rules run once
        groups = []
        for a, own in plan.items():
            users: dict[str, list] = {}
            for i, w, p in own:
                users.setdefault(p, []).append((i, w))
            groups.append((a and re.compile(a).search, [(re.compile(p).finditer, u) for p, u in users.items()], list(users)))
        asked = [p for _, _, own in groups for p in own]
        anchored = [a for a, own in zip(plan, groups) for _ in own[2]]
        pairs = [(g, own) for g, (_, all_, _) in enumerate(groups) for own in all_]
        may, may_anchor = sieve(asked), sieve([a or "" for a in anchored])
        schema = None
        for b in batches:
            schema = schema or pa.schema([*(b.schema.field(c) for c in CELL), ("ord", pa.int32()), ("base", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())])
            texts = b.column("text")
            for lo in range(0, b.num_rows, 256):
                at, found = [], []
                for row, text in enumerate(texts.slice(lo, 256).to_pylist(), lo):
                    seen = {}
                    left = compress(pairs, map(and_, may(text), may_anchor(text))) if text is not None else ()
                    known = {}
                    for g, (find, users) in left:
                        anchor = groups[g][0]
                        if g not in known:
                            known[g] = not anchor or anchor(text) is not None
                        if known[g]:
                            for m in find(text):
                                for i, w in users:
                                    seen.setdefault((i, w, *m.span()), m[0])
                    for (i, w, s, e), value in seen.items():
                        at.append(row)
                        found.append((i, w, s, e, value, text[max(0, s - reach) : s], text[e : e + reach]))
                if at:
                    where = pa.array(at)
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(where) for c in CELL), *(pa.array(x, schema.field(len(CELL) + k).type) for k, x in enumerate(cols))], schema=schema)

    return run


def scan(texts: DataFrame, rules: tuple[Rule, ...], reach: int = 80, native: bool = False) -> DataFrame:
    """All matches of all patterns, overlapping ones too, with the text around each.

    A cheap anchor skips texts that can't match.  ``native`` evaluates the patterns by built-in functions in one
    projection, else they are compiled and run over Arrow batches, on texts that hold what a match needs; both find the
    same.  A span that two patterns of a
    rule find with one weight comes once.  The spans meet the rule table by broadcast; what comes back has the
    validator's outcome and the confidence.
    """
    spark = texts.sparkSession
    n = sum(len(r.patterns) for r in rules)
    if not n:
        return _finish(texts.select(*CELL, F.lit(0).alias("ord"), F.lit(0.0).alias("base"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("text").alias("value"), F.lit("").alias("before"), F.lit("").alias("after")).where("false").withColumnRenamed("value", "text"), rules, spark)
    if native:
        found = _native(texts, rules, reach)
    else:
        cells = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (texts.schema[c] for c in CELL))
        found = texts.select(*CELL, "text").mapInArrow(_matcher(rules, reach), f"{cells}, {MATCHES}")
    return _finish(found.withColumnRenamed("value", "text"), rules, spark)


def _finish(spans: DataFrame, rules: tuple[Rule, ...], spark) -> DataFrame:
    used = sorted({r.validator for r in rules if r.validator}, key=list(VALIDATORS).index)
    dim = rule_table(spark, rules).select("ord", "entity_id", "entity", "ontology", "validator", "validator_weight", "primary", "not_after", "not_before", "not_like")
    d = spans.join(F.broadcast(dim), "ord")
    left = F.regexp_replace(F.lower(F.substring(F.col("before"), -50, 50)), r"(?U)\s+$", "")
    right = F.regexp_replace(F.lower(F.substring(F.col("after"), 1, 50)), r"(?U)^\s+", "")
    d = d.where(~F.exists("not_after", lambda p: F.endswith(left, p)) & ~F.exists("not_before", lambda p: F.startswith(right, p)) & F.coalesce(~F.regexp_like("text", F.col("not_like")), F.lit(True)))
    valid = passes(F.col("validator"), F.col("text"), used) if used else F.lit(None).cast("boolean")
    d = d.withColumn("valid", valid)
    return d.withColumn("confidence", confidence(F.col("base"), F.col("valid"), F.col("validator_weight"), F.col("primary"))).select(*CELL, "start", "end", "text", "entity_id", "entity", "ontology", "confidence", "valid", "before", "after", F.lit("regex").alias("stage"))


def dedupe(spans: DataFrame) -> DataFrame:
    """One entity for each span of a cell: of greatest confidence, then of greatest entity_id."""
    w = Window.partitionBy(*CELL, "start", "end").orderBy(F.desc("confidence"), F.desc("entity_id"), F.desc_nulls_last("valid"))
    return spans.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def ordered(spans: DataFrame) -> DataFrame:
    """Spans in reading order, the more confident of equal starts first."""
    return spans.orderBy(*CELL, "start", F.desc("confidence"), "end", "entity_id")


#: bits of the tables that tell which rows of words may be a surface or begin one
SLOTS = 1 << 24


def _marked(terms: DataFrame) -> tuple[bytes, bytes]:
    """Bit tables of the surfaces' first words, first two and so on, and of the whole surfaces, by CRC; their size doesn't depend on the dictionary's."""
    w = F.split("surface", " ")
    begun = F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.struct(F.lit(0).alias("kind"), F.array_join(F.slice(w, 1, n), " ").alias("s")))
    both = terms.where("surface is not null").select(F.explode(F.concat(begun, F.array(F.struct(F.lit(1).alias("kind"), F.col("surface").alias("s"))))).alias("x"))
    slot = F.pmod(F.crc32(F.encode("x.s", "UTF-8")), F.lit(SLOTS))
    marks = both.groupBy("x.kind", F.floor(slot / 8).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))).alias("bits")).toArrow()
    tables = bytearray(SLOTS // 8), bytearray(SLOTS // 8)
    for kind, byte, bits in zip(*(c.to_pylist() for c in marks.columns)):
        tables[kind][byte] = bits
    return bytes(tables[0]), bytes(tables[1])


def dictionary(texts: DataFrame, terms: DataFrame, most_words: int = 8, base: float = 0.6, reach: int = 80) -> DataFrame:
    """Leftmost-longest matches of a dictionary of surfaces, on whole ASCII words without case.

    terms: (surface, entity_id, canonical, code, source).  Word n-grams that may be a surface, by bit tables made of the
    dictionary, come from Arrow batches with the text around them and meet the dictionary itself in an equi-join, which
    Spark broadcasts while the dictionary is small and shuffles beyond; a fold over each text's few hits keeps those
    that don't overlap.
    """
    tables = texts.sparkSession.sparkContext.broadcast(_marked(terms))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile("[A-Za-z0-9]+").finditer
        begun, whole = tables.value
        row_id = TaskContext.get().partitionId() << 40
        for b in batches:
            text = b.column("text").to_pylist()
            for lo in range(0, b.num_rows, 64):
                at, found = [], []
                for row, t in enumerate(text[lo : lo + 64], lo):
                    row_id += 1
                    w = [(*m.span(), m[0].lower().encode()) for m in find(t or "")]
                    for i, (s, e, word) in enumerate(w):
                        crc = crc32(word)
                        n = i
                        while begun[(k := crc % SLOTS) >> 3] >> (k & 7) & 1:
                            if whole[k >> 3] >> (k & 7) & 1:
                                at.append(row)
                                found.append((row_id, b" ".join(x[2] for x in w[i : n + 1]).decode(), s, e, t[s:e], t[max(0, s - reach) : s], t[e : e + reach]))
                            n += 1
                            if n == len(w) or n - i == most_words:
                                break
                            _, e, word = w[n]
                            crc = crc32(word, crc32(b" ", crc))
                if at:
                    where, cols = pa.array(at), zip(*found)
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(where) for c in CELL), *(pa.array(x, t) for x, t in zip(cols, kinds))], names=[*CELL, "_row", "surface", "start", "end", "value", "before", "after"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (texts.schema[c] for c in CELL))
    hits = texts.select(*CELL, "text").mapInArrow(grams, f"{kinds}, _row long, surface string, start int, end int, value string, before string, after string").join(terms.dropDuplicates(["surface"]), "surface")
    hits = hits.groupBy(*CELL, "_row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("rev"), "end", "entity_id", "canonical", "code", "source", "value", "before", "after"))).alias("hits"))
    kept = F.aggregate("hits", F.slice("hits", 1, 0), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > x["start"]), acc).otherwise(F.array_append(acc, x)))
    d = hits.select(*CELL, F.explode(kept).alias("s"))
    return d.select(*CELL, "s.start", "s.end", F.col("s.value").alias("text"), "s.entity_id", F.split_part("s.entity_id", F.lit("::"), F.lit(2)).alias("entity"), F.split_part("s.entity_id", F.lit("::"), F.lit(1)).alias("ontology"), F.lit(base).alias("confidence"), F.lit(None).cast("boolean").alias("valid"), "s.before", "s.after", F.lit("dictionary").alias("stage"), "s.canonical", "s.code")


def deterministic(texts: DataFrame, rules: tuple[Rule, ...], terms: DataFrame | None = None, min_confidence: float = 0.0, custom=None) -> DataFrame:
    """Patterns and dictionary together, deduped within each cell.  ``custom`` (texts -> spans) replaces the pattern scan."""
    spans = custom(texts) if custom else scan(texts, rules)
    if terms is not None:
        spans = spans.unionByName(dictionary(texts, terms).drop("canonical", "code"))
    return dedupe(spans).where(F.col("confidence") >= min_confidence)
