"""String columns: normalisation, predicates on cells, matches with offsets, span folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
NULL_WORDS = tuple("n/a na n.a. none null nil - — tbd unknown".split())
BLOCK = 128
MASK_RUN = r"^(\*{2,}.*|X{3,}.*|[•#●]{2,}.*)$"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cell(c: Column) -> Column:
    """A cell as the scanner sees it: a stripped string, null when blank."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*NULL_WORDS) | F.trim(c).rlike(MASK_RUN)


def is_compact(c: Column, most: int = 4) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))) <= most


def is_prose(c: Column) -> Column:
    return c.rlike("[A-Za-z]{2,}")


def normal_term(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def shape(c: Column) -> Column:
    """Digits as D, letters as A, all else as it is."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}", "A"), r"\p{N}", "D")


def find_all(text: Column, pattern: str, group: Column | None = None) -> Column:
    """All matches of a pattern that matches no empty string, with half-open offsets in code points.

    The pieces between matches and the matches themselves alternate, so running lengths give the offsets; no Python
    is involved.  They are summed in blocks, as a list that grows by one match at a time would be copied for each.  A
    null text gives null.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        end = start + F.length(x["text"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text")))).alias("out"))

    def block(acc: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(pairs, i, BLOCK), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(own["at"].alias("at"), F.array_append(acc["out"], own["out"]).alias("out"))

    pairs = F.zip_with(found, F.slice(parts, 1, F.size(found)), lambda t, n: F.struct(t.alias("text"), n.alias("skip")))
    folded = F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), block, lambda acc: F.flatten(acc["out"]))
    return F.when(text.isNull(), None).when(F.size(found) == 0, none).otherwise(folded)


def elect(spans: Column) -> Column:
    """The spans that stay, of an array of structs that begins with the fields to order by, greatest first, and has start and end."""
    best = F.reverse(F.array_sort(spans))
    return F.aggregate(best, F.slice(spans, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), acc).otherwise(F.array_append(acc, x)))


def splice(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, text, new) replaced, from the right to the left.

    Raises on overlapping spans, on spans that leave the text and on spans whose text is no longer there: a bad join
    must never let a value through.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["new"].alias("new"))))
    apart = F.forall(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (F.element_at(ordered, F.greatest(i - 1, F.lit(1)))["end"] <= F.element_at(ordered, i)["start"]))
    stale = F.exists(ordered, lambda s: ~F.substring(text, s["start"] + 1, s["end"] - s["start"]).eqNullSafe(s["text"]) | (s["start"] < 0))
    done = F.aggregate(F.reverse(ordered), text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), s["new"], F.substring(acc, s["end"] + 1, F.length(acc))))
    return (
        F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text)
        .when(~apart, F.raise_error(F.lit("spans overlap")).cast("string"))
        .when(stale, F.raise_error(F.lit("a span doesn't match its source")).cast("string"))
        .otherwise(done)
    )
