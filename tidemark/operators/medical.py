"""Dictionaries of medical terms from public vocabularies: cleaning, first-wins merging, n-gram limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normal_term

STOP = ("disease", "syndrome", "disorder", "pain", "other", "normal", "water", "air", "food", "test", "patient")
FORMS = "tablet|capsule|solution|injection|cream|ointment|syrup|suspension|spray|patch|oral|topical|extended release|delayed release|chewable|film coated|gel|powder"


def drug_name(c: Column) -> Column:
    """A drug's name without its brand in brackets, volumes, doses and forms."""
    s = F.regexp_replace(F.lower(c), r"\[[^\]]*\]", " ")
    s = F.regexp_replace(s, r"\b\d+(\.\d+)?\s*(mg|mcg|g|ml|l|unt|meq|%|hr|actuat)(/[a-z0-9. ]+)?\b", " ")
    s = F.regexp_replace(s, rf"\b({FORMS})s?\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def merge(sources: list[DataFrame], stop: tuple[str, ...] = STOP, most_words: int = 8, least_chars: int = 4) -> DataFrame:
    """(surface, entity_id, canonical, code, source) of vocabularies with those columns and ``term`` for surface.

    Of equal surfaces the first vocabulary's counts, within it the least canonical form; surfaces that are stop words,
    short or of more than ``most_words`` words go.
    """
    out = None
    for i, s in enumerate(sources):
        d = s.select(normal_term(F.col("term")).alias("surface"), "entity_id", "canonical", "code", "source", F.lit(i).alias("_o"))
        out = d if out is None else out.unionByName(d)
    w = Window.partitionBy("surface").orderBy("_o", "canonical", "code")
    d = out.where(~F.col("surface").isin(*stop) & (F.length("surface") >= least_chars) & (F.size(F.split("surface", " ")) <= most_words))
    return d.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_o")


def typed(lay: DataFrame, terms: DataFrame) -> DataFrame:
    """Lay terms (term, canonical) with the entity of their canonical form; those without one go.  Their code is their own, where they have one, else that form's."""
    t = terms.select(F.col("surface").alias("_s"), "entity_id", F.col("code").alias("_code"), F.col("canonical").alias("to"))
    own = "code" in lay.columns
    d = lay.withColumn("_s", normal_term(F.col("canonical"))).join(t, "_s")
    return d.select("term", "entity_id", F.col("canonical" if own else "to").alias("canonical"), F.col("code" if own else "_code").alias("code"), F.lit("lay").alias("source"))


def codes(df: DataFrame, code: str, description: str, order: str) -> DataFrame:
    """Code to description, the last of equal codes by ``order``."""
    return df.groupBy(F.col(code).alias("code")).agg(F.max_by(description, order).alias("description"))


def names(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(column).alias("name")).where("name <> ''").distinct()
