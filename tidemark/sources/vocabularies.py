"""Readers of three public medical vocabularies, and the dictionary made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.medical import drug_name, merge, typed

CONDITION, MEDICATION = "phi::medical_condition", "phi::medication_name"
#: kinds of names in the drug vocabulary that are names of drugs: ingredients, brands and what is made of them
KINDS = ("IN", "PIN", "MIN", "BN", "SCD", "SBD", "SCDC", "SY", "PSN", "TMSY")
SHAPE = ("term", "entity_id", "canonical", "code", "source")


def _csv(spark: SparkSession, path: str, names: list[str], header: bool) -> DataFrame:
    d = spark.read.csv(path, header=False, inferSchema=False, multiLine=True, escape='"', schema=", ".join(f"`{n}` string" for n in names), mode="PERMISSIVE", enforceSchema=True)
    return d.where(F.coalesce(F.lower(names[0]) != "class id", F.lit(True)) & F.coalesce(F.lower(names[0]) != "id", F.lit(True))) if header else d


def diseases(spark: SparkSession, path: str, synonyms: bool = False) -> DataFrame:
    """Disease labels, or their synonyms, from a CSV of id, label, synonyms parted by bars, and whether obsolete as fifth column; a header comes first."""
    d = _csv(spark, path, ["id", "label", "synonyms", "_4", "obsolete"], True)
    d = d.where(F.trim(F.coalesce("label", F.lit(""))) != "").where(F.coalesce(F.upper(F.trim("obsolete")) != "TRUE", F.lit(True)))
    label = F.trim("label")
    term = F.explode(F.transform(F.split("synonyms", "[|]"), F.trim)) if synonyms else label
    return d.select(term.alias("term"), F.lit(CONDITION).alias("entity_id"), label.alias("canonical"), F.trim("id").alias("code"), F.lit("mondo").alias("source")).where("term <> ''")


def drugs(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Drug names from lines of at least 15 fields parted by bars: concept first, kind of name thirteenth, name fifteenth."""
    d = spark.read.text(path).select(F.split("value", "[|]").alias("f")).where(F.size("f") >= 15)
    d = d.where(F.get("f", F.lit(12)).isin(*kinds)).select(drug_name(F.trim(F.get("f", F.lit(14)))).alias("term"), F.trim(F.get("f", F.lit(0))).alias("code"))
    return d.where("term <> ''").select("term", F.lit(MEDICATION).alias("entity_id"), F.col("term").alias("canonical"), "code", F.lit("rxnorm").alias("source"))


def lay_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, canonical, code) from a CSV of concept, lay term, anything, and preferred name."""
    d = _csv(spark, path, ["cui", "term", "_3", "preferred"], False)
    return d.select(F.trim("term").alias("term"), F.trim("preferred").alias("canonical"), F.trim("cui").alias("code")).where("term <> '' and canonical <> ''")


def dictionary(spark: SparkSession, mondo: str, rxnorm: str, chv: str | None = None) -> DataFrame:
    """(surface, entity_id, canonical, code, source): disease labels come first, then drugs, then synonyms; lay terms take the type of their preferred name."""
    sources = [diseases(spark, mondo), drugs(spark, rxnorm), diseases(spark, mondo, synonyms=True)]
    terms = merge([s.select(*SHAPE) for s in sources])
    return merge([*[s.select(*SHAPE) for s in sources], typed(lay_terms(spark, chv), terms).select(*SHAPE)]) if chv else terms
