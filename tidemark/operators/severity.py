"""How severe findings are, what their records add to that, and what a dataset's findings come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.generalize import precision
from tidemark.functions.local import small
from tidemark.plans.rules import Rule, rule_table

BASES = {"direct_identifier": 0.90, "genetic_data": 0.90, "biometric_identifier": 0.90, "financial_data": 0.85, "sensitive_attribute": 0.80, "device_identifier": 0.60, "quasi_identifier": 0.55, "neutral": 0.30}
LEVELS = ("info", "low", "medium", "high", "critical")
STRONG = ("direct_identifier", "genetic_data", "biometric_identifier", "financial_data")
BOOSTABLE = (*STRONG, "sensitive_attribute", "device_identifier", "quasi_identifier")
CARDS = ("fin::credit_card_number", "fin::cvv_code", "fin::card_expiry_date")
SAFE_HARBOR = {
    "names": ("person_names", "physician_names"), "geographic": ("street_address", "city", "county", "state", "zip_code", "po_box", "latitude_coordinates", "longitude_coordinates"),
    "dates": ("dates", "age", "date_of_birth", "date_of_death", "timestamps"), "telephone": ("phone_number",), "fax": ("fax_number",), "email": ("email_address",), "ssn": ("ssn", "canadian_social_insurance_number_sin", "us_itin", "uk_national_insurance_number_nino", "indian_aadhaar_number"),
    "medical_record": ("medical_record_number_mrn", "uk_nhs_number"), "health_plan": ("health_plan_beneficiary_number", "claim_control_number", "authorization_precertification_code"), "account": ("account_reference_number", "bank_account_number", "iban", "routing_number_aba", "credit_card_number", "swift_bic"),
    "license": ("drivers_license_number", "certificate_license_number", "provider_npi", "provider_tax_id_ein"), "vehicle": ("vehicle_identification_number_vin",), "device": ("device_serial_number", "imei_number", "mac_address"), "url": ("web_url",), "ip": ("ip_address",),
    "biometric": ("fingerprints", "retinal_scans", "voiceprints"), "photograph": ("facial_photographs",), "other": ("unique_identifier", "uuid_guid", "passport_number", "us_passport_number", "us_ein", "dna_sequences", "genomic_variants"),
}


def _pick(c: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def level(score: Column, corpus: bool = False) -> Column:
    out = F.when(score >= 0.65, "high").when(score >= 0.40, "medium").when(score >= 0.20, "low").otherwise("info")
    return F.when(score >= 0.93, "critical").otherwise(out) if corpus else out


def level_order(c: Column) -> Column:
    return _pick(c, {x: i for i, x in enumerate(LEVELS)}, 0)


def review(level_: Column, rescued: Column, confidence: Column) -> Column:
    severe = level_.isin("critical", "high")
    return F.when(severe & F.coalesce(rescued, F.lit(False)), "rescue").when(severe & (confidence < 0.6), "low_confidence")


def assess(findings: DataFrame, rules: tuple[Rule, ...], health: bool = False) -> DataFrame:
    """Findings with entity, class, score, level, review reason and regulations.  Confidence never moves a score."""
    dim = F.broadcast(rule_table(findings.sparkSession, rules).select("entity_id", "entity", "category", "data_class", "label", "kind"))
    d = findings.drop(*[c for c in dim.columns if c != "entity_id"]).join(dim, "entity_id", "left")
    d = d.withColumn("score", F.round(_pick(F.col("data_class"), BASES, 0.55) * precision(F.col("kind"), F.col("text")), 6)).withColumn("level", level(F.col("score")))
    tags = F.when(F.coalesce(F.col("data_class"), F.lit("neutral")) == "neutral", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(F.col("category") == "PHI", "HIPAA"), F.when(F.col("entity_id").isin(*CARDS), "PCI"), F.lit("GDPR"), F.lit("CCPA"))))
    d = d.withColumn("tags", tags)
    covered = [e for es in SAFE_HARBOR.values() for e in es]
    any_phi = F.lit(True)
    if not health:
        seen = d.agg(F.coalesce(F.max(F.col("category") == "PHI"), F.lit(False)).alias("any_phi"))
        d = d.crossJoin(F.broadcast(seen))
        any_phi = F.col("any_phi")
    d = d.withColumn("tags", F.when(any_phi & F.col("entity").isin(*covered) & ~F.array_contains("tags", "HIPAA"), F.concat(F.array(F.lit("HIPAA")), "tags")).otherwise(F.col("tags")))
    rescued = F.col("rescued") if "rescued" in findings.columns else F.lit(False)
    return d.withColumn("review", review(F.col("level"), rescued, F.col("confidence"))).drop("any_phi")


RECORD = ["source_id", "row"]


def strong_types(assessed: DataFrame) -> DataFrame:
    return assessed.where(F.col("data_class").isin(*STRONG)).groupBy(*RECORD).agg(F.count_distinct("entity_id").alias("strong"))


def field_of() -> Column:
    return F.coalesce("col", "entity")


def k_classes(assessed: DataFrame, least: int = 10) -> DataFrame:
    """Each record with the size k of its class: records that agree on every quasi-identifying field.

    A record's value of a field is its last one; a field that it lacks counts as a value of its own.  With fewer than
    max(2, least) records, or no quasi-identifying field, there are no rows.
    """
    d = assessed.where(F.col("data_class").isin("quasi_identifier", "sensitive_attribute")).withColumn("field", field_of())
    last = d.groupBy(*RECORD, "field", "data_class").agg(F.max_by("text", F.struct("start", "end", "text")).alias("value"))
    tuple_ = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("data_class") == "quasi_identifier", F.struct("field", "value"))))))
    records = last.groupBy(*RECORD).agg(tuple_.alias("qi"), F.max((F.col("data_class") == "quasi_identifier").cast("int")).alias("has_qi"))
    classes = records.groupBy("qi").agg(F.count(F.lit(1)).alias("k"))
    total = records.agg(F.count(F.lit(1)).alias("n"), F.max("has_qi").alias("any_qi"))
    return records.join(classes, "qi").crossJoin(F.broadcast(total)).where((F.col("n") >= max(2, least)) & (F.col("any_qi") == 1)).select(*RECORD, "qi", "k")


def k_summary(classes: DataFrame, threshold: int = 5) -> DataFrame:
    return classes.agg(F.count(F.lit(1)).alias("records"), F.min("k").alias("k_min"), F.count_if(F.col("k") == 1).alias("singletons"), F.count_if(F.col("k") < threshold).alias("below_threshold"))


def escalate(assessed: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Scores lifted by what else a record gives away, then levels with 'critical', and the review again."""
    s = strong_types(assessed)
    d = assessed.join(s.select(F.col("source_id").alias("_s"), F.col("row").alias("_r"), "strong"), (F.col("source_id") == F.col("_s")) & F.col("row").eqNullSafe(F.col("_r")), "left").drop("_s", "_r").withColumn("strong", F.coalesce("strong", F.lit(0)))
    if classes is not None:
        c = classes.select(F.col("source_id").alias("_s"), F.col("row").alias("_r"), "k")
        d = d.join(c, (F.col("source_id") == F.col("_s")) & F.col("row").eqNullSafe(F.col("_r")), "left").drop("_s", "_r")
    else:
        d = d.withColumn("k", F.lit(None).cast("long"))
    boost = F.col("data_class").isin(*BOOSTABLE)
    once = F.when(boost & (F.col("strong") >= 2), F.col("score") + (1 - F.col("score")) * F.least(F.lit(0.45), 0.15 * (F.col("strong") - 1))).otherwise(F.col("score"))
    twice = F.when(boost & (F.col("k") == 1), F.col("once") + (1 - F.col("once")) * 0.20).otherwise(F.col("once"))
    rescued = F.col("rescued") if "rescued" in assessed.columns else F.lit(False)
    d = d.withColumn("once", once).withColumn("score", F.round(twice, 6)).drop("once").withColumn("level", level(F.col("score"), True))
    return d.withColumn("review", review(F.col("level"), rescued, F.col("confidence")))


def histogram(d: DataFrame) -> DataFrame:
    dim = small(d.sparkSession, [(x,) for x in LEVELS], "level string")
    return dim.join(d.groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_entity(d: DataFrame) -> DataFrame:
    tags = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("tags")))), ",")
    return d.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max_by("level", level_order(F.col("level"))).alias("worst"), F.round(F.avg("score"), 6).alias("mean_score"), tags.alias("tags"))


def per_record(d: DataFrame) -> DataFrame:
    """Findings by record: number, summed score, strong types, worst level, whether it is alone in its class, and what it holds."""
    alone = F.coalesce(F.max(F.col("k") == 1), F.lit(False)) if "k" in d.columns else F.lit(False)
    return d.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total_score"), F.count_distinct(F.when(F.col("data_class").isin(*STRONG), F.col("entity_id"))).alias("strong"), F.max_by("level", level_order(F.col("level"))).alias("worst"), alone.alias("singleton"), F.array_join(F.sort_array(F.collect_set("entity")), ",").alias("entities"))


def location() -> Column:
    """Where a person has to look: the cell, else the document."""
    return F.when(F.col("col").isNotNull() & F.col("row").isNotNull(), F.format_string("%s (row %d)", "col", "row")).otherwise(F.coalesce("col", "source_id"))


def heatmap(d: DataFrame) -> DataFrame:
    return d.groupBy(F.coalesce("col", "source_id").alias("location")).pivot("level", list(LEVELS)).count().na.fill(0)


def compliance(d: DataFrame) -> DataFrame:
    return d.select(F.explode("tags").alias("regulation"), "level").groupBy("regulation").agg(F.count(F.lit(1)).alias("n"), F.max_by("level", level_order(F.col("level"))).alias("worst"))


def checklist(d: DataFrame) -> DataFrame:
    """All 18 categories of the safe-harbor list, with the entities found of each."""
    spark = d.sparkSession
    dim = small(spark, [(i, c, e) for i, (c, es) in enumerate(SAFE_HARBOR.items(), 1) for e in es], "position int, category string, entity string")
    hits = dim.join(d.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity", "left")
    return hits.groupBy("position", "category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.col("entity")))), ",").alias("entities"))


def exposure(d: DataFrame, classes: DataFrame | None = None, threshold: int = 5) -> DataFrame:
    """One row: findings, severe ones, share of records that stand out, and the index from 0 to 100."""
    s = d.agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("level").isin("high", "critical")).alias("severe"), F.count_if(F.col("level") == "critical").alias("critical"))
    if classes is not None:
        u = classes.agg(F.when(F.count(F.lit(1)) > 0, F.count_if(F.col("k") < threshold) / F.count(F.lit(1))).alias("unique_share"))
        s = s.crossJoin(F.broadcast(u))
    else:
        s = s.withColumn("unique_share", F.lit(None).cast("double"))
    raw = F.when(F.col("findings") > 0, F.col("severe") / F.col("findings")).otherwise(0.0) * F.when(F.col("unique_share").isNull(), 1.0).otherwise(0.5 + 0.5 * F.col("unique_share")) * 100
    return s.withColumn("index", F.bround(F.when(F.col("critical") > 0, F.greatest(raw, F.lit(40.0))).otherwise(raw), 1))


def approvals(d: DataFrame) -> DataFrame:
    """The review queue by value: level, location, entity, the value's beginning, why it is there, and how often."""
    q = d.where("review is not null").select("level", location().alias("location"), "entity", F.substring("text", 1, 40).alias("value"), "review")
    return q.groupBy(*q.columns).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), F.desc(level_order(F.col("level"))), "location", "entity", "value")


def trace(d: DataFrame) -> DataFrame:
    """The steps that led to each score: (…, step, what, change) of an escalated finding."""
    kind = _pick(F.col("data_class"), BASES, 0.55)
    exact = F.round(kind * precision(F.col("kind"), F.col("text")), 6)
    boost = F.col("data_class").isin(*BOOSTABLE)
    once = F.when(boost & (F.col("strong") >= 2), exact + (1 - exact) * F.least(F.lit(0.45), 0.15 * (F.col("strong") - 1))).otherwise(exact)
    step = lambda n, name, what, change: F.struct(F.lit(n).alias("n"), F.lit(name).alias("step"), what.alias("what"), F.round(change, 6).alias("change"))
    steps = F.array(
        step(1, "sensitivity", F.concat(F.lit("a value of the class "), F.coalesce("data_class", F.lit("none"))), kind),
        step(2, "precision", F.lit("how exact the value is"), exact - kind),
        step(3, "together", F.concat(F.col("strong").cast("string"), F.lit(" strong types in the record")), once - exact),
        step(4, "alone", F.when(F.col("k") == 1, "the only record of its class").otherwise("not alone in its class"), F.col("score") - once),
    )
    return d.select(*RECORD, "col", "start", "end", "entity", "score", F.explode(steps).alias("s")).select(*RECORD, "col", "start", "end", "entity", "score", "s.n", "s.step", "s.what", "s.change")


def throughput(scanned: DataFrame, seconds: float) -> DataFrame:
    """One row: texts, characters, and how many of each a second of a scan that took so long."""
    n = scanned.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    rate = lambda c: F.round(F.try_divide(F.col(c), F.lit(float(seconds))), 1)
    return n.select("texts", "chars", F.lit(float(seconds)).alias("seconds"), rate("texts").alias("texts_a_second"), rate("chars").alias("chars_a_second"))


def review_queue(d: DataFrame) -> DataFrame:
    return d.where("review is not null").orderBy(F.desc("score"), *RECORD, "start")
