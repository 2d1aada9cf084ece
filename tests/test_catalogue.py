"""The rule catalogue: a literal that each pattern takes as a whole and one in which it finds nothing; rule files; both ways to scan."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import context, detect
from tidemark.plans import rulefile, sql
from tidemark.plans import rules as R

#: entity, place of the pattern, what it takes, what it leaves
LITERALS = """
email_address 0 a.b+c@mail.example.org :: a.b@localhost
email_address 0 [x_y@ex.co] :: @ex.co
email_address 1 bob [at] x.org [dot] uk :: bob at x dot org
email_address 1 bob (at) x (dot) org :: bob [at] x.org
email_address 1 bob [at] x (dot) org :: [at] (dot)
email_address 1 bob (at) x [dot] org :: bob (at) x
phone_number 0 +1 (743) 555-3824 :: 743-555-382
fax_number 0 7435553824 :: 743 5553 824
ssn 0 123-45-6789 :: 123-456-789
street_address 0 45 Old Baker Road :: 45 old baker road
street_address 1 Suite 200 :: Room air
county 0 Orange County :: orange county
zip_code 0 02139-1234 :: 0213
latitude_coordinates 0 42.36 N :: 42.36 E
latitude_coordinates 1 42.3601 :: 423601
longitude_coordinates 0 71.06 W :: 71.06 N
longitude_coordinates 1 171.0589 :: 1710589
dates 0 2024-01-16 at 08:30:15 PM PST :: 2024-01
dates 1 03/04/20 :: 03/04
dates 2 03-04-2020 :: 03-04
dates 3 June 10, 2024 9:15 AM PST :: June 10
dates 4 Mar. 3, 2020 :: Mar. 2020
dates 5 January 15th :: January 15
dates 6 March 2020 :: Mar 2020
dates 7 5th of June 2024 :: 5th of June
age 0 45 yrs old :: 45 yrs
age 1 45 y/o :: 45 y
age 2 Age: 45 :: Age 45
age 3 age 45 :: aged 45
timestamps 0 1700000000 :: 170000000
timestamps 1 1700000000000 :: 17000000000
timestamps 2 5 pm :: 5 p
timestamps 3 23:59 :: 24:59x
relative_date_expressions 0 almost 9 years :: nine years
relative_date_expressions 1 for about 2 years :: for two years
relative_date_expressions 2 early evening :: evening
relative_date_expressions 3 last weekend :: weekend
relative_date_expressions 4 yesterday :: day
relative_date_expressions 5 past quarter :: quarter
imei_number 0 490154203237518 :: 49015420323751
mac_address 0 00:1B:44:11:3A:B7 :: 00:1B:44:11:3A
ip_address 0 10.0.0.255 :: 10.0.0
web_url 0 www.example.com/x?y=1 :: example.com
uuid_guid 0 550e8400-e29b-41d4-a716-446655440000 :: 550e8400-e29b-41d4-a716
uuid_guid 1 d41d8cd98f00b204e9800998ecf8427e :: d41d8cd98f00b204
vehicle_identification_number_vin 0 1HGCM82633A004352 :: 1HGCM82633A00435O
us_passport_number 0 L12345678 :: L1234567
uk_passport_number 0 123456789 :: 12345678
canadian_passport_number 0 AB123456 :: A123456
indian_passport_number 0 A1234567 :: AB1234567
australian_passport_number 0 PA1234567 :: PAX1234567
german_passport_number 0 C01X00T47 :: C01X00T4
drivers_license_number 0 D123-4567-8901 :: D123
uk_nhs_number 0 943 476 5919 :: 943 476
canadian_social_insurance_number_sin 0 046 454 286 :: 046454286
indian_aadhaar_number 0 2345 6789 0123 :: 2345 6789
us_itin 0 912-70-1234 :: 812-70-1234
us_ein 0 12-3456789 :: 123456789
account_reference_number 0 ACC-700000 :: ACC 700000
unique_identifier 0 CUST-001234 :: CUST001234
unique_identifier 1 EMP-789456 :: EMP-78
medical_record_number_mrn 0 789456 :: 7894
medical_record_number_mrn 1 PAT-12345 :: PAT-none
medical_record_number_mrn 2 SUBJ-042 :: SUBJ-
health_plan_beneficiary_number 0 INS-456789 :: INS 456789
health_plan_beneficiary_number 1 BCBS-1234 :: BCBS 1234
claim_control_number 0 AUTH-2024-XYZ :: AUTH 2024
icd10_diagnosis_codes 0 J45.909 :: U45.909
cpt_procedure_codes 0 99213 :: 9921
medication_dosage 0 2.5 ml :: 2.5 miles
medication_dosage 1 5mg/kg :: 5mg
medication_dosage 2 twice daily :: daily
vital_signs 0 120/80 :: 120-80
vital_signs 1 72 bpm :: 72 bps
vital_signs 2 98.6°F :: 98.6°
vital_signs 3 95 % SpO2 :: 85 % SpO2
vital_signs 4 16 breaths/min :: 16 breaths
provider_npi 0 1234567893 :: 123456789
phi::dates 0 2024-1-6 :: 2024-1
phi::dates 1 3/4/2020 :: 3/4
phi::dates 2 3-4-20 :: 3-4
phi::dates 3 may 5, 2021 :: may 2021
phi::dates 4 Dec. 5 2021 :: Dec. 5
phi::timestamps 0 1600000000 :: 160000000
phi::timestamps 1 1600000000000 :: 160000000000
phi::relative_date_expressions 0 Today :: todays
phi::relative_date_expressions 1 tomorrow :: morrow
phi::relative_date_expressions 2 past few weeks :: few weeks
phi::relative_date_expressions 3 3 days from now :: 3 days
phi::relative_date_expressions 4 from the clinic today :: from the clinic
genomic_variants 0 BRCA1 :: BRCA3
genomic_variants 1 c.1234+5A>G :: c.1234
genomic_variants 2 p.Val600Glu :: p.V600
genomic_variants 3 C677T :: 677
genomic_variants 4 E3/E4 :: E3-E4
credit_card_number 0 4111 1111 1111 1111 :: 4111 1111 1111
credit_card_number 1 XXXX-XXXX-XXXX-1234 :: XXXX-1234
credit_card_number 2 card ending in 1234 :: card ending
cvv_code 0 123 :: 123-4567
card_expiry_date 0 12/25 :: 13/25
bank_account_number 0 12345678901 :: 12345
routing_number_aba 0 021000021 :: x-021000021
iban 0 DE89370400440532013000 :: DE8937040044
payment_transaction_id 0 TXN-ABC123 :: TXN-A
crypto_wallet_address 0 0x52908400098527886E0F7030069857D2E4169EE7 :: 0x5290840009852788
crypto_wallet_address 1 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa :: 1A1zP1eP5QGefi2DMPT
swift_bic 0 DEUTDEFF500 :: DEUTDEF
"""
ROWS = [(m[1], int(m[2]), m[3], m[4]) for line in LITERALS.strip().split("\n") if (m := re.match(r"(\S+) (\d) (.*) :: (.*)", line))]
TEXTS = "source_id string, row long, col string, text string"


def rule(name: str) -> R.Rule:
    return R.only(name)[0]


def test_every_pattern_has_literals():
    assert {(rule(n).entity_id, k) for n, k, _, _ in ROWS} == {(r.entity_id, k) for r in R.catalogue() for k in range(len(r.patterns))}
    assert len(R.catalogue()) == 84 and len(ROWS) >= 106 - 2 and sum(len(r.phrases) for r in R.catalogue()) >= 655


@pytest.mark.parametrize("name, k, good, bad", ROWS)
def test_literals(name, k, good, bad):
    r = rule(name)
    assert re.search(r.patterns[k], good)[0] == good
    assert not re.search(r.patterns[k], bad), bad
    assert not r.anchor or re.search(r.anchor, good)


def test_both_ways_to_scan_find_the_same(spark):
    """Built-in functions and Arrow batches, over all literals, between letters outside ASCII and in one long text; refused places too."""
    lines = [x for _, _, good, bad in ROWS for x in (good, bad, f"é{good}ü {bad}")] + ["mrn 123-45-6789", "123-45-6789 digits", "account\t 743-555-3824", " ".join(x for _, _, x, _ in ROWS), "", "٤٥ years old"]
    t = spark.createDataFrame([(str(i), None, None, x) for i, x in enumerate(lines)] + [("n", None, None, None)], TEXTS)
    rules = R.catalogue()
    rows = lambda d: sorted((r.source_id, r.start, r.end, r.text, r.entity_id, round(r.confidence, 6), r.before, r.after) for r in d.collect())
    arrow = rows(detect.scan(t, rules, native=False))
    halves = [rules[i : i + 12] for i in range(0, len(rules), 24)]  # planning so many expressions takes long; half the rules will do
    native = [x for some in halves for x in rows(detect.scan(t, some, native=True))]
    ids = {r.entity_id for some in halves for r in some}
    assert [x for x in arrow if x[4] in ids] == sorted(native) and len(arrow) > 500
    mine = lambda i: {(x[4], x[3]) for x in arrow if x[0] == str(i)}
    assert ("pii::ssn", "123-45-6789") not in mine(len(lines) - 6) | mine(len(lines) - 5)
    assert not any(e == "pii::phone_number" for e, _ in mine(len(lines) - 4))


def test_the_sql_knows_every_entity_with_patterns():
    assert set(sql.PATTERNS) == {r.entity_id for r in R.catalogue() if r.patterns}


def test_phrases_notation():
    assert R._w("a[b] c,{x|y z},p[ {q|r}]") == ("a c", "ab c", "x", "y z", "p", "p q", "p r")


def test_rule_files(spark, tmp_path):
    own = {"entities": {"badge": {"regex_patterns": {"accepted_patterns": [r"\bB-\d{4}\b", {"pattern": r"\b\d{4}\b", "confidence_weight": 0.2}], "confidence_weight": 0.6}, "contextual_phrases": {"values": ["badge", 7], "confidence_weight": 0.5, "rescue_override": True}, "prohibited_prefix": {"values": ["Order", {"x:": None}]}, "classification": {"data_class": "direct_identifier", "category": "PII"}, "is_a": "pii_entity_ontology::unique_identifier"}, "odd": "no mapping"}}
    at = tmp_path / "own_rules.json"
    at.write_text(json.dumps(own))
    (r,) = rulefile.read(str(at))
    assert (r.entity_id, r.patterns, r.weights, r.phrases, r.not_after, r.is_a, r.override) == ("own::badge", (r"\bB-\d{4}\b", r"\b\d{4}\b"), (None, 0.2), ("badge",), ("order",), "pii::unique_identifier", True)
    t = spark.createDataFrame([("0", None, None, "badge B-1234, order B-9999")], TEXTS)
    found = {(x.text, x.confidence) for x in detect.dedupe(detect.scan(t, (r,))).collect()}
    assert found == {("B-1234", 0.6), ("1234", 0.2), ("9999", 0.2)}
    every = rulefile.load([str(at)], extend=True)
    assert len(every) == 85 and R.root("own::badge", every) == "pii::unique_identifier" and rulefile.load() == R.catalogue() and len(rulefile.load([str(at)])) == 1
    for spoil, message in ((("validators", {"enum": "NONE"}), "validator"), (("classification", {"data_class": "x"}), "class"), (("default_action", "burn"), "action"), (("default_action", "generalize"), "generalized"), (("regex_patterns", {"accepted_patterns": ["("]}), "pattern")):
        at.write_text(json.dumps({"entities": {"badge": own["entities"]["badge"] | dict([spoil])}}))
        with pytest.raises(ValueError, match=message):
            rulefile.read(str(at))
    at.write_text("[]")
    with pytest.raises(ValueError, match="entities"):
        rulefile.read(str(at))
    (tmp_path / "map.json").write_text(json.dumps({"mappings": {"PER": "pii::person_names", "NORP": ["pii::nationality", "pii::religious_affiliation"]}}))
    assert rulefile.labels(str(tmp_path / "map.json")) == {"PER": ("pii::person_names",), "NORP": ("pii::nationality", "pii::religious_affiliation")}


def test_context_without_a_join(spark):
    """Scores of every rule near a span, by hand; the plan has no join."""
    t = spark.createDataFrame([("0", None, None, "routing number 021000021 at the bank"), ("1", 3, "Fax", "7435553824")], TEXTS)
    rules = R.only("routing_number_aba", "fax_number", "phone_number", "bank_account_number")
    s = detect.scan(t, rules)
    e = context.evidence(s, rules)
    assert "Join" not in e.drop("phrases")._jdf.queryExecution().executedPlan().toString().split("Scan")[0].replace("BroadcastHashJoin", "")
    got = {(r.source_id, r.start, r.end, r.entity_id): (round(r.context, 6), r.phrases) for r in e.collect()}
    left, right = "routing number ", " at the bank"
    near = lambda gap, n: 1 - gap / n
    want = 0.4 * (near(1, 15) + near(8, 15)) * 1.25 + 0.4 * near(8, 12) + 0.05 * 2
    assert got["0", 15, 24, "fin::routing_number_aba"] == (round(min(1, want), 6), ["bank", "routing", "routing number"])
    assert len(left) == 15 and len(right) == 12
    assert got["1", 0, 10, "pii::fax_number"] == (round(0.45 * (1 - 1 / 4) * 1.25, 6), ["fax"])
    keyed = context.evidence(s, rules, keys=spark.createDataFrame([("Fax", "pii::fax_number")], "col string, entity_id string"))
    assert {r.entity_id: round(r.context, 6) for r in keyed.where("source_id = '1' and end = 10").collect()} == {"pii::fax_number": round(0.8 * 0.75 * 1.25, 6)}
    assert F is not None
