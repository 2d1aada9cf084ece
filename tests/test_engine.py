"""The engine's operators on small hand-worked inputs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.api import Scanner
from tidemark.functions import generalize as G
from tidemark.functions import text as T
from tidemark.functions.validators import VALIDATORS, to_date
from tidemark.operators import context, detect, evaluate, fusion, intervals, medical, models, optimize, policy, severity, synthetic, tables, utility
from tidemark.plans import rules as R
from tidemark.sources import readers, vocabularies
from tidemark.streaming import stream

TEXTS = "source_id string, row long, col string, text string"
SPAN = "source_id string, row long, col string, start int, end int, text string, entity_id string, confidence double, valid boolean"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def texts(spark, *rows):
    return spark.createDataFrame([(str(i), None, None, t) for i, t in enumerate(rows)], TEXTS)


def found(df):
    return sorted((r.start, r.end, r.entity_id) for r in df.collect())


def test_find_all(spark):
    t = "ä@b.co, 12 x@y.org\n😀 z@q.net"
    got = one(spark, T.find_all(F.lit(t), r"[a-z]+@[a-z]+\.[a-z]+"))
    assert [(s.start, s.end, s.text) for s in got] == [(11, 18, "x@y.org"), (21, 28, "z@q.net")]
    assert all(t[s.start : s.end] == s.text for s in got)
    assert one(spark, T.find_all(F.lit(""), "a")) == [] and one(spark, T.find_all(F.lit(None).cast("string"), "a")) is None


@pytest.mark.parametrize(
    "name, good, bad",
    [
        ("PHONE_US", "(743) 555-3824", "(143) 555-3824"), ("US_SSN", "123-45-6789", "666-45-6789"), ("US_ITIN", "912-70-1234", "912-60-1234"), ("CANADIAN_SIN", "046 454 286", "111 111 111"), ("INDIAN_AADHAAR", "2345 6789 0123", "1345 6789 0123"),
        ("UK_NHS", "943 476 5919", "943 476 5918"), ("NPI", "1234567893", "1234567890"), ("LUHN_CHECKSUM", "4111 1111 1111 1111", "4111 1111 1111 1112"), ("ABA_ROUTING_NUMBER", "021000021", "021000022"), ("IBAN", "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"),
        ("IMEI", "490154203237518", "490154203237519"), ("VIN", "1HGCM82633A004352", "1HGCM82633A00435O"), ("IPV4_RANGE", "10.0.0.255", "10.0.0.256"), ("WEB_URL", "www.example.com/x?y=1", "https://localhost"), ("LATITUDE", "42.36 N", "142.36 N"), ("LONGITUDE", "-171.1", "181"),
        ("DATE", "March 5, 2021", "soon"), ("UNIX_TIMESTAMP", "0978307200", "1600000000"), ("TIMESTAMP", "10:30 pm", "10"), ("E164", "+14155550100", "4155550100"), ("INSURANCE_ID", "ABC123456", "123456789"), ("DATE_YEAR_RANGE", "1999-01-01", "1899-01-01"), ("POSTAL_CODE_FORMAT", "x", None),
    ],
)
def test_validators(spark, name, good, bad):
    assert one(spark, F.coalesce(VALIDATORS[name](F.lit(good)), F.lit(False)))
    if bad:
        assert not one(spark, F.coalesce(VALIDATORS[name](F.lit(bad)), F.lit(False)))
        assert not one(spark, F.coalesce(VALIDATORS[name](F.lit(None).cast("string")), F.lit(False)))


def test_dates(spark):
    for s in ("2021-03-05", "03/05/2021", "5 March 2021", "Mar 5, 2021", "05.03.2021", "3-5-2021", "3/5/21", "Mar. 5, 2021 9:15 AM PST", "5th of march, 2021", "2021-03-05 at 08:30:15", "MARCH 5th 2021"):
        assert one(spark, to_date(F.lit(s))) == dt.date(2021, 3, 5), s
    check = lambda s: one(spark, VALIDATORS["DATE"](F.lit(s)))
    assert one(spark, to_date(F.lit("March 2021"))) == dt.date(2021, 3, 1) and one(spark, to_date(F.lit("March 15th"))) is None
    assert check("March 15th") and check("Feb 29th") and not check("March 45th") and not check("soon")


def test_generalize(spark):
    for kind, value, level, want in (("age", "34 years", "5y", "30-34"), ("age", "91", "20y", "90+"), ("date", "2021-03-05", "month", "2021-03"), ("date", "2021-03-05", "decade", "2020s"), ("zip", "02139-1234", "3-digit", "021**"), ("coordinates", "42.36", "1dp", "42.4"), ("coordinates", "42.3 N", "int", None), ("age", "none", "5y", None), ("other", "x", None, None)):
        assert one(spark, G.generalize(kind, F.lit(value), level)) == want
    with pytest.raises(ValueError):
        G.generalize("age", F.lit("1"), "7y")
    for kind, value, want in (("age", "30-34", 0.8), ("age", "90+", 0.4), ("date", "2021", 0.6), ("date", "2020s", 0.4), ("zip", "021**", 0.6), ("zip", "0****", 0.3), ("coordinates", "42", 0.3), (None, "x", 1.0)):
        assert one(spark, G.precision(F.lit(kind), F.lit(value))) == want


def test_coordinates_by_exact_value(spark):
    for v in (-3.85, -2.75, 0.35, -0.0, 0.05, 0.049999999999999996, 0.25, 0.75, 99.95, -1000.45, 5e-324, None):
        assert one(spark, G.coordinates(F.lit(v).cast("double").cast("string"), "1dp")) == (None if v is None else f"{v:.1f}"), v


def test_confidence(spark):
    f = lambda base, valid, w, primary: round(one(spark, detect.confidence(F.lit(base), F.lit(valid).cast("boolean"), F.lit(w).cast("double"), F.lit(primary))), 4)
    assert f(0.8, None, None, False) == 0.8
    assert f(0.55, True, 0.88, True) == 0.88 and f(0.9, True, None, False) == 0.95
    assert f(0.5, False, 0.88, True) == round(0.28 * 0.5 + 0.32 * 0.88, 4) and f(0.9, False, None, False) == 0.48


def test_scan_and_dedupe(spark):
    t = texts(spark, "Call (743) 555-3824 or fax: (743) 555-3825.", "", "write a.b@ex.org")
    got = detect.dedupe(detect.scan(t, R.only("phone_number", "fax_number", "email_address")))
    assert {(r.source_id, r.text, r.entity_id) for r in got.collect()} == {("0", "(743) 555-3824", "pii::phone_number"), ("0", "(743) 555-3825", "pii::phone_number"), ("2", "a.b@ex.org", "pii::email_address")}
    assert {r.entity_id for r in Scanner(spark, R.only("phone_number", "fax_number")).texts(t).where("start > 20").collect()} == {"pii::phone_number"}  # equal confidences: the greater id, which its check locks against context
    assert detect.scan(t, R.only("city")).count() == 0


def test_dictionary_is_leftmost_longest(spark):
    t = texts(spark, "Chronic kidney disease and kidney stones; kidney-disease", "nothing")
    terms = spark.createDataFrame([(s, "phi::medical_condition", s, "c", "t") for s in ("kidney", "kidney disease", "chronic kidney disease", "stones")], "surface string, entity_id string, canonical string, code string, source string")
    assert [(r.text, r.start) for r in detect.dictionary(t, terms).orderBy("start").collect()] == [("Chronic kidney disease", 0), ("kidney", 27), ("stones", 34), ("kidney-disease", 42)]


def test_catalogue():
    rules = R.catalogue()
    assert len(rules) == 84 and R.root("phi::physician_names", rules) == "pii::person_names" and R.root("pii::us_passport_number", rules) == "pii::us_passport_number"
    with pytest.raises(ValueError):
        R.check([R.Rule("pii::x", R.D, default_action="generalize")])
    for r in rules:
        assert r.patterns or r.phrases or r.is_a or r.entity_id.split("::")[1] not in ("ssn", "email_address")


def test_context(spark):
    t = texts(spark, "security code: 123", "there is 123 here")
    s = detect.scan(t, R.only("cvv_code"))
    got = {r.source_id: r for r in context.rescored(s, R.only("cvv_code")).collect()}
    left = "security code: "
    want = 0.85 * (1 - (len(left) - 13) / len(left)) * 1.25
    assert round(got["0"].context, 6) == round(min(1, want), 6) and got["1"].context == 0
    assert round(got["0"].fused, 6) == round(0.05 + 0.35 * min(1, want) * 0.95, 6)


def test_fusion_override_and_model_spans(spark):
    rules = R.catalogue()
    t = texts(spark, "date of birth: 1970-05-06", "seen by Dr. Ann Lee today")
    ner = spark.createDataFrame([("1", None, None, 12, 19, "Ann Lee", "phi::physician_names", 0.6, "seen by dr. ", " today")], fusion.NER)
    out = {(r.source_id, r.text): r for r in Scanner(spark).texts(t, ner).collect()}
    assert out[("0", "1970-05-06")].entity_id == "phi::date_of_birth" and out[("0", "1970-05-06")].rescued
    assert any(r.entity_id == "pii::person_names" for r in out.values())
    assert rules


def test_election(spark):
    s = spark.createDataFrame([("a", None, None, 0, 10, "x" * 10, "pii::ssn", 0.9, True), ("a", None, None, 2, 6, "xxxx", "fin::cvv_code", 0.95, None), ("a", None, None, 8, 14, "x" * 6, "pii::phone_number", 0.8, False), ("a", None, None, 20, 25, "x" * 5, "pii::city", 0.5, None), ("a", None, None, 18, 25, "x" * 7, "pii::street_address", 0.5, None)], SPAN)
    assert found(intervals.elected(s, R.catalogue())) == [(0, 10, "pii::ssn"), (18, 25, "pii::street_address")]
    assert {(r.entity_id, r.reason) for r in intervals.losers(s, R.catalogue()).collect()} == {("fin::cvv_code", "nested"), ("pii::phone_number", "outranked"), ("pii::city", "absorbed")}
    assert found(intervals.resolve(s, R.catalogue(), election=False))


def test_growth_and_merging(spark):
    t = texts(spark, "met Dr. Ann Lee at Mercy Hospital")
    s = spark.createDataFrame([("0", None, None, 8, 11, "Ann", "phi::physician_names", 0.6, None), ("0", None, None, 19, 24, "Mercy", "phi::hospital_names", 0.6, None)], SPAN)
    assert {r.text for r in intervals.grow(s, t, R.catalogue()).collect()} == {"Dr. Ann", "Mercy Hospital"}
    # spans under the end of the is_a chain grow by what their kinds know; what is known of them comes along
    up = s.withColumn("entity_id", F.when(F.col("text") == "Ann", "pii::person_names").otherwise("pii::organization")).withColumns({"winner_kind": F.lit("ner"), "rescued": F.lit(True)})
    assert {(r.text, r.winner_kind, r.rescued) for r in intervals.grow(intervals.resolve(up, R.catalogue()), t, R.catalogue()).collect()} == {("Dr. Ann", "ner", True), ("Mercy Hospital", "ner", True)}
    assert {r.text for r in intervals.grow(up.withColumn("entity_id", F.lit("pii::city")), t, R.catalogue()).collect()} == {"Ann", "Mercy"}
    p = spark.createDataFrame([("0", None, None, 8, 11, "Ann", "pii::person_names", 0.6, None), ("0", None, None, 12, 15, "Lee", "pii::person_names", 0.8, None)], SPAN)
    assert [(r.text, r.confidence) for r in intervals.merge_adjacent(p, t).collect()] == [("Ann Lee", 0.8)]


def test_tables(spark):
    rows = [(i, f"(743) 555-38{i:02d}", "x") for i in range(8)] + [(8, "ext 12", "n/a"), (9, "n/a", None), (10, "  ", "y")]
    df = spark.createDataFrame(rows, "id long, phone string, memo string")
    assert tables.decisive_entity("homePhone", R.catalogue()) in ("pii::phone_number", None)
    assert tables.decisive_entity("date_of_birth", R.catalogue()) == "phi::date_of_birth"
    assert tables.cells(df, "t", "id").count() == 20
    got = Scanner(spark, R.only("phone_number")).table(df, "id", "t")
    filled = [r for r in got.collect() if r.winner_kind == "column_consensus"]
    assert [(r.row, r.text, r.entity_id) for r in filled] == [(8, "ext 12", "pii::phone_number")]
    plan = Scanner(spark, R.only("phone_number"))
    done = plan.plan(plan.assess(got)[0])
    out = {r.id: r.phone for r in tables.scrub_rows(df, done, "id", "t").collect()}
    assert out[0] == "[PHONE]" and out[9] == "n/a" and out[10] == "  "


def test_scrub_is_safe(spark):
    t = texts(spark, "mail a@b.org or c@d.org", "none")
    rules = R.only("email_address")
    plan = policy.execute(policy.resolve(detect.scan(t, rules), rules))
    out = policy.scrub(t, plan)
    assert {r.text for r in out.collect()} == {"mail [EMAIL] or [EMAIL]", "none"}
    assert detect.scan(out, rules).count() == 0
    for bad in (plan.withColumn("text", F.lit("zzz")), plan.withColumn("source_id", F.lit("gone")), plan.withColumn("start", F.lit(5)).withColumn("end", F.lit(12)).withColumn("text", F.lit("a@b.org"))):
        with pytest.raises(Exception, match="span"):
            policy.scrub(t, bad).collect()


def test_policy(spark):
    f = spark.createDataFrame([("a", None, None, 0, 10, "1970-05-06", "pii::dates", 0.9, True), ("a", None, None, 20, 27, "a@b.org", "pii::email_address", 0.9, None), ("a", None, None, 30, 32, "xx", "pii::uuid_guid", 0.9, None), ("a", None, None, 40, 44, "soon", "phi::dates", 0.9, None)], SPAN)
    act = lambda **k: {r.text: (r.action, r.new, r.fallback) for r in policy.execute(policy.resolve(f, R.catalogue(), **k)).collect()}
    got = act()
    assert got["1970-05-06"] == ("generalize", "1970", None) and got["a@b.org"][:2] == ("mask", "[EMAIL]") and got["xx"][0] == "keep" and got["soon"] == ("generalize", "[DATE]", "generalize→mask")
    got = act(profile="gdpr_pseudonymization", overrides={"email_address": "hash", "dates": "generalize:decade"})
    assert got["1970-05-06"][1] == "1970s" and got["a@b.org"][1].startswith("EMAIL_")
    with pytest.raises(ValueError):
        policy.resolve(f, R.catalogue(), overrides={"email_address": "generalize"})
    up = policy.resolve(f.withColumn("alternates", F.array(F.lit("pii::ssn"))), R.catalogue())
    assert {r.action for r in up.where("text = '1970-05-06'").collect()} == {"mask"}
    genes = spark.createDataFrame([("a", None, None, i, i + 1, e, e, 0.9, None) for i, e in enumerate(("phi::dna_sequences", "phi::fingerprints", "fin::iban", "phi::vital_signs", "pii::us_itin"))], SPAN)
    assert {r.text: r.action for r in policy.resolve(genes, R.catalogue(), "gdpr_pseudonymization").collect()} == {"phi::dna_sequences": "replace", "phi::fingerprints": "replace", "fin::iban": "replace", "phi::vital_signs": "generalize", "pii::us_itin": "replace"}
    a = one(spark, policy.same_format(F.lit("Ab-12")))
    assert T and len(a) == 5 and a[2] == "-" and a[3:].isdigit()


def test_severity_and_classes(spark):
    rows = [("t", i, "zip_code", 0, 5, z, "pii::zip_code", 0.9, True) for i, z in enumerate(["02139"] * 6 + ["02140"] * 5 + ["99999"])] + [("t", 11, "ssn", 0, 11, "123-45-6789", "pii::ssn", 0.5, True), ("t", 11, "mail", 0, 7, "a@b.org", "pii::email_address", 0.9, None)]
    d = severity.assess(spark.createDataFrame(rows, SPAN), R.catalogue())
    k = severity.k_classes(d)
    assert {tuple(r) for r in severity.k_summary(k).collect()} == {(12, 1, 1, 1)}
    e = {(r.row, r.entity): r for r in severity.escalate(d, k).collect()}
    assert e[(0, "zip_code")].score == 0.55
    once = 0.55 + 0.45 * 0.15
    assert e[(11, "zip_code")].score == round(once + (1 - once) * 0.2, 6)
    assert e[(11, "ssn")].review == "low_confidence"
    x = severity.exposure(severity.escalate(d, k), k).first()
    assert x.findings == 14 and x["index"] == pytest.approx(100 * 3 / 14 * (0.5 + 0.5 / 12), abs=0.06) or x["index"] >= 40
    assert severity.checklist(d).count() == 18


def test_optimizer(spark):
    df = spark.createDataFrame([(str(20 + i % 10), "02139" if i % 2 else "02140") for i in range(40)], "age string, zip string")
    kinds = {"age": "age", "zip": "zip"}
    got = optimize.choose(df, kinds, optimize.PRESETS["balanced"])
    sized = {tuple(map(int, r.node.split(","))): r.k for r in optimize.lattice(df, kinds, at_once=3).collect()}
    steps = optimize.rungs(kinds)
    assert len(sized) == 20 and sized[0, 0] == 4 and got.achieved_k == sized[tuple(steps[c].index(a) for c, a in got.actions.items())] >= 5
    low = [n for n, k in sized.items() if k >= 5 and not any(m != n and j >= 5 and all(x <= y for x, y in zip(m, n)) for m, j in sized.items())]
    found = optimize.search(optimize.folded(df, kinds), kinds, 5)
    assert sorted(found.minimal) == sorted(low) and found.searched < 20
    # one rung of either column is enough; the band keeps the look of an age less than a cut postcode keeps its own
    kept = optimize.retentions(optimize.folded(df, kinds), kinds)
    assert kept["age"][0] == 1.0 and kept["zip"][-1] == pytest.approx(1 - 0.2 - 0.5 * (1 - 1 / 2) - 0.3)
    best = max(sorted(low, key=lambda n: (sum(n), n)), key=lambda n: round(kept["age"][n[0]] + kept["zip"][n[1]], 9))
    assert got.actions == {c: steps[c][i] for c, i in zip(kinds, best)} and set(got.reasons) == set(kinds)
    one_row = optimize.choose(df.limit(1), kinds, optimize.PRESETS["maximum"])
    assert set(one_row.actions.values()) == {"mask"} and one_row.achieved_k == 1 and "even mask" in one_row.reasons["age"]
    assert optimize.choose(df, kinds, optimize.PRESETS["required"]).actions == {}
    assert optimize.preset(True) is optimize.PRESETS["balanced"] and optimize.preset(None) is None


def test_optimizer_from_findings(spark):
    rows = [("t", i, "zip", 0, 5, "0213%d" % (i % 4), "pii::zip_code", 0.9, True) for i in range(12)] + [("t", i, "mail", 0, 7, "a@b.org", "pii::email_address", 0.9, None) for i in range(12)] + [("t", 0, "x", 0, 3, "abc", "phi::dna_sequences", 0.9, None)]
    d = severity.assess(spark.createDataFrame(rows, SPAN), R.catalogue())
    got = optimize.from_findings(d, R.catalogue(), optimize.PRESETS["balanced"])
    assert got.actions == {"email_address": "hash", "zip_code": "generalize:3-digit"} and got.achieved_k == 12 and got.searched == 2
    assert "joined" in got.reasons["email_address"] and "k=12" in got.reasons["zip_code"] and "no identifier" in got.reasons["dna_sequences"]
    s = Scanner(spark)
    assert s.optimize(d, "maximum").actions["email_address"] == "mask" and s.optimize(d, False).actions == {} and s.optimize(d, "required").actions == {"email_address": "hash"}
    assert {r.entity: r.action for r in s.plan(d, overrides=got.actions).collect()}["zip_code"] == "generalize"


def test_utility(spark):
    rules = R.only("email_address", "phone_number")
    t = texts(spark, "a@b.org (743) 555-3824", "a@b.org")
    f = severity.assess(detect.scan(t, rules), rules)
    done = policy.execute(policy.resolve(f, rules, overrides={"phone_number": "keep"}))
    assert tuple(utility.leakage(done).first()) == (2, 1, 0.5)
    assert {r.entity: r.loss for r in utility.losses(done).collect()} == {"email_address": 0.5, "phone_number": 0.0}
    assert {r.entity: r.score for r in utility.residual(done).collect()} == {"email_address": 0.0, "phone_number": 0.9}


def test_evaluation(spark):
    s = "doc string, start int, end int, entity_id string"
    g = spark.createDataFrame([("d", 0, 5, "a"), ("d", 6, 9, "a"), ("d", 20, 25, "b"), ("e", 0, 3, "a")], s)
    p = spark.createDataFrame([("d", 0, 9, "a"), ("d", 20, 25, "a"), ("e", 1, 4, "a"), ("e", 2, 3, "a")], s)
    assert {(r.doc, r.entity_id): (r.tp, r.fp, r.fn) for r in evaluate.overlap(g, p).collect()} == {("d", "a"): (2, 1, 0), ("d", "b"): (0, 0, 1), ("e", "a"): (1, 0, 0)}
    assert {r.entity_id: (r.tp, r.fp, r.fn) for r in evaluate.strict(g, p).collect()} == {"a": (2, 3, 1), "b": (0, 0, 1)}
    assert {tuple(r) for r in evaluate.confusion(g, p).collect()} == {("b", "a", 1)}
    m = {r.average: r.f1 for r in evaluate.micro_macro(evaluate.overlap(g, p)).collect()}
    assert m["micro"] == pytest.approx(6 / 8) and 0 < m["macro"] < 1
    assert evaluate.regressions(evaluate.strict(g, g), evaluate.strict(g, p)).count() == 1
    # a find from end to end of a run stands for all of it, strictly too; one that is wider doesn't
    run = spark.createDataFrame([("d", 0, 9, "a", "llm", True, "z"), ("d", 20, 26, "b", "ner", False, None)], s + ", winner_kind string, rescued boolean, original_entity_id string")
    m = evaluate.matches(g, run, exact=True)
    assert {r.entity_id: (r.tp, r.fp, r.fn) for r in evaluate.counted(m, "entity_id").collect()} == {"a": (2, 0, 1), "b": (0, 1, 1)}
    assert {(r.outcome, r.gold_start, r.start) for r in m.collect()} == {("tp", 0, 0), ("tp", 6, 0), ("fn", 0, None), ("fp", None, 20), ("fn", 20, None)}
    assert {tuple(r) for r in evaluate.by_winner(m).collect()} == {("llm", 2, 0), ("ner", 0, 1)}
    assert {tuple(r) for r in evaluate.rescues(m).collect()} == {("z", 2, 2, 0)}
    a = evaluate.attribution(m).first()
    assert (a.tp, a.fp, a.precision, a.recall_added) == (2, 0, 1.0, 0.5) and a.f1_with == round(4 / 7, 4) and a.f1_without == 0.0
    assert {tuple(r) for r in evaluate.remapped(g, {"a": "z", "b": None}).select("entity_id").distinct().collect()} == {("z",)}
    bad = evaluate.errors(m, spark.createDataFrame([("d", None, None, "one, two, three, four, five"), ("e", None, None, "six")], TEXTS), 4)
    assert {(r.doc, r.outcome, r.before, r.text, r.after) for r in bad.collect()} == {("e", "fn", "", "six", ""), ("d", "fn", "one, two, three, four, five"[16:20], "one, two, three, four, five"[20:25], "one, two, three, four, five"[25:29]), ("d", "fp", "one, two, three, four, five"[16:20], "one, two, three, four, five"[20:26], "one, two, three, four, five"[26:30])}
    assert evaluate.allowed(run, spark.createDataFrame([("d", ["b"])], "doc string, allowed array<string>")).count() == 1
    t = spark.createDataFrame([("t", 1, "x", 0, 3, "a"), ("t", 2, "x", 0, 3, "a")], "source_id string, row long, col string, start int, end int, entity_id string")
    assert {r.entity_id: (r.tp, r.fp, r.fn) for r in evaluate.strict(evaluate.cells_as_docs(t), evaluate.cells_as_docs(t.limit(1))).collect()} == {"a": (1, 0, 1)}


def test_models(spark):
    t = texts(spark, "ask Ann Lee", "ask Ann Lee", "12")

    def load():
        return lambda x: [{"start": x.index("Ann"), "end": x.index("Lee") + 3, "label": "PER", "score": 0.9}]

    got = models.tag(t, load, {"PER": ("pii::person_names",)}, R.catalogue()).collect()
    assert [(r.source_id, r.text, round(r.confidence, 3)) for r in sorted(got, key=lambda r: r.source_id)] == [("0", "Ann Lee", 0.45), ("1", "Ann Lee", 0.45)]

    def talk():
        return lambda chunk, wanted: '[{"entity_id": "pii::person_names", "text": "ann lee"}, {"entity_id": "x", "text": "ask"}]' if "Ann" in chunk else "no"

    assert {(r.source_id, r.text) for r in models.ask(t, talk, ["pii::person_names"]).collect()} == {("0", "Ann Lee"), ("1", "Ann Lee")}
    # each text is asked for what it has no sure finding of, and one without any finding for everything
    f = spark.createDataFrame([("0", None, None, 4, 11, "Ann Lee", "pii::person_names", 0.9, None), ("1", None, None, 4, 11, "Ann Lee", "pii::person_names", 0.5, None)], SPAN)
    asked = models.gaps(t, f, ["pii::person_names", "pii::city"])
    assert {r.source_id: r.ask for r in asked.collect()} == {"0": ["pii::city"], "1": ["pii::person_names", "pii::city"], "2": ["pii::person_names", "pii::city"]}
    more = models.ask(t, talk, asked)
    assert {(r.source_id, r.entity_id) for r in more.collect()} == {("1", "pii::person_names")}

    def fuller():
        return lambda chunk, wanted: '{"spans": [{"entity_type": "city", "text": "ask", "confidence": 0.9}, {"entity_id": "pii::city", "text": "nowhere"}, 3]}'

    s = Scanner(spark)
    found = s.texts(t.where("source_id < '2'"))
    filled = s.fill(t, found, fuller)
    assert {(r.source_id, r.text, r.winner_kind) for r in filled.where("entity_id = 'pii::city'").collect()} == {("0", "ask", "llm"), ("1", "ask", "llm")}
    gate = models.tag(t, load, {"PER": (("pii::person_names", ("ask",), None), ("pii::city", ("town",), "pii::county"))}, R.catalogue())
    assert {(r.source_id, r.entity_id) for r in gate.collect()} == {(i, e) for i in "01" for e in ("pii::person_names", "pii::county")}
    models.register("own", load)
    assert models.tag(t, "own", {"PER": ("pii::person_names",)}, R.catalogue()).count() == 2
    with pytest.raises(ValueError, match="no tagger"):
        models.backend("none")
    noise = spark.createDataFrame([("DATE", 0, 9, "12/05/2020"), ("DATE", 0, 5, "daily"), ("DATE", 0, 12, "May 5\nnext l"), ("DATE", 0, 8, "30 years"), ("PER", 0, 5, "12345")], "label string, start int, end int, text string")
    assert {(r.label, r.end, r.text) for r in models.usable_dates(noise).collect()} == {("DATE", 5, "May 5"), ("PER", 5, "12345")}
    long = texts(spark, "x" * 4500)
    assert [(r.offset, len(r.chunk)) for r in models.chunks(long).orderBy("offset").collect()] == [(0, 2000), (1900, 2000), (3800, 700)]


def test_medical(spark):
    assert one(spark, medical.drug_name(F.lit("Acetaminophen 500 MG Oral Tablet [Tylenol]"))) == "acetaminophen"
    a = spark.createDataFrame([("Kidney Disease", "e1", "kidney disease", "1", "a"), ("pain", "e1", "pain", "2", "a")], "term string, entity_id string, canonical string, code string, source string")
    b = spark.createDataFrame([("kidney-disease", "e2", "other", "9", "b"), ("Stones", "e2", "stones", "3", "b")], a.schema)
    assert {(r.surface, r.source) for r in medical.merge([a, b]).collect()} == {("kidney disease", "a"), ("stones", "b")}


def test_vocabularies(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,label,synonyms,x,obsolete\nM:1,Kidney Disease,"renal trouble|nephropathy, chronic",,\nM:2,Old Thing,,,TRUE\n')
    (tmp_path / "r.rrf").write_text("77|ENG|||||||||||IN|c|Aspirin|||\n78|ENG|||||||||||XX|c|Nothing|||\nshort|line\n")
    (tmp_path / "c.csv").write_text("C1,bad kidneys,x,Kidney disease\nC2,headache pill,x,aspirin\nC3,unknown thing,x,else\n")
    got = vocabularies.dictionary(spark, *[str(tmp_path / f) for f in ("m.csv", "r.rrf", "c.csv")])
    assert {(r.surface, r.entity_id.split("::")[1], r.code, r.source) for r in got.collect()} == {("kidney disease", "medical_condition", "M:1", "mondo"), ("renal trouble", "medical_condition", "M:1", "mondo"), ("nephropathy chronic", "medical_condition", "M:1", "mondo"), ("aspirin", "medication_name", "77", "rxnorm"), ("bad kidneys", "medical_condition", "C1", "lay"), ("headache pill", "medication_name", "C2", "lay")}


def test_synthetic_gold(spark):
    made, gold = synthetic.corpus(spark.range(40))
    text = {r.source_id: r.text for r in made.collect()}
    rows = gold.collect()
    assert len(rows) > 100 and all(text[r.doc][r.start : r.end] == r.text for r in rows) and {r.entity_id for r in rows} == {e for e, _ in synthetic.values().values() if e}
    assert all(t.count("\n") == 5 for t in text.values())
    found = Scanner(spark).texts(made).withColumn("doc", F.col("source_id")).where(F.col("entity_id").isin(*{r.entity_id for r in rows}))
    by = {r.entity_id: r.f1 for r in evaluate.prf(evaluate.strict(gold, found)).collect()}
    assert min(by[e] for e in ("pii::email_address", "pii::ssn", "fin::credit_card_number", "pii::ip_address", "fin::payment_transaction_id")) >= 0.9, by


def test_scanner_helpers(spark):
    s = Scanner(spark, R.only("email_address", "phone_number"))
    got = s.lists(["x", "b@c.org then a@b.org", "(743) 555-3824"])
    assert [[r.text for r in x] for x in got] == [[], ["b@c.org", "a@b.org"], ["(743) 555-3824"]]
    t = texts(spark, "a@b.org", "x")
    found, took = s.profiled(t)
    assert found.count() == 1 and set(took) == {"deterministic", "all"}
    assert [r.text for r in s.deterministic(texts(spark, "z@b.org a@b.org")).collect()] == ["z@b.org", "a@b.org"]
    own = Scanner(spark, R.only("email_address"), detector=lambda t: detect.scan(t, R.only("ip_address")))
    assert own.texts(texts(spark, "10.0.0.1 a@b.org")).count() == 1
    assert severity.throughput(t, 2.0).first().texts_a_second == 1.0


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("mail a@b.org")
    (tmp_path / "in/b.csv").write_text('id,memo\n1,"two\nlines c@d.org"\n2,\n')
    (tmp_path / "in/c.json").write_text('[{"k": "e@f.org", "n": {"x": 1}}]')
    (tmp_path / "in/skip.pdf").write_text("x")
    files = readers.expand(spark, [str(tmp_path / "in")])
    assert [os.path.basename(f) for f in files] == ["a.txt", "b.csv", "c.json"]
    d = readers.read_all(spark, [str(tmp_path / "in")])
    assert {r.text for r in detect.scan(d, R.only("email_address")).collect()} == {"a@b.org", "c@d.org", "e@f.org"}
    gold = tmp_path / "0.gold.jsonl"
    gold.write_text('{"_meta": {}}\n{"start": 5, "end": 12, "text": "a@b.org", "entity_id": "pii::email_address"}\n')
    assert readers.read_gold(spark, [str(gold)], texts(spark, "mail a@b.org"), R.catalogue()).count() == 1
    with pytest.raises(Exception, match="bad true span"):
        readers.read_gold(spark, [str(gold)], texts(spark, "mail x@b.org"), R.catalogue()).collect()
    (tmp_path / "g/v2").mkdir(parents=True)
    (tmp_path / "g/ACTIVE").write_text("v2\n")
    (tmp_path / "g/v2/0.gold.jsonl").write_text(gold.read_text())
    assert [os.path.basename(f) for f in readers.discover_gold(spark, str(tmp_path / "g"))] == ["0.gold.jsonl"]
    g = readers.read_gold(spark, readers.discover_gold(spark, str(tmp_path / "g")), texts(spark, "mail a@b.org"), R.catalogue())
    readers.write_evaluation(g, g.withColumn("winner_kind", F.lit("deterministic")), texts(spark, "mail a@b.org"), str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev/strict/entities")).first().f1 == 1.0 and spark.read.json(str(tmp_path / "ev/overlap/winners")).first().tp == 1
    (tmp_path / "in/a.txt").write_bytes(b"mail \xff a@b.org")
    assert readers.read_texts(spark, [str(tmp_path / "in/a.txt")]).first().text == "mail  a@b.org"
    assert {(r.col, r.text) for r in readers.read_tables(spark, [f for f in files if f.endswith("json")]).collect()} == {("k", "e@f.org"), ("n", '{"x":1}')}
    stamp = readers.stamped(detect.scan(d, R.only("email_address")))
    assert {r.source_label for r in stamp.collect()} == {"a.txt", "b.csv", "c.json"}
    readers.write_sources(readers.read_texts(spark, [str(tmp_path / "in/a.txt")]), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs/source=a.txt")).first().value == "mail  a@b.org"
    made = readers.write_report(spark, {"a": 1}, "# x", str(tmp_path / "r"))
    assert len(made) == 2 and "r.json" in (tmp_path / "r.md").read_text()


def test_report(spark):
    data, text = Scanner(spark, R.only("email_address", "phone_number")).report(Scanner(spark, R.only("email_address", "phone_number")).texts(texts(spark, "a@b.org", "(743) 555-3824")))
    assert data["exposure"]["findings"] == 2 and "Exposure index" in text and "## Safe-harbor checklist" in text
    for title in ("At a glance", "Before and after", "For a person to approve", "How the highest score came about", "How strongly it hides what"):
        assert f"## {title}" in text
    assert data["glance"][0] == {"findings": 2, "locations": 2, "records": 2, "for review": 0} and {x["level"]: (x["before"], x["after"]) for x in data["levels"]}["info"] == (0, 2)
    steps = data["example"]
    assert [x["step"] for x in steps] == ["sensitivity", "precision", "together", "alone"] and sum(x["change"] for x in steps) == pytest.approx(steps[0]["score"])
    chosen, text = Scanner(spark, R.only("email_address", "zip_code")).report(Scanner(spark, R.only("email_address", "zip_code")).texts(texts(spark, *[f"zip code 0213{i % 3} a{i}@b.org" for i in range(9)])), privacy=True)
    assert {x["entity"]: x["action"] for x in chosen["choices"]}["email_address"] == "hash" and "What the optimiser chose" in text and "combinations were sized" in text


def test_stream(spark, tmp_path):
    src, at = str(tmp_path / "src"), str(tmp_path / "log")
    spark.createDataFrame([(1, "mail a@b.org"), (2, "none")], "doc_id long, text string").write.parquet(src)
    got = []
    q = stream.each_batch(spark.readStream.schema("doc_id long, text string").parquet(src), R.only("email_address"), lambda d, i: got.extend(r.text for r in d.collect()), at)
    q.awaitTermination()
    assert got == ["a@b.org"]


def test_stream_rates(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 10, 5), "a@b.org c@d.org"), (2, dt.datetime(2024, 1, 1, 11, 5), "x@y.org"), (3, dt.datetime(2024, 1, 2), "z")], "id long, ts timestamp, text string").write.parquet(src)
    s = spark.readStream.schema("id long, ts timestamp, text string").parquet(src)
    q = stream.rates(s, R.only("email_address"), "ts", "text", "id").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("rates").collect()) == [1, 2]
