"""The rule catalogue: what is looked for, how it is checked, which words around it speak for it, and how severe it is.

Order matters: ties between equal scores go to the earlier rule.  A pattern is written such that Python and, with the
prefix that :attr:`Rule.native` adds, Java find the same matches; an anchor is what every match of a rule contains, so
that texts without it need no further look.  :mod:`tidemark.plans.rulefile` reads further rules from files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.generalize import KINDS, LADDERS
from tidemark.functions.local import small
from tidemark.functions.validators import VALIDATORS

ACTIONS = tuple("DEFAULT keep generalize format_preserve replace hash mask redact".split())
D, Q, S, F_, B, G, N = "direct_identifier", "quasi_identifier", "sensitive_attribute", "financial_data", "biometric_identifier", "genetic_data", "neutral"
CLASSES = (D, G, B, F_, S, "device_identifier", Q, N)


@dataclass(frozen=True)
class Rule:
    entity_id: str
    data_class: str
    label: str | None = None
    patterns: tuple = ()
    weight: float | None = None
    validator: str | None = None
    validator_weight: float | None = None
    primary: bool = False
    phrases: tuple = ()
    phrase_weight: float | None = None
    is_a: str | None = None
    part_of: str | None = None
    not_after: tuple = ()
    not_before: tuple = ()
    not_like: tuple = ()
    prefixes: tuple = ()
    suffixes: tuple = ()
    override: bool = False
    ner_weight: float = 0.65
    before: int = 50
    after: int = 25
    anchor: str | None = None
    default_action: str = "DEFAULT"
    weights: tuple = field(default=())
    description: str | None = None

    @property
    def native(self) -> tuple[str, ...]:
        """The patterns for Java, where classes and boundaries must be told to know all of Unicode, as Python's do."""
        return tuple("(?U)" + p for p in self.patterns)

    @property
    def ontology(self) -> str:
        return self.entity_id.split("::")[0]

    @property
    def name(self) -> str:
        return self.entity_id.split("::")[1]

    @property
    def category(self) -> str:
        return {"pii": "PII", "phi": "PHI", "fin": "Financial"}.get(self.ontology, self.ontology.upper())


_B = r"\b"
_STEMS = {"Jan": "uary", "Feb": "ruary", "Mar": "ch", "Apr": "il", "May": "", "Jun": "e", "Jul": "y", "Aug": "ust", "Sep": "tember", "Oct": "ober", "Nov": "ember", "Dec": "ember"}
_LONG, _SHORT, _EITHER = (f"(?:{'|'.join(x)})" for x in ((a + b for a, b in _STEMS.items()), _STEMS, (f"{a}(?:{b})?" if b else a for a, b in _STEMS.items())))


def _n(*lengths: int) -> str:
    """So many digits: exactly, or from and to."""
    return r"\d{" + ",".join(map(str, lengths)) + "}"


def _whole(*parts: str, loose: bool = False) -> str:
    """The parts in a row, as a word of their own; loose: without regard to case."""
    return ("(?i)" if loose else "") + _B + "".join(parts) + _B


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _w(text: str) -> tuple[str, ...]:
    """Phrases from a short notation: commas between, [x] may be missing, {a|b} stands for either."""
    out = []
    for item in text.split(","):
        todo = [item.strip()]
        while todo:
            x = todo.pop(0)
            if m := re.search(r"\[([^\]]*)\]|\{([^}]*)\}", x):
                todo[:0] = [x[: m.start()] + y + x[m.end() :] for y in (["", m[1]] if m[1] is not None else m[2].split("|"))]
            else:
                out.append(" ".join(x.split()))
    return tuple(dict.fromkeys(out))


_NEAR = r"(?:(?:about|almost|approximately|around|over)\s+)?"
_SPAN = r"(?:day|week|month|year)s?"
_GAP = r"[\s.-]?"
_PHONE = rf"(?:\+?1{_GAP}|\+1\s*)?(?:{_n(3)}|\({_n(3)}\)){_GAP}{_n(3)}{_GAP}{_n(4)}{_B}"
_CLOCK = rf"(?:\s+(?:at\s+)?{_n(1, 2)}:{_n(2)}(?::{_n(2)})?(?:\s*(?:A|P)M)?(?:\s+[A-Z][A-Z]{{1,3}})?)?"
_MDY = r"\s+" + _n(1, 2) + r",?\s+" + _n(4)
_ISO = "-".join((_n(4), _n(1, 2), _n(1, 2)))
_SLASHED, _DASHED = (s.join((_n(1, 2), _n(1, 2), _n(2, 4))) for s in "/-")
_MAIL = "[A-Za-z0-9._%+-]+"
_DAY = "birth{day| date},dob,date of {birth|death},born[ on],born in,age{ is|d},d{ie|ecease}d,dod,death {date|occurred},expired,passed {away|on},time of death"
_PASS = "passport[ number],passport no,travel document"
_LAT = "coordinate[s],geo,gps,location"

PII = [
    Rule("pii::person_names", D, "PERSON", phrases=_w("{full |}name,{dr|md|rn},doctor,physician,nurse,attending,provider,client,applicant,claimant,employee,insured,subscriber"), phrase_weight=0.6, ner_weight=0.5, not_like=(_whole(_EITHER, loose=True),)),
    Rule("pii::email_address", D, "EMAIL", (r"\[?" + _MAIL + r"@[-.A-Za-z0-9]+[.][A-Za-z]{2,}\]?", _whole(_MAIL, r"\s*(?:\[at\]|\(at\))\s*[A-Za-z0-9.-]+\s*(?:\[dot\]|\(dot\))\s*[A-Za-z]{2,}")), 0.9, phrases=_w("[e]mail,e-mail,{reply|send} to"), anchor=r"@|[\[(]at[\])]"),
    Rule("pii::phone_number", D, "PHONE", (_PHONE,), 0.55, "PHONE_US", 0.88, True, _w("phone[ number],tel[ephone],mobile,cell,contact[ number],call,reach"), not_after=_w("acct,[{checking|savings} ]account,account number,transfer to[ account]"), anchor=_n(3)),
    Rule("pii::fax_number", D, "PHONE", (_PHONE,), 0.55, "PHONE_US", 0.88, True, _w("fax[ number],facsimile"), anchor=_n(3)),
    Rule("pii::ssn", D, "SSN", (_whole("-".join((_n(3), _n(2), _n(4)))),), 0.85, "US_SSN", phrases=_w("ss#,ssn[#],social security[ number]"), not_after=_w("account,customer,emp[loyee],license,medical record,member,mrn"), not_before=_w("digit[s]"), anchor=r"\d-\d"),
    Rule(
        "pii::street_address", D, "STREET_ADDRESS",
        (
            _whole(r"\d+(?:\s+[A-Z][A-Za-z]{1,})+\s+", _any("St(?:reet)? Ave(?:nue)? Boulevard Blvd Dr(?:ive)? R(?:oa)?d Lane Ln C(?:our)?t Way Pl(?:ace)? Ter(?:race)? Cres(?:cent)? Close Grove Mews Sq(?:uare)? Parkway Pkwy")),
            _whole(_any(r"Apt\.? Apartment Suite Ste\.? Unit Fl\.? Floor Bldg\.? Building Rm\.? Room"), r"\s+(?=[0-9A-Z-]*\d)[0-9A-Z][0-9A-Z-]*", loose=True),
        ),
        0.65, phrases=_w("address,ave[nue],st[reet],road,rd,boulevard,blvd,lane,ln,drive,dr,court,ct,parkway,pkwy,pl[ace],ter[race],cres[cent],close,gr[ove],mews,sq[uare]"), anchor=r"\d",
    ),
    Rule("pii::city", Q, "LOCATION", phrases=_w("city[ name],town,locality,municipality,{based|lives|resides} in"), part_of="pii::street_address"),
    Rule("pii::county", Q, "LOCATION", (_whole(r"[A-Z][A-Za-z]{1,}\s+County"),), 0.6, phrases=("county",), phrase_weight=0.4, anchor="County"),
    Rule("pii::state", Q, "LOCATION", phrases=_w("state[ {code|name}],province,region"), part_of="pii::street_address"),
    Rule("pii::zip_code", Q, "ZIPCODE", (_whole(_n(5), "(?:-", _n(4), ")?"),), 0.78, "POSTAL_CODE_FORMAT", phrases=(*_w("zip[ code],postal[ code],address,city,state,suite"), *"al ak az ar ca co ct dc de fl ga hi ia id il in ks ky la ma md me mi mn mo ms mt nc nd ne nh nj nm nv ny oh ok or pa ri sc sd tn tx ut va vt wa wi wv wy".split()), part_of="pii::street_address", before=35, after=10, anchor=_n(5)),
    Rule("pii::po_box", D, phrases=_w("{p.o.|po|post office} box")),
    Rule("pii::latitude_coordinates", Q, "GPS_COORDINATES", (_whole("-?", _n(1, 2), r"(?:[.]\d+)?\s*[NS]"), _whole("-?", _n(1, 2), r"\.\d+")), 0.45, "LATITUDE", phrases=_w("lat[itude]," + _LAT), phrase_weight=0.8, weights=(0.85, 0.15), anchor=r"\d\.\d|\d\s*[NS]"),
    Rule("pii::longitude_coordinates", Q, "GPS_COORDINATES", (_whole("-?", _n(1, 3), r"(?:[.]\d+)?\s*[EW]"), _whole("-?", _n(1, 3), r"\.\d+")), 0.15, "LONGITUDE", phrases=_w("long[itude],lng," + _LAT), phrase_weight=0.8, weights=(0.85, 0.15), anchor=r"\d\.\d|\d\s*[EW]"),
    Rule(
        "pii::dates", Q, "DATE",
        (
            _whole(_ISO, _CLOCK), _whole(_SLASHED), _whole(_DASHED), _whole(_LONG, _MDY, _CLOCK, loose=True), _whole(_SHORT, r"\.?", _MDY, _CLOCK, loose=True), _whole(_LONG, r"\s+", _n(1, 2), "(?:st|nd|rd|th)", loose=True),
            _whole(_LONG, r"\s+", _n(4), loose=True), _whole(_n(1, 2), r"(?:th|st|nd|rd)?\s+(?:of\s+)?", _LONG, r",?\s+", _n(4), loose=True),
        ),
        0.7, "DATE", phrases=_w(_DAY), ner_weight=0.72, anchor=r"\d",
    ),
    Rule("pii::age", Q, "AGE", (_whole(_n(1, 3), r"\s*(?:yrs?[.]?|years?)\s*old"), _whole(_n(1, 3), r"\s*y/?o"), _whole(r"Age:\s*", _n(1, 3), loose=True), _whole(r"age\s+", _n(1, 3), loose=True)), 0.75, phrases=_w("date of birth,dob,born,birth date,patient age"), ner_weight=0.6, weights=(None, None, None, 0.25), anchor=r"\d"),
    Rule("pii::timestamps", Q, "TIME", (_whole(_n(10)), _whole(_n(13)), _whole(_n(1, 2), "(?::", _n(2), r")?\s*[ap]m", loose=True), _whole(r"(?:2[0-3]|[01]?\d):[0-5]\d")), 0.15, "TIMESTAMP", phrases=_w("timestamp,epoch,unix,{created|updated}{ |_}at,{logged|recorded} at"), phrase_weight=0.8, weights=(None, None, 0.7, 0.7), anchor=r"\d"),
    Rule(
        "pii::relative_date_expressions", N, None,
        (
            _whole(_NEAR, r"\d+\s*[-–]?\s*", _SPAN, loose=True), _whole(r"for\s+(?:(?:about|almost|approximately)\s+)?\d+\s+", _SPAN, loose=True), _whole(r"(?:early|late|last|this)\s+(?:morning|afternoon|evening|(?:to)?night)", loose=True), _whole(r"last\s+weekend", loose=True),
            _whole("(?:yesterday|today|tomorrow)", loose=True), _whole(r"(?:past|last|this|next)\s+(?:week(?:end)?|month|quarter|year)", loose=True),
        ),
        0.5, phrases=_w("ago,since,recently,within,duration,period,{in|for|over} the past"), weights=(None, None, None, None, 0.25, 0.25),
    ),
    Rule("pii::device_serial_number", D, "ID_NUM"),
    Rule("pii::imei_number", D, "IMEI", (_whole(_n(15)),), 0.9, "IMEI", anchor=_n(15)),
    Rule("pii::mac_address", D, "MAC_ADDRESS", (_whole("(?:[A-Fa-f0-9]{2}[:-]){5}[A-Fa-f0-9]{2}"),), 0.9, anchor="[A-Fa-f0-9][:-][A-Fa-f0-9]{2}[:-]"),
    Rule("pii::ip_address", D, "IP_ADDRESS", (_whole(r"(?:{0}\.){{3}}{0}".format("(?:2(?:5[0-5]|[0-4][0-9])|[01]?[0-9]{1,2})")),), 0.9, "IPV4_RANGE", anchor=r"[0-9]\.[0-9]"),
    Rule("pii::organization", Q, "ORGANIZATION", phrases=_w("organization,company,corporation,firm,agency,institution,inc[orporated],llc,ltd,employer,employed by,works {at|for},facility,hospital,clinic,medical center"), ner_weight=0.25, not_like=(r"^\d+$", "^[A-Z]{6,}$", "^[A-Z]+-[-0-9A-Z]+$")),
    Rule("pii::employer_organization", Q, "ORGANIZATION", phrases=_w("employer[ name],employed by,place of employment,works {at|for},company,organization"), is_a="pii::organization"),
    Rule("pii::web_url", D, "URL", (r"\b(?:www[.]|https?://(?:www[.])?)[\w@:%.+~#=-]{1,256}\.[\w()]{1,6}\b[\w()@:%+.~#?&/=-]*".replace(r"\w", "A-Za-z0-9_").replace("_()]{1,6}", "()]{1,6}"),), 0.9, "WEB_URL", anchor=r"https?://|www\."),
    Rule("pii::uuid_guid", N, "ID_NUM", (_whole("-".join("[A-Fa-f0-9]{%d}" % k for k in (8, 4, 4, 4, 12))), _whole("[A-Fa-f0-9]{32}")), 0.9, anchor="[A-Fa-f0-9]{8}"),
    Rule("pii::vehicle_identification_number_vin", D, "VIN", (_whole("[0-9A-HJ-NPR-Z]{17}"),), 0.8, "VIN", anchor="[0-9A-Z]{17}"),
    Rule("pii::passport_number", D, "ID_NUM", phrases=_w(_PASS + ",passport id"), phrase_weight=0.85),
    Rule("pii::us_passport_number", D, "ID_NUM", (_whole("[A-Z][0-9]{8}"),), 0.1, phrases=_w(_PASS + ",{us|american} passport"), phrase_weight=0.85, anchor="[A-Z][0-9]{8}"),
    Rule("pii::uk_passport_number", D, "ID_NUM", (_whole("[0-9]{9}"),), 0.05, phrases=_w(_PASS + ",{uk|british} passport"), phrase_weight=0.9, anchor="[0-9]{9}"),
    Rule("pii::canadian_passport_number", D, "ID_NUM", (_whole("[A-Z][A-Z][0-9]{6}"),), 0.1, phrases=_w(_PASS + ",canadian passport"), phrase_weight=0.85, anchor="[A-Z][0-9]{6}"),
    Rule("pii::indian_passport_number", D, "ID_NUM", (_whole("[A-Z][0-9]{7}"),), 0.1, phrases=_w(_PASS + ",indian passport"), phrase_weight=0.85, anchor="[A-Z][0-9]{7}"),
    Rule("pii::australian_passport_number", D, "ID_NUM", (_whole("[A-Z][A-Z]?[0-9]{7}"),), 0.1, phrases=_w(_PASS + ",australian passport"), phrase_weight=0.85, anchor="[A-Z][0-9]{7}"),
    Rule("pii::german_passport_number", D, "ID_NUM", (_whole("[0-9CF-HJ-NPRTV-Z]{9}"),), 0.1, phrases=_w("passport[ number],travel document,german passport,reisepass"), phrase_weight=0.85, anchor="[A-Z0-9]{9}"),
    Rule("pii::drivers_license_number", D, "ID_NUM", (_whole("[A-Z][-0-9A-Z]{5,14}"),), 0.05, phrases=_w("driver[{'s|s} license],dl[ number],dmv,driving[ license],license[ {id|no|number}]"), phrase_weight=0.85, anchor="[A-Z][-0-9A-Z]{5}"),
    Rule("pii::uk_national_insurance_number_nino", D, phrases=_w("nino,national insurance[ number]")),
    Rule("pii::uk_nhs_number", D, "ID_NUM", (_whole("[ -]?".join((_n(3), _n(3), _n(4)))),), 0.05, "UK_NHS", phrases=_w("nhs[ {no|number}],national health service"), phrase_weight=0.85, override=True, anchor=_n(3)),
    Rule("pii::canadian_social_insurance_number_sin", D, None, (_whole("[ -]".join([_n(3)] * 3)),), 0.65, "CANADIAN_SIN", phrases=_w("sin,social insurance[ number]"), anchor=_n(3)),
    Rule("pii::indian_aadhaar_number", D, "ID_NUM", (_whole(r"\s?".join([_n(4)] * 3)),), None, "INDIAN_AADHAAR", phrases=_w("aadhaar[ number],aadhar"), anchor=_n(4)),
    Rule("pii::us_itin", D, None, (_whole("[ -]?".join(("9" + _n(2), _n(2), _n(4)))),), 0.85, "US_ITIN", phrases=_w("itin,individual taxpayer[ identification]"), phrase_weight=0.7, anchor=r"9\d\d"),
    Rule("pii::us_ein", D, "ID_NUM", (_whole(_n(2), "-", _n(7)),), 0.5, phrases=_w("ein,tin,employer id,employer identification[ number],[federal ]tax id,tax id number"), phrase_weight=0.6, anchor=_n(7)),
    Rule("pii::nationality", Q, phrases=_w("nationality,national of,citizen[ship],citizen of"), phrase_weight=0.4),
    Rule("pii::religious_affiliation", S, phrases=_w("religio{n|us},faith,belief,worship,denomination,church,mosque,synagogue,temple"), phrase_weight=0.4),
    Rule("pii::account_reference_number", D, "ACCOUNT_NUMBER", (_whole(r"ACC-\w{1,15}"),), 0.75, phrases=_w("[billing ]account,account {id|number|ref[erence]}"), anchor="ACC-"),
    Rule("pii::unique_identifier", D, "ACCOUNT_NUMBER", (_whole(_any("CLM CUST MEM POL RES SUB"), r"-\w{1,15}"), _whole(r"[A-Z]{2,6}-\d{3,}(?:-\d\d+)*")), 0.75, phrases=_w("account[ {id|number}],{adjuster|application|customer|employee|manager|member|officer|record|student|subscriber} id,{application|claim|customer|policy|record|reference} number"), weights=(None, 0.25), anchor=r"[A-Z]-\w"),
]
PHI = [
    Rule("phi::medical_record_number_mrn", D, "ID_NUM", (_whole(_n(5, 10)), _whole(_any("PTID PAT MRN BH-MRN"), r"[\s:-]\s*(?=[-\w]*\d)[-\w]{4,12}"), _whole(_any("SUBJ SUB RES GEN"), r"[\s:-]\s*(?=[-\w]*\d)[-\w]{1,12}")), 0.05, phrases=_w("mrn,{case|chart|medical record|patient|record} number,medical record,patient[ {id|identifier}],admission,discharge,encounter,visit,chart,[{research|study} ]subject,subject id,participant[ id],study id,cohort"), phrase_weight=0.85, not_after=_w("ssn,social security"), anchor=r"\d"),
    Rule("phi::health_plan_beneficiary_number", D, "ID_NUM", (_whole(_any("BEN GRP HPB INS MEM PLN"), r"-\w{1,15}"), _whole(_any("AET ANT BCBS? CIG CVH HUM KSR MOL SHP UHC WLP"), r"-\w{1,15}")), 0.7, phrases=_w("{health plan|plan|medicare} beneficiary,health plan,beneficiary[ {id|identifier|number}],hpb[ {id|number}],insurance,policy[ number],plan number,member id,coverage,medicare,medicaid,aetna,anthem,blue{cross|shield},cigna,humana,kaiser,molina,uhc,unitedhealthcare"), anchor=r"[A-Z]{3}-\w"),
    Rule("phi::claim_control_number", D, "ID_NUM", (_whole(_any("AUTH CCN CLM GEN-STUDY STUDY"), r"-[\w-]{1,25}"),), 0.75, phrases=_w("claim[ {control|number}],control number,authorization,study[ id]"), anchor="AUTH-|CCN-|CLM-|STUDY-"),
    Rule("phi::authorization_precertification_code", D, "ID_NUM"),
    Rule("phi::icd10_diagnosis_codes", S, "CONDITION", (_whole(r"[A-TV-Z][0-9][A-Z0-9](?:\.[A-Z0-9]{1,4})?"),), 0.05, phrases=_w("icd[{10|-10}],diagnosis[ code],diagnosed with,dx,assessment"), phrase_weight=0.85, anchor="[A-TV-Z][0-9]"),
    Rule("phi::cpt_procedure_codes", S, "PROCEDURE", (_whole(_n(5)),), 0.05, phrases=_w("cpt[ code],hcpcs,procedure[ code]"), phrase_weight=0.85, anchor=_n(5)),
    Rule("phi::hcpcs_codes", S, "PROCEDURE"),
    Rule("phi::ndc_codes", S, "MEDICATION"),
    Rule("phi::lab_results", S, "LAB_TEST"),
    Rule(
        "phi::medication_dosage", S, None,
        (
            _whole(r"\d+(?:[.]\d+)?\s*", _any("mg mcg m[lL] k?g μg IU units? tablets? cap(?:sule)?s?")),
            _whole(r"\d+(?:[.]\d+)?\s*", _any("mg mcg m[lL] g μg"), r"\s*/\s*", _any("kg day hr hour dose min kg/day")),
            _whole(r"(?:\d+\s*(?:times?|x)\s+(?:daily|(?:per|a)\s+day)|(?:on|twi|thri)ce\s+(?:daily|(?:per|a)\s+day))", loose=True),
        ),
        0.7, phrases=_w("dos{age|e},medication,drug,prescri{bed|ption},administered,mcg,mg,tablet,capsule,oral,iv,infusion,injection"), anchor=r"\d|[Cc][Ee]",
    ),
    Rule("phi::medical_condition", S, "CONDITION", phrases=_w("diagnos{ed|is},dx,condition,comorbidity,disease,disorder,history of,presents with")),
    Rule("phi::medication_name", S, "MEDICATION", phrases=_w("medication,drug,dose,rx,prescri{bed|ption},taking,administered")),
    Rule("phi::vital_signs", S, None, (_whole("/".join([_n(2, 3)] * 2)), _whole(_n(2, 3), r"\s*bpm"), _whole(_n(2, 3), r"(?:[.]\d)?\s*°?\s*[CF]"), r"\b(?:100|9[0-9])\s*%\s*(?:oxygen|sat|(?:Sp)?O2)?\b", _whole(_n(1, 2), r"\s*br(?:eaths?)?[\s/]min(?:ute)?")), 0.65, phrases=_w("vital{s| signs},blood pressure,bp,systolic,diastolic,mmhg,heart rate,pulse,temp[erature],oxygen saturation,o2 sat,spo2,respiratory rate,rr"), not_after=_w("exp[{ires|iry|iration}],valid {thru|through|until}"), not_before=("/",), anchor=r"\d"),
    Rule("phi::measurement_units", N),
    Rule("phi::physician_names", Q, "PERSON", phrases=_w("dr[.],doctor,physician[ assistant],referring physician,md,m.d.,d.o.,rn,np,pa,nurse[ practitioner],attending,prescriber,provider,specialist,surgeon"), phrase_weight=0.8, is_a="pii::person_names", prefixes=("Dr", "Dr.", "Prof", "Prof.", "Doctor"), not_like=(_whole(_any("APRN CNA CNM CRNA EMT LCSW LMFT LMSW LPC MSW NP PA-C")),)),
    Rule("phi::hospital_names", Q, "ORGANIZATION", is_a="pii::organization", suffixes=("HOSPITAL", "CLINIC", "CENTER", "CENTRE", "HEALTH CENTER", "MEDICAL CENTER")),
    Rule("phi::hospital_abbreviations", Q, "ORGANIZATION", is_a="pii::organization"),
    Rule("phi::provider_npi", D, "ID_NUM", (_whole(_n(10)),), 0.05, "NPI", phrases=_w("npi,national provider identifier,provider {id|number},{billing|rendering} provider"), phrase_weight=0.85, anchor=_n(10)),
    Rule("phi::provider_tax_id_ein", D, "ID_NUM"),
    Rule("phi::dates", Q, "DATE", (_whole(_ISO), _whole(_SLASHED), _whole(_DASHED), _whole(_LONG, _MDY, loose=True), _whole(_SHORT, r"\.?", _MDY, loose=True)), 0.5, "DATE", phrases=_w(_DAY), anchor=r"\d"),
    Rule("phi::date_of_birth", D, "DATE_OF_BIRTH", validator="DATE", phrases=_w("birth{day| date},date of birth,dob,born[ {in|on}]"), phrase_weight=0.8, override=True, ner_weight=0.9),
    Rule("phi::date_of_death", D, "DATE", validator="DATE", phrases=_w("d{ied|od},died on,date of {death|expiration},deceased,death date,expired,passed {away|on},time of death"), phrase_weight=0.8, override=True, ner_weight=0.9),
    Rule("phi::timestamps", Q, "TIME", (_whole(_n(10)), _whole(_n(13))), 0.5, "UNIX_TIMESTAMP", anchor=_n(10)),
    Rule(
        "phi::relative_date_expressions", N, None,
        (
            _whole("today", loose=True), _whole("(?:tomorrow|yesterday)", loose=True), _whole(r"(?:past|last|this|next)\s+(?:week(?:end)?|month|quarter|year|morning|afternoon|evening|few\s+(?:day|week|month)s?)", loose=True),
            _whole(r"\d+\s+", _SPAN, r"\s+(?:ago|earlier|later|from\s+now)", loose=True), _whole(r"from(?:\s+the)?\s+\w+\s+today", loose=True),
        ),
        0.15, phrases=_w("patient,session,treatment,therapy,appointment,visit,came in,symptom,onset,presents,diagnosis,discharge,follow[-]up,clinic[al],lab,results,research,study,participant,sequencing,specimen"), phrase_weight=0.8,
    ),
    *(Rule(f"phi::{x}", B) for x in ("fingerprints", "retinal_scans", "voiceprints", "facial_photographs")),
    Rule("phi::dna_sequences", G),
    Rule(
        "phi::genomic_variants", G, None,
        (
            _whole(_any("APC APOE ATM BMPR1A BRAF BRCA[12] CDH1 CHEK2 EGFR EPCAM KRAS MEN1 MLH1 MSH[26] MTHFR MUTYH NBN NF[12] PALB2 PTEN RAD51[CD]? RET SMAD4 STK11 TP53 VHL")),
            _whole(r"[cgmnr]\.[0-9]+(?:[-+][0-9]+)?[ACGT]?>[ACGT]"), r"\bp[.][A-Z][a-z]{2}\d+(?:[*?]|[A-Z][a-z]{2})\b", _whole(r"(?:rs\d{5,}|[A-Z]\d+[A-Z])"), _whole("/".join(["[A-Z][0-9]+"] * 2)),
        ),
        0.75, phrases=_w("variant[ of uncertain significance],vus,mutation,allele,[likely ]pathogenic,benign,{hetero|homo}zygous,gen{e|etic|ome|omic|otype},locus,exome,snp,sequencing"),
    ),
    Rule("phi::certificate_license_number", D, "ID_NUM", phrases=_w("licen{c|s}e,license {no|number},{permit|registration} number,certifi{cate|cation|ed},board certified,credential,accreditation"), phrase_weight=0.6),
]
#: ends with the group of digits that completes 13, for a loop that may stop does so before it tries a blank
_CARD = r"(?:\d[ -]*?)" + "{13,19}"
FIN = [
    Rule("fin::credit_card_number", F_, "CREDIT_CARD", (r"(?<!\d)" + _CARD + r"(?!\d)", _whole(_CARD.replace(r"\d", r"[\dXx*#]")), _whole(r"(?:last\s+(?:four|4)\s+digits?|(?:card\s+)?ending\s+in)\s+", _n(4), loose=True)), 0.9, "LUHN_CHECKSUM", phrases=_w("credit card,card number,cc#,amex,discover,mastercard,visa,[card ]ending in,last {4|four} digits"), not_after=_w("cv{c|v}"), anchor=r"[\dXx*#][ -]*[\dXx*#][ -]*[\dXx*#][ -]*[\dXx*#]"),
    Rule("fin::cvv_code", F_, "CVV", (r"(?<![\d-])\b" + _n(3, 4) + r"\b(?![\d-])",), 0.05, phrases=_w("cv{c|v},{card|security|verification} code"), phrase_weight=0.85, anchor=_n(3)),
    Rule("fin::card_expiry_date", F_, None, (_whole(r"(?:1[0-2]|0[1-9])/", _n(2)),), 0.72, phrases=_w("exp[{ date|ires|iry|iration}],valid {thru|through|until},good thru,ending in,card ending"), phrase_weight=0.8, not_after=_w("birth[{day| date}],born,date of birth,dob"), not_before=("/",), anchor=r"\d/\d"),
    Rule("fin::bank_account_number", F_, "ACCOUNT_NUMBER", (_whole(_n(6, 17)),), 0.1, phrases=_w("a/c,acct,ach,[{bank|checking|current|savings} ]account,bank account number,account {ending|number},checking,savings,credited to,debit[ed from],deposit[ed to],direct deposit,routing[ and account],sent to account,sort code,transfer to,wire transfer"), phrase_weight=0.8, not_after=_w("ssn,social security,itin,ein,mrn,medical record,patient[ id],pat[-],res-,ins-,inv-,cust-,claim,policy,research,study,ticket"), before=80, after=25, anchor=_n(6)),
    Rule("fin::routing_number_aba", Q, "ACCOUNT_NUMBER", (r"(?<![\w-])" + _n(9) + r"(?![\w-])",), 0.22, "ABA_ROUTING_NUMBER", phrases=_w("aba,ach,bank,routing[ number],rtn,transit number,wire[ transfer]"), anchor=_n(9)),
    Rule("fin::iban", F_, "IBAN", (_whole("[A-Z]{2}", _n(2), "[A-Z0-9]{11,28}"),), 0.85, "IBAN", anchor=r"[A-Z]{2}\d\d"),
    Rule("fin::payment_transaction_id", F_, None, (_whole(_any("INV ORD PAY PMT PYMT REF TXN"), r"-\w{3,20}"),), 0.75, phrases=_w("[{payment|transaction} ]reference,payment,transaction[ id],invoice,order,receipt"), anchor="[A-Z]{3}-"),
    Rule("fin::crypto_wallet_address", F_, "BITCOIN_ADDRESS", (_whole("0x[0-9A-Fa-f]{40}"), _whole("(?:bc1[0-9a-z]{25,39}|[13][1-9A-HJ-NP-Za-km-z]{25,34})")), 0.8, phrases=_w("wallet[ address],crypto,bitcoin,btc,eth[ereum]"), phrase_weight=0.4, anchor="[0-9A-Za-z]{25}"),
    Rule("fin::swift_bic", F_, "BIC", (_whole("[A-Z]{6}[0-9A-Z]{2}(?:[0-9A-Z]{3})?"),), 0.15, phrases=_w("bic[ code],swift[ {bic|code}],swift/bic"), phrase_weight=0.85, anchor="[A-Z]{6}"),
]
DEFAULT_WEIGHT, DEFAULT_PHRASE_WEIGHT = 0.8, 0.4


def check(rules: list[Rule]) -> list[Rule]:
    """The rules, once they hold what the operators rely on; else an error."""
    ids = [r.entity_id for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError("two rules have the same entity_id")
    for r in rules:
        if r.validator and r.validator not in VALIDATORS:
            raise ValueError(f"{r.entity_id}: no validator {r.validator}")
        if r.data_class not in CLASSES:
            raise ValueError(f"{r.entity_id}: no class {r.data_class}")
        verb, _, level = r.default_action.partition(":")
        if verb not in ACTIONS:
            raise ValueError(f"{r.entity_id}: no action {verb}")
        if verb == "generalize" and (r.entity_id not in KINDS or level and level not in LADDERS[KINDS[r.entity_id]]):
            raise ValueError(f"{r.entity_id}: can't be generalized so")
        if r.weights and len(r.weights) != len(r.patterns):
            raise ValueError(f"{r.entity_id}: as many weights as patterns are needed")
    return rules


@lru_cache
def catalogue(ontologies: tuple = ("pii", "phi", "fin")) -> tuple[Rule, ...]:
    return tuple(check([r for o in ontologies for r in {"pii": PII, "phi": PHI, "fin": FIN}[o]]))


def only(*names: str) -> tuple[Rule, ...]:
    return tuple(r for r in catalogue() if r.name in names or r.entity_id in names)


def root(entity_id: str, rules: tuple[Rule, ...]) -> str:
    """The end of the chain of is_a; unknown parents and cycles stop it."""
    by, seen = {r.entity_id: r for r in rules}, {entity_id}
    while (r := by.get(entity_id)) and r.is_a in by and r.is_a not in seen:
        entity_id = r.is_a
        seen.add(entity_id)
    return entity_id


def without_validators(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    return tuple(replace(r, validator=None) for r in rules)


SCHEMA = "ord int, entity_id string, root_id string, entity string, ontology string, category string, data_class string, label string, weight double, validator string, validator_weight double, primary boolean, phrase_weight double, has_patterns boolean, is_a string, part_of string, not_after array<string>, not_before array<string>, not_like string, override boolean, ner_weight double, win_before int, win_after int, default_action string, kind string, pattern string"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """One row a rule; some 84 rows, so joins with it are broadcast."""
    rows = [
        (i, r.entity_id, root(r.entity_id, rules), r.name, r.ontology, r.category, r.data_class, r.label, r.weight, r.validator, r.validator_weight, r.primary, r.phrase_weight, bool(r.patterns), r.is_a, r.part_of, list(r.not_after), list(r.not_before), "|".join(f"(?:(?U){x})" for x in r.not_like) or None, r.override, r.ner_weight, r.before, r.after, r.default_action, KINDS.get(r.entity_id), "|".join(f"(?:{p})" for p in r.native) or None)
        for i, r in enumerate(rules)
    ]
    return small(spark, rows, SCHEMA)

