"""Pieces of the DuckDB SQL that the queries are compared with.

The patterns here are written for RE2 and apart from :mod:`rules`, so that a pattern that is missing or wrong there
shows.  RE2 knows no look-around and only ASCII boundaries: texts are read with every letter and digit outside ASCII as
an underscore, which is a word character too, and what look-around would say is asked of the characters beside.
"""

from __future__ import annotations

_MON = "april|august|december|february|january|july|june|march|may|november|october|september"
_MO = "apr|aug|dec|feb|jan|jul|jun|mar|may|nov|oct|sep"
_T = r"( +(at +)?[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?(\s*[AP]M)?(\s+[A-Z][A-Z]{1,3})?)?".replace(" +", r"\s+")
_YMD, _SL, _DA = r"\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", r"\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}\b"
_DATED = rf"(?i)\b({_MON})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}"
_DATED3 = rf"(?i)\b({_MO})[.]?\s+[0-9]{{1,2}},?\s+[0-9]{{4}}"
_TEL = r"(?:\+?1[-.\s]?|\+1\s*)?(?:\([0-9]{3}\)|[0-9]{3})[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
_OCTET = "(?:2[0-4][0-9]|25[0-5]|[01]?[0-9]?[0-9])"
_U = "(days|day|weeks|week|months|month|years|year)"

#: by entity: RE2 patterns; a tuple is a pattern and a condition on the match m and on what stands before (p, one character) and after it (n)
PATTERNS: dict[str, list] = {
    "pii::email_address": [r"\[?[a-zA-Z0-9.%+_-]+@[a-zA-Z0-9-.]+\.[a-zA-Z]{2,}\]?", r"\b[a-zA-Z0-9.%+_-]+\s*(\[at\]|\(at\))\s*[a-zA-Z0-9-.]+\s*(\[dot\]|\(dot\))\s*[a-zA-Z]{2,}\b"],
    "pii::phone_number": [_TEL],
    "pii::fax_number": [_TEL],
    "pii::ssn": [r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"],
    "pii::street_address": [
        r"\b[0-9]+(\s+[A-Z][[:alpha:]]+)+\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Place|Pl|Court|Ct|Parkway|Pkwy|Square|Sq|Terrace|Ter|Crescent|Cres|Way|Close|Grove|Mews)\b",
        r"(?i)\b(Apartment|Apt\.?|Building|Bldg\.?|Floor|Fl\.?|Room|Rm\.?|Suite|Ste\.?|Unit)\s+([0-9][A-Z0-9-]*|[A-Z][A-Z0-9-]*[0-9][A-Z0-9-]*)\b",
    ],
    "pii::county": [r"\b[A-Z][[:alpha:]]+\s+County\b"],
    "pii::zip_code": [r"\b[0-9]{5}(-[0-9]{4})?\b"],
    "pii::latitude_coordinates": [r"\b-?[0-9]{1,2}(\.[0-9]+)?\s*[SN]\b", r"\b-?[0-9]{1,2}\.[0-9]+\b"],
    "pii::longitude_coordinates": [r"\b-?[0-9]{1,3}(\.[0-9]+)?\s*[WE]\b", r"\b-?[0-9]{1,3}\.[0-9]+\b"],
    "pii::dates": [_YMD + _T + r"\b", _SL, _DA, _DATED + _T + r"\b", _DATED3 + _T + r"\b", rf"(?i)\b({_MON})\s+[0-9]{{1,2}}(th|st|nd|rd)\b", rf"(?i)\b({_MON})\s+[0-9]{{4}}\b", rf"(?i)\b[0-9]{{1,2}}(th|st|nd|rd)?\s+(of\s+)?({_MON}),?\s+[0-9]{{4}}\b"],
    "pii::age": [r"\b[0-9]{1,3}\s*(years|year|yrs\.?|yr\.?)\s*old\b", r"\b[0-9]{1,3}\s*y/?o\b", r"(?i)\bage:\s*[0-9]{1,3}\b", r"(?i)\bage\s+[0-9]{1,3}\b"],
    "pii::timestamps": [r"\b[0-9]{10}\b", r"\b[0-9]{13}\b", r"(?i)\b[0-9]{1,2}(:[0-9]{2})?\s*(pm|am)\b", r"\b(2[0-3]|[01]?[0-9]):[0-5][0-9]\b"],
    "pii::relative_date_expressions": [
        rf"(?i)\b((over|around|approximately|almost|about)\s+)?[0-9]+\s*[–-]?\s*{_U}\b", rf"(?i)\bfor\s+((approximately|almost|about)\s+)?[0-9]+\s+{_U}\b", r"(?i)\b(late|early|last|this)\s+(tonight|night|evening|afternoon|morning)\b", r"(?i)\blast\s+weekend\b",
        r"(?i)\b(tomorrow|today|yesterday)\b", r"(?i)\b(this|next|past|last)\s+(weekend|week|quarter|month|year)\b",
    ],
    "pii::imei_number": [r"\b[0-9]{15}\b"],
    "pii::mac_address": [r"\b[0-9a-fA-F]{2}([:-][0-9a-fA-F]{2}){5}\b"],
    "pii::ip_address": [rf"\b{_OCTET}(\.{_OCTET}){{3}}\b"],
    "pii::web_url": [r"\b(https?://(www\.)?|www\.)[[:alnum:]@:%._+~#=-]{1,256}\.[[:alnum:]()]{1,6}\b[[:alnum:]()@:%_+.~#?&/=-]*"],
    "pii::uuid_guid": [r"\b[[:xdigit:]]{8}(-[[:xdigit:]]{4}){3}-[[:xdigit:]]{12}\b", r"\b[[:xdigit:]]{32}\b"],
    "pii::vehicle_identification_number_vin": [r"\b[0-9A-HJ-NPR-Z]{17}\b"],
    "pii::us_passport_number": [r"\b[[:upper:]][0-9]{8}\b"],
    "pii::uk_passport_number": [r"\b[0-9]{9}\b"],
    "pii::canadian_passport_number": [r"\b[A-Z][A-Z][0-9]{6}\b"],
    "pii::indian_passport_number": [r"\b[[:upper:]][0-9]{7}\b"],
    "pii::australian_passport_number": [r"\b[A-Z][A-Z]?[0-9]{7}\b"],
    "pii::german_passport_number": [r"\b[CFGHJKLMNPRTVWXYZ0-9]{9}\b"],
    "pii::drivers_license_number": [r"\b[A-Z][0-9A-Z-]{5,14}\b"],
    "pii::uk_nhs_number": [r"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}\b"],
    "pii::canadian_social_insurance_number_sin": [r"\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{3}\b"],
    "pii::indian_aadhaar_number": [r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b"],
    "pii::us_itin": [r"\b9[0-9]{2}[ -]?[0-9]{2}[ -]?[0-9]{4}\b"],
    "pii::us_ein": [r"\b[0-9]{2}-[0-9]{7}\b"],
    "pii::account_reference_number": [r"\bACC-[0-9A-Za-z_]{1,15}\b"],
    "pii::unique_identifier": [r"\b(SUB|RES|POL|MEM|CUST|CLM)-[0-9A-Za-z_]{1,15}\b", r"\b[A-Z]{2,6}-[0-9]{3,}(-[0-9]{2,})*\b"],
    "phi::medical_record_number_mrn": [r"\b[0-9]{5,10}\b", (r"\b(BH-MRN|MRN|PAT|PTID)[\s:-]\s*[0-9A-Za-z_-]{4,12}\b", "regexp_matches(regexp_extract(m, '[\\s:-]\\s*(.*)$', 1) || regexp_extract(n, '^[0-9A-Za-z_-]*'), '[0-9]')"), (r"\b(RES|GEN|SUBJ|SUB)[\s:-]\s*[0-9A-Za-z_-]{1,12}\b", "regexp_matches(regexp_extract(m, '[\\s:-]\\s*(.*)$', 1) || regexp_extract(n, '^[0-9A-Za-z_-]*'), '[0-9]')")],
    "phi::health_plan_beneficiary_number": [r"\b(PLN|MEM|INS|HPB|GRP|BEN)-[0-9A-Za-z_]{1,15}\b", r"\b(WLP|UHC|SHP|MOL|KSR|HUM|CVH|CIG|BCBS|BCB|ANT|AET)-[0-9A-Za-z_]{1,15}\b"],
    "phi::claim_control_number": [r"\b(STUDY|GEN-STUDY|CLM|CCN|AUTH)-[0-9A-Za-z_-]{1,25}\b"],
    "phi::icd10_diagnosis_codes": [r"\b[A-TV-Z][[:digit:]][[:digit:][:upper:]](\.[[:digit:][:upper:]]{1,4})?\b"],
    "phi::cpt_procedure_codes": [r"\b[0-9]{5}\b"],
    "phi::medication_dosage": [r"\b[0-9]+(\.[0-9]+)?\s*(mg|mcg|mL|ml|kg|g|IU|units|unit|tablets|tablet|capsules|capsule|caps|cap)\b", r"\b[0-9]+(\.[0-9]+)?\s*(mg|mcg|mL|ml|g)\s*/\s*(kg/day|kg|day|hour|hr|dose|min)\b", r"(?i)\b([0-9]+\s*(x|times|time)\s+(per\s+day|daily|a\s+day)|(thrice|twice|once)\s+(per\s+day|daily|a\s+day))\b"],
    "phi::vital_signs": [r"\b[0-9]{2,3}/[0-9]{2,3}\b", r"\b[0-9]{2,3}\s*bpm\b", r"\b[0-9]{2,3}(\.[0-9])?\s*°?\s*[FC]\b", r"\b(100|9[0-9])\s*%\s*(SpO2|O2|oxygen|sat)?\b", r"\b[0-9]{1,2}\s*(breaths|breath|br)[\s/](minute|min)\b"],
    "phi::provider_npi": [r"\b[0-9]{10}\b"],
    "phi::dates": [_YMD + r"\b", _SL, _DA, _DATED + r"\b", _DATED3 + r"\b"],
    "phi::timestamps": [r"\b[0-9]{10}\b", r"\b[0-9]{13}\b"],
    "phi::relative_date_expressions": [r"(?i)\btoday\b", r"(?i)\b(tomorrow|yesterday)\b", r"(?i)\b(this|next|past|last)\s+(weekend|week|quarter|month|year|evening|afternoon|morning|few\s+(days|day|weeks|week|months|month))\b", rf"(?i)\b[0-9]+\s+{_U}\s+(later|earlier|from\s+now|ago)\b", r"(?i)\bfrom\s+(the\s+)?[0-9A-Za-z_]+\s+today\b"],
    "phi::genomic_variants": [
        r"\b(VHL|TP53|STK11|SMAD4|RET|RAD51C|RAD51D|RAD51|PTEN|PALB2|NF1|NF2|NBN|MUTYH|MTHFR|MSH2|MSH6|MLH1|MEN1|KRAS|EPCAM|EGFR|CHEK2|CDH1|BRCA1|BRCA2|BRAF|BMPR1A|ATM|APOE|APC)\b", r"\b[rnmgc]\.[0-9]+([-+][0-9]+)?[TGCA]?>[TGCA]\b", r"\bp\.[A-Z][a-z][a-z][0-9]+([*?]|[A-Z][a-z][a-z])\b", r"\b([A-Z][0-9]+[A-Z]|rs[0-9]{5,})\b", r"\b[A-Z][0-9]+/[A-Z][0-9]+\b",
    ],
    "fin::credit_card_number": ["<digits>", r"\b(?:[0-9Xx*#][ -]*?){13,19}\b", r"(?i)(?:\b(?:card\s+)?ending\s+in|\blast\s+(?:four|4)\s+digits?)\s+[0-9]{4}\b"],
    "fin::cvv_code": [(r"\b[0-9]{3,4}\b", "p NOT IN ('-') AND n[1] NOT IN ('-')")],
    "fin::card_expiry_date": [r"\b(1[0-2]|0[1-9])/[0-9]{2}\b"],
    "fin::bank_account_number": [r"\b[0-9]{6,17}\b"],
    "fin::routing_number_aba": [(r"\b[0-9]{9}\b", "p <> '-' AND n[1] <> '-'")],
    "fin::iban": [r"\b[[:upper:]]{2}[0-9]{2}[0-9A-Z]{11,28}\b"],
    "fin::payment_transaction_id": [r"\b(TXN|REF|PYMT|PMT|PAY|ORD|INV)-[0-9A-Za-z_]{3,20}\b"],
    "fin::crypto_wallet_address": [r"\b0x[0-9a-fA-F]{40}\b", r"\b(bc1[0-9a-z]{25,39}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b"],
    "fin::swift_bic": [r"\b[A-Z]{6}[0-9A-Z]{2}([0-9A-Z]{3})?\b"],
}
#: what may not stand right before or after a span
BEFORE = {
    "pii::phone_number": "account|account number|acct|transfer to account|transfer to|checking account|savings account", "pii::ssn": "mrn|medical record|account|employee|emp|member|customer|license", "phi::medical_record_number_mrn": "ssn|social security", "phi::vital_signs": "expires|exp|expiry|expiration|valid thru|valid through|valid until",
    "fin::credit_card_number": "cvv|cvc", "fin::card_expiry_date": "date of birth|dob|born|birth date|birthday|birth", "fin::bank_account_number": "ssn|social security|itin|ein|mrn|medical record|patient id|patient|pat|pat-|res-|ins-|inv-|cust-|ticket|policy|claim|research|study",
}
AFTER = {"pii::ssn": "digits|digit", "phi::vital_signs": "/", "fin::card_expiry_date": "/"}
EVERY = tuple(PATTERNS)


def full(name: str) -> str:
    return next(e for e in PATTERNS if name in (e, e.split("::")[1]))


def ascii_only(c: str, other: str) -> str:
    """As many characters; letters and digits outside ASCII as ``other``, wide spaces as spaces."""
    return rf"regexp_replace(regexp_replace({c}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}]', '{other}', 'g'), '\p{{Z}}', ' ', 'g')"


def _pieces(p: str, key: str, text: str, table: str) -> str:
    """(key, t0, start, end, m): running lengths of pieces and matches give the offsets."""
    p = p.replace("'", "''")
    return f"""SELECT {key}, t0, CAST(before + upto AS BIGINT) AS start, CAST(before + upto + length(m) AS BIGINT) AS "end", m FROM (
      SELECT {key}, t0, m, sum(length(pre)) OVER (PARTITION BY {key} ORDER BY i) AS before, coalesce(sum(length(m)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM (SELECT {key}, t0, unnest(ms) AS m, unnest(s[1:len(ms)]) AS pre, unnest(range(len(ms))) AS i
        FROM (SELECT {key}, {text} AS t0, regexp_extract_all({text}, '{p}') AS ms, regexp_split_to_array({text}, '{p}') AS s FROM {table}) WHERE len(ms) > 0))"""


def _cards(key: str, text: str, table: str) -> str:
    """Stretches of 13 to 19 digits with blanks and dashes between: groups of digits, taken from the left up to the one that completes 13."""
    return f"""SELECT {key}, t0, a AS start, b AS "end", substr(t0, a + 1, b - a) AS m FROM (
      WITH RECURSIVE runs AS (SELECT {key}, t0, start, m FROM ({_pieces("[0-9]([ -]*[0-9])*", key, text, table)}) WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) >= 13),
      g AS (SELECT {key}, t0, start AS run, m, list_transform(range(1, length(m) + 1), lambda i: CASE WHEN regexp_matches(m[i], '[0-9]') AND (i = 1 OR NOT regexp_matches(m[i - 1], '[0-9]')) THEN i ELSE 0 END) AS st FROM runs),
      e AS (SELECT {key}, t0, run, m, unnest(list_filter(st, lambda i: i > 0)) AS i FROM g),
      c AS (SELECT {key}, t0, run, i, min(j) AS j FROM (SELECT {key}, t0, run, m, i, unnest(range(i, length(m) + 1)) AS j FROM e) WHERE regexp_matches(m[j], '[0-9]') AND (j = length(m) OR NOT regexp_matches(m[j + 1], '[0-9]')) AND length(regexp_replace(m[i:j], '[^0-9]', '', 'g')) BETWEEN 13 AND 19 GROUP BY {key}, t0, run, i),
      w AS (SELECT {key}, t0, run, min_by(j, i) AS j, min(i) AS i FROM c GROUP BY {key}, t0, run
        UNION ALL SELECT w.{key}, w.t0, w.run, n.j, n.i FROM w, LATERAL (SELECT min(c.i) AS i, min_by(c.j, c.i) AS j FROM c WHERE c.{key} = w.{key} AND c.run = w.run AND c.i > w.j) n WHERE n.i IS NOT NULL)
      SELECT {key}, t0, CAST(run + i - 1 AS BIGINT) AS a, CAST(run + j AS BIGINT) AS b FROM w)"""


def spans(name: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """(key, start, end, text) of an entity's matches, each span once, those in a refused place left out."""
    entity = full(name)
    outside = "¤" if entity in ("pii::email_address", "pii::web_url") else "_"
    at = f"(SELECT {key}, {ascii_only(text, outside)} AS {text} FROM {table} WHERE {text} IS NOT NULL)"
    parts = []
    for p in PATTERNS[entity]:
        p, condition = p if isinstance(p, tuple) else (p, "true")
        rows = _cards(key, text, at) if p == "<digits>" else _pieces(p, key, text, at)
        parts.append(f"""SELECT {key}, start, "end" FROM (SELECT {key}, start, "end", m, t0, CASE WHEN start > 0 THEN substr(t0, start, 1) ELSE '' END AS p, substr(t0, "end" + 1, 50) AS n FROM ({rows})) WHERE {condition}""")
    left, right = r"regexp_replace(lower(substr(d.{0}, CAST(greatest(s.start - 49, 1) AS INT), CAST(least(s.start, 50) AS INT))), '\s+$', '')".format(text), r"""regexp_replace(lower(substr(d.{0}, CAST(s."end" + 1 AS INT), 50)), '^\s+', '')""".format(text)
    quoted = lambda x: x.replace("'", "''")
    refused = [f"NOT ends_with({left}, '{quoted(x)}')" for x in BEFORE.get(entity, "").split("|") if x] + [f"NOT starts_with({right}, '{quoted(x)}')" for x in AFTER.get(entity, "").split("|") if x]
    return f"""(SELECT s.{key}, s.start, s."end", substr(d.{text}, CAST(s.start + 1 AS INT), CAST(s."end" - s.start AS INT)) AS text FROM ({" UNION ".join(parts)}) s JOIN {table} d ON s.{key} = d.{key} WHERE {" AND ".join(refused) or "true"})"""


def every_span(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """(key, start, end, entity_id) of the whole catalogue."""
    return "(" + " UNION ALL ".join(f"""SELECT {key}, start, "end", '{e}' AS entity_id FROM {spans(e, table, key, text)}""" for e in EVERY) + ")"


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def luhn(d: str, n: int) -> str:
    """For a string of exactly n digits."""
    parts = []
    for i in range(n):
        x = f"CAST(substr({d}, {i + 1}, 1) AS INT)"
        parts.append(f"(CASE WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END)" if (n - i) % 2 == 0 else x)
    return "((" + " + ".join(parts) + ") % 10 = 0)"


def luhn_any(d: str) -> str:
    """For a string of any number of digits."""
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST({d}[i] AS INT) WHEN CAST({d}[i] AS INT) > 4 THEN CAST({d}[i] AS INT) * 2 - 9 ELSE CAST({d}[i] AS INT) * 2 END)) % 10 = 0)"


def weighted(d: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def phone_ok(c: str) -> str:
    d = f"regexp_replace({digits(c)}, '^1([0-9]{{10}})$', '\\1')"
    return f"(regexp_matches({d}, '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') AND NOT regexp_matches({d}, '^([0-9]11|[0-9]{{3}}[0-9]11)'))"


def ip_ok(c: str) -> str:
    return "(" + " AND ".join(f"CAST(split_part({c}, '.', {i}) AS INT) <= 255" for i in range(1, 5)) + ")"


#: entity, its check, its confidence if passed and if failed, its label
FOUND = {
    "email_address": (None, 0.9, 0.9, "EMAIL"), "phone_number": (phone_ok, 0.88, 0.28 * 0.55 + 0.32 * 0.88, "PHONE"), "ip_address": (ip_ok, 0.95, 0.48, "IP_ADDRESS"),
    "credit_card_number": (lambda c: luhn_any(digits(c)), 0.95, 0.48, "CREDIT_CARD"), "zip_code": (lambda c: "true", 0.83, 0.429, "ZIPCODE"), "fax_number": (phone_ok, 0.88, 0.28 * 0.55 + 0.32 * 0.88, "PHONE"),
    "bank_account_number": (None, 0.1, 0.1, "ACCOUNT_NUMBER"), "cvv_code": (None, 0.05, 0.05, "CVV"),
}
FOUR = ("email_address", "phone_number", "ip_address", "credit_card_number")


def found(names: tuple[str, ...] = FOUR) -> str:
    """(doc_id, start, end, text, entity, valid, confidence) of the named rules."""
    out = []
    for n in names:
        check, ok, bad, _ = FOUND[n]
        valid = check("s.text") if check else "CAST(NULL AS BOOLEAN)"
        out.append(f"""SELECT s.doc_id, s.start, s."end", s.text, '{n}' AS entity, {valid} AS valid, CASE WHEN {valid} THEN {ok} ELSE {bad if check else ok} END AS confidence FROM {spans(n)} s""")
    return "(" + " UNION ALL ".join(out) + ")"
