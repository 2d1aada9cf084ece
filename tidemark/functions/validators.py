"""Checks of identifiers as boolean columns; a null or unparsable value is false."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _weighted(d: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(d, i + 1, 1).cast("int") * w
    return total


def _one_digit(d: Column) -> Column:
    return d.rlike(r"^(\d)\1*$")


def phone_us(c: Column) -> Column:
    d = F.regexp_replace(digits(c), "^1(?=[0-9]{10}$)", "")
    return d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") & ~d.rlike("^([0-9]11|[0-9]{3}[0-9]11)")


def e164(c: Column) -> Column:
    return c.rlike(r"^\+[1-9][0-9]{6,14}$")


def us_ssn(c: Column) -> Column:
    d = digits(c)
    return d.rlike("^[0-8][0-9]{8}$") & ~d.rlike("^(000|666)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def us_itin(c: Column) -> Column:
    return digits(c).rlike("^9[0-9]{2}[78][0-9]{5}$")


def canadian_sin(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 9) & ~_one_digit(d)


def indian_aadhaar(c: Column) -> Column:
    d = digits(c)
    return d.rlike("^[2-9][0-9]{11}$") & ~_one_digit(d)


def uk_nhs(c: Column) -> Column:
    d = digits(c)
    check = 11 - _weighted(d, list(range(10, 1, -1))) % 11
    check = F.when(check == 11, 0).otherwise(check)
    return (F.length(d) == 10) & (check != 10) & (check == F.substring(d, 10, 1).cast("int"))


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", digits(c))


def npi(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 10) & F.call_function("luhn_check", F.concat(F.lit("80840"), d))


def aba_routing(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 9) & (_weighted(d, [3, 7, 1] * 3) % 10 == 0)


def iban(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise((a * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97))
    return s.rlike("^[A-Z]{2}[A-Z0-9]{13,32}$") & (rest == 1)


def imei(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 15) & F.call_function("luhn_check", d)


def vin(c: Column) -> Column:
    return F.upper(c).rlike("^[A-HJ-NPR-Z0-9]{17}$")


def ipv4(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda x: x.rlike("^[0-9]+$") & (F.try_to_number(x, F.lit("999999999")) <= 255))


def web_url(c: Column) -> Column:
    whole = F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("http://"), c))
    return whole.rlike(r"(?i)^https?://([^\s/@]+@)?[^\s/:?#.]+(\.[^\s/:?#.]+)*\.[^\s/:?#.]{2,}([:/?#]\S*)?$")


def _degrees(c: Column, letters: str, most: int) -> Column:
    v = F.trim(F.regexp_replace(F.upper(c), f"[{letters}°]", "")).try_cast("double")
    return v.between(-most, most)


def latitude(c: Column) -> Column:
    return _degrees(c, "NS", 90)


def longitude(c: Column) -> Column:
    return _degrees(c, "EW", 180)


DATE_FORMATS = ("y-M-d", "M/d/yy", "M/d/y", "d/M/yy", "d/M/y", "M-d-yy", "M-d-y", "d-M-yy", "d-M-y", "MMM d y", "d MMM y", "MMM y", "y/M/d", "d.M.y", "yyyyMMdd")
_NO_YEAR = r"^[A-Z][a-z]{2} \d{1,2}$"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def to_date(c: Column) -> Column:
    """The date that one of the known formats reads in the value, else null; never depends on today."""
    s = F.regexp_replace(F.trim(c), r"(?i)(?<=\d)(st|nd|rd|th)\b", "")
    # a time of day after the date, commas, "of" and all but the first letters of a month say nothing about the day
    s = F.regexp_replace(s, r"(?i)(\s+at)?[\sT]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(\s*[ap]\.?m\.?)?(\s*[a-z]{1,5})?$", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)\bof\b|,", " "), r"\s+", " "))
    month = F.lower(F.regexp_extract(s, rf"(?i)\b({'|'.join(_MONTHS)})[a-z]*", 1))
    s = F.when(month != "", F.regexp_replace(s, rf"(?i)\b({'|'.join(_MONTHS)})[a-z]*\.?", F.initcap(month))).otherwise(s)
    return F.when(~s.rlike(_NO_YEAR), F.coalesce(*(F.try_to_timestamp(s, F.lit(f)).cast("date") for f in DATE_FORMATS)))


def date(c: Column) -> Column:
    """A date, or a month and a day of it."""
    day = F.trim(F.regexp_replace(c, r"(?i)(?<=\d)(st|nd|rd|th)\b", ""))
    of = F.concat(F.initcap(F.substring(day, 1, 3)), F.lit(" "), F.regexp_extract(day, r"\d{1,2}$", 0), F.lit(" 2000"))
    return to_date(c).isNotNull() | (day.rlike(rf"(?i)^({'|'.join(_MONTHS)})[a-z]*\.?\s+\d{{1,2}}$") & F.try_to_timestamp(of, F.lit("MMM d y")).isNotNull())


def date_year_range(c: Column) -> Column:
    return F.year(to_date(c)).between(1900, 2100)


def unix_timestamp(c: Column) -> Column:
    d = F.trim(c)
    return (d.rlike("^[0-9]{10}$") & (d.try_cast("long") <= 978307200)) | (d.rlike("^[0-9]{13}$") & (d.try_cast("long") / 1000 <= 978307200))


def timestamp(c: Column) -> Column:
    s = F.trim(c)
    return unix_timestamp(c) | s.rlike(r"(?i)^(0?[1-9]|1[0-2])(:[0-5]\d){0,2}\s*[ap]\.?m\.?$") | s.rlike(r"^([01]?\d|2[0-3])(:[0-5]\d){1,2}$")


def postal_code(c: Column) -> Column:
    return F.lit(True)


def insurance_id(c: Column) -> Column:
    s = F.regexp_replace(c, r"[\s-]", "")
    return s.rlike("^[A-Za-z0-9]{8,15}$") & s.rlike("[0-9]") & s.rlike("[A-Za-z]")


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "PHONE_US": phone_us, "E164": e164, "US_SSN": us_ssn, "US_ITIN": us_itin, "CANADIAN_SIN": canadian_sin, "INDIAN_AADHAAR": indian_aadhaar,
    "UK_NHS": uk_nhs, "NPI": npi, "LUHN_CHECKSUM": luhn, "ABA_ROUTING_NUMBER": aba_routing, "IBAN": iban, "IMEI": imei, "VIN": vin, "IPV4_RANGE": ipv4,
    "WEB_URL": web_url, "LATITUDE": latitude, "LONGITUDE": longitude, "DATE": date, "DATE_YEAR_RANGE": date_year_range, "UNIX_TIMESTAMP": unix_timestamp,
    "TIMESTAMP": timestamp, "POSTAL_CODE_FORMAT": postal_code, "INSURANCE_ID": insurance_id,
}


def passes(name: Column, value: Column, only: list[str] | None = None) -> Column:
    """Whether the value passes the check that the other column names; null where none is named."""
    out = F.lit(None).cast("boolean")
    for k in reversed(only or list(VALIDATORS)):
        out = F.when(name == k, F.coalesce(VALIDATORS[k](value), F.lit(False))).otherwise(out)
    return out
