"""Coarser forms of ages, dates, postcodes and coordinates, and how precise a value still is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validators import digits, to_date

LADDERS = {"coordinates": ("1dp", "int"), "zip": ("3-digit", "1-digit"), "age": ("5y", "10y", "20y"), "date": ("month", "year", "decade")}
DEFAULT_LEVEL = {"age": "10y", "date": "year", "zip": "3-digit", "coordinates": "1dp"}
KINDS = {"pii::age": "age", "pii::dates": "date", "phi::dates": "date", "phi::date_of_birth": "date", "phi::date_of_death": "date", "pii::zip_code": "zip", "pii::latitude_coordinates": "coordinates", "pii::longitude_coordinates": "coordinates"}


def age(c: Column, level: str) -> Column:
    """Bands of 5, 10 or 20 years; 90 and above are one band."""
    width = int(level.rstrip("y"))
    v = F.nullif(F.regexp_extract(c, "[0-9]+", 0), F.lit("")).try_cast("int")
    lo = F.floor(v / width) * width
    return F.when(v >= 90, "90+").when(v.isNotNull(), F.concat(lo.cast("string"), F.lit("-"), (lo + width - 1).cast("string")))


def date(c: Column, level: str) -> Column:
    d = to_date(c)
    if level == "decade":
        return F.concat((F.floor(F.year(d) / 10) * 10).cast("string"), F.lit("s"))
    return F.date_format(d, "yyyy-MM" if level == "month" else "yyyy")


def zip_code(c: Column, level: str) -> Column:
    d, n = digits(c), int(level[0])
    return F.when(F.length(d) >= n, F.rpad(F.substring(d, 1, n), 5, "*"))


def coordinates(c: Column, level: str) -> Column:
    """Rounded by the number's exact binary value, halves to even."""
    v = F.trim(c).try_cast("double")
    sign, whole = F.when((v < 0) | ((v == 0) & F.startswith(F.trim(c), F.lit("-"))), "-").otherwise(""), F.floor(F.abs(v))
    if level == "int":
        return F.concat(sign, F.bround(F.abs(v), 0).cast("long").cast("string"))
    # ten times the fraction, in units of 2^-58: a double times 10 would be rounded, to a half that it isn't; what is cut off is of fractions under 2^-5, which give 0
    unit = 1 << 58
    part = ((F.abs(v) - whole) * float(unit)).cast("long") * 10
    down, rest = F.shiftright(part, 58), part.bitwiseAND(F.lit(unit - 1))
    up = (rest > unit // 2) | ((rest == unit // 2) & (down % 2 == 1))
    tenths = whole * 10 + down + up.cast("long")
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


_RUNGS = {"age": age, "date": date, "zip": zip_code, "coordinates": coordinates}


def generalize(kind: str, c: Column, level: str | None = None) -> Column:
    """Null where the value can't be read; an unknown level is an error, an unknown kind gives null."""
    if kind not in _RUNGS:
        return F.lit(None).cast("string")
    level = level or DEFAULT_LEVEL[kind]
    if level in LADDERS[kind]:
        return _RUNGS[kind](c, level)
    raise ValueError(f"{kind} has no level {level}")


def generalize_by(kind: Column, level: Column, c: Column) -> Column:
    """As :func:`generalize`, with kind and level from columns."""
    out = F.lit(None).cast("string")
    for k, levels in LADDERS.items():
        for x in levels:
            out = F.when((kind == k) & (F.coalesce(level, F.lit(DEFAULT_LEVEL[k])) == x), generalize(k, c, x)).otherwise(out)
    return out


def precision(kind: Column, c: Column) -> Column:
    """Share of a value's severity that its own precision leaves."""
    t = F.trim(c)
    lo, hi = F.regexp_extract(t, r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(t, r"^(\d+)-(\d+)$", 2).try_cast("int")
    width = hi - lo + 1
    band = F.when(width == 10, 0.6).when(width == 20, 0.4).otherwise(0.8)
    by_age = F.when(t == "90+", 0.4).when(t.rlike(r"^\d+-\d+$"), band).otherwise(1.0)
    by_date = F.when(t.rlike(r"^\d{3}0s$"), 0.4).when(t.rlike(r"^\d{4}$"), 0.6).when(t.rlike(r"^\d{4}-\d{2}$"), 0.8).otherwise(1.0)
    by_zip = F.when(t.rlike(r"^\d{3}\*\*$"), 0.6).when(t.rlike(r"^\d\*{4}$"), 0.3).otherwise(1.0)
    by_place = F.when(t.rlike(r"^-?\d+$"), 0.3).when(t.rlike(r"^-?\d+\.\d$"), 0.6).otherwise(1.0)
    return F.when(kind == "age", by_age).when(kind == "date", by_date).when(kind == "zip", by_zip).when(kind == "coordinates", by_place).otherwise(1.0)
