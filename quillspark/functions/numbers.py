"""Numbers and dates of spreadsheets as text."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, let

#: The built-in number format ids that are dates or times.
DATE_FORMAT_IDS = [*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)]
LAST_SERIAL = 2_958_465  # 9999-12-31


def format_number(c) -> Column:
    """Whole numbers below 2^53 without a point, others with up to ten decimals: the exact binary value
    rounded, halves to even, as exact_number() does for one value (from 2^63 on, the shortest form's digits)."""
    c = _c(c).cast("double")
    size = F.abs(c)
    units = F.floor(size).cast("long")
    shown = lambda n: F.concat(F.when(c < 0, "-").otherwise(""), (units + F.when(n == 10**10, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % 10**10).cast("string"), 10, "0"))
    cut = F.regexp_replace(let(size - units.cast("double"), lambda part: let(_ten_decimals(part), shown)), r"\.?0+\z", "")
    fixed = F.regexp_replace(F.format_string("%.10f", c), r"\.0+\z", "")
    return (
        F.when(F.isnan(c), "NaN")
        .when(c == float("inf"), "inf")
        .when(c == float("-inf"), "-inf")
        .when((F.floor(c).cast("double") == c) & (size < float(1 << 62)), c.cast("long").cast("string"))
        .when(size < float(1 << 53), cut)
        .otherwise(fixed)
    )


def _ten_decimals(part: Column) -> Column:
    """A fraction of 0 to 1, which is exact in a double, in units of 10^-10, halves to even.  Its product with 10^10
    is exact together with the product's rounding error, which Dekker's splitting gives."""
    scale, split = 1e10, float((1 << 27) + 1)
    scale_high = split * scale - (split * scale - scale)
    scale_low = scale - scale_high
    product, below = part * scale, F.floor(part * scale)

    def error(high):
        low = part - high
        return ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low

    beyond = (product - below.cast("double") - 0.5) + let(split * part - (split * part - part), error)  # half a unit
    return below.cast("long") + F.when(beyond >= F.when(below % 2 == 1, 0.0).otherwise(5e-324), 1).otherwise(0)


def exact_number(x: float) -> str:
    """format_number() for one value, by its exact binary expansion."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1 << 53:
        return str(int(x))
    return ("%.10f" % x).rstrip("0").rstrip(".")


def shortest_number(c) -> Column:
    """Whole numbers below 1e15 as such; others as their shortest decimal form, never with an exponent."""
    c = _c(c).cast("double")
    whole = (F.floor(c).cast("double") == c) & (F.abs(c) < 1e15)
    text = c.cast("string")
    power = F.coalesce(F.regexp_extract(text, r"E(-?\d+)\z", 1).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.regexp_extract(text, r"\A-?(\d+\.?\d*)", 1), r"\.0\z", "")
    sign = F.when(c < 0, "-").otherwise("")
    frac = F.char_length(F.regexp_extract(digits, r"\.(\d*)", 1))
    bare = F.replace(digits, F.lit("."), F.lit(""))
    up = F.concat(sign, bare, F.repeat(F.lit("0"), F.greatest(power - frac, F.lit(0))))
    down = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), bare)
    return (
        F.when(F.isnan(c), "NaN")
        .when(c == float("inf"), "inf")
        .when(c == float("-inf"), "-inf")
        .when(whole, F.floor(c).cast("string"))
        .when(power > 0, up)
        .when(power < 0, down)
        .otherwise(F.regexp_replace(text, r"\.0\z", ""))
    )


def is_date_format_id(c) -> Column:
    return _c(c).isin(DATE_FORMAT_IDS)


def is_date_format_code(c) -> Column:
    """A custom code with a date or time letter and no digit placeholder, outside quotes and escapes."""
    bare = F.regexp_replace(F.regexp_replace(_c(c), r"(?s)\\.?", ""), r'(?s)"[^"]*("|\z)', "")
    return bare.rlike("(?i)[ydhsm]") & ~bare.rlike("[0#?]")


def hms(fraction) -> Column:
    """HH:MM:SS of a day's fraction; 24:00:00 wraps without a day's carry."""
    s = F.floor(_c(fraction) * 86400.0 + 0.5).cast("long")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(s / 3600) % 24), part(F.floor(s % 3600 / 60)), part(s % 60))


def serial_date(day) -> Column:
    """The date of a whole serial: day 1 is 1900-01-01, and 60 is the leap day that 1900 never had."""
    day = _c(day).cast("int")
    real = F.date_add(F.when(day < 60, F.lit("1899-12-31").cast("date")).otherwise(F.lit("1899-12-30").cast("date")), day)
    return F.when(day == 60, "1900-02-29").otherwise(F.date_format(real, "yyyy-MM-dd"))


def serial_to_iso(c) -> Column:
    """A spreadsheet date serial as YYYY-MM-DD[ HH:MM:SS] or HH:MM:SS; out of range, as a number."""
    c = _c(c).cast("double")
    day = F.floor(c)
    frac = c - day.cast("double")
    safe = F.when((c >= 1) & (c < LAST_SERIAL + 1), day).otherwise(1)
    date = serial_date(safe)
    return (
        F.when((c < 0) | F.isnan(c) | (c == float("inf")), shortest_number(c))
        .when((day == 0) & (frac > 0), hms(frac))
        .when((day == 0) | (day > LAST_SERIAL), shortest_number(c))
        .when(F.abs(frac) < 1e-10, date)
        .otherwise(F.concat(date, F.lit(" "), hms(frac)))
    )


def rk_value(rk) -> Column:
    """An RK-encoded number (unsigned 32 bits in a long).  Bit 1: integer; bit 0: hundredths; else the
    high word of a double, whose parts are read off with shifts."""
    rk = _c(rk).cast("long")
    signed = F.when(rk >= 1 << 31, rk - (1 << 32)).otherwise(rk)
    whole = F.shiftright(signed, 2).cast("double")
    high = rk.bitwiseAND(F.lit(0xFFFFFFFC).cast("long"))
    sign = F.when(high >= 1 << 31, -1.0).otherwise(1.0)
    power = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF).cast("long")).cast("int")
    fraction = high.bitwiseAND(F.lit(0xFFFFF).cast("long")).cast("double") / float(1 << 20)
    normal = sign * (fraction + 1.0) * F.pow(F.lit(2.0), (power - 1023).cast("double"))
    tiny = sign * fraction * F.pow(F.lit(2.0), F.lit(-1022.0))
    double = F.when(power == 0, tiny).when((power == 2047) & (fraction == 0), sign * float("inf")).when(power == 2047, float("nan")).otherwise(normal)
    value = F.when(rk.bitwiseAND(F.lit(2).cast("long")) != 0, whole).otherwise(double)
    return F.when(rk.bitwiseAND(F.lit(1).cast("long")) != 0, value / 100.0).otherwise(value)


def rk_number(rk: int) -> float:
    """rk_value() for one value."""
    value = float((rk - (1 << 32) if rk >> 31 else rk) >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100.0 if rk & 1 else value


def parse_number(c) -> Column:
    """A decimal number without surrounding space; else null."""
    c = _c(c)
    return F.when(c.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), c.try_cast("double"))
