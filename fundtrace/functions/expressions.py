"""Column expressions shared by the queries."""

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundtrace.functions import reference_values as V


# White space of Unicode and the four separator controls, and the decimal digits of other scripts with their values, by rule.
_SPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def stripped(raw: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(raw, F.lit(_SPACE))


def ascii_digits(text: Column) -> Column:
    """Digits of any script as those of ASCII."""
    return F.translate(text, "".join(_DIGITS), _VALUES)


def bank_id(raw: Column) -> Column:
    """A bank id as an integer's text if it is all digits, of any script, else the stripped text."""
    text = stripped(raw)
    other = F.when(text.rlike(r"^\p{Nd}+$"), F.regexp_replace(ascii_digits(text), "^0+(?=.)", "")).otherwise(text)
    # Nearly all ids are ASCII digits as they stand: one regular expression and one trim.
    return F.when(raw.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(raw, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(other)


def is_usd() -> Column:
    return F.col("currency") == "US Dollar"


def is_wire_or_ach() -> Column:
    return F.col("fmt").isin("Wire", "ACH")


def in_text_window(window: tuple[str, str]) -> Column:
    """Inclusive comparison of the raw timestamp text; never parsed, never cast. Sources have stripped it, so the bare column reaches the scan."""
    return F.col("ts").between(*window)


def day() -> Column:
    return F.translate(F.substring("ts", 1, 10), "/", "-")


def in_conversion_days() -> Column:
    return day().between(*V.CONVERSION_DAYS)
