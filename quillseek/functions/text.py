"""Text functions, as columns where Spark has what they need and as Python functions for patterns."""

from __future__ import annotations

import math
import re
import unicodedata
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, as the inside of a character class.
TRIMMED = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: What separates words when a field's length is counted.
WORD_BREAKS = "\\t-\\r \\u00a0"
#: Letters that have no canonical decomposition and their plain forms.
PLAIN = {"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i", "ß": "ss"}
#: Fixed value: the default token, letters, marks, numbers and underscores.
TOKEN = r"[\p{L}\p{M}\p{N}_]+"

_BLANK = re.compile(f"[{TRIMMED}]*")
_PLAIN = str.maketrans(PLAIN)


def is_blank(text: str) -> bool:
    return _BLANK.fullmatch(text) is not None


def trim(text: str) -> str:
    return re.sub(f"^[{TRIMMED}]+|[{TRIMMED}]+$", "", text)


def _is_mark(char: str) -> bool:
    """Combining marks of the Basic Multilingual Plane."""
    return unicodedata.category(char)[0] == "M" and ord(char) < 0x10000


def strip_diacritics(text: str) -> str:
    if text.isascii():
        return text
    split = unicodedata.normalize("NFD", text)
    return "".join([c for c in split if c < "\u0300" or not _is_mark(c)]).translate(_PLAIN)


def fold(text: str, is_case_sensitive: bool, ignore_diacritics: bool) -> str:
    """A pattern or text as it is compared."""
    if not is_case_sensitive:
        text = text.lower()
    return strip_diacritics(text) if ignore_diacritics else text


def number_text(value: float | None) -> str | None:
    """A double in its shortest decimal form, with an exponent only below 1e-6 and from 1e21 on."""
    if value is None:
        return None
    if math.isnan(value) or math.isinf(value):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
    sign, places, exponent = Decimal(repr(value)).normalize().as_tuple()
    minus, digits = "-" * sign, "".join(map(str, places))
    point = len(digits) + exponent
    if not value:
        return minus + "0"
    if point > 21 or point <= -6:
        return f"{minus}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{point - 1:+d}"
    if point <= 0:
        return f"{minus}0.{'0' * -point}{digits}"
    return minus + digits.ljust(point, "0")[:point] + (f".{digits[point:]}" if len(digits) > point else "")


def not_blank(column: Column) -> Column:
    return column.rlike(f"[^{TRIMMED}]")


def word_count(column: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(column, F.lit(f"[^{WORD_BREAKS}]+")))


def length_norm(column: Column, weight: float = 1.0) -> Column:
    """1 / words^(weight / 2), to three decimals."""
    return F.floor(F.lit(1000.0) / F.pow(word_count(column).cast("double"), F.lit(0.5 * weight)) + 0.5) / F.lit(1000.0)


def tokens(column: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
