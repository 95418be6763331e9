"""Terms: what one pattern asks of one text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillseek.functions.kernel import Fuzzy
from quillseek.options import Options

RANGES = "array<struct<start: int, end: int>>"


@dataclass(frozen=True)
class Term:
    """kind: exact, include, prefix, suffix, not_include, not_prefix, not_suffix or fuzzy.  value is folded."""

    kind: str
    value: str

    @property
    def inverse(self) -> bool:
        return self.kind.startswith("not_")

    @property
    def native(self) -> bool:
        return self.kind != "fuzzy"

    def holds(self, text: Column) -> Column:
        """Whether a folded text satisfies a native term."""
        value, kind = F.lit(self.value), self.kind.removeprefix("not_")
        if kind == "exact":
            found = text == value
        elif kind == "include":
            found = F.contains(text, value) if self.value else F.lit(self.inverse)
        elif kind == "prefix":
            found = F.startswith(text, value)
        else:
            found = F.endswith(text, value)
        return ~found if self.inverse else found

    def ranges(self, text: Column) -> Column:
        """The places of a native term in a folded text that satisfies it, in UTF-16 units."""
        n, m = utf16_length(text), utf16_width(self.value)
        if self.kind == "include":
            return occurrences(text, self.value)
        if self.kind in ("exact", "prefix"):
            start, end = F.lit(0), F.lit(m - 1)
        elif self.kind == "suffix":
            start, end = n - m, n - 1
        else:
            start, end = F.lit(0), n - 1
        return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))

    def fuzzy(self, options: Options) -> Fuzzy:
        return fuzzy_of(self.value, options)


def fuzzy_of(folded: str, options: Options, ignore_location: bool | None = None) -> Fuzzy:
    return Fuzzy(
        folded,
        options.location,
        options.threshold,
        options.distance,
        options.find_all_matches,
        options.min_match_char_length,
        options.include_matches,
        options.ignore_location if ignore_location is None else ignore_location,
    )


def utf16_width(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def utf16_length(text: Column) -> Column:
    """Characters beyond the Basic Multilingual Plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def occurrences(text: Column, value: str) -> Column:
    """Ranges of the occurrences of value, from the left and without overlaps."""
    width = utf16_width(value)
    pieces = F.split(text, r"\Q" + value.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
    # An occurrence starts where all pieces and occurrences before it end.
    gaps = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), utf16_length)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS {RANGES})").alias("found"))
    step = lambda acc, gap: F.struct(
        (acc["at"] + gap + width).alias("at"),
        F.concat(acc["found"], F.array(F.struct((acc["at"] + gap).alias("start"), (acc["at"] + gap + width - 1).alias("end")))).alias("found"),
    )
    return F.aggregate(gaps, start, step)["found"]


def merged(ranges: Column) -> Column:
    """Ranges sorted, those that overlap or touch joined."""
    empty = F.expr(f"cast(array() AS {RANGES})")

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        extends = (F.size(acc) > 0) & (r["start"] <= last["end"] + 1)
        return F.when(extends, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), empty, step)
