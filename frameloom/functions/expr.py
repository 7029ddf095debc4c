"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """c as a double; null for text that is no number, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column, digits: int) -> Column:
    """c times a power of ten, rounded to a whole number, halves away from zero, and divided again, as SQL engines round
    doubles. F.round rounds the shortest decimal text of c instead, which may lie below a half that c stands for."""
    return F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def nearest_rank(values: Column, q: float) -> Column:
    """The element of an array at place round((n - 1) * q), halves to even, in ascending order; 0 if empty."""
    ordered = F.array_sort(values)
    place = F.bround((F.size(ordered) - 1) * F.lit(q), 0).cast("int")
    return F.when(F.size(ordered) > 0, F.element_at(ordered, place + 1)).otherwise(0.0)


def first_present(*columns: Column) -> Column:
    return F.coalesce(*columns)


def onset(frame: Column, start: Column, given: Column) -> Column:
    """Onset frame of an event: as given, else its start, else its frame."""
    return F.coalesce(given, start, frame)


def event_end(on: Column, peak: Column, end: Column, duration: Column) -> Column:
    """End frame: as given, else by duration, else the peak."""
    return F.coalesce(end, on + F.greatest(F.lit(0), duration - 1), peak)


def event_duration(on: Column, end: Column, duration: Column) -> Column:
    return F.coalesce(duration, F.greatest(F.lit(1), end - on + 1))


def natural_key(identifier: Column) -> list[Column]:
    """Sort keys that order identifiers by what precedes their trailing digits, then by all digits as a number."""
    digits = F.regexp_replace(identifier, r"\D", "")
    return [F.regexp_replace(identifier, r"\d+$", ""), F.coalesce(digits.try_cast("long"), F.lit(-1))]


def overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes (x, y, width, height)."""
    wide = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    return ratio(both, a[2] * a[3] + b[2] * b[3] - both)


def edge_distance(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Distance of a point from the nearest edge of its image; 0 if the size is unknown."""
    inside = F.least(x, y, width - 1 - x, height - 1 - y)
    return F.when((width > 0) & (height > 0), F.greatest(F.lit(0.0), inside)).otherwise(0.0)


def plain_text(c: Column) -> Column:
    """A value for a tab-separated file: null is empty, tabs and line ends are blanks."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t\n\r", "   ")


def label(c: Column) -> Column:
    """A label in small letters without outer blanks; empty if missing."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def binary_label(c: Column, yes: Sequence[str], no: Sequence[str]) -> Column:
    return F.when(label(c).isin(*yes), 1).when(label(c).isin(*no), 0)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts of the conditions that hold, in the order given."""
    return F.filter(F.array(*[F.when(condition, text) for condition, text in pairs]), lambda x: x.isNotNull())


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between two ISO texts, not below 0; null if either is none."""
    micros = F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))
    return F.greatest(F.lit(0.0), micros / 1_000_000.0)


def two_case(values: Column, name: str) -> Column:
    """A map's value under a name, else under the name in small letters."""
    return F.coalesce(F.try_element_at(values, F.lit(name)), F.try_element_at(values, F.lit(name.lower())))
