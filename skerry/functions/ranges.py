"""Ranges as struct<lower, upper, lower_inc, upper_inc>; a null bound is open, a null range matches nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, lower_inc: Column | None = None, upper_inc: Column | None = None) -> Column:
    """A range; by default the lower end belongs to it and the upper one doesn't."""
    return F.struct(lower.alias("lower"), upper.alias("upper"), (lower_inc if lower_inc is not None else F.lit(True)).alias("lower_inc"), (upper_inc if upper_inc is not None else F.lit(False)).alias("upper_inc"))


def is_empty(r: Column) -> Column:
    """No value lies in the range."""
    both = r["lower"].isNotNull() & r["upper"].isNotNull()
    return both & ((r["lower"] > r["upper"]) | ((r["lower"] == r["upper"]) & ~(r["lower_inc"] & r["upper_inc"])))


def holds(r: Column, value: Column) -> Column:
    """The value lies in the range."""
    low = r["lower"].isNull() | (r["lower"] < value) | ((r["lower"] == value) & r["lower_inc"])
    high = r["upper"].isNull() | (r["upper"] > value) | ((r["upper"] == value) & r["upper_inc"])
    return r.isNotNull() & low & high


def _before(a: Column, b: Column) -> Column:
    """Range a ends before range b begins; touching ends meet only if both belong."""
    return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def intersects(a: Column, b: Column) -> Column:
    """Some value lies in both."""
    return a.isNotNull() & b.isNotNull() & ~is_empty(a) & ~is_empty(b) & ~_before(a, b) & ~_before(b, a)


def inside(a: Column, b: Column) -> Column:
    """Every value of a lies in b; empty ranges match nothing."""
    low = b["lower"].isNull() | F.coalesce((a["lower"] > b["lower"]) | ((a["lower"] == b["lower"]) & (b["lower_inc"] | ~a["lower_inc"])), F.lit(False))
    high = b["upper"].isNull() | F.coalesce((a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & (b["upper_inc"] | ~a["upper_inc"])), F.lit(False))
    return a.isNotNull() & b.isNotNull() & ~is_empty(a) & ~is_empty(b) & low & high


def sort_key(r: Column) -> list[Column]:
    """Columns that order ranges: open lower ends first, then by lower end, inclusive first, then by upper end, open last."""
    return [F.when(r["lower"].isNull(), 0).otherwise(1), r["lower"], F.when(r["lower_inc"], 0).otherwise(1), F.when(r["upper"].isNull(), 1).otherwise(0), r["upper"], F.when(r["upper_inc"], 1).otherwise(0)]
