"""Statistics as column expressions: shrinkage, mid-rank percentiles, renormalised blends, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def num(x: float) -> Column:
    return F.lit(x).cast("double")


def rate(part: Column, whole: Column) -> Column:
    """NULL, not zero, where the whole is unknown or zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), num(0))


def cents(value: Column) -> Column:
    """A double as an amount of two decimals: its hundredfold, as floating point has it, is rounded half away from zero.
    So does SQL's cast; Spark's own rounds the shortest decimal that reads as the double (8.075 is 8.08 there, not 8.07)."""
    return (F.round(value * num(100)).cast("decimal(12,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,2)")


def hundredths(value: Column) -> Column:
    """A double rounded to two decimals in floating point, as SQL's round does; Spark's own rounds the shortest decimal that
    reads as the double (8075.005 is 8075.01 there, not 8075.0)."""
    return F.round(value * num(100)) / num(100)


def shrink(value: Column, n: Column, field: Column, prior: float) -> Column:
    """A rate over n observations, pulled toward the field's by ``prior`` observations."""
    n = n.cast("double")
    return (value * n + num(prior) * field) / (n + num(prior))


def midrank(value: Column, *groups: str) -> Column:
    """The mid-rank percentile in (0, 1) within a population: ties share the average rank, and a NULL neither
    has one nor counts.  The population of a run is a catalogue of cards, so a run is a window's partition."""
    known = F.isnull(value)
    place = F.rank().over(Window.partitionBy(*groups, known).orderBy(value)).cast("double")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, known, value)).cast("double")
    total = F.count(value).over(Window.partitionBy(*groups)).cast("double")
    return F.when(value.isNotNull(), (place + (ties - num(1)) / num(2) - num(0.5)) / total)


def blend(parts: Sequence[tuple[float, Column]]) -> Column:
    """The weighted mean of the parts that are known; NULL if none is."""
    top, bottom = num(0), num(0)
    for weight, part in parts:
        top = top + F.coalesce(num(weight) * part, num(0))
        bottom = bottom + F.when(part.isNotNull(), num(weight)).otherwise(num(0))
    return top / F.nullif(bottom, num(0))


def saturation(n: Column, scale: float) -> Column:
    return num(1) - F.exp(-n.cast("double") / num(scale))


def grade(score: Column, bands: Sequence[tuple[float, str]]) -> Column:
    """The letter of the first band that the score reaches; F below all, NULL if there is no score."""
    out = None
    for least, letter in bands:
        out = F.when(score >= num(least), letter) if out is None else out.when(score >= num(least), letter)
    return F.when(score.isNotNull(), out.otherwise("F"))


#: The least score of each letter grade; F below all of them.
LETTERS = [(90.0, "A+"), (85.0, "A"), (80.0, "A-"), (75.0, "B+"), (70.0, "B"), (65.0, "B-"), (60.0, "C+"), (50.0, "C"), (45.0, "C-"), (35.0, "D")]
