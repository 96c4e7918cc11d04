"""Rounding rules shared by the score operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column) -> Column:
    """Whole-number rounding that sends .5 upwards for negatives too."""
    return F.floor(value + F.lit(0.5)).cast("long")


def clamp_score(value: Column) -> Column:
    """A score as a whole number between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(value + F.lit(0.5)))).cast("long")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or null."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, True))
