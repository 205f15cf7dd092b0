"""The three roundings results depend on. Spark's plain ``round`` is none of them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column) -> Column:
    """Nearest integer, ties towards +infinity, as BIGINT."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def half_even(value: Column, digits: int = 0) -> Column:
    """Nearest value at ``digits`` decimals, ties to even."""
    return F.bround(value, digits)


def truncate(value: Column) -> Column:
    """Towards zero, as INT."""
    return value.cast("int")


def squeeze(value: Column, lo, hi) -> Column:
    """Into [lo, hi] for a value known to be present; a NULL would come out as ``lo``."""
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def clamp(value: Column, lo, hi) -> Column:
    """Into [lo, hi]; NULL stays NULL. Names its argument twice, so give it a plain column."""
    return F.when(value.isNotNull(), squeeze(value, lo, hi))
