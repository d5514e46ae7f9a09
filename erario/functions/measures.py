"""Aggregate expressions over fact rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from erario import fixed

# Money is added as blocks of 2^32 units, units within a block and millionths (to which each
# amount is rounded): three exact integer sums, so a total does not depend on the order in which
# partitions arrive, and holds up to 3.9e28 in size.  The parts are joined once per group.
_MILLIONTH = "0.000001"
_BLOCK = 4294967296
PARTS = ("blocks", "units", "rest")


def split_total(c: Column) -> tuple[Column, Column, Column]:
    """Sums of the blocks, of the units within them and of the millionths of a double column."""
    blocks = F.floor(c / _BLOCK)
    inside = c - blocks * F.lit(float(_BLOCK))
    units = F.floor(inside)
    return F.sum(blocks), F.sum(units), F.sum(F.rint((inside - units) * 1e6).cast("bigint"))


def joined(blocks: Column, units: Column, millionths: Column) -> Column:
    """A total from its three sums, rounded to a double once."""
    exact = (
        blocks.cast("decimal(20,0)") * F.lit(_BLOCK).cast("decimal(10,0)") + units.cast("decimal(20,0)")
        + millionths.cast("decimal(20,0)") * F.lit(_MILLIONTH).cast("decimal(6,6)")
    )
    return exact.cast("double")


def total(c: Column) -> Column:
    return joined(*split_total(c))


def positive(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(F.lit(0.0))


def tally(condition: Column) -> Column:
    """How many rows meet a condition; 0 rather than null on no rows."""
    return F.count_if(condition)


def mean_ratio() -> tuple[Column, Column]:
    """Sum and count of the ratio where there is a base (the mean is their quotient)."""
    r = F.when(F.col(fixed.MODIFIED) > 0, F.col("ratio_ejecucion"))
    return F.sum(r), F.count(r)
