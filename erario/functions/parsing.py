"""Column expressions that turn raw text into typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, NumericType, StringType

from erario import fixed

# What counts as a number, and the white space to strip (Unicode's, with
# the four ASCII separators).
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def known(c: Column) -> Column:
    """Missing-value tokens become null."""
    return F.when(~c.isin(*fixed.MISSING_TOKENS), c)


def number(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal number, or too large for a double,
    becomes null."""
    return finite(F.when(c.rlike(NUMBER), F.trim(c)).try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def whole(c: Column, name: str) -> Column:
    """Text to long.  ``2026.0`` is 2026; a fractional number fails the job."""
    wide = number(c)
    exact = F.when(c.rlike(NUMBER), F.trim(c)).try_cast("bigint")
    fraction = F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), c)).cast("bigint")
    return F.coalesce(
        exact,
        F.when(wide.isNull(), F.lit(None).cast("bigint"))
        .when(wide == F.floor(wide), wide.cast("bigint"))
        .otherwise(fraction),
    )


def stripped(c: Column) -> Column:
    """Strip white space of every kind, which plain ``trim`` does not (it knows the space)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def as_amount(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return number(c)
    if isinstance(kind, (DoubleType, FloatType)):
        return finite(F.when(~F.isnan(c), c).cast("double"))
    return c.cast("double")


def fraction_seen(c: Column, kind: DataType) -> Column | None:
    """Whether any value of an id column is not a whole number; None if its type rules it out."""
    if not isinstance(kind, (StringType, DoubleType, FloatType)):
        return None
    value = as_amount(c, kind)
    return F.coalesce(F.bool_or(value != F.floor(value)), F.lit(False))


def as_whole(c: Column, kind: DataType, name: str) -> Column:
    if isinstance(kind, StringType):
        return whole(c, name)
    if isinstance(kind, (DoubleType, FloatType)):
        return whole(F.when(~F.isnan(c), c).cast("string"), name)
    if isinstance(kind, NumericType):
        return c.cast("bigint")
    raise TypeError(f"{name}: cannot read {kind.simpleString()} as a whole number")


def as_text(c: Column, missing: str | None) -> Column:
    text = stripped(c.cast("string"))
    return text if missing is None else F.coalesce(text, F.lit(missing))
