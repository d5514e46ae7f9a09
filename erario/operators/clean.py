"""Typing, trimming, de-duplication and derivation of budget lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario import fixed
from erario.functions.execution import derived
from erario.functions.parsing import as_amount, as_text, as_whole, fraction_seen
from erario.store import slice_of


def typed(df: DataFrame, null_text: str | None = None) -> DataFrame:
    """Amounts to double, ids to long, texts stripped; other columns pass unchanged.

    The period and the line key must be whole numbers.  Another id column that holds a fraction
    somewhere is a double as a whole, which one pass over the untyped id columns finds out.

    ``null_text`` replaces a missing text (``"nan"`` mirrors a frame whose texts went
    through a string cast); by default it stays null and keys are joined null-safely.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    asked = {n: fraction_seen(F.col(n), kinds[n]) for n in df.columns if n in fixed.NUMERIC_IDS}
    asked = {n: seen.alias(n) for n, seen in asked.items() if seen is not None}
    fractional = {n for n, yes in df.agg(*asked.values()).head().asDict().items() if yes} if asked else set()

    def one(name: str):
        c = F.col(name)
        if name in fixed.AMOUNTS or name in fractional:
            return as_amount(c, kinds[name]).alias(name)
        if name in (fixed.PERIOD, fixed.LINE_KEY) or name in fixed.NUMERIC_IDS:
            return as_whole(c, kinds[name], name).alias(name)
        if name in fixed.TEXTS:
            return as_text(c, null_text).alias(name)
        return c

    return df.select(*[one(n) for n in df.columns])


def deduplicated(df: DataFrame) -> DataFrame:
    """One of each set of rows equal in all columns (nulls are equal).  The partial
    aggregate runs before the shuffle, so a hot set of copies shrinks to one row a task."""
    return df.dropDuplicates()


def with_derived(df: DataFrame, unpaid_band: bool = False) -> DataFrame:
    amounts = [a for a in fixed.AMOUNTS if a in df.columns]
    return df.select("*", *[c.alias(n) for n, c in derived(amounts, unpaid_band).items()])


@dataclass(frozen=True)
class CleanResult:
    df: DataFrame
    before: DataFrame

    def duplicates(self) -> int:
        """Rows removed as exact copies."""
        return self.before.count() - self.df.count()


def clean(df: DataFrame, null_text: str | None = None, unpaid_band: bool = False) -> CleanResult:
    ready = typed(df, null_text)
    return CleanResult(ready.transform(deduplicated).transform(with_derived, unpaid_band), ready)


def clean_slices(df: DataFrame, many: int, null_text: str | None = None) -> Iterator[DataFrame]:
    """What ``clean`` gives, in so many parts: equal rows have one line key, so a part has all copies of
    its rows, and only a part's rows are shuffled at a time."""
    ready = typed(df, null_text)
    key = fixed.LINE_KEY if fixed.LINE_KEY in df.columns else df.columns[0]
    for at in range(many):
        yield slice_of(ready, key, at, many).transform(deduplicated).transform(with_derived)
