"""Surrogate-key lookup and its checks."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.spec import DimSpec


def null_safe_lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], sk: str) -> DataFrame:
    """Left join on a composite key in which null equals null; keeps every row of ``df``.
    The result holds the surrogate key as its last column."""
    other = dim.select(*[F.col(k).alias(f"__{k}") for k in keys], sk)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(other, match, "left").drop(*[f"__{k}" for k in keys])


def repeated_keys(dims: dict[str, DataFrame], specs: Sequence[DimSpec]) -> DataFrame:
    """Per dimension, how many natural keys occur more than once."""
    parts = [
        dims[s.name].groupBy(*s.keys).count()
        .agg(F.count_if(F.col("count") > 1).alias("repeated_keys"))
        .select(F.lit(s.name).alias("dimension"), "repeated_keys")
        for s in specs
    ]
    return reduce(DataFrame.unionByName, parts)


def require_unique(dims: dict[str, DataFrame], specs: Sequence[DimSpec]) -> None:
    bad = repeated_keys(dims, specs).filter("repeated_keys > 0").collect()  # a row a dimension
    if bad:
        raise ValueError(f"dimension keys are not unique: {[r['dimension'] for r in bad]}")


def missing_keys(df: DataFrame, sks: Sequence[str]) -> DataFrame:
    """Per surrogate key, how many rows found no member."""
    row = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in sks])
    cells = [F.struct(F.lit(k).alias("sk"), F.col(k).alias("missing_rows")) for k in sks]
    return row.select(F.inline(F.array(*cells)))


def require_matched(df: DataFrame, sks: Sequence[str]) -> None:
    bad = missing_keys(df, sks).filter("missing_rows > 0").collect()  # a row a key
    if bad:
        raise RuntimeError(f"fact rows without a member in: {[r['sk'] for r in bad]}")
