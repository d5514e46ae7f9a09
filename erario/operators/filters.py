"""Named analytic filters and equality filters."""

from __future__ import annotations

from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario import fixed
from erario.functions.execution import surely


def named_filters() -> dict[str, Column]:
    has_base = F.col("flag_registro_valido") & surely(F.col(fixed.MODIFIED) > 0)
    return {
        "filtro_olap": ~F.col("flag_montos_negativos"),
        "filtro_modelado_ratio": has_base,
        "filtro_modelado_programable": has_base
        & surely(F.col("tipo_gasto") == fixed.PROGRAMMABLE),
        "filtro_clasificacion_sin_pago": has_base,
    }


def apply_filter(df: DataFrame, name: str) -> DataFrame:
    known = named_filters()
    if name not in known:
        raise ValueError(f"unknown filter {name!r}; choose one of {sorted(known)}")
    return df.filter(known[name])


def chosen(filters: dict[str, Any], allowed: Iterable[str]) -> dict[str, Any]:
    """The given filters that apply; missing values and other columns are ignored."""
    allowed = set(allowed)
    return {k: v for k, v in filters.items() if v is not None and k in allowed}


def equalities(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Keep rows equal to every value; values are literals of the column's own type."""
    for name, value in filters.items():
        df = df.filter(F.col(name) == F.lit(value).cast(df.schema[name].dataType))
    return df
