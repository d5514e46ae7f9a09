"""The analytic views: lazy frames over a warehouse.

A key fixes its labels, so each view aggregates the fact by surrogate key and period
first (partial sums before the shuffle, no join on fact rows) and only then fetches the
labels for the few groups left.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erario import fixed
from erario.functions.execution import ratio
from erario.functions.measures import PARTS, joined, mean_ratio, positive, split_total, tally
from erario.operators.filters import equalities
from erario.plans.star import Warehouse

_COUNTS = {
    "n_sin_pago": "sin_pago",
    "n_alta_ejecucion": "alta_ejecucion",
    "n_sobre_ejecucion": "sobre_ejecucion",
}
_PUSHED_KEYS = 1000


@dataclass(frozen=True)
class View:
    """What a view groups by and which measures it shows, in order."""

    dim: str | None
    labels: tuple[str, ...]
    measures: tuple[str, ...]


_SUMS = ("monto_modificado", "monto_pagado")
_ALL_SUMS = ("monto_aprobado",) + _SUMS
_WEIGHTED = "ratio_ejecucion_ponderado"
_MEAN = "ratio_ejecucion_promedio"
_BASE = "base_modificado_positivo"

VIEWS = {
    "global": View(None, (), _ALL_SUMS + (_BASE, _WEIGHTED, _MEAN) + tuple(_COUNTS)),
    "ramo": View(
        "dim_ramo", ("id_ramo", "desc_ramo"),
        _ALL_SUMS + (_WEIGHTED, "n_sin_pago", "n_alta_ejecucion"),
    ),
    "ur": View("dim_ur", ("id_ur", "desc_ur"), _SUMS + (_WEIGHTED, "n_sin_pago")),
    "entidad": View(
        "dim_entidad", ("id_entidad_federativa", "entidad_federativa"),
        _SUMS + (_WEIGHTED, "n_sin_pago"),
    ),
    "capitulo": View(
        "dim_clasificacion_economica", ("id_capitulo", "desc_capitulo"), _SUMS + (_WEIGHTED,)
    ),
    "programa": View(
        "dim_clasificacion_funcional", ("id_pp", "desc_pp", "id_funcion", "desc_funcion"),
        _SUMS + (_WEIGHTED,),
    ),
    "fuente": View("dim_fuente_financiamiento", ("id_ff", "desc_ff"), _SUMS + (_WEIGHTED,)),
    "banda": View(None, ("banda_ejecucion", "tipo_gasto"), _SUMS),
    "tipo_gasto": View(None, ("tipo_gasto",), _SUMS + (_MEAN,)),
}


def _partials(measures: tuple[str, ...]) -> dict[str, Column]:
    """Sums that add up when groups are merged; an amount has three."""
    need = {"n_registros": F.count("*")}

    def money(name: str, c: Column) -> None:
        need.update(zip((f"__{p}_{name}" for p in PARTS), split_total(c), strict=True))

    for m in measures:
        if m in fixed.AMOUNTS:
            money(m, F.col(m))
        elif m in _COUNTS:
            need[m] = tally(F.col(_COUNTS[m]))
        elif m == _MEAN:
            need["__ratio_sum"], need["__ratio_n"] = mean_ratio()
    if _WEIGHTED in measures or _BASE in measures:
        money(fixed.PAID, F.col(fixed.PAID))
        money(_BASE, positive(F.col(fixed.MODIFIED)))
    return need


def _finished(measures: tuple[str, ...]) -> list[Column]:
    def money(name: str) -> Column:
        return joined(*(F.col(f"__{p}_{name}") for p in PARTS))

    out = [F.col("n_registros")]
    for m in measures:
        if m in fixed.AMOUNTS or m == _BASE:
            out.append(money(m).alias(m))
        elif m == _WEIGHTED:
            out.append(ratio(money(fixed.PAID), money(_BASE)).alias(m))
        elif m == _MEAN:
            out.append(ratio(F.col("__ratio_sum"), F.col("__ratio_n")).alias(m))
        else:
            out.append(F.col(m))
    return out


def restricted(wh: Warehouse, fact: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Fact rows that pass equality filters on any star column.

    Filters on a dimension become its surrogate keys.  A short list of keys goes to the
    scan as a literal, where row-group statistics skip (the fact is written in key
    order); a long one is a semi join."""
    own = {k: v for k, v in filters.items() if k in fact.columns}
    fact = equalities(fact, own)
    by_dim: dict[str, dict[str, Any]] = {}
    for name, value in filters.items():
        if name in own:
            continue
        owner = wh.spec.owner(name)
        if owner is None:
            raise ValueError(f"no column {name!r} in this star")
        by_dim.setdefault(owner.name, {})[name] = value
    for dim_name, wanted in by_dim.items():
        sk = wh.spec.dim(dim_name).sk
        members = equalities(wh.dims[dim_name], wanted).select(sk)
        head = [r[0] for r in members.take(_PUSHED_KEYS + 1)]  # bounded
        if len(head) <= _PUSHED_KEYS:
            fact = fact.filter(F.col(sk).isin(head) if head else F.lit(False))
        else:
            fact = fact.join(members, sk, "left_semi")
    return fact


def view(
    wh: Warehouse, axis: str, grain: str = "key", filters: dict[str, Any] | None = None
) -> DataFrame:
    """One analytic view.  ``grain="label"`` merges keys that share the shown labels;
    by default chapter and programme stay one row per classification key."""
    shape = VIEWS[axis]
    dim = wh.spec.dim(shape.dim) if shape.dim else None
    labels = [c for c in shape.labels if c in (dim.keys if dim else wh.fact.columns)]
    by = [dim.sk] if dim else labels
    partials = _partials(shape.measures)
    filters = filters or {}

    fact = wh.fact
    if filters:
        fact = restricted(wh, fact, filters)
    groups = fact.groupBy(*by, fixed.PERIOD).agg(*[c.alias(n) for n, c in partials.items()])
    if dim is None:
        return groups.select(*labels, fixed.PERIOD, *_finished(shape.measures))

    hop = ["id_ramo"] if axis == "ur" else []
    named = groups.join(wh.dim(dim.name).select(dim.sk, *labels, *hop), dim.sk)
    if axis == "ur":
        # The unit's branch is found by its number alone: a number with two names repeats
        # the unit's rows, and a unit without a number has none.
        named = named.join(wh.dim("dim_ramo").select("id_ramo", "desc_ramo"), "id_ramo")
        labels = labels + ["id_ramo", "desc_ramo"]
    if grain == "label":
        named = named.groupBy(*labels, fixed.PERIOD).agg(*[F.sum(n).alias(n) for n in partials])
        return named.select(*labels, fixed.PERIOD, *_finished(shape.measures))
    return named.select(dim.sk, *labels, fixed.PERIOD, *_finished(shape.measures))


def star_columns(wh: Warehouse) -> list[str]:
    """Columns of the detail cube: keys, labels by dimension, type, amounts, attributes."""
    labels: list[str] = []
    for d in wh.spec.dims:
        labels += [k for k in d.keys if k not in labels]
    rest = [a for a in wh.spec.attributes if a not in ("tipo_gasto", "log1p_monto_pagado")]
    tipo = [a for a in wh.spec.attributes if a == "tipo_gasto"]
    return [fixed.FACT_KEY, wh.spec.line_key, *labels, *tipo, *wh.spec.amounts, *rest]


def star(wh: Warehouse, columns: list[str] | None = None, fact: DataFrame | None = None) -> DataFrame:
    """The detail cube.  Only dimensions that supply a wanted column are joined; every
    key has a member (checked at build time), so leaving one out loses no row."""
    wanted = columns or star_columns(wh)
    rows = wh.fact if fact is None else fact
    have = set(rows.columns)
    for d in wh.spec.dims:
        labels = [k for k in d.keys if k in wanted and k not in have]
        if labels:
            rows = rows.join(wh.dim(d.name).select(d.sk, *labels), d.sk)
            have.update(labels)
    return rows.select(*wanted)


def modelling_star(wh: Warehouse, columns: list[str] | None = None) -> DataFrame:
    """Rows fit for modelling: base above zero, valid, programmable; all columns, or some."""
    fit = wh.fact.filter(
        (F.col(fixed.MODIFIED) > 0)
        & F.col("flag_registro_valido")
        & (F.col("tipo_gasto") == fixed.PROGRAMMABLE)
    )
    if columns is not None:
        return star(wh, columns, fit)
    cube = star_columns(wh)
    extra = [c for c in (*wh.spec.sks, "log1p_monto_pagado") if c in fit.columns]
    return star(wh, cube + extra, fit)


def register_views(spark: SparkSession, wh: Warehouse) -> list[str]:
    """Register every view for SQL and list the registered names by prefix."""
    for name, frame in wh.dims.items():
        frame.createOrReplaceTempView(name)
    wh.fact_table().createOrReplaceTempView(fixed.FACT)
    star(wh).createOrReplaceTempView(fixed.STAR_VIEW)
    for axis, name in fixed.AXIS_VIEWS.items():
        view(wh, axis).createOrReplaceTempView(name)
    found = [t.name for t in spark.catalog.listTables() if t.name.startswith(fixed.VIEW_PREFIX)]
    return sorted(found)
