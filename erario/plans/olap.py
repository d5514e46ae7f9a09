"""Filtered top-N queries, the paged detail cube, lookups and chart rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario import fixed
from erario.operators.filters import chosen
from erario.operators.numbering import number_rows
from erario.plans.star import Warehouse
from erario.plans.views import VIEWS, restricted, star, view
from erario.store import Store


def checked(limit: int | None) -> int | None:
    """None asks for every row; a limit below 1 is an error."""
    if limit is not None and limit < 1:
        raise ValueError(f"a limit must be at least 1, not {limit}")
    return limit


def axes() -> list[str]:
    return list(fixed.AXIS_VIEWS)


def catalogue(spark: SparkSession) -> DataFrame:
    """Axes with their view and filters, and the filterable columns of the detail cube."""
    rows = [(a, v, sorted(fixed.AXIS_FILTERS[a])) for a, v in fixed.AXIS_VIEWS.items()]
    rows.append(("star", fixed.STAR_VIEW, sorted(fixed.STAR_FILTERS)))
    return spark.createDataFrame(rows, "axis string, view string, filters array<string>")


@dataclass(frozen=True)
class AxisResult:
    axis: str
    view: str
    filters_applied: dict[str, Any]
    data: DataFrame

    def row_count(self) -> int:
        return self.data.count()


@dataclass(frozen=True)
class StarPage:
    limit: int | None
    offset: int
    filters_applied: dict[str, Any]
    data: DataFrame
    matching: DataFrame

    def row_count(self) -> int:
        """Rows that match the filters, on all pages."""
        return self.matching.count()


def query_axis(
    wh: Warehouse, axis: str, filters: dict[str, Any] | None = None, limit: int | None = 100,
    grain: str = "key",
) -> AxisResult:
    """The largest groups of an axis.  Filters the axis does not know are ignored."""
    if axis not in fixed.AXIS_VIEWS:
        raise ValueError(f"unknown axis {axis!r}; choose one of {axes()}")
    applied = chosen(filters or {}, fixed.AXIS_FILTERS[axis])
    groups = view(wh, axis, grain, applied)
    ties = [F.col(c).asc_nulls_last() for c in _keys(wh, axis, groups)]
    top = groups.orderBy(F.col("n_registros").desc_nulls_last(), *ties)
    if checked(limit) is not None:
        top = top.limit(limit)
    return AxisResult(axis, fixed.AXIS_VIEWS[axis], applied, top)


def _keys(wh: Warehouse, axis: str, groups: DataFrame) -> list[str]:
    """Columns that tell the groups of an axis apart, the surrogate key first."""
    shape = VIEWS[axis]
    names = ([wh.spec.dim(shape.dim).sk] if shape.dim else []) + list(shape.labels)
    names += ["id_ramo", "desc_ramo"] if axis == "ur" else []
    return [n for n in dict.fromkeys(names + [fixed.PERIOD]) if n in groups.columns]


def query_kpis(wh: Warehouse, ciclo: int | None = None, limit: int | None = 50) -> AxisResult:
    return query_axis(wh, "global", {"ciclo": ciclo}, limit)


def query_star(
    wh: Warehouse,
    filters: dict[str, Any] | None = None,
    limit: int | None = 100,
    offset: int = 0,
    after: tuple[float | None, int] | None = None,
) -> StarPage:
    """A page of the detail cube by modified amount, largest first.

    The page is cut from fact rows alone and labelled afterwards, so dimensions are joined
    to one page, not to the fact.  ``after`` = (amount, fact_sk) of the last row seen
    continues from there without sorting the rows an ``offset`` would skip.  With an offset,
    amounts and keys alone are numbered over range partitions, so no task meets the rows skipped."""
    applied = chosen(filters or {}, fixed.STAR_FILTERS)
    matching = restricted(wh, wh.fact, applied)
    amount, key = F.col(fixed.MODIFIED), F.col(fixed.FACT_KEY)
    order = [amount.desc_nulls_last(), key.asc()]
    checked(limit)
    rest = matching
    if after is not None:
        last, sk = after
        if last is None:
            rest = matching.filter(amount.isNull() & (key > sk))
        else:
            rest = matching.filter(
                (amount < last) | amount.isNull() | ((amount == last) & (key > sk))
            )
    if offset:
        numbered = number_rows(
            rest.select(amount, key), order, "__place", Store(wh.fact.sparkSession))
        wanted = F.col("__place") > offset
        if limit is not None:
            wanted &= F.col("__place") <= offset + limit
        page = rest.join(numbered.filter(wanted).select(key), fixed.FACT_KEY, "left_semi")
    else:
        page = rest.orderBy(*order).limit(limit) if limit is not None else rest
    return StarPage(limit, offset, applied, star(wh, fact=page).orderBy(*order), matching)


def lookup(wh: Warehouse, name: str) -> DataFrame:
    """Values to choose from, sorted, missing values last."""
    def of(dim: str, columns: Sequence[str], sort: str, distinct=False, known=False) -> DataFrame:
        table = wh.dims[dim]
        rows = table.select(*[c for c in columns if c in table.columns])
        if known and sort in rows.columns:
            rows = rows.filter(F.col(sort).isNotNull())
        if distinct:
            rows = rows.distinct()
        first = [sort] if sort in rows.columns else []
        order = first + [c for c in rows.columns if c not in first]
        return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order])

    def of_fact(column: str, known: bool) -> DataFrame:
        rows = wh.fact.select(column).distinct()
        rows = rows.filter(F.col(column).isNotNull()) if known else rows
        return rows.orderBy(F.col(column).asc_nulls_last())

    eco, func = "dim_clasificacion_economica", "dim_clasificacion_funcional"
    choices = {
        "ramo": lambda: of("dim_ramo", ("id_ramo", "desc_ramo"), "id_ramo"),
        "ur": lambda: of("dim_ur", ("id_ur", "desc_ur", "id_ramo"), "id_ur"),
        "entidad": lambda: of(
            "dim_entidad", ("id_entidad_federativa", "entidad_federativa"), "entidad_federativa"
        ),
        "fuente": lambda: of("dim_fuente_financiamiento", ("id_ff", "desc_ff"), "id_ff"),
        "capitulo": lambda: of(eco, ("id_capitulo", "desc_capitulo"), "id_capitulo", distinct=True),
        "programa": lambda: of(func, ("id_pp", "desc_pp"), "id_pp", distinct=True, known=True),
        "banda_ejecucion": lambda: of_fact("banda_ejecucion", known=True),
        "tipo_gasto": lambda: of_fact("tipo_gasto", known=False),
    }
    if name not in choices:
        raise ValueError(f"unknown lookup {name!r}; choose one of {list(choices)}")
    return choices[name]()


def chart_rows(
    result: AxisResult,
    rows: int = 15,
    labels: Sequence[str] = fixed.LABEL_COLUMNS,
    metric: str | None = None,
) -> DataFrame:
    """The first rows of an axis as (label, value): the first non-blank descriptive column
    and the first preferred measure the view has."""
    data = result.data
    numeric = {n for n, t in data.dtypes if t in ("bigint", "int", "double")}
    metric = metric or next(
        (m for m in fixed.METRIC_PREFERENCE if m in numeric),
        next((c for c in data.columns if c in numeric and not c.startswith("id_")), "n_registros"),
    )
    texts = [F.col(c).cast("string") for c in labels if c in data.columns]
    filled = [F.when(F.length(F.trim(t)) > 0, t) for t in texts]
    if result.axis == "global":
        last = F.lit("Total")
    else:  # the row's first value
        last = F.coalesce(F.col(data.columns[0]).cast("string"), F.lit("—"))
    label = F.substring(reduce(lambda a, b: F.coalesce(a, b), [*filled, last]), 1, fixed.LABEL_LENGTH)
    return data.limit(rows).select(label.alias("label"), F.col(metric).cast("double").alias("value"))
