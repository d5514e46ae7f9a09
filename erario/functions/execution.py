"""Derived columns of a budget line: quality flags, execution ratios and bands.

Every flag is true or false, never null: a comparison with a missing amount is false.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from erario import fixed


def surely(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def ratio(part: Column, base: Column) -> Column:
    """Guarded division: null unless the base is positive."""
    return F.when(base > 0, part / base)


def any_negative(amounts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [surely(F.col(a) < 0) for a in amounts])


def band(executed: Column, usable: Column, unpaid: Column, unpaid_band: bool = False) -> Column:
    """Execution band.  By default an unpaid line counts as ``baja``, its ratio being 0;
    ``unpaid_band`` gives it the level of its own."""
    level = F.when(~usable | executed.isNull(), "sin_base")
    if unpaid_band:
        level = level.when(unpaid, "sin_pago")
    return (
        level.when(executed < fixed.MIDDLE_RATIO, "baja")
        .when(executed < fixed.HIGH_RATIO, "media")
        .when(executed <= 1, "alta")
        .otherwise("sobre")
    )


def band_rank(c: Column) -> Column:
    """Position of a band in its order, from 0."""
    return F.array_position(F.array(*[F.lit(b) for b in fixed.BANDS]), c) - 1


def derived(amounts: Sequence[str], unpaid_band: bool = False) -> dict[str, Column]:
    """The eleven derived columns, each from source columns alone."""
    mod, apr, pag = F.col(fixed.MODIFIED), F.col(fixed.APPROVED), F.col(fixed.PAID)
    negative = any_negative(amounts)
    has_base = surely(mod > 0)
    executed = ratio(pag, mod)
    unpaid = has_base & surely(pag == 0)
    return {
        "flag_montos_negativos": negative,
        "flag_modificado_cero": surely(mod == 0),
        "flag_modificado_negativo": surely(mod < 0),
        "ratio_ejecucion": executed,
        "ratio_aprobado": ratio(pag, apr),
        "log1p_monto_pagado": F.log1p(F.when(pag < 0, F.lit(0.0)).otherwise(pag)),
        "sin_pago": unpaid,
        "alta_ejecucion": surely(executed >= fixed.HIGH_RATIO),
        "sobre_ejecucion": surely(executed > 1),
        "banda_ejecucion": band(executed, has_base & ~negative, unpaid, unpaid_band),
        "flag_registro_valido": ~negative & ~surely(mod < 0) & F.col(fixed.PERIOD).isNotNull(),
    }
