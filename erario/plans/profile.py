"""Data-quality profile as tidy rows (section, column, metric, value)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erario import fixed
from erario.functions.execution import ratio, surely
from erario.functions.parsing import as_amount
from erario.functions.measures import total
from erario.operators.filters import named_filters
from erario.operators.quantiles import BUFFERED_ROWS, melt, quantiles
from erario.store import Store, release

Measure = tuple[str, str, str, Column]  # section, column, metric, aggregate
_PROBS = {"mediana": 0.5, "p95": 0.95, "p99": 0.99}
_FLAGS = (
    "flag_montos_negativos", "flag_modificado_cero", "flag_registro_valido",
    "sin_pago", "alta_ejecucion", "sobre_ejecucion",
)


def tidy(df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Compute all aggregates in one pass and lay them out one per row.  A constant is a measure
    as it is, so it also holds on an empty frame."""
    row = df.agg(*[m[3].cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    cells = [
        F.struct(
            F.lit(m[0]).alias("section"), F.lit(m[1]).alias("column"),
            F.lit(m[2]).alias("metric"), F.col(f"m{i}").alias("value"),
        )
        for i, m in enumerate(measures)
    ]
    return row.select(F.inline(F.array(*cells)))


def _amounts(df: DataFrame) -> dict[str, Column]:
    """The amounts as numbers, also when the frame still holds them as text."""
    return {
        a: as_amount(F.col(a), df.schema[a].dataType) for a in fixed.AMOUNTS if a in df.columns
    }


def _executed(df: DataFrame) -> tuple[Column, Column, Column]:
    amounts = _amounts(df)
    mod, paid = amounts[fixed.MODIFIED], amounts[fixed.PAID]
    return mod, paid, ratio(paid, mod)


def shape_measures(df: DataFrame) -> list[Measure]:
    listed = [("columnas", c, "posicion", F.lit(i)) for i, c in enumerate(df.columns)]
    return [
        ("forma", "", "n_filas", F.count("*")),
        ("forma", "", "n_columnas", F.lit(len(df.columns))),
        *listed,
    ]


def null_measures(df: DataFrame) -> list[Measure]:
    return [("nulos", c, "nulos", F.count_if(F.col(c).isNull())) for c in df.columns]


def amount_measures(df: DataFrame) -> list[Measure]:
    out: list[Measure] = []
    for a, c in _amounts(df).items():
        out += [
            ("montos", a, "min", F.min(c)),
            ("montos", a, "max", F.max(c)),
            ("montos", a, "media", F.when(F.count(c) > 0, total(c) / F.count(c))),
            ("montos", a, "negativos", F.count_if(c < 0)),
            ("montos", a, "nulos", F.count_if(c.isNull())),
        ]
    return out


def ratio_measures(df: DataFrame) -> list[Measure]:
    mod, paid, executed = _executed(df)
    counts = {
        "filas_con_modificado_positivo": mod > 0,
        "modificado_cero": mod == 0,
        "modificado_negativo": mod < 0,
        "sobre_ejecucion_gt_1": executed > 1,
        "sin_pago": (mod > 0) & (paid == 0),
    }
    return [("ratio_ejecucion_crudo", "", n, F.count_if(surely(c))) for n, c in counts.items()]


def flag_measures() -> list[Measure]:
    return [("flags", f, "n", F.count_if(F.col(f))) for f in _FLAGS]


def filter_measures() -> list[Measure]:
    """Rows passing each named filter, and the thresholds in use."""
    counts = [("filtros_analiticos_n_filas", n, "n", F.count_if(c)) for n, c in named_filters().items()]
    limits = {"RATIO_ALTA_EJECUCION": fixed.HIGH_RATIO, "RATIO_MEDIA_EJECUCION": fixed.MIDDLE_RATIO}
    return counts + [("umbrales", n, "umbral", F.lit(v)) for n, v in limits.items()]


def quantile_rows(
    df: DataFrame, store: Store | None = None, buffered_rows: int = BUFFERED_ROWS,
    exact: bool = True,
) -> DataFrame:
    """Median, p95 and p99 of every amount and of the ratio where there is a base."""
    columns = {**_amounts(df), "ratio": _executed(df)[2]}
    found = quantiles(
        df, columns, list(_PROBS.values()), store, buffered_rows, None if exact else 10_000
    )
    is_ratio = F.col("name") == "ratio"
    metric = F.when(F.col("prob") == _PROBS["mediana"], "mediana")
    for name in ("p95", "p99"):
        metric = metric.when(F.col("prob") == _PROBS[name], name)
    return found.select(
        F.when(is_ratio, "ratio_ejecucion_crudo").otherwise("montos").alias("section"),
        F.when(is_ratio, "").otherwise(F.col("name")).alias("column"),
        metric.alias("metric"), "value",
    )


def duplicate_rows(
    df: DataFrame, store: Store | None = None, broadcast_hashes: int = 4_000_000
) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    Equal rows have equal hashes, so only rows whose hash occurs again are compared in full.
    Hashes are counted first (eight bytes a row to shuffle); if few repeat, their rows are
    picked by a broadcast, and if many do, all rows are grouped."""
    store = store or Store(df.sparkSession)
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(c) for c in df.columns]))
    repeated = store.save(
        hashed.groupBy("__h").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("__h")
    )
    release(df.sparkSession)  # of the hashes of all rows
    if repeated.count() <= broadcast_hashes:
        hashed = hashed.join(F.broadcast(repeated), "__h", "left_semi")
    copies = hashed.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    value = F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("double").alias("value")
    return copies.agg(value).select(
        F.lit("forma").alias("section"), F.lit("").alias("column"),
        F.lit("duplicados_exactos").alias("metric"), "value",
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (name, value, n) for every distinct value of the given columns, null included,
    counted before the shuffle."""
    texts = {c: F.col(c).cast("string") for c in columns if c in df.columns}
    return melt(df, texts).groupBy("name", "value").agg(F.count("*").alias("n"))


def frequencies(df: DataFrame, column: str, section: str, top: int | None = None) -> DataFrame:
    """How often each known value occurs, most frequent first."""
    counts = (
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("metric"))
        .agg(F.count("*").cast("double").alias("value"))
    )
    if top is not None:
        counts = counts.orderBy(F.col("value").desc(), "metric").limit(top)
    return counts.select(F.lit(section).alias("section"), F.lit(column).alias("column"), "metric", "value")


def distinct_counts(
    df: DataFrame, columns: Sequence[str] = ("id_ramo", "id_ur", "entidad_federativa"),
    exact: bool = True,
) -> DataFrame:
    """Known distinct values per column."""
    columns = [c for c in columns if c in df.columns]
    if not exact:
        return tidy(df, [("cardinalidad", c, "distintos", F.approx_count_distinct(c)) for c in columns])
    counted = value_counts(df, columns).groupBy("name").agg(
        F.count("value").cast("double").alias("value")
    )
    return counted.select(
        F.lit("cardinalidad").alias("section"), F.col("name").alias("column"),
        F.lit("distintos").alias("metric"), "value",
    )


def periods(df: DataFrame) -> DataFrame:
    known = df.select(fixed.PERIOD).filter(F.col(fixed.PERIOD).isNotNull()).distinct()
    return known.select(
        F.lit("ciclo_valores").alias("section"), F.lit(fixed.PERIOD).alias("column"),
        F.col(fixed.PERIOD).cast("string").alias("metric"),
        F.col(fixed.PERIOD).try_cast("double").alias("value"),
    )


def band_counts(df: DataFrame) -> DataFrame:
    """Rows per band in band order, empty levels included."""
    counts = df.groupBy("banda_ejecucion").agg(F.count("*").alias("n"))
    levels = df.sparkSession.range(len(fixed.BANDS)).select(
        F.col("id").alias("banda_orden"),
        F.element_at(F.array(*[F.lit(b) for b in fixed.BANDS]), (F.col("id") + 1).cast("int"))
        .alias("banda_ejecucion"),
    )
    return counts.join(F.broadcast(levels), "banda_ejecucion", "right").select(
        "banda_ejecucion", F.coalesce("n", F.lit(0)).alias("n"), "banda_orden"
    ).orderBy("banda_orden")


def profile_raw(
    df: DataFrame, store: Store | None = None, exact: bool = True,
    buffered_rows: int = BUFFERED_ROWS,
) -> DataFrame:
    """Structure, nulls, amounts, ratio, frequencies, cardinality of typed lines."""
    parts = [
        tidy(df, shape_measures(df) + null_measures(df) + amount_measures(df) + ratio_measures(df)),
        quantile_rows(df, store, buffered_rows, exact),
        duplicate_rows(df, store), distinct_counts(df, exact=exact), periods(df),
    ]
    for column, top in (("tipo_gasto", None), ("desc_tipogasto", 10)):
        if column in df.columns:
            parts.append(frequencies(df, column, f"{column}_top10" if top else column, top))
    return reduce(DataFrame.unionByName, parts)


def profile_clean(
    df: DataFrame, store: Store | None = None, exact: bool = True,
    buffered_rows: int = BUFFERED_ROWS, duplicates: int | None = None,
) -> DataFrame:
    """The raw profile plus flags, bands, filters, thresholds and removed duplicates."""
    bands = band_counts(df).select(
        F.lit("banda_ejecucion").alias("section"), F.lit("banda_ejecucion").alias("column"),
        F.col("banda_ejecucion").alias("metric"), F.col("n").cast("double").alias("value"),
    )
    measures = flag_measures() + filter_measures()
    if duplicates is not None:
        measures.append(("forma", "", "duplicados_eliminados", F.lit(duplicates)))
    return profile_raw(df, store, exact, buffered_rows).unionByName(tidy(df, measures)).unionByName(bands)


def before_and_after(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("stage", F.lit("entrada")).unionByName(
        after.withColumn("stage", F.lit("limpio"))
    )


def describe(
    df: DataFrame, columns: Sequence[str], store: Store | None = None,
    buffered_rows: int = BUFFERED_ROWS,
) -> DataFrame:
    """Per column: count, then unique, top and freq of a text or mean, deviation, extremes
    and quartiles of a number."""
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c] in ("double", "bigint", "int")]
    texts = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        stats = melt(df, {c: F.col(c).cast("double") for c in numbers}).groupBy("name").agg(
            F.count("value").alias("count"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        found = quantiles(
            df, {c: F.col(c).cast("double") for c in numbers}, [0.25, 0.5, 0.75], store, buffered_rows
        )
        quartiles = found.groupBy("name").agg(*[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
            for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
        ])
        parts.append(
            stats.join(F.broadcast(quartiles), "name").select(  # a row per column
                "name", "count", F.lit(None).cast("bigint").alias("unique"),
                F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("freq"),
                "mean", "std", "min", "q25", "q50", "q75", "max",
            )
        )
    if texts:
        nothing = [F.lit(None).cast("double").alias(n)
                   for n in ("mean", "std", "min", "q25", "q50", "q75", "max")]
        seen = value_counts(df, texts).filter(F.col("value").isNotNull())
        best = F.min(F.struct(-F.col("n"), F.col("value")))
        parts.append(
            seen.groupBy("name").agg(
                F.sum("n").alias("count"), F.count("*").alias("unique"), best.alias("best")
            ).select("name", "count", "unique", F.col("best.value").alias("top"),
                     (-F.col("best.col1")).alias("freq"), *nothing)
        )
    return reduce(DataFrame.unionByName, parts)


def ratio_histogram(df: DataFrame, bins: int = 50, ceiling: float = 2.0) -> DataFrame:
    """Equal-width bins of the ratio, values above the ceiling counted at it.  The span is
    that of the data, and its end belongs to the last bin; empty bins are listed."""
    executed = F.col("ratio_ejecucion")
    used = df.filter((F.col(fixed.MODIFIED) > 0) & executed.isNotNull()).select(
        F.least(executed, F.lit(ceiling)).alias("x")
    )
    lo, hi = used.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    elif lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    place = F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * bins)
    counts = used.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    every = F.broadcast(df.sparkSession.range(bins).withColumnRenamed("id", "bin"))
    return counts.join(every, "bin", "right").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
