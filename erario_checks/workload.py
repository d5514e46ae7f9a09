"""Registered queries over the order tables seen as budget lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario import fixed
from erario.operators.clean import clean, clean_slices, deduplicated, typed
from erario.operators.filters import apply_filter
from erario.operators.lookup import missing_keys
from erario.operators.numbering import number_rows
from erario.operators.quantiles import quantiles
from erario.plans import profile
from erario.plans.olap import catalogue, chart_rows, lookup, query_axis, query_kpis, query_star
from erario.plans.star import (
    Warehouse,
    build_warehouse,
    key_uniqueness,
    orphans,
    warehouse_report,
)
from erario.plans.views import modelling_star, register_views, star, view
from erario.sources.lens import lens, path, raw_lens
from erario.sources.raw import read_raw_csv
from erario.sources.tables import Processed, load_modelling_frame, load_olap_source, run_cleaning
from erario.store import Store, release, slice_of, slices_of, stored_bytes

Query = Callable[[SparkSession, str], DataFrame]


class Stage:
    """The stored clean table and warehouse of one data folder, as a user would keep them:
    built by Spark on first use, then read by every query of the session."""

    _known: dict[tuple[str, str], Stage] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.store = Store(spark)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Stage:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    @cached_property
    def clean(self) -> DataFrame:
        return self.store.save_slices(clean_slices(lens(self.spark, self.sf_dir), self.slices), "limpio")

    @property
    def slices(self) -> int:
        """The joins of the lines and what follows them are done in so many slices of the line key."""
        return slices_of(stored_bytes(self.spark, path(self.sf_dir, "lineitem")))

    @cached_property
    def csv(self) -> str:
        """The budget lines as several CSV files, as a publisher would deliver them."""
        to, many = self.store.path("csv"), self.slices
        rows = lens(self.spark, self.sf_dir)
        for at in range(many):
            part = rows.repartition(4) if many == 1 else slice_of(rows, fixed.LINE_KEY, at, many)
            write = part.write.mode("append").option("header", True).option("escape", '"')
            (write if many == 1 else write.option("compression", "gzip")).csv(to)
            release(self.spark)
        return to

    @cached_property
    def processed(self) -> tuple[Processed, Store]:
        """The CSV files cleaned and profiled into stored tables."""
        out = Store(self.spark)
        return run_cleaning(read_raw_csv(self.spark, self.csv), out), out

    @cached_property
    def warehouse(self) -> Warehouse:
        return build_warehouse(self.clean, self.store)


def on_lens(plan: Callable[[DataFrame], DataFrame]) -> Query:
    """A plan over budget lines read straight from the tables."""
    return lambda spark, sf_dir: plan(lens(spark, sf_dir))


def on_clean(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(Stage.of(spark, sf_dir).clean)


def on_warehouse(plan: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(Stage.of(spark, sf_dir).warehouse)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round order-dependent means and library logarithms for comparison."""
    return df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})


LINE = ["id_clave_cartera", *[a for a in fixed.AMOUNTS if "mensual" not in a]]
MEAN = "ratio_ejecucion_promedio"
LOG = "log1p_monto_pagado"
FLAG_COLUMNS = [
    "flag_montos_negativos", "flag_modificado_cero", "flag_modificado_negativo", "sin_pago",
    "alta_ejecucion", "sobre_ejecucion", "flag_registro_valido",
]
NUMBERED = ["dim_tiempo", "dim_ramo", "dim_ur", "dim_entidad", "dim_fuente_financiamiento",
            "dim_clasificacion_economica", "dim_clasificacion_funcional"]
SHORT = {"dim_fuente_financiamiento": "dim_fuente", "dim_clasificacion_economica": "dim_economica",
         "dim_clasificacion_funcional": "dim_funcional"}
AMOUNT_SECTIONS = ["montos"]
DESCRIBED = ["monto_aprobado", "monto_modificado", "monto_pagado", "ratio_ejecucion",
             "tipo_gasto", "banda_ejecucion"]


def _derived(*columns: str, **options) -> Query:
    return on_lens(lambda df: rounded(clean(df, **options).df.select(*LINE, *columns), LOG))


def _fact_numbering(wh: Warehouse) -> DataFrame:
    """The fact numbered again under another order (funding source first)."""
    order = ["ff_sk", *[c for c in wh.spec.fact_order if c != "ff_sk"]]
    rows = wh.fact.select(*wh.spec.fact_order)
    return number_rows(rows, order, "position", Store(wh.fact.sparkSession)).select(
        "position", "ff_sk", "tiempo_sk", "id_clave_cartera", "monto_aprobado"
    )


def _star_count(wh: Warehouse) -> DataFrame:
    """Rows of the detail cube, of the fact and of the global view: all equal."""
    kpis = view(wh, "global").agg(F.sum("n_registros").alias("rows"))
    parts = [
        star(wh).agg(F.count("*").alias("rows")).select(F.lit("star").alias("source"), "rows"),
        wh.fact.agg(F.count("*").alias("rows")).select(F.lit("fact").alias("source"), "rows"),
        kpis.select(F.lit("kpis").alias("source"), "rows"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _profile(measures: Callable[[DataFrame], list]) -> Query:
    return on_clean(lambda df: rounded(profile.tidy(df, measures(df)), "value"))


def _views_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered views answer SQL text."""
    register_views(spark, Stage.of(spark, sf_dir).warehouse)
    return spark.sql(
        f"SELECT entidad_federativa, sum(n_registros) AS n, sum(n_sin_pago) AS unpaid "
        f"FROM {fixed.AXIS_VIEWS['entidad']} GROUP BY entidad_federativa"
    )


def _all_views_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every registered view, counted by SQL text."""
    names = register_views(spark, Stage.of(spark, sf_dir).warehouse)
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in names))


def _csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty lines written as CSV files, read back and typed."""
    to = Store(spark).path("csv")
    raw_lens(spark, sf_dir).repartition(3).write.option("header", True).option("escape", '"').csv(to)
    return typed(read_raw_csv(spark, to)).select(
        "ciclo", "id_clave_cartera", "id_capitulo", "monto_aprobado")


def _stage(choose: Callable[[Stage], DataFrame]) -> Query:
    return lambda s, d: choose(Stage.of(s, d)).select(*LINE, "ciclo", "tipo_gasto")


def _before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Stage.of(spark, sf_dir).processed[0].profile
    return found.where("section = 'forma' and metric in ('n_filas', 'duplicados_eliminados')").select(
        "stage", "metric", "value")


def base_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "lens": on_lens(lambda df: df),
        "derive_flags": _derived(*FLAG_COLUMNS),
        "derive_ratios": _derived("ratio_ejecucion", "ratio_aprobado"),
        "derive_log1p": _derived(LOG),
        "band_default": _derived("banda_ejecucion"),
        "band_unpaid_option": _derived("banda_ejecucion", unpaid_band=True),
        "clean_types": lambda s, d: typed(raw_lens(s, d)).select(
            "ciclo", "id_clave_cartera", "id_capitulo", "monto_aprobado"),
        "clean_trim": lambda s, d: typed(raw_lens(s, d)).groupBy("desc_ur", "id_ur", "tipo_gasto")
        .agg(F.count("*").alias("n")),
        "dedupe_exact": lambda s, d: deduplicated(typed(raw_lens(s, d))),
        "duplicates_removed": lambda s, d: profile.duplicate_rows(typed(raw_lens(s, d))),
    }
    for short, name in (
        ("filter_olap", "filtro_olap"), ("filter_ratio", "filtro_modelado_ratio"),
        ("filter_programable", "filtro_modelado_programable"),
        ("filter_unpaid", "filtro_clasificacion_sin_pago"),
    ):
        q[short] = on_lens(lambda df, name=name: apply_filter(clean(df).df, name).select(
            *LINE, "ciclo", "tipo_gasto"))
    q["csv_read"] = _csv_read
    q["stage_clean"] = _stage(lambda st: st.processed[0].clean)
    q["stage_analytic"] = _stage(lambda st: st.processed[0].analytic)
    q["olap_source"] = _stage(lambda st: load_olap_source(st.spark, st.processed[1]))
    q["modelling_source"] = _stage(lambda st: load_modelling_frame(st.spark, st.processed[1]))
    q["profile_before_after"] = _before_and_after
    q["filter_counts"] = _profile(lambda df: profile.filter_measures())

    for name in NUMBERED:
        q[SHORT.get(name, name)] = on_warehouse(lambda wh, name=name: wh.dims[name])
    q["fact_table"] = on_warehouse(lambda wh: rounded(wh.fact_table(), LOG))
    q["fact_numbering"] = on_warehouse(_fact_numbering)
    q["modelling_star"] = on_warehouse(lambda wh: rounded(modelling_star(wh), LOG))
    q["warehouse_report"] = on_warehouse(
        lambda wh: warehouse_report(wh, len(register_views(wh.fact.sparkSession, wh))))
    q["orphans"] = on_warehouse(orphans)
    q["missing_keys"] = on_warehouse(lambda wh: missing_keys(wh.fact, wh.spec.sks))
    q["key_uniqueness"] = on_warehouse(key_uniqueness)
    q["star_counts"] = on_warehouse(_star_count)

    for axis in fixed.AXIS_VIEWS:
        short = "kpis" if axis == "global" else axis
        q[f"view_{short}"] = on_warehouse(lambda wh, a=axis: rounded(view(wh, a), MEAN))
        q[f"axis_topk_{short}"] = on_warehouse(
            lambda wh, a=axis: rounded(query_axis(wh, a, limit=20).data, MEAN))
    q["view_star"] = on_warehouse(star)
    q["view_capitulo_label"] = on_warehouse(lambda wh: view(wh, "capitulo", "label"))
    q["view_programa_label"] = on_warehouse(lambda wh: view(wh, "programa", "label"))
    q["views_by_sql"] = _views_by_sql
    q["all_views_by_sql"] = _all_views_by_sql
    q["axis_catalogue"] = lambda spark, sf_dir: (
        catalogue(spark).join(_all_views_by_sql(spark, sf_dir).withColumnRenamed("name", "view"), "view")
        .withColumn("filters", F.array_join("filters", ",")))
    q["axis_capitulo_all"] = on_warehouse(
        lambda wh: rounded(query_axis(wh, "capitulo", limit=None).data, MEAN))
    q["kpis_one_cycle"] = on_warehouse(lambda wh: rounded(query_kpis(wh, 1997).data, MEAN))
    q["axis_filtered_ramo"] = on_warehouse(
        lambda wh: query_axis(wh, "ramo", {"id_ramo": 2, "ciclo": 1996, "id_pp": 9}).data)
    q["axis_filtered_ur"] = on_warehouse(
        lambda wh: query_axis(wh, "ur", {"id_ur": "U2", "id_ramo": 2}).data)
    q["axis_filtered_capitulo"] = on_warehouse(
        lambda wh: query_axis(wh, "capitulo", {"id_capitulo": 7}, limit=None).data)
    q["star_page"] = on_warehouse(
        lambda wh: query_star(wh, {"id_ramo": 1, "tipo_gasto": "PROGRAMABLE"}, 50).data)
    q["star_page_offset"] = on_warehouse(
        lambda wh: query_star(wh, {"ciclo": 1995, "banda_ejecucion": "media"}, 25, 40).data)
    q["star_page_total"] = on_warehouse(
        lambda wh: query_star(wh, {"ciclo": 1995, "banda_ejecucion": "media"}).matching
        .agg(F.count("*").alias("row_count")))
    q["chart_top15"] = on_warehouse(lambda wh: chart_rows(query_axis(wh, "entidad")))
    q["chart_top15_paid"] = on_warehouse(
        lambda wh: chart_rows(query_axis(wh, "fuente"), metric="monto_pagado", labels=("desc_ff",)))
    for name in ("ramo", "ur", "entidad", "fuente", "capitulo", "programa", "banda_ejecucion", "tipo_gasto"):
        q[f"lookup_{name}"] = on_warehouse(lambda wh, n=name: lookup(wh, n))

    q["profile_shape"] = _profile(profile.shape_measures)
    q["profile_nulls"] = _profile(profile.null_measures)
    q["profile_amounts"] = _profile(profile.amount_measures)
    q["profile_ratio"] = _profile(profile.ratio_measures)
    q["profile_flags"] = _profile(lambda df: profile.flag_measures())
    q["profile_quantiles"] = on_clean(lambda df: rounded(profile.quantile_rows(df), "value"))
    q["profile_quantiles_ranked"] = on_clean(
        lambda df: rounded(profile.quantile_rows(df, buffered_rows=2000), "value"))
    q["profile_freq"] = on_clean(lambda df: profile.frequencies(df, "tipo_gasto", "tipo_gasto"))
    q["profile_top10"] = on_clean(
        lambda df: profile.frequencies(df, "entidad_federativa", "entidad_top10", 10))
    q["profile_distinct"] = on_clean(profile.distinct_counts)
    q["profile_periods"] = on_clean(profile.periods)
    q["profile_bands"] = on_clean(profile.band_counts)
    q["profile_duplicates"] = on_clean(profile.duplicate_rows)
    q["hist_ratio"] = on_clean(lambda df: rounded(profile.ratio_histogram(df), "bin_start"))
    q["describe"] = on_clean(lambda df: rounded(
        profile.describe(df, DESCRIBED), "mean", "std", "min", "q25", "q50", "q75", "max"))
    q["impute_median"] = on_clean(lambda df: rounded(
        quantiles(df, {c: F.col(c) for c in ("monto_modificado", "monto_pagado", "id_capitulo")}, [0.5]),
        "value"))
    return q
