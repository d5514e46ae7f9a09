"""Tables of the cleaning stage and the sources of later stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from erario import fixed
from erario.operators.clean import clean, clean_slices
from erario.operators.filters import apply_filter
from erario.plans.profile import before_and_after, profile_clean, profile_raw
from erario.plans.star import load_warehouse
from erario.plans.views import modelling_star
from erario.sources.raw import read_raw_csv
from erario.store import Store, slices_of, stored_bytes

RAW, CLEAN, ANALYTIC, PROFILE = "entrada", "limpio", "analitico", "perfil"
MODELLING_FILTER = "filtro_modelado_programable"


@dataclass(frozen=True)
class Processed:
    clean: DataFrame
    analytic: DataFrame
    profile: DataFrame
    duplicates: int


def run_cleaning(raw: DataFrame, out: Store, null_text: str | None = None) -> Processed:
    """Raw lines to the clean and analytic tables and the profile before and after.

    Raw text is kept once in columnar form: the profile reads single columns of it many
    times, which a CSV can only answer by parsing every line.  It goes before the analytic table is
    written; many lines are cleaned slice by slice."""
    with Store.scratch(raw.sparkSession) as scratch:
        raw = scratch.save(raw, RAW)
        many = slices_of(stored_bytes(raw.sparkSession, scratch.path(RAW)))
        table = out.save_slices(clean_slices(raw, many, null_text), CLEAN)
        removed = raw.count() - table.count()
        profile = before_and_after(
            profile_raw(raw, scratch), profile_clean(table, scratch, duplicates=removed)
        )
        # A few hundred rows: one file for the reader's sake.
        profile.repartition(1).write.mode("overwrite").json(out.path(PROFILE))
    analytic = out.save(apply_filter(table, MODELLING_FILTER), ANALYTIC)
    return Processed(table, analytic, out.spark.read.json(out.path(PROFILE)), removed)


def load_clean(spark: SparkSession, tables: Store, csv: str | None = None) -> DataFrame:
    """The stored clean table, else cleaned from the CSV."""
    if tables.has(CLEAN):
        return tables.load(CLEAN)
    if csv is None:
        raise FileNotFoundError(f"no clean table under {tables.root} and no CSV given")
    return clean(read_raw_csv(spark, csv)).df


def load_olap_source(spark: SparkSession, tables: Store, csv: str | None = None) -> DataFrame:
    return apply_filter(load_clean(spark, tables, csv), "filtro_olap")


def load_modelling_frame(
    spark: SparkSession,
    tables: Store,
    warehouse: Store | None = None,
    csv: str | None = None,
    prefer_warehouse: bool = False,
) -> DataFrame:
    """Rows to train on: the analytic table, else the clean table filtered, else the
    warehouse, else the CSV.  ``prefer_warehouse`` skips the first two."""
    if not prefer_warehouse:
        if tables.has(ANALYTIC):
            return tables.load(ANALYTIC)
        if tables.has(CLEAN):
            return apply_filter(tables.load(CLEAN), MODELLING_FILTER)
    if warehouse is not None and warehouse.has(fixed.FACT):
        return modelling_star(load_warehouse(spark, warehouse))
    return apply_filter(load_clean(spark, tables, csv), MODELLING_FILTER)
