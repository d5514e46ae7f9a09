"""The star warehouse: dimensions, fact, their tables and checks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario import fixed
from erario.operators.filters import apply_filter
from erario.operators.lookup import (
    null_safe_lookup,
    repeated_keys,
    require_matched,
    require_unique,
)
from erario.operators.numbering import number_rows, numbered_slices
from erario.spec import DimSpec, StarSpec
from erario.store import BROADCAST_BYTES, SLICE_ROWS, Store, broadcast_small


def dimension_members(df: DataFrame, spec: DimSpec, wider: DataFrame | None = None) -> DataFrame:
    """Distinct natural keys.  Read from a wider dimension when one holds all the keys."""
    return (df if wider is None else wider).select(*spec.keys).distinct()


def build_dimensions(df: DataFrame, spec: StarSpec, store: Store, scratch: Store) -> dict[str, DataFrame]:
    """All dimensions, each numbered 1…N in the order of its keys and written."""

    def build(dim: DimSpec, wider: DataFrame | None = None) -> DataFrame:
        members = dimension_members(df, dim, wider)
        numbered = number_rows(members, dim.order, dim.sk, scratch)
        return store.save(numbered.select(*dim.keys, dim.sk), dim.name)

    def container(dim: DimSpec) -> DimSpec | None:
        return next(
            (d for d in spec.dims if d is not dim and set(dim.keys) < set(d.keys)), None
        )

    wide = [d for d in spec.dims if container(d) is None]
    with ThreadPoolExecutor(max_workers=len(wide)) as pool:
        task = inheritable_thread_target(df.sparkSession)(build)
        built = dict(zip([d.name for d in wide], pool.map(task, wide)))
    for d in spec.dims:
        if d.name not in built:
            built[d.name] = build(d, built[container(d).name])
    return {d.name: built[d.name] for d in spec.dims}


def fact_rows(
    df: DataFrame, dims: dict[str, DataFrame], spec: StarSpec, bound: int = BROADCAST_BYTES
) -> DataFrame:
    """Every source row with its surrogate keys in place of the natural ones."""
    sized = broadcast_small(dims, bound)
    for d in spec.dims:
        df = null_safe_lookup(df, sized[d.name], d.keys, d.sk)
    carried = [fixed.PERIOD] if fixed.PERIOD in df.columns else []
    return df.select(spec.line_key, *spec.sks, *spec.amounts, *spec.attributes, *carried)


@dataclass(frozen=True)
class Warehouse:
    """Dimensions and the fact.  The fact also carries the period it is partitioned by,
    so that a filter on the period prunes folders."""

    spec: StarSpec
    dims: dict[str, DataFrame]
    fact: DataFrame

    @cached_property
    def _sized(self) -> dict[str, DataFrame]:
        return broadcast_small(self.dims)

    def dim(self, name: str) -> DataFrame:
        """A dimension to join to, with a broadcast hint if it is small."""
        return self._sized[name]

    def fact_table(self) -> DataFrame:
        """The fact in its documented shape (period only as a key)."""
        return self.fact.select(
            fixed.FACT_KEY, self.spec.line_key, *self.spec.sks, *self.spec.amounts,
            *self.spec.attributes,
        )


def build_warehouse(clean: DataFrame, store: Store) -> Warehouse:
    """Filter, number the dimensions, look up keys, number the fact, write, check."""
    with Store.scratch(clean.sparkSession) as scratch:
        return _built(clean, store, scratch)


def _built(clean: DataFrame, store: Store, scratch: Store) -> Warehouse:
    source = apply_filter(clean, "filtro_olap")
    spec = StarSpec.of(clean.columns)
    dims = build_dimensions(source, spec, store, scratch)
    require_unique(dims, spec.dims)
    rows = fact_rows(source, dims, spec)

    def ordered(numbered: DataFrame) -> DataFrame:
        require_matched(numbered, spec.sks)
        # In key order inside each period, so that row groups hold narrow key ranges.
        return numbered.sortWithinPartitions(fixed.PERIOD, fixed.FACT_KEY)

    if clean.count() <= SLICE_ROWS:
        slices = iter([number_rows(rows, spec.fact_order, fixed.FACT_KEY, scratch)])
    else:
        slices = numbered_slices(rows, spec.fact_order, fixed.FACT_KEY, SLICE_ROWS)
    fact = store.save_slices(map(ordered, slices), fixed.FACT, by=(fixed.PERIOD,))
    return Warehouse(spec, dims, fact)


def load_warehouse(spark: SparkSession, store: Store) -> Warehouse:
    spec_names = [n for n in fixed.DIMENSIONS if store.has(n)]
    if not store.has(fixed.FACT) or not spec_names:
        raise FileNotFoundError(f"no warehouse under {store.root}; build it first")
    dims = {n: store.load(n) for n in spec_names}
    fact = store.load(fixed.FACT)
    # Partition folders lose the type of the period; the dimension knows it.
    kind = dims["dim_tiempo"].schema[fixed.PERIOD].dataType
    schema = fact.schema
    schema[fixed.PERIOD].dataType = kind
    fact = spark.read.schema(schema).parquet(store.path(fixed.FACT))
    columns = {c for d in dims.values() for c in d.columns} | set(fact.columns)
    return Warehouse(StarSpec.of(columns), dims, fact)


def orphans(wh: Warehouse) -> DataFrame:
    """Fact rows whose key is null or has no member, per dimension."""
    parts = []
    for d in wh.spec.dims:
        per_key = wh.fact.groupBy(d.sk).agg(F.count("*").alias("n"))
        lost = per_key.join(wh.dim(d.name).select(d.sk), d.sk, "left_anti")
        parts.append(
            lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
            .select(F.lit(d.name).alias("dimension"), "orphan_rows")
        )
    return reduce(DataFrame.unionByName, parts)


def warehouse_report(wh: Warehouse, views: int) -> DataFrame:
    """One row per check: fact rows, orphans, members per dimension, views; ``ok`` holds
    on every row only if no row is orphaned, the fact is not empty and views suffice."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in wh.spec.sks])
    facts = wh.fact.agg(F.count("*").alias("n"), F.count_if(missing).alias("lost"))
    checks = facts.select(
        F.inline(
            F.array(
                F.struct(F.lit("fact_ejecucion_rows").alias("check"), F.col("n").alias("value")),
                F.struct(F.lit("orphan_fact_rows").alias("check"), F.col("lost").alias("value")),
                F.struct(
                    F.lit("olap_views").alias("check"), F.lit(views).cast("long").alias("value")
                ),
            )
        )
    )
    counts = [
        wh.dims[d.name].agg(F.count("*").alias("value")).select(F.lit(d.name).alias("check"), "value")
        for d in wh.spec.dims
    ]
    rows = reduce(DataFrame.unionByName, counts, checks)  # a row per check
    found = rows.agg(F.map_from_entries(F.collect_list(F.struct("check", "value"))).alias("found"))
    good = (
        (F.col("found")["orphan_fact_rows"] == 0)
        & (F.col("found")["fact_ejecucion_rows"] > 0)
        & (F.col("found")["olap_views"] >= 8)
    )
    return found.select(F.explode("found").alias("check", "value"), good.alias("ok"))


def key_uniqueness(wh: Warehouse) -> DataFrame:
    return repeated_keys(wh.dims, wh.spec.dims)
